"""Exact decimals of any length, as canonical text; Arrow-batched. Declared digits use native columns instead where these are exact,
which ``canonical`` and ``quotient`` turn into the same texts without Python."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import values as V


@F.pandas_udf(StringType())
def _binary(a: pd.Series, b: pd.Series, op: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None, o: str) -> str | None:
        if x is None or y is None:
            return None
        out = V.decimal_op(o, V.parse_decimal(x), V.parse_decimal(y))
        return None if out is None else V.format_decimal(out)

    return pd.Series([one(*row) for row in zip(a, b, op, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _abs(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else x.lstrip("-"))


@F.pandas_udf(StringType())
def _canonical(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else V.format_decimal(Decimal(x)))


@F.pandas_udf(StringType())
def _order_key(a: pd.Series) -> pd.Series:
    """A text whose binary order is the numeric order."""
    flip = str.maketrans("0123456789", "9876543210")

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        whole, _, rest = x.lstrip("-").partition(".")
        key = f"{len(whole):04d}{whole}.{rest}"
        return f"n{key.translate(flip)}~" if x.startswith("-") else f"p{key}"

    return a.map(one)


@F.pandas_udf(StringType())
def _sum(a: pd.Series) -> str:
    total = Decimal(0)
    for x in a.dropna():
        total = V.EXACT.add(total, Decimal(x))
    return V.format_decimal(total)


def binary(op: str, a: Column, b: Column) -> Column:
    return _binary(a, b, F.lit(op))


def absolute(a: Column) -> Column:
    return _abs(a)


def canonical(a: Column, scale: int) -> Column:
    """A native decimal as canonical text. Up to six places its plain text is never in powers of ten, and only zeros go;
    beyond, the whole part and one plus the fraction are written apart, as neither ever is."""
    if scale == 0:
        return a.cast("string")
    if scale <= 6:
        return _trimmed(a.cast("string"))
    if scale > 36:
        return _canonical(a.cast("string"))
    one = F.lit(1).cast("decimal(1,0)")
    return _trimmed(F.concat(F.when(a < 0, "-").otherwise(""), F.floor(F.abs(a)).cast("string"), F.substring((F.abs(a) % one + one).cast("string"), 2, scale + 1)))


def _trimmed(text: Column) -> Column:
    """Digits with a point, without the zeros at the end."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def quotient(a: Column, b: Column, of: tuple[int, int], by: tuple[int, int]) -> Column | None:
    """Canonical text of a / b, cut 18 places behind the canonical scale of a; NULL for a zero divisor.

    ``of`` and ``by`` are the declared digits. All steps are long divisions of whole numbers in native columns, 64 bits wide
    where these do; None where they need more than 38 digits. Texts stand once each, as Catalyst would compute copies again.
    """
    (p, s), (q, t) = of, by
    if p + s + t > 36 or p + t > 31 or q > 18:
        return None
    ten = lambda n: F.lit("1" + "0" * n).cast(f"decimal({n + 1},0)")
    top, bottom = (F.abs(a) * ten(s + t)).cast(f"decimal({p + t},0)"), (F.abs(b) * ten(t)).cast(f"decimal({q},0)")
    long = lambda x, y: F.call_function("div", x, y)
    if p + t <= 18 and q <= 9:
        top, bottom, ten = top.cast("bigint"), bottom.cast("bigint"), lambda n: F.lit(10**n).cast("bigint")
        even, step = long, 9
    else:
        even, step = lambda x, y: ((x - x % y).cast(f"decimal({p + t},0)") / y).cast(f"decimal({p + t},0)"), 18
    bottom = F.when(bottom != 0, bottom)
    whole, left, places = even(top, bottom), top % bottom, []
    for _ in range(18 // step):
        places.append(F.lpad(long(left * ten(step), bottom).cast("string"), step, "0"))
        left = left * ten(step) % bottom
    if s:
        places.insert(0, F.lpad((whole % ten(s)).cast("string"), s, "0"))
        whole = even(whole, ten(s))
    own = (F.abs(a) * F.lit("1" + "0" * s).cast(f"decimal({s + 1},0)")).cast(f"decimal({p},0)").cast("string")
    zeros = F.least(F.length(own) - F.length(F.rtrim(own, F.lit("0"))), F.lit(s))
    minus = F.when(((a < 0) & (b > 0)) | ((a > 0) & (b < 0)), "-").otherwise("")
    return _trimmed(F.concat(minus, whole.cast("string"), F.lit("."), F.substring(F.concat(*places), F.lit(1), F.lit(s + 18) - zeros)))


def order_key(a: Column) -> Column:
    return _order_key(a)


def total(a: Column) -> Column:
    """Exact sum of a group; nulls are left out."""
    return _sum(a)
