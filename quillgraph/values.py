"""Scalar values: seven kinds, exact and without null.

Columns hold them as: string, atom -> STRING; int64 -> BIGINT; timestamp -> BIGINT
(nanoseconds since the epoch, UTC); duration -> BIGINT (seconds); date -> DATE;
decimal -> DECIMAL(p, s) where the field declares both, else STRING (canonical digits).
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Context, Decimal, InvalidOperation

STRING, ATOM, INT64, TIMESTAMP, DURATION, DECIMAL, DATE, BOOL = "string", "atom", "int64", "timestamp", "duration", "decimal", "date", "bool"
#: Kinds that a field can have, with the byte that marks each in canonical bytes.
KIND_BYTES = {STRING: 1, ATOM: 2, INT64: 3, TIMESTAMP: 4, DURATION: 5, DECIMAL: 6, DATE: 7}
ORDERED = frozenset({INT64, TIMESTAMP, DURATION, DECIMAL, DATE})
INT_MIN, INT_MAX = -(2**63), 2**63 - 1
MAX_DIGITS = 1000
EXACT = Context(prec=3 * MAX_DIGITS, Emax=10**6, Emin=-(10**6))
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
_TIMESTAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(?:Z|[+-]00:00)", re.ASCII)
_DECIMAL = re.compile(r"[+-]?(\d+)(?:\.(\d+))?", re.ASCII)
_DURATION = re.compile(r"(-?\d+)([hms]?)", re.ASCII)


class ValueError_(ValueError):
    """A text that is no value of its kind."""


@dataclass(frozen=True)
class Value:
    """A literal: ``data`` is str, int, Decimal or date, by kind."""

    kind: str
    data: object

    def text(self) -> str:
        """The canonical text."""
        if self.kind == TIMESTAMP:
            return format_timestamp(self.data)
        if self.kind == DECIMAL:
            return format_decimal(self.data)
        return self.data.isoformat() if self.kind == DATE else str(self.data)


def string(x: str) -> Value:
    return Value(STRING, x)


def atom(x: str) -> Value:
    return Value(ATOM, x)


def int64(x: int) -> Value:
    if not INT_MIN <= x <= INT_MAX:
        raise ValueError_(f"{x} is beyond 64 bits")
    return Value(INT64, x)


def duration(x: int | str) -> Value:
    """Whole seconds, or text such as "8h", "30m", "5s" or "90"."""
    if isinstance(x, str):
        m = _DURATION.fullmatch(x)
        if not m:
            raise ValueError_(f"no duration: {x!r}")
        x = int(m[1]) * {"h": 3600, "m": 60, "s": 1, "": 1}[m[2]]
    return Value(DURATION, int64(x).data)


def timestamp(x: str | int) -> Value:
    return Value(TIMESTAMP, parse_timestamp(x) if isinstance(x, str) else int64(x).data)


def date(x: str | dt.date) -> Value:
    if isinstance(x, str):
        if not re.fullmatch(r"\d{4}-\d\d-\d\d", x, re.ASCII):
            raise ValueError_(f"no date: {x!r}")
        try:
            x = dt.date.fromisoformat(x)
        except ValueError as e:
            raise ValueError_(str(e)) from e
    return Value(DATE, x)


def decimal(x: str | Decimal | int) -> Value:
    return Value(DECIMAL, parse_decimal(str(x)))


def parse_timestamp(text: str) -> int:
    """Nanoseconds since the epoch; only UTC, a capital T, at most nine fraction digits, no leap second."""
    m = _TIMESTAMP.fullmatch(text)
    if not m:
        raise ValueError_(f"no UTC timestamp: {text!r}")
    try:
        whole = dt.datetime(*map(int, m.groups()[:6]), tzinfo=dt.UTC)
    except ValueError as e:
        raise ValueError_(str(e)) from e
    span = whole - EPOCH
    ns = (span.days * 86400 + span.seconds) * 10**9 + int((m[7] or "0").ljust(9, "0"))
    if not INT_MIN <= ns <= INT_MAX:
        raise ValueError_(f"{text!r} is beyond the range of nanoseconds")
    return ns


def format_timestamp(ns: int) -> str:
    whole, rest = divmod(ns, 10**9)
    out = (EPOCH + dt.timedelta(seconds=whole)).strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0")
    return out + (f".{rest:09d}".rstrip("0") if rest else "") + "Z"


def parse_decimal(text: str) -> Decimal:
    m = _DECIMAL.fullmatch(text)
    if not m or len(m[1]) + len(m[2] or "") > MAX_DIGITS:
        raise ValueError_(f"no decimal of at most {MAX_DIGITS} digits: {text!r}")
    return normal_decimal(EXACT.create_decimal(text))


def normal_decimal(x: Decimal) -> Decimal:
    """Without trailing zeros of the fraction and without minus zero."""
    if not x:
        return Decimal(0)
    x = EXACT.normalize(x) if x.as_tuple().exponent < 0 else x
    return x.quantize(Decimal(1), context=EXACT) if x.as_tuple().exponent > 0 else x


def format_decimal(x: Decimal) -> str:
    return format(normal_decimal(x), "f")


def decimal_op(op: str, a: Decimal, b: Decimal) -> Decimal | None:
    """Exact add, subtract and multiply; divide truncates 18 digits behind the scale of a. None is a fault."""
    try:
        if op == "divide":
            if not b:
                return None
            places = max(0, -normal_decimal(a).as_tuple().exponent) + 18
            num, den = a.as_integer_ratio(), b.as_integer_ratio()
            top, bottom = num[0] * den[1] * 10**places, num[1] * den[0]
            scaled = abs(top) // abs(bottom)
            out = EXACT.scaleb(EXACT.create_decimal(scaled if (top < 0) == (bottom < 0) else -scaled), -places)
        else:
            out = getattr(EXACT, op)(a, b)
    except InvalidOperation:
        return None
    out = normal_decimal(out)
    return out if len(out.as_tuple().digits) <= MAX_DIGITS and -out.as_tuple().exponent <= MAX_DIGITS else None


def from_text(kind: str, text: str) -> Value:
    """The value that a text stands for."""
    if kind == INT64:
        if not re.fullmatch(r"-?\d+", text, re.ASCII):
            raise ValueError_(f"no int64: {text!r}")
        return int64(int(text))
    return {STRING: string, ATOM: atom, TIMESTAMP: timestamp, DURATION: duration, DECIMAL: decimal, DATE: date}[kind](text)
