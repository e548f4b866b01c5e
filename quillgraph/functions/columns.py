"""Expressions as Spark columns, with NULL for a fault.

The language has no null value, so a fault (an absent field, an overflow, a division by zero)
can be NULL throughout: scalar functions pass it on, ``coalesce`` swallows it, ``if``, ``all`` and ``any``
evaluate from left to right. No compiled expression throws, not even in a branch that is not taken.

Reductions over groups are columns of a table of groups (see ``Reductions``), so a guard or an
assigned value is an ordinary expression once they are there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..expr import REDUCTIONS, Expr
from ..schema import Field, SchemaError
from . import decimals

BIG = "decimal(38,0)"
NS = 10**9


@dataclass
class Typed:
    """A column, its value kind, and the digits of a native decimal."""

    col: Column
    kind: str
    digits: tuple[int, int] | None = None

    def text(self) -> Column:
        return decimals.canonical(self.col, self.digits[1]) if self.digits else self.col

    def key(self) -> Column:
        """What orders and compares like the value."""
        return decimals.order_key(self.text()) if self.kind == V.DECIMAL and not self.digits else self.col


def null(kind: str = "boolean") -> Column:
    return F.lit(None).cast(kind)


def every(parts: list[Column]) -> Column:
    """True if all are; the first that is not true decides, NULL if it is NULL."""
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = F.when(p.isNull(), null()).when(~p, F.lit(False)).otherwise(out)
    return out


def some(parts: list[Column]) -> Column:
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = F.when(p.isNull(), null()).when(p, F.lit(True)).otherwise(out)
    return out


def floor_div(a: Column, n: int) -> Column:
    """Floored division of a BIGINT by a positive number."""
    return F.call_function("div", a, F.lit(n)) - F.when(a % n < 0, 1).otherwise(0)


def day_of(ns: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ns, 86400 * NS).cast("int"))


class Compiler:
    """Compiles expressions given the columns of fields and, for group scopes, of reductions."""

    def __init__(self, fields: Callable[[str], tuple[Column, Field]], reductions: dict[Expr, Typed] | None = None):
        self.fields, self.reductions = fields, reductions or {}

    def bool(self, e: Expr) -> Column:
        return self.typed(e).col

    def typed(self, e: Expr) -> Typed:
        if e.kind in REDUCTIONS:
            return self.reductions[e]
        if e.kind == "literal":
            return self.literal(e.value)
        if e.kind == "field":
            col, f = self.fields(e.path)
            return Typed(col, f.kind, f.digits if f.kind == V.DECIMAL else None)
        if e.kind == "exists":
            return Typed(self.fields(e.path)[0].isNotNull(), V.BOOL)
        return getattr(self, f"_{e.kind}")(e, *[self.typed(a) for a in e.args])

    @staticmethod
    def literal(v: V.Value) -> Typed:
        if v.kind == V.DECIMAL:
            shape = v.data.as_tuple()
            scale = max(0, -shape.exponent)
            precision = max(len(shape.digits) + max(0, shape.exponent), scale)
            if precision <= 38:
                return Typed(F.lit(v.text()).cast(f"decimal({max(precision, 1)},{scale})"), V.DECIMAL, (max(precision, 1), scale))
            return Typed(F.lit(v.text()), V.DECIMAL)
        spark = {V.INT64: "bigint", V.TIMESTAMP: "bigint", V.DURATION: "bigint", V.DATE: "date"}.get(v.kind, "string")
        return Typed(F.lit(v.text() if v.kind == V.DATE else v.data).cast(spark), v.kind)

    def _not(self, e: Expr, a: Typed) -> Typed:
        return Typed(~a.col, V.BOOL)

    def _all(self, e: Expr, *parts: Typed) -> Typed:
        return Typed(every([p.col for p in parts]), V.BOOL)

    def _any(self, e: Expr, *parts: Typed) -> Typed:
        return Typed(some([p.col for p in parts]), V.BOOL)

    def _equal(self, e: Expr, a: Typed, b: Typed) -> Typed:
        a, b = common(a, b)
        return Typed(a.col == b.col, V.BOOL)

    def _less(self, e: Expr, a: Typed, b: Typed) -> Typed:
        a, b = common(a, b)
        return Typed(a.key() < b.key(), V.BOOL)

    def _if(self, e: Expr, c: Typed, a: Typed, b: Typed) -> Typed:
        a, b = common(a, b)
        return Typed(F.when(c.col.isNull(), F.lit(None)).when(c.col, a.col).otherwise(b.col), a.kind, wider(a, b))

    def _coalesce(self, e: Expr, *parts: Typed) -> Typed:
        parts = common(*parts)
        return Typed(F.coalesce(*[p.col for p in parts]), parts[0].kind, wider(*parts))

    def _clamp(self, e: Expr, x: Typed, lo: Typed, hi: Typed) -> Typed:
        x, lo, hi = common(x, lo, hi)
        k, a, b = x.key(), lo.key(), hi.key()
        out = F.when(k.isNull() | a.isNull() | b.isNull() | (a > b), F.lit(None)).when(k < a, lo.col).when(k > b, hi.col).otherwise(x.col)
        return Typed(out, x.kind, wider(x, lo, hi))

    def _add(self, e: Expr, a: Typed, b: Typed) -> Typed:
        if V.TIMESTAMP in (a.kind, b.kind):
            return moved(*((a, b) if a.kind == V.TIMESTAMP else (b, a)), 1)
        if a.kind == V.DECIMAL:
            return decimal_result("add", a, b)
        return Typed(F.try_add(a.col, b.col), a.kind)

    _timestamp_add = _add

    def _subtract(self, e: Expr, a: Typed, b: Typed) -> Typed:
        if a.kind == V.TIMESTAMP:
            return self._timestamp_diff(e, a, b) if b.kind == V.TIMESTAMP else moved(a, b, -1)
        if a.kind == V.DECIMAL:
            return decimal_result("subtract", a, b)
        return Typed(F.try_subtract(a.col, b.col), a.kind)

    def _timestamp_diff(self, e: Expr, a: Typed, b: Typed) -> Typed:
        return Typed(F.call_function("div", a.col.cast("decimal(20,0)") - b.col.cast("decimal(20,0)"), F.lit(NS).cast("decimal(20,0)")), V.DURATION)

    def _multiply(self, e: Expr, a: Typed, b: Typed) -> Typed:
        if a.kind == V.DECIMAL:
            return decimal_result("multiply", a, b)
        return Typed(F.try_multiply(a.col, b.col), V.DURATION if V.DURATION in (a.kind, b.kind) else V.INT64)

    def _divide(self, e: Expr, a: Typed, b: Typed) -> Typed:
        if a.kind == V.DECIMAL:
            return decimal_quotient(a, b)
        return Typed(F.call_function("div", *safe_operands(a.col, b.col)), V.INT64)

    def _modulo(self, e: Expr, a: Typed, b: Typed) -> Typed:
        x, y = safe_operands(a.col, b.col)
        return Typed(x % y, V.INT64)

    def _abs(self, e: Expr, a: Typed) -> Typed:
        if a.kind == V.DECIMAL:
            return Typed(F.abs(a.col), V.DECIMAL, a.digits) if a.digits else Typed(decimals.absolute(a.col), V.DECIMAL)
        return Typed(F.abs(F.when(a.col != V.INT_MIN, a.col)), a.kind)

    def _date_extract(self, e: Expr, a: Typed) -> Typed:
        day = a.col if a.kind == V.DATE else day_of(a.col)
        second = F.pmod(floor_div(a.col, NS), F.lit(86400)) if a.kind == V.TIMESTAMP else None
        part = {
            "year": lambda: F.year(day), "month": lambda: F.month(day), "day": lambda: F.dayofmonth(day), "day_of_week": lambda: F.weekday(day) + 1,
            "hour": lambda: F.call_function("div", second, F.lit(3600)), "minute": lambda: F.call_function("div", second, F.lit(60)) % 60, "second": lambda: second % 60,
        }[e.unit]
        return Typed(part().cast("bigint"), V.INT64)

    def _concat(self, e: Expr, *parts: Typed) -> Typed:
        return Typed(F.concat(*[p.col for p in parts]), V.STRING)

    def _substring(self, e: Expr, s: Typed, start: Typed, n: Typed) -> Typed:
        most = F.lit(2**31 - 2).cast("bigint")
        safe = lambda c, x: F.when(c.col >= 0, x)
        at, size = safe(start, F.least(F.greatest(start.col, F.lit(0)), most).cast("int") + 1), safe(n, F.least(F.greatest(n.col, F.lit(0)), most).cast("int"))
        return Typed(F.call_function("substring", s.col, at, size), V.STRING)

    def _trim(self, e: Expr, a: Typed) -> Typed:
        return Typed(F.regexp_replace(a.col, r"(?U)^\s+|\s+$", ""), V.STRING)


def safe_operands(a: Column, b: Column) -> tuple[Column, Column]:
    """Operands that make / and % NULL where they would throw or wrap."""
    return F.when(~((a == V.INT_MIN) & (b == -1)), a), F.when(b != 0, b)


def moved(at: Typed, by: Typed, sign: int) -> Typed:
    out = at.col.cast(BIG) + by.col.cast(BIG) * F.lit(sign * NS).cast("decimal(11,0)")
    return Typed(out.cast(BIG).try_cast("bigint"), V.TIMESTAMP)


def wider(*parts: Typed) -> tuple[int, int] | None:
    """The digits that hold all, as Spark's common type has them."""
    if not all(p.digits for p in parts):
        return None
    scale = max(p.digits[1] for p in parts)
    return max(p.digits[0] - p.digits[1] for p in parts) + scale, scale


def common(*parts: Typed) -> tuple[Typed, ...]:
    """All native, if one type holds them exactly, else all text."""
    if parts[0].kind != V.DECIMAL or ((w := wider(*parts)) and w[0] <= 38):
        return parts
    return tuple(Typed(p.text(), V.DECIMAL) for p in parts)


def decimal_quotient(a: Typed, b: Typed) -> Typed:
    """Native steps where declared digits allow them, and a native quotient where that fits 38 digits as well."""
    out = decimals.quotient(a.col, b.col, a.digits, b.digits) if a.digits and b.digits else None
    if out is None:
        return Typed(decimals.binary("divide", a.text(), b.text()), V.DECIMAL)
    digits = (a.digits[0] + b.digits[1] + 18, a.digits[1] + 18)
    return Typed(out.cast(f"decimal({digits[0]},{digits[1]})"), V.DECIMAL, digits) if digits[0] <= 38 else Typed(out, V.DECIMAL)


def decimal_result(op: str, a: Typed, b: Typed) -> Typed:
    """Native where the exact result fits 38 digits."""
    if a.digits and b.digits:
        if op == "multiply":
            p, s = a.digits[0] + b.digits[0] + 1, a.digits[1] + b.digits[1]
        else:
            p, s = wider(a, b)
            p += 1
        if p <= 38:
            return Typed({"add": a.col + b.col, "subtract": a.col - b.col, "multiply": a.col * b.col}[op], V.DECIMAL, (p, s))
    return Typed(decimals.binary(op, a.text(), b.text()), V.DECIMAL)


def stored(t: Typed, f: Field) -> Column:
    """A value as the column type of a field; a decimal that does not fit the declared digits is a fault."""
    if f.kind != V.DECIMAL:
        return t.col
    if not f.digits:
        return t.text()
    target = f"decimal({f.digits[0]},{f.digits[1]})"
    out = t.col.try_cast(target)
    a, b = common(Typed(out, V.DECIMAL, f.digits), t)
    return F.when(a.col == b.col, out)


class Reductions:
    """The group reductions of some expressions, as aggregates of a table of groups.

    Aggregates combine partially and never hold a group. Two cases need the order of the members:
    ``all_equal`` with absent fields, and a ``sum`` whose partial sums might leave 64 bits though the total
    does not. They set ``__unsure``; ``exact`` adds the ordered windows that decide them.
    """

    def __init__(self, exprs: list[Expr], member: Compiler, exact: bool = False):
        self.member, self.exact = member, exact
        self.found = list(dict.fromkeys(e for x in exprs for e in x.walk() if e.kind in REDUCTIONS))
        self.names = {e: f"__r{i}" for i, e in enumerate(self.found)}

    def prepared(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows with the ordered helper columns, where exact."""
        if not self.exact:
            return rows
        w = Window.partitionBy(key).orderBy("id")
        for e, name in self.names.items():
            if e.kind == "all_equal":
                rows = rows.withColumn(f"{name}_first", F.first(self.member.fields(e.path)[0]).over(w))
            elif e.kind == "sum" and self.member.fields(e.path)[1].kind != V.DECIMAL:
                rows = rows.withColumn(f"{name}_prefix", F.sum(self.member.fields(e.path)[0].cast(BIG)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return rows

    def aggregates(self) -> list[Column]:
        out, unsure = [], F.lit(False)
        for e, name in self.names.items():
            col, doubt = self.aggregate(e, name)
            out.append(col.alias(name))
            if doubt is not None:
                unsure = unsure | F.coalesce(doubt, F.lit(False))
        return [*out, unsure.alias("__unsure")]

    def aggregate(self, e: Expr, name: str) -> tuple[Column, Column | None]:
        if e.kind == "count":
            return F.count(F.lit(1)), None
        if e.kind in ("all_members", "any_members"):
            return ordered_quantifier(self.member.bool(e.args[0]), e.kind == "all_members"), None
        col, f = self.member.fields(e.path)
        absent = F.count(col) < F.count(F.lit(1))
        if e.kind == "all_equal":
            if self.exact:
                return ordered_quantifier(col == F.col(f"{name}_first"), True), None
            first, same = F.min_by(col, "id"), F.min(col) == F.max(col)
            return F.when(first.isNull() | (absent & same), null()).otherwise(same), absent & first.isNotNull() & ~same
        if e.kind == "sum":
            if f.kind == V.DECIMAL:
                exact_sum = F.try_sum(col) if f.digits and f.digits[0] <= 28 else decimals.total(Typed(col, V.DECIMAL, f.digits).text())
                return F.when(~absent, exact_sum), None
            total = F.sum(col.cast("decimal(19,0)"))
            fits = total.between(V.INT_MIN, V.INT_MAX)
            if self.exact:
                prefix = F.col(f"{name}_prefix")
                fits = (F.min(prefix) >= V.INT_MIN) & (F.max(prefix) <= V.INT_MAX)
                return F.when(~absent & fits, total.try_cast("bigint")), None
            return F.when(~absent & fits, total.try_cast("bigint")), F.sum(F.abs(col.cast("decimal(19,0)"))) > V.INT_MAX
        pick = {"min": (F.min, F.min_by), "max": (F.max, F.max_by)}[e.kind]
        t = Typed(col, f.kind, f.digits)
        return F.when(~absent, pick[0](col) if f.kind != V.DECIMAL or f.digits else pick[1](col, t.key())), None

    def of_one(self, e: Expr) -> Column:
        """The reduction of a group of one entity, as a value of its row."""
        if e.kind == "count":
            return F.lit(1).cast("bigint")
        if e.kind in ("all_members", "any_members"):
            return self.member.bool(e.args[0])
        col, f = self.member.fields(e.path)
        if e.kind == "all_equal":
            return F.when(col.isNotNull(), F.lit(True))
        if e.kind == "sum" and f.kind == V.DECIMAL and f.digits:
            return col.cast(f"decimal({f.digits[0] + 10},{f.digits[1]})") if f.digits[0] <= 28 else Typed(col, f.kind, f.digits).text()
        return col

    def typed(self) -> dict[Expr, Typed]:
        """The reductions as columns of the table of groups."""
        out = {}
        for e, name in self.names.items():
            if e.kind == "count":
                out[e] = Typed(F.col(name), V.INT64)
            elif e.kind in ("all_members", "any_members", "all_equal"):
                out[e] = Typed(F.col(name), V.BOOL)
            else:
                f = self.member.fields(e.path)[1]
                digits = f.digits if f.kind == V.DECIMAL else None
                if e.kind == "sum" and digits:
                    digits = (digits[0] + 10, digits[1]) if digits[0] <= 28 else None
                out[e] = Typed(F.col(name), f.kind, digits)
        return out


def ordered_quantifier(p: Column, forall: bool) -> Column:
    """The first member in id order that is not ``forall`` decides: its value, or NULL."""
    off = ~p.eqNullSafe(F.lit(forall))
    return F.when(F.count_if(off) == 0, F.lit(forall)).otherwise(F.min_by(p, F.when(off, F.col("id"))))


def kind_fields(fields: dict[str, Field], rename: Callable[[str], str] = lambda n: n) -> Callable[[str], tuple[Column, Field]]:
    """Looks up "entity.field" paths among the fields of one entity kind."""

    def find(path: str) -> tuple[Column, Field]:
        name = path.partition(".")[2]
        if name not in fields:
            raise SchemaError(f"no field {path}")
        return F.col(f"`{rename(name)}`"), fields[name]

    return find
