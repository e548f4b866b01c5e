"""The closed expression language: 30 kinds, their bounds, and the type checker of its scopes.

Scopes: MEMBER (one entity), GROUP (a group as a whole: reductions and quantifiers, no bare field),
MEMBER_IN_GROUP (an entity and the group around it), PAIR (two entities, under ``from.`` and ``to.`` or their kinds).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from . import values as V
from .schema import Schema
from .values import Value

MEMBER, GROUP, MEMBER_IN_GROUP, PAIR = "member", "group", "member-in-group", "pair"
MAX_DEPTH, MAX_NODES = 64, 4096
UNITS = ("year", "month", "day", "hour", "minute", "second", "day_of_week")
#: Kind -> least and most operands.
ARITY = {
    "literal": (0, 0), "field": (0, 0), "exists": (0, 0), "not": (1, 1), "all": (1, None), "any": (1, None), "equal": (2, 2), "less": (2, 2),
    "add": (2, 2), "all_members": (1, 1), "any_members": (1, 1), "all_equal": (0, 0), "count": (0, 0), "sum": (0, 0), "min": (0, 0), "max": (0, 0),
    "subtract": (2, 2), "multiply": (2, 2), "divide": (2, 2), "modulo": (2, 2), "abs": (1, 1), "clamp": (3, 3), "timestamp_add": (2, 2), "timestamp_diff": (2, 2),
    "date_extract": (1, 1), "concat": (2, None), "substring": (3, 3), "trim": (1, 1), "if": (3, 3), "coalesce": (1, None),
}
REDUCTIONS = frozenset({"all_members", "any_members", "all_equal", "count", "sum", "min", "max"})
WITH_FIELD = frozenset({"field", "exists", "all_equal", "sum", "min", "max"})


class ExpressionError(ValueError):
    """An expression that breaks the language's rules."""


@dataclass(frozen=True)
class Expr:
    kind: str
    args: tuple[Expr, ...] = ()
    value: Value | None = None
    path: str | None = None
    unit: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ARITY:
            raise ExpressionError(f"no such expression: {self.kind}")
        least, most = ARITY[self.kind]
        if len(self.args) < least or (most is not None and len(self.args) > most):
            raise ExpressionError(f"{self.kind} takes {least}{'' if most == least else ' or more'} operands, not {len(self.args)}")
        if (self.kind == "literal") != (self.value is not None) or (self.kind in WITH_FIELD) != (self.path is not None):
            raise ExpressionError(f"{self.kind}: wrong payload")
        if (self.kind == "date_extract") != (self.unit is not None) or (self.unit and self.unit.lower() not in UNITS):
            raise ExpressionError(f"{self.kind}: no such unit: {self.unit}")

    def walk(self) -> Iterator[Expr]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(reversed(e.args))

    def paths(self) -> set[str]:
        return {e.path for e in self.walk() if e.path}

    def check_bounds(self) -> None:
        stack, nodes = [(self, 1)], 0
        while stack:
            e, depth = stack.pop()
            nodes += 1
            if depth > MAX_DEPTH or nodes > MAX_NODES:
                raise ExpressionError(f"deeper than {MAX_DEPTH} or larger than {MAX_NODES} nodes")
            stack.extend((a, depth + 1) for a in e.args)


def lit(v: Value | str | int) -> Expr:
    """A literal; str and int stand for string and int64."""
    return Expr("literal", value=v if isinstance(v, Value) else V.string(v) if isinstance(v, str) else V.int64(v))


def field(path: str) -> Expr:
    return Expr("field", path=path)


def exists(path: str) -> Expr:
    return Expr("exists", path=path)


def count() -> Expr:
    return Expr("count")


def over(kind: str, path: str) -> Expr:
    """sum, min, max or all_equal of a field."""
    return Expr(kind, path=path)


def extract(unit: str, of: Expr) -> Expr:
    return Expr("date_extract", (of,), unit=unit.lower())


def call(kind: str, *args: Expr) -> Expr:
    return Expr(kind, tuple(args))


TRUE = call("equal", lit(1), lit(1))


class Checker:
    """Finds the type of an expression in a scope, or raises ExpressionError."""

    def __init__(self, schema: Schema, kind: str, other: str | None = None):
        self.schema, self.kind, self.other = schema, kind, other

    def field_type(self, path: str, scope: str) -> str:
        entity, _, name = path.partition(".")
        if scope == PAIR:
            if entity in ("from", "to"):
                entity = self.kind if entity == "from" else self.other
            elif self.kind == self.other:
                raise ExpressionError(f"{path}: both ends are {entity}; say from. or to.")
            elif entity not in (self.kind, self.other):
                raise ExpressionError(f"{path}: neither end is {entity}")
        elif entity != self.kind:
            raise ExpressionError(f"{path}: the selection is of {self.kind}")
        found = self.schema.kind_of(f"{entity}.{name}")
        if found is None:
            raise UnknownField(path)
        return found

    def type_of(self, e: Expr, scope: str) -> str:
        e.check_bounds()
        return self._type(e, scope)

    def _type(self, e: Expr, scope: str) -> str:
        k = e.kind
        if k in REDUCTIONS:
            if scope not in (GROUP, MEMBER_IN_GROUP):
                raise ExpressionError(f"{k} needs a group")
            if k in ("all_members", "any_members"):
                self.want(e.args[0], MEMBER, V.BOOL)
                return V.BOOL
            if k == "count":
                return V.INT64
            t = self.field_type(e.path, MEMBER)
            if k == "all_equal":
                return V.BOOL
            if t not in ({V.INT64, V.DECIMAL, V.DURATION} if k == "sum" else V.ORDERED):
                raise ExpressionError(f"{k} of {t}")
            return t
        if k == "literal":
            return e.value.kind
        if k in ("field", "exists"):
            if scope == GROUP:
                raise ExpressionError(f"{e.path}: a bare field has no value for a group")
            t = self.field_type(e.path, scope)
            return t if k == "field" else V.BOOL
        types = [self._type(a, scope) for a in e.args]
        a, b = (types + [None, None])[:2]
        if k in ("not", "all", "any"):
            return V.BOOL if set(types) == {V.BOOL} else self.no(e, types)
        if k == "equal":
            return V.BOOL if a == b else self.no(e, types)
        if k == "less":
            return V.BOOL if a == b and a in V.ORDERED else self.no(e, types)
        if k == "if":
            return b if a == V.BOOL and b == types[2] else self.no(e, types)
        if k == "coalesce":
            return a if len(set(types)) == 1 else self.no(e, types)
        if k == "clamp":
            return a if len(set(types)) == 1 and a in V.ORDERED else self.no(e, types)
        if k == "concat":
            return V.STRING if set(types) == {V.STRING} else self.no(e, types)
        if k == "date_extract":
            timed = e.unit in ("hour", "minute", "second")
            return V.INT64 if a == V.TIMESTAMP or (a == V.DATE and not timed) else self.no(e, types)
        table = {
            "add": {(V.INT64, V.INT64): V.INT64, (V.DECIMAL, V.DECIMAL): V.DECIMAL, (V.DURATION, V.DURATION): V.DURATION, (V.TIMESTAMP, V.DURATION): V.TIMESTAMP, (V.DURATION, V.TIMESTAMP): V.TIMESTAMP},
            "subtract": {(V.INT64, V.INT64): V.INT64, (V.DECIMAL, V.DECIMAL): V.DECIMAL, (V.DURATION, V.DURATION): V.DURATION, (V.TIMESTAMP, V.TIMESTAMP): V.DURATION, (V.TIMESTAMP, V.DURATION): V.TIMESTAMP},
            "multiply": {(V.INT64, V.INT64): V.INT64, (V.DECIMAL, V.DECIMAL): V.DECIMAL, (V.DURATION, V.INT64): V.DURATION, (V.INT64, V.DURATION): V.DURATION},
            "divide": {(V.INT64, V.INT64): V.INT64, (V.DECIMAL, V.DECIMAL): V.DECIMAL},
            "modulo": {(V.INT64, V.INT64): V.INT64},
            "abs": {(V.INT64,): V.INT64, (V.DECIMAL,): V.DECIMAL, (V.DURATION,): V.DURATION},
            "timestamp_add": {(V.TIMESTAMP, V.DURATION): V.TIMESTAMP, (V.DURATION, V.TIMESTAMP): V.TIMESTAMP},
            "timestamp_diff": {(V.TIMESTAMP, V.TIMESTAMP): V.DURATION},
            "substring": {(V.STRING, V.INT64, V.INT64): V.STRING},
            "trim": {(V.STRING,): V.STRING},
        }[k]
        return table.get(tuple(types)) or self.no(e, types)

    def want(self, e: Expr, scope: str, kind: str) -> None:
        if (t := self._type(e, scope)) != kind:
            raise ExpressionError(f"{e.kind} is {t}, not {kind}")

    @staticmethod
    def no(e: Expr, types: list[str]) -> str:
        raise ExpressionError(f"{e.kind} does not take {', '.join(types)}")


class UnknownField(ExpressionError):
    """A path that the schema does not have."""

    def __init__(self, path: str):
        super().__init__(f"unknown field {path}")
        self.path = path
