"""Schemas: a closed set of entity kinds with typed fields, and of relation kinds between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from . import values as V

RELATION_COLUMNS = ("kind", "from_kind", "from_id", "to_kind", "to_id")
RELATION_TYPE = T.StructType([T.StructField(c, T.StringType(), False) for c in RELATION_COLUMNS])


class SchemaError(ValueError):
    """A schema, rule or state that breaks the rules of its construction."""


@dataclass(frozen=True)
class Field:
    """A field. ``digits`` is (precision, scale): a decimal of that size is a native column, others are text."""

    name: str
    kind: str
    required: bool = False
    digits: tuple[int, int] | None = None

    def spark_type(self) -> T.DataType:
        if self.kind == V.DECIMAL and self.digits:
            return T.DecimalType(*self.digits)
        return {V.INT64: T.LongType(), V.TIMESTAMP: T.LongType(), V.DURATION: T.LongType(), V.DATE: T.DateType()}.get(self.kind, T.StringType())


@dataclass(frozen=True)
class EntityKind:
    name: str
    fields: tuple[Field, ...]

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.StringType(), False), *(T.StructField(f.name, f.spark_type(), True, {"kind": f.kind, "required": f.required}) for f in self.fields)])


@dataclass(frozen=True)
class RelationKind:
    name: str
    from_kind: str
    to_kind: str


@dataclass(frozen=True)
class Schema:
    entities: tuple[EntityKind, ...]
    relations: tuple[RelationKind, ...] = ()

    def __post_init__(self) -> None:
        names = [e.name for e in self.entities]
        if len(set(names)) < len(names) or len({r.name for r in self.relations}) < len(self.relations):
            raise SchemaError("kinds must have different names")
        for e in self.entities:
            fields = [f.name for f in e.fields]
            if not e.name or "" in fields or len(set(fields)) < len(fields):
                raise SchemaError(f"{e.name or 'a kind'}: names must be there and differ")
            for f in e.fields:
                if f.kind not in V.KIND_BYTES:
                    raise SchemaError(f"{e.name}.{f.name}: no such kind: {f.kind}")
        for r in self.relations:
            if not r.name or r.from_kind not in names or r.to_kind not in names:
                raise SchemaError(f"relation {r.name}: an end is no declared kind")

    def entity(self, name: str) -> EntityKind | None:
        return next((e for e in self.entities if e.name == name), None)

    def relation(self, name: str) -> RelationKind | None:
        return next((r for r in self.relations if r.name == name), None)

    def kind_of(self, path: str) -> str | None:
        """The value kind of "entity.field"."""
        entity, _, name = path.partition(".")
        found = self.entity(entity)
        field = found.field(name) if found else None
        return field.kind if field else None
