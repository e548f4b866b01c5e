"""Graph states: a DataFrame per entity kind and one of relations, under one schema and lineage."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import values as V
from .functions import identity
from .functions.columns import Typed
from .pairs import Pairs
from .schema import RELATION_COLUMNS, RELATION_TYPE, EntityKind, Schema, SchemaError


@dataclass(frozen=True)
class GraphState:
    """Immutable: a rule that is rejected leaves its predecessor in place."""

    schema: Schema
    lineage: str
    entities: dict[str, DataFrame]
    relations: DataFrame
    #: Those of the relations that are kept as pairs, and the rows of the others (None: of all).
    pairs: tuple[Pairs, ...] = ()
    rest: DataFrame | None = None

    @property
    def listed(self) -> DataFrame:
        """The relations that are kept as rows."""
        return self.relations if self.rest is None else self.rest

    @property
    def spark(self) -> SparkSession:
        return self.relations.sparkSession

    def with_kind(self, kind: str, rows: DataFrame) -> GraphState:
        return replace(self, entities=self.entities | {kind: rows})

    def with_relations(self, rows: DataFrame) -> GraphState:
        return replace(self, relations=rows, pairs=(), rest=None)

    def with_pairs(self, listed: DataFrame, pairs: tuple[Pairs, ...]) -> GraphState:
        rows = listed
        for p in pairs:
            rows = rows.unionByName(p.rows())
        return replace(self, relations=rows, pairs=pairs, rest=listed)

    def faults(self) -> list[str]:
        """What breaks the rules of a state: duplicate ids, absent required fields, duplicate or dangling relations."""
        return state_faults(self)

    def checked(self) -> GraphState:
        if found := self.faults():
            raise SchemaError("; ".join(found))
        return self

    def persisted(self, name: str = "state", since: GraphState | None = None) -> GraphState:
        """Cuts the lineage: tables are written to the shared checkpoint folder and read again, but for those that ``since`` has as well."""
        base = f"{checkpoint_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        same = lambda df, old: since is not None and df is old
        done = {k: df if same(df, since and since.entities[k]) else stored_table(df, f"{base}/entities/{k}") for k, df in self.entities.items()}
        done = replace(self, entities=done)
        if same(self.relations, since and since.relations):
            return done
        listed = self.listed if same(self.listed, since and since.listed) else stored_table(self.listed, f"{base}/relations")
        kept = since.pairs if since else ()
        pairs = tuple(p if any(p is q for q in kept) else p.stored(stored_table, f"{base}/pairs-{i}") for i, p in enumerate(self.pairs))
        return done.with_pairs(listed, pairs) if pairs else done.with_relations(listed)

    def digest(self) -> str:
        """The exact state digest: one hash over all entities and relations in order, streamed through the driver. For small states."""
        h = hashlib.sha256()
        for part in self.canonical_bytes():
            h.update(part)
        return "sha256:" + h.hexdigest()

    def canonical_bytes(self) -> Iterator[bytes]:
        yield identity.text(identity.tag("state")) + identity.raw_digest(schema_digest(self.schema)) + identity.raw_digest(self.lineage)
        kinds = sorted(self.entities)
        yield identity.number(sum(self.entities[k].count() for k in kinds))
        for k in kinds:
            kind = self.schema.entity(k)
            for row in self.entities[k].orderBy("id").toLocalIterator():
                known = [(f, row[f.name]) for f in sorted(kind.fields, key=lambda f: f.name) if row[f.name] is not None]
                yield identity.text(k) + identity.raw_digest(row["id"]) + identity.number(len(known))
                for f, x in known:
                    yield identity.text(f.name) + identity.value(V.Value(f.kind, V.normal_decimal(V.parse_decimal(str(x))) if f.kind == V.DECIMAL else x))
        yield identity.number(self.relations.count())
        for row in self.relations.orderBy(*RELATION_COLUMNS).toLocalIterator():
            yield b"".join([identity.text(row[0]), identity.text(row[1]), identity.raw_digest(row[2]), identity.text(row[3]), identity.raw_digest(row[4])])

    def content_digest(self) -> str:
        """A digest for states of any size: the sum of 64-bit digests of all rows in four lanes, made on the executors.

        It does not depend on the order of rows or on partitions, and is no substitute for
        ``digest``, which other systems can reproduce.
        """
        parts = []
        for k, df in sorted(self.entities.items()):
            parts.append(df.select(F.sha2(row_bytes(self.schema.entity(k)), 256).alias("h")))
        parts.append(self.relations.select(F.sha2(F.concat(F.lit("r"), *[identity.text_column(F.col(c)) for c in RELATION_COLUMNS]), 256).alias("h")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        lanes = [F.sum(F.conv(F.substring("h", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
        row = every.agg(F.count("*"), *lanes).first()
        return identity.digest(",".join(map(str, [schema_digest(self.schema), self.lineage, *row])).encode())


def row_bytes(kind: EntityKind) -> Column:
    """The canonical bytes of an entity; an absent field is one zero byte."""
    parts = [identity.constant(identity.text(kind.name)), identity.text_column(F.col("id"))]
    for f in sorted(kind.fields, key=lambda f: f.name):
        t = Typed(F.col(f"`{f.name}`"), f.kind, f.digits if f.kind == V.DECIMAL else None)
        parts.append(F.coalesce(F.concat(identity.constant(b"\x01" + identity.text(f.name)), identity.value_column(t)), identity.constant(b"\x00")))
    return F.concat(*parts)


def schema_digest(schema: Schema) -> str:
    body = identity.text(identity.tag("schema")) + identity.number(len(schema.entities))
    for e in sorted(schema.entities, key=lambda e: e.name):
        body += identity.text(e.name) + identity.number(len(e.fields))
        for f in sorted(e.fields, key=lambda f: f.name):
            body += identity.text(f.name) + bytes([V.KIND_BYTES[f.kind], int(f.required)])
    body += identity.number(len(schema.relations))
    for r in sorted(schema.relations, key=lambda r: r.name):
        body += identity.text(r.name) + identity.text(r.from_kind) + identity.text(r.to_kind)
    return identity.digest(body)


def checkpoint_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")


def stored_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_state(spark: SparkSession, schema: Schema, lineage: str) -> GraphState:
    none = lambda struct: spark.createDataFrame([], struct).where(F.lit(False))  # noqa: E731  (planned as empty, so joins with it vanish)
    return GraphState(schema, lineage, {e.name: none(e.struct()) for e in schema.entities}, none(RELATION_TYPE))


def ingest(spark: SparkSession, schema: Schema, lineage: str, sources: dict[str, tuple[DataFrame, Column, dict[str, Column]]], relations: DataFrame | None = None) -> GraphState:
    """A state from tables. sources: kind -> (rows, source key, column of each field); ids are derived from the keys, and kinds without a source are empty."""
    state = empty_state(spark, schema, lineage)
    for kind, (rows, key, columns) in sources.items():
        declared = schema.entity(kind)
        if declared is None:
            raise SchemaError(f"unknown kind {kind}")
        made = [columns.get(f.name, F.lit(None)).cast(f.spark_type()).alias(f.name) for f in declared.fields]
        state = state.with_kind(kind, rows.select(identity.source_id_column(lineage, kind, key.cast("string")).alias("id"), *made))
    return state if relations is None else state.with_relations(relations.select(*RELATION_COLUMNS))


def state_faults(state: GraphState) -> list[str]:
    """One row of counts per table; nothing else reaches the driver."""
    out = []
    for k, df in sorted(state.entities.items()):
        kind = state.schema.entity(k)
        required = [f.name for f in kind.fields if f.required]
        row = df.groupBy("id").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{f}`").isNull()).alias(f"r{i}") for i, f in enumerate(required)])
        row = row.agg(F.count_if(F.expr("n > 1")), F.count_if(F.expr("id is null")), *[F.sum(f"r{i}") for i in range(len(required))]).first()
        out += [f"{k}: duplicate ids" for _ in range(bool(row[0]))] + [f"{k}: null ids" for _ in range(bool(row[1]))]
        out += [f"{k}.{f}: required, but absent" for f, n in zip(required, row[2:], strict=True) if n]
    rel = state.relations
    if state.schema.relations:
        known = [(r.name, r.from_kind, r.to_kind) for r in state.schema.relations]
        is_known = F.lit(False)
        for r in known:
            is_known = is_known | ((F.col("kind") == r[0]) & (F.col("from_kind") == r[1]) & (F.col("to_kind") == r[2]))
        if not rel.where(~is_known).isEmpty():
            out.append("relations: undeclared kind or ends")
        if not rel.groupBy(*RELATION_COLUMNS).count().where("count > 1").isEmpty():
            out.append("relations: duplicates")
        if not dangling(state).isEmpty():
            out.append("relations: an end does not exist")
    elif not rel.isEmpty():
        out.append("relations: none is declared")
    return out


def dangling(state: GraphState, rel: DataFrame | None = None) -> DataFrame:
    """Relations of which an end does not exist."""
    rel = state.relations if rel is None else rel
    ids = None
    for k, df in state.entities.items():
        part = df.select(F.lit(k).alias("k"), "id")
        ids = part if ids is None else ids.unionByName(part)
    ends = rel.select(*RELATION_COLUMNS, F.explode(F.array(F.struct(F.col("from_kind").alias("k"), F.col("from_id").alias("id")), F.struct(F.col("to_kind").alias("k"), F.col("to_id").alias("id")))).alias("end"))
    return ends.select(*RELATION_COLUMNS, "end.k", "end.id").join(ids, ["k", "id"], "left_anti").select(*RELATION_COLUMNS)
