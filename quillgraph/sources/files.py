"""States from JSON files, rule texts and staging tables, and back.

A JSON state has a schema, a lineage id, entities and relations. Texts stay texts, integers become
int64, booleans the atoms "true" and "false"; the other kinds come as canonical text where the schema declares
them. Staging tables are one table per entity kind, ``raw_entities_<kind>``, and ``raw_relations``.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..dsl import Source, parse
from ..functions.identity import timestamp_text
from ..schema import RELATION_COLUMNS, EntityKind, Field, RelationKind, Schema, SchemaError
from ..state import GraphState, empty_state


def read_rules(path: str) -> Source:
    """A rule file; its schema also makes an empty state (``empty_state``)."""
    return parse(Path(path).read_text(encoding="utf-8"))


def schema_from_json(data: dict) -> Schema:
    entities = tuple(EntityKind(e["kind"], tuple(Field(f["name"], f["type"], bool(f.get("required", False))) for f in e.get("fields", []))) for e in data.get("entities", []))
    return Schema(entities, tuple(RelationKind(r["kind"], r["from"], r["to"]) for r in data.get("relations", [])))


def from_text_column(text: Column, f: Field) -> Column:
    """A field's column from canonical text; a text that is no value of the kind becomes NULL."""
    if f.kind in (V.INT64, V.DURATION):
        return text.try_cast("bigint")
    if f.kind == V.DATE:
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    if f.kind == V.TIMESTAMP:
        return timestamp_column(text)
    if f.kind == V.DECIMAL and f.digits:
        return text.try_cast(f"decimal({f.digits[0]},{f.digits[1]})")
    return text


def timestamp_column(text: Column) -> Column:
    """Nanoseconds from canonical timestamp text, beyond the microseconds that Spark's own type has."""
    form = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?(?:Z|[+-]00:00)$"
    part = lambda i: F.regexp_extract(text, form, i)
    day = F.datediff(part(1).try_cast("date"), F.lit("1970-01-01").cast("date")).cast("decimal(38,0)")
    hour, minute, second = (part(i).try_cast("int") for i in (2, 3, 4))
    ok = text.rlike(form) & (hour < 24) & (minute < 60) & (second < 60)
    seconds = day * 86400 + (hour * 3600 + minute * 60 + second)
    ns = seconds.cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.rpad(part(5), 9, "0").try_cast("bigint")
    return F.when(ok, ns.cast("decimal(38,0)").try_cast("bigint"))


def read_json_state(spark: SparkSession, path: str) -> GraphState:
    """A state file of any size: the header is read once, entities and relations as distributed rows."""
    whole = spark.read.schema("schema string, lineage_id string, entities array<struct<kind:string,id:string,fields:map<string,string>>>, relations array<struct<kind:string,from:struct<kind:string,id:string>,to:struct<kind:string,id:string>>>").json(path, multiLine=True)
    head = whole.select("schema", "lineage_id").first()
    if head is None or not head["schema"]:
        raise SchemaError("the file has no schema")
    schema = schema_from_json(json.loads(head["schema"]))
    state = empty_state(spark, schema, head["lineage_id"])
    rows = whole.select(F.inline("entities"))
    for e in schema.entities:
        own = rows.where(F.col("kind") == e.name)
        state = state.with_kind(e.name, own.select("id", *[from_text_column(F.col("fields")[f.name], f).alias(f.name) for f in e.fields]))
    rel = whole.select(F.inline("relations")).select("kind", F.col("from.kind").alias("from_kind"), F.col("from.id").alias("from_id"), F.col("to.kind").alias("to_kind"), F.col("to.id").alias("to_id"))
    return state.with_relations(rel)


def to_text_column(col: Column, f: Field) -> Column:
    if f.kind == V.TIMESTAMP:
        return timestamp_text(col)
    return F.date_format(col, "yyyy-MM-dd") if f.kind == V.DATE else col.cast("string")


def write_json_state(state: GraphState, path: str) -> None:
    """One JSON file; for states that fit the driver."""
    schema = {
        "entities": [{"kind": e.name, "fields": [{"name": f.name, "type": f.kind, "required": f.required} for f in e.fields]} for e in state.schema.entities],
        "relations": [{"kind": r.name, "from": r.from_kind, "to": r.to_kind} for r in state.schema.relations],
    }
    entities = []
    for e in state.schema.entities:
        rows = state.entities[e.name].select("id", *[to_text_column(F.col(f"`{f.name}`"), f).alias(f.name) for f in e.fields]).orderBy("id")
        entities += [{"kind": e.name, "id": r["id"], "fields": {f.name: r[f.name] for f in e.fields if r[f.name] is not None}} for r in rows.toLocalIterator()]
    relations = [{"kind": r[0], "from": {"kind": r[1], "id": r[2]}, "to": {"kind": r[3], "id": r[4]}} for r in state.relations.select(*RELATION_COLUMNS).orderBy(*RELATION_COLUMNS).toLocalIterator()]
    Path(path).write_text(json.dumps({"schema": schema, "lineage_id": state.lineage, "entities": entities, "relations": relations}, ensure_ascii=False), encoding="utf-8")


def read_staged(spark: SparkSession, schema: Schema, lineage: str, folder: str) -> GraphState:
    """Staging tables under a folder, as Parquet. Rows that are not active (is_active false or null, where the table has it) are left out."""
    state = empty_state(spark, schema, lineage)

    def live(table: str) -> DataFrame:
        raw = spark.read.parquet(f"{folder}/{table}")
        return raw.where("is_active") if "is_active" in raw.columns else raw

    for e in schema.entities:
        raw = live(f"raw_entities_{e.name}")
        state = state.with_kind(e.name, raw.select("id", *[F.col(f"`{f.name}`").cast(f.spark_type()) for f in e.fields]))
    return state.with_relations(live("raw_relations").select(*RELATION_COLUMNS))


def write_state(state: GraphState, folder: str) -> None:
    """The staging tables of a state, with the system columns lineage_id and is_active."""
    system = [F.lit(state.lineage).alias("lineage_id"), F.lit(True).alias("is_active")]
    for k, df in state.entities.items():
        df.select("*", *system).write.mode("overwrite").parquet(f"{folder}/raw_entities_{k}")
    state.relations.select("*", *system).write.mode("overwrite").parquet(f"{folder}/raw_relations")
