"""The retail tables as a graph state: kinds, relations, and conversion at the boundary.

DOUBLE columns become int64 cents, or decimals of declared digits; timestamps become nanoseconds. Entity ids come
from each table's key; the key of a line item is six columns, as shorter ones repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reach_workers
from . import values as V
from .functions import identity
from .schema import EntityKind, Field, RelationKind, Schema
from .state import GraphState, ingest

S, I = V.STRING, V.INT64
LINEAGE = identity.lineage_id("retail", "tables")
SCHEMA = Schema(
    (
        EntityKind("region", (Field("regionkey", I, True), Field("name", S, True))),
        EntityKind("nation", (Field("nationkey", I, True), Field("name", S, True), Field("regionkey", I))),
        EntityKind("customer", (Field("custkey", I, True), Field("name", S), Field("nationkey", I), Field("segment", S), Field("acctbal_cents", I), Field("tier", S), Field("nation_total", I), Field("nation_count", I))),
        EntityKind("supplier", (Field("suppkey", I, True), Field("name", S), Field("nationkey", I), Field("acctbal_cents", I))),
        EntityKind("order", (Field("orderkey", I, True), Field("custkey", I), Field("status", S), Field("priority", S), Field("total_cents", I), Field("placed", V.TIMESTAMP), Field("rank", S))),
        EntityKind("lineitem", (Field("orderkey", I, True), Field("linenumber", I), Field("quantity", I), Field("price_cents", I), Field("discount", V.DECIMAL, digits=(4, 2)), Field("price", V.DECIMAL, digits=(12, 2)), Field("flag", S), Field("shipped", V.DATE))),
        EntityKind("event", (Field("event_id", I, True), Field("user_id", I), Field("type", V.ATOM), Field("at", V.TIMESTAMP), Field("millis", I))),
        EntityKind("account", (Field("custkey", I, True), Field("orders", I), Field("total_cents", I), Field("largest_cents", I))),
        EntityKind("leg", (Field("part", S, True), Field("cents", I), Field("custkey", I))),
    ),
    (RelationKind("serves", "supplier", "customer"), RelationKind("holds", "customer", "order"), RelationKind("peer", "nation", "nation"), RelationKind("richer", "supplier", "supplier"), RelationKind("owns", "account", "order")),
)


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def nanos(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp")) * 1000


def read(spark: SparkSession, sf_dir: str, *kinds: str) -> GraphState:
    """A state with the named kinds; the others are empty."""
    reach_workers(spark)
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    long = lambda c: F.col(c).cast("bigint")

    def source(kind: str) -> tuple[DataFrame, Column, dict[str, Column]]:
        match kind:
            case "region":
                return table("region"), F.col("r_regionkey"), {"regionkey": long("r_regionkey"), "name": F.col("r_name")}
            case "nation":
                return table("nation"), F.col("n_nationkey"), {"nationkey": long("n_nationkey"), "name": F.col("n_name"), "regionkey": long("n_regionkey")}
            case "customer":
                return table("customer"), F.col("c_custkey"), {"custkey": F.col("c_custkey"), "name": F.col("c_name"), "nationkey": long("c_nationkey"), "segment": F.col("c_mktsegment"), "acctbal_cents": cents("c_acctbal")}
            case "supplier":
                return table("supplier"), F.col("s_suppkey"), {"suppkey": F.col("s_suppkey"), "name": F.col("s_name"), "nationkey": long("s_nationkey"), "acctbal_cents": cents("s_acctbal")}
            case "order":
                return table("orders"), F.col("o_orderkey"), {"orderkey": F.col("o_orderkey"), "custkey": F.col("o_custkey"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "total_cents": cents("o_totalprice"), "placed": nanos("o_orderdate")}
            case "lineitem":
                key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice"), F.unix_micros(F.col("l_shipdate").cast("timestamp")))
                return table("lineitem"), key, {
                    "orderkey": F.col("l_orderkey"), "linenumber": long("l_linenumber"), "quantity": F.round("l_quantity").cast("bigint"), "price_cents": cents("l_extendedprice"),
                    "discount": (cents("l_discount") / F.lit(100).cast("decimal(3,0)")).cast("decimal(4,2)"), "price": (cents("l_extendedprice") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)"), "flag": F.col("l_returnflag"), "shipped": F.col("l_shipdate").cast("date"),
                }
            case "event":
                return table("events"), F.col("event_id"), {"event_id": F.col("event_id"), "user_id": F.col("user_id"), "type": F.col("event_type"), "at": nanos("ts"), "millis": F.round(F.col("value") * 1000).cast("bigint")}
        raise ValueError(f"no table for {kind}")

    return ingest(spark, SCHEMA, LINEAGE, {k: source(k) for k in kinds})


def sql_text(s: str) -> str:
    """Canonical bytes of a text, in DuckDB SQL."""
    return f"unhex(lpad(to_hex(octet_length(encode({s}))), 16, '0')) || encode({s})"


def sql_source_id(kind: str, key: str) -> str:
    """A source id in DuckDB SQL."""
    head = identity.text(identity.tag("source-entity")) + identity.raw_digest(LINEAGE) + identity.text(kind)
    return f"('sha256:' || sha256(unhex('{head.hex()}') || {sql_text(f'({key})::VARCHAR')}))"


def sql_synthetic_id(kind: str, rule: str, ids: str, discriminator: str, kind_byte: int = 1) -> str:
    """A synthetic id in DuckDB SQL. ids: a list of ids; discriminator: a text or, for kind byte 3, an int64."""
    head = identity.text(identity.tag("synthetic-entity")) + identity.raw_digest(LINEAGE) + identity.text(kind) + identity.text(rule)
    body = f"unhex(lpad(to_hex(({discriminator})::BIGINT), 16, '0'))" if kind_byte == 3 else sql_text(f"({discriminator})::VARCHAR")
    joined = f"unhex(array_to_string(list_sort(list_transform({ids}, lambda i: substr(i, 8))), ''))"
    return f"('sha256:' || sha256(unhex('{head.hex()}') || unhex(lpad(to_hex(len({ids})), 16, '0')) || {joined} || unhex('{kind_byte:02x}') || {body}))"
