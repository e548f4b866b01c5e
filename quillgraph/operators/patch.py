"""Change sets: what a rule did, as rows that can be applied to a state and undone.

A change is (rank, op, kind, id, before, after): ``before`` and ``after`` are JSON objects of the
fields concerned (absent fields are left out), for relations of the relation. Ranks order the operations: insert 1,
relate 2, update 3, unrelate 4, delete 5. Applying checks every before-image and is all or nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as R
from ..schema import RELATION_COLUMNS, RELATION_TYPE, EntityKind
from ..state import GraphState, dangling

CHANGE_COLUMNS = ("rank", "op", "kind", "id", "before", "after")
RANKS = {"insert": 1, "relate": 2, "update": 3, "unrelate": 4, "delete": 5}
INVERSE = {"insert": "delete", "delete": "insert", "relate": "unrelate", "unrelate": "relate", "update": "update"}


def packed(columns: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()])) if columns else F.lit(None).cast("string")


def changes_of(op: str, kind: str, rows: DataFrame, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    return rows.select(F.lit(RANKS[op]).alias("rank"), F.lit(op).alias("op"), F.lit(kind).alias("kind"), F.col("id"), packed(before).alias("before"), packed(after).alias("after"))


def relation_changes(op: str, edges: DataFrame) -> DataFrame:
    image = packed({c: F.col(c) for c in RELATION_COLUMNS})
    none = F.lit(None).cast("string")
    before, after = (none, image) if op == "relate" else (image, none)
    return edges.select(F.lit(RANKS[op]).alias("rank"), F.lit(op).alias("op"), F.col("kind"), F.concat_ws(">", "from_id", "to_id").alias("id"), before.alias("before"), after.alias("after"))


def inverse(changes: DataFrame) -> DataFrame:
    """The change set that takes a state back."""
    op = F.col("op")
    back = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])[op]
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[back]
    return changes.select(rank.alias("rank"), back.alias("op"), "kind", "id", F.col("after").alias("before"), F.col("before").alias("after"))


def image_type(kind: EntityKind) -> T.StructType:
    return T.StructType([f for f in kind.struct() if f.name != "id"])


@dataclass(frozen=True)
class Applied:
    state: GraphState
    code: str | None = None


def apply_changes(state: GraphState, changes: DataFrame) -> Applied:
    """Applies a change set, or rejects it with an operation code and gives the state back."""
    present = {(r["kind"], r["op"]) for r in changes.select("kind", "op").distinct().collect()}  # at most kinds x operations
    checks, after, with_new = [], state, state
    for e in state.schema.entities:
        own, there = changes.where((F.col("kind") == e.name) & F.col("op").isin("insert", "update", "delete")), state.entities[e.name]
        image = image_type(e)
        parsed = own.withColumn("b", F.from_json(F.coalesce("before", F.lit("{}")), image)).withColumn("a", F.from_json(F.coalesce("after", F.lit("{}")), image))
        current = there.select("id", F.struct(*[F.col(f"`{f.name}`") for f in image]).alias("now"))
        kept = there
        if (e.name, "delete") in present:
            gone = parsed.where(F.col("op") == "delete")
            whole = F.lit(False)
            for f in image:
                whole = whole | ~F.col(f"now.`{f.name}`").eqNullSafe(F.col(f"b.`{f.name}`"))
            checks += [tally(gone.join(there.select("id"), "id", "left_anti"), R.NO_DELETE), tally(gone.join(current, "id").where(whole), R.BEFORE_MISMATCH)]
            kept = kept.join(gone.select("id"), "id", "left_anti")
        if (e.name, "update") in present:
            keys_of = lambda c: F.coalesce(F.map_keys(F.from_json(c, "map<string,string>")), F.array().cast("array<string>"))
            upd = parsed.where(F.col("op") == "update").withColumn("keys", F.array_union(keys_of(F.col("before")), keys_of(F.col("after"))))
            differs = F.lit(False)
            for f in image:
                differs = differs | (F.array_contains("keys", f.name) & ~F.col(f"now.`{f.name}`").eqNullSafe(F.col(f"b.`{f.name}`")))
            checks += [tally(upd.join(there.select("id"), "id", "left_anti"), R.NO_UPDATE), tally(upd.join(current, "id").where(differs), R.BEFORE_MISMATCH)]
            kept = kept.join(upd.select("id", "keys", "a"), "id", "left")
            kept = kept.select("id", *[F.when(F.array_contains("keys", f.name), F.col(f"a.`{f.name}`")).otherwise(F.col(f"`{f.name}`")).alias(f.name) for f in image])
        if (e.name, "insert") in present:
            new = parsed.where(F.col("op") == "insert")
            checks += [tally(new.groupBy("id").count().where("count > 1"), R.COLLISION), tally(new.join(there.select("id"), "id", "left_semi"), R.COLLISION)]
            kept = kept.unionByName(new.select("id", *[F.col(f"a.`{f.name}`").alias(f.name) for f in image]))
            with_new = with_new.with_kind(e.name, there.select("id").unionByName(new.select("id")))
        after = after.with_kind(e.name, kept)
    ops = {op for _, op in present}
    edges = {op: changes.where(F.col("op") == op).select(F.from_json("after" if op == "relate" else "before", RELATION_TYPE).alias("r")).select("r.*") for op in ("relate", "unrelate")}
    own = list(RELATION_COLUMNS)
    if "relate" in ops:
        checks += [tally(edges["relate"].join(state.relations, own, "left_semi"), R.ALREADY_RELATED), tally(edges["relate"].groupBy(*own).count().where("count > 1"), R.ALREADY_RELATED), tally(dangling(with_new, edges["relate"]), R.ENDPOINT_MISSING)]
        after = after.with_relations(after.relations.unionByName(edges["relate"]))
    if "unrelate" in ops:
        checks.append(tally(edges["unrelate"].join(after.relations, own, "left_anti"), R.NOT_RELATED))
        after = after.with_relations(after.relations.join(edges["unrelate"], own, "left_anti").select(*own))
    if "delete" in ops:
        checks.append(tally(dangling(after), R.DANGLING))
    if not checks:
        return Applied(after)
    every = checks[0]
    for c in checks[1:]:
        every = every.unionByName(c)
    bad = {r["code"] for r in every.groupBy("code").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    for code in (R.COLLISION, R.ALREADY_RELATED, R.ENDPOINT_MISSING, R.NO_UPDATE, R.NOT_RELATED, R.NO_DELETE, R.BEFORE_MISMATCH, R.DANGLING):
        if code in bad:
            return Applied(state, code)
    return Applied(after)


def tally(rows: DataFrame, code: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n")


def undo_changes(state: GraphState, changes: DataFrame) -> Applied:
    return apply_changes(state, inverse(changes))
