"""Selection: filter, group by one key, and counts of what would reject a rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..expr import Expr
from ..functions.columns import Compiler, Reductions, kind_fields
from ..rules import Cardinality, Selector
from ..state import GraphState


def violates(members: Cardinality, n: Column) -> Column:
    if members.mode == "any":
        return F.lit(False)
    return n != members.n if members.mode == "exactly" else n < members.n


@dataclass
class Selection:
    """``rows``: all of the kind with ``__where``; ``chosen``: those selected, with ``__key``; ``groups``: a row per key."""

    selector: Selector
    member: Compiler
    rows: DataFrame
    chosen: DataFrame
    groups: DataFrame
    reductions: Reductions

    def group_compiler(self) -> Compiler:
        """For group scope, and for member-in-group scope once ``groups`` is joined."""
        return Compiler(self.member.fields, self.reductions.typed())


def select(state: GraphState, selector: Selector, group_exprs: list[Expr], exact: bool = False, extra: list[Column] = ()) -> Selection:
    """extra: more aggregates of a group. Groups are aggregated with partial sums; no window and no collected group unless ``exact`` or ``extra`` asks for one."""
    kind = state.schema.entity(selector.kind)
    member = Compiler(kind_fields({f.name: f for f in kind.fields}))
    where = member.bool(selector.where) if selector.where else F.lit(True)
    rows = state.entities[selector.kind].withColumn("__where", where)
    key = member.typed(selector.group_by) if selector.group_by else None
    key_column = F.col("id") if key is None else key.text() if key.kind == V.DECIMAL else key.col
    chosen = rows.where("__where").drop("__where").withColumn("__key", key_column)
    reductions = Reductions(group_exprs, member, exact)
    if selector.group_by is None:  # every entity is a group: its reductions are values of its own row
        single = [reductions.of_one(e).alias(n) for e, n in reductions.names.items()]
        groups = chosen.select("*", F.lit(1).cast("bigint").alias("__n"), *single, F.lit(False).alias("__unsure"), F.array("id").alias("__ids"))
        return Selection(selector, member, rows, chosen, groups, reductions)
    groups = reductions.prepared(chosen, "__key").groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), *reductions.aggregates(), *extra)
    return Selection(selector, member, rows, chosen, groups, reductions)


def selection_counts(s: Selection) -> DataFrame:
    """(name, n): faults of the selector over all rows of the kind, then of keys, cardinality and the number of groups."""
    where = s.rows.agg(F.count_if(F.col("__where").isNull()).alias("n")).select(F.lit("where_fault").alias("name"), "n")
    groups = s.groups.agg(
        F.count_if(F.col("__key").isNull()).alias("key_fault"), F.count_if(violates(s.selector.members, F.col("__n"))).alias("cardinality"),
        F.count(F.lit(1)).alias("groups"), F.count_if("__unsure").alias("unsure"),
    )
    return where.unionByName(groups.unpivot([], ["key_fault", "cardinality", "groups", "unsure"], "name", "n"))
