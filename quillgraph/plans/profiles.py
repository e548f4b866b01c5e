"""Completeness: are the fields that a profile requires present in all entities of its kind?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..state import GraphState


def assess(state: GraphState, profile: R.Profile) -> DataFrame:
    """(id, code, satisfied): every entity by every requirement."""
    rows = state.entities[profile.kind]
    pairs = [F.struct(F.lit(r.code).alias("code"), F.col(f"`{r.path.partition('.')[2]}`").isNotNull().alias("satisfied")) for r in sorted(profile.requirements)]
    if not pairs:
        return rows.limit(0).select("id", F.lit("").alias("code"), F.lit(True).alias("satisfied"))
    return rows.select("id", F.inline(F.array(*pairs)))


def verdicts(state: GraphState, profile: R.Profile) -> DataFrame:
    """One row: profile, kind, n_entities, n_missing and the verdict; no entities are ready."""
    missing = F.lit(0)
    for r in profile.requirements:
        missing = missing + F.col(f"`{r.path.partition('.')[2]}`").isNull().cast("int")
    out = state.entities[profile.kind].agg(F.count(F.lit(1)).alias("n_entities"), F.coalesce(F.sum(missing), F.lit(0)).cast("bigint").alias("n_missing"))
    return out.select(F.lit(profile.key).alias("profile"), F.lit(profile.kind).alias("kind"), "n_entities", "n_missing", F.when(F.col("n_missing") == 0, "ready").otherwise("needs_input").alias("verdict"))
