"""Corpora: one plan over many cases, comparison of two plans, and the promotion gate.

A corpus is a state per case. Runs of a case are independent; their results are rows of
small tables (case, status, verdicts), which joins and aggregates compare.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..state import GraphState
from .compiler import Plan
from .runner import Run, replay, run_plan

#: States of an execution, reasons for missing evidence, and the clauses of the gate.
LIFECYCLE = ("pending", "running", "succeeded", "failed", "unattempted")
MISSING = ("not_executed", "not_answered", "unattempted", "checkpoint_not_sealed", "not_assessed")
CLAUSES = ("static_validation", "sealed_with_provenance", "protected_invariants", "ready_assessment", "pinned_identities", "comparison_corpus", "no_metric_regression", "digest_consistency", "certified_backend")
BACKENDS = frozenset({"spark", "sql"})
RESULT = "case_id string, status string, checkpoint string, profile string, verdict string"


def run_corpus(plan: Plan, cases: dict[str, GraphState], persist: bool = True) -> dict[str, Run]:
    """Runs a plan on every case; a case whose state is no state is left as it is by raising."""
    return {case: run_plan(plan, state, persist=persist) for case, state in sorted(cases.items())}


def results_frame(spark: SparkSession, runs: dict[str, Run | None]) -> DataFrame:
    """(case_id, status, checkpoint, profile, verdict), a row for each sealed assessment, or one without them."""
    rows = []
    for case, run in runs.items():
        if run is None:
            rows.append((case, "unattempted", None, None, None))
            continue
        status = "succeeded" if run.status == "succeeded" else "failed"
        found = [(case, status, c.key, p, v) for c in run.checkpoints for p, v in c.assessments.items()]
        rows += found or [(case, status, run.checkpoints[-1].key if run.checkpoints else None, None, None)]
    return spark.createDataFrame(rows, RESULT)


def progress(results: DataFrame) -> DataFrame:
    """(status, n_cases) for every state of the lifecycle."""
    spark = results.sparkSession
    states = spark.range(1).select(F.explode(F.array(*map(F.lit, LIFECYCLE))).alias("status"))
    return states.join(results.select("case_id", "status").distinct().groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n_cases"))


@dataclass(frozen=True)
class Policy:
    """Which checkpoint of the baseline answers to which of the candidate, and the profile that is compared."""

    correspondences: tuple[tuple[str, str], ...]
    profile: str

    def __post_init__(self) -> None:
        a, b = zip(*self.correspondences, strict=True) if self.correspondences else ((), ())
        if not a or len(set(a)) < len(a) or len(set(b)) < len(b):
            raise ValueError("checkpoints must correspond one to one")


def compare(baseline: DataFrame, candidate: DataFrame, policy: Policy) -> DataFrame:
    """A row per case and correspondence: both verdicts, or the reason why evidence is missing."""
    spark = baseline.sparkSession
    pairs = spark.createDataFrame(list(policy.correspondences), "base_checkpoint string, cand_checkpoint string")
    cases = baseline.select("case_id").unionByName(candidate.select("case_id")).distinct()
    grid = cases.join(F.broadcast(pairs))  # a policy's few correspondences for each case
    for side, results in (("base", baseline), ("cand", candidate)):
        status = results.select("case_id", F.col("status").alias(f"{side}_status")).distinct()
        sealed = results.where("checkpoint is not null").select("case_id", F.col("checkpoint").alias(f"{side}_checkpoint"), F.lit(True).alias(f"{side}_sealed")).distinct()
        answers = results.where(F.col("profile") == policy.profile).select("case_id", F.col("checkpoint").alias(f"{side}_checkpoint"), F.col("verdict").alias(f"{side}_verdict"))
        grid = grid.join(status, "case_id", "left").join(sealed, ["case_id", f"{side}_checkpoint"], "left").join(answers, ["case_id", f"{side}_checkpoint"], "left")
        s = F.col(f"{side}_status")
        why = F.when(s.isNull(), "not_executed").when(s.isin("pending", "running"), "not_answered").when(s == "unattempted", "unattempted").when(F.col(f"{side}_sealed").isNull(), "checkpoint_not_sealed").when(F.col(f"{side}_verdict").isNull(), "not_assessed")
        grid = grid.withColumn(f"{side}_missing", why)
    return grid.select("case_id", "base_checkpoint", "cand_checkpoint", "base_verdict", "cand_verdict", "base_missing", "cand_missing")


def regression(compared: DataFrame) -> DataFrame:
    """One row: the cases, those that fell from ready to needs_input, ready totals of both sides, and whether nothing regressed."""
    ready = lambda c: F.count_if(F.col(c) == "ready")
    fell = F.count_if((F.col("base_verdict") == "ready") & (F.col("cand_verdict") == "needs_input"))
    incomplete = F.count_if(F.col("base_missing").isNotNull() | F.col("cand_missing").isNotNull())
    out = compared.agg(F.countDistinct("case_id").alias("n_cases"), incomplete.alias("n_incomplete"), fell.alias("n_fell"), ready("base_verdict").alias("base_ready"), ready("cand_verdict").alias("cand_ready"))
    return out.withColumn("no_regression", (F.col("n_incomplete") == 0) & (F.col("n_fell") == 0) & (F.col("cand_ready") >= F.col("base_ready")))


@dataclass
class Evidence:
    """What the gate judges; None where there is no evidence for a clause."""

    compiled: bool | None = None
    sealed: bool | None = None
    invariants_hold: bool | None = None
    ready: bool | None = None
    identities_pinned: bool | None = None
    corpus_complete: bool | None = None
    no_regression: bool | None = None
    digests_agree: bool | None = None
    backend: str | None = None
    notes: dict[str, str] = field(default_factory=dict)


def gate(evidence: Evidence) -> tuple[bool, dict[str, str]]:
    """(authorised, result of each clause: pass, fail or not_evaluated); authorised only if every clause passes."""
    e = evidence
    known = (e.compiled, e.sealed, e.invariants_hold, e.ready, e.identities_pinned, e.corpus_complete, e.no_regression, e.digests_agree, None if e.backend is None else e.backend in BACKENDS)
    out = {name: "not_evaluated" if x is None else "pass" if x else "fail" for name, x in zip(CLAUSES, known, strict=True)}
    return all(v == "pass" for v in out.values()), out


def reproduced(run: Run) -> bool | None:
    """Does the journal, replayed from the initial state, give the state of each checkpoint? None where it can't be replayed."""
    if run.initial is None or not run.checkpoints:
        return None
    order = {c.rule.id: i for i, c in enumerate(run.plan.rules)}
    state, done = run.initial, 0
    for sealed in run.checkpoints:
        upto = order.get(sealed.after, -1) + 1
        if not done <= upto <= len(run.changes) or not upto:
            return None
        state, code = replay(state, run.changes[done:upto])
        if code or state.content_digest() != sealed.state.content_digest():
            return False
        done = upto
    return True


def gathered(plan: Plan | None, runs: dict[str, Run], compared: DataFrame | None, backend: str = "spark") -> Evidence:
    """Evidence from runs of a candidate plan and its comparison with a baseline."""
    row = regression(compared).first() if compared is not None else None
    again = [reproduced(r) for r in runs.values()]
    return Evidence(
        compiled=plan is not None,
        sealed=all(r.checkpoints for r in runs.values()) if runs else None,
        invariants_hold=all(r.status == "succeeded" and not any(c.state.faults() for c in r.checkpoints) for r in runs.values()) if runs else None,
        ready=all(v == "ready" for r in runs.values() if r.checkpoints for v in r.checkpoints[-1].assessments.values()) if runs else None,
        identities_pinned=all(r.plan.id == plan.id for r in runs.values()) if runs and plan else None,
        corpus_complete=None if row is None else row["n_incomplete"] == 0 and row["n_cases"] > 0,
        no_regression=None if row is None else row["no_regression"],
        digests_agree=False if False in again else None if None in again or not again else True,
        backend=backend,
    )
