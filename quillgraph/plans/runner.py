"""Runs a plan: rule by rule, with a journal, sealed checkpoints and assessments.

A rejection ends the run; states, journal and checkpoints up to there remain. At each declared
checkpoint the state is written to the shared folder, which cuts the lineage, so that neither plans nor recovery
grow with the number of rules.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .. import rules as R
from ..functions import identity
from ..operators.execute import Outcome, execute
from ..operators.patch import apply_changes
from ..state import GraphState, checkpoint_folder, stored_table
from . import profiles
from .compiler import Plan


@dataclass(frozen=True)
class Entry:
    """One journal entry: a rule and its outcome."""

    sequence: int
    rule: str
    accepted: bool
    code: str | None
    obligation: str | None
    counts: dict[str, int]


@dataclass(frozen=True)
class Sealed:
    key: str
    after: str
    state: GraphState
    assessments: dict[str, str]


@dataclass
class Run:
    """What a run leaves: its status is "succeeded" or "rejected"."""

    plan: Plan
    state: GraphState
    journal: list[Entry] = field(default_factory=list)
    changes: list[DataFrame] = field(default_factory=list)
    checkpoints: list[Sealed] = field(default_factory=list)
    failure: Entry | None = None
    initial: GraphState | None = None

    @property
    def status(self) -> str:
        return "rejected" if self.failure else "succeeded"

    def journal_frame(self) -> DataFrame:
        rows = [(e.sequence, e.rule, e.accepted, e.code, e.obligation) for e in self.journal]
        return self.state.spark.createDataFrame(rows, "sequence int, rule string, accepted boolean, code string, obligation string")


def run_plan(plan: Plan, state: GraphState, domain: str = identity.NAMESPACE, persist: bool = True) -> Run:
    """persist: write the state at checkpoints, and what insertions make. Without it both stay lazy."""
    out, kept = Run(plan, state, initial=state), state
    for i, compiled in enumerate(plan.rules):
        due = [c for c in plan.checkpoints if c.after == compiled.rule.id]
        path = f"{checkpoint_folder(state.spark)}/rule-{i}-{uuid.uuid4().hex}"
        store = (lambda df, path=path: stored_table(df, path)) if persist and (due or isinstance(compiled.rule.operation, R.InsertEntity)) else None
        outcome: Outcome = execute(out.state, compiled.rule, domain, store)
        entry = Entry(i, compiled.rule.id, outcome.accepted, outcome.code, outcome.obligation, outcome.counts or {})
        out.journal.append(entry)
        if not outcome.accepted:
            out.failure = entry
            break
        out.state = outcome.state
        out.changes.append(outcome.changes)
        if due and persist:
            if outcome.stored:
                kept = kept.with_kind(outcome.stored, out.state.entities[outcome.stored])
            kept = out.state = out.state.persisted(f"checkpoint-{i}", since=kept)
        for c in due:
            out.checkpoints.append(Sealed(c.key, c.after, out.state, assessed(out.state, plan.profiles)))
    return out


def assessed(state: GraphState, found: tuple[R.Profile, ...]) -> dict[str, str]:
    """The verdict of each profile, in one query."""
    rows = [profiles.verdicts(state, p) for p in found]
    every = rows[0] if rows else None
    for r in rows[1:]:
        every = every.unionByName(r)
    return {r["profile"]: r["verdict"] for r in every.collect()} if every is not None else {}


def replay(state: GraphState, changes: list[DataFrame]) -> tuple[GraphState, str | None]:
    """Applies journaled change sets again; the code of the first that does not apply, or None."""
    for c in changes:
        done = apply_changes(state, c)
        if done.code:
            return state, done.code
        state = done.state
    return state, None


def checkpoint_rules(plan: Plan) -> dict[str, R.Checkpoint]:
    return {c.key: c for c in plan.checkpoints}
