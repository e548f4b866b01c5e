"""Command line: ``python -m quillgraph COMMAND``.

compile RULES            the plan's id and order, or its diagnostics (exit 1)
format RULES             the canonical rule text
run RULES STATE [OUT]    runs the plan on a JSON state; prints the journal; exit 1 if a rule was rejected
sql RULES KIND LINEAGE   the plan as one SQL statement that selects a kind, or "relations", of the lineage with this id
project RULES FOLDER LINEAGE   the plan as the files of a model project
diff STATE STATE         the changes between two JSON states
gate BASE CANDIDATE PROFILE CHECKPOINT STATE...   the clauses of the promotion gate over a corpus; exit 1 unless authorised
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .dsl import parse, unparse
from .plans import corpus
from .plans.compiler import Plan, compile_rules
from .plans.diff import diff_states
from .plans.runner import run_plan
from .plans.sql_text import plan_sql, project_files
from .sources import read_json_state, read_rules, write_json_state


def spark() -> SparkSession:
    return SparkSession.builder.appName("quillgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def compiled(path: str) -> Plan:
    source = read_rules(path)
    result = compile_rules(source.schema, source.ruleset)
    if result.plan is None:
        for d in result.diagnostics:
            print(f"{d.code} {d.subject} {d.detail}")
        raise SystemExit(1)
    return result.plan


def main(args: list[str]) -> int:
    match args:
        case ["compile", rules]:
            plan = compiled(rules)
            print(plan.id, *[c.rule.id for c in plan.rules], sep="\n")
        case ["format", rules]:
            print(unparse(parse(Path(rules).read_text(encoding="utf-8"))), end="")
        case ["run", rules, state, *out]:
            run = run_plan(compiled(rules), read_json_state(spark(), state).checked())
            for e in run.journal:
                print(e.sequence, e.rule, "accepted" if e.accepted else f"rejected {e.code} {e.obligation or ''}")
            for c in run.checkpoints:
                print(c.key, c.assessments)
            if out:
                write_json_state(run.state, out[0])
            return int(run.failure is not None)
        case ["sql", rules, kind, lineage]:
            print(plan_sql(compiled(rules), lineage, kind))
        case ["project", rules, folder, lineage]:
            for name, text in project_files(compiled(rules), lineage).items():
                path = Path(folder) / name
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(text, encoding="utf-8")
        case ["diff", a, b]:
            session = spark()
            for r in diff_states(read_json_state(session, a), read_json_state(session, b)).toLocalIterator():
                print(r["change"], r["kind"], r["id"], r["field"] or "")
        case ["gate", base, candidate, profile, checkpoint, *states] if states:
            session = spark()
            cases = {s: read_json_state(session, s).checked() for s in states}
            plan = compiled(candidate)
            runs = corpus.run_corpus(plan, cases, persist=False)
            results = [corpus.results_frame(session, r) for r in (corpus.run_corpus(compiled(base), cases, persist=False), runs)]
            ok, clauses = corpus.gate(corpus.gathered(plan, runs, corpus.compare(*results, corpus.Policy(((checkpoint, checkpoint),), profile))))
            print(*[f"{k} {v}" for k, v in clauses.items()], "authorised" if ok else "refused", sep="\n")
            return int(not ok)
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
