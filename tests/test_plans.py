"""Rule text, compilation, runs with checkpoints, diffs, corpora, the gate, and state files."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillgraph import rules as R
from quillgraph import values as V
from quillgraph.dsl import SyntaxError_, parse, unparse
from quillgraph.expr import call, count, field, lit
from quillgraph.functions import identity
from quillgraph.plans import corpus
from quillgraph.plans.compiler import compile_rules
from quillgraph.plans.diff import diff_metrics, diff_states
from quillgraph.plans.runner import replay, run_plan
from quillgraph.plans.sql_text import Emitter, plan_sql, project_files
from quillgraph.schema import RELATION_TYPE, EntityKind, Field, RelationKind, Schema, SchemaError
from quillgraph.sources import read_json_state, read_staged, write_json_state, write_state
from quillgraph.state import empty_state, ingest

LINEAGE = identity.lineage_id("tests", "plans")
LENDING = """
# a comment
schema {
  entity loan { code: string; branch: string; days: int64; fine_cents: int64 optional; mode: string; }
  entity shelf { label: string; branch: string; free: int64; }
  entity notice { branch: string; loans: int64; worst: int64; }
  entity slip { text: string; cents: int64; }
  relation placed { from: notice; to: shelf; }
}
rule price {
  select loan where loan.mode == "OUT" group_by loan.code having count() >= 1
  set loan.fine_cents = if(loan.days <= 21, 0, (loan.days - 21) * 15);
}
checkpoint priced after price;
rule notify (depends_on: ["price"]) {
  insert notice { select loan where loan.branch == "EAST" && coalesce(loan.fine_cents, 0) > 0 group_by loan.branch; discriminator: "LATE"; }
  set notice.branch = "EAST", notice.loans = count(), notice.worst = max(loan.fine_cents);
}
rule place (depends_on: ["notify"]) {
  relate notice to shelf as placed { from: select notice; to: select shelf; guard: all(notice.branch == shelf.branch, notice.loans < shelf.free); };
}
rule close (depends_on: ["place"]) {
  delete loan { select loan where loan.days <= 21; };
}
rule tear (depends_on: ["close"]) {
  split shelf into slip { select shelf where shelf.free < 0; retain_source: true;
    partition "one" { discriminator: "ONE"; set slip.text = "ONE", slip.cents = shelf.free * 100; } };
}
profile complete for entity loan { require loan.fine_cents present as FINE; }
"""


def lending_state(spark, schema):
    loans = [("L1", "EAST", 30), ("L2", "EAST", 21), ("L3", "WEST", 50), ("L4", "EAST", 22)]
    shelves = [("S1", "EAST", 5), ("S2", "EAST", 1), ("S3", "WEST", 9)]
    data = [(identity.source_id(LINEAGE, "loan", c), c, b, d, None, "OUT") for c, b, d in loans]
    s = empty_state(spark, schema, LINEAGE).with_kind("loan", spark.createDataFrame(data, schema.entity("loan").struct()))
    data = [(identity.source_id(LINEAGE, "shelf", x), x, b, n) for x, b, n in shelves]
    return s.with_kind("shelf", spark.createDataFrame(data, schema.entity("shelf").struct()))


def test_run_from_text(spark, tmp_path):
    source = parse(LENDING)
    plan = compile_rules(source.schema, source.ruleset).plan
    assert [c.rule.id for c in plan.rules] == ["price", "notify", "place", "close", "tear"]
    start = lending_state(spark, source.schema).checked()
    run = run_plan(plan, start)
    assert (run.status, run.failure.rule, run.failure.code) == ("rejected", "tear", R.SELECTION_EMPTY)
    assert {r["code"]: r["fine_cents"] for r in run.state.entities["loan"].collect()} == {"L1": 135, "L3": 435, "L4": 15}
    notice = run.state.entities["notice"].first()
    assert (notice["loans"], notice["worst"]) == (2, 135)
    assert [r["to_id"] for r in run.state.relations.collect()] == [identity.source_id(LINEAGE, "shelf", "S1")]
    assert [(c.key, c.assessments) for c in run.checkpoints] == [("priced", {"complete": "ready"})]
    assert [r["accepted"] for r in run.journal_frame().orderBy("sequence").collect()] == [True, True, True, True, False]
    again, code = replay(start, run.changes)
    assert code is None and again.digest() == run.state.digest() and again.content_digest() == run.state.content_digest()
    assert again.content_digest() != start.content_digest()
    changes = {(r["change"], r["kind"]) for r in diff_states(start, run.state).collect()}
    assert changes == {("modified", "loan"), ("deleted", "loan"), ("created", "notice"), ("relation_added", "placed")}
    metrics = {r["metric"]: r["n"] for r in diff_metrics(start, run.state).collect()}
    assert metrics == {"entities_before": 7, "entities_after": 7, "created": 1, "deleted": 1, "modified": 3, "relation_added": 1, "relation_removed": 0}
    write_json_state(run.state, f"{tmp_path}/state.json")
    assert read_json_state(spark, f"{tmp_path}/state.json").digest() == run.state.digest()
    write_state(run.state, f"{tmp_path}/staged")
    assert read_staged(spark, source.schema, LINEAGE, f"{tmp_path}/staged").digest() == run.state.digest()


def test_text_reads_back():
    source = parse(LENDING)
    assert parse(unparse(source)) == source
    extra = LENDING.split("rule price")[0] + """
    rule a (reads: [], writes: [], depends_on: []) { delete loan { select loan where !(loan.branch != "EAST") || -loan.days >= -3 && coalesce(loan.fine_cents, 0) % 2 == 1; }; }
    rule b { merge loan into loan { select loan group_by concat(loan.branch, trim(" x\\n\\"")); discriminator: atom("M"); reanchor_relations: true; } set loan.code = "M"; }
    rule c { unrelate notice from shelf as placed { from: select notice; to: select shelf; guard: all(notice.branch == shelf.branch, true); }; }
    rule d { select loan where all(exists(loan.branch), clamp(loan.days, 0, 5) < 3) set loan.branch = if(extract(year, date("2026-01-02")) > 2000 && ts("2026-01-02T00:00:00Z") < date_add(ts("2026-01-01T00:00:00Z"), dur("8h")), "x", substring("abc", 0, 1)); }
    """
    source = parse(extra)
    text = unparse(source)
    assert unparse(parse(text)) == text  # a default key is written out, and then needs no at_least 1
    assert [r for r in parse(text).ruleset.rules if r.id != "d"] == [r for r in source.ruleset.rules if r.id != "d"]
    by_id = {r.id: r for r in source.ruleset.rules}
    assert by_id["d"].operation.selector.group_by == field("loan.branch")  # the first field of where
    assert by_id["d"].operation.selector.members == R.Cardinality("at_least", 1)


@pytest.mark.parametrize("text", ["rule x { select }", "schema { entity a { b: blob; } }", "rule x { delete a { select a where null; }; }", 'rule x { delete a { select a where f(1); }; }', "schema { relation r { from: a; } }", "rule x { delete a { select a where " + "(" * 300 + "1" + ")" * 300 + "; }; }", '"unclosed', "@"])
def test_bad_text(text):
    with pytest.raises(SyntaxError_):
        parse(text)


def small_schema():
    return Schema((EntityKind("e", tuple(Field(n, V.INT64) for n in ("g", "a", "b", "c"))), EntityKind("t", (Field("x", V.INT64),))), (RelationKind("r", "e", "t"),))


def writes(name, target, *reads, after=(), **kw):
    value = lit(1)
    for r in reads:
        value = call("add", value, field(f"e.{r}"))
    return R.Rule(name, R.SelectAndAssign(R.Selector("e", None, field("e.g")), (R.Assignment(f"e.{target}", value),)), after, **kw)


def codes(*rules, profiles=(), checkpoints=()):
    return [(d.code, d.subject) for d in compile_rules(small_schema(), R.Ruleset(tuple(rules), tuple(checkpoints), tuple(profiles))).diagnostics]


def order(*rules):
    return [c.rule.id for c in compile_rules(small_schema(), R.Ruleset(tuple(rules))).plan.rules]


def test_dependency_order():
    assert order(writes("z", "a"), writes("y", "b", "a"), writes("x", "c", "b")) == ["z", "y", "x"]
    assert order(writes("b", "b"), writes("a", "a"), writes("c", "c", "b")) == ["a", "b", "c"]
    assert order(writes("c", "c"), writes("b", "b"), writes("a", "a", "c")) == ["b", "c", "a"]  # the smallest ready rule, not level by level
    assert order(writes("a", "a", after=("b",)), writes("b", "a")) == ["b", "a"]


def test_diagnostics():
    assert codes(writes("a", "a"), writes("b", "a")) == [("WRITE_CONFLICT_UNRESOLVED", "a|b")]
    assert codes(writes("a", "a", "b"), writes("b", "b", "a")) == [("DEPENDENCY_CYCLE", "ruleset")]
    assert codes(writes("a", "a", after=("a",))) == [("DEPENDENCY_CYCLE", "ruleset")]
    assert codes(writes("a", "a", after=("nobody",))) == [("UNSUPPORTED_OPERATOR", "a")]
    assert codes(writes("a", "nope")) == [("UNKNOWN_FIELD", "a")]
    assert codes(writes("a", "a", reads=("e.g",), writes=("e.b",))) == [("DECLARED_ACCESS_MISMATCH", "a")]
    assert codes(writes("a", "a", "b", reads=("e.b", "e.g"), writes=("e.a",))) == []
    ungrouped = R.Rule("u", R.SelectAndAssign(R.Selector("e"), (R.Assignment("e.a", lit(1)),)))
    assert codes(ungrouped) == [("UNSUPPORTED_OPERATOR", "u")]
    bare = R.Rule("m", R.MergeEntities(R.Selector("e", None, field("e.g")), "t", lit("d"), (R.Assignment("t.x", field("e.a")),)))
    assert codes(bare) == [("UNSUPPORTED_OPERATOR", "m")]
    twice = R.Rule("d", R.SelectAndAssign(R.Selector("e", None, field("e.g")), (R.Assignment("e.a", lit(1)), R.Assignment("e.a", lit(2)))))
    assert codes(twice) == [("UNSUPPORTED_OPERATOR", "d")]
    reduced = R.Rule("r", R.RelateEntities("r", R.Selector("e"), R.Selector("t"), call("less", count(), lit(1))))
    assert codes(reduced) == [("UNSUPPORTED_OPERATOR", "r")]
    assert codes(writes("a", "a"), checkpoints=[R.Checkpoint("c", "zzz")]) == [("UNSUPPORTED_OPERATOR", "c")]
    strong = R.Profile("p", "e", (R.Requirement("e.a", "A"), R.Requirement("e.b", "B")), ("q",))
    assert codes(profiles=[strong, R.Profile("q", "e", (R.Requirement("e.a", "A"),))]) == []
    assert codes(profiles=[strong, R.Profile("q", "e", (R.Requirement("e.c", "C"),))]) == [("PROFILE_ORDER_UNPROVABLE", "p")]


def test_plan_ids_do_not_depend_on_the_order_of_rules():
    a, b = writes("a", "a"), writes("b", "b", "a")
    ids = {compile_rules(small_schema(), R.Ruleset(rules)).plan.id for rules in ((a, b), (b, a))}
    assert len(ids) == 1 and ids != {compile_rules(small_schema(), R.Ruleset((a,))).plan.id}


def test_state_faults(spark):
    s = empty_state(spark, small_schema(), LINEAGE)
    assert s.checked() is s
    row = ("sha256:" + "a" * 64, 1, None, None, None)
    twice = s.with_kind("e", spark.createDataFrame([row, row], small_schema().entity("e").struct()))
    assert twice.faults() == ["e: duplicate ids"]
    with pytest.raises(SchemaError):
        twice.checked()
    edge = spark.createDataFrame([("r", "e", row[0], "t", row[0])], RELATION_TYPE)
    assert s.with_relations(edge).faults() == ["relations: an end does not exist"]
    assert ingest(spark, small_schema(), LINEAGE, {}).checked().digest() == s.digest()
    with pytest.raises(SchemaError):
        Schema((EntityKind("e", (Field("a", "blob"),)),))


def test_corpus_and_gate(spark):
    source = parse(LENDING)
    good = compile_rules(source.schema, R.Ruleset(source.ruleset.rules[:2], source.ruleset.checkpoints, source.ruleset.profiles)).plan
    case = lending_state(spark, source.schema)
    cases = {"one": case, "two": case.with_kind("loan", case.entities["loan"].where("code <> 'L3'"))}
    runs = corpus.run_corpus(good, cases, persist=False)
    assert {c: r.status for c, r in runs.items()} == {"one": "succeeded", "two": "succeeded"}
    results = corpus.results_frame(spark, runs)
    assert {r["status"]: r["n_cases"] for r in corpus.progress(results).collect()} == {"pending": 0, "running": 0, "succeeded": 2, "failed": 0, "unattempted": 0}
    policy = corpus.Policy((("priced", "priced"),), "complete")
    compared = corpus.compare(results, results, policy)
    ok, clauses = corpus.gate(corpus.gathered(good, runs, compared))
    assert ok and set(clauses.values()) == {"pass"}
    worse = spark.createDataFrame([("one", "succeeded", "priced", "complete", "needs_input")], corpus.RESULT)
    compared = corpus.compare(results, worse, policy)
    assert {(r["case_id"], r["cand_verdict"], r["cand_missing"]) for r in compared.collect()} == {("one", "needs_input", None), ("two", None, "not_executed")}
    ok, clauses = corpus.gate(corpus.gathered(good, runs, compared))
    assert not ok and clauses["no_metric_regression"] == "fail" and clauses["comparison_corpus"] == "fail"
    assert corpus.gate(corpus.Evidence())[1] == dict.fromkeys(corpus.CLAUSES, "not_evaluated")
    with pytest.raises(ValueError):
        corpus.Policy((("a", "b"), ("a", "c")), "p")


def test_gate_replays_every_case(spark):
    """A journal that does not give the sealed state makes the clause fail, in any case; without evidence it is not evaluated."""
    source = parse(LENDING)
    plan = compile_rules(source.schema, R.Ruleset(source.ruleset.rules[:2], source.ruleset.checkpoints, source.ruleset.profiles)).plan
    case = lending_state(spark, source.schema)
    runs = corpus.run_corpus(plan, {"one": case, "two": case}, persist=False)
    clause = lambda: corpus.gate(corpus.gathered(plan, runs, None))[1]["digest_consistency"]
    assert clause() == "pass"
    whole = list(runs["two"].changes)
    runs["two"].changes[0] = whole[0].limit(0)
    assert clause() == "fail"
    runs["two"].changes[:] = []
    assert clause() == "not_evaluated"
    runs["two"].changes[:], runs["one"].initial = whole, None
    assert clause() == "not_evaluated"
    sealed = runs["two"].checkpoints[-1]
    loans = sealed.state.entities["loan"]
    runs["two"].checkpoints[-1] = replace(sealed, state=sealed.state.with_kind("loan", loans.unionByName(loans)))
    clauses = corpus.gate(corpus.gathered(plan, runs, None))[1]
    assert clauses["digest_consistency"] == clauses["protected_invariants"] == "fail"


def test_emitted_sql_runs(spark, tmp_path):
    """The emitted SQL over staged tables gives the states that the operators give."""
    source = parse(LENDING)
    plan = compile_rules(source.schema, R.Ruleset(source.ruleset.rules[:4], source.ruleset.checkpoints)).plan
    start = lending_state(spark, source.schema)
    after = run_plan(plan, start, persist=False).state
    write_state(start, f"{tmp_path}/staged")
    for t in (*(f"raw_entities_{k}" for k in start.entities), "raw_relations"):
        rows = spark.read.parquet(f"{tmp_path}/staged/{t}")
        gone = rows.withColumns({"is_active": F.lit(False)} | ({"id": F.lit("sha256:" + "0" * 64)} if "id" in rows.columns else {}))
        gone.write.mode("append").parquet(f"{tmp_path}/staged/{t}")  # withdrawn rows
        spark.read.parquet(f"{tmp_path}/staged/{t}").createOrReplaceTempView(t)
    assert read_staged(spark, source.schema, LINEAGE, f"{tmp_path}/staged").digest() == start.digest()
    for k in ("loan", "notice", "relations"):
        got = spark.sql(plan_sql(plan, LINEAGE, k))
        want = after.relations if k == "relations" else after.entities[k]
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), k
    files = project_files(plan, LINEAGE)
    assert "models/checkpoints/chk_priced_loan.sql" in files and "{{ ref(" in files["models/transformations/tx_01_price_loan.sql"]


def test_emitted_decimal_division(spark):
    """The emitted quotient is the engine's: cut after 18 places, NULL for a zero divisor."""
    plan = compile_rules(small_schema(), R.Ruleset(())).plan
    for a, b in (("1.50", "0.40"), ("-5", "3"), ("7", "0.07"), ("1", "0"), ("123456789.123456789", "-0.000000003")):
        got = spark.sql("SELECT " + Emitter(plan, {}).sql(call("divide", lit(V.decimal(a)), lit(V.decimal(b))))).first()[0]
        want = V.decimal_op("divide", V.parse_decimal(a), V.parse_decimal(b))
        assert got == want, (a, b)


def test_values():
    assert V.decimal("25.500").text() == "25.5" and V.decimal("-0.0").text() == "0" and V.decimal("1200").text() == "1200"
    assert V.duration("8h").data == 28800 and V.duration("90").data == 90
    assert V.timestamp("2031-03-05T10:00:00.120Z").text() == "2031-03-05T10:00:00.12Z"
    for kind, bad in (("timestamp", "2031-03-05t10:00:00Z"), ("timestamp", "2031-03-05T10:00:60Z"), ("timestamp", "2031-03-05T10:00:00+01:00"), ("timestamp", "1600-01-01T00:00:00Z"), ("date", "2026-02-30"), ("int64", str(2**63)), ("decimal", "1e5"), ("decimal", "1" * 1001), ("duration", "x")):
        with pytest.raises(ValueError):
            V.from_text(kind, bad)
    assert json.loads(json.dumps({"k": V.string("é").text()})) == {"k": "é"}
