"""Relations that are kept as two sides: they are written so, counted so, and give the same rows as comparing all pairs."""

import pytest
from pyspark.sql import functions as F

from quillgraph import pairs as P
from quillgraph import rules as R
from quillgraph import values as V
from quillgraph.expr import call, field, lit
from quillgraph.functions import identity
from quillgraph.operators import execute
from quillgraph.operators.patch import undo_changes
from quillgraph.schema import RELATION_TYPE, EntityKind, Field, RelationKind, Schema
from quillgraph.state import empty_state

S, I = V.STRING, V.INT64
LINEAGE = identity.lineage_id("tests", "harbour")
SCHEMA = Schema(
    (EntityKind("pilot", (Field("name", S, True), Field("port", S), Field("rank", I))), EntityKind("ship", (Field("name", S, True), Field("port", S), Field("draught", I), Field("kind", S)))),
    (RelationKind("guides", "pilot", "ship"),),
)
PILOTS = [(f"sha256:{i:064x}", f"p{i}", "north" if i % 3 else "south", i % 7) for i in range(60)]
SHIPS = [(f"sha256:{1000 + i:064x}", f"s{i}", "north" if i % 4 else "east", i % 11, "tug") for i in range(80)]
SAME_PORT = call("equal", field("pilot.port"), field("ship.port"))
DEEP = call("less", field("ship.draught"), field("pilot.rank"))


@pytest.fixture(scope="module")
def harbour(spark):
    s = empty_state(spark, SCHEMA, LINEAGE)
    return s.with_kind("pilot", spark.createDataFrame(PILOTS, SCHEMA.entity("pilot").struct())).with_kind("ship", spark.createDataFrame(SHIPS, SCHEMA.entity("ship").struct()))


def rule(op, guard, pilots=None, ships=None):
    return R.Rule("guide", op("guides", R.Selector("pilot", pilots), R.Selector("ship", ships), guard))


def wanted(test):
    return sorted((p[0], s[0]) for p in PILOTS for s in SHIPS if test(p, s))


def ends(state):
    return sorted(tuple(r) for r in state.relations.select("from_id", "to_id").collect())


def port(p, s):
    return p[2] == s[2]


def test_checkpoints_write_sides_and_not_pairs(harbour, monkeypatch):
    made = execute(harbour, rule(R.RelateEntities, SAME_PORT))
    assert made.counts["passed"] == len(wanted(port)) == 40 * 60
    written = []
    from quillgraph import state as module

    store = module.stored_table
    monkeypatch.setattr(module, "stored_table", lambda df, path: written.append(df.count()) or store(df, path))
    kept = made.state.persisted("pairs", since=harbour)
    assert sum(written) == len(PILOTS) + len(SHIPS)  # 2,400 rows of relations before
    assert ends(kept) == wanted(port)


def test_unrelate_from_pairs_and_from_rows(harbour, spark):
    low, small = call("less", field("pilot.rank"), lit(3)), call("less", field("ship.draught"), lit(5))
    first = execute(harbour, rule(R.RelateEntities, SAME_PORT)).state
    as_rows = harbour.with_relations(spark.createDataFrame(first.relations.collect(), RELATION_TYPE))
    left = wanted(lambda p, s: port(p, s) and not (p[3] < 3 and s[3] < 5))
    rest = wanted(lambda p, s: port(p, s) and not (p[3] < 3 and s[3] < 5) and not (s[3] >= 5 and s[3] < p[3]))
    for start in (first, as_rows, first.persisted("once")):
        out = execute(start, rule(R.UnrelateEntities, SAME_PORT, low, small))
        assert out.counts["related"] == out.counts["passed"] == len(wanted(port)) - len(left)
        assert ends(out.state) == left and ends(undo_changes(out.state, out.changes).state) == wanted(port)
        large = call("not", small)
        again = execute(out.state, rule(R.UnrelateEntities, call("all", SAME_PORT, DEEP), None, large))
        assert again.accepted and ends(again.state) == rest
        assert execute(again.state, rule(R.UnrelateEntities, SAME_PORT)).code == R.NOT_RELATED
        assert execute(again.state, rule(R.RelateEntities, SAME_PORT)).code == R.ALREADY_RELATED
        back = execute(again.state, rule(R.RelateEntities, SAME_PORT, low, small))
        assert back.accepted and ends(back.state) == sorted(rest + [x for x in wanted(port) if x not in set(left)])


@pytest.mark.parametrize("limits", [(0, 100), (10, 300), (10**6, 100)])
def test_pairs_of_every_size(harbour, monkeypatch, limits):
    """A grid of parts, a merge join, and a broadcast dealt to tasks give the same pairs."""
    monkeypatch.setattr(P, "BROADCAST_ROWS", limits[0])
    monkeypatch.setattr(P, "PAIRS_A_TASK", limits[1])
    assert ends(execute(harbour, rule(R.RelateEntities, SAME_PORT)).state) == wanted(port)
    assert ends(execute(harbour, rule(R.RelateEntities, call("all", SAME_PORT, DEEP))).state) == wanted(lambda p, s: port(p, s) and s[3] < p[3])


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_a_task_makes_pairs_of_few_ids(harbour, monkeypatch, broadcast):
    """Files keep ids as numbers only if a task has few different ones; each task had all 40 pilots of a port before."""
    monkeypatch.setattr(P, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(P, "PAIRS_A_TASK", 100)
    for guard, test in ((SAME_PORT, port), (call("all", SAME_PORT, DEEP), lambda p, s: port(p, s) and s[3] < p[3]), (DEEP, lambda p, s: s[3] < p[3])):
        made = execute(harbour, rule(R.RelateEntities, guard)).state
        assert ends(made) == wanted(test)
        tasks = made.relations.groupBy(F.spark_partition_id()).agg(F.countDistinct("from_id"), F.countDistinct("to_id")).collect()
        assert len(tasks) >= 10
        assert sum(t[1] for t in tasks) <= 25 * len(tasks) and sum(t[2] for t in tasks) <= 25 * len(tasks)


def test_status_of_a_keyed_relation_makes_no_pairs(harbour, monkeypatch):
    """The counts come from sizes of groups; a field called kind is no column of relations."""
    monkeypatch.setattr(P.Pairs, "matched", lambda self: self.left.crossJoin(self.right).where(F.raise_error(F.lit("pairs")).isNull()))
    made = execute(harbour, rule(R.RelateEntities, SAME_PORT))
    assert made.counts["passed"] == 2400
    assert execute(made.state, rule(R.UnrelateEntities, SAME_PORT)).counts["related"] == 2400


@pytest.mark.parametrize("name", ["q_merge_reanchor", "q_diff_metrics"])
def test_tables_of_entities_are_not_sent_to_the_driver(spark, monkeypatch, name):
    """Spark takes these tables for small, as it goes by compressed files; the same rows come without a broadcast."""
    from quillgraph import queries

    run = queries.QUERIES[name]
    before = sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(P, "SMALL_ROWS", 0)
    df = run(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == before


def test_inserted_rows_are_made_once(spark, tmp_path):
    """Later rules of a run and its checkpoints read what an insertion made, and do not group the orders again."""
    from quillgraph import queries

    run = queries.flagship_run(spark, "/root/testdata/sf0.001")
    assert run.status == "succeeded"
    plan = run.changes[0]._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and run.changes[0].count() == run.state.entities["account"].count() > 0
    assert len(run.state.pairs) == 2 and run.state.listed.isEmpty()
