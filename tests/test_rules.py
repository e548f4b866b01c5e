"""The operators on small states: results, rejections, and undo."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillgraph import rules as R
from quillgraph import values as V
from quillgraph.expr import Checker, Expr, ExpressionError, call, count, exists, extract, field, lit, over
from quillgraph.functions import identity
from quillgraph.operators import execute
from quillgraph.operators.patch import apply_changes, undo_changes
from quillgraph.schema import RELATION_TYPE, EntityKind, Field, RelationKind, Schema, SchemaError
from quillgraph.state import empty_state

LINEAGE = identity.lineage_id("tests", "garden")
S, I = V.STRING, V.INT64
SCHEMA = Schema(
    (
        EntityKind("plant", (Field("tag", S, True), Field("stage", S), Field("plot", S), Field("height", I))),
        EntityKind("pot", (Field("label", S, True), Field("plot", S))),
        EntityKind("bed", (Field("plot", S, True), Field("plants", I), Field("growth", I))),
        EntityKind("sample", (Field("sort", S, True), Field("size", I))),
    ),
    (RelationKind("stands_in", "plant", "pot"), RelationKind("waters", "bed", "pot"), RelationKind("shades", "plant", "plant")),
)
P1, P2, P3 = (identity.source_id(LINEAGE, "plant", n) for n in ("P1", "P2", "P3"))
Q1, Q2 = (identity.source_id(LINEAGE, "pot", n) for n in ("Q1", "Q2"))
PLANTS = [(P1, "P1", "SEED", "north", 4), (P2, "P2", "SPROUT", "north", 9), (P3, "P3", "SPROUT", "south", 20)]
NORTH = call("equal", field("plant.plot"), lit("north"))


@pytest.fixture(scope="module")
def state(spark):
    """Two plots: two plants and a pot in the north, of which one plant stands in the pot, and a plant in its pot in the south."""
    s = empty_state(spark, SCHEMA, LINEAGE)
    s = s.with_kind("plant", spark.createDataFrame(PLANTS, SCHEMA.entity("plant").struct()))
    s = s.with_kind("pot", spark.createDataFrame([(Q1, "Q1", "north"), (Q2, "Q2", "south")], SCHEMA.entity("pot").struct()))
    edges = [("stands_in", "plant", P1, "pot", Q1), ("stands_in", "plant", P3, "pot", Q2)]
    return s.with_relations(spark.createDataFrame(edges, RELATION_TYPE)).checked()


def plants(where=None, by="plot", **kw):
    return R.Selector("plant", where, field(f"plant.{by}") if by else None, **kw)


def undone(state, out):
    """Undo after a rule gives the state before it, and replay gives the state after it."""
    content = lambda s: [rows(df, *df.columns) for df in s.entities.values()] + [rows(s.relations, *s.relations.columns)]
    assert content(undo_changes(out.state, out.changes).state) == content(state)
    assert content(apply_changes(state, out.changes).state) == content(out.state)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_select_and_assign_reads_the_state_before(state):
    grown = R.Assignment("plant.height", call("add", field("plant.height"), over("sum", "plant.height")))
    stage = R.Assignment("plant.stage", call("if", call("less", field("plant.height"), lit(8)), lit("LOW"), lit("HIGH")))
    out = execute(state, R.Rule("r", R.SelectAndAssign(plants(), (grown, stage))))
    assert rows(out.state.entities["plant"], "tag", "height", "stage") == [("P1", 17, "LOW"), ("P2", 22, "HIGH"), ("P3", 40, "HIGH")]
    undone(state, out)


def test_insert_grouped_and_ungrouped(state):
    made = (R.Assignment("bed.plot", lit("north")), R.Assignment("bed.plants", count()), R.Assignment("bed.growth", over("sum", "plant.height")))
    out = execute(state, R.Rule("form", R.InsertEntity(plants(NORTH, members=R.Cardinality("exactly", 2)), "bed", lit("BED"), made)))
    assert rows(out.state.entities["bed"], "plot", "plants", "growth") == [("north", 2, 13)]
    assert out.state.entities["bed"].first()["id"] == identity.synthetic_id(LINEAGE, "bed", "form", [P1, P2], V.string("BED"))
    undone(state, out)
    taken = (R.Assignment("sample.sort", field("plant.stage")), R.Assignment("sample.size", field("plant.height")))
    out = execute(state, R.Rule("take", R.InsertEntity(plants(by=None), "sample", field("plant.tag"), taken)))
    assert {r["size"] for r in out.state.entities["sample"].collect()} == {4, 9, 20}
    undone(state, out)
    again = execute(out.state, R.Rule("take", R.InsertEntity(plants(by=None), "sample", field("plant.tag"), taken)))
    assert again.code == R.COLLISION and again.state is out.state
    with pytest.raises(SchemaError):
        execute(state, R.Rule("x", R.InsertEntity(plants(), "bed", lit("B"))))


def test_delete_does_not_cascade(state):
    one = lambda d: R.Rule("del", R.DeleteEntity(plants(call("equal", field("plant.tag"), lit(d)), by=None)))
    out = execute(state, one("P2"))
    assert rows(out.state.entities["plant"], "tag") == [("P1",), ("P3",)]
    undone(state, out)
    assert execute(state, one("P3")).code == R.DANGLING
    assert execute(state, one("nobody")).code == R.SELECTION_EMPTY


def test_relate_and_unrelate(state):
    same_plot = call("equal", field("plant.plot"), field("pot.plot"))
    only = lambda tag: plants(call("equal", field("plant.tag"), lit(tag)), by=None)
    rule = lambda kind, who: R.Rule("r", kind("stands_in", who, R.Selector("pot"), same_plot))
    out = execute(state, rule(R.RelateEntities, only("P2")))
    assert out.accepted and rows(out.state.relations, "from_id", "to_id") == sorted([(P1, Q1), (P2, Q1), (P3, Q2)], key=str)
    undone(state, out)
    assert execute(state, rule(R.RelateEntities, plants(by=None))).code == R.ALREADY_RELATED
    assert execute(state, rule(R.UnrelateEntities, plants(by=None))).code == R.NOT_RELATED
    gone = execute(state, rule(R.UnrelateEntities, only("P3")))
    assert rows(gone.state.relations, "from_id") == [(P1,)]
    undone(state, gone)
    over_it = call("all", call("less", field("to.height"), field("from.height")), call("equal", field("from.plot"), field("to.plot")))
    out = execute(state, R.Rule("m", R.RelateEntities("shades", plants(by=None), plants(by=None), over_it)))
    assert rows(out.state.relations.where("kind = 'shades'"), "from_id", "to_id") == [(P2, P1)]
    every = execute(state, R.Rule("m", R.RelateEntities("shades", plants(by=None), plants(by=None))))
    assert every.state.relations.where("kind = 'shades'").count() == 9  # pairs of an entity with itself included


def test_relation_guard_faults(state, spark):
    bare = spark.createDataFrame([("sha256:" + "f" * 64, "P9", "SPROUT", None, None)], SCHEMA.entity("plant").struct())
    s = state.with_kind("plant", state.entities["plant"].unionByName(bare))
    same_plot, low = call("equal", field("plant.plot"), field("pot.plot")), call("less", field("plant.height"), lit(8))
    rel = lambda *parts: execute(s, R.Rule("rel", R.RelateEntities("stands_in", plants(by=None), R.Selector("pot"), call("all", *parts))))
    assert rel(same_plot, low).code == R.EXPRESSION_UNAVAILABLE  # an absent key faults for every pair
    assert rel(exists("plant.plot"), same_plot, exists("plant.height")).code == R.ALREADY_RELATED  # not asked for behind a false conjunct
    four = call("equal", field("plant.height"), lit(4))
    assert rel(call("equal", field("plant.tag"), field("pot.label")), four).code == R.GUARD_UNSATISFIED  # first key never agrees


@pytest.mark.parametrize("reanchor", [True, False])
def test_merge(state, reanchor):
    made = (R.Assignment("plant.tag", lit("MIX")), R.Assignment("plant.height", over("sum", "plant.height")))
    out = execute(state, R.Rule("merge", R.MergeEntities(plants(NORTH), "plant", lit("M"), made, reanchor_relations=reanchor)))
    assert rows(out.state.entities["plant"], "tag", "height") == [("MIX", 13), ("P3", 20)]
    merged = out.state.entities["plant"].where("tag = 'MIX'").first()["id"]
    assert rows(out.state.relations, "from_id", "to_id") == sorted([(P3, Q2)] + [(merged, Q1)] * reanchor, key=str)
    undone(state, out)


def test_merge_retains_and_drops_loops(state, spark):
    more = spark.createDataFrame([("shades", "plant", P1, "plant", P2), ("stands_in", "plant", P2, "pot", Q1)], RELATION_TYPE)
    s = state.with_relations(state.relations.unionByName(more))
    made = (R.Assignment("plant.tag", lit("M")),)
    merge = lambda *a, **k: execute(s, R.Rule("merge", R.MergeEntities(plants(NORTH), *a, **k)))
    out = merge("plant", lit("M"), made, reanchor_relations=True)
    assert rows(out.state.relations, "kind", "to_id") == sorted([("stands_in", Q1), ("stands_in", Q2)], key=str)
    undone(s, out)
    kept = merge("plant", lit("M"), made, retain_sources=True)
    assert kept.state.entities["plant"].count() == 4 and kept.state.relations.count() == 4
    to_bed = merge("bed", lit("M"), (R.Assignment("bed.plot", lit("north")),), reanchor_relations=True)
    assert rows(to_bed.state.relations, "from_id") == [(P3,)]  # no declared relation fits the new ends


@pytest.mark.parametrize("retain", [True, False])
def test_split(state, retain):
    half = R.Assignment("sample.size", call("divide", field("plant.height"), lit(2)))
    part = lambda n: R.Partition(lit(n), (R.Assignment("sample.sort", lit(n)), half))
    out = execute(state, R.Rule("split", R.SplitEntity(plants(by=None), "sample", (part("A"), part("B")), retain_source=retain)))
    assert rows(out.state.entities["sample"], "sort", "size") == sorted([(n, x) for n in "AB" for x in (2, 4, 10)], key=str)
    assert out.state.entities["plant"].count() == (3 if retain else 0) and out.state.relations.count() == (2 if retain else 0)
    undone(state, out)
    assert execute(state, R.Rule("split", R.SplitEntity(plants(by=None), "sample", (part("A"), part("A"))))).code == R.COLLISION


def test_rejections_come_in_order(state, spark):
    gap = spark.createDataFrame([("sha256:" + "e" * 64, "P9", None, "west", None)], SCHEMA.entity("plant").struct())
    s = state.with_kind("plant", state.entities["plant"].unionByName(gap))
    put = lambda sel, guard=None, value=lit("x"): execute(s, R.Rule("r", R.SelectAndAssign(sel, (R.Assignment("plant.stage", value),), guard or call("equal", lit(1), lit(1)))))
    nine = call("equal", field("plant.height"), lit(9))
    assert put(plants(nine)).code == R.EXPRESSION_UNAVAILABLE  # where is evaluated for every plant
    assert put(plants(call("all", exists("plant.height"), nine))).accepted
    assert put(plants(members=R.Cardinality("exactly", 2))).code == R.CARDINALITY_INVALID
    assert put(plants(call("equal", field("plant.tag"), lit("?")))).code == R.SELECTION_EMPTY
    assert put(plants(), call("less", over("sum", "plant.height"), lit(100))).code == R.EXPRESSION_UNAVAILABLE
    assert put(plants(), call("less", lit(5), count())).code == R.GUARD_UNSATISFIED
    concat = call("concat", field("plant.stage"), lit("!"))
    assert put(plants(), None, concat).code == R.EXPRESSION_UNAVAILABLE
    assert put(plants(), call("equal", count(), lit(2)), concat).accepted  # values are evaluated for groups that pass only


def test_quantifiers_and_ordered_sums(spark):
    schema = Schema((EntityKind("e", (Field("g", S), Field("x", I), Field("out", S))),))
    big = V.INT_MAX

    def verdict(xs, guard, **kw):
        data = [("sha256:" + f"{i:064x}", "g", x, None) for i, x in enumerate(xs)]
        s = empty_state(spark, schema, LINEAGE).with_kind("e", spark.createDataFrame(data, schema.entity("e").struct()))
        return execute(s, R.Rule("r", R.SelectAndAssign(R.Selector("e", None, field("e.g")), (R.Assignment("e.out", lit("y")),), guard))).code

    one = call("all_members", call("equal", field("e.x"), lit(1)))
    some = call("any_members", call("equal", field("e.x"), lit(1)))
    same = over("all_equal", "e.x")
    ok, no, fault = None, R.GUARD_UNSATISFIED, R.EXPRESSION_UNAVAILABLE
    assert [verdict(x, one) for x in ([1, 1], [1, 2, None], [1, None, 2], [None])] == [ok, no, fault, fault]
    assert [verdict(x, some) for x in ([2, 1, None], [2, None, 1], [2, 2])] == [ok, fault, no]
    assert [verdict(x, same) for x in ([3, 3], [3, 4, None], [3, None, 4], [None, 3], [3, None])] == [ok, no, fault, fault, fault]
    small = call("less", over("sum", "e.x"), lit(big))
    assert [verdict(x, small) for x in ([1, 2], [big, 1, -5], [big, -5, 1], [1, None])] == [ok, fault, ok, fault]


CASES = [
    (call("add", lit(1), lit(2)), 3), (call("add", lit(V.INT_MAX), lit(1)), None), (call("subtract", lit(V.INT_MIN), lit(1)), None), (call("multiply", lit(V.INT_MAX), lit(2)), None),
    (call("divide", lit(-7), lit(2)), -3), (call("divide", lit(1), lit(0)), None), (call("divide", lit(V.INT_MIN), lit(-1)), None), (call("modulo", lit(-7), lit(2)), -1),
    (call("modulo", lit(7), lit(-2)), 1), (call("modulo", lit(1), lit(0)), None), (call("modulo", lit(V.INT_MIN), lit(-1)), None), (call("abs", lit(V.INT_MIN)), None), (call("abs", lit(-4)), 4),
    (call("clamp", lit(7), lit(1), lit(9)), 7), (call("clamp", lit(7), lit(8), lit(9)), 8), (call("clamp", lit(7), lit(9), lit(8)), None), (call("clamp", field("e.x"), lit(1), lit(2)), None),
    (call("coalesce", call("divide", lit(1), lit(0)), lit(5)), 5), (call("if", exists("e.x"), call("divide", lit(1), lit(0)), lit(2)), 2), (call("if", call("equal", field("e.x"), lit(1)), lit(1), lit(2)), None),
    (call("all", call("equal", field("e.x"), lit(1)), call("not", call("equal", lit(1), lit(1)))), None), (call("all", call("equal", lit(1), lit(2)), call("equal", field("e.x"), lit(1))), False),
    (call("any", call("equal", lit(1), lit(1)), call("equal", field("e.x"), lit(1))), True), (call("any", call("equal", field("e.x"), lit(1)), call("equal", lit(1), lit(1))), None),
    (call("concat", lit("a"), lit("b")), "ab"), (call("substring", lit("a😀bc"), lit(1), lit(2)), "😀b"), (call("substring", lit("abc"), lit(3), lit(1)), ""), (call("substring", lit("abc"), lit(-1), lit(1)), None),
    (call("substring", lit("abc"), lit(0), lit(V.INT_MAX)), "abc"), (call("trim", lit("\t  a b \n")), "a b"),
    (call("timestamp_diff", lit(V.timestamp("2031-03-05T06:00:00Z")), lit(V.timestamp("2031-03-05T06:00:00.5Z"))), 0), (call("timestamp_diff", lit(V.timestamp("2240-06-01T00:00:00.000000001Z")), lit(V.timestamp("1702-02-03T00:00:00Z"))), 16987881600),
    (call("timestamp_diff", lit(V.timestamp("1702-02-03T00:00:00.9Z")), lit(V.timestamp("2240-06-01T00:00:00Z"))), -16987881599),
    (call("timestamp_add", lit(V.timestamp("2031-03-05T06:00:00Z")), lit(V.duration("2h"))), V.parse_timestamp("2031-03-05T08:00:00Z")), (call("add", lit(V.timestamp("2262-04-11T00:00:00Z")), lit(V.duration("24h"))), None),
    (extract("day_of_week", lit(V.date("2031-03-05"))), 3), (extract("day_of_week", lit(V.timestamp("1969-12-31T23:59:59.999999999Z"))), 3), (extract("hour", lit(V.timestamp("1969-12-31T23:59:59Z"))), 23), (extract("year", lit(V.date("0001-01-01"))), 1),
    (call("less", lit(V.date("2026-01-01")), lit(V.date("2026-01-02"))), True),
]
DECIMALS = [
    ("divide", "5", "3", "1.666666666666666666"), ("divide", "0.9", "1.2", "0.75"), ("divide", "-5", "3", "-1.666666666666666666"), ("divide", "1", "0", None), ("divide", "81.20", "8", "10.15"),
    ("multiply", "12.50", "6", "75"), ("add", "0.1", "0.2", "0.3"), ("subtract", "9.75", "0.75", "9"), ("multiply", "9" * 30, "9" * 30, str(int("9" * 30) ** 2)), ("subtract", "1", "1.0", "0"),
]


def test_scalars(spark):
    from quillgraph.functions.columns import Compiler, kind_fields

    compiler = Compiler(kind_fields({"x": Field("x", I)}))
    base = spark.createDataFrame([(None,)], "x bigint")
    got = base.select(*[compiler.typed(e).col.alias(f"c{i}") for i, (e, _) in enumerate(CASES)]).first()
    bad = [(e, want, x) for (e, want), x in zip(CASES, got, strict=True) if x != want]
    assert not bad
    c = Compiler(kind_fields({n: Field(n, V.DECIMAL) for n in "ab"}))
    data = spark.createDataFrame([(i, a, b) for i, (_, a, b, _) in enumerate(DECIMALS)], "i int, a string, b string")
    ops = {op: c.typed(call(op, field("e.a"), field("e.b"))).text() for op in ("add", "subtract", "multiply", "divide")}
    out = {r["i"]: r for r in data.select("i", *[x.alias(n) for n, x in ops.items()]).collect()}
    assert [out[i][op] for i, (op, *_) in enumerate(DECIMALS)] == [w for *_, w in DECIMALS]
    literal = [Compiler(kind_fields({})).typed(call(op, lit(V.decimal(a)), lit(V.decimal(b)))).text().alias(f"d{i}") for i, (op, a, b, _) in enumerate(DECIMALS)]
    assert list(spark.range(1).select(*literal).first()) == [w for *_, w in DECIMALS]


@pytest.mark.parametrize("of,by,native", [((12, 2), (4, 2), True), ((22, 2), (1, 0), True), ((12, 6), (18, 18), True), ((18, 6), (18, 18), False), ((9, 9), (9, 0), True), ((31, 0), (18, 0), True), ((5, 0), (3, 3), True), ((20, 10), (5, 2), True)])
def test_native_division(spark, of, by, native):
    """Declared digits are divided without Python where 38 digits do, and give what exact arithmetic gives in any case."""
    from quillgraph.functions.columns import Compiler, kind_fields

    draw = random.Random(f"{of}{by}")

    def some(p, s):
        n = draw.choice([0, 1, 10**p - 1, 10 ** draw.randrange(p), draw.randrange(10**p), draw.randrange(10 ** draw.randint(1, p))])
        return V.EXACT.scaleb(Decimal(draw.choice([n, -n])), -s)

    rows = [(i, some(*of), some(*by)) for i in range(300)]
    e = [Field("a", V.DECIMAL, digits=of), Field("b", V.DECIMAL, digits=by)]
    data = spark.createDataFrame([*rows, (300, None, V.EXACT.scaleb(Decimal(1), -by[1])), (301, Decimal(0), None)], f"i int, a decimal({of[0]},{of[1]}), b decimal({by[0]},{by[1]})")
    t = Compiler(kind_fields({f.name: f for f in e})).typed(call("divide", field("e.a"), field("e.b")))
    out = data.select("i", t.text().alias("q"))
    assert ("Python" not in out._jdf.queryExecution().executedPlan().toString()) == native
    got = {r["i"]: r["q"] for r in out.collect()}
    for i, a, b in rows:
        want = V.decimal_op("divide", a, b)
        assert got[i] == (None if want is None else V.format_decimal(want)), (a, b)
    assert got[300] is None and got[301] is None


def test_decimals_of_unlike_digits(spark):
    """Where no native type holds both sides, they compare, combine and are stored exactly."""
    from quillgraph.functions.columns import Compiler, kind_fields, stored

    wide, fine = Field("w", V.DECIMAL, digits=(38, 0)), Field("f", V.DECIMAL, digits=(38, 30))
    data = spark.createDataFrame([(Decimal(2), V.EXACT.create_decimal("2." + "0" * 29 + "1")), (Decimal(10**37), Decimal(3))], "w decimal(38,0), f decimal(38,30)")
    c = Compiler(kind_fields({"w": wide, "f": fine}))
    w, f = field("e.w"), field("e.f")
    exprs = {"eq": call("equal", w, f), "less": call("less", w, f), "either": call("coalesce", w, f), "mid": call("clamp", f, w, w)}
    got = data.select(*[(t.text() if t.kind == V.DECIMAL else t.col).alias(n) for n, t in ((n, c.typed(e)) for n, e in exprs.items())], stored(c.typed(f), wide).alias("kept")).collect()
    assert [tuple(r) for r in got] == [(False, True, "2", "2", None), (False, False, str(10**37), str(10**37), Decimal(3))]


def test_types():
    check = Checker(SCHEMA, "plant")
    for bad in (call("less", lit("a"), lit("b")), call("equal", lit("a"), lit(V.atom("a"))), over("sum", "plant.plot"), field("pot.plot"), extract("hour", lit(V.date("2026-01-01"))), call("add", lit(1), lit("a"))):
        with pytest.raises(ExpressionError):
            check.type_of(bad, "member-in-group")
    with pytest.raises(ExpressionError):
        check.type_of(field("plant.height"), "group")
    with pytest.raises(ExpressionError):
        check.type_of(over("sum", "plant.height"), "member")
    deep = lit(1)
    for _ in range(70):
        deep = call("abs", deep)
    with pytest.raises(ExpressionError):
        check.type_of(deep, "member")
    with pytest.raises(ExpressionError):
        Expr("concat", (lit("a"),))


def test_identities_agree_on_both_sides(spark):
    ids = [P2, P1]
    from quillgraph.functions.columns import Typed

    got = spark.createDataFrame([("K é", ids, "T")], "k string, ids array<string>, d string").select(
        identity.source_id_column(LINEAGE, "plant", F.col("k")), identity.synthetic_id_column(LINEAGE, "bed", "r", F.col("ids"), Typed(F.col("d"), V.ATOM)),
        identity.timestamp_text(F.lit(V.parse_timestamp("1690-05-06T07:08:09.12Z"))),
    ).first()
    assert list(got) == [identity.source_id(LINEAGE, "plant", "K é"), identity.synthetic_id(LINEAGE, "bed", "r", ids, V.atom("T")), "1690-05-06T07:08:09.12Z"]


def test_patches_check_before_images(state):
    op = R.SelectAndAssign(plants(), (R.Assignment("plant.stage", lit("X")),))
    out = execute(state, R.Rule("r", op))
    twice = apply_changes(out.state, out.changes)
    assert twice.code == R.BEFORE_MISMATCH and twice.state is out.state
    assert apply_changes(state, out.changes.withColumn("id", F.lit("sha256:" + "0" * 64))).code == R.NO_UPDATE
