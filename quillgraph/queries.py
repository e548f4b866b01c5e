"""One query for each operator and function group of the engine over the retail tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retail
from . import rules as R
from . import values as V
from .dsl import parse
from .expr import Expr, call, count, exists, extract, field, lit, over
from .functions.columns import Compiler, kind_fields
from .operators import Outcome, execute
from .operators.patch import apply_changes, changes_of, relation_changes, undo_changes
from .operators.selector import select, violates
from .pairs import unsent
from .plans import corpus, profiles
from .plans.compiler import compile_rules
from .plans.diff import diff_metrics, diff_states
from .plans.runner import run_plan
from .retail import read, sql_source_id, sql_synthetic_id
from .schema import RELATION_TYPE, Schema
from .state import GraphState

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sel(kind: str, where: Expr | None = None, by: str | None = None, members: R.Cardinality = R.Cardinality()) -> R.Selector:
    return R.Selector(kind, where, field(f"{kind}.{by}") if by else None, members)


def eq(a: Expr | str, b: Expr | str | int) -> Expr:
    return call("equal", field(a) if isinstance(a, str) else a, b if isinstance(b, Expr) else lit(b))


def put(path: str, value: Expr) -> R.Assignment:
    return R.Assignment(path, value)


def accepted(out: Outcome) -> GraphState:
    if not out.accepted:
        raise RuntimeError(f"the rule was rejected: {out.code}")
    return out.state


def projected(state: GraphState, kind: str, key: str, **exprs: Expr) -> DataFrame:
    """Values of expressions for every entity of a kind; decimals as canonical text."""
    compiler = Compiler(kind_fields({f.name: f for f in state.schema.entity(kind).fields}))
    typed = {n: compiler.typed(e) for n, e in exprs.items()}
    return state.entities[kind].select(key, *[(t.text() if t.kind == V.DECIMAL else t.col).alias(n) for n, t in typed.items()])


def shown(name: str) -> Column:
    """An int64 that may be absent, as -1."""
    return F.coalesce(name, F.lit(-1)).cast("bigint").alias(name)


def code_row(out: Outcome) -> DataFrame:
    return out.state.spark.range(1).select(F.lit(out.code).alias("code"), F.lit(out.obligation).alias("obligation"))


CUST = "SELECT c_custkey AS custkey, c_name AS name, c_nationkey::BIGINT AS nationkey, c_mktsegment AS segment, round(c_acctbal * 100)::BIGINT AS cents FROM customer"
ORD = "SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS status, o_orderpriority AS priority, round(o_totalprice * 100)::BIGINT AS cents, o_orderdate AS placed FROM orders"
SUPP = "SELECT s_suppkey AS suppkey, s_nationkey::BIGINT AS nationkey, round(s_acctbal * 100)::BIGINT AS cents FROM supplier"
LINE = "SELECT l_orderkey AS orderkey, l_linenumber::BIGINT AS linenumber, round(l_quantity)::BIGINT AS quantity, round(l_extendedprice * 100)::BIGINT AS cents, round(l_discount * 100)::BIGINT AS pct, l_returnflag AS flag, l_shipdate::DATE AS shipped FROM lineitem"
CID, OID, SID = sql_source_id("customer", "custkey"), sql_source_id("order", "orderkey"), sql_source_id("supplier", "suppkey")


# -- sources


@query(f"SELECT {sql_source_id('nation', 'n_nationkey')} AS id, n_nationkey::BIGINT AS nationkey, n_name AS name FROM nation")
def q_scan_source_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").entities["nation"].select("id", "nationkey", "name")


@query(f"WITH e AS (SELECT 'customer' AS kind, count(*) AS n, count(DISTINCT c_custkey) AS ids FROM customer UNION ALL SELECT 'lineitem', count(*), count(*) FROM lineitem) SELECT kind, n, ids FROM e")
def q_ingest_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "customer", "lineitem")
    parts = [s.entities[k].agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).select(F.lit(k).alias("kind"), "n", "ids") for k in ("customer", "lineitem")]
    return parts[0].unionByName(parts[1])


# -- selector


@query(f"SELECT custkey FROM ({CUST}) WHERE segment = 'BUILDING' AND cents > 0")
def q_select_where(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "customer")
    rich = call("all", eq("customer.segment", "BUILDING"), call("less", lit(0), field("customer.acctbal_cents")))
    return select(s, sel("customer", rich), []).chosen.select("custkey")


@query(f"SELECT custkey, nullif(segment, 'MACHINERY') IS NOT NULL AS present FROM ({CUST})")
def q_exists_absent(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "customer")
    s = s.with_kind("customer", s.entities["customer"].withColumn("tier", F.nullif("segment", F.lit("MACHINERY"))))
    return projected(s, "customer", "custkey", present=exists("customer.tier"))


@query(f"SELECT custkey AS key, count(*) AS n FROM ({ORD}) GROUP BY custkey HAVING count(*) <> 10")
def q_cardinality_violations(spark: SparkSession, d: str) -> DataFrame:
    exactly = R.Cardinality("exactly", 10)
    groups = select(read(spark, d, "order"), sel("order", by="custkey", members=exactly), []).groups
    return groups.where(violates(exactly, F.col("__n"))).select(F.col("__key").alias("key"), F.col("__n").alias("n"))


# -- select and assign


def tiers(members: R.Cardinality = R.Cardinality(), least: int = 2) -> R.Rule:
    """Customers in BUILDING, by nation: a tier from their own balance and the nation's total and count."""
    tier = call("if", call("less", lit(0), field("customer.acctbal_cents")), lit("POSITIVE"), lit("DEBT"))
    items = (put("customer.tier", tier), put("customer.nation_total", over("sum", "customer.acctbal_cents")), put("customer.nation_count", count()))
    return R.Rule("tiers", R.SelectAndAssign(sel("customer", eq("customer.segment", "BUILDING"), "nationkey", members), items, call("not", call("less", count(), lit(least)))))


TIERS = f"""
    WITH c AS ({CUST}), g AS (SELECT nationkey, sum(cents)::BIGINT AS total, count(*) AS n FROM c WHERE segment = 'BUILDING' GROUP BY nationkey HAVING count(*) >= {{least}})
    SELECT custkey, c.nationkey, CASE WHEN n IS NULL THEN NULL WHEN cents > 0 THEN 'POSITIVE' ELSE 'DEBT' END AS tier, coalesce(total, -1) AS nation_total, coalesce(n, -1) AS nation_count
    FROM c LEFT JOIN g ON c.nationkey = g.nationkey AND segment = 'BUILDING'
"""


@query(TIERS.format(least=2))
def q_assign_reductions(spark: SparkSession, d: str) -> DataFrame:
    return accepted(execute(read(spark, d, "customer"), tiers())).entities["customer"].select("custkey", "nationkey", "tier", shown("nation_total"), shown("nation_count"))


@query(TIERS.format(least=12))
def q_assign_guard_skip(spark: SparkSession, d: str) -> DataFrame:
    return execute(read(spark, d, "customer"), tiers(least=12)).state.entities["customer"].select("custkey", "nationkey", "tier", shown("nation_total"), shown("nation_count"))


@query(f"WITH o AS ({ORD}) SELECT orderkey, CASE WHEN cents = max(cents) OVER w THEN 'TOP' WHEN cents = min(cents) OVER w THEN 'LOW' ELSE 'MID' END AS rank FROM o WINDOW w AS (PARTITION BY custkey)")
def q_assign_min_max(spark: SparkSession, d: str) -> DataFrame:
    cents = field("order.total_cents")
    value = call("if", call("equal", cents, over("max", "order.total_cents")), lit("TOP"), call("if", call("equal", cents, over("min", "order.total_cents")), lit("LOW"), lit("MID")))
    rule = R.Rule("rank", R.SelectAndAssign(sel("order", by="custkey"), (put("order.rank", value),)))
    return accepted(execute(read(spark, d, "order"), rule)).entities["order"].select("orderkey", "rank")


@query(f"SELECT orderkey, bool_and(quantity < 40) AS all_small, bool_or(quantity > 45) AS any_large, min(flag) = max(flag) AS same_flag, count(*) AS n, sum(cents)::BIGINT AS total, min(shipped) AS first_day FROM ({LINE}) GROUP BY orderkey")
def q_quantifiers(spark: SparkSession, d: str) -> DataFrame:
    quantity = field("lineitem.quantity")
    wanted = {
        "all_small": call("all_members", call("less", quantity, lit(40))), "any_large": call("any_members", call("less", lit(45), quantity)),
        "same_flag": over("all_equal", "lineitem.flag"), "n": count(), "total": over("sum", "lineitem.price_cents"), "first_day": over("min", "lineitem.shipped"),
    }
    s = select(read(spark, d, "lineitem"), sel("lineitem", by="orderkey"), list(wanted.values()))
    compiler = s.group_compiler()
    return s.groups.select(F.col("__key").alias("orderkey"), *[compiler.typed(e).col.alias(n) for n, e in wanted.items()])


# -- scalar functions


@query(f"""
    SELECT orderkey, linenumber, cents, cents + quantity AS added, cents - 5000000 AS subtracted, cents * quantity AS product,
           CASE WHEN quantity % 5 = 0 THEN -1 ELSE trunc((cents - 5000000)::DECIMAL(38,0) / (quantity % 5))::BIGINT END AS quotient,
           CASE WHEN quantity % 5 = 0 THEN -1 ELSE (cents - 5000000) % (quantity % 5) END AS rest,
           abs(cents - 5000000) AS size, least(greatest(quantity, 10), 20) AS clamped, coalesce(CASE WHEN quantity % 5 = 0 THEN NULL ELSE 100 // (quantity % 5) END, -1) AS or_else
    FROM ({LINE})
""")
def q_scalar_int(spark: SparkSession, d: str) -> DataFrame:
    q, c = field("lineitem.quantity"), field("lineitem.price_cents")
    low, five = call("subtract", c, lit(5000000)), call("modulo", q, lit(5))
    s = read(spark, d, "lineitem")
    out = projected(
        s, "lineitem", "orderkey", linenumber=field("lineitem.linenumber"), cents=c, added=call("add", c, q), subtracted=low, product=call("multiply", c, q),
        quotient=call("divide", low, five), rest=call("modulo", low, five), size=call("abs", low), clamped=call("clamp", q, lit(10), lit(20)),
        or_else=call("coalesce", call("divide", lit(100), five), lit(-1)),
    )
    return out.withColumns({"quotient": shown("quotient"), "rest": shown("rest")})


def sql_decimal(x: str) -> str:
    return f"regexp_replace(regexp_replace(({x})::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def sql_quotient(cents: str, by: int) -> str:
    """A positive amount in cents, divided as a decimal: cut 18 places behind the last digit of the amount that is not zero."""
    places = f"(CASE WHEN {cents} % 100 = 0 THEN 18 WHEN {cents} % 10 = 0 THEN 19 ELSE 20 END)"
    whole, rest = f"({cents} // {100 * by})", f"lpad((({cents} % {100 * by}) * 1000000000000000000::HUGEINT // {by})::VARCHAR, 20, '0')"
    return f"regexp_replace(regexp_replace({whole}::VARCHAR || '.' || left({rest}, {places}), '0+$', ''), '\\.$', '')"


@query(f"""
    WITH l AS (SELECT *, (cents / 100.0)::DECIMAL(12,2) AS price, (pct / 100.0)::DECIMAL(4,2) AS discount FROM ({LINE}))
    SELECT orderkey, linenumber, {sql_decimal("price * (1::DECIMAL(2,0) - discount)")} AS net, {sql_decimal("price + discount")} AS total, {sql_decimal("abs(discount - 0.05)")} AS off,
           discount < 0.05 AS small, {sql_decimal("least(greatest(discount, 0.02), 0.08)")} AS clamped,
           {sql_decimal("cents * 125000::HUGEINT")} AS eighth, {sql_quotient("cents", 7)} AS seventh
    FROM l
""")
def q_scalar_decimal(spark: SparkSession, d: str) -> DataFrame:
    price, disc, dec = field("lineitem.price"), field("lineitem.discount"), lambda x: lit(V.decimal(x))
    eighth = call("divide", call("multiply", price, dec("100000000")), dec("8"))
    return projected(
        read(spark, d, "lineitem"), "lineitem", "orderkey", linenumber=field("lineitem.linenumber"), net=call("multiply", price, call("subtract", dec("1"), disc)), total=call("add", price, disc),
        off=call("abs", call("subtract", disc, dec("0.05"))), small=call("less", disc, dec("0.05")), clamped=call("clamp", disc, dec("0.02"), dec("0.08")), eighth=eighth,
        seventh=call("divide", price, dec("7")),
    )


@query(f"""
    SELECT event_id, year(ts)::BIGINT AS y, month(ts)::BIGINT AS m, day(ts)::BIGINT AS d, hour(ts)::BIGINT AS h, minute(ts)::BIGINT AS mi, second(ts)::BIGINT AS s, isodow(ts)::BIGINT AS dow,
           epoch_us(ts) * 1000 + 5400000000000 AS later, trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00'))::DECIMAL(38,0) / 1000000)::BIGINT AS since
    FROM events
""")
def q_scalar_temporal(spark: SparkSession, d: str) -> DataFrame:
    at = field("event.at")
    units = {"y": "year", "m": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second", "dow": "day_of_week"}
    return projected(
        read(spark, d, "event"), "event", "event_id", **{n: extract(u, at) for n, u in units.items()},
        later=call("timestamp_add", at, lit(V.duration("90m"))), since=call("timestamp_diff", at, lit(V.timestamp("2024-01-15T12:00:00Z"))),
    )


@query(f"SELECT custkey, segment || ':' || name AS label, substr(name, 3, 6) AS part, segment AS trimmed, substr(segment, 100, 2) AS past FROM ({CUST})")
def q_scalar_string(spark: SparkSession, d: str) -> DataFrame:
    name, segment = field("customer.name"), field("customer.segment")
    return projected(
        read(spark, d, "customer"), "customer", "custkey", label=call("concat", segment, lit(":"), name), part=call("substring", name, lit(2), lit(6)),
        trimmed=call("trim", call("concat", lit("\t  "), segment, lit("\n"))), past=call("substring", segment, lit(99), lit(2)),
    )


@query(f"""
    SELECT custkey, CASE WHEN cents < 0 THEN 'debt' WHEN cents < 500000 THEN 'low' ELSE 'high' END AS band, NOT (segment = 'BUILDING') AS other,
           (segment = 'BUILDING' AND cents > 0) AS both_hold, (segment = 'BUILDING' OR cents > 0) AS one_holds, CASE WHEN cents % 2 = 0 THEN 'fault' ELSE (1 % (cents % 2) = 0)::VARCHAR END AS maybe
    FROM ({CUST})
""")
def q_scalar_conditional(spark: SparkSession, d: str) -> DataFrame:
    cents, building = field("customer.acctbal_cents"), eq("customer.segment", "BUILDING")
    band = call("if", call("less", cents, lit(0)), lit("debt"), call("if", call("less", cents, lit(500000)), lit("low"), lit("high")))
    positive = call("less", lit(0), cents)
    out = projected(
        read(spark, d, "customer"), "customer", "custkey", band=band, other=call("not", building), both_hold=call("all", building, positive), one_holds=call("any", building, positive),
        maybe=call("equal", call("modulo", lit(1), call("modulo", cents, lit(2))), lit(0)),
    )
    return out.withColumn("maybe", F.coalesce(F.col("maybe").cast("string"), F.lit("fault")))


# -- insert, delete


ACCOUNTS = R.Rule("accounts", R.InsertEntity(sel("order", by="custkey"), "account", lit("ACCOUNT"), (put("account.custkey", over("min", "order.custkey")), put("account.orders", count()), put("account.total_cents", over("sum", "order.total_cents")), put("account.largest_cents", over("max", "order.total_cents")))))


@query(f"SELECT {sql_synthetic_id('account', 'accounts', 'ids', chr(39) + 'ACCOUNT' + chr(39))} AS id, custkey, orders, total_cents, largest_cents FROM (SELECT custkey, list({OID}) AS ids, count(*) AS orders, sum(cents)::BIGINT AS total_cents, max(cents) AS largest_cents FROM ({ORD}) GROUP BY custkey)")
def q_insert_grouped(spark: SparkSession, d: str) -> DataFrame:
    return accepted(execute(read(spark, d, "order"), ACCOUNTS)).entities["account"].select("id", "custkey", "orders", "total_cents", "largest_cents")


@query(f"SELECT {sql_synthetic_id('leg', 'legs', f'[{OID}]', 'orderkey', 3)} AS id, 'whole' AS part, cents, custkey FROM ({ORD}) WHERE status = 'F'")
def q_insert_ungrouped(spark: SparkSession, d: str) -> DataFrame:
    items = (put("leg.part", lit("whole")), put("leg.cents", field("order.total_cents")), put("leg.custkey", field("order.custkey")))
    rule = R.Rule("legs", R.InsertEntity(sel("order", eq("order.status", "F")), "leg", field("order.orderkey"), items))
    return accepted(execute(read(spark, d, "order"), rule)).entities["leg"].select("id", "part", "cents", "custkey")


SMALL = R.Rule("small", R.DeleteEntity(sel("order", by="custkey"), call("less", over("sum", "order.total_cents"), lit(100_000_000))))


@query(f"SELECT orderkey, custkey FROM (SELECT *, sum(cents) OVER (PARTITION BY custkey) AS total FROM ({ORD})) WHERE NOT total < 100000000")
def q_delete(spark: SparkSession, d: str) -> DataFrame:
    return accepted(execute(read(spark, d, "order"), SMALL)).entities["order"].select("orderkey", "custkey")


def held(s: GraphState) -> GraphState:
    """Each customer holds its orders."""
    own = unsent(s.entities["customer"].select("custkey", F.col("id").alias("from_id"))).join(s.entities["order"].select("custkey", F.col("id").alias("to_id")), "custkey")
    return s.with_relations(own.select(F.lit("holds").alias("kind"), F.lit("customer").alias("from_kind"), "from_id", F.lit("order").alias("to_kind"), "to_id"))


@query("SELECT 'OP_DANGLING_RELATION' AS code, NULL::VARCHAR AS obligation")
def q_delete_dangling_rejected(spark: SparkSession, d: str) -> DataFrame:
    return code_row(execute(held(read(spark, d, "customer", "order")), SMALL))


# -- relate, unrelate


SERVE = R.RelateEntities("serves", sel("supplier", call("less", lit(0), field("supplier.acctbal_cents"))), sel("customer", eq("customer.segment", "BUILDING")), eq("supplier.nationkey", field("customer.nationkey")))
SERVED = f"SELECT {SID} AS from_id, {CID} AS to_id FROM ({SUPP}) s JOIN ({CUST}) c ON s.nationkey = c.nationkey WHERE s.cents > 0 AND c.segment = 'BUILDING'"


@query(SERVED)
def q_relate_equi(spark: SparkSession, d: str) -> DataFrame:
    return accepted(execute(read(spark, d, "supplier", "customer"), R.Rule("serve", SERVE))).relations.select("from_id", "to_id")


@query(f"SELECT {sql_source_id('nation', 'a.n_nationkey')} AS from_id, {sql_source_id('nation', 'b.n_nationkey')} AS to_id FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def q_relate_theta(spark: SparkSession, d: str) -> DataFrame:
    rule = R.Rule("peer", R.RelateEntities("peer", sel("nation"), sel("nation"), call("less", field("from.nationkey"), field("to.nationkey"))))
    return accepted(execute(read(spark, d, "nation"), rule)).relations.select("from_id", "to_id")


@query(f"WITH s AS (SELECT *, {SID} AS id FROM ({SUPP})) SELECT a.id AS from_id, b.id AS to_id FROM s a JOIN s b ON a.nationkey = b.nationkey AND b.cents < a.cents")
def q_relate_same_kind(spark: SparkSession, d: str) -> DataFrame:
    guard = call("all", eq("from.nationkey", field("to.nationkey")), call("less", field("to.acctbal_cents"), field("from.acctbal_cents")))
    rule = R.Rule("richer", R.RelateEntities("richer", sel("supplier"), sel("supplier"), guard))
    return execute(read(spark, d, "supplier"), rule).state.relations.select("from_id", "to_id")


@query(f"SELECT {SID} AS from_id, {CID} AS to_id FROM ({SUPP}) s JOIN ({CUST}) c ON s.nationkey = c.nationkey WHERE s.cents > 0 AND c.segment = 'BUILDING' AND NOT c.cents < 0")
def q_unrelate(spark: SparkSession, d: str) -> DataFrame:
    s = accepted(execute(read(spark, d, "supplier", "customer"), R.Rule("serve", SERVE)))
    debt = sel("customer", call("all", eq("customer.segment", "BUILDING"), call("less", field("customer.acctbal_cents"), lit(0))))
    return accepted(execute(s, R.Rule("drop", R.UnrelateEntities("serves", SERVE.from_selector, debt, SERVE.guard)))).relations.select("from_id", "to_id")


@query("SELECT 'OP_RELATION_NOT_FOUND' AS code, NULL::VARCHAR AS obligation")
def q_unrelate_missing_rejected(spark: SparkSession, d: str) -> DataFrame:
    s = accepted(execute(read(spark, d, "supplier", "customer"), R.Rule("serve", SERVE)))
    return code_row(execute(s, R.Rule("drop", R.UnrelateEntities("serves", SERVE.from_selector, sel("customer"), SERVE.guard))))


# -- merge, split


MERGED = R.MergeEntities(sel("customer", eq("customer.segment", "BUILDING"), "nationkey"), "customer", lit("NATION"), (put("customer.custkey", over("min", "customer.custkey")), put("customer.acctbal_cents", over("sum", "customer.acctbal_cents")), put("customer.nation_count", count())), reanchor_relations=True)


@query(f"""
    WITH c AS (SELECT *, {CID} AS id FROM ({CUST})), g AS (SELECT nationkey, {sql_synthetic_id('customer', 'merge', 'list(id)', chr(39) + 'NATION' + chr(39))} AS merged FROM c WHERE segment = 'BUILDING' GROUP BY nationkey),
         m AS (SELECT custkey, coalesce(merged, id) AS id FROM c LEFT JOIN g ON c.nationkey = g.nationkey AND segment = 'BUILDING')
    SELECT DISTINCT m.id AS from_id, {OID} AS to_id FROM m JOIN ({ORD}) o USING (custkey)
""")
def q_merge_reanchor(spark: SparkSession, d: str) -> DataFrame:
    return accepted(execute(held(read(spark, d, "customer", "order")), R.Rule("merge", MERGED))).relations.select("from_id", "to_id")


@query(f"""
    WITH c AS (SELECT *, {CID} AS id FROM ({CUST}))
    SELECT id, custkey, cents AS acctbal_cents, -1::BIGINT AS nation_count FROM c UNION ALL
    SELECT {sql_synthetic_id('customer', 'merge', 'list(id)', chr(39) + 'NATION' + chr(39))}, min(custkey), sum(cents)::BIGINT, count(*) FROM c WHERE segment = 'BUILDING' GROUP BY nationkey
""")
def q_merge_retain(spark: SparkSession, d: str) -> DataFrame:
    op = R.MergeEntities(MERGED.selector, "customer", MERGED.discriminator, MERGED.assignments, retain_sources=True)
    return accepted(execute(read(spark, d, "customer"), R.Rule("merge", op))).entities["customer"].select("id", "custkey", "acctbal_cents", shown("nation_count"))


def split(retain: bool) -> R.Rule:
    half = call("divide", field("order.total_cents"), lit(2))
    part = lambda n, v: R.Partition(lit(n), (put("leg.part", lit(n)), put("leg.cents", v), put("leg.custkey", field("order.custkey"))))
    return R.Rule("split", R.SplitEntity(sel("order", eq("order.status", "O")), "leg", (part("A", half), part("B", call("subtract", field("order.total_cents"), half))), retain_source=retain))


LEGS = f"""
    SELECT {sql_synthetic_id('leg', 'split', f'[{OID}]', chr(39) + 'A' + chr(39))} AS id, 'A' AS part, cents // 2 AS cents, custkey FROM ({ORD}) WHERE status = 'O' UNION ALL
    SELECT {sql_synthetic_id('leg', 'split', f'[{OID}]', chr(39) + 'B' + chr(39))}, 'B', cents - cents // 2, custkey FROM ({ORD}) WHERE status = 'O'
"""


@query(LEGS)
def q_split_two(spark: SparkSession, d: str) -> DataFrame:
    return accepted(execute(read(spark, d, "order"), split(False))).entities["leg"].select("id", "part", "cents", "custkey")


@query(f"SELECT count(*) AS orders, count(*) FILTER (status = 'O') * 2 AS legs FROM ({ORD})")
def q_split_retain(spark: SparkSession, d: str) -> DataFrame:
    s = accepted(execute(read(spark, d, "order"), split(True)))
    return s.entities["order"].agg(F.count("*").alias("orders")).join(s.entities["leg"].agg(F.count("*").alias("legs")))


# -- patches, diffs


@query(f"""
    WITH t AS ({TIERS.format(least=2)}) SELECT 3 AS rank, 'update' AS op, 'customer' AS kind, {CID} AS id, '{{}}' AS before,
        '{{"tier":"' || tier || '","nation_total":' || nation_total || ',"nation_count":' || nation_count || '}}' AS after FROM t WHERE nation_count >= 0
""")
def q_patch_log(spark: SparkSession, d: str) -> DataFrame:
    return execute(read(spark, d, "customer"), tiers()).changes


@query("SELECT 0 AS differences, count(*) AS n FROM customer")
def q_undo_identity(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "customer")
    out = execute(s, tiers())
    back = undo_changes(out.state, out.changes).state
    return diff_states(s, back).agg(F.count("*").cast("int").alias("differences")).join(back.entities["customer"].agg(F.count("*").alias("n")))


@query(f"""
    WITH t AS ({TIERS.format(least=2)}) SELECT 'modified' AS change, 'customer' AS kind, {CID} AS id, unnest(['tier', 'nation_total', 'nation_count']) AS field FROM t WHERE nation_count >= 0
""")
def q_diff(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "customer")
    return diff_states(s, accepted(execute(s, tiers())))


@query(f"""
    WITH m AS (SELECT count(*) AS gone, count(DISTINCT nationkey) AS made FROM ({CUST}) WHERE segment = 'BUILDING'), c AS (SELECT count(*) AS n FROM customer), o AS (SELECT count(*) AS n FROM orders),
         r AS (SELECT count(*) AS moved FROM ({CUST}) c JOIN ({ORD}) o USING (custkey) WHERE segment = 'BUILDING')
    SELECT 'entities_before' AS metric, c.n + o.n AS n FROM c, o UNION ALL SELECT 'entities_after', c.n + o.n - gone + made FROM c, o, m UNION ALL SELECT 'created', made FROM m UNION ALL SELECT 'deleted', gone FROM m UNION ALL
    SELECT 'modified', 0 UNION ALL SELECT 'relation_added', moved FROM r UNION ALL SELECT 'relation_removed', moved FROM r
""")
def q_diff_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = held(read(spark, d, "customer", "order"))
    return diff_metrics(s, accepted(execute(s, R.Rule("merge", MERGED))))


# -- profiles, corpora, gate


READY = R.Profile("ready", "customer", (R.Requirement("customer.name", "NAME"), R.Requirement("customer.tier", "TIER")))


@query(f"WITH t AS ({TIERS.format(least=2)}) SELECT {CID} AS id, 'NAME' AS code, true AS satisfied FROM t UNION ALL SELECT {CID}, 'TIER', tier IS NOT NULL FROM t")
def q_profile_assess(spark: SparkSession, d: str) -> DataFrame:
    return profiles.assess(accepted(execute(read(spark, d, "customer"), tiers())), READY)


@query(f"WITH t AS ({TIERS.format(least=2)}) SELECT 'ready' AS profile, 'customer' AS kind, count(*) AS n_entities, count(*) FILTER (tier IS NULL) AS n_missing, CASE WHEN count(*) FILTER (tier IS NULL) = 0 THEN 'ready' ELSE 'needs_input' END AS verdict FROM t")
def q_profile_verdict(spark: SparkSession, d: str) -> DataFrame:
    return profiles.verdicts(accepted(execute(read(spark, d, "customer"), tiers())), READY)


def case_results(spark: SparkSession, d: str, least: int, status: str) -> DataFrame:
    """Verdicts per nation: a nation is a case, and is ready if none of its BUILDING customers lacks a tier."""
    rows = execute(read(spark, d, "customer"), tiers(least=least)).state.entities["customer"].where("segment = 'BUILDING'")
    out = rows.groupBy("nationkey").agg(F.count_if(F.col("tier").isNull()).alias("missing"))
    return out.select(F.col("nationkey").cast("string").alias("case_id"), F.lit(status).alias("status"), F.lit("tiered").alias("checkpoint"), F.lit("ready").alias("profile"), F.when(F.col("missing") == 0, "ready").otherwise("needs_input").alias("verdict"))


CASES = f"SELECT nationkey::VARCHAR AS case_id, CASE WHEN count(*) >= 2 THEN 'ready' ELSE 'needs_input' END AS base_verdict, CASE WHEN count(*) >= 12 THEN 'ready' ELSE 'needs_input' END AS cand_verdict FROM ({CUST}) WHERE segment = 'BUILDING' GROUP BY nationkey"


@query(f"SELECT case_id, 'tiered' AS base_checkpoint, 'tiered' AS cand_checkpoint, base_verdict, cand_verdict, NULL::VARCHAR AS base_missing, NULL::VARCHAR AS cand_missing FROM ({CASES})")
def q_corpus_compare(spark: SparkSession, d: str) -> DataFrame:
    return corpus.compare(case_results(spark, d, 2, "succeeded"), case_results(spark, d, 12, "succeeded"), corpus.Policy((("tiered", "tiered"),), "ready"))


@query(f"""
    SELECT count(*) AS n_cases, 0::BIGINT AS n_incomplete, count(*) FILTER (base_verdict = 'ready' AND cand_verdict = 'needs_input') AS n_fell, count(*) FILTER (base_verdict = 'ready') AS base_ready,
           count(*) FILTER (cand_verdict = 'ready') AS cand_ready, count(*) FILTER (base_verdict = 'ready' AND cand_verdict = 'needs_input') = 0 AS no_regression FROM ({CASES})
""")
def q_gate_regression(spark: SparkSession, d: str) -> DataFrame:
    return corpus.regression(q_corpus_compare(spark, d))


@query("SELECT status, CASE WHEN status = 'succeeded' THEN (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_mktsegment = 'BUILDING') ELSE 0 END AS n_cases FROM (SELECT unnest(['pending', 'running', 'succeeded', 'failed', 'unattempted']) AS status)")
def q_corpus_progress(spark: SparkSession, d: str) -> DataFrame:
    return corpus.progress(case_results(spark, d, 2, "succeeded"))


# -- whole plans


FLAGSHIP = """
rule tier_customers {
  select customer where customer.segment == "BUILDING" group_by customer.nationkey having count() >= 2
  set customer.tier = if(customer.acctbal_cents > 0, "POSITIVE", "DEBT"), customer.nation_total = sum(customer.acctbal_cents), customer.nation_count = count();
}
checkpoint tiered after tier_customers;
rule accounts {
  insert account { select order group_by order.custkey having count() >= 5; discriminator: "ACCOUNT"; }
  set account.custkey = min(order.custkey), account.orders = count(), account.total_cents = sum(order.total_cents), account.largest_cents = max(order.total_cents);
}
rule serve (depends_on: ["tier_customers"]) {
  relate supplier to customer as serves {
    from: select supplier where supplier.acctbal_cents > 0;
    to: select customer where exists(customer.tier) && customer.tier == "POSITIVE";
    guard: supplier.nationkey == customer.nationkey;
  };
}
rule own (depends_on: ["accounts"]) {
  relate account to order as owns {
    from: select account;
    to: select order where order.status == "F";
    guard: account.custkey == order.custkey;
  };
}
checkpoint related after serve;
profile ready for entity customer { require customer.name present as NAME; }
"""


def flagship_run(spark: SparkSession, d: str, persist: bool = True):
    from .dsl.parser import Source

    source: Source = parse(FLAGSHIP)
    plan = compile_rules(retail.SCHEMA, source.ruleset).plan
    return run_plan(plan, read(spark, d, "customer", "order", "supplier"), persist=persist)


@query(f"""
    WITH c AS ({CUST}), g AS (SELECT nationkey, count(*) AS n FROM c WHERE segment = 'BUILDING' GROUP BY nationkey HAVING count(*) >= 2), a AS (SELECT custkey FROM ({ORD}) GROUP BY custkey HAVING count(*) >= 5)
    SELECT 'serves' AS kind, {SID} AS from_id, {CID} AS to_id FROM ({SUPP}) s JOIN c ON s.nationkey = c.nationkey JOIN g ON g.nationkey = c.nationkey WHERE s.cents > 0 AND c.segment = 'BUILDING' AND c.cents > 0
    UNION ALL
    SELECT 'owns', {sql_synthetic_id('account', 'accounts', 'ids', chr(39) + 'ACCOUNT' + chr(39))}, o.id
    FROM (SELECT custkey, list({OID}) AS ids FROM ({ORD}) GROUP BY custkey HAVING count(*) >= 5) a JOIN (SELECT custkey, status, {OID} AS id FROM ({ORD})) o ON a.custkey = o.custkey WHERE o.status = 'F'
""")
def q_pipeline_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Four rules from rule text: assignment, insertion and two relations, with checkpoints."""
    run = flagship_run(spark, d)
    if run.failure:
        raise RuntimeError(f"{run.failure.rule}: {run.failure.code}")
    return run.state.relations.select("kind", "from_id", "to_id")


@query("SELECT * FROM (VALUES (0, 'accounts', true), (1, 'own', true), (2, 'tier_customers', true), (3, 'serve', true)) t(sequence, rule, accepted)")
def q_journal(spark: SparkSession, d: str) -> DataFrame:
    return flagship_run(spark, d, persist=False).journal_frame().select("sequence", "rule", "accepted")


@query("""
    SELECT * FROM (VALUES ('selector_fault', 'SELECTION_EXPRESSION_UNAVAILABLE'), ('cardinality', 'SELECTION_CARDINALITY_INVALID'), ('empty', 'SELECTION_EMPTY'), ('value_fault', 'SELECTION_EXPRESSION_UNAVAILABLE'),
        ('guard', 'SELECTION_GUARD_UNSATISFIED'), ('collision', 'OP_ENTITY_IDENTITY_COLLISION'), ('already_related', 'OP_RELATION_ALREADY_PRESENT'), ('not_related', 'OP_RELATION_NOT_FOUND'), ('dangling', 'OP_DANGLING_RELATION')) t(what, code)
""")
def q_status_codes(spark: SparkSession, d: str) -> DataFrame:
    """A rejection of each sort, on the nations."""
    s = read(spark, d, "nation")
    on = lambda selector, value=lit("x"), guard=None: R.SelectAndAssign(selector, (put("nation.name", value),), guard or eq(lit(1), 1))
    by = lambda where=None, members=R.Cardinality(): sel("nation", where, "regionkey", members)
    zero = call("divide", field("nation.nationkey"), lit(0))
    loops = R.RelateEntities("peer", sel("nation"), sel("nation"), eq("from.nationkey", field("to.nationkey")))
    peers = execute(s, R.Rule("peer", loops)).state
    made = R.InsertEntity(sel("nation"), "region", lit("R"), (put("region.regionkey", field("nation.regionkey")), put("region.name", lit("n"))))
    once = execute(s, R.Rule("made", made)).state
    outs = {
        "selector_fault": execute(s, R.Rule("r", on(by(eq(zero, 1))))), "cardinality": execute(s, R.Rule("r", on(by(members=R.Cardinality("exactly", 1))))), "empty": execute(s, R.Rule("r", on(by(eq("nation.nationkey", -1))))),
        "value_fault": execute(s, R.Rule("r", on(by(), call("if", eq(zero, 1), lit("a"), lit("b"))))), "guard": execute(s, R.Rule("r", on(by(), guard=call("less", count(), lit(0))))),
        "collision": execute(once, R.Rule("made", made)), "already_related": execute(peers, R.Rule("peer", loops)),
        "not_related": execute(s, R.Rule("peer", R.UnrelateEntities("peer", loops.from_selector, loops.to_selector, loops.guard))), "dangling": execute(peers, R.Rule("d", R.DeleteEntity(sel("nation")))),
    }
    return spark.createDataFrame([(k, o.code) for k, o in outs.items()], "what string, code string")


@query("""
    SELECT * FROM (VALUES ('insert_twice', 'OP_ENTITY_IDENTITY_COLLISION'), ('update_absent', 'OP_UPDATE_TARGET_NOT_FOUND'), ('delete_absent', 'OP_DELETE_TARGET_NOT_FOUND'), ('update_stale', 'OP_BEFORE_IMAGE_MISMATCH'),
        ('delete_stale', 'OP_BEFORE_IMAGE_MISMATCH'), ('relate_twice', 'OP_RELATION_ALREADY_PRESENT'), ('relate_nobody', 'OP_RELATION_ENDPOINT_MISSING'), ('unrelate_absent', 'OP_RELATION_NOT_FOUND'), ('delete_related', 'OP_DANGLING_RELATION')) t(what, code)
""")
def q_apply_codes(spark: SparkSession, d: str) -> DataFrame:
    """A change set of each sort that does not apply, with all eight operation codes."""
    s = read(spark, d, "nation")
    there, nobody = s.entities["nation"], F.lit("sha256:" + "0" * 64)
    image = {c: F.col(c) for c in there.columns if c != "id"}
    stale = image | {"name": F.lit("another")}
    absent = there.withColumn("id", nobody).limit(1)
    edges = there.select(F.lit("peer").alias("kind"), F.lit("nation").alias("from_kind"), F.col("id").alias("from_id"), F.lit("nation").alias("to_kind"), F.col("id").alias("to_id"))
    peers = s.with_relations(edges)
    change = lambda op, rows, before, after: changes_of(op, "nation", rows, before, after)
    found = {
        "insert_twice": (s, change("insert", there, {}, image)), "update_absent": (s, change("update", absent, image, stale)), "delete_absent": (s, change("delete", absent, image, {})),
        "update_stale": (s, change("update", there, stale, image)), "delete_stale": (s, change("delete", there, stale, {})), "relate_twice": (peers, relation_changes("relate", edges)),
        "relate_nobody": (s, relation_changes("relate", edges.withColumn("to_id", nobody))), "unrelate_absent": (s, relation_changes("unrelate", edges)), "delete_related": (peers, change("delete", there, image, {})),
    }
    return spark.createDataFrame([(k, apply_changes(state, rows).code) for k, (state, rows) in found.items()], "what string, code string")


@query("""
    SELECT * FROM (VALUES ('absent', 'not_executed'), ('running', 'not_answered'), ('waiting', 'unattempted'), ('stopped', 'checkpoint_not_sealed'), ('sealed', 'not_assessed'), ('whole', NULL)) t(case_id, cand_missing)
""")
def q_corpus_missing(spark: SparkSession, d: str) -> DataFrame:
    """Runs of small corpora through ``run_corpus``, and each reason why a candidate's evidence is missing."""
    start = read(spark, d, "customer")
    rules = parse(FLAGSHIP).ruleset.rules[:1]
    plan = lambda *profiles: compile_rules(retail.SCHEMA, R.Ruleset(rules, (R.Checkpoint("tiered", rules[0].id),), profiles)).plan
    ready = R.Profile("ready", "customer", (R.Requirement("customer.name", "NAME"),))
    names = ("absent", "running", "waiting", "stopped", "sealed", "whole")
    run = lambda p, state, *of: corpus.run_corpus(p, dict.fromkeys(of, state), persist=False)
    base = corpus.results_frame(spark, dict.fromkeys(names, run(plan(ready), start, "whole")["whole"]))
    nobody = start.with_kind("customer", start.entities["customer"].limit(0))
    done = run(plan(ready), start, "whole") | run(plan(), start, "sealed") | run(plan(ready), nobody, "stopped") | {"waiting": None}
    candidate = corpus.results_frame(spark, done).unionByName(spark.createDataFrame([("running", "running", None, None, None)], corpus.RESULT))
    return corpus.compare(base, candidate, corpus.Policy((("tiered", "tiered"),), "ready")).where("base_missing is null").select("case_id", "cand_missing")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_assign_reductions(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "RELATION_TYPE", "Schema", "flagship"]
