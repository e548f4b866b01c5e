"""The seven operators. Each is one atomic rule: it gives a new state and its changes, or a rejection.

A rule takes one status query (a row of counts per check, the only thing that reaches the
driver), then hands on lazy DataFrames. Assignments read the state before the rule. Checks
come in a fixed order: selector faults, cardinality, emptiness, faults of guard or
values, a guard that holds nowhere, and then the integrity of the changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .. import values as V
from ..expr import Expr
from ..functions import identity
from ..functions.columns import Compiler, every, kind_fields, stored
from ..pairs import PAIRS_A_TASK, Pairs, unsent
from ..schema import RELATION_COLUMNS, EntityKind, SchemaError
from ..state import GraphState, dangling
from .patch import CHANGE_COLUMNS, changes_of, relation_changes
from .selector import Selection, select, selection_counts, violates


@dataclass(frozen=True)
class Outcome:
    """``code`` is None if the rule was accepted; a rejected rule leaves the state as it was."""

    state: GraphState
    code: str | None = None
    obligation: str | None = None
    changes: DataFrame | None = None
    counts: dict[str, int] | None = None
    #: The kind whose new table already reads from a written one.
    stored: str | None = None

    @property
    def accepted(self) -> bool:
        return self.code is None


Store = Callable[[DataFrame], DataFrame]


def execute(state: GraphState, rule: R.Rule, domain: str = identity.NAMESPACE, store: Store | None = None) -> Outcome:
    """Applies a rule to a state. store: writes a table and reads it back, for assignments that a checkpoint follows, and for insertions, which later rules would compute again."""
    if isinstance(rule.operation, R.SelectAndAssign):
        return select_and_assign(state, rule, domain, False, store) or select_and_assign(state, rule, domain, True, store)
    run = {
        R.InsertEntity: insert_entity, R.DeleteEntity: delete_entity, R.RelateEntities: relate_entities,
        R.UnrelateEntities: relate_entities, R.MergeEntities: merge_entities, R.SplitEntity: split_entity,
    }[type(rule.operation)]
    kept = (store,) if run is insert_entity else ()
    out = run(state, rule, domain, False, *kept)
    return run(state, rule, domain, True, *kept) if out is None else out


def counted(*parts: DataFrame) -> dict[str, int]:
    """Sums (name, n) rows in one query."""
    every_part = parts[0]
    for p in parts[1:]:
        every_part = every_part.unionByName(p)
    return {r["name"]: r["n"] or 0 for r in every_part.groupBy("name").agg(F.sum("n").alias("n")).collect()}


def one(df: DataFrame, **columns: Column) -> DataFrame:
    """Aggregates as (name, n) rows."""
    return df.agg(*[c.cast("bigint").alias(k) for k, c in columns.items()]).unpivot([], list(columns), "name", "n")


def selector_verdict(n: dict[str, int]) -> str | None:
    """The first obligation that the selection breaks."""
    if n["where_fault"] or n["key_fault"]:
        return "01-selector-evaluable"
    if n["cardinality"]:
        return "02-cardinality"
    return None if n["groups"] else "03-selection-nonempty"


def verdict(n: dict[str, int]) -> str | None:
    if found := selector_verdict(n):
        return found
    if n["guard_fault"] or n.get("value_fault"):
        return "04-evaluable"
    return None if n["passed"] else "05-guard"


def rejected(state: GraphState, obligation: str, n: dict[str, int]) -> Outcome:
    return Outcome(state, R.OBLIGATIONS[obligation], obligation, counts=n)


def refused(state: GraphState, code: str, n: dict[str, int]) -> Outcome:
    return Outcome(state, code, counts=n)


def with_groups(s: Selection) -> DataFrame:
    """The chosen rows, each with its group's columns."""
    return s.groups if s.selector.group_by is None else s.chosen.join(s.groups, "__key")


def guard_counts(groups: DataFrame) -> DataFrame:
    return one(groups, guard_fault=F.count_if(F.col("__guard").isNull()), passed=F.count_if("__guard"))


def fault_count(rows: DataFrame, names: list[str]) -> DataFrame:
    any_null = F.lit(False)
    for n in names:
        any_null = any_null | F.col(n).isNull()
    return one(rows, value_fault=F.count_if(any_null))


def select_and_assign(state: GraphState, rule: R.Rule, domain: str, exact: bool, store: Store | None = None) -> Outcome | None:
    """One table holds every row of the kind with its flags and new values; the status is a count over it, the new state a projection of it.

    With ``store`` it is written first, so that status and state read it instead of computing it twice.
    """
    op: R.SelectAndAssign = rule.operation
    if op.selector.group_by is None:
        raise SchemaError(f"{rule.id}: select-and-assign needs group_by")
    s = select(state, op.selector, [op.guard, *(a.value for a in op.assignments)], exact)
    compiler, kind = s.group_compiler(), state.schema.entity(op.selector.kind)
    columns = ["id", *(f.name for f in kind.fields)]
    names = [a.path.partition(".")[2] for a in op.assignments]
    value_of = {name: f"__v{i}" for i, name in enumerate(names)}
    rows = s.chosen.join(s.groups.withColumn("__guard", compiler.bool(op.guard)), "__key")
    for name, a in zip(names, op.assignments, strict=True):
        rows = rows.withColumn(value_of[name], stored(compiler.typed(a.value), kind.field(name)))
    rows = rows.select(*[F.col(f"`{c}`") for c in columns], F.lit(True).alias("__sel"), F.lit(False).alias("__fault"), violates(op.selector.members, F.col("__n")).alias("__bad"), "__unsure", "__guard", *value_of.values())
    no = F.lit(False)
    blank = [no.alias("__bad"), no.alias("__unsure"), no.alias("__guard"), *[F.lit(None).cast(kind.field(n).spark_type()).alias(v) for n, v in value_of.items()]]
    keep = [F.col(f"`{c}`") for c in columns]
    others = s.rows.where(~F.coalesce("__where", no)).select(*keep, no.alias("__sel"), F.col("__where").isNull().alias("__fault"), *blank)
    keyless = s.chosen.where(F.col("__key").isNull()).select(*keep, F.lit(True).alias("__sel"), F.lit(True).alias("__fault"), *blank)
    full = rows.unionByName(others).unionByName(keyless)
    if store:
        full = store(full)
    any_null = F.lit(False)
    for v in value_of.values():
        any_null = any_null | F.col(v).isNull()
    n = full.agg(
        F.count_if("__fault").alias("where_fault"), F.count_if("__bad").alias("cardinality"), F.count_if("__sel").alias("groups"), F.count_if("__unsure").alias("unsure"),
        F.count_if(F.col("__guard").isNull()).alias("guard_fault"), F.count_if("__guard").alias("passed"), F.count_if(F.coalesce("__guard", no) & any_null).alias("value_fault"),
    ).first().asDict() | {"key_fault": 0}
    if n["unsure"] and not exact:
        return None
    if bad := verdict(n):
        return rejected(state, bad, n)
    after = full.select(*[F.when(F.col("__guard"), F.col(value_of[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in value_of else F.col(f"`{c}`") for c in columns])
    changes = changes_of("update", kind.name, full.where("__guard"), {c: F.col(f"`{c}`") for c in names}, {c: F.col(v) for c, v in value_of.items()})
    return Outcome(state.with_kind(kind.name, after), changes=changes, counts=n, stored=kind.name if store else None)


def new_fields(target: EntityKind, assignments: tuple[R.Assignment, ...], rule: str) -> dict[str, R.Assignment]:
    """The assigned fields of a new entity. A required field without a value is a mistake of the rule, not a rejection."""
    found = {a.path.partition(".")[2]: a for a in assignments}
    if missing := [f.name for f in target.fields if f.required and f.name not in found]:
        raise SchemaError(f"{rule}: {target.name} needs {', '.join(missing)}")
    return found


def created(rows: DataFrame, lineage: str, target: EntityKind, rule: str, ids: Column, discriminator: Expr, fields: dict[str, R.Assignment], compiler: Compiler, domain: str) -> DataFrame:
    """Adds __new (the synthetic id) and __f_<field>; a fault in either is NULL."""
    key = compiler.typed(discriminator)
    rows = rows.withColumn("__new", F.when(key.col.isNotNull(), identity.synthetic_id_column(lineage, target.name, rule, ids, key, domain)))
    for name, a in fields.items():
        rows = rows.withColumn(f"__f_{name}", stored(compiler.typed(a.value), target.field(name)))
    return rows


def as_entities(rows: DataFrame, target: EntityKind, fields: dict[str, R.Assignment]) -> DataFrame:
    return rows.select(F.col("__new").alias("id"), *[(F.col(f"`__f_{f.name}`") if f.name in fields else F.lit(None)).cast(f.spark_type()).alias(f.name) for f in target.fields])


def collisions(fresh: DataFrame, there: DataFrame) -> DataFrame:
    """New ids that are equal to each other or to one that is there."""
    twice = one(fresh.groupBy("id").count().where("count > 1"), collision=F.count(F.lit(1)))
    return twice.unionByName(one(fresh.join(unsent(there.select("id")), "id", "left_semi"), collision=F.count(F.lit(1))))


def all_fields(target: EntityKind) -> dict[str, Column]:
    return {f.name: F.col(f"`{f.name}`") for f in target.fields}


def insert_entity(state: GraphState, rule: R.Rule, domain: str, exact: bool, store: Store | None = None) -> Outcome | None:
    op: R.InsertEntity = rule.operation
    target = state.schema.entity(op.target_kind)
    fields = new_fields(target, op.assignments, rule.id)
    values = [op.discriminator, *(a.value for a in op.assignments)]
    s = select(state, op.selector, [op.guard, *values], exact, [F.collect_list("id").alias("__ids")])
    groups = s.groups.withColumn("__guard", s.group_compiler().bool(op.guard))
    rows = created(groups.where("__guard"), state.lineage, target, rule.id, F.col("__ids"), op.discriminator, fields, s.group_compiler(), domain)
    fresh = as_entities(rows, target, fields)
    n = counted(selection_counts(s), guard_counts(groups), fault_count(rows, ["__new", *(f"`__f_{f}`" for f in fields)]), collisions(fresh.where("id is not null"), state.entities[target.name]))
    if n["unsure"] and not exact:
        return None
    if bad := verdict(n):
        return rejected(state, bad, n)
    if n["collision"]:
        return refused(state, R.COLLISION, n)
    fresh = store(fresh) if store else fresh
    after = state.with_kind(target.name, state.entities[target.name].unionByName(fresh))
    return Outcome(after, changes=changes_of("insert", target.name, fresh, {}, all_fields(target)), counts=n)


def delete_entity(state: GraphState, rule: R.Rule, domain: str, exact: bool) -> Outcome | None:
    op: R.DeleteEntity = rule.operation
    kind = state.schema.entity(op.selector.kind)
    s = select(state, op.selector, [op.guard], exact)
    s.groups = s.groups.withColumn("__guard", s.group_compiler().bool(op.guard))
    gone = with_groups(s).where("__guard").select("id", *[f"`{f.name}`" for f in kind.fields])
    n = counted(selection_counts(s), guard_counts(s.groups), one(touching(state, kind.name, gone), dangling=F.count(F.lit(1))))
    if n["unsure"] and not exact:
        return None
    if bad := verdict(n):
        return rejected(state, bad, n)
    if n["dangling"]:
        return refused(state, R.DANGLING, n)
    ids = unsent(gone.select("id"), n["passed"] if op.selector.group_by is None else None)
    after = state.with_kind(kind.name, state.entities[kind.name].join(ids, "id", "left_anti"))
    return Outcome(after, changes=changes_of("delete", kind.name, gone, all_fields(kind), {}), counts=n)


def ended(relations: DataFrame, kind: str, ids: DataFrame, n: int | None = None) -> DataFrame:
    """The relations with __from and __to: what ``ids`` (of ``n`` entities of a kind) holds as ``new`` for that end, NULL if the end is not among them."""
    for end in ("from", "to"):
        there = ids.select(F.col("id").alias(f"__{end}_id"), F.col("new").alias(f"__{end}"))
        relations = relations.join(unsent(there, n), (F.col(f"{end}_kind") == kind) & (F.col(f"{end}_id") == F.col(f"__{end}_id")), "left").drop(f"__{end}_id")
    return relations


def touching(state: GraphState, kind: str, ids: DataFrame) -> DataFrame:
    """Relations with an end among ``ids`` of a kind."""
    return ended(state.relations, kind, ids.select("id", F.lit("").alias("new"))).where(F.coalesce("__from", "__to").isNotNull()).select(*RELATION_COLUMNS)


def pair_side(state: GraphState, selector: R.Selector, side: str) -> tuple[Selection, DataFrame]:
    """A side's selection, and its rows with all columns under a prefix."""
    s = select(state, selector, [])
    rows = s.chosen.drop("__key")
    return s, rows.select(*[F.col(f"`{c}`").alias(f"{side}_{c}") for c in rows.columns])


def pair_compiler(state: GraphState, from_kind: str, to_kind: str, tag: str = "") -> Compiler:
    a, b = (kind_fields({f.name: f for f in state.schema.entity(k).fields}, lambda n, p=p: f"{p}_{n}{tag}") for k, p in ((from_kind, "from"), (to_kind, "to")))

    def find(path: str):
        head = path.partition(".")[0]
        if head in ("from", "to"):
            return (a if head == "from" else b)(path)
        if from_kind == to_kind:
            raise SchemaError(f"{path}: both ends are {head}")
        return (a if head == from_kind else b)(path)

    return Compiler(find)


def side_of(path: str, from_kind: str) -> str:
    """The end that a path reads."""
    head = path.partition(".")[0]
    return "from" if head in ("from", from_kind) and head != "to" else "to"


def sides(e: Expr, from_kind: str, to_kind: str) -> set[str]:
    """Which ends an expression reads."""
    return {side_of(p, from_kind) for p in e.paths()}


def equi_prefix(guard: Expr, from_kind: str, to_kind: str) -> tuple[list[tuple[Expr, Expr]], list[Expr]]:
    """The leading conjuncts of a guard that equate one end with the other, as (from, to), and the rest.

    Only leading ones become join keys: behind another conjunct, an equality may fault without anyone asking.
    """
    parts: list[Expr] = []

    def flatten(e: Expr) -> None:
        for x in e.args if e.kind == "all" else [e]:
            flatten(x) if x.kind == "all" else parts.append(x)

    flatten(guard)
    keys: list[tuple[Expr, Expr]] = []
    while parts and parts[0].kind == "equal":
        a, b = parts[0].args
        sa, sb = sides(a, from_kind, to_kind), sides(b, from_kind, to_kind)
        if (sa, sb) == ({"from"}, {"to"}):
            keys.append((a, b))
        elif (sa, sb) == ({"to"}, {"from"}):
            keys.append((b, a))
        else:
            break
        parts.pop(0)
    return keys, parts


def relate_entities(state: GraphState, rule: R.Rule, domain: str, exact: bool) -> Outcome | None:
    """Relates (or unrelates) the pairs of two selections for which the guard holds.

    Leading equalities between the ends join them, and the pairs stay two sides (see ``Pairs``) until
    someone reads them; if nothing follows the equalities, the status needs no pair. Only a guard
    without one compares all pairs, which is what it asks for.
    """
    op: R.RelateEntities = rule.operation
    undo = isinstance(op, R.UnrelateEntities)
    declared = state.schema.relation(op.relation_kind)
    kinds = (op.from_selector.kind, op.to_selector.kind)
    (fs, left), (ts, right) = pair_side(state, op.from_selector, "from"), pair_side(state, op.to_selector, "to")
    first = counted(
        selection_counts(fs).withColumn("name", F.concat(F.lit("from_"), "name")), selection_counts(ts).withColumn("name", F.concat(F.lit("to_"), "name")),
        *[one(x, **{f"{end}_rows": F.count(F.lit(1))}) for x, end, s in ((left, "from", fs), (right, "to", ts)) if s.selector.group_by],
    )
    ends = [{k.removeprefix(p): v for k, v in first.items() if k.startswith(p)} for p in ("from_", "to_")]
    for end in ends:  # both ends' faults and cardinality come before emptiness
        if (bad := selector_verdict(end)) and bad != "03-selection-nonempty":
            return rejected(state, bad, first)
    if not all(end["groups"] for end in ends):
        return rejected(state, "03-selection-nonempty", first)

    compiler = pair_compiler(state, *kinds)
    keys, rest = equi_prefix(op.guard, *kinds)
    names = [(f"__a{i}", f"__b{i}") for i in range(len(keys))]
    for (a, b), (x, y) in zip(keys, names, strict=True):
        s, t = compiler.typed(a), compiler.typed(b)
        left, right = left.withColumn(x, s.text() if s.kind == V.DECIMAL else s.col), right.withColumn(y, t.text() if t.kind == V.DECIMAL else t.col)
    read = {(side_of(p, kinds[0]), p.partition(".")[2]) for e in rest for p in e.paths()}
    left, right = (d.select(f"{end}_id", *ks, *[f"`{end}_{f}`" for e, f in sorted(read) if e == end]) for d, end, ks in ((left, "from", [a for a, _ in names]), (right, "to", [b for _, b in names])))
    holds = lambda tag="": every([pair_compiler(state, *kinds, tag).bool(e) for e in rest]) if rest else None
    sizes = tuple(end.get("rows", end["groups"]) for end in ends)
    pairs = Pairs(declared, left, right, tuple(names), holds(), sizes, sizes[0] * sizes[1])
    if names and rest and pairs.n > PAIRS_A_TASK:
        pairs = replace(pairs, n=pairs.key_count().first()["n"])
    checks = [pairs.counted("passed", "guard_fault")]
    for i, (a, b) in enumerate(names):  # a pair whose earlier keys agree faults where this key is absent
        before = [F.col(x) == F.col(y) for x, y in names[:i]]
        for x, y, name, ys in ((left, right, a, names[:i]), (right, left, b, [n[::-1] for n in names[:i]])):
            bad = x.where(F.col(name).isNull())
            bad = bad.join(y.select(*[n for _, n in ys]), before, "left_semi") if before else bad
            checks.append(one(bad, guard_fault=F.count(F.lit(1))))
    listed = state.listed.where(F.col("kind") == declared.name)
    hits = hit_by(listed, pairs)
    checks.append(one(hits, related=F.count(F.lit(1))))
    tag = f"__{uuid.uuid4().hex}"
    other = pairs.tagged(tag, holds(tag))
    own = [p for p in state.pairs if p.kind == declared]
    n = first | {"guard_fault": 0} | counted(*checks, *[p.shared(other, tag).counted("related") for p in own])
    if n["guard_fault"]:
        return rejected(state, "04-evaluable", n)
    if not n["passed"]:
        return rejected(state, "05-guard", n)
    if not undo and n["related"]:
        return refused(state, R.ALREADY_RELATED, n)
    if undo and n["related"] < n["passed"]:
        return refused(state, R.NOT_RELATED, n)
    if not rest:
        pairs = replace(pairs, n=n["passed"])
    changes = relation_changes("unrelate" if undo else "relate", pairs.rows())
    if not undo:
        return Outcome(state.with_pairs(state.listed, (*state.pairs, pairs)), changes=changes, counts=n)
    stay = state.listed.join(unsent(hits), list(RELATION_COLUMNS), "left_anti")
    return Outcome(state.with_pairs(stay, tuple(p.without(other, tag) if p.kind == declared else p for p in state.pairs)), changes=changes, counts=n)


def hit_by(relations: DataFrame, pairs: Pairs) -> DataFrame:
    """Those of the relations that are among the pairs."""
    out = relations.select(*[F.col(c).alias(f"__r_{c}") for c in RELATION_COLUMNS])
    out = out.join(unsent(pairs.left, pairs.sizes[0]), F.col("__r_from_id") == F.col("from_id")).join(unsent(pairs.right, pairs.sizes[1]), F.col("__r_to_id") == F.col("to_id"))
    for a, b in pairs.keys:
        out = out.where(F.col(a) == F.col(b))
    return (out if pairs.holds is None else out.where(pairs.holds)).select(*[F.col(f"__r_{c}").alias(c) for c in RELATION_COLUMNS]).distinct()


def removed_with_relations(state: GraphState, kind: str, gone: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The relations that stay when entities go, and those that go with them with __from and __to (see ``ended``)."""
    marked = ended(state.relations, kind, gone, n)
    end = F.coalesce("__from", "__to")
    return marked.where(end.isNull()).select(*RELATION_COLUMNS), marked.where(end.isNotNull())


def merge_entities(state: GraphState, rule: R.Rule, domain: str, exact: bool) -> Outcome | None:
    op: R.MergeEntities = rule.operation
    kind, target = state.schema.entity(op.selector.kind), state.schema.entity(op.target_kind)
    fields = new_fields(target, op.assignments, rule.id)
    s = select(state, op.selector, [op.guard, op.discriminator, *(a.value for a in op.assignments)], exact, [F.collect_list("id").alias("__ids")])
    s.groups = s.groups.withColumn("__guard", s.group_compiler().bool(op.guard))
    rows = created(s.groups.where("__guard"), state.lineage, target, rule.id, F.col("__ids"), op.discriminator, fields, s.group_compiler(), domain)
    fresh = as_entities(rows, target, fields)
    members = one(s.groups.where("__guard"), members=F.coalesce(F.sum("__n"), F.lit(0)))
    n = counted(selection_counts(s), guard_counts(s.groups), members, fault_count(rows, ["__new", *(f"`__f_{f}`" for f in fields)]), collisions(fresh.where("id is not null"), state.entities[target.name]))
    if n["unsure"] and not exact:
        return None
    if bad := verdict(n):
        return rejected(state, bad, n)
    if n["collision"]:
        return refused(state, R.COLLISION, n)
    changes = changes_of("insert", target.name, fresh, {}, all_fields(target))
    if op.retain_sources:
        return Outcome(state.with_kind(target.name, state.entities[target.name].unionByName(fresh)), changes=changes, counts=n)
    moved = rows.select(F.explode("__ids").alias("id"), F.col("__new").alias("new"))
    ids = unsent(moved.select("id"), n["members"])
    gone = state.entities[kind.name].join(ids, "id", "left_semi")
    keep, lost = removed_with_relations(state, kind.name, moved, n["members"])
    changes = changes.unionByName(relation_changes("unrelate", lost)).unionByName(changes_of("delete", kind.name, gone, all_fields(kind), {}))
    if op.reanchor_relations:
        again = reanchored(state, lost, target.name)
        keep = keep.unionByName(again)
        changes = changes.unionByName(relation_changes("relate", again))
    after = state.with_kind(kind.name, state.entities[kind.name].join(ids, "id", "left_anti")).with_relations(keep)
    after = after.with_kind(target.name, after.entities[target.name].unionByName(fresh))
    return Outcome(after, changes=changes, counts=n)


def reanchored(state: GraphState, lost: DataFrame, target: str) -> DataFrame:
    """Lost relations at their merged ends, where the declared kinds fit; loops are dropped and duplicates collapse."""
    out = lost
    for end in ("from", "to"):
        out = out.withColumns({f"{end}_kind": F.when(F.col(f"__{end}").isNotNull(), F.lit(target)).otherwise(F.col(f"{end}_kind")), f"{end}_id": F.coalesce(f"__{end}", f"{end}_id")})
    fits = F.lit(False)
    for r in state.schema.relations:
        fits = fits | ((F.col("kind") == r.name) & (F.col("from_kind") == r.from_kind) & (F.col("to_kind") == r.to_kind))
    loop = (F.col("from_kind") == F.col("to_kind")) & (F.col("from_id") == F.col("to_id"))
    return out.where(fits & ~loop).select(*RELATION_COLUMNS).distinct()


def split_entity(state: GraphState, rule: R.Rule, domain: str, exact: bool) -> Outcome | None:
    op: R.SplitEntity = rule.operation
    kind, target = state.schema.entity(op.selector.kind), state.schema.entity(op.target_kind)
    s = select(state, op.selector, [op.guard], exact)
    s.groups = s.groups.withColumn("__guard", s.group_compiler().bool(op.guard))
    sources = with_groups(s).where("__guard")
    children, fresh = [], []
    for p in op.partitions:
        fields = new_fields(target, p.assignments, rule.id)
        made = created(sources, state.lineage, target, rule.id, F.array("id"), p.discriminator, fields, s.member, domain)
        children.append((F.col("__new").isNull(), [F.col(f"`__f_{f}`").isNull() for f in fields], made))
        fresh.append(as_entities(made, target, fields))
    new = fresh[0]
    for f in fresh[1:]:
        new = new.unionByName(f)
    faults = []
    for no_id, nulls, made in children:
        bad = no_id
        for x in nulls:
            bad = bad | x
        faults.append(one(made, value_fault=F.count_if(bad)))
    n = counted(selection_counts(s), guard_counts(s.groups), *faults, collisions(new.where("id is not null"), state.entities[target.name]))
    if n["unsure"] and not exact:
        return None
    if bad := verdict(n):
        return rejected(state, bad, n)
    if n["collision"]:
        return refused(state, R.COLLISION, n)
    changes = changes_of("insert", target.name, new, {}, all_fields(target))
    if op.retain_source:
        return Outcome(state.with_kind(target.name, state.entities[target.name].unionByName(new)), changes=changes, counts=n)
    gone = sources.select("id", *[f"`{f.name}`" for f in kind.fields])
    keep, lost = removed_with_relations(state, kind.name, gone.select("id", F.lit("").alias("new")), n["passed"] if op.selector.group_by is None else None)
    changes = changes.unionByName(relation_changes("unrelate", lost)).unionByName(changes_of("delete", kind.name, gone, all_fields(kind), {}))
    after = state.with_kind(kind.name, state.entities[kind.name].join(unsent(gone.select("id"), n["passed"] if op.selector.group_by is None else None), "id", "left_anti")).with_relations(keep)
    after = after.with_kind(target.name, after.entities[target.name].unionByName(new))
    return Outcome(after, changes=changes, counts=n)


__all__ = ["CHANGE_COLUMNS", "Outcome", "dangling", "execute"]
