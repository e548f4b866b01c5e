"""Plans as text: one SQL statement with a common table expression per step, or the files of a model project.

The SQL is Spark's. It follows the operators here, faults as NULL and strict ``all``/``any`` included; what it
cannot do is reject: cardinality, empty selections and unsatisfied guards leave a step without effect, so
run a plan with ``runner`` where rejections matter. Decimals must have declared digits or stay unread.
"""

from __future__ import annotations

from .. import rules as R
from .. import values as V
from ..expr import Expr
from ..functions import identity
from ..schema import RELATION_COLUMNS, EntityKind
from .compiler import Plan

ARITHMETIC = {"add": "try_add", "subtract": "try_subtract", "multiply": "try_multiply"}
SQL_TYPES = {V.INT64: "bigint", V.TIMESTAMP: "bigint", V.DURATION: "bigint", V.DATE: "date"}


def text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(s: str) -> str:
    return "`" + s.replace("`", "``") + "`"


class Emitter:
    """Expressions in the scope of one entity alias; group reductions are columns r0, r1, … of the alias g."""

    def __init__(self, plan: Plan, aliases: dict[str, str], reductions: dict[Expr, str] | None = None):
        self.plan, self.aliases, self.reductions = plan, aliases, reductions or {}

    def kind(self, e: Expr) -> str | None:
        """The value kind of an operand, as far as arithmetic needs it."""
        if e.kind == "literal":
            return e.value.kind
        if e.path and e.kind != "exists":
            return self.plan.schema.kind_of(f"{self.aliases.get(e.path.partition('.')[0] + '/kind', e.path.partition('.')[0])}.{e.path.partition('.')[2]}")
        if e.kind in ("timestamp_add",):
            return V.TIMESTAMP
        if e.kind in ("timestamp_diff",):
            return V.DURATION
        return next((k for a in reversed(e.args) if (k := self.kind(a))), None)

    def sql(self, e: Expr) -> str:
        if e in self.reductions:
            return f"g.{self.reductions[e]}"
        k, a = e.kind, [self.sql(x) for x in e.args]
        if k == "literal":
            v = e.value
            if v.kind in (V.STRING, V.ATOM):
                return text(v.data)
            return f"date{text(v.text())}" if v.kind == V.DATE else f"{v.text()}BD" if v.kind == V.DECIMAL else f"{v.data}L"
        if k in ("field", "exists"):
            head, _, field = e.path.partition(".")
            col = f"{self.aliases[head]}.{name(field)}"
            return col if k == "field" else f"({col} IS NOT NULL)"
        if k == "not":
            return f"(NOT {a[0]})"
        if k in ("all", "any"):
            out = a[-1]
            for x in reversed(a[:-1]):
                out = f"CASE WHEN {x} IS NULL THEN NULL WHEN {'NOT ' if k == 'all' else ''}{x} THEN {'false' if k == 'all' else 'true'} ELSE {out} END"
            return f"({out})"
        if k in ("equal", "less"):
            return f"({a[0]} {'=' if k == 'equal' else '<'} {a[1]})"
        if k == "if":
            return f"(CASE WHEN {a[0]} IS NULL THEN NULL WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"
        if k == "coalesce":
            return f"coalesce({', '.join(a)})"
        if k == "clamp":
            return f"(CASE WHEN {a[0]} IS NULL OR {a[1]} IS NULL OR {a[2]} IS NULL OR {a[1]} > {a[2]} THEN NULL WHEN {a[0]} < {a[1]} THEN {a[1]} WHEN {a[0]} > {a[2]} THEN {a[2]} ELSE {a[0]} END)"
        if k == "concat":
            return f"concat({', '.join(a)})"
        if k == "trim":
            return f"regexp_replace({a[0]}, '(?U)^\\\\s+|\\\\s+$', '')"
        if k == "substring":
            return f"(CASE WHEN {a[1]} >= 0 AND {a[2]} >= 0 THEN substring({a[0]}, cast(least({a[1]}, 2147483645L) AS int) + 1, cast(least({a[2]}, 2147483646L) AS int)) END)"
        if k == "divide" and V.DECIMAL in [self.kind(x) for x in e.args]:
            # Cut after 18 places, as whole and rest; exact for operands of up to 18 digits.
            whole, rest = f"({a[0]} div nullif({a[1]}, 0BD))", f"((({a[0]} % nullif({a[1]}, 0BD)) * 1000000000000000000BD) div {a[1]})"
            return f"(cast({whole} AS decimal(37,18)) + cast(cast({rest} AS decimal(19,0)) * 0.000000000000000001BD AS decimal(37,18)))"
        if k in ("divide", "modulo"):
            safe = f"CASE WHEN NOT ({a[0]} = {V.INT_MIN + 1}L - 1L AND {a[1]} = -1L) THEN {a[0]} END"
            return f"(({safe}) {'div' if k == 'divide' else '%'} nullif({a[1]}, 0L))"
        if k == "abs":
            return f"abs(CASE WHEN {a[0]} > {V.INT_MIN + 1}L - 1L THEN {a[0]} END)"
        if k == "date_extract":
            return self.extract(e, a[0])
        kinds = [self.kind(x) for x in e.args]
        if k == "timestamp_diff" or (k == "subtract" and kinds == [V.TIMESTAMP, V.TIMESTAMP]):
            return f"((cast({a[0]} AS decimal(20,0)) - cast({a[1]} AS decimal(20,0))) div 1000000000BD)"
        if V.TIMESTAMP in kinds:
            at, by = (a[0], a[1]) if kinds[0] == V.TIMESTAMP else (a[1], a[0])
            return f"try_cast(cast({at} AS decimal(38,0)) {'-' if k == 'subtract' else '+'} cast({by} AS decimal(20,0)) * 1000000000BD AS bigint)"
        if V.DECIMAL in kinds:
            return f"({a[0]} {dict(add='+', subtract='-', multiply='*')[k]} {a[1]})"
        return f"{ARITHMETIC[k]}({a[0]}, {a[1]})"

    def extract(self, e: Expr, x: str) -> str:
        stamp = self.kind(e.args[0]) == V.TIMESTAMP
        second = f"({x} div 1000000000L - CASE WHEN {x} % 1000000000L < 0 THEN 1 ELSE 0 END)"
        day = f"date_add(date'1970-01-01', cast(({second} - pmod({second}, 86400L)) div 86400L AS int))" if stamp else x
        part = {"year": f"year({day})", "month": f"month({day})", "day": f"day({day})", "day_of_week": f"weekday({day}) + 1", "hour": f"pmod({second}, 86400L) div 3600L", "minute": f"pmod({second}, 3600L) div 60L", "second": f"pmod({second}, 60L)"}[e.unit]
        return f"cast({part} AS bigint)"

    def reduction(self, e: Expr) -> str:
        """An aggregate over the members of a group, which are ordered by id."""
        if e.kind == "count":
            return "count(*)"
        if e.kind in ("all_members", "any_members"):
            p, want = self.sql(e.args[0]), "true" if e.kind == "all_members" else "false"
            return f"CASE WHEN count_if(NOT ({p} <=> {want})) = 0 THEN {want} ELSE min_by({p}, CASE WHEN NOT ({p} <=> {want}) THEN s.id END) END"
        head, _, field = e.path.partition(".")
        col = f"{self.aliases[head]}.{name(field)}"
        if e.kind == "all_equal":
            return f"CASE WHEN min_by({col}, s.id) IS NULL OR (count({col}) < count(*) AND min({col}) = max({col})) THEN NULL ELSE min({col}) = max({col}) END"
        body = f"try_sum({col})" if e.kind == "sum" else f"{e.kind}({col})"
        return f"CASE WHEN count({col}) = count(*) THEN {body} END"


def encoded(s: str) -> str:
    return f"unhex(lpad(hex(octet_length({s})), 16, '0')), encode({s}, 'utf-8')"


def synthetic(lineage: str, kind: str, rule: str, ids: str, value: str, value_kind: str) -> str:
    head = identity.text(identity.tag("synthetic-entity")) + identity.raw_digest(lineage) + identity.text(kind) + identity.text(rule)
    body = f"unhex(lpad(hex({value}), 16, '0'))" if value_kind == V.INT64 else encoded(value)
    sorted_ids = f"array_sort(transform({ids}, i -> substring(i, 8, 64)))"
    return f"concat('sha256:', sha2(concat(unhex('{head.hex()}'), unhex(lpad(hex(size({ids})), 16, '0')), unhex(array_join({sorted_ids}, '')), unhex('{V.KIND_BYTES[value_kind]:02x}'), {body}), 256))"


def staged_columns(plan: Plan) -> dict[str, list[str]]:
    """The columns of each kind's staging table that a plan reads, and those of "relations"."""
    return {e.name: [name(c) for c in ("id", *(f.name for f in e.fields))] for e in plan.schema.entities} | {"relations": list(RELATION_COLUMNS)}


def active(table: str, columns: list[str]) -> str:
    """Withdrawn rows stay in the staging tables with is_active false; only active ones are read."""
    return f"SELECT {', '.join(columns)} FROM {table} WHERE is_active"


class Pipeline:
    """Steps in plan order; ``current`` names the relation that holds each kind (and "relations") after the last step."""

    def __init__(self, plan: Plan, lineage: str, ref=lambda step: step, source=lambda table, columns: f"({active(table, columns)})"):
        self.plan, self.lineage, self.ref = plan, lineage, ref
        self.steps: list[tuple[str, str]] = []
        self.current = {kind: source(f"raw_{'entities_' * (kind != 'relations')}{kind}", columns) for kind, columns in staged_columns(plan).items()}
        self.at_checkpoint: dict[str, dict[str, str]] = {}
        for i, c in enumerate(plan.rules, 1):
            self.rule(i, c.rule)
            for k in plan.checkpoints:
                if k.after == c.rule.id:
                    self.at_checkpoint[k.key] = dict(self.current)

    def step(self, label: str, kind: str | None, sql: str) -> str:
        self.steps.append((label, sql))
        if kind:
            self.current[kind] = self.ref(label)
        return self.ref(label)

    def groups(self, label: str, s: R.Selector, guard: Expr, exprs: list[Expr], with_ids: bool) -> tuple[str, Emitter]:
        """A step of the qualifying groups (key, reductions, ids), and the emitter for what reads it."""
        from ..expr import REDUCTIONS

        found = list(dict.fromkeys(e for x in [guard, *exprs] for e in x.walk() if e.kind in REDUCTIONS))
        names = {e: f"r{i}" for i, e in enumerate(found)}
        member = Emitter(self.plan, {s.kind: "s"})
        key = member.sql(s.group_by) if s.group_by is not None else "s.id"
        where = f" WHERE {member.sql(s.where)}" if s.where is not None else ""
        columns = [f"{key} AS k", *(f"{member.reduction(e)} AS {n}" for e, n in names.items()), *(["collect_list(s.id) AS ids"] if with_ids else [])]
        both = Emitter(self.plan, {s.kind: "s"}, names)
        inner = f"SELECT {', '.join(columns)} FROM {self.current[s.kind]} s{where} GROUP BY {key}"
        step = self.step(f"{label}_groups", None, f"SELECT g.* FROM ({inner}) g WHERE {both.sql(guard)}")
        return step, both

    def members(self, s: R.Selector, groups: str) -> str:
        member = Emitter(self.plan, {s.kind: "s"})
        key = member.sql(s.group_by) if s.group_by is not None else "s.id"
        where = f" WHERE {member.sql(s.where)}" if s.where is not None else ""
        return f"{self.current[s.kind]} s JOIN {groups} g ON {key} = g.k{where}"

    @staticmethod
    def row(kind: EntityKind, new_id: str, items: dict[str, str]) -> str:
        return ", ".join([f"{new_id} AS id", *(f"cast({items.get(f.name, 'NULL')} AS {f.spark_type().simpleString()}) AS {name(f.name)}" for f in kind.fields)])

    @staticmethod
    def columns(kind: EntityKind, alias: str) -> str:
        return ", ".join([f"{alias}.id", *(f"{alias}.{name(f.name)}" for f in kind.fields)])

    def rule(self, i: int, rule: R.Rule) -> None:
        op, label = rule.operation, f"tx_{i:02d}_{rule.id}"
        entity = self.plan.schema.entity
        if isinstance(op, R.RelateEntities):
            return self.relation(op, label)
        s = op.selector
        if isinstance(op, R.SelectAndAssign):
            groups, both = self.groups(label, s, op.guard, [a.value for a in op.assignments], False)
            kind = entity(s.kind)
            items = {a.path.partition(".")[2]: both.sql(a.value) for a in op.assignments}
            changed = self.step(f"{label}_new", None, f"SELECT {self.row(kind, 's.id', {f.name: items.get(f.name, 's.' + name(f.name)) for f in kind.fields})} FROM {self.members(s, groups)}")
            self.step(f"{label}_{s.kind}", s.kind, f"SELECT {self.columns(kind, 's')} FROM {self.current[s.kind]} s LEFT ANTI JOIN {changed} c ON s.id = c.id UNION ALL SELECT {self.columns(kind, 'c')} FROM {changed} c")
            return None
        if isinstance(op, R.DeleteEntity):
            groups, _ = self.groups(label, s, op.guard, [], False)
            gone = self.step(f"{label}_gone", None, f"SELECT s.id FROM {self.members(s, groups)}")
            self.remove(label, s.kind, gone)
            return None
        target = entity(op.target_kind)
        parts = op.partitions if isinstance(op, R.SplitEntity) else [R.Partition(op.discriminator, op.assignments)]
        per_member = isinstance(op, R.SplitEntity) or (isinstance(op, R.InsertEntity) and s.group_by is None)
        groups, both = self.groups(label, s, op.guard, [x for p in parts for x in (p.discriminator, *(a.value for a in p.assignments))], True)
        source = self.members(s, groups) if per_member else f"{groups} g"
        made = []
        for p in parts:
            new_id = synthetic(self.lineage, target.name, rule.id, "array(s.id)" if per_member else "g.ids", both.sql(p.discriminator), both.kind(p.discriminator) or V.STRING)
            made.append(f"SELECT {self.row(target, new_id, {a.path.partition('.')[2]: both.sql(a.value) for a in p.assignments})}{', g.ids AS ids' if isinstance(op, R.MergeEntities) else ''} FROM {source}")
        fresh = self.step(f"{label}_new", None, " UNION ALL ".join(made))
        if isinstance(op, R.MergeEntities) and not op.retain_sources:
            moved = self.step(f"{label}_moved", None, f"SELECT explode(n.ids) AS id, n.id AS new FROM {fresh} n")
            old = self.current["relations"]
            self.remove(label, s.kind, moved, relations=True)
            if op.reanchor_relations:
                self.reanchor(label, s.kind, target.name, moved, old)
        elif isinstance(op, R.SplitEntity) and not op.retain_source:
            gone = self.step(f"{label}_gone", None, f"SELECT s.id FROM {self.members(s, groups)}")
            self.remove(label, s.kind, gone, relations=True)
        self.step(f"{label}_{target.name}", target.name, f"SELECT {self.columns(target, 's')} FROM {self.current[target.name]} s UNION ALL SELECT {self.columns(target, 'n')} FROM {fresh} n")
        return None

    def remove(self, label: str, kind: str, gone: str, relations: bool = False) -> None:
        own = self.plan.schema.entity(kind)
        if relations:
            at = lambda end: f"r.{end}_kind = {text(kind)} AND r.{end}_id IN (SELECT id FROM {gone})"
            self.step(f"{label}_left", "relations", f"SELECT r.* FROM {self.current['relations']} r WHERE NOT coalesce(({at('from')}) OR ({at('to')}), false)")
        self.step(f"{label}_kept_{kind}", kind, f"SELECT {self.columns(own, 's')} FROM {self.current[kind]} s LEFT ANTI JOIN {gone} d ON s.id = d.id")

    def reanchor(self, label: str, kind: str, target: str, moved: str, old: str) -> None:
        end = lambda e, m: f"CASE WHEN {m}.new IS NULL THEN r.{e}_kind ELSE {text(target)} END AS {e}_kind, coalesce({m}.new, r.{e}_id) AS {e}_id"
        on = lambda e, m: f"LEFT JOIN {moved} {m} ON r.{e}_kind = {text(kind)} AND r.{e}_id = {m}.id"
        fits = " OR ".join(f"(kind = {text(x.name)} AND from_kind = {text(x.from_kind)} AND to_kind = {text(x.to_kind)})" for x in self.plan.schema.relations) or "false"
        inner = f"SELECT r.kind, {end('from', 'a')}, {end('to', 'b')} FROM {old} r {on('from', 'a')} {on('to', 'b')} WHERE a.new IS NOT NULL OR b.new IS NOT NULL"
        self.step(f"{label}_reanchored", "relations", f"SELECT {', '.join(RELATION_COLUMNS)} FROM {self.current['relations']} UNION ALL SELECT DISTINCT {', '.join(RELATION_COLUMNS)} FROM ({inner}) WHERE ({fits}) AND NOT (from_kind = to_kind AND from_id = to_id)")

    def relation(self, op: R.RelateEntities, label: str) -> None:
        declared = self.plan.schema.relation(op.relation_kind)
        a, b = op.from_selector, op.to_selector
        aliases = {"from": "f", "to": "t", "from/kind": a.kind, "to/kind": b.kind} | ({a.kind: "f", b.kind: "t"} if a.kind != b.kind else {})
        pair = Emitter(self.plan, aliases)
        side = lambda s: f"(SELECT s.* FROM {self.current[s.kind]} s{' WHERE ' + Emitter(self.plan, {s.kind: 's'}).sql(s.where) if s.where is not None else ''})"
        # As a join condition, plain AND lets an equality become a hash join; only true pairs are kept, so it means the same here.
        parts = op.guard.args if op.guard.kind == "all" else (op.guard,)
        on = " AND ".join(pair.sql(p) for p in parts)
        edges = f"SELECT {text(declared.name)} AS kind, {text(a.kind)} AS from_kind, f.id AS from_id, {text(b.kind)} AS to_kind, t.id AS to_id FROM {side(a)} f JOIN {side(b)} t ON {on}"
        step = self.step(f"{label}_edges", None, edges)
        own = self.current["relations"]
        columns = ", ".join(f"r.{c}" for c in RELATION_COLUMNS)
        if isinstance(op, R.UnrelateEntities):
            self.step(f"{label}_relations", "relations", f"SELECT {columns} FROM {own} r LEFT ANTI JOIN {step} e ON {' AND '.join(f'r.{c} = e.{c}' for c in RELATION_COLUMNS)}")
        else:
            self.step(f"{label}_relations", "relations", f"SELECT {columns} FROM {own} r UNION ALL SELECT {', '.join(f'e.{c}' for c in RELATION_COLUMNS)} FROM {step} e")


def plan_sql(plan: Plan, lineage: str, result: str) -> str:
    """One statement over the staging tables that selects a kind, or "relations", after the plan."""
    p = Pipeline(plan, lineage, ref=name)
    ctes = ",\n".join(f"{name(label)} AS (\n  {sql}\n)" for label, sql in p.steps)
    return (f"WITH {ctes}\n" if ctes else "") + f"SELECT * FROM {p.current[result]}"


def project_files(plan: Plan, lineage: str, project: str = "quillgraph_plan") -> dict[str, str]:
    """A model project: path -> text. A model for each step, staging views of the sources, and models of each checkpoint."""
    ref = lambda model: "{{ ref('" + model + "') }}"
    p = Pipeline(plan, lineage, ref=ref, source=lambda t, _: ref(f"stg_{t}"))
    files = {"dbt_project.yml": f"name: {project}\nversion: '1.0'\nprofile: {project}\nmodel-paths: [models]\nmodels:\n  {project}:\n    staging: {{+materialized: view}}\n    transformations: {{+materialized: table}}\n    checkpoints: {{+materialized: table}}\n"}
    tables = [f"raw_entities_{e.name}" for e in plan.schema.entities] + ["raw_relations"]
    files["models/staging/sources.yml"] = "version: 2\nsources:\n  - name: quillgraph\n    tables:\n" + "".join(f"      - name: {t}\n" for t in tables)
    for t, columns in zip(tables, staged_columns(plan).values(), strict=True):
        files[f"models/staging/stg_{t}.sql"] = active(f"{{{{ source('quillgraph', '{t}') }}}}", columns) + "\n"
    for label, sql in p.steps:
        files[f"models/transformations/{label}.sql"] = sql + "\n"
    for key, current in p.at_checkpoint.items():
        for kind, model in current.items():
            files[f"models/checkpoints/chk_{key}_{kind}.sql"] = f"SELECT * FROM {model}\n"
    return files
