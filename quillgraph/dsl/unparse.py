"""From declarations to canonical rule text, which reads back as the same declarations."""

from __future__ import annotations

from .. import rules as R
from .. import values as V
from ..expr import TRUE, Expr
from .parser import Source

SIGNS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "modulo": "%"}
TYPE_NAMES = {V.STRING: "string", V.INT64: "int64", V.DECIMAL: "decimal", V.TIMESTAMP: "timestamp", V.DATE: "date", V.DURATION: "duration", V.ATOM: "atom"}


def quoted(s: str) -> str:
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        s = s.replace(raw, code)
    return f'"{s}"'


def unparse_expr(e: Expr) -> str:
    k, args = e.kind, [unparse_expr(a) for a in e.args]
    if k == "literal":
        return literal(e.value)
    if k == "field":
        return e.path
    if k in ("exists", "all_equal", "sum", "min", "max"):
        return f"{k}({e.path})"
    if k == "count":
        return "count()"
    if e == TRUE:
        return "true"
    if k == "not":
        inner = e.args[0]
        if inner.kind == "equal" and inner != TRUE:
            return f"({unparse_expr(inner.args[0])} != {unparse_expr(inner.args[1])})"
        if inner.kind == "less":
            return f"({unparse_expr(inner.args[0])} >= {unparse_expr(inner.args[1])})"
        return f"!({args[0]})"
    if k in ("equal", "less"):
        return f"({args[0]} {'==' if k == 'equal' else '<'} {args[1]})"
    if k in SIGNS:
        return f"({args[0]} {SIGNS[k]} {args[1]})"
    if k in ("all", "any") and len(args) == 2:
        return f"({args[0]} {'&&' if k == 'all' else '||'} {args[1]})"
    if k == "date_extract":
        return f"extract({e.unit}, {args[0]})"
    return f"{k.removesuffix('_members')}({', '.join(args)})"


def literal(v: V.Value) -> str:
    if v.kind == V.STRING:
        return quoted(v.data)
    if v.kind == V.INT64:
        return str(v.data)
    if v.kind == V.DECIMAL:
        text = v.text()
        return text if "." in text else f"{text}d"
    return {V.ATOM: "atom", V.TIMESTAMP: "ts", V.DATE: "date", V.DURATION: "dur"}[v.kind] + f"({quoted(v.text())})"


def selector(s: R.Selector, having: Expr | None = None) -> str:
    out = f"select {s.kind}"
    if s.where is not None:
        out += f" where {unparse_expr(s.where)}"
    if s.group_by is not None:
        out += f" group_by {unparse_expr(s.group_by)}"
    if having is not None and having != TRUE:
        out += f" having {unparse_expr(having)}"
    return out


def sets(items: tuple[R.Assignment, ...]) -> str:
    return " set " + ", ".join(f"{a.path} = {unparse_expr(a.value)}" for a in items) if items else ""


def operation(op: R.Operation) -> str:
    if isinstance(op, R.SelectAndAssign):
        return f"{selector(op.selector, op.guard)}{sets(op.assignments)};"
    if isinstance(op, R.InsertEntity):
        return f"insert {op.target_kind} {{ {selector(op.selector, op.guard)}; discriminator: {unparse_expr(op.discriminator)}; }}{sets(op.assignments)};"
    if isinstance(op, R.DeleteEntity):
        return f"delete {op.selector.kind} {{ {selector(op.selector, op.guard)}; }};"
    if isinstance(op, R.RelateEntities):
        word, joint = ("unrelate", "from") if isinstance(op, R.UnrelateEntities) else ("relate", "to")
        guard = "" if op.guard == TRUE else f" guard: {unparse_expr(op.guard)};"
        return f"{word} {op.from_selector.kind} {joint} {op.to_selector.kind} as {op.relation_kind} {{ from: {selector(op.from_selector)}; to: {selector(op.to_selector)};{guard} }};"
    if isinstance(op, R.MergeEntities):
        flags = "".join(f" {k}: true;" for k in ("reanchor_relations", "retain_sources") if getattr(op, k))
        return f"merge {op.selector.kind} into {op.target_kind} {{ {selector(op.selector, op.guard)}; discriminator: {unparse_expr(op.discriminator)};{flags} }}{sets(op.assignments)};"
    parts = " ".join(f'partition "{i}" {{ discriminator: {unparse_expr(p.discriminator)};{sets(p.assignments)}; }}' for i, p in enumerate(op.partitions))
    return f"split {op.selector.kind} into {op.target_kind} {{ {selector(op.selector, op.guard)};{' retain_source: true;' if op.retain_source else ''} {parts} }};"


def unparse(source: Source) -> str:
    out = ["schema {"]
    for e in source.schema.entities:
        out.append(f"  entity {e.name} {{")
        out += [f"    {f.name}: {TYPE_NAMES[f.kind]}{'' if f.required else ' optional'};" for f in e.fields]
        out.append("  }")
    for r in source.schema.relations:
        out += [f"  relation {r.name} {{", f"    from: {r.from_kind};", f"    to: {r.to_kind};", "  }"]
    out.append("}")
    names = lambda xs: "[" + ", ".join(quoted(x) for x in xs) + "]"
    for r in source.ruleset.rules:
        opts = [f"{k}: {names(v)}" for k, v in (("reads", r.reads), ("writes", r.writes), ("depends_on", r.after or None)) if v is not None]
        out += ["", f"rule {r.id}{' (' + ', '.join(opts) + ')' if opts else ''} {{", f"  {operation(r.operation)}", "}"]
    out += [f"\ncheckpoint {c.key} after {c.after};" for c in source.ruleset.checkpoints]
    for p in source.ruleset.profiles:
        out += ["", f"profile {p.key} for entity {p.kind}{' (implies: ' + names(p.implies) + ')' if p.implies else ''} {{"]
        out += [f"  require {r.path} present as {r.code};" for r in p.requirements]
        out.append("}")
    return "\n".join(out) + "\n"
