"""Declarations: selectors, the seven operations, rules, checkpoints and completeness profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from .expr import TRUE, Expr

#: The closed vocabularies of codes.
CARDINALITY_INVALID, SELECTION_EMPTY = "SELECTION_CARDINALITY_INVALID", "SELECTION_EMPTY"
GUARD_UNSATISFIED, EXPRESSION_UNAVAILABLE = "SELECTION_GUARD_UNSATISFIED", "SELECTION_EXPRESSION_UNAVAILABLE"
OBLIGATIONS = {"01-selector-evaluable": EXPRESSION_UNAVAILABLE, "02-cardinality": CARDINALITY_INVALID, "03-selection-nonempty": SELECTION_EMPTY, "04-evaluable": EXPRESSION_UNAVAILABLE, "05-guard": GUARD_UNSATISFIED}
OPERATION_CODES = ("OP_ENTITY_IDENTITY_COLLISION", "OP_UPDATE_TARGET_NOT_FOUND", "OP_DELETE_TARGET_NOT_FOUND", "OP_BEFORE_IMAGE_MISMATCH", "OP_RELATION_ALREADY_PRESENT", "OP_RELATION_ENDPOINT_MISSING", "OP_RELATION_NOT_FOUND", "OP_DANGLING_RELATION")
COLLISION, NO_UPDATE, NO_DELETE, BEFORE_MISMATCH, ALREADY_RELATED, ENDPOINT_MISSING, NOT_RELATED, DANGLING = OPERATION_CODES


@dataclass(frozen=True)
class Cardinality:
    """any, exactly n or at_least n members of a group."""

    mode: str = "any"
    n: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("any", "exactly", "at_least") or (self.mode == "any") != (self.n == 0) or self.n < 0:
            raise ValueError(f"no cardinality: {self.mode} {self.n}")


@dataclass(frozen=True)
class Selector:
    """Entities of one kind that ``where`` holds for, grouped by one scalar, or each by itself."""

    kind: str
    where: Expr | None = None
    group_by: Expr | None = None
    members: Cardinality = Cardinality()


@dataclass(frozen=True)
class Assignment:
    path: str
    value: Expr


@dataclass(frozen=True)
class SelectAndAssign:
    selector: Selector
    assignments: tuple[Assignment, ...]
    guard: Expr = TRUE


@dataclass(frozen=True)
class InsertEntity:
    selector: Selector
    target_kind: str
    discriminator: Expr
    assignments: tuple[Assignment, ...] = ()
    guard: Expr = TRUE


@dataclass(frozen=True)
class DeleteEntity:
    selector: Selector
    guard: Expr = TRUE


@dataclass(frozen=True)
class RelateEntities:
    relation_kind: str
    from_selector: Selector
    to_selector: Selector
    guard: Expr = TRUE


@dataclass(frozen=True)
class UnrelateEntities(RelateEntities):
    pass


@dataclass(frozen=True)
class MergeEntities:
    selector: Selector
    target_kind: str
    discriminator: Expr
    assignments: tuple[Assignment, ...] = ()
    guard: Expr = TRUE
    retain_sources: bool = False
    reanchor_relations: bool = False


@dataclass(frozen=True)
class Partition:
    discriminator: Expr
    assignments: tuple[Assignment, ...] = ()


@dataclass(frozen=True)
class SplitEntity:
    selector: Selector
    target_kind: str
    partitions: tuple[Partition, ...]
    guard: Expr = TRUE
    retain_source: bool = False


Operation = SelectAndAssign | InsertEntity | DeleteEntity | RelateEntities | UnrelateEntities | MergeEntities | SplitEntity


@dataclass(frozen=True)
class Rule:
    """reads and writes, where given, must be exactly those that the compiler derives."""

    id: str
    operation: Operation
    after: tuple[str, ...] = ()
    reads: tuple[str, ...] | None = None
    writes: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Checkpoint:
    key: str
    after: str


@dataclass(frozen=True, order=True)
class Requirement:
    path: str
    code: str


@dataclass(frozen=True)
class Profile:
    """All entities of a kind must have the required fields; ``implies`` names weaker profiles."""

    key: str
    kind: str
    requirements: tuple[Requirement, ...]
    implies: tuple[str, ...] = ()


@dataclass(frozen=True)
class Ruleset:
    rules: tuple[Rule, ...]
    checkpoints: tuple[Checkpoint, ...] = ()
    profiles: tuple[Profile, ...] = field(default=())
