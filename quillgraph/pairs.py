"""Relations of two selections, kept as their two sides and what joins them.

Two selections related by a key have as many relations as their groups have pairs, far more than entities. So a state
keeps the sides: checkpoints write them, counts multiply the sizes of groups, and what is unrelated later becomes columns
of the sides. Rows are made where someone reads them, by a join that shuffles no pair and deals the largest groups to tasks in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import RelationKind

#: The smaller side of pairs is broadcast up to this many rows (an id and what joins it, about 100 bytes).
BROADCAST_ROWS = 400_000
#: Tables of entities are joined by id as Spark sees fit up to this many rows. Its estimates come from compressed files, so larger ones are never broadcast.
SMALL_ROWS = 50_000
PAIRS_A_TASK = 4_000_000
MOST_TASKS = 8_192


def unsent(df: DataFrame, n: int | None = None) -> DataFrame:
    """Keeps a table of ``n`` rows (None: unknown) from being broadcast in a join."""
    return df if n is not None and n <= SMALL_ROWS else df.hint("merge")


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


@dataclass(frozen=True)
class Pairs:
    """``left`` has from_id, ``right`` to_id; a pair is related if its ``keys`` (left column, right column) are equal and ``holds`` is true."""

    kind: RelationKind
    left: DataFrame
    right: DataFrame
    keys: tuple[tuple[str, str], ...]
    holds: Column | None
    #: Rows of the sides, and pairs with equal keys: no fewer than there are.
    sizes: tuple[int, int]
    n: int

    def matched(self) -> DataFrame:
        """All pairs with equal keys. Many are made in tiles: a part of one group meets a part of the other in one task."""
        tasks = min(math.ceil(self.n / PAIRS_A_TASK), MOST_TASKS)
        left, right = self.left, self.right
        equal = [F.col(a) == F.col(b) for a, b in self.keys]
        small = min(self.sizes) <= BROADCAST_ROWS
        if tasks > 1:
            left, right = self.dealt(small)
            ends = ([a for a, _ in self.keys] + ["__i", "__j"], [b for _, b in self.keys] + ["__x", "__y"])
            equal.append(F.col("__i") == F.col("__x"))
            if not small:
                left, right = left.repartition(tasks, *ends[0]), right.repartition(tasks, *ends[1])
                equal.append(F.col("__j") == F.col("__y"))
            elif self.sizes[0] <= self.sizes[1]:
                right = right.repartition(tasks, *ends[1])
            else:
                left = left.repartition(tasks, *ends[0])
                equal[-1] = F.col("__j") == F.col("__y")
        if not small:
            right = unsent(right)
        elif self.sizes[0] <= self.sizes[1]:
            left = F.broadcast(left)
        else:
            right = F.broadcast(right)
        return left.join(right, equal) if equal else left.crossJoin(right)

    def dealt(self, small: bool) -> tuple[DataFrame, DataFrame]:
        """The sides with their tiles: (__i, __j) on the left, (__x, __y) on the right.

        Each group is dealt into parts of about ``side`` rows, __i of the left one and __y of the right one; a row is repeated for
        every part that it meets. So a task has few different ids, which files keep as numbers: with all ids of a group
        in each task, every row would hold both ids in full. Groups of more rows are few, and broadcast. small: the smaller side is broadcast, and not repeated.
        """
        side = max(math.isqrt(PAIRS_A_TASK), 1)
        parts = lambda n: F.ceil(n / F.lit(side)).cast("int")
        left, right = self.left, self.right
        if self.keys:
            names = [f"__k{i}" for i in range(len(self.keys))]
            large = self.groups().where((F.col("__l") > side) | (F.col("__r") > side))
            large = F.broadcast(large.select(*[F.col(a).alias(k) for (a, _), k in zip(self.keys, names, strict=True)], parts(F.col("__l")).alias("__ls"), parts(F.col("__r")).alias("__rs")))
            left = left.join(large, [F.col(a) == F.col(k) for (a, _), k in zip(self.keys, names, strict=True)], "left").drop(*names)
            right = right.join(large, [F.col(b) == F.col(k) for (_, b), k in zip(self.keys, names, strict=True)], "left").drop(*names)
        else:
            left, right = (d.withColumn("__ls", parts(F.lit(self.sizes[0]))).withColumn("__rs", parts(F.lit(self.sizes[1]))) for d in (left, right))
        ls, rs = F.coalesce("__ls", F.lit(1)), F.coalesce("__rs", F.lit(1))
        part = lambda end, n: F.pmod(F.xxhash64(end), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left, right = left.withColumn("__i", part("from_id", ls)), right.withColumn("__y", part("to_id", rs))
        if not (small and self.sizes[0] <= self.sizes[1]):
            left = left.withColumn("__j", every(rs))
        if not (small and self.sizes[0] > self.sizes[1]):
            right = right.withColumn("__x", every(ls))
        return left.drop("__ls", "__rs"), right.drop("__ls", "__rs")

    def rows(self) -> DataFrame:
        found = self.matched() if self.holds is None else self.matched().where(self.holds)
        k = self.kind
        return found.select(F.lit(k.name).alias("kind"), F.lit(k.from_kind).alias("from_kind"), F.col("from_id"), F.lit(k.to_kind).alias("to_kind"), F.col("to_id"))

    def groups(self) -> DataFrame:
        """The keys that both sides have, with the sizes of their groups as __l and __r."""
        a = self.left.groupBy(*[a for a, _ in self.keys]).agg(F.count(F.lit(1)).alias("__l"))
        b = self.right.groupBy(*[b for _, b in self.keys]).agg(F.count(F.lit(1)).alias("__r"))
        equal = [F.col(x) == F.col(y) for x, y in self.keys]
        return a.join(unsent(b, min(self.sizes)), equal) if equal else a.crossJoin(b)

    def key_count(self) -> DataFrame:
        """The number of pairs with equal keys as n, from the sizes of groups."""
        return self.groups().agg(F.coalesce(F.sum(F.col("__l") * F.col("__r")), F.lit(0)).alias("n"))

    def counted(self, passed: str, fault: str | None = None) -> DataFrame:
        """(name, n): pairs for which ``holds`` is true and, under ``fault``, NULL."""
        if self.holds is None:
            return self.key_count().select(F.lit(passed).alias("name"), "n")
        found = self.matched().select(self.holds.alias("__holds"))
        counts = [F.count_if("__holds").alias(passed)] + ([F.count_if(F.col("__holds").isNull()).alias(fault)] if fault else [])
        return found.agg(*counts).unpivot([], [passed] + ([fault] if fault else []), "name", "n")

    def tagged(self, tag: str, holds: Column | None) -> Pairs:
        """The same with ``tag`` behind every name. holds: the condition under these names."""
        left, right = (d.select(*[F.col(f"`{c}`").alias(c + tag) for c in d.columns]) for d in (self.left, self.right))
        return replace(self, left=left, right=right, keys=tuple((a + tag, b + tag) for a, b in self.keys), holds=holds)

    def joined(self, other: Pairs, tag: str, how: str) -> tuple[DataFrame, DataFrame]:
        left = self.left.join(unsent(other.left, other.sizes[0]), F.col("from_id") == F.col(f"from_id{tag}"), how)
        return left, self.right.join(unsent(other.right, other.sizes[1]), F.col("to_id") == F.col(f"to_id{tag}"), how)

    def shared(self, other: Pairs, tag: str) -> Pairs:
        """The pairs that are in both; ``other`` is tagged."""
        left, right = self.joined(other, tag, "inner")
        sizes = tuple(map(min, self.sizes, other.sizes))
        return replace(self, left=left, right=right, keys=self.keys + other.keys, holds=both(self.holds, other.holds), sizes=sizes, n=min(self.n, other.n))

    def without(self, other: Pairs, tag: str) -> Pairs:
        """The pairs that are not in ``other``, which is tagged."""
        left, right = self.joined(other, tag, "left")
        there = F.col(f"from_id{tag}").isNotNull() & F.col(f"to_id{tag}").isNotNull()
        for a, b in other.keys:
            there = there & (F.col(a) == F.col(b))
        return replace(self, left=left, right=right, holds=both(self.holds, ~F.coalesce(both(there, other.holds), F.lit(False))))

    def stored(self, store: Callable[[DataFrame, str], DataFrame], path: str) -> Pairs:
        return replace(self, left=store(self.left, f"{path}/left"), right=store(self.right, f"{path}/right"))
