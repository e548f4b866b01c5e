"""N-gram Jaccard join: a size-aware heavy-light set join, and the groups that its links form.

A text's set is its distinct w-word shingles; two texts link when
|A & B| >= t |A | B|. Every pair that links is found; nothing is capped or sampled.

1. Texts with equal sets fold into one class; only classes are joined.
2. A pair of sizes a <= b that links has at most H = floor((1-t)/(1+t) (a+b)) elements on
   one side only, so it shares at least c = ceil(t/(1+t) (a+b)) elements.
   *Light* (small) sets are filed under all of their subsets of this fixed size c, for
   each partner size. *Heavy* (large) sets are filed in inverted lists: the shingles
   are dealt by hash into more than H segments, so that linked sets agree on at least
   one whole segment; a list holds the sets with equal content in a segment. (Lists
   of single shingles would be exact as well, but a passage that thousands of texts share
   makes them quadratic.) A size is light where its subsets cost less than its lists
   (``is_light``).
3. Lists with two classes or more become *stars*: a row (smallest class of the list, class), each once
   however many lists give it. Any two sets of a list are in one star. Within a star, sketches of the parity of the
   shingles in 2^k cells are compared: |A xor B| is at least the number of cells that differ, which
   rejects nearly all false pairs and no true one. A star passes on a spanning forest of what remains.
4. Connected components of these edges are candidate groups; any two sets that link are
   in the same one. Within a group the shingle sets themselves are compared, and the group passes on a
   spanning forest of its links.
5. Connected components of these edges are the result.

Stars and groups of bounded size are searched breadth first in one task: a set is compared only with sets
that are not yet reached, so a family of near copies costs about one comparison a set. Larger ones are
cut in blocks: each block is searched together with the group's leader, and only sets that
the leader does not reach meet all blocks. With ``links`` (numbers of links are asked for), all pairs of a group
are compared instead, which grows with the square of a family, over many tasks.

Hot groups: a class is filed once per task however many copies it has; a list that many classes of a
task share is one entry of the task, and its members are joined to it by (list, entry), which is unique; a class that
an id repeats is sent once per task. Shingles are 64-bit fingerprints, classes 128-bit ones, and list keys 40 bits and
more within a bucket: equal sets are equal up to a hash collision, and equal list keys only propose pairs.

Edge cases: null and empty texts have an empty set, link with nothing and are their own
component; a text with fewer words than w has its whole sequence as its one shingle;
a row with a null id takes no part in links and has a null component; rows that repeat an
id and a text count as one document for components; columns other than the id and
the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, drop_written, written

U = np.uint64
WORD = regex.compile("[^\x20\x09-\x0d]+")
#: Sets and shingles in a group that one task holds; larger ones are cut in blocks of half of that.
BLOCK, SHINGLES = 1024, 1 << 20
#: The same for stars, whose sketches take some tenths of a byte for each shingle: with large blocks few copies are sent.
STAR_BLOCK, STAR_SHINGLES = 8192, 1 << 25
#: A list that more classes of one task share is one entry of that task.
HOT = 64
#: List entries and classes that a task gathers before it deals them into buckets, and stars that it remembers.
FLUSH, OFFSETS, STARS = 1 << 20, 1 << 15, 500_000
#: Bytes of documents for each bucket of list entries.
BUCKET_BYTES = 1 << 20
#: A list entry costs this many subset entries: it is scanned and its pairs are verified.
LIST_COST = 6
#: Words and classes that a task remembers.
CACHE, CLASSES = 200_000, 200_000
#: Edges that one task contracts.
CONTRACT = 200_000
#: Rows of ids (some 50 bytes each) up to this number, counted first, are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rounds in which labels settle: more than a path of 2^60 needs.
ROUNDS = 100


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, hashes: WordHash) -> np.ndarray:
    """The sorted distinct shingle fingerprints of a whole text."""
    words = WORD.findall((text or "").translate(LOWER_AZ))
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, n)
    with np.errstate(over="ignore"):
        if n < width:
            width = n
        out = mix(h[: n - width + 1] + U(width))
        for i in range(1, width):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return np.unique(out)


@dataclass(frozen=True)
class Plan:
    """Which signatures a set of each size gets, for threshold num/den."""

    num: int
    den: int

    def differ(self, a: int, b: int) -> int:
        """The most elements that linked sets of these sizes can have on one side only."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest(self, n: int) -> int:
        """The largest size of a partner."""
        return n * self.den // self.num

    def smallest(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def common(self, a: int, b: int) -> int:
        """The least number of shared elements of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def subset_count(self, n: int) -> int:
        return sum(comb(n, self.common(n, b)) for b in range(self.smallest(n), self.largest(n) + 1) if self.common(n, b) <= min(n, b))

    def is_light(self, n: int) -> bool:
        """Light up to the first size whose subsets cost more than its lists."""
        return n <= 64 and all(self.subset_count(k) <= LIST_COST * (self.differ(k, self.largest(k)) + 2) for k in range(1, n + 1))

    def interval(self, n: int) -> tuple[int, int]:
        """The interval of sizes that shares one segmentation with n."""
        low, ratio = 1, max(1.4, self.den / self.num)
        while True:
            high = max(int(low * ratio), low + 1)
            if n < high:
                return low, high - 1
            low = high

    def segments(self, low: int, high: int) -> tuple[int, int]:
        """Segments for pairs whose larger size is in the interval, and how many may be empty in a set that is filed by its others only."""
        most = self.differ(high, high)
        spare = 1 + int(2 * most * np.exp(-low / (most + 1)))
        return most + 1 + spare, spare


_light: dict[tuple[int, int], int] = {}


def light_bound(plan: Plan) -> int:
    """The largest light size."""
    key = (plan.num, plan.den)
    if key not in _light:
        n = 0
        while plan.is_light(n + 1):
            n += 1
        _light[key] = n
    return _light[key]


def signatures(s: np.ndarray, plan: Plan) -> np.ndarray:
    """The distinct list keys of a set: subsets if it is light, segments with any partner of a heavy size."""
    n, out = len(s), []
    light = light_bound(plan)
    with np.errstate(over="ignore"):
        m = mix(s)
        if n <= light:
            total = m.sum(dtype=U)
            for b in range(plan.smallest(n), min(plan.largest(n), light) + 1):
                c = plan.common(n, b)
                drop = n - c
                if c > min(n, b) or (drop == 0 and n == b):
                    continue  # no such pair, or equal sets, which are one class
                if drop == 0:
                    sums = np.array([total], U)
                elif drop == 1:
                    sums = total - m
                else:
                    sums = np.array([total - m[list(x)].sum(dtype=U) for x in combinations(range(n), drop)], U)
                out.append(mix(sums * U(3) + U(min(n, b) << 40 | max(n, b) << 20 | c)))
        if plan.largest(n) > light:
            for low, high in sorted({plan.interval(k) for k in (n, plan.largest(n))}):
                if high <= light:
                    continue
                count, spare = plan.segments(low, high)
                where = (s % U(count)).astype(np.int64)
                sums, sizes = np.zeros(count, U), np.bincount(where, minlength=count)
                np.add.at(sums, where, m)
                # With more empty segments than spare ones, agreement may be on empty ones alone.
                use = np.flatnonzero(sizes > 0) if (sizes == 0).sum() <= spare else np.arange(count)
                out.append(mix((sums[use] ^ mix(sizes[use].astype(U))) + mix(use.astype(U) + U(high << 24))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def sketch(s: np.ndarray, plan: Plan) -> bytes:
    """Parities of the set in a number of cells that depends on its size, the largest resolution first folding to any smaller."""
    cells = 256
    while cells < len(s) * 2 * (plan.den - plan.num) // plan.den * 2:
        cells *= 2
    bits = np.bincount((mix(s ^ U(0x5851F42D4C957F2D)) & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the fewest cells among them (cell i joins cell i + half)."""
    least = min(map(len, sketches))
    rows = np.zeros((len(sketches), least // 8), U)
    for i, x in enumerate(sketches):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, least // 8), axis=0)
    return rows


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, plan: Plan) -> np.ndarray:
    """A matrix: can sketches a[i] and b[j] belong to sets that link?"""
    differ = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        differ += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return differ <= (plan.den - plan.num) * (size_a[:, None] + size_b[None, :]) // (plan.den + plan.num)


class Sets:
    """Sets of a star or a group: sizes, sketches and, for exact answers, shingles."""

    def __init__(self, n: np.ndarray, sketches: list[bytes], shingles: list[np.ndarray] | None, plan: Plan):
        self.n, self.shingles, self.plan = n, shingles, plan
        self.cells = np.array([len(x) for x in sketches])
        # For each resolution, the sketches of at least this resolution, folded to it.
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for level in np.unique(self.cells).tolist():
            place = np.cumsum(self.cells >= level) - 1
            self.at[level] = place, folded([x for x in sketches if len(x) >= level])

    def near(self, v: int, others: np.ndarray) -> np.ndarray:
        """Which of the others can link with v by their sketches, or do link, if the shingles are there?"""
        plan, n = self.plan, self.n
        out = np.zeros(len(others), bool)
        fit = np.flatnonzero((plan.den * n[others] >= plan.num * n[v]) & (plan.num * n[others] <= plan.den * n[v]))
        for level, (place, rows) in self.at.items():
            some = fit[np.minimum(self.cells[others[fit]], self.cells[v]) == level]
            if len(some):
                mine = place[v]
                out[some] = may_link(rows[mine : mine + 1], rows[place[others[some]]], n[v : v + 1], n[others[some]], plan)[0]
        if self.shingles is not None and out.any():
            some = np.flatnonzero(out)
            both = overlaps(self.shingles[v], [self.shingles[u] for u in others[some].tolist()])
            out[some] = plan.den * both >= plan.num * (n[v] + n[others[some]] - both)
        return out


def overlaps(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of s are in each of the others, which are not empty."""
    flat = np.concatenate(others)
    at = np.searchsorted(s, flat)
    at[at == len(s)] = 0
    return np.add.reduceat((s[at] == flat).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def search(sets: Sets) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the sets' links, and the sets that the first one reaches; each set is compared with unreached ones only."""
    fresh = np.ones(len(sets.n), bool)
    out, first = [], fresh
    for root in range(len(fresh)):
        if not fresh[root]:
            continue
        fresh[root] = False
        todo = [root]
        while todo:
            left = np.flatnonzero(fresh)
            if not len(left):
                break
            v = todo.pop()
            new = left[sets.near(v, left)]
            fresh[new] = False
            new = new.tolist()
            out += [(v, u) for u in new]
            todo += new
        if root == 0:
            first = ~fresh
    return out, first


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a graph given as a symmetric matrix; in memory no more than the matrix."""
    fresh = np.ones(len(near), bool)
    out = []
    for root in np.flatnonzero(near.any(1)).tolist():
        if not fresh[root]:
            continue
        fresh[root] = False
        todo = [root]
        while todo:
            v = todo.pop()
            new = np.flatnonzero(near[v] & fresh)
            fresh[new] = False
            new = new.tolist()
            out += [(v, u) for u in new]
            todo += new
    return out


#: Rows of ``filed``: a document, the list entries of a bucket, the members of a list that a task has as one entry.
DOCUMENT, ENTRIES, MEMBERS = 0, 1, 2
FILED = pa.schema(
    [
        ("kind", pa.int8()),
        ("n", pa.int64()),
        ("class", pa.binary()),
        ("ref", pa.int64()),
        ("sketch", pa.binary()),
        ("list", pa.int64()),
        ("entries", pa.binary()),
        ("members", pa.list_(pa.int64())),
    ]
)


def dealt(lists: list[np.ndarray], start: int, bits: int) -> Iterator[pa.RecordBatch]:
    """ENTRIES and MEMBERS rows (without key) for the list keys of classes start, start + 1 and so on.

    An entry is 40 bits of the key and 16 bits for the class; the topmost marks a list that
    more than HOT of these classes share, of which only the first has an entry.
    """
    keys = np.concatenate(lists)
    own = np.repeat(np.arange(len(lists), dtype=np.uint16), [len(x) for x in lists])
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order] >> U(24 - bits), own[order]  # bits of the bucket, then 40
    at = bounds(keys)
    hot = np.flatnonzero(np.diff(at) > HOT).tolist()
    keep = np.ones(len(keys), bool)
    flag = own.copy()
    some: list[tuple[int, int, list[int]]] = []
    for i in hot:
        run = slice(int(at[i]), int(at[i + 1]))
        some.append((int(keys[run.start]), start + int(own[run.start]), (own[run].astype(np.int64) + start).tolist()))
        keep[run.start + 1 : run.stop] = False
        flag[run.start] |= OFFSETS
    keys, flag = keys[keep], flag[keep]
    buckets = (keys >> U(40)).astype(np.int64)
    low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5]
    cut = bounds(buckets).tolist()
    head = start.to_bytes(8, "little")
    blobs = [head + low[x:y].tobytes() + flag[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
    for rows in (
        {"kind": [ENTRIES] * len(blobs), "list": buckets[cut[:-1]].tolist(), "entries": blobs},
        {"kind": [MEMBERS] * len(some), "list": [x for x, _, _ in some], "ref": [x for _, x, _ in some], "members": [x for _, _, x in some]},
    ):
        m = len(rows["kind"])
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * m), f.type) for f in FILED], schema=FILED)


def filed(docs: DataFrame, width: int, plan: Plan, bits: int) -> DataFrame:
    """DOCUMENT rows (key, n, class; ref and sketch at the first sight of the class with a key in a task), ENTRIES and MEMBERS rows."""
    key_type = docs.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHash(), set()
        start = made = TaskContext.get().partitionId() << 40
        lists: list[np.ndarray] = []
        waiting = 0
        none: pa.DataType | None = None
        for batch in batches:
            none = batch.column(0).type
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sizes, classes, refs, sketches = [], [], [], []
                for key, text in zip(part.column(0), part.column(1), strict=True):
                    s = shingles(text.as_py(), width, hashes)
                    c = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    new = key.is_valid and c is not None and c not in seen  # rows without a key are not joined
                    if new:
                        if len(seen) >= CLASSES:
                            seen.clear()
                        seen.add(c)
                        lists.append(signatures(s, plan))
                        waiting += len(lists[-1])
                    sizes.append(len(s))
                    classes.append(c)
                    refs.append(made if new else None)
                    sketches.append(sketch(s, plan) if new else None)
                    made += new
                    if waiting >= FLUSH or len(lists) >= OFFSETS:
                        yield from keyed(dealt(lists, start, bits), none)
                        lists, waiting, start = [], 0, made
                m = len(sizes)
                rows = {"kind": [DOCUMENT] * m, "n": sizes, "class": classes, "ref": refs, "sketch": sketches}
                out = [pa.array(rows.get(f.name, [None] * m), f.type) for f in FILED]
                yield pa.RecordBatch.from_arrays([part.column(0), *out], ["key", *FILED.names])
        if waiting:
            yield from keyed(dealt(lists, start, bits), none)

    def keyed(found: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for x in found:
            yield pa.RecordBatch.from_arrays([pa.nulls(x.num_rows, kind), *x.columns], ["key", *FILED.names])

    return docs.mapInArrow(
        work, f"key {key_type}, kind tinyint, n bigint, class binary, ref bigint, sketch binary, list bigint, entries binary, members array<bigint>"
    )


def stars(filed_rows: DataFrame) -> DataFrame:
    """(lo, ref): for each list that has two classes or more, its smallest reference with each of its references, itself included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = [], 0

        def flushed() -> pa.RecordBatch:
            rows = np.unique(np.concatenate(found), axis=0)
            lists = pa.array(rows[:, 2], mask=rows[:, 2] < 0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), lists], ["lo", "ref", "list"])

        for run in runs(batches, "list"):
            bucket, blobs = run.column("list").to_numpy(), run.column("entries").to_pylist()
            at = bounds(bucket)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                keys, refs, hot = entries(blobs[lo:hi])
                order = np.lexsort((refs, keys))
                keys, refs, hot = keys[order], refs[order], hot[order]
                cut = bounds(keys)
                first, size = cut[:-1], np.diff(cut)
                use = np.repeat((size > 1) | hot[first], size)
                if use.any():
                    least = np.repeat(refs[first], size)[use]
                    lists = np.where(hot[use], (int(bucket[lo]) << 40) + keys[use], -1)
                    found.append(np.unique(np.stack([least, refs[use], lists], axis=1), axis=0))
                    waiting += len(found[-1])
                if waiting >= STARS:
                    yield flushed()
                    found, waiting = [], 0
        if waiting:
            yield flushed()

    def entries(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, refs, hot = [], [], []
        for blob in blobs:
            m = (len(blob) - 8) // 7
            wide = np.zeros((m, 8), np.uint8)
            wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * m, 8).reshape(m, 5)
            flag = np.frombuffer(blob[8 + 5 * m :], np.uint16)
            keys.append(wide.view(np.int64).ravel())
            refs.append((flag & (OFFSETS - 1)).astype(np.int64) + int.from_bytes(blob[:8], "little"))
            hot.append(flag >= OFFSETS)
        return np.concatenate(keys), np.concatenate(refs), np.concatenate(hot)

    dealt_rows = grouped(filed_rows.where(f"kind = {ENTRIES}").select("list", "entries"), "list", "list")
    found = written(dealt_rows.mapInArrow(work, "lo bigint, ref bigint, list bigint"), "jaccard-found")
    members = filed_rows.where(f"kind = {MEMBERS}").select("list", "ref", F.explode("members").alias("member"))
    # An entry that stands for many classes gives way to them.
    many = found.where("list is not null").join(members, ["list", "ref"]).select("lo", F.col("member").alias("ref"))
    return found.where("list is null").select("lo", "ref").unionByName(many).distinct()


def grouped(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a key together in one partition and in order."""
    return df.repartition(key).sortWithinPartitions(key, order)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of equal ``key``, from batches that are sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key))
        if rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py() == k[0].as_py() == k[-1].as_py():
            rest.append(batch)
            continue
        a = k.to_numpy(zero_copy_only=False)
        last = len(a) - 1
        while last > 0 and a[last - 1] == a[-1]:
            last -= 1
        if rest or last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def bounds(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def cut(ids: DataFrame, exact: bool) -> DataFrame:
    """Adds ``blocks``: 1 where a task can hold the group, else into how many blocks it is cut, and ``block`` by the hash of rep. ids: group, rep, n and others."""
    size = ids.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    sets, weight = (BLOCK, SHINGLES) if exact else (STAR_BLOCK, STAR_SHINGLES)
    big = size.where((F.col("sets") > sets) | (F.col("shingles") > weight)).select("group", blocks_of(exact).alias("blocks"))
    some = ids.join(big, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return some.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))


def blocks_of(exact: bool) -> Column:
    """How many blocks so many sets and shingles are cut into."""
    sets, weight = (BLOCK, SHINGLES) if exact else (STAR_BLOCK, STAR_SHINGLES)
    return F.ceil(F.greatest(F.col("sets") / (sets // 2), F.col("shingles") / (weight // 2))).cast("int")


def task_of(*parts: Column) -> Column:
    return F.struct(F.xxhash64("group", *parts).alias("task"))


def read_set(n: np.ndarray, bodies: list[bytes], at: list[int], plan: Plan, exact: bool) -> Sets:
    bodies = [bodies[k] for k in at]
    if not exact:
        return Sets(n[at], bodies, None, plan)
    sets = [np.frombuffer(x, U) for x in bodies]
    return Sets(n[at], [sketch(s, plan) for s in sets], sets, plan)


def pairs_batch(found: list[tuple[int, int, int | None]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["group", "a", "b"])


def group_edges(ids: DataFrame, attach: Callable[[DataFrame], DataFrame], plan: Plan, exact: bool, name: str) -> DataFrame:
    """Edges (a, b) that connect what links within each group.

    ids: group, rep, n and what ``attach`` needs to add ``body`` (a sketch or, if exact, shingles) to rows of ids with
    a column ``tasks``, the tasks to which the row goes. The group's leader is the set whose rep is the group.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Searches each block with the leader first. Rows with b null are sets of cut groups that the leader does not reach."""
        for run in runs(batches, "task"):
            task, group, rep, n, blocks = (run.column(c).to_numpy() for c in ("task", "group", "rep", "n", "blocks"))
            at, bodies = bounds(task), run.column("body").to_pylist()
            found: list[tuple[int, int, int | None]] = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                order = sorted(range(lo, hi), key=lambda k: (rep[k] != group[k], rep[k]))
                near, reached = search(read_set(n, bodies, order, plan, exact))
                ids_of, g = rep[order].tolist(), int(group[lo])
                found += {(g, ids_of[a], ids_of[b]): 0 for a, b in near if ids_of[a] != ids_of[b]}
                if blocks[lo] > 1:
                    found += {(g, ids_of[k], None): 0 for k in np.flatnonzero(~reached).tolist()}
            yield from pairs_batch(found)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares the unreached sets of a block (side 0) with all sets of a block (side 1), of which the reached ones are already connected."""
        for run in runs(batches, "task"):
            task, group, rep, n, side, far = (run.column(c).to_numpy() for c in ("task", "group", "rep", "n", "side", "far"))
            at, bodies = bounds(task), run.column("body").to_pylist()
            found: list[tuple[int, int, int | None]] = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sets = read_set(n, bodies, list(range(lo, hi)), plan, exact)
                g, up = int(group[lo]), {}

                def top(x: int, up: dict = up) -> int:
                    while up.setdefault(x, x) != x:
                        up[x] = x = up[up[x]]
                    return x

                known = next((int(rep[k]) for k in range(lo, hi) if side[k] and not far[k]), None)
                for k in range(lo, hi):
                    if side[k] and not far[k]:
                        up[int(rep[k])] = known
                others = np.flatnonzero(side[lo:hi] == 1)
                for k in np.flatnonzero(side[lo:hi] == 0).tolist():
                    a = int(rep[lo + k])
                    for u in others[sets.near(k, others)].tolist():
                        b = int(rep[lo + u])
                        if top(a) != top(b):
                            up[top(a)] = top(b)
                            found.append((g, a, b))
            yield from pairs_batch(found)

    some = cut(ids, exact)
    leader = (F.col("rep") == F.col("group")) & (F.col("blocks") > 1)
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: task_of(i))
    rows = attach(some.withColumn("tasks", F.when(leader, every).otherwise(F.array(task_of(F.col("block")))))).select("*", F.explode("tasks.task").alias("task"))
    searched = grouped(rows.select("task", "group", "rep", "n", "blocks", "body"), "task", "rep").mapInArrow(own, "group bigint, a bigint, b bigint")
    found = written(searched, f"{name}-own")
    far = found.where("b is null").select("group", F.col("a").alias("rep")).distinct()
    if far.isEmpty():
        return found.select("a", "b")
    # Unreached sets, in blocks of their own, meet each block of their group.
    counts = far.join(ids.select("group", "rep", "n"), ["group", "rep"]).groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    again = some.join(counts.select("group", blocks_of(exact).alias("far_blocks")), "group").join(far.withColumn("far", F.lit(True)), ["group", "rep"], "left")
    again = again.withColumn("far", F.coalesce("far", F.lit(False))).withColumn("far_block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("far_blocks")).cast("int"))
    side = lambda i, j, k: F.struct(F.xxhash64("group", i, j).alias("task"), F.lit(k).alias("side"))
    as_other = F.transform(F.sequence(F.lit(0), F.col("far_blocks") - 1), lambda i: side(i, F.col("block"), 1))
    as_far = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: side(F.col("far_block"), j, 0))
    rows = attach(again.withColumn("tasks", F.when(F.col("far"), F.concat(as_other, as_far)).otherwise(as_other))).withColumn("t", F.explode("tasks"))
    rows = rows.select("t.task", "t.side", "group", "rep", "n", "far", "body")
    return found.where("b is not null").select("a", "b").unionByName(grouped(rows, "task", "rep").mapInArrow(rest, "group bigint, a bigint, b bigint").select("a", "b"))


def counted(ids: DataFrame, attach: Callable[[DataFrame], DataFrame], plan: Plan) -> DataFrame:
    """All links within the groups: (a, b, links) with spanning edges (links null), and rows with b null and the links that a has from one task.

    ids: group, rep, n, size (texts of the class) and what ``attach`` needs. Groups beyond a task's bounds are cut
    in blocks, and each pair of blocks is a task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "task"):
            task, rep, n, size = (run.column(c).to_numpy() for c in ("task", "rep", "n", "size"))
            side, raw = run.column("side").to_pylist(), run.column("body")
            at = bounds(task)
            out: list[tuple[int, int | None, int | None]] = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                # Rows that repeat an id and a text are one set.
                own = [k for k in range(lo, hi) if k == lo or rep[k] != rep[k - 1] or n[k] != n[k - 1] or raw[k] != raw[k - 1]]
                if len(own) < 2:
                    continue
                near = across(linked([np.frombuffer(raw[k].as_py(), U) for k in own], n[own], plan), [side[k] for k in own])
                ids_of, links = rep[own], near @ size[own]
                out += [(int(ids_of[a]), int(ids_of[b]), None) for a, b in forest(near)]
                out += [(int(ids_of[k]), None, int(links[k])) for k in np.flatnonzero(links)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "links"])

    some = cut(ids, True)
    block = F.col("block")
    pair = lambda o: F.struct(
        F.xxhash64("group", F.least(o, block), F.greatest(o, block)).alias("task"), F.when(o == block, None).otherwise((block > o).cast("int")).alias("side")
    )
    rows = attach(some.withColumn("tasks", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))).withColumn("t", F.explode("tasks"))
    return grouped(rows.select("t.task", "t.side", "rep", "n", "size", "body"), "task", "rep").mapInArrow(work, "a bigint, b bigint, links bigint")


def across(near: np.ndarray, side: list[int | None]) -> np.ndarray:
    """Without the edges within a side of a pair of blocks, nor loops."""
    s = np.array([-1 if x is None else x for x in side])
    near &= (s[:, None] < 0) | (s[:, None] != s[None, :])
    np.fill_diagonal(near, False)
    return near


def linked(sets: list[np.ndarray], n: np.ndarray, plan: Plan) -> np.ndarray:
    """A matrix: which of the sets link?"""
    m = len(sets)
    both = np.zeros((m, m), np.float32)
    if m <= 8:
        for a in range(m):
            for b in range(a):
                both[a, b] = both[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        # Overlaps as a matrix product of 0/1 rows, some thousand shingles at a time.
        every, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(m), [len(s) for s in sets])
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        step = max(256, (2 << 20) // m)
        for lo in range(0, len(every), step):
            x, y = np.searchsorted(code, [lo, lo + step])
            part = np.zeros((m, min(step, len(every) - lo)), np.float32)
            part[owner[x:y], code[x:y] - lo] = 1
            both += part @ part.T
    both = both.astype(np.int64)
    return plan.den * both >= plan.num * (n[:, None] + n[None, :] - both)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, label): the smallest vertex of each vertex's connected component.

    Edges are first contracted in parts of bounded size; a single part is the result. Else smallest labels spread over them, and each round also takes the label of the
    label, so that rounds grow with the logarithm of the longest path. Every round is written to
    the shared checkpoint folder.
    """
    found = written(edges.select("a", "b"), f"{name}-found")
    parts = 1 + found.count() // CONTRACT
    stars = contracted(found, parts)
    if parts == 1:
        labels = written(stars.select(F.col("b").alias("v"), F.col("a").alias("label")), f"{name}-labels")
        drop_written(found)
        return labels
    both = written(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    drop_written(found)
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), f"{name}-0")
    for i in range(1, ROUNDS + 1):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        new = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        step = written(new.join(jump, "label", "left").select("v", "old", F.least("label", "further").alias("label")), f"{name}-{i}")
        changed = step.where("old <> label").limit(1).count()
        drop_written(labels)
        labels = step.select("v", "label")
        if not changed:
            drop_written(both)
            return labels
    raise RuntimeError(f"labels still change after {ROUNDS} rounds")


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) that connect the same vertices: each part becomes stars (loops included) around the smallest vertices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                while up.setdefault(a, a) != a:
                    up[a] = a = up[up[a]]
                while up.setdefault(b, b) != b:
                    up[b] = b = up[up[b]]
                if a != b:
                    up[max(a, b)] = min(a, b)
        stars = []
        for v in up:
            top = v
            while up[top] != top:
                top = up[top]
            stars.append((top, v))
        if stars:
            a, b = zip(*stars, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges.repartition(parts).mapInArrow(work, "a bigint, b bigint")


def join(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """Returns the id column (which must cast to bigint), n_shingles, component_id and, if links, n_links (documents linked with this one) for every row."""
    rows, facts = linked_classes(docs, width, num, den, id_col, text_col, links)
    names = ["component_id", "n_links"][: 1 + links]
    in_class = rows.where("class is not null").join(facts, "class", "left").select("key", "n", *[F.when(F.col("key").isNotNull(), F.col(c)).alias(c) for c in names])
    empty = rows.where("class is null").select("key", "n", F.col("key").alias("component_id"), F.lit(0).cast("bigint").alias("n_links")).select("key", "n", *names)
    out_id = F.col("key").cast(docs.schema[id_col].dataType).alias(id_col)
    return in_class.unionByName(empty).select(out_id, F.col("n").alias("n_shingles"), *names)


def linked_classes(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, links: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (key, n, class) of all documents, and class, size, rep, component_id and, if links, n_links of all classes."""
    plan = Plan(num, den)
    texts = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
    rows = written(filed(texts, width, plan, bucket_bits(texts)), "jaccard-filed")
    slim = written(rows.where(f"kind = {DOCUMENT}").select("key", "n", "class", "ref", "sketch"), "jaccard-rows")
    base = slim.where("class is not null and key is not null")
    facts = [F.min("key").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.max("sketch").alias("sketch")]
    classes = written(base.groupBy("class").agg(*facts), "jaccard-classes")

    refs = base.where("ref is not null").select("ref", "class").join(classes, "class").select("ref", "rep", "n", "class", "sketch")
    starred = stars(rows).join(refs.select(F.col("ref").alias("lo"), F.col("rep").alias("group")), "lo").join(refs.select("ref", "rep", "n", "class"), "ref")
    in_stars = starred.groupBy("group", "class").agg(F.first("rep").alias("rep"), F.first("n").alias("n"))
    in_stars = written(in_stars, "jaccard-stars")
    drop_written(rows)
    marks = classes.select("class", F.col("sketch").alias("body"))
    near = group_edges(in_stars, lambda df: df.join(marks, "class"), plan, False, "jaccard-near")
    groups = components(near, "jaccard-candidates")
    drop_written(in_stars)

    of_group = classes.select(F.col("rep").alias("v"), "class", "size", "n")
    ids = written(groups.join(of_group, "v").select(F.col("label").alias("group"), F.col("v").alias("rep"), "class", "size", "n"), "jaccard-members")
    attach = lambda df: shingle_sets(texts, df, width)
    if links:
        out = written(counted(ids, attach, plan), "jaccard-links")
        edges = out.where("b is not null")
    else:
        edges = group_edges(ids, attach, plan, True, "jaccard-exact")
    labels = components(edges, "jaccard-components").withColumnRenamed("v", "rep")
    found = classes.select("class", "rep", "size").join(labels, "rep", "left").withColumn("component_id", F.coalesce("label", "rep"))
    if links:
        more = out.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        found = found.join(more, "rep", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("size") - 1)
    return slim.select("key", "n", "class"), found.drop("label", "links")


def bucket_bits(docs: DataFrame) -> int:
    """How many buckets (as a power of two) list entries are dealt into, by the planner's estimate of the input's size; any number gives the same result."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(22, max(6, ceil(log2(max(2, size / BUCKET_BYTES)))))


def shingle_sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """ids (rep, class, tasks and others) with ``body``, the shingles of the text whose key is rep; a text of another class that has the same id goes."""
    # What is broadcast is counted as it is sent: a row, and an element for each task that it goes to.
    tasks = ids.select(F.size("tasks").alias("n")).agg(F.sum("n")).first()[0] or 0
    wanted = F.broadcast(ids) if tasks <= BROADCAST_IDS else ids
    names = [f.name for f in ids.schema]
    found = texts.select(F.col("key").alias("rep"), "text").join(wanted, "rep").select("text", *names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHash(), set()
        at = names.index("class") + 1
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                keep, sets = [], []
                for text, rep, c in zip(part.column(0), part.column(names.index("rep") + 1), part.column(at), strict=True):
                    known = (rep.as_py(), c.as_py())
                    s = b"" if known in seen else shingles(text.as_py(), width, hashes).tobytes()
                    keep.append(known not in seen and xxhash.xxh3_128_digest(s) == known[1])
                    if keep[-1]:
                        if len(seen) >= CLASSES:
                            seen.clear()
                        seen.add(known)
                    sets.append(s)
                out = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sets, pa.binary())], [*names, "body"])
                yield out.filter(pa.array(keep))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema)
    return found.mapInArrow(work, f"{kinds}, body binary")


def deduplicate(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keeps one document of each group, that with the smallest id, with all columns; documents without words and those with a null id stay.

    Texts are not shuffled: the ids that go, or that stand in several rows, meet the documents in a join (broadcast up to BROADCAST_IDS of them).
    """
    rows, facts = linked_classes(docs, width, num, den, id_col, text_col, False)
    keyed = rows.where("key is not null")
    # An id with several texts stays if any of them is kept.
    placed = keyed.join(facts.select("class", "component_id"), "class", "left")
    state = placed.groupBy("key").agg(F.max(F.coalesce(F.col("component_id") == F.col("key"), F.lit(True))).alias("kept"), F.count("*").alias("rows"))
    odd = written(state.where("not kept or rows > 1"), "jaccard-odd")
    some = F.broadcast(odd) if odd.count() <= BROADCAST_IDS else odd
    own, kept = docs[id_col].cast("bigint"), some.where("kept")
    plain = docs.join(some, own == some["key"], "left_anti")
    repeated = docs.join(kept, own == kept["key"], "left_semi").dropDuplicates([id_col, text_col])
    return plain.unionByName(repeated)
