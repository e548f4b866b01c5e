"""Approximate nearest neighbours over learned partitions.

1. A bounded sample (the ``sample_rows`` vectors with the smallest hash of their id, 128 for each partition at least) gets an
   exact neighbour graph, which is cut into ``n_parts`` balanced partitions (by default more for more rows: ``parts_of``): balanced
   k-means seeds them, then vertices move to the partition that most of their neighbours
   are in, as long as none outgrows ``slack`` times the mean.
2. A small classifier (one hidden layer, softmax) learns the partition of a vector.
3. Every row is indexed under its most probable partition; a query goes to its most
   probable ``probes`` partitions. Where ``probes`` is not given, it is the smallest number that
   reaches ``target`` recall for the sample's own vectors.
4. In each probed partition the candidates are reranked by the exact cosine in double
   precision on the original vectors; the k best of all partitions remain.

Partitions are worked through in blocks of at most CANDIDATES x QUERIES rows, so a
partition that holds a third of all rows (equal vectors, say) spreads over many tasks.
Nothing but the sample, the model and one count per partition reaches the driver.

Vectors that are null, zero, hold null or non-finite components, differ in length from the most common
one in the sample, or have a null id take no part. Ties go to the smaller id. Rows that
repeat an id count once per id in a result, at their best score, and are no candidates for their own id. Fewer
candidates than k give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES = 8192, 1024


#: The most parts, of PART_SAMPLE sample rows each; a part has about 8 times as many rows as there are parts, up to that.
MOST_PARTS, PART_SAMPLE = 256, 128


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: no norm overflows or vanishes, and no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def parts_of(n: int) -> int:
    """The number of parts for so many rows."""
    return min(MOST_PARTS, max(32, int(np.sqrt(n / 8))))


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest others of each row, by cosine."""
    out = np.empty((len(x), degree), np.int64)
    step = max(16, (1 << 22) // max(1, len(x)))
    for lo in range(0, len(x), step):
        s = x[lo : lo + step] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + step] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, n_parts: int, slack: float = 1.1, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """A partition of the graph's vertices with few cut edges and no part above ``slack`` times the mean."""
    rng = np.random.default_rng(seed)
    most = int(np.ceil(slack * len(x) / n_parts))
    centres = x[rng.choice(len(x), n_parts, replace=False)]
    for _ in range(6):
        part = assign(x @ centres.T, most)
        centres = np.stack([x[part == p].sum(0) if (part == p).any() else x[int(rng.integers(len(x)))] for p in range(n_parts)])
        centres = centres / np.maximum(np.sqrt((centres**2).sum(1, keepdims=True)), 1e-12)
    both = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])], axis=1)
    sizes = np.bincount(part, minlength=n_parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), n_parts), np.int32)
        np.add.at(votes, (both[0], part[both[1]]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[want[i]] < most:
                sizes[part[i]] -= 1
                sizes[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


def assign(scores: np.ndarray, most: int) -> np.ndarray:
    """Each row to its best part with room, those that have most to lose first."""
    order = np.argsort(-scores, axis=1)
    ranked = np.take_along_axis(scores, order, 1)
    part, room = np.full(len(scores), -1), np.full(scores.shape[1], most)
    for i in np.argsort(-(ranked[:, 0] - ranked[:, min(1, scores.shape[1] - 1)]), kind="stable"):
        for p in order[i]:
            if room[p]:
                part[i], room[p] = p, room[p] - 1
                break
    return part


class Router:
    """A classifier from unit vectors to partitions."""

    def __init__(self, dim: int, n_parts: int, hidden: int = 128, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 1 / np.sqrt(dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, n_parts)), np.zeros(n_parts)]

    def fit(self, x: np.ndarray, part: np.ndarray, epochs: int = 30, rate: float = 5e-3, seed: int = 2) -> Router:
        rng = np.random.default_rng(seed)
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                rows = order[lo : lo + 256]
                h = np.tanh(x[rows] * 8 @ self.p[0] + self.p[1])
                err = softmax(h @ self.p[2] + self.p[3])
                err[np.arange(len(rows)), part[rows]] -= 1
                err /= len(rows)
                back = err @ self.p[2].T * (1 - h * h)
                step += 1
                for i, d in enumerate((8 * x[rows].T @ back, back.sum(0), h.T @ err, err.sum(0))):
                    d = d + 1e-5 * self.p[i]
                    m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each row, most probable first."""
        return np.argsort(-(np.tanh(x * 8 @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]), axis=1, kind="stable")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_index(sample: np.ndarray, n_parts: int, probes: int | None, target: float, k: int) -> tuple[Router, int]:
    """The router and the number of partitions that a query probes."""
    x = unit(sample)
    n_parts = max(1, min(n_parts, len(x) // PART_SAMPLE))
    if n_parts == 1:
        return Router(x.shape[1], 1), 1
    graph = neighbour_graph(x, min(10, len(x) - 1))
    router = Router(x.shape[1], n_parts).fit(x, balanced_partition(x, graph, n_parts))
    if probes is None:
        order = router.order(x)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n_parts)[None, :], 1)
        near = neighbour_graph(x, min(k, len(x) - 1))
        place = np.take_along_axis(rank, order[near, 0], 1).ravel()  # the rank, for each vector, of its neighbours' partitions
        reach = np.cumsum(np.bincount(place, minlength=n_parts)) / len(place)
        probes = int(np.searchsorted(reach, target) + 1)
    return router, min(probes, n_parts)


def search(vectors: DataFrame, is_query: Column, k: int = 5, n_parts: int | None = None, probes: int | None = None, target: float = 0.96, sample_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Returns query_id, rank (from 1), the neighbour's id and score for each row for which ``is_query`` holds."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(usable).select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    n_parts = n_parts or parts_of(rows.count())
    sample_rows = max(sample_rows, PART_SAMPLE * n_parts)  # the bound of the sample: 32,768 for the most parts, unless more is asked for
    sample = [r["v"] for r in rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()]
    kind = vectors.schema[id_col].dataType.simpleString()
    if not sample:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    router, n_probes = fit_index(np.array([s for s in sample if len(s) == dim]), n_parts, probes, target, k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            order = router.order(unit(x))
            ask = batch.column(2).to_pylist()
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array(order[:, 0], pa.int32()), pa.array([o if q else None for o, q in zip(order[:, :n_probes].astype(np.int32), ask, strict=True)], pa.list_(pa.int32()))], ["id", "v", "part", "probes"])

    indexed = written(rows.where(F.size("v") == dim).mapInArrow(index, f"id {kind}, v binary, part int, probes array<int>"), "ann-index")
    asks = indexed.where("probes is not null").select("id", "v", F.explode("probes").alias("part"))
    per_part = indexed.groupBy("part").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("c_blocks"))  # a row for each partition
    per_ask = asks.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_blocks"))
    blocks = F.broadcast(per_part.join(per_ask, "part"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    candidates = indexed.select("id", "v", "part").join(blocks, "part").select("part", own("c_blocks").alias("c"), spread("q_blocks").alias("q"), F.lit(False).alias("ask"), "id", "v")
    queries = asks.join(blocks, "part").select("part", spread("c_blocks").alias("c"), own("q_blocks").alias("q"), F.lit(True).alias("ask"), "id", "v")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_blocks(batches):
            ask = block.column("ask").to_numpy()
            ids = block.column("id").to_numpy()
            x = np.frombuffer(b"".join(block.column("v").to_pylist()), np.float64).reshape(-1, dim)
            found = nearest(ids[ask], x[ask], ids[~ask], x[~ask], k)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "id", "score"])

    near = candidates.unionByName(queries).repartition("part", "c", "q").sortWithinPartitions("part", "c", "q").mapInArrow(rerank, f"query_id {kind}, id {kind}, score double")
    best = near.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (part, c, q) at a time, from batches that are sorted by them."""
    rest: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        p, c, q = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((p[1:] != p[:-1]) | (c[1:] != c[:-1]) | (q[1:] != q[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
            new = (p[lo], c[lo], q[lo])
            if rest and new != key:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(lo, hi - lo))
            key = new
    if rest:
        yield pa.Table.from_batches(rest)


def nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(query, candidate, cosine): the k nearest candidates with another id of each query in a block.

    A matrix product narrows the choice; scores and ties are decided on sums whose order
    does not depend on a row's place, so equal vectors have equal scores.
    """
    if not len(q) or not len(c):
        return None
    q, c = scaled(q), scaled(c)
    q_norm, c_norm = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    rough = (q / q_norm[:, None]) @ (c / c_norm[:, None]).T
    rough[q_ids[:, None] == c_ids[None, :]] = -np.inf
    repeats = np.unique(c_ids, return_counts=True)[1].max()
    take = min(k * int(repeats), rough.shape[1])
    bar = np.partition(rough, rough.shape[1] - take, axis=1)[:, rough.shape[1] - take]
    i, j = np.nonzero((rough >= bar[:, None] - 1e-9) & np.isfinite(rough))
    out = []
    for lo in range(0, len(i), 1 << 18):
        a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
        out.append((q[a] * c[b]).sum(1) / (q_norm[a] * c_norm[b]))
    score = np.concatenate(out) if out else np.zeros(0)
    order = np.lexsort((c_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    # The first k different ids of each query.
    keep, last, ids = np.zeros(len(i), bool), -1, set()
    for n, (a, b) in enumerate(zip(i.tolist(), c_ids[j].tolist(), strict=True)):
        if a != last:
            last, ids = a, set()
        if len(ids) < k and b not in ids:
            ids.add(b)
            keep[n] = True
    return q_ids[i[keep]], c_ids[j[keep]], score[keep]
