"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + 1/n sum_{i<j} <v_i, v_j> x_i x_j), where x_i says that
a hashed term occurs and n is how many terms with weights do (else the pairs of a long text drown all else). The pairwise part learns combinations (an insult with the
mention of a group) which additive weights miss. Terms are the words, A-Z and other
letters lower-cased and punctuation at both ends dropped, and the first four and five
letters of longer words, which stand for a stem with any ending.

Every term in at least ``least`` training rows has a weight and factors, however evenly it is spread over the
classes: a word may count in combination only. Linear weights are shrunk (L1), factors by L2.

Training takes at most ``sample_rows`` labelled documents, those with the smallest hash
of their id; of these a fifth is kept back to set the calibration, by which a score of
``threshold`` is the cut that errs least. Scoring takes whole texts, in one pass.

Edge cases: a null or empty text has no terms and gets the score of the bias; labels
that are null, or whose document is missing, are left out; without any label, or with
one class only, the score is the smoothed share of the positive class; repeated rows
are scored one by one; of the texts of one labelled id the least one is learnt from; columns other than the id and the
text are ignored; where all columns are kept, one that has the name of the score column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
STRIP = ".,;:!?\"'()[]{}<>|#*$%&~`_-«»„“”¿¡"
#: Words remembered by a worker at most.
CACHE = 300_000


def term_buckets(word: str) -> tuple[int, ...]:
    """The buckets of one white-space-delimited word."""
    core = word.strip(STRIP)
    if not core:
        return ()
    terms = [core] + [f"{core[:n]}\0" for n in (4, 5) if len(core) > n]
    return tuple(dict.fromkeys(xxhash.xxh3_64_intdigest(t) % BUCKETS for t in terms))


class Terms(dict):
    """Word -> its buckets among ``active`` (all, if None)."""

    def __init__(self, active: np.ndarray | None = None):
        super().__init__()
        self.active = active

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = term_buckets(word)
        if self.active is not None:
            found = tuple(b for b in found if self.active[b])
        if len(self) >= CACHE:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        """The distinct buckets of a whole text, in ascending order."""
        found = set(chain.from_iterable(map(self.__getitem__, set((text or "").lower().split()))))
        return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class FactorizationMachine:
    """Weights by bucket; ``scale`` and ``shift`` map the raw value to a calibrated logit."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias, np.float64)
        for i, row in enumerate(rows):
            if len(row):
                v = self.factors[row]
                s = v.sum(0, dtype=np.float64)
                out[i] += self.linear[row].sum(dtype=np.float64) + 0.5 * (s @ s - np.square(v, dtype=np.float64).sum()) / len(row)
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.clip(self.scale * self.raw(rows) + self.shift, -35, 35)
        return 1 / (1 + np.exp(-z))


def slopes(model: FactorizationMachine, rows: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The mean log loss's slope by the bias, the buckets of the rows (none empty), and the slopes by their linear weights and factors."""
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    v = model.factors[flat]
    sums = np.add.reduceat(v, starts, axis=0)
    pairs = 0.5 * (np.square(sums).sum(1) - np.add.reduceat(np.square(v).sum(1), starts)) / sizes
    z = np.clip(model.bias + np.add.reduceat(model.linear[flat], starts) + pairs, -35, 35)
    err = (1 / (1 + np.exp(-z)) - labels) / len(rows)
    ids, at = np.unique(flat, return_inverse=True)
    each = (err / sizes)[owner, None] * (sums[owner] - v)
    by_factor = np.stack([np.bincount(at, column, len(ids)) for column in each.T], axis=1)
    return float(err.sum()), ids, np.bincount(at, err[owner], len(ids)), by_factor


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    threshold: float = 0.7,
    rank: int = 8,
    epochs: int = 12,
    rate: float = 0.1,
    factor_rate: float = 0.5,
    l1: float = 2e-3,
    l2: float = 1e-3,
    least: int = 10,
    seed: int = 7,
) -> FactorizationMachine:
    """Trains by mini-batch Adagrad on the log loss, with an L1 step on linear weights; terms in fewer than ``least`` rows get no weight."""
    labels = np.asarray(labels, np.float64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, rank), np.float32))
    if len(labels) < 10 or labels.min() == labels.max():
        return model
    rng = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate(rows), minlength=BUCKETS) >= least
    rows = [r[seen[r]] for r in rows]
    order = rng.permutation(len(rows))
    held, own = order[: len(rows) // 5], order[len(rows) // 5 :]
    own = own[[len(rows[i]) > 0 for i in own]]
    active = np.flatnonzero(seen)
    model.factors[active] = rng.normal(0, 0.2, (len(active), rank))
    g_linear, g_factors, g_bias = np.full(BUCKETS, 1e-2, np.float32), np.full((BUCKETS, rank), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        rng.shuffle(own)
        for k in range(0, len(own), 64):
            part = own[k : k + 64]
            d_bias, ids, d_lin, d_fac = slopes(model, [rows[i] for i in part], labels[part])
            d_fac += l2 * model.factors[ids]
            g_linear[ids] += d_lin**2
            g_factors[ids] += d_fac**2
            step = rate / np.sqrt(g_linear[ids])
            moved = model.linear[ids] - step * d_lin
            model.linear[ids] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
            model.factors[ids] -= factor_rate * d_fac / np.sqrt(g_factors[ids])
            g_bias += d_bias**2
            model.bias -= rate * d_bias / np.sqrt(g_bias)
    calibrate(model, model.raw([rows[i] for i in held]), labels[held], threshold)
    return model


def calibrate(model: FactorizationMachine, raw: np.ndarray, labels: np.ndarray, threshold: float) -> None:
    """Shifts the logit so that the cut with the fewest errors on held rows (the middle of the best gap) scores ``threshold``."""
    if not len(raw) or labels.min() == labels.max():
        return
    order = np.argsort(raw, kind="stable")
    z, y = raw[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    errors[1:-1] += np.where(np.diff(z) > 0, 0, len(z))
    best = np.flatnonzero(errors == errors.min())
    model.shift = float(np.log(threshold / (1 - threshold)) - model.scale * cuts[best[len(best) // 2]])


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id column as ``key`` and the distinct buckets of each whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([terms.of(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], ["key", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(work, f"key {kind}, terms array<int>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", usable: Column | None = None, sample_rows: int = 8_000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """Fits on at most ``sample_rows`` labelled rows (those with the smallest hash of the id) among the ``usable``."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if usable is None else known.where(usable)
    known = known.groupBy(id_col).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    sample = docs.select(id_col, text_col).join(F.broadcast(known), id_col)  # bounded by sample_rows
    got = hashed(sample.select(F.struct(id_col, "label").alias("k"), text_col), "k", text_col).select("key.*", "terms").toPandas()
    got["terms"] = [tuple(t) for t in got["terms"]]
    got = got.sort_values([id_col, "terms"]).drop_duplicates(id_col)
    return fit([np.asarray(t, np.int32) for t in got["terms"]], got["label"].to_numpy(np.float64), threshold)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, score_col: str = "score") -> DataFrame:
    """Adds ``score_col`` to the id column, or to all columns if ``keep``."""
    active = np.flatnonzero(model.linear.astype(bool) | model.factors.any(1))
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.scale, model.shift, active, model.linear[active], model.factors[active]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, scale, shift, ids, linear, factors = sent.value
        full = np.zeros(BUCKETS, bool)
        full[ids] = True
        place = np.cumsum(full) - 1
        terms, own = Terms(full), FactorizationMachine(bias, linear, factors, scale, shift)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [place[terms.of(t.as_py())] for t in texts]
            columns = batch.columns if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own.score(found))], [*([f.name for f in batch.schema] if keep else [id_col]), score_col])

    rows = docs.drop(*({score_col} - {id_col, text_col})) if keep else docs.select(id_col, text_col)
    fields = rows.schema if keep else docs.select(id_col).schema
    schema = type(fields)([*fields.fields]).add(score_col, "double")
    return rows.mapInArrow(work, schema)
