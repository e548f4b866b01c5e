"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``WINDOW`` words. Each passage is encoded as a vector
of word-shape, repetition and symbol rates, which a tanh layer maps to h. Gated
attention weighs the passages, a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))), and the
score is the sigmoid of a linear map of sum_k a_k h_k. Only documents have labels; the
weights of the passages are learnt from these.

Training takes at most ``sample_rows`` labelled documents, those with the smallest hash
of their id, a fifth of them kept back for the calibration, by which a score of
``threshold`` is the cut that errs least. Scoring takes whole texts, in one pass.

Edge cases: a null or empty text is a bag with one all-zero passage; labels that are
null, or whose document is missing, are left out; without any label, or with one class
only, the score is the smoothed share of class 1; repeated rows are scored one by one;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 50
#: Words remembered by a worker at most.
CACHE = 300_000
N_WORD, N_PASSAGE = 10, 14


def word_shape(word: str) -> tuple[float, ...]:
    letters = sum(map(str.isalpha, word))
    n = len(word)
    symbols = n - letters - sum(map(str.isdigit, word)) - word.count(".") - word.count(",")
    return (
        min(n, 40) / 10,
        float(letters > 1 and word.isupper()),
        float(word[0].isupper() and not word.isupper()),
        float(symbols > 0),
        min(symbols, 10) / n,
        float(word[-1] in ".!?"),
        float(letters < n and any(map(str.isdigit, word))),
        float(letters == 0),
        letters / n,
        float(n <= 3),
    )


class Words(dict):
    """Word -> row of a table of shapes."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1024, N_WORD))

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = word_shape(word)
        return n

    def passages(self, text: str | None) -> np.ndarray:
        """The encoded passages of a whole text, at least one."""
        words = (text or "").split()
        n = len(words)
        if not n:
            return np.zeros((1, N_PASSAGE), np.float32)
        ids = np.fromiter(map(self.__getitem__, words), np.int64, n)
        starts = np.arange(0, n, WINDOW)
        sizes = np.diff(np.append(starts, n))[:, None]
        means = np.add.reduceat(self.table[ids], starts, axis=0) / sizes
        owner = np.arange(n) // WINDOW
        keys = np.sort(owner << 40 | ids)
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        distinct = np.bincount(keys[first] >> 40, minlength=len(starts))[:, None] / sizes
        again = np.concatenate([[0.0], ids[1:] == ids[:-1]])
        again = np.add.reduceat(again, starts)[:, None] / sizes
        if len(self) > CACHE:
            self.clear()
        return np.concatenate([means, distinct, again, np.log1p(sizes) / 4, np.full_like(distinct, np.log1p(len(starts)) / 4)], axis=1).astype(np.float32)


class AttentionMIL:
    """Weights of the encoder, the gated attention and the output."""

    def __init__(self, hidden: int = 16, attention: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.std = np.zeros(N_PASSAGE), np.ones(N_PASSAGE)
        self.p = {"E": draw(N_PASSAGE, hidden), "e": np.zeros(hidden), "V": draw(hidden, attention), "U": draw(hidden, attention), "w": draw(attention), "o": draw(hidden), "b": np.zeros(1)}
        self.shift = 0.0

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of the bags whose passages begin at ``starts`` in ``x``."""
        p = self.p
        z = (x - self.mean) / self.std
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        s = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = s / np.repeat(np.add.reduceat(s, starts), sizes)
        bag = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return bag @ p["o"] + p["b"][0], {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "sizes": sizes}

    def backward(self, c: dict, err: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        d_bag = np.repeat(err[:, None] * p["o"], c["sizes"], axis=0)
        d_a = (d_bag * c["h"]).sum(1)
        d_s = c["a"] * (d_a - np.repeat(np.add.reduceat(c["a"] * d_a, starts), c["sizes"]))
        d_t, d_g = d_s[:, None] * p["w"] * c["g"], d_s[:, None] * p["w"] * c["t"]
        d_v, d_u = d_t * (1 - c["t"] ** 2), d_g * c["g"] * (1 - c["g"])
        d_h = c["a"][:, None] * d_bag + d_v @ p["V"].T + d_u @ p["U"].T
        d_e = d_h * (1 - c["h"] ** 2)
        return {"E": c["z"].T @ d_e, "e": d_e.sum(0), "V": c["h"].T @ d_v, "U": c["h"].T @ d_u, "w": (c["t"] * c["g"]).T @ d_s, "o": c["bag"].T @ err, "b": err.sum(keepdims=True)}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        z, _ = self.forward(np.concatenate(bags), starts)
        return 1 / (1 + np.exp(-np.clip(z + self.shift, -35, 35)))


def fit(bags: list[np.ndarray], labels: np.ndarray, threshold: float = 0.3, epochs: int = 30, rate: float = 0.01, l2: float = 1e-4, seed: int = 5) -> AttentionMIL:
    """Trains by Adam on the log loss, both classes weighing the same."""
    labels = np.asarray(labels, np.float64)
    model = AttentionMIL(seed=seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(labels) < 10 or labels.min() == labels.max():
        model.p["o"][:], model.p["b"][:] = 0, np.log(share / (1 - share))
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held, own = order[: len(bags) // 5], order[len(bags) // 5 :]
    every = np.concatenate([bags[i] for i in own])
    model.mean, model.std = every.mean(0, dtype=np.float64), every.std(0, dtype=np.float64) + 1e-3
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    m, v, step = {k: np.zeros_like(x) for k, x in model.p.items()}, {k: np.zeros_like(x) for k, x in model.p.items()}, 0
    for epoch in range(epochs):
        rng.shuffle(own)
        for k in range(0, len(own), 128):
            part = own[k : k + 128]
            starts = np.cumsum([0] + [len(bags[i]) for i in part[:-1]])
            z, cache = model.forward(np.concatenate([bags[i] for i in part]), starts)
            err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[part]) * weight[part] / len(part)
            step += 1
            for name, d in model.backward(cache, err, starts).items():
                d = d + l2 * model.p[name]
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.999 * v[name] + 0.001 * d * d
                model.p[name] = model.p[name] - rate * (0.5 if epoch > epochs * 0.7 else 1) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    starts = np.cumsum([0] + [len(bags[i]) for i in held[:-1]])
    z, _ = model.forward(np.concatenate([bags[i] for i in held]), starts)
    model.shift = float(np.log(threshold / (1 - threshold)) - best_cut(z, labels[held]))
    return model


def best_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors, in the middle of the widest run of such cuts; log odds 0.3 : 0.7 without two classes."""
    if not len(z) or labels.min() == labels.max():
        return float(np.log(0.3 / 0.7))
    order = np.argsort(z, kind="stable")
    z, y = z[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    errors[1:-1] += np.where(np.diff(z) > 0, 0, len(z))
    best = np.flatnonzero(errors == errors.min())
    return float(cuts[best[len(best) // 2]])


def bags_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id column as ``key`` and the passages of each whole text, flat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words.passages(t.as_py()).ravel() for t in batch.column(1)], pa.list_(pa.float32()))], ["key", "bag"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(work, f"key {kind}, bag array<float>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None, sample_rows: int = 12_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> AttentionMIL:
    """Fits on at most ``sample_rows`` labelled rows (those with the smallest hash of the id) among the ``usable``."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if usable is None else known.where(usable)
    known = known.groupBy(id_col).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    sample = docs.select(id_col, text_col).join(F.broadcast(known), id_col)  # bounded by sample_rows
    got = bags_of(sample.select(F.struct(id_col, "label").alias("k"), text_col), "k", text_col).select("key.*", "bag").toPandas()
    got = got.sort_values(id_col, kind="stable").drop_duplicates(id_col)
    return fit([np.asarray(b, np.float32).reshape(-1, N_PASSAGE) for b in got["bag"]], got["label"].to_numpy(np.float64), threshold)


def score(docs: DataFrame, model: AttentionMIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id column and ``score`` for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score([words.passages(t.as_py()) for t in batch.column(1)]))], ["key", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(work, f"key {kind}, score double").withColumnRenamed("key", id_col)
