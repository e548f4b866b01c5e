"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and underscores, lower-cased. All n-word grams of a test item are
its seeds, however many documents hold them. A text that holds a seed is
aligned with the item around it: local alignment over words, +2 for a match, -1 for a
substitution, insertion or deletion. The similarity is the score over that of the whole item; from
``threshold`` on the text is contaminated. Copies with about a third of the words
edited are found. Windows that lack so many of the item's words that no alignment can reach the threshold are
not aligned; this bound loses nothing.

One pass over the texts and no shuffle. The test items are sent to the executors in
blocks of at most ``BLOCK_CHARS`` characters, so what is broadcast is bounded for any benchmark.

Edge cases: null and empty texts and items match nothing; an item with fewer than n words
is its own one seed; items with equal texts are all reported; a text that
repeats in rows is reported for each row; a document that holds an item several times is reported
once, at its best (first of equal) place; columns other than ids and texts are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
WORD = re.compile(r"\w+")
BLOCK_CHARS = 32_000_000
PAIRS = 2_000_000
MATCH, MISS = 2, -1


class Vocabulary(dict):
    """Word -> number, for the words of the items alone; any other word of a text is 0, which matches nothing."""

    def add(self, text: str | None) -> np.ndarray:
        words = lowered_words(text or "")
        return np.fromiter((self.setdefault(w, len(self) + 1) for w in words), U, len(words))

    def of(self, text: str | None) -> np.ndarray:
        words = lowered_words(text or "")
        return np.fromiter(map(self.get, words, repeat(0)), U, len(words))


def lowered_words(text: str) -> list[str]:
    """The words of a text, lower-cased, as many as WORD finds in it."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def grams(runs: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint for each row of ``width`` words."""
    with np.errstate(over="ignore"):
        out = runs[:, 0] + U(width)
        for i in range(1, width):
            out = (out ^ (out >> U(29))) * U(0x9E3779B97F4A7C15) + runs[:, i]
        return (out ^ (out >> U(32))) * U(0xD6E8FEB86659FD93)


@dataclass
class Seeds:
    """The grams of a block of items: sorted, with the (item, place) pairs of each."""

    ids: list
    words: list[np.ndarray]
    width: int
    vocabulary: Vocabulary

    def __post_init__(self) -> None:
        found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item, words in enumerate(self.words):
            w = min(self.width, len(words))
            if w:
                runs = words[np.arange(len(words) - w + 1)[:, None] + np.arange(w)]
                for place, g in enumerate(grams(runs, w).tolist()):
                    found[w][g].append((item, place))
        self.by_width = {w: np.array(sorted(x), U) for w, x in found.items()}
        #: The (item, place) pairs in the order of the grams, and where those of each gram begin.
        self.pairs = {w: np.array([pair for g in sorted(x) for pair in x[g]], np.int64) for w, x in found.items()}
        self.begins = {w: np.cumsum([0, *(len(x[g]) for g in sorted(x))]) for w, x in found.items()}
        self.lengths = np.array([len(x) for x in self.words], np.int64)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, places in the text, indexes of the grams); only runs of words that items have are looked up."""
        known = words != 0
        for w, keys in self.by_width.items():
            run = known[: len(known) - w + 1].copy()
            for i in range(1, min(w, len(known))):
                run &= known[i : len(known) - w + 1 + i]
            at = np.flatnonzero(run)
            if not len(at):
                continue
            g = grams(words[at[:, None] + np.arange(w)], w)
            i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            ok = keys[i] == g
            if ok.any():
                yield w, at[ok], i[ok]

    def diagonals(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in the text less place in the item) of all seeds, each once, in order."""
        span = len(words) + int(self.lengths.max(initial=0)) + 1
        shift = span - len(words)
        found = [np.zeros(0, np.int64)]
        for w, at, index in self.hits(words):
            begins, pairs = self.begins[w], self.pairs[w]
            sizes = begins[index + 1] - begins[index]
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(at):  # some million pairs at a time
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
                size = sizes[lo:hi]
                k = np.arange(size.sum()) + np.repeat(begins[index[lo:hi]] - (np.cumsum(size) - size), size)
                found.append(np.unique(pairs[k, 0] * span + np.repeat(at[lo:hi], size) - pairs[k, 1] + shift))
                lo = hi
        codes = np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]
        return codes // span, codes % span - shift

    def candidates(self, words: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(item, start, end): the windows of the text around its seeds that hold enough of the item's words."""
        items, found = self.diagonals(words)
        if not len(items):
            return []
        cut = np.flatnonzero((items[1:] != items[:-1]) | (found[1:] - found[:-1] > self.lengths[items[1:]] // 3 + 4)) + 1
        out = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(items)], strict=True):
            item = int(items[lo])
            n = len(self.words[item])
            slack = n // 3 + 4
            while lo < hi:
                first = int(found[lo])
                lo += int(np.searchsorted(found[lo:hi], first + 2 * n, side="right"))
                start, end = max(0, first - slack), min(len(words), int(found[lo - 1]) + n + slack)
                # At most the item's words that the window holds can match.
                if np.isin(self.words[item], words[start:end]).sum() / n >= threshold:
                    out.append((item, start, end))
        return out


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of many (item, window) pairs at once, and the window's word behind the best (first) end."""
    rows, cols = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), rows), U), np.ones((len(items), cols), U)
    real = np.zeros((len(items), cols), bool)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], b[k, : len(y)], real[k, : len(y)] = x, y, True
    length = np.array([len(x) for x in items])
    score = np.zeros((len(items), cols + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    ramp = -MISS * np.arange(cols, dtype=np.int32)
    for i in range(rows):
        same = (a[:, i, None] == b) & real
        new = np.maximum(score[:, :-1] + np.where(same, MATCH, MISS), score[:, 1:] + MISS)
        np.maximum(new, 0, out=new)
        new = (np.maximum.accumulate(new + ramp, axis=1) - ramp).astype(np.int32)
        new[i >= length] = 0
        score[:, 1:] = new
        top = new.argmax(1)
        value = new[np.arange(len(items)), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


def best_matches(seeds: Seeds, texts: list[np.ndarray], threshold: float) -> dict[int, list[tuple[int, float, int, int]]]:
    """For each contaminated text of a batch, by its place: (item, similarity, first word, word behind the last) of each item."""
    found = [(len(seeds.words[item]), k, item, start, end) for k, words in enumerate(texts) for item, start, end in seeds.candidates(words, threshold)]
    found.sort()
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    at = 0
    while at < len(found):
        most = found[at][0] * 5 // 4 + 8  # pairs of like sizes are aligned at once
        part = [f for f in found[at : at + max(1, min(512, 4_000_000 // (4 * most * most)))] if f[0] <= most]
        at += len(part)
        score, last = align([seeds.words[f[2]] for f in part], [texts[f[1]][f[3] : f[4]] for f in part])
        for (n, k, item, start, _), value, end in zip(part, score.tolist(), last.tolist(), strict=True):
            similarity = value / (MATCH * n)
            if similarity >= threshold and (similarity > best[k, item][0] if (k, item) in best else True):
                # Aligned backwards from its end, the match ends where it starts.
                _, back = align([seeds.words[item][::-1]], [texts[k][start : start + end][::-1]])
                best[k, item] = similarity, start + end - int(back[0]), start + end
    out: dict[int, list] = defaultdict(list)
    for (k, item), value in sorted(best.items()):
        out[k].append((item, *value))
    return out


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most some hundred texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            yield batch.slice(k, 512)


def item_blocks(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> Iterator[Seeds]:
    """The items in blocks of a bounded number of characters."""
    known = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // BLOCK_CHARS)
    for k in range(n_blocks):
        vocabulary = Vocabulary()
        rows = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).collect()  # about BLOCK_CHARS characters
        rows = sorted(rows, key=lambda r: (str(r["id"]), r["text"]))
        yield Seeds([r["id"] for r in rows], [vocabulary.add(r["text"]) for r in rows], width, vocabulary)


def find(docs: DataFrame, benchmark: DataFrame, width: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each contaminated document and item: both ids, similarity, n_words of the item, and the span in code points (start, end)."""
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"key {kinds[0].simpleString()}, item {kinds[1].simpleString()}, similarity double, n_words bigint, start bigint, end bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for seeds in item_blocks(benchmark, width, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(seeds)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in parts(batches):
                rows, items, values = [], [], []
                texts = batch.column(1)
                for k, found in best_matches(own, [own.vocabulary.of(t.as_py()) for t in texts], threshold).items():
                    spans = [m.span() for m in WORD.finditer(texts[k].as_py())]
                    for item, similarity, first, last in found:
                        rows.append(k)
                        items.append(own.ids[item])
                        values.append((similarity, len(own.words[item]), spans[first][0], spans[last - 1][1]))
                if rows:
                    a, n, s, e = zip(*values, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(items), pa.array(a, pa.float64()), *(pa.array(x, pa.int64()) for x in (n, s, e))], ["key", "item", "similarity", "n_words", "start", "end"])

        out = out.unionByName(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(work, schema))
    return out.withColumnsRenamed({"key": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 3, threshold: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    for seeds in item_blocks(benchmark, width, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(seeds)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in parts(batches):
                texts = batch.column(batch.schema.get_field_index(text_col))
                bad = best_matches(own, [own.vocabulary.of(t.as_py()) for t in texts], threshold)
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
