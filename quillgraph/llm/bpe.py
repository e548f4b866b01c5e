"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

``rank_queue_merge`` keeps, for every merge rank, a bucket with the linked-list
positions whose pair has this rank, and a two-level bitmap of the ranks whose
bucket holds anything. Find-first-set on the bitmap gives the next rank in
constant time; entries whose pair has changed since they were queued are skipped
when they come up. A pre-token of n bytes takes O(n log n), so very long
pre-tokens (no white space for megabytes) stay cheap, where a rescan of all pairs
after each merge would be quadratic.

Edge cases: null texts count as empty; empty texts have no ids (n_tokens 0, both
digests those of no bytes); every row gives one row, repeated ids included;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens handled at once; a text of any length is worked through in such steps.
STEP = 1 << 16
#: Pre-tokens up to this many characters are remembered: at most CACHE recent ones and as many of the generation before.
SHORT, CACHE = 48, 300_000


def load_ranks(path: str) -> list[bytes]:
    """The bytes of every id, from a file of "base64 rank" lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for word, rank in pairs:
        tokens[int(rank)] = base64.b64decode(word)
    return tokens


class RankQueue:
    """Positions by rank, smallest rank first; within a rank, smallest position first.

    Two bitmap levels of SPAN bits a word: bit r of ``low`` is set where the bucket
    of rank r holds anything, a bit of ``top`` where a word of ``low`` is not zero.
    """

    __slots__ = ("buckets", "low", "top")
    SHIFT = 8

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> self.SHIFT) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 8
        self.low[word] |= 1 << (rank & 255)
        self.top |= 1 << word

    def pop(self) -> tuple[int, int]:
        """The next (rank, position); call it only while ``top`` is not zero."""
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.low[word]
        first = bits & -bits
        rank = (word << 8) + first.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[word] = bits = bits ^ first
        if not bits:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Memo(dict):
    """Pre-token -> ids: a dictionary, so that a known one costs a plain lookup, with one older generation behind it."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge
        self.older: dict[str, tuple[int, ...]] = {}

    def trim(self) -> None:
        """Lets go of the older generation, as workers live on after a task."""
        self.older = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = tuple(self.merge(word.encode("utf-8")))
        if len(word) <= SHORT:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class BytePairCodec:
    """Encodes and decodes by a list of token bytes, whose index is both id and merge rank."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks = {token: i for i, token in enumerate(tokens)}
        self.byte_id = [self.ranks[bytes([b])] for b in range(256)]
        self.findall = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self.queue = RankQueue(len(tokens))
        self.pairs: dict[tuple[int, int], int] = {}
        self.known = Memo(self.rank_queue_merge)

    def pair_rank(self, left: int, right: int) -> int:
        """The rank at which two adjacent ids merge, or -1."""
        rank = self.pairs.get((left, right))
        if rank is None:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
            if len(self.pairs) >= 400_000:
                self.pairs.clear()
            self.pairs[left, right] = rank
        return rank

    def rank_queue_merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pair_rank, queue = self.pair_rank, self.queue
        pairs, push, pop = self.pairs, queue.push, queue.pop
        ids = list(map(self.byte_id.__getitem__, piece))
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queued = [-1] * n
        for i in range(n - 1):
            rank = pairs.get((ids[i], ids[i + 1]))
            if rank is None:
                rank = pair_rank(ids[i], ids[i + 1])
            if rank >= 0:
                queued[i] = rank
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if queued[i] != rank:
                continue  # stale: its pair has changed, or it went into a merge
            j = after[i]
            ids[i] = rank
            ids[j] = queued[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = pairs.get((rank, ids[k]))
                if right is None:
                    right = pair_rank(rank, ids[k])
                queued[i] = right
                if right >= 0:
                    push(right, i)
            else:
                queued[i] = -1
            h = before[i]
            if h >= 0:
                left = pairs.get((ids[h], rank))
                if left is None:
                    left = pair_rank(ids[h], rank)
                queued[h] = left
                if left >= 0:
                    push(left, h)
        return [i for i in ids if i >= 0]

    def encode_steps(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a bounded number of pre-tokens at a time."""
        get = self.known.__getitem__
        if len(text) <= STEP:
            yield list(chain.from_iterable(map(get, self.findall(text))))
            return
        found = (m.group() for m in self.finditer(text))
        while step := list(islice(found, STEP)):
            yield list(chain.from_iterable(map(get, step)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_steps(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], tuple[BytePairCodec, list[str]]] = {}


def codec(path: str, pattern: str) -> tuple[BytePairCodec, list[str]]:
    """One codec and the decimal text of each id, kept for the life of a Python worker."""
    if (path, pattern) not in _codecs:
        tokens = load_ranks(path)
        _codecs[path, pattern] = BytePairCodec(tokens, pattern), list(map(str, range(len(tokens))))
    return _codecs[path, pattern]


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator's own output: the id column and ``ids array<int>``, in one pass without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])
        own.known.trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(work, f"key {kind}, ids array<int>").withColumnRenamed("key", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids again, and returns the id column, n_tokens, ids_sha256 and decoded_sha256.

    The digests are built a step at a time, so neither the ids nor the decoded bytes
    of a very long text are ever held as a whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, decimal = codec(path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1):
                n, a, b, comma = 0, hashlib.sha256(), hashlib.sha256(), ""
                for ids in own.encode_steps(text.as_py() or ""):
                    if ids:
                        a.update((comma + ",".join(map(decimal.__getitem__, ids))).encode())
                        b.update(own.decode(ids))
                        n, comma = n + len(ids), ","
                counts.append(n)
                encoded.append(a.hexdigest())
                decoded.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.known.trim()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(work, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", id_col)
