"""PII: base patterns, and candidates that boosted trees judge.

``base_spans`` finds emails, ip addresses, card and phone numbers by fixed patterns, whole
and exact, in linear time. Beyond them, high-recall generators propose overlapping candidate
spans (values behind a key word, token-like strings, spelt-out emails, numbers in groups);
gradient-boosted trees score each by its format and context; per-kind thresholds,
calibrated on held-back rows, select the spans to redact, best first, without overlap with
each other or with a base span. Kinds of the method: secret, email_text, phone_local, id_number.

The trees are trained on the driver on rows that ``training_rows`` writes from a fixed seed: true values and
look-alikes (hashes in urls, version numbers, dates, plain words) in invented contexts.
Their number is a parameter, so training costs the same for any corpus.

Edge cases: null texts count as empty and have no spans; every row is judged by itself,
repeated ids included; texts of any length are read whole; columns other than the
id and the text are ignored (``redact`` keeps them all).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")

LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Every ip, card and phone match lies in one such region.
REGION = re.compile(r"[0-9+][0-9\x20().+-]*")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Found from each @ outwards: its domain to the right, the run of local characters to the left."""
    last, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
        if m and start < at:
            yield "email", start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind in the order of KINDS, then by start."""
    out = list(emails(text)) if "@" in text else []
    ips, cards, phones = [], [], []
    for region in REGION.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        part = region.group()
        if part.count(".") >= 3:
            ips += [("ip", a + m.start(), a + m.end()) for m in IP.finditer(part) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        if b - a >= 13:
            for m in CARD.finditer(part):
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    cards.append(("card", a + m.start(), a + m.end()))
        if "+" in part:
            phones += [("phone", a + m.start(), a + m.end()) for m in PHONE.finditer(part) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return out + ips + cards + phones


#: High-recall generators: kind and pattern; group 1 is the proposed span.
GENERATORS = (
    ("secret", re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)\b[\"']?\s{0,3}(?:[:=]|is|\s)\s{0,3}[\"']?([^\s\"',;<>]{6,}+)")),
    ("secret", re.compile(r"(?<![A-Za-z0-9/+_=-])([A-Za-z0-9/+_=-]{16,}+)")),
    ("email_text", re.compile(r"(?i)\b([a-z0-9._%+-]{1,64}\s?(?:\[|\(|\{|\s)\s?at\s?(?:\]|\)|\}|\s)\s?[a-z0-9-]{1,63}(?:\s?(?:\[|\(|\{|\s)\s?dot\s?(?:\]|\)|\}|\s)\s?[a-z0-9-]{2,63}){1,4})\b")),
    ("phone_local", re.compile(r"(?<![\w.+-])(\(?[0-9]{2,5}\)?[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,5}){0,3})(?![\w-]|\.[0-9])")),
    ("id_number", re.compile(r"(?<![\w.-])([0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![\w-])")),
)
#: Without one of these a text has no candidate of the kind: key words, digits or long strings.
QUICK = re.compile(r"(?i)pass|pwd|secret|token|key|auth|bearer|credential|[0-9]{2}|[A-Za-z0-9/+_=-]{16}|[\[({\s]at[\])}\s].{1,66}[\[({\s]dot[\])}\s]")
CONTEXT = ("pass", "pwd", "secret", "token", "key", "auth", "call", "tel", "phone", "mobile", "fax", "ssn", "social", "iban", "account", "mail", "contact", "version", "http", "commit", "sha", "page", "date", "isbn", "order")


def shape_features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    value = text[start:end]
    n = len(value)
    digits, upper, lower = sum(map(str.isdigit, value)), sum(map(str.isupper, value)), sum(map(str.islower, value))
    counts = Counter(value).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    hexa = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False)) / n
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    near = text[start - 1] if start else " "
    return [
        *(float(kind == k) for k in ("secret", "email_text", "phone_local", "id_number")),
        float(n), digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, entropy, hexa, switches, float(digits),
        float(value.startswith("AKIA")), float(len(counts)), float(near in "=:\"'"), float(near.isspace()), float("/" in before[-8:]), float(after[:1] in "\"'"),
        float(value.count("-")), float(value.count(".")), float(value.count(" ")), max(map(len, re.findall(r"[a-z]+", value.lower())), default=0),
        *(float(word in before) for word in CONTEXT),
    ]


def candidates(text: str) -> list[Span]:
    """All proposals, overlaps included."""
    if not QUICK.search(text):
        return []
    return sorted({(kind, *m.span(1)) for kind, pattern in GENERATORS for m in pattern.finditer(text)}, key=lambda s: (s[1], s[2], s[0]))


class BoostedTrees:
    """Gradient boosting of depth-3 trees on the log loss, over quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            z += self.grow(binned, y - p, p * (1 - p))
        return self

    def grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """Adds a complete tree: node k has the children 2k+1 and 2k+2."""
        inner = 2**self.depth - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**self.depth)
        node = np.zeros(len(grad), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, 0, None)
            g_all, h_all = grad[rows].sum(), hess[rows].sum()
            for f in range(binned.shape[1]) if len(rows) > 3 else ():
                size = len(self.edges[f]) + 1
                if size < 2:
                    continue
                g = np.cumsum(np.bincount(binned[rows, f], grad[rows], size))[:-1]
                h = np.cumsum(np.bincount(binned[rows, f], hess[rows], size))[:-1]
                gain = g**2 / (h + self.l2) + (g_all - g) ** 2 / (h_all - h + self.l2) - g_all**2 / (h_all + self.l2)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (gain[b], f, b)
            _, feature[k], b = best
            if b is not None:
                cut[k] = self.edges[feature[k]][b]
                right = binned[rows, feature[k]] > b
            else:
                right = np.zeros(len(rows), bool)
            node[rows] = 2 * k + 1 + right
        at = node - inner
        g, h = np.bincount(at, grad, len(leaf)), np.bincount(at, hess, len(leaf))
        leaf = self.rate * g / (h + self.l2)
        self.trees.append((feature, cut, leaf))
        return leaf[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def training_rows(n: int, seed: int = 11) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """Short invented texts with the spans that are to be found in each."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    word = lambda: draw(["an", "er", "th", "on", "re", "ti", "es", "or", "de", "la", "que", "en", "ung", "sch", "é", "os"], int(rng.integers(1, 6)))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    num = lambda k: draw("0123456789", k)
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    true = (
        lambda: ("secret", f"{pick(['password', 'pwd', 'passwd', 'Password'])}{pick(['=', ': ', ' = ', '='])}", draw(pick([hexa, mixed]), int(rng.integers(8, 24))), ""),
        lambda: ("secret", f'{pick(["token", "api_key", "secret", "api-key", "auth"])}{pick([" = ", "=", ": "])}"', draw(pick([hexa, mixed]), int(rng.integers(16, 48))), '"'),
        lambda: ("secret", pick(["", "key ", "id "]), "AKIA" + draw(upper, 16), ""),
        lambda: ("secret", "", pick(["ghp_", "sk_live_", "xoxb-"]) + draw(mixed, 30), ""),
        lambda: ("email_text", pick(["contact ", "mail ", ""]), f"{word()}{pick([' at ', ' [at] ', ' (at) '])}{word()}{pick([' dot ', ' [dot] ', ' (dot) '])}{pick(['com', 'org', 'net'])}", ""),
        lambda: ("phone_local", pick(["call ", "tel ", "phone: ", "tel. ", ""]), f"({num(3)}) {num(3)}-{num(4)}", ""),
        lambda: ("phone_local", pick(["call ", "mobile ", "phone: "]), f"{num(3)}{pick(['-', '.', ' '])}{num(3)}{pick(['-', '.', ' '])}{num(4)}", ""),
        lambda: ("id_number", pick(["ssn ", "SSN: ", ""]), f"{num(3)}-{num(2)}-{num(4)}", ""),
        lambda: ("secret", f"{pick(['password', 'passphrase', 'Password', 'pwd'])}{pick([': ', '=', ' is '])}", word() + word() + num(int(rng.integers(1, 4))), ""),
        lambda: ("id_number", pick(["iban ", "IBAN: ", ""]), f"{pick(['DE', 'FR', 'ES'])}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", ""),
    )
    false = (
        lambda: ("", "", word() + word() + word() + word() + word(), ""),
        lambda: ("", "", f"{word()}-{word()}-{word()}-{word()}", ""),
        lambda: ("", "https://", f"{word()}.example.com/{word()}{word()}/{word()}{word()}", ""),
        lambda: ("", pick(["commit ", "sha256 "]), draw(hexa, pick([40, 64])), ""),
        lambda: ("", pick(["token ", "password ", "the key ", "secret ", "auth "]), f"{word()}{word()}{word()}", ""),
        lambda: ("", pick(["page ", "version ", "order ", "isbn "]), f"{num(2)} {num(2)} {num(2)}", ""),
        lambda: ("", pick(["date ", "", "on "]), f"20{num(2)}-{num(2)}-{num(2)}", ""),
        lambda: ("", pick(["", "from "]), f"{num(4)} {num(4)}", ""),
        lambda: ("", "", pick(["=", "-", "_"]) * int(rng.integers(16, 40)), ""),
        lambda: ("", "", f"{word()} at {word()} {word()} dot", ""),
        lambda: ("", "", pick(upper) * int(rng.integers(16, 30)), ""),
        lambda: ("", "", (word() + word() + word() + word() + word() + word()).upper(), pick(["!!", "", "."])),
        lambda: ("", "", (word() + word() + word() + word() + word() + word()).capitalize(), ""),
        lambda: ("", pick(["token ", "password ", "secret "]), (word() + word()).upper(), ""),
        lambda: ("", pick(["password: ", "secret = ", "token is ", "auth: "]), word() + word(), ""),
        lambda: ("", pick(["token ", "secret ", "pass "]), word() + num(int(rng.integers(1, 3))) + word(), ""),
        lambda: ("", pick(["at ", "", "time "]), f"20{num(2)}-{num(2)}-{num(2)}T{num(2)}:{num(2)}:{num(2)}", ""),
        lambda: ("", pick(["", "total ", "costs "]), f"{num(2)} {num(3)} {num(3)}", pick([" km", " EUR", ""])),
        lambda: ("", pick(["at ", "", "point "]), f"{num(2)}.{num(4)} {num(3)}.{num(4)}", ""),
        lambda: ("", "", f"{word()}_{word()}_{word()}_{word()}{num(2)}", ""),
        lambda: ("", "", f"{num(4)}-{num(4)}-{num(3)}{pick('0123456789X')}", ""),
    )
    for _ in range(n):
        text, spans = words(0, 8), set()
        for _ in range(int(rng.integers(1, 4))):
            kind, lead, value, tail = pick(true if rng.random() < 0.5 else false)()
            text += pick([" ", "\n", " "]) + lead
            if kind:
                spans.add((kind, len(text), len(text) + len(value)))
            text += value + tail + pick([" ", ". ", ", ", "\n"]) + words(0, 8)
        yield text, spans


class Model:
    """Boosted trees and a threshold for each kind."""

    def __init__(self, n_rows: int = 3000, seed: int = 11, precision: float = 0.98):
        x, y, kinds = [], [], []
        for text, spans in training_rows(n_rows, seed):
            for kind, a, b in candidates(text):
                x.append(shape_features(text, kind, a, b))
                y.append(float((kind, a, b) in spans))
                kinds.append(kind)
        x, y, kinds = np.array(x), np.array(y), np.array(kinds)
        cut = len(y) * 3 // 4
        self.trees = BoostedTrees().fit(x[:cut], y[:cut])
        held, own = self.trees.score(x[cut:]), y[cut:]
        self.thresholds = {kind: precise_from(held[kinds[cut:] == kind], own[kinds[cut:] == kind], precision) for kind in dict(GENERATORS)}

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The candidates selected beside the base spans: the best first, none overlapping."""
        found = candidates(text)
        taken = Taken(base)
        found = [s for s in found if taken.free(s[1], s[2])]
        if not found:
            return []
        scores = self.trees.score(np.array([shape_features(text, *s) for s in found]))
        out: list[Span] = []
        for i in sorted(range(len(found)), key=lambda i: (-scores[i], found[i])):
            kind, a, b = found[i]
            if scores[i] >= self.thresholds[kind] and taken.free(a, b):
                out.append(found[i])
                taken.add(a, b)
        return out


def precise_from(scores: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The threshold for a kind: the middle of the gap below the lowest score from which on the held-back rows reach the precision, 1 if none does."""
    order = np.argsort(-scores, kind="stable")
    s, t = scores[order], truth[order]
    last = np.append(s[1:] < s[:-1], True)  # equal scores go together
    enough = np.flatnonzero((np.cumsum(t) / np.arange(1, len(t) + 1) >= precision) & last)
    if not len(enough):
        return 1.0
    k = int(enough[-1])
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


class Taken:
    """Disjoint intervals in the order of the text; each question and addition takes a binary search."""

    def __init__(self, spans: list[Span]):
        self.ends: list[int] = []
        self.starts: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):  # those of base spans that overlap become one
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k == len(self.starts) or self.starts[k] >= b

    def add(self, a: int, b: int) -> None:
        k = bisect_right(self.ends, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


@lru_cache(maxsize=4)
def trained(n_rows: int) -> Model:
    return Model(n_rows)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def all_spans(base: list[Span], added: list[Span]) -> list[Span]:
    return base + sorted(added, key=lambda s: (s[0], s[1], s[2]))


def find(docs: DataFrame, training: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id column, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(training))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            counts, digests, spans, n_added = [[] for _ in KINDS], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                added = model.added(text, base)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_spans(base, added)))
                n_added.append(len(added))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), pa.array(n_added, pa.int64())], ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(work, f"key {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
    return out.withColumnRenamed("key", id_col)


def redact(docs: DataFrame, training: int = 3000, text_col: str = "text") -> DataFrame:
    """All rows and columns, each span of the text replaced by its kind in brackets (``[email]``); null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(training))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t.as_py() is None else redacted(t.as_py(), model) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(work, docs.schema)


def redacted(text: str, model: Model) -> str:
    """Spans of different kinds that overlap become one, under the kind that starts first."""
    base = base_spans(text)
    out, last = [], 0
    for kind, a, b in sorted(base + model.added(text, base), key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text
