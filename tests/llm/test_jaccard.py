"""The n-gram Jaccard join against brute force."""

import random
import re

import pytest

from quillgraph.llm import jaccard_join as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, width, num, den):
    """n_shingles, component and links of each document, by comparing all pairs."""
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    up, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if every and den * both >= num * every:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i), links[i]) for i in ids}


def corpus(seed):
    """Near copies of many sizes, with shared passages, repeated words, and the odd empty text."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    shared = [word() for _ in range(30)]
    docs = []
    for base in range(14):
        n = rng.choice([1, 2, 3, 8, 12, 13, 14, 20, 25, 40, 90, 200])
        text = [f"{word()}{rng.randint(0, 40)}" for _ in range(n)] + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 25 if base == 3 else 6)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [f"x{rng.randint(0, 9)}"]
            docs.append((len(docs) * 3 + 1, (" " if rng.random() < 0.5 else "\n\t").join(copy).upper() if rng.random() < 0.1 else " ".join(copy)))
    return [*docs, (10_000, None), (10_001, ""), (10_002, " \n\t "), (10_003, "one"), (10_004, "ONE"), (10_005, "two words")]


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 8, 10), (1, 1, 2)])
def test_matches_brute_force(spark, width, num, den, monkeypatch):
    docs = corpus(width)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in J.join(frame, width, num, den).collect()}
    assert got == brute(docs, width, num, den)


def test_every_linked_pair_shares_enough_lists():
    """Both light subsets and heavy segments, over random pairs near the threshold."""
    rng = random.Random(4)
    import numpy as np

    for num, den in ((9, 10), (8, 10), (1, 2)):
        plan = J.Plan(num, den)
        assert J.light_bound(plan) >= 1
        hits = 0
        for _ in range(3000):
            n = rng.choice([3, 5, 9, 10, 11, 14, 19, 20, 28, 40, 77, 150])
            base = [rng.getrandbits(64) for _ in range(n)]
            other = base[: n - rng.randint(0, max(1, n // 5))] + [rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n // 5)))]
            a, b = np.unique(np.array(base, np.uint64)), np.unique(np.array(other, np.uint64))
            both = len(np.intersect1d(a, b))
            if both == len(a) == len(b) or den * both < num * (len(a) + len(b) - both):
                continue
            hits += 1
            common = len(np.intersect1d(J.signatures(a, plan), J.signatures(b, plan)))
            low, high = sorted((len(a), len(b)))
            need = 1
            if high > J.light_bound(plan):
                count, spare = plan.segments(*plan.interval(high))
                need = max(1, count - spare - plan.differ(low, high))
            assert common >= need, (num, low, high, both)
            x = J.folded([J.sketch(a, plan), J.sketch(b, plan)])
            assert J.may_link(x[:1], x[1:], np.array([len(a)]), np.array([len(b)]), plan)[0, 0]
        assert hits > 100


def test_large_groups_are_cut_in_blocks(spark, monkeypatch):
    """With tiny blocks, pairs of blocks give the same result."""
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "STAR_BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(120)] = f"y{rng.randint(0, 99)}"
        docs.append((i, " ".join(copy)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in J.join(frame, 3, 9, 10).collect()}
    assert got == brute(docs, 3, 9, 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_lists_and_leaders(spark, monkeypatch, seed):
    """With tiny blocks, tiny flushes and lists that are hot from four sets on, components are those of brute force, counted links or not."""
    for name, value in (("BLOCK", 8), ("STAR_BLOCK", 8), ("HOT", 3), ("FLUSH", 3000), ("OFFSETS", 64), ("STARS", 50), ("SHINGLES", 2000)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(seed)
    base, docs = [f"w{i}" for i in range(80)], []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(80)] = f"y{rng.randint(0, 99)}"
        docs.append((i, " ".join(copy)))
    docs += [(i, " ".join([f"q{i}x{k}" for k in range(20)] + base[:30])) for i in range(100, 140)]
    want = brute(docs, 3, 8, 10)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3, "doc_id")
    for links in (False, True):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(frame, 3, 8, 10, links=links).collect()}
        assert got == {k: v[:2] for k, v in want.items()}
    assert sorted(r["doc_id"] for r in J.deduplicate(frame, 3, 8, 10).collect()) == sorted({v[1] for v in want.values()})


def test_labels_that_do_not_settle_raise(spark, monkeypatch):
    monkeypatch.setattr(J, "ROUNDS", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    monkeypatch.setattr(J, "CONTRACT", 20)
    with pytest.raises(RuntimeError, match="rounds"):
        J.components(edges, "test-chain")


def test_search_compares_a_family_once(monkeypatch):
    """Near copies of one text take about one comparison a set, not one a pair."""
    import numpy as np

    plan, rng, asked = J.Plan(9, 10), np.random.default_rng(1), []
    base = rng.integers(1, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[3:], rng.integers(1, 1 << 63, 3).astype(np.uint64)])) for _ in range(400)]
    group = J.Sets(np.array([len(s) for s in sets]), [J.sketch(s, plan) for s in sets], sets, plan)
    near = group.near
    monkeypatch.setattr(group, "near", lambda v, others: (asked.append(len(others)), near(v, others))[1])
    found, reached = J.search(group)
    assert reached.all()
    assert len(found) == 399
    assert sum(asked) < 2 * 400


def test_odd_rows(spark):
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (7, "a b c d e f", None), (None, "a b c d e f", "z"), (9, None, "w")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, n_shingles string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.join(frame).collect()), key=str)
    assert got == sorted([(5, 4, 5), (5, 4, 5), (7, 4, 5), (None, 4, None), (9, 0, 9)], key=str)
    assert J.join(frame.limit(0)).count() == 0
    kept = J.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [5, 9, None]


def test_null_id_before_its_copy(spark):
    """A row without an id, met first in a task, does not take the lists of its class with it."""
    text = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(text)), (1, " ".join(text)), (2, " ".join([*text[:-1], "other"])), (None, " ".join(text))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = [(r["doc_id"], r["component_id"], r["n_links"]) for r in J.join(frame, 3, 9, 10).collect()]
    assert sorted(got, key=str) == sorted([(None, None, None), (1, 1, 1), (2, 1, 1), (None, None, None)], key=str)
    assert sorted((r["doc_id"] for r in J.deduplicate(frame).collect()), key=str) == [1, None, None]
