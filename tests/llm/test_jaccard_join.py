import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import jaccard_join as j
from lodestack.llm.components import components

LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, words=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    ids = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            ids[root(k)] = min(key, ids.get(root(k), key))
    return sorted(((key, len(sets[k]), ids.get(root(k)) if sets[k] else key) for k, (key, _) in enumerate(rows)), key=repr)


def corpus(seed):
    """Random texts, chains and groups of near copies, shared passages, short and empty texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 400)}"
    passage = [word() for _ in range(50)]
    texts = []
    for _ in range(40):
        base = [word() for _ in range(r.choice([1, 2, 3, 4, 5, 8, 30, 60, 200]))]
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            base = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                base[r.randrange(len(base))] = word()
            texts.append(base)
    for _ in range(50):
        texts.append([word() for _ in range(r.randint(0, 12))] + passage + [word() for _ in range(r.randint(0, 30))])
    return [(k, " ".join(t)) for k, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One TWO"), (9004, "one two")]


@pytest.mark.parametrize(("seed", "heavy", "block"), [(1, 64, 1024), (2, 3, 1024), (3, 2, 4)])
def test_against_all_pairs(spark, monkeypatch, seed, heavy, block):
    """With low limits common elements, dense nodes and tiles of several blocks are met on a small table."""
    monkeypatch.setattr(j, "HEAVY", heavy)
    monkeypatch.setattr(j, "BLOCK", block)
    rows = corpus(seed)
    got = j.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_a_large_group_that_misses_the_threshold_by_a_little(spark, monkeypatch):
    """300 near copies of one text, most pairs of which just don't link, and whole copies of some."""
    monkeypatch.setattr(j, "HEAVY", 16)
    r = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(300):
        own = list(base)
        for _ in range(r.choice([1, 3, 5, 6, 7])):
            own[r.randrange(len(own))] = f"e{r.randint(0, 10**6)}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 300, 7)]
    got = j.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_sets_whose_names_collide(spark, monkeypatch):
    monkeypatch.setattr(j, "NAME_BYTES", 2)
    rows = [(k, f"{k} one two three four five six") for k in range(600)] + [(600, "7 one two three four five six")]
    got = j.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert {r["component_id"] for r in got.where("doc_id in (7, 600)").collect()} == {7}


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, j.jaccard_join(odd).collect()), key=repr) == brute(rows)
    assert j.jaccard_join(none).count() == 0


def test_bound_never_cuts_a_link():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[r.random(len(a)) < 0.8], r.integers(0, 1 << 62, int(r.integers(1, 60))).astype(np.uint64))))
        x, y = j.bitmap(a), j.bitmap(b)
        width = min(len(x), len(y))
        assert j._bound(len(a), len(b), j.fold(x, width), j.fold(y, width)) >= len(np.intersect1d(a, b))


def test_shingles_of_long_words_and_pieces():
    texts = ["a b c d e", "A  b\tc d\ne", "x" * 300_000 + " b c d", None, "a b"]
    got = list(j.shingle_sets(pa.array(texts)))
    assert [len(s) for s in got] == [2, 2, 1, 0, 1] and (got[0] == got[1]).all()


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (12, 11), (7, 7), (None, 1), (5, 4)] + [(100 + k, 200) for k in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), 10: 10, 11: 10, 12: 10, 7: 7, **dict.fromkeys(range(100, 150), 100), 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_within_components_are_counted(spark, monkeypatch, odd):
    """Every link of all pairs of rows, in groups of near copies, with tiles of several blocks."""
    monkeypatch.setattr(j, "HEAVY", 2)
    monkeypatch.setattr(j, "BLOCK", 4)
    for rows, df in ((corpus(3), None), ([(r["doc_id"], r["text"]) for r in odd.collect()], odd)):
        sets = []
        for _, t in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
            sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
        n = [sum(b != a and 100 * len(x & y) >= 85 * len(x | y) for b, y in enumerate(sets) if x and y) for a, x in enumerate(sets)]
        want = sorted(((*row, k) for row, k in zip(brute_in_order(rows), n, strict=True)), key=repr)
        df = df or spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, j.jaccard_links(df).collect()), key=repr) == want


def brute_in_order(rows):
    """The rows of `brute` in the order of the input, by numbers in place of keys."""
    numbered = brute([(k, t) for k, (_, t) in enumerate(rows)])
    group = {k: c for k, _, c in numbered}
    size = {k: n for k, n, _ in numbered}
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[group[k]] = min(key, least.get(group[k], key))
    return [(key, size[k], least.get(group[k]) if size[k] else key) for k, (key, _) in enumerate(rows)]
