import random
import re

from lodestack.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(text, items, window=13):
    own, hit, seen = words(text), set(), set()
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    seen.add(str(k))
    return len(own), len(hit), sorted(seen)


def test_against_brute_force(spark, odd, none):
    r = random.Random(1)
    alphabet = ["aa", "b", "Cc", "é", "d1"]
    items = [(k, " ".join(r.choice(alphabet) for _ in range(n))) for k, n in enumerate([1, 3, 13, 14, 20, 5])] + [(6, None), (7, "--"), (None, "aa"), (1, "b b b b")]
    docs = [(k, ("-" if k % 2 else " ").join(r.choice([*alphabet, "zz", "y"]) for _ in range(r.randint(0, 60)))) for k in range(60)]
    docs += [(100 + k, "zz, " + t + "! zz") for k, (_, t) in enumerate(items) if t]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = {k: brute(t, [x for x in items if x[0] is not None]) for k, t in docs}
    for size in (1 << 20, 60):  # one automaton, then several blocks
        got = {x["key"]: (x["n_words"], x["n_hit"], x["items"]) for x in d.find_hits(df, bench, block_bytes=size).collect()}
        assert got == expected
    for x in d.find_hits(df, bench).collect():
        text = dict(docs)[x["key"]]
        assert sum(len(words(text[s["start"] : s["end"]])) for s in x["spans"]) == x["n_hit"]
    got = d.decontaminate(odd, bench).collect()
    assert len(got) == odd.count() and d.decontaminate(none, bench).count() == 0
    assert not any(x["contaminated"] for x in d.decontaminate(odd, bench.limit(0)).collect())


def test_share(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three " + "x " * 57), (2, "one two three " + "x " * 58), (3, "one, TWO\nthree")], "doc_id long, text string")
    assert {x["doc_id"]: x["contaminated"] for x in d.decontaminate(docs, bench).collect()} == {1: True, 2: False, 3: True}
