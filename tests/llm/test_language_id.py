import zlib

import numpy as np

from lodestack.llm import language_id as g

TEXTS = {"en": ["the cat sat on the mat and the dog"], "xx": ["zug zwei drei und vier katzen"]}


def longest_pieces(text, training):
    s, n = f" {text} ", 0
    for at in range(0, len(s), g.BLOCK):
        block, i = s[at : at + g.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j <= len(block) and any(block[i:j] in t for t in training):
                j += 1
            i = max(i + 1, j - 1)
            n += 1
    return n


def test_pieces_against_brute_force():
    r = np.random.default_rng(3)
    training = {k: ["".join(r.choice(list("ab cdé"), 200)), "".join(r.choice(list("ab ce"), 80))] for k in ("p", "q")}
    model = g.Model(training)
    texts = [g.normal("".join(r.choice(list("ab cdeé1"), n))) for n in (1, 5, 100, 254, 255, 256, 700, 3000)]
    for text, row in zip(texts, model.pieces(texts), strict=True):
        assert row.tolist() == [longest_pieces(text, [f" {g.normal(x)} " for x in training[k]]) if text else 0 for k in ("p", "q")]


def test_automaton_spells_every_substring():
    s = [1, 2, 1, 1, 2, 3, 1, 2, 1, 1]
    a = g.SuffixAutomaton(s, 4)
    subs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for x in [*subs, (3, 3), (2, 2), (1, 1, 1)]:
        state = 1
        for c in x:
            state = int(a.after(np.array([state]), np.array([c]))[0]) if state else 0
        assert bool(state) == (x in subs)


def test_many_characters_take_no_more_room():
    """An alphabet of 20,000 characters: the table follows the transitions alone."""
    r = np.random.default_rng(4)
    s = r.integers(1, 20_000, 30_000).tolist()
    a = g.SuffixAutomaton(s, 20_000)
    assert a.keys.nbytes + a.values.nbytes < 8 << 20
    for at in r.integers(0, len(s) - 6, 50):
        state = 1
        for c in s[at : at + 6]:
            state = int(a.after(np.array([state]), np.array([c]))[0])
        assert state


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = g.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_odd_rows(odd, none):
    got = {r["doc_id"]: r["lang_pred"] for r in g.language_id(odd).collect()}
    assert len(g.language_id(odd).collect()) == odd.count() and got[0] == got[1] == got[2] == "und" and got[6] == "en"
    assert g.language_id(none).count() == 0
    assert {r["lang_pred"] for r in g.predict(odd, {}).collect()} == {"und"}
