import re

import numpy as np
import pytest

from lodestack.llm import masked_lm as m
from lodestack.llm.words import SYMBOLS, hashed

PATH = "/root/testdata/sf0.001"


def rows_of(docs):
    return docs.selectExpr("doc_id as key", "text")


def one_by_one(words, weights, text):
    """The score of a text, one token after another, from the layers themselves and in plain Python."""
    net = m.Network(words, weights)
    embed, w1, b1, w2, b2, w3, b3, w4 = (x.astype(np.float64) for x in net.layers)
    import pyarrow as pa

    found = [h[0] for _, _, h, _ in hashed(pa.array([text]), SYMBOLS)]
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    assert len(h) == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})))
    ids = words.ids(h).tolist()
    total = 0.0
    for k in range(len(ids)):
        near = [ids[j] if 0 <= j < len(ids) else m.VOCABULARY + m.TAIL for j in (k - 2, k - 1, k + 1, k + 2)]
        x = np.tanh(np.concatenate([embed[j] for j in near]) @ w1 + b1)
        pick = lambda z, at: z[at] - np.log(np.exp(z).sum())
        if ids[k] < m.VOCABULARY:
            c = ids[k] // m.MEMBERS
            total += pick(x @ w2 + b2 + words.classes, c) + pick(x @ w3[c] + b3[c] + words.members[c], ids[k] % m.MEMBERS)
        else:
            total += pick(x @ w2 + b2 + words.classes, m.CLASSES)
            leaf = int(h[k]) % m.LEAVES
            digits = [leaf // m.DIGITS ** (m.LEVELS - 1 - i) % m.DIGITS for i in range(m.LEVELS)]
            for level, digit in enumerate(digits):
                prefix = leaf // m.DIGITS ** (m.LEVELS - level)
                total += pick(x @ w4[level] + words.priors(level, prefix), digit)
    return len(ids), total


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    words = m.vocabulary(rows_of(docs))
    return docs, words, m.train(rows_of(docs), words)


def test_score_is_the_sum_over_tokens(learned):
    """The batched score against one token at a time, on twelve texts, long ones too."""
    docs, words, weights = learned
    got = {r["doc_id"]: (r["n_tokens"], r["log_likelihood"]) for r in m.score(docs, words, weights).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k in sorted(texts, key=lambda k: len(texts[k] or ""))[:: max(1, len(texts) // 12)]:
        n, want = one_by_one(words, weights, texts[k] or "")
        assert got[k][0] == n and got[k][1] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_probabilities_of_all_tokens_add_up(learned):
    """Over the classes' words and, within the tail, over all leaves of some prefix."""
    _, words, weights = learned
    net = m.Network(words, weights)
    context = np.array([[3, 900, m.VOCABULARY + 5, m.VOCABULARY + m.TAIL]])
    every = np.arange(m.VOCABULARY)
    n = m.DIGITS**2  # leaves that share all but two digits
    logs = net.score(np.repeat(context, len(every) + n, 0), np.concatenate((every, np.full(n, m.VOCABULARY))), np.concatenate((np.zeros(len(every), np.int64), 1_000_192 // n * n + np.arange(n))))
    head = np.exp(logs[: len(every)]).sum()
    h = net._hidden(context)[1]
    steps = list(net._steps(h, np.array([m.VOCABULARY]), np.array([1_000_192])))
    tail = np.exp(steps[0][3][0, m.CLASSES])
    assert head + tail == pytest.approx(1, abs=1e-4)
    prefix = np.exp(sum(s[3][0, s[4][0]] for s in steps[: 1 + m.LEVELS - 2]))
    assert np.exp(logs[len(every) :]).sum() == pytest.approx(prefix, rel=1e-3)


def test_learning_helps_and_both_sides_count(spark, learned):
    docs, words, weights = learned
    mean = lambda w: (lambda r: sum(x["log_likelihood"] for x in r) / sum(x["n_tokens"] for x in r))(m.score(docs, words, w).collect())
    before, after = mean(m.Network(words).weights), mean(weights)
    assert before < 0 and after > before + 0.05
    net = m.Network(words, weights)
    base = np.array([[1, 2, 3, 4]])
    for side in range(4):  # every step of the prediction hangs on every neighbour
        other = base.copy()
        other[0, side] = 40
        pair = [list(net._steps(net._hidden(c)[1], np.array([m.VOCABULARY]), np.array([77]))) for c in (base, other)]
        assert all(not np.allclose(a[3], b[3], atol=1e-7) for a, b in zip(*pair, strict=True))


def test_the_same_rows_in_other_partitions(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    found = []
    for n in (1, 3, 60):
        rows = m.pseudo_likelihood(docs.repartition(n)).collect()
        found.append({r["doc_id"]: r["log_likelihood"] for r in rows})
    for k, want in found[0].items():
        assert found[1][k] == pytest.approx(want, rel=1e-4, abs=1e-3) and found[2][k] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_gradient():
    """A step goes against the numeric gradient of every layer."""
    words = m.Words.of_counts(np.arange(40, dtype=np.uint64), np.arange(100, 60, -1), np.where(np.arange(m.LEAVES) % 7 == 0, 1, 0).astype(np.uint8))
    r = np.random.default_rng(3)
    start = m.Network(words).weights + r.standard_normal(len(m.Network(words).weights)).astype(np.float32) * np.float32(0.1)
    context, ids, leaves = r.integers(0, 40, (6, 4)), np.array([0, 5, 33, 39, m.VOCABULARY + 1, m.VOCABULARY + 2]), np.array([0, 0, 0, 0, 7, 700])
    loss = lambda w: -m.Network(words, w).score(context, ids, leaves).mean()
    net = m.Network(words, start)
    net.learn(context, ids, leaves, rate=1e-3)
    step = (start - net.weights) / 1e-3
    at = 0
    for layer in net.layers:
        own = np.abs(step[at : at + layer.size])
        k = at + int(own.argmax())
        wide = np.zeros(len(start), np.float32)
        wide[k] = 1e-2
        slope = (loss(start + wide) - loss(start - wide)) / 2e-2
        assert np.sign(slope) == np.sign(step[k]) and abs(slope) > 1e-4
        at += layer.size
    for _ in range(40):
        net.learn(context, ids, leaves)
    assert loss(net.weights) < loss(start) - 1


def test_counts_cover_the_corpus(spark):
    rows = spark.createDataFrame([(k, f"common word{k} common rare{k % 3}") for k in range(3000)], "key long, text string")
    words = m.vocabulary(rows)
    assert np.exp(words.members.astype(float)).sum() + np.exp(words.classes[-1]) == pytest.approx(12_000 + m.UNSEEN * m.LEAVES, rel=0.01)


def test_every_token_trains_once(spark, monkeypatch):
    """Of a table whose shards are all shorter than a batch too."""
    counts, own = [], m.written

    def written(df, name):
        out = own(df, name)
        if name == "weights":
            counts.append(sum(r["n"] for r in out.collect()))
        return out

    monkeypatch.setattr(m, "written", written)
    rows = spark.createDataFrame([(k, "red green blue " * (1 + k % 3 + 900 * (k == 7))) for k in range(40)], "key long, text string")
    words = m.vocabulary(rows)
    weights = m.train(rows, words, shard_bytes=200)
    total = sum(3 * (1 + k % 3 + 900 * (k == 7)) for k in range(40))
    assert len(counts) == m.ROUNDS and all(counts) and sum(counts) == total
    assert not np.array_equal(weights, m.Network(words).weights)


def test_odd_rows(odd, none):
    got = m.pseudo_likelihood(odd).collect()
    assert len(got) == odd.count() and all(r["log_likelihood"] <= 0 for r in got)
    assert {(r["n_tokens"], r["mean_log_likelihood"]) for r in got if r["doc_id"] in (0, 1, 2)} == {(0, None)}
    assert m.pseudo_likelihood(none).count() == 0
