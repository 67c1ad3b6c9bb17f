import itertools

import numpy as np

from lodestack.llm import toxicity as x


def test_marginals_against_all_taggings():
    field = x.Field(np.arange(3, dtype=np.uint64), np.array([2.0, -1.0, 0.5]), -1.5, np.array([[0.4, -0.3], [-0.2, 0.6]]))
    docs = [(6, np.array([1, 2, 5]), np.array([[0, -1], [1, 2], [0, 0]])), (4, np.array([0]), np.array([[2, -1]])), (3, np.zeros(0, int), np.zeros((0, 2), int)), (1, np.array([0]), np.array([[0, -1]]))]
    for (n, at, ids), got in zip(docs, field.marginals(docs), strict=True):
        e = np.full(n, field.bias)
        e[at] = field.emission(ids)
        weight, toxic = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            path = (0, *tags)
            w = np.exp(sum(field.step[a, b] for a, b in zip(path, path[1:])) + sum(e[t] for t in range(n) if tags[t]))
            weight += w
            toxic += w * np.array(tags)
        # the chain begins clean before its first run; a first featured token is reached by one step
        if len(at):
            assert np.allclose(got, (toxic / weight)[at], atol=1e-9)


def test_held_out(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    field = x.train(docs, labels.where(~x.held_out()))
    rows = x.score(docs, field, spans=True).join(labels, "doc_id").collect()
    clean, toxic = [r["score"] for r in rows if not r["toxic"]], [r["score"] for r in rows if r["toxic"]]
    assert np.mean(np.array(clean) >= 0.3) <= 0.02 and np.mean(np.array(toxic) >= 0.3) >= 0.5
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {text[r["doc_id"]][s["start"] : s["end"]].lower() for r in rows for s in r["spans"]}
    assert "idiot" in words and not words & {"the", "and", "of"}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (6, 0, 1), (6, 1, 1), (None, 1, 1), (77, 1, 1), (7, None, 1)], "doc_id long, toxic int, key int")
    got = x.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert x.toxicity(none, labels).count() == 0
    assert {r["predicted"] for r in x.toxicity(odd, labels.limit(0)).collect()} == {0}


def test_near_copies_count_once():
    assert x.distinct_rows([(1, 1, [5, 6]), (2, 1, [9, 6]), (3, 0, [5, 6]), (4, 1, [7, 8])]) == [1, 3, 4]
