import hashlib

from lodestack.llm import exact_dedup as e

from .conftest import ODD


def brute(rows):
    low = {c: c + 32 for c in range(65, 91)}
    digest = lambda t: hashlib.sha256((t or "").translate(low).encode()).hexdigest()
    out = []
    for k, t in rows:
        same = [a for a, b in rows if digest(b) == digest(t)]
        keep = max((a for a in same if a is not None), default=None)
        out.append((k, keep, len(same), k == keep, digest(t)))
    return sorted(out, key=repr)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert len(rows) == len(ODD) + 1
    assert sorted(map(tuple, e.exact_dedup(odd).collect()), key=repr) == brute(rows)
    assert e.exact_dedup(none).count() == 0


def test_small_buckets(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "cast(id % 700 as string) as text")
    got = e.exact_dedup(df, bucket_rows=100).where("kept").selectExpr("doc_id", "group_size", "cast(text_sha256 as string) h").collect()
    assert len(got) == 700 and {r["doc_id"] for r in got} == set(range(4300, 5000)) and sum(r["group_size"] for r in got) == 5000


def test_filter_resizes_and_deletes():
    own = e.Bucket(4)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    assert all(own.add(d, 1, 1) for d in keys) and own.filter.resized > 0
    assert all(d in own.filter for d in keys) and not any(own.add(d, 2, 1) for d in keys)
    assert all(own.remove(d, 2) for d in keys[:2000])
    assert not any(own.has(d) for d in keys[:2000]) and all(own.has(d) for d in keys[2000:])
    assert (own.filter.table > 0).sum() == 1000 and not own.remove(keys[0])


def test_index_updates(spark):
    df = lambda *t: spark.createDataFrame([(k, x) for k, x in enumerate(t)], "doc_id long, text string")
    index = e.build_index(df("a", "b", "B", None), bucket_rows=1)
    live = lambda i: {r["doc_id"]: r["live"] for r in e.probe(i, df("A", "b", "", "zz")).collect()}
    assert live(index) == {0: True, 1: True, 2: True, 3: False}
    index = e.update_index(index, df("zz"), df("a", "b"), bucket_rows=1)
    assert live(index) == {0: False, 1: True, 2: True, 3: True}
    assert live(e.update_index(index, None, df("b", "never"), bucket_rows=1))[1] is False


def test_an_index_grows_its_buckets(spark):
    rows = lambda a, z: spark.range(a, z).selectExpr("id as doc_id", "cast(id as string) as text")
    index = e.build_index(rows(0, 100), bucket_rows=50)
    assert index.count() == 2
    index = e.update_index(index, rows(100, 2000), rows(0, 10), bucket_rows=50)
    assert {r["buckets"] for r in index.collect()} == {40} and max(len(r["digests"]) for r in index.collect()) < 110
    live = {r["doc_id"]: r["live"] for r in e.probe(index, rows(0, 2100)).collect()}
    assert len(live) == 2100 and all(v == (10 <= k < 2000) for k, v in live.items())
    assert e.probe(e.build_index(rows(0, 0)), rows(0, 3)).where("live").count() == 0
