import corpus_pipeline as p
from lodestack.llm import decontamination, jaccard_join, mixing, toxicity

from .test_decontamination import brute as leak
from .test_jaccard_join import brute as near

PATH = "/root/testdata/sf0.001"


def test_stages_decide_over_their_own_input(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in p.STAGES:
        out[name] = before = docs
        docs = p.written(stage(spark, docs, PATH), name)
        if name != "token_output":
            assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        if name == "toxicity":
            rejected = {r["doc_id"] for r in toxicity.toxicity(before, spark.read.parquet(f"{PATH}/labels.parquet")).where("predicted = 1").collect()}
            assert ids == {k for k, _ in rows} - rejected
        elif name == "jaccard_join":
            assert ids == {k for k, _, c in near(rows, 5, 80) if k == c}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
            bad = {k for k, t in rows for n, h, _ in [leak(t, items)] if h and 20 * h >= n}
            assert ids == {k for k, _ in rows} - bad
        elif name == "mixing":
            want = {r["doc_id"]: round(r["taken"] / r["size"] + 1e-9) for r in mixing.mix_report(before).where("size > 0").collect()}
            got = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert got == {k: n for k, n in want.items() if n}
        else:
            assert docs.count() == before.count()
    assert decontamination and jaccard_join


def test_run_and_odd_rows(spark, odd):
    assert p.run(spark, PATH).count() > 0
    kept = p.drop_near_copies(spark, odd, PATH)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert kept.where("text = 'the same words' or text = 'THE SAME words'").count() == 1


def test_rows_that_share_an_id_or_have_none_are_decided_one_by_one(spark, monkeypatch):
    clean = [" ".join(f"c{k}w{i}" for i in range(40)) for k in range(6)]
    item = spark.read.parquet(f"{PATH}/benchmark.parquet").where("length(text) > 100").first()["text"]
    rows = [(7, clean[0], "s"), (7, clean[1], "s"), (7, item, "s"), (7, clean[1], "s"), (None, clean[2], "s"), (None, clean[3], "s"), (None, item, "s"), (None, clean[3], "s"), (8, clean[4], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = lambda df: sorted(r["text"] for r in df.collect())
    assert texts(p.drop_near_copies(spark, docs, PATH)) == sorted({*clean[:5], item})
    assert texts(p.drop_leaks(spark, docs, PATH)) == sorted(t for _, t, _ in rows if t != item)
    mixed = p.mix_sources(spark, docs, PATH)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} >= {7, None}
    monkeypatch.setattr(toxicity, "train", lambda *_: None)
    monkeypatch.setattr(toxicity, "score", lambda d, _, text, key: d.selectExpr(key, f"if({text} = '{clean[0]}' or {text} = '{clean[2]}', 1e9D, -1e9D) as score"))
    assert texts(p.reject_toxic(spark, docs, PATH)) == sorted(t for _, t, _ in rows if t not in (clean[0], clean[2]))
