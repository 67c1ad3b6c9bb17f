import os

import pytest

import corpus_pipeline as p
from lodestack.llm import storage as s


def test_written_tables_go_when_they_are_forgotten(spark):
    df = s.written(spark.range(10), "numbers")
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder) and df.count() == 10
    s.forget(df)
    assert not os.path.exists(folder)


def test_a_file_is_whole_or_not_there(tmp_path):
    uri = f"file://{tmp_path}/a/b.bin"
    with pytest.raises(ValueError), s.new_file(uri) as out:
        out.write(b"half")
        raise ValueError
    assert not os.path.exists(tmp_path / "a" / "b.bin")
    s.put_file(uri, lambda out: out.write(b"all"))
    assert (tmp_path / "a" / "b.bin").read_bytes() == b"all"


def test_workers_keep_what_their_module_needs_alone():
    made = []

    def run(batches):
        yield from (s.kept("x", lambda: made.append(1) or "x") for _ in batches)

    def other(batches):
        yield from batches

    other.__module__ = "elsewhere"
    assert list(s.tidied(run)([1, 2])) == ["x", "x"] and list(s.tidied(run)([1])) == ["x"] and len(made) == 1
    assert list(s.tidied(other)([1])) == [1] and not s._kept
    assert list(s.tidied(run)([1])) == ["x"] and len(made) == 2


def test_batches_are_small_within_a_block_only(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), s.small_batches(spark, 10):
        assert spark.conf.get(name) == "10"
        raise ValueError
    assert spark.conf.get(name) == before


def test_rows_are_numbered_by_their_place(spark, odd, tmp_path):
    """Each row its own number, the same in every scan, over many files; and in a table without files."""
    spark.range(1000).selectExpr("id % 7 as doc_id", "cast(id as string) as text").repartition(9).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    a, b = ({r["text"]: r[p.ROW] for r in p._numbered(x).collect()} for x in (docs, docs))
    assert a == b and len(set(a.values())) == 1000
    own = p._numbered(odd)
    assert own.columns == [*odd.columns, p.ROW] and len({r[p.ROW] for r in own.collect()}) == odd.count()
