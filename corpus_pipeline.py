"""A corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark leaks go,
sources are mixed to their target weights, and the mix is written as token ids.

Every stage but the last returns the columns of its input. Decisions are addressed to rows, by a
number that each row has from its file and its place in it; so rows that repeat a doc_id, or have
none, are decided on one by one, and nothing has to be written to number them.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import decontamination, jaccard_join, mixing, tokens, toxicity
from lodestack.llm.storage import small_batches, written

BROADCAST_ROWS, ROW, FILE, AT = 2_000_000, "_pipeline_row", "_pipeline_file", "_pipeline_at"


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table of two numbers a row, or of file names, written; broadcast up to `BROADCAST_ROWS` rows, and joined by a shuffle beyond."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number for each row (`ROW`): its file's rank and its place there; a table that isn't read from files is written first."""
    if ROW in docs.columns:
        return docs
    place = F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(AT)
    try:
        rows = docs.select("*", *place)
    except AnalysisException:  # it has no files
        rows = written(docs, "rows").select("*", *place)
    files = rows.select(FILE).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(FILE)))  # a row for each file
    rows = rows.join(_small(files, "files"), FILE)
    return rows.select(*docs.columns, (F.shiftleft(F.col("_rank").cast("long"), 40) + F.col(AT)).alias(ROW))


def _by_rows(stage):
    """A stage over numbered rows that returns the columns of its input."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return stage(spark, _numbered(docs), sf_dir).select(docs.columns)

    return run_stage


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return docs.join(_small(dropped.select(ROW), "dropped"), ROW, "left_anti").select(docs.columns)


@_by_rows
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labels, which go by doc_id, and scores every row; a null or empty text is one without toxic tokens, and without labels no row goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")), "doc_id", "text")
    return _without(docs, toxicity.score(docs, field, "text", ROW).where(F.col("score") >= toxicity.THRESHOLD))


@_by_rows
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; of a group the row with the smallest id stays, the first of several."""
    found = jaccard_join.jaccard_join(docs, key=ROW, words=5, percent=80).join(docs.select(ROW, "doc_id"), ROW)
    found = written(found, "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", ROW))
    stay = found.groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return _without(docs, found.join(stay, ROW, "left_anti"))


@_by_rows
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth of the words or more are benchmark passages go; a null or empty text has none, and stays."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=ROW)
    return _without(docs, found.where("contaminated"))


@_by_rows
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of a row as the mix takes copies of it; a copy that is cut at the budget counts from a half on."""
    order = F.coalesce(F.col("doc_id").cast("string"), F.col(ROW).cast("string"))
    report = mixing.mix_report(docs.withColumn("_order", order), key=ROW, order="_order").where("size > 0")
    copies = report.select(ROW, F.round(F.col("taken") / F.col("size")).cast("int").alias("_copies")).where("_copies > 0")
    return docs.join(_small(copies, "copies"), ROW).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token files."""
    with small_batches(spark):
        return tokens.tokenize(docs, tokens.public_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each over all that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
