"""Mixing sources to target weights by weighted fair queueing.

Every document may be served twice (two epochs of its source). Within a source, copies stand in a
shuffled order, the order of the MD5 of their id and text, epoch by epoch; a copy's virtual finish time is
the source's words up to and including it, divided by the source's target, and each of its words
has a finish time likewise. The mix is the words of all copies in the order of finish times,
truncated where running sums over that one order reach the budget, the whole words of all targets.
So copies before the cut are taken whole, and the copy of each source then in service gives the
words served so far. As no target exceeds two epochs, no word beyond virtual time 1 is needed, and
words that tie are all on one side of the cut.

Scale: running sums never put a source, or the whole order, into one task. The first hex digits of
the shuffle key, or the finish time itself, cut each order into bins of nearly equal size, more of
them where there are more rows; rows that share an id are spread by their texts. Windows run within bins, and the sums of whole bins (sources x bins rows) carry over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import written

WEIGHTS, SHARE, EPOCHS, BINS, BIN_ROWS = (3, 1, 2), 1.5, 2, 1024, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(df: DataFrame, key: str, text: str, source: str, order: str | None = None) -> DataFrame:
    """(key, source, size, shuffle): size counts the text's words; a null text has none. `order` is shuffled by, with the text; the key by default."""
    return df.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(order or key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary")).alias("shuffle"),
    )


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(of, source_size, target) from (of, source_size), where `of` orders sources by code point, null last.

    Sources take the weights in turn; the budget is `share` of all words. A target stops at
    `epochs` times its source, and the excess goes to the others by weight: with sources by rising
    cap / weight, the first k are capped for the least k at which the level
    (budget - their caps) / (weight of the others) lifts no other above its cap.
    One row per source, so this is the one place with a window over a whole table.
    """
    x = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy("of")) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    x = x.withColumn("cap", F.col("source_size") * float(epochs))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "of").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    x = x.withColumns({"before": F.coalesce(F.sum("cap").over(rising), F.lit(0.0)), "taken_w": F.coalesce(F.sum("w").over(rising), F.lit(0.0)), "all_w": F.sum("w").over(every), "budget": F.sum("source_size").over(every) * share})
    x = x.withColumn("height", (F.col("budget") - F.col("before")) / (F.col("all_w") - F.col("taken_w")))
    x = x.withColumn("water", F.min(F.when(F.col("height") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), "taken_w", "height"))).over(every)["height"])
    return x.select("of", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("w"), F.col("cap"))).alias("target"))


def placed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, bins: int = BINS, order: str | None = None) -> DataFrame:
    """One row per document: key, source, shuffle, size, source_size, target, cum (its source's words up to and with it, in one epoch)."""
    rows = written(sizes(df, key, text, source, order), "mix-sizes")
    bins = max(bins, -(-rows.count() // BIN_ROWS))
    first = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    rows = rows.withColumns({"of": F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name")), "bin": F.floor(first * bins / F.lit(1 << 32)).cast("int")})
    sums = rows.groupBy("of", "bin").agg(F.sum("size").alias("words"))
    given = targets(sums.groupBy("of").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    earlier = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("of", "bin", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("carried")).join(given, "of")
    within = Window.partitionBy("of", "bin").orderBy("shuffle", "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(within)).join(carried, ["of", "bin"])
    return rows.select("key", "source", "shuffle", "size", "source_size", "target", (F.col("within") + F.col("carried")).alias("cum"))


def _finish(word: Column) -> Column:
    """The virtual time at which a source has served its first `word` words."""
    return word / F.nullif("target", F.lit(0.0))


def cut(rows: DataFrame, epochs: int = EPOCHS, bins: int = BINS, budget: int | None = None) -> DataFrame:
    """One row (at): the finish time of the last word dealt when `budget` words of all sources have been, null if none are.

    Words of all copies are ranged by finish time into bins; sums of bins carry over, the bin in
    which the budget ends is ranged again, and only the words of one of its bins are numbered.
    The default budget is the whole words of all targets; more than all words deals all of them.
    """
    copies = rows.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("start", F.col("cum") - F.col("size") + F.col("copy") * F.col("source_size"))
    bin_of = lambda word: F.floor(_finish(word) * bins + 0.5)
    parts = copies.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start") + 1), bin_of(F.col("start") + F.col("size")))))
    upto = lambda edge: F.least(F.greatest(F.ceil((edge - 0.5) / bins * F.col("target")) - 1 - F.col("start"), F.lit(0)), F.col("size"))
    lo = F.when(F.col("bin") == bin_of(F.col("start") + 1), F.lit(0)).otherwise(upto(F.col("bin")))
    hi = F.when(F.col("bin") == bin_of(F.col("start") + F.col("size")), F.col("size")).otherwise(upto(F.col("bin") + 1))
    parts = parts.select("bin", "start", "target", lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    if budget is None:
        total = rows.groupBy("source").agg(F.first("target").alias("target")).agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)).alias("total"))
    else:
        total = rows.sparkSession.range(1).select(F.lit(budget).cast("long").alias("total"))

    def last(sums: DataFrame, total: DataFrame, by: str) -> DataFrame:
        """(by, total): the first bin whose running sum reaches the total, or the last one, and the words to take of it."""
        x = sums.withColumn("carried", F.sum("words").over(Window.orderBy(by)) - F.col("words")).join(F.broadcast(total))
        x = x.where("carried < total").agg(F.max_by(F.struct(by, F.least(F.col("total") - F.col("carried"), F.col("words")).alias("total")), by).alias("x"))
        return x.where("x is not null").select("x.*")

    first = last(parts.groupBy("bin").agg(F.sum(F.col("hi") - F.col("lo")).alias("words")), total, "bin")
    words = parts.join(F.broadcast(first), "bin").withColumn("word", F.explode(F.sequence(F.col("start") + F.col("lo") + 1, F.col("start") + F.col("hi"))))
    words = words.select(_finish(F.col("word")).alias("finish"), F.floor((_finish(F.col("word")) * bins + 0.5 - F.col("bin")) * bins).alias("fine"), "total")
    words = written(words, "mix-cut")
    second = last(words.groupBy("fine").agg(F.count("*").alias("words")), words.select("total").limit(1), "fine")
    words = words.drop("total").join(F.broadcast(second), "fine")
    return words.withColumn("nth", F.row_number().over(Window.orderBy("finish"))).where("nth <= total").agg(F.max("finish").alias("at"))


def _dealt(rows: DataFrame, epochs: int, bins: int) -> DataFrame:
    """Rows of `placed` with `dealt`: the words of their source that finish by the cut of the mix."""
    rows = written(rows, "mix-placed")
    n = F.floor(F.col("at") * F.col("target"))
    n = F.when(_finish(n + 1) <= F.col("at"), n + 1).when(_finish(n) <= F.col("at"), n).otherwise(n - 1)
    return rows.join(F.broadcast(written(cut(rows, epochs, bins), "mix-at"))).withColumn("dealt", F.coalesce(n, F.lit(0)))


def _served(copy: Column) -> Column:
    """Words of a copy up to the cut: all, some or none of its size."""
    start = F.col("cum") - F.col("size") + copy * F.col("source_size")
    return F.least(F.greatest(F.col("dealt") - start, F.lit(0)), F.col("size")).cast("long")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", epochs: int = EPOCHS, bins: int = BINS, **options) -> DataFrame:
    """The mix: copies range-sorted by virtual finish time and truncated at the budget.

    Columns: key, source, copy, size, words (taken), finish.
    """
    copies = _dealt(placed(df, key, text, source, epochs=epochs, bins=bins, **options), epochs, bins).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.select("key", "source", "shuffle", "copy", "size", _served(F.col("copy")).alias("words"), _finish(F.col("cum") + F.col("copy") * F.col("source_size")).alias("finish"))
    return copies.where("words > 0").orderBy("finish", F.col("source").isNull(), "source", "shuffle", "copy").drop("shuffle").withColumnRenamed("key", key)


def mix_report(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", epochs: int = EPOCHS, bins: int = BINS, **options) -> DataFrame:
    """One row per input row: key, size, source_size and target of its source, taken (words the mix takes of it, over all copies).

    A null text has no words and gives none. Rows without a source are a source of their own, the
    last. Rows that repeat a key stay rows of their own. Where no source has words all targets are
    0; an empty table gives no rows. Columns beyond the three named ones are ignored.
    """
    taken = sum((_served(F.lit(i)) for i in range(1, epochs)), _served(F.lit(0)))
    rows = _dealt(placed(df, key, text, source, epochs=epochs, bins=bins, **options), epochs, bins)
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: null texts have no words, a null source is a source of its own, repeated rows are mixed one by one."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS shuffle FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, ([3, 1, 2])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
b AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER o, 0) AS before, coalesce(sum(w) OVER o, 0) AS taken_w
  FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, (budget - before) / (all_w - taken_w) AS height FROM b),
l AS (SELECT height AS water FROM h WHERE height * w <= cap ORDER BY cap / w, taken_w LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT water FROM l) * w, cap)) AS target FROM h),
c AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (floor(least(greatest(target - start, 0), size)) + floor(least(greatest(target - start - source_size, 0), size)))::BIGINT AS taken
FROM c
"""
