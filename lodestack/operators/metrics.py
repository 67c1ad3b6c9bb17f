"""Line metrics by file, module and project, and coverage gaps. One pass counts; groups merge before they shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_lines
from .facts import Facts


def file_metrics(files: DataFrame) -> DataFrame:
    """path, module, is_test, total_lines, blank_lines, comment_lines, code_lines of each file, without exploding lines."""
    total, blank, comment = count_lines("content")
    rows = files.select("path", "module", "is_test", total.alias("total_lines"), blank.alias("blank_lines"), comment.alias("comment_lines"))
    return rows.withColumn("code_lines", F.col("total_lines") - F.col("blank_lines") - F.col("comment_lines"))


def module_metrics(per_file: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Sums by module, files, test files, their ratio, and the average of the files' averages above 0 for `extra` columns.

    Counts of classes, functions and methods and the largest complexity too, where `code_metrics` gave them.
    """
    sums = [F.sum(c).cast("long").alias(c) for c in ("total_lines", "blank_lines", "comment_lines", "code_lines")]
    sums += [F.sum(c).cast("long").alias(c) for c in ("class_count", "function_count", "method_count") if c in per_file.columns]
    sums += [F.max("max_complexity").alias("max_complexity")] if "max_complexity" in per_file.columns else []
    means = [F.avg(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in extra or []]
    out = per_file.groupBy("module").agg(F.count("*").alias("files"), F.count_if("is_test").alias("test_files"), *sums, *means)
    return out.withColumn("test_ratio", F.try_divide(F.col("test_files"), F.col("files") - F.col("test_files")))


def project_summary(per_file: DataFrame) -> DataFrame:
    """One row of totals; the average is over source files only."""
    source = F.when(~F.col("is_test"), F.col("total_lines"))
    return per_file.agg(
        F.count("*").alias("files"), F.count_if("is_test").alias("test_files"), F.countDistinct("module").alias("modules"),
        *(F.sum(c).cast("long").alias(c) for c in ("total_lines", "blank_lines", "comment_lines", "code_lines")), F.avg(source).alias("avg_source_lines"),
    )


def coverage_gaps(files: DataFrame) -> DataFrame:
    """Source files whose stem has no test file `test_<stem>` or `<stem>_test`; `_*` and `__init__` are exempt."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.py)?$", 1)
    rows = files.select("path", "is_test", stem.alias("stem"))
    tested = rows.where("is_test").select(F.regexp_replace("stem", r"^test_|_test$", "").alias("stem")).distinct()
    return rows.where(~F.col("is_test") & ~F.col("stem").startswith("_")).join(tested, "stem", "left_anti").select("path")


def unlabelled(files: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Files that no row of another table refers to."""
    return files.join(keys.select(F.col(key).cast("string").alias("path")).distinct(), "path", "left_anti")


def code_metrics(facts: Facts) -> DataFrame:
    """`file_metrics` with class_count, function_count, method_count, import_count, has_docstring, avg_complexity, max_complexity and avg_function_length.

    The averages are 0 for a file without functions, as are all counts for one that doesn't parse.
    """
    kind = lambda k: F.size(F.filter("defs", lambda d: d["kind"] == k))
    own = F.filter("defs", lambda d: d["kind"] != "class")
    n = F.size(own)
    mean = lambda f: F.when(n > 0, F.aggregate(own, F.lit(0).cast("long"), lambda a, d: a + f(d)) / n).otherwise(F.lit(0.0))
    total, blank, comment = count_lines("content")
    return facts.of("defs", "measures", "imports", "docstring", keep=("path", "module", "is_test", "content")).select(
        "path", "module", "is_test", total.alias("total_lines"), blank.alias("blank_lines"), comment.alias("comment_lines"), (total - blank - comment).alias("code_lines"),
        kind("class").alias("class_count"), kind("function").alias("function_count"), kind("method").alias("method_count"), F.size("imports").alias("import_count"), F.col("docstring").isNotNull().alias("has_docstring"),
        mean(lambda d: d["cyclomatic"]).alias("avg_complexity"), F.coalesce(F.array_max(F.transform(own, lambda d: d["cyclomatic"])), F.lit(0)).alias("max_complexity"), mean(lambda d: d["end_line"] - d["start_line"] + 1).alias("avg_function_length"),
    )
