"""Repeated code: groups of equal fragments by hash. A group is a count, so a very common fragment is merged before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import explode_lines, strip
from ..schemas import finding


def duplicate_groups(fragments: DataFrame, key: str = "norm_hash", least: int | Column = 2, within: tuple[str, ...] = ()) -> DataFrame:
    """hash, occurrences, and first location of each group of at least `least`, a number or one that follows from the columns `within` which groups are told apart."""
    place = F.struct(F.col("path"), F.col("start_line").alias("line"))
    return fragments.groupBy(*within, key).agg(F.count("*").alias("occurrences"), F.min(place).alias("first")).where(F.col("occurrences") >= least).select(*within, key, "occurrences", F.col("first.path").alias("first_path"), F.col("first.line").alias("first_line"))


def duplicate_findings(fragments: DataFrame, type_: str | Column, key: str = "norm_hash", least: int | Column = 2, severity: str | Column = "warning", within: tuple[str, ...] = ()) -> DataFrame:
    """One finding per member of a group, with the group's size and its first place; members are joined back, not collected."""
    groups = duplicate_groups(fragments, key, least, within)
    rows = fragments.join(groups, [*within, key])
    context = F.map_from_arrays(F.array(F.lit("hash"), F.lit("first")), F.array(F.col(key).cast("string"), F.concat("first_path", F.lit(":"), F.col("first_line").cast("string"))))
    return rows.select(*finding("optimize", type_, file_path=F.col("path"), line_number=F.col("start_line"), end_line=F.col("end_line"), name=F.col("context"), message=F.concat(F.lit("occurs "), F.col("occurrences").cast("string"), F.lit(" times")), severity=severity, value_num=F.col("occurrences"), original_code=F.col("source"), context=context))


def duplicate_lines(files: DataFrame, least: int = 3) -> DataFrame:
    """Lines that aren't blank, by their stripped text: occurrences, distinct files and the first path."""
    rows = explode_lines(files).where("kind <> 'blank'").select("path", strip("text").alias("line"))
    return rows.groupBy("line").agg(F.count("*").alias("occurrences"), F.countDistinct("path").alias("files"), F.min("path").alias("first_path")).where(F.col("occurrences") >= least)


def duplicate_contents(files: DataFrame, least: int = 2) -> DataFrame:
    """Files of equal content: md5, occurrences and the first path."""
    return files.groupBy(F.md5(F.col("content").cast("binary")).alias("content_md5")).agg(F.count("*").alias("occurrences"), F.min("path").alias("first_path")).where(F.col("occurrences") >= least)


def literals_of(files: DataFrame, pattern: str) -> DataFrame:
    """Every match of a pattern in the contents, as fragments of text."""
    return files.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("value"))
