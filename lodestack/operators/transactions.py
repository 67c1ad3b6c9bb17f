"""Edits as an ordered log: pending_edits(path, seq, original, new, operation), folded to one change per path.

Nothing is written before a commit; a commit is a snapshot of contents, which a driver swaps in.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold(edits: DataFrame) -> DataFrame:
    """Per path the first original, the last new content, the operations in order, and their number."""
    names = F.array_sort(F.collect_list(F.struct("seq", "operation")))
    return edits.groupBy("path").agg(F.min_by("original", "seq").alias("original"), F.max_by("new", "seq").alias("new"), F.array_join(names["operation"], "; ").alias("operation"), F.count("*").alias("n_edits"))


def unified_diff(original: str | None, new: str | None, path: str, context: int = 3) -> str:
    """A unified diff with a/ and b/ names; empty if nothing changed. Missing final line ends count as there."""
    a, b = ((t if not t or t.endswith("\n") else t + "\n") for t in (original or "", new or ""))
    return "".join(difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), f"a/{path}", f"b/{path}", n=context))


@F.pandas_udf(StringType())
def diff_of(original: pd.Series, new: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([unified_diff(a, b, p) for a, b, p in zip(original, new, path, strict=True)])


def preview(edits: DataFrame) -> DataFrame:
    """results of a dry run: a row per path with its diff."""
    return fold(edits).select(F.lit(True).alias("success"), F.concat(F.lit("would apply "), F.col("operation")).alias("message"), "path", "operation", F.lit(None).cast("string").alias("error"), diff_of(F.coalesce("original", F.lit("")), F.coalesce("new", F.lit("")), "path").alias("diff"))


def commit(files: DataFrame, edits: DataFrame) -> DataFrame:
    """`files` with the folded edits applied; paths without an edit stay, new paths are added."""
    own = fold(edits).select("path", F.col("new").alias("_new"))
    return files.join(own, "path", "full").withColumn("content", F.coalesce("_new", "content")).drop("_new")


def edits_of(files: DataFrame, new: Column, operation: str, seq: int = 0) -> DataFrame:
    """An edit for each file whose content an expression changes."""
    return files.select("path", F.lit(seq).alias("seq"), F.col("content").alias("original"), new.alias("new"), F.lit(operation).alias("operation")).where("not (original <=> new)")


def batch(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """success (all, true if none), partial_success (any, false if none), all_failed (none, true if none) and the count."""
    return results.groupBy(*(by or [])).agg(F.coalesce(F.bool_and("success"), F.lit(True)).alias("success"), F.coalesce(F.bool_or("success"), F.lit(False)).alias("partial_success"), F.coalesce(F.bool_and(~F.col("success")), F.lit(True)).alias("all_failed"), F.count("*").alias("n"))


def last_diffs(results: DataFrame, seq: str) -> DataFrame:
    return results.where("diff is not null").groupBy("path").agg(F.max_by("diff", seq).alias("diff"))


def combine_diffs(results: DataFrame) -> DataFrame:
    """(diff): all diffs of results as one text, in order of their paths; a report, so one row."""
    parts = F.array_sort(F.collect_list(F.struct("path", "diff")))
    return results.where("diff is not null").agg(F.array_join(parts["diff"], "\n").alias("diff"))


class Transaction:
    """Edits that are applied together or not at all: add logs, preview, then commit or roll back; it doesn't nest.

    As a context manager it commits at the end (`committed` has the new files) and rolls back on an error.
    """

    _open = False

    def __init__(self, files: DataFrame):
        self.files, self.logs, self.committed = files, [], None

    def __enter__(self) -> Transaction:
        if Transaction._open:
            raise RuntimeError("a transaction is open already")
        Transaction._open = True
        return self

    def __exit__(self, kind, value, trace) -> None:
        Transaction._open = False
        if kind is None:
            self.commit()
        else:
            self.rollback()

    def add(self, log: DataFrame) -> None:
        """Edits (path, original, new, operation) after all that were added before."""
        self.logs.append(log.select("path", F.lit(len(self.logs)).alias("seq"), "original", "new", "operation"))

    @property
    def pending(self) -> DataFrame | None:
        out = None
        for log in self.logs:
            out = log if out is None else out.unionByName(log)
        return out

    def current(self) -> DataFrame:
        """The files as the pending edits leave them, for the next edit."""
        return self.files if not self.logs else commit(self.files, self.pending)

    def preview(self) -> DataFrame | None:
        return preview(self.pending) if self.logs else None

    def commit(self) -> DataFrame:
        self.committed = self.current()
        return self.committed

    def rollback(self) -> DataFrame:
        """Forget all edits; the files are as they were, which no edit ever touched."""
        self.logs, self.committed = [], None
        return self.files
