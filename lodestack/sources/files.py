"""Corpora as `files` tables: source trees, tables with a text column, configuration and requirement files; and their sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IS_TEST = r"(^|/)test_[^/]*$|_test\.py$|(^|/)tests/"


def read_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """files of a directory tree by a file-name pattern, with paths relative to the root; `__pycache__` and empty files are left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("binaryFile").load(root).where(~F.col("path").contains("/__pycache__/"))
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.substring_index("path", f"{base}/", -1)
    return of_columns(raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")))


def of_columns(df: DataFrame, path: str = "path", content: str = "content", module: str | None = None) -> DataFrame:
    """Any table with an id and a text column as `files`; the module is the path with dots unless a column is named."""
    name = F.col(path).cast("string")
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.py$", ""), "/", "."), r"\.__init__$", "")
    return df.select(name.alias("path"), (F.col(module) if module else dotted).alias("module"), F.col(content).alias("content"), name.rlike(IS_TEST).alias("is_test"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table as files: path = doc_id, module = source."""
    return of_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")


def parse_config(files: DataFrame) -> DataFrame:
    """config(path, format, json, error): JSON, YAML, TOML and INI contents, by file name, as JSON text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.config import loads

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                kind = {"yml": "yaml", "cfg": "ini"}.get(ext := path.rpartition(".")[2].lower(), ext)
                try:
                    rows.append((path, kind, json.dumps(loads(content or "", kind), default=str, sort_keys=False), None))
                except Exception as e:  # a file that doesn't parse is a row with an error
                    rows.append((path, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "json", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, format string, json string, error string")


def write_files(files: DataFrame, root: str) -> None:
    """A snapshot of the contents as Parquet, from which a driver can swap a tree."""
    files.select("path", "content").write.mode("overwrite").parquet(root)
