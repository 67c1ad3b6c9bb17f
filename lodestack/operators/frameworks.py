"""Routes, routers, dependencies, middleware, models and relationships of web and database frameworks, by patterns over contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROUTE = r"@(\w+)\.(route|get|post|put|delete|patch|websocket)\(\s*[\"']([^\"']*)[\"']([^)]*)\)(?:\s*@[^\n]*)*\s*(?:async\s+)?def\s+(\w+)"
_CLASS = r"(?ms)^class\s+(\w+)\(([^)]*)\):\n(.*?)(?=^\S|\z)"


def _zipped(files: DataFrame, pattern: str, n: int) -> DataFrame:
    """(path, g1..gn): the groups of every match."""
    cols = {f"g{k}": F.regexp_extract_all("content", F.lit(pattern), F.lit(k)) for k in range(1, n + 1)}
    rows = files.where(F.col("content").rlike(pattern)).withColumns(cols)
    return rows.select("path", F.explode(F.arrays_zip(*cols)).alias("m")).select("path", "m.*")


def routes(files: DataFrame) -> DataFrame:
    """(path, route, function, methods, owner, response_model, status_code): methods default to GET; owner is null for app and application."""
    rows = _zipped(files, _ROUTE, 5)
    listed = F.transform(F.regexp_extract_all(F.regexp_extract("g4", r"methods\s*=\s*\[([^\]]*)\]", 1), F.lit(r"[\"'](\w+)[\"']"), F.lit(1)), F.upper)
    methods = F.when(F.col("g2") != "route", F.array(F.upper("g2"))).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))
    part = lambda p: F.nullif(F.regexp_extract("g4", p, 1), F.lit(""))
    return rows.select("path", F.col("g3").alias("route"), F.col("g5").alias("function"), methods.alias("methods"), F.when(~F.col("g1").isin("app", "application"), F.col("g1")).alias("owner"), part(r"response_model\s*=\s*([\w\[\].]+)").alias("response_model"), part(r"status_code\s*=\s*([\w.]+)").cast("string").alias("status_code"))


def groups_of_routes(files: DataFrame) -> DataFrame:
    """(path, variable, kind, name): blueprints and routers that are made."""
    rows = _zipped(files, r"(?m)^\s*(\w+)\s*=\s*(Blueprint|APIRouter)\(\s*(?:[\"']([^\"']*)[\"'])?", 3)
    return rows.select("path", F.col("g1").alias("variable"), F.lower("g2").alias("kind"), F.nullif("g3", F.lit("")).alias("name"))


def injected(files: DataFrame) -> DataFrame:
    """(path, name, is_async): names in Depends(...) that a def of the same file has."""
    used = _zipped(files, r"Depends\(\s*(\w+)", 1).select("path", F.col("g1").alias("name")).distinct()
    made = _zipped(files, r"(?m)^\s*(async\s+)?def\s+(\w+)\s*\(", 2).select("path", F.col("g2").alias("name"), (F.col("g1") != "").alias("is_async"))
    return used.join(made, ["path", "name"])


def middleware(files: DataFrame) -> DataFrame:
    return _zipped(files, r"\.add_middleware\(\s*(\w+)|@\w+\.middleware\(\s*[\"'](\w+)[\"']", 2).select("path", F.coalesce(F.nullif("g1", F.lit("")), "g2").alias("name"))


def models(files: DataFrame) -> DataFrame:
    """(path, name, table, body): classes that derive from a declarative base; the table defaults to the name in lower case."""
    rows = _zipped(files, _CLASS, 3).where(F.col("g2").rlike(r"\b(Base|db\.Model|DeclarativeBase|SQLModel)\b"))
    table = F.nullif(F.regexp_extract("g3", r"__tablename__\s*=\s*[\"'](\w+)[\"']", 1), F.lit(""))
    return rows.select("path", F.col("g1").alias("name"), F.coalesce(table, F.lower("g1")).alias("table"), F.col("g3").alias("body"))


def columns(found: DataFrame) -> DataFrame:
    """(path, name, column, type) of models."""
    pattern = r"(?m)^\s+(\w+)\s*(?::[^=\n]*)?=\s*(?:\w+\.)?(?:Column|mapped_column|Field)\(\s*(?:\w+\.)?(\w*)"
    rows = found.withColumns({"c": F.regexp_extract_all("body", F.lit(pattern), F.lit(1)), "t": F.regexp_extract_all("body", F.lit(pattern), F.lit(2))})
    return rows.select("path", "name", F.explode(F.arrays_zip("c", "t")).alias("m")).select("path", "name", F.col("m.c").alias("column"), F.nullif("m.t", F.lit("")).alias("type"))


def relationships(files: DataFrame) -> DataFrame:
    """(path, attribute, target): every relationship of a file."""
    return _zipped(files, r"(?m)^\s+(\w+)\s*(?::[^=\n]*)?=\s*(?:\w+\.)?relationship\(\s*[\"']?(\w+)", 2).select("path", F.col("g1").alias("attribute"), F.col("g2").alias("target"))


def url_patterns(files: DataFrame) -> DataFrame:
    """(path, route, view, name) of URL tables."""
    return _zipped(files, r"\b(?:re_)?path\(\s*r?[\"']([^\"']*)[\"']\s*,\s*([\w.]+)[^)\n]*?(?:name\s*=\s*[\"']([\w-]*)[\"'])?\s*\)", 3).select("path", F.col("g1").alias("route"), F.col("g2").alias("view"), F.nullif("g3", F.lit("")).alias("name"))


def url_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(r"(^|/)urls\.py$")).select("path")


def apps_containing(files: DataFrame, pattern: str) -> DataFrame:
    """(app, path): files that a pattern matches, under the first folder of their path."""
    return files.where(F.col("content").rlike(pattern) & F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("app"), "path")


def apps_containing_class(files: DataFrame, name: str) -> DataFrame:
    return apps_containing(files, rf"(?m)^class\s+{name}\b")


def settings(files: DataFrame, name: str) -> DataFrame:
    """(path, value): the text that a settings file assigns to a name at its top level."""
    return _zipped(files.where(F.col("path").rlike(r"settings[^/]*\.py$|/settings/")), rf"(?m)^({name})\s*=\s*([^\n]*)", 2).select("path", F.col("g2").alias("value"))
