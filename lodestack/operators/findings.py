"""The list algebra of findings: filters, counts, orders and summaries as DataFrame operations.

Everything is an expression, so filters reach the scan, and counts merge before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITIES

# The types that each selection names.
GROUPS = {
    "complexity_issues": ["HIGH_COMPLEXITY", "LONG_FUNCTION", "LONG_CLASS", "DEEP_NESTING", "TOO_MANY_PARAMETERS", "TOO_MANY_BRANCHES", "TOO_MANY_RETURNS"],
    "dead_code": ["UNUSED_FUNCTION", "UNUSED_CLASS", "UNUSED_VARIABLE", "UNUSED_IMPORT", "UNREACHABLE_CODE"],
    "pattern_issues": ["MISSING_TYPE_HINT", "MISSING_DOCSTRING", "BARE_EXCEPT", "HARDCODED_STRING", "MAGIC_NUMBER", "TODO_COMMENT"],
    "secrets": ["HARDCODED_SECRET", "HARDCODED_PASSWORD", "HARDCODED_API_KEY", "HARDCODED_TOKEN", "HARDCODED_CRYPTO_KEY"],
    "injection_risks": ["SQL_INJECTION", "SHELL_INJECTION", "CODE_INJECTION", "TEMPLATE_INJECTION"],
    "unsafe_operations": ["UNSAFE_YAML_LOAD", "UNSAFE_PICKLE", "UNSAFE_EVAL", "UNSAFE_EXEC", "UNSAFE_DESERIALIZE"],
    "crypto_issues": ["INSECURE_RANDOM", "WEAK_CRYPTO", "INSECURE_HASH"],
    "dry_issues": ["DUPLICATE_CODE_BLOCK", "DUPLICATE_EXPRESSION", "DUPLICATE_LITERAL", "SIMILAR_FUNCTION", "REPEATED_PATTERN"],
    "loop_issues": ["LOOP_TO_COMPREHENSION", "LOOP_TO_DICT_COMPREHENSION", "LOOP_TO_SET_COMPREHENSION", "LOOP_TO_SUM", "LOOP_TO_JOIN", "LOOP_TO_ANY_ALL", "LOOP_TO_ENUMERATE", "LOOP_TO_ZIP", "LOOP_TO_MAP", "LOOP_TO_FILTER"],
    "efficiency_issues": ["INEFFICIENT_STRING_CONCAT", "INEFFICIENT_LIST_OPERATION", "UNNECESSARY_LIST_CONVERSION"],
}


class Findings:
    """A DataFrame of findings (or targets) with the list verbs; every verb returns a new one or a DataFrame."""

    def __init__(self, df: DataFrame, domain: str = "security"):
        self.df, self.domain = df, domain

    def _of(self, df: DataFrame) -> Findings:
        return Findings(df, self.domain)

    def rank(self, unknown: int = 99) -> Column:
        """0 for the most severe; `unknown` for a severity outside the domain's list."""
        out = F.lit(unknown)
        for k, s in enumerate(SEVERITIES[self.domain]):
            out = F.when(F.col("severity") == s, k).otherwise(out)
        return out

    def where(self, condition: Column | str) -> Findings:
        return self._of(self.df.where(condition))

    filter = where

    def in_file(self, path: str) -> Findings:
        return self.where(F.col("file_path") == path)

    def in_directory(self, directory: str) -> Findings:
        base = directory.rstrip("/")
        return self.where((F.col("file_path") == base) | F.col("file_path").startswith(base + "/"))

    def matching(self, pattern: str) -> Findings:
        return self.where(F.coalesce("name", F.lit("")).rlike(pattern))

    def by_type(self, *types: str) -> Findings:
        return self.where(F.col("type").isin(*types))

    by_types = by_type

    def by_severity(self, severity: str) -> Findings:
        return self.where(F.col("severity") == severity)

    def at_least(self, severity: str) -> Findings:
        """As severe as `severity` or more; all of them if that is none of the domain's."""
        names = SEVERITIES[self.domain]
        return self.where(self.rank(len(names) - 1) <= (names.index(severity) if severity in names else len(names) - 1))

    def select_group(self, group: str) -> Findings:
        return self.by_type(*GROUPS[group])

    def above(self, value: float) -> Findings:
        return self.where(F.col("value_num") > value)

    def below(self, value: float) -> Findings:
        return self.where(F.col("value_num") < value)

    def with_docstrings(self, has: bool = True) -> Findings:
        return self.where(F.col("docstring").isNotNull() if has else F.col("docstring").isNull())

    def without_docstrings(self) -> Findings:
        return self.with_docstrings(False)

    def count_by(self, *columns: str) -> DataFrame:
        return self.df.groupBy(*columns).agg(F.count("*").alias("n"))

    def grouped(self, column: str) -> DataFrame:
        """One row per value with the locations of its findings, in order."""
        return self.df.groupBy(column).agg(F.array_sort(F.collect_list(F.struct("file_path", "line_number", "type"))).alias("findings"))

    def sorted_by_severity(self, descending: bool = True) -> Findings:
        order = self.rank().asc() if descending else self.rank().desc()
        return self._of(self.df.orderBy(order, "file_path", "line_number", "type"))

    def sorted_by_location(self) -> Findings:
        return self._of(self.df.orderBy("file_path", "line_number", "type"))

    def sorted_by_value(self, descending: bool = True) -> Findings:
        value = F.coalesce("value_num", F.lit(0.0))
        return self._of(self.df.orderBy(value.desc() if descending else value.asc(), "file_path", "line_number"))

    def first(self, n: int = 1) -> Findings:
        return self._of(self.df.orderBy("file_path", "line_number", "type").limit(n))

    def last(self, n: int = 1) -> Findings:
        return self._of(self.df.orderBy(F.desc("file_path"), F.desc("line_number"), F.desc("type")).limit(n))

    def to_dicts(self) -> DataFrame:
        return self.df.select("type", F.col("file_path").alias("file"), F.col("line_number").alias("line"), "name", "message", "severity")

    def renamed(self, pattern: str, replacement: str) -> DataFrame:
        """Names as `pattern` replaced in them, with an error for rows without a name."""
        return self.df.withColumns({"new_name": F.regexp_replace("name", pattern, replacement), "error": F.when(F.col("name").isNull(), F.lit("target has no name"))})

    def summary(self) -> str:
        """A short text: the total, then a line per severity and per type by falling count."""
        rows = self.count_by("severity", "type").collect()
        by: dict[str, dict[str, int]] = {"severity": {}, "type": {}}
        for r in rows:
            for k in by:
                by[k][str(r[k])] = by[k].get(str(r[k]), 0) + r["n"]
        order = {s: k for k, s in enumerate(SEVERITIES[self.domain])}
        out = [f"Total: {sum(r['n'] for r in rows)} findings"]
        out += [f"  {s}: {n}" for s, n in sorted(by["severity"].items(), key=lambda x: order.get(x[0], 99))]
        return "\n".join(out + [f"  {t}: {n}" for t, n in sorted(by["type"].items(), key=lambda x: (-x[1], x[0]))])
