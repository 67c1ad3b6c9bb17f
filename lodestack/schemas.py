"""Fixed schemas of the tables that operators exchange, and the closed sets of values in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "path string, module string, content string, is_test boolean"
FINDINGS = (
    "domain string, type string, file_path string, line_number int, end_line int, name string, message string, severity string, "
    "value_num double, value_str string, threshold double, code_snippet string, recommendation string, "
    "original_code string, suggested_code string, estimated_improvement string, context map<string,string>"
)
RESULTS = "success boolean, message string, path string, operation string, error string, diff string"
CHANGES = "patch_id string, file string, hunk int, seq int, type string, old_line int, new_line int, content string"

# The ranks of severities, 0 the most severe, by domain.
SEVERITIES = {
    "analysis": ["error", "warning", "info"],
    "security": ["critical", "high", "medium", "low"],
    "optimize": ["warning", "suggestion", "info"],
}


def finding(domain: str, type_: Column | str, **columns: Column | str | float | None) -> list[Column]:
    """The columns of a finding; those not given are null."""
    kinds = [c.strip().split(" ", 1) for c in FINDINGS.split(", ")]
    given = {"domain": domain, "type": type_} | columns
    out = []
    for name, kind in kinds:
        value = given.get(name)
        value = value if isinstance(value, Column) else F.lit(value)
        out.append(value.cast(kind).alias(name))
    return out


def union(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first
