"""TODO comments and lint directives: line patterns in built-in expressions, no Python on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import explode_lines, strip

# The kinds of TODO comment, and their order of priority.
TODO_TYPES = ["TODO", "FIXME", "XXX", "HACK", "NOTE", "BUG"]
TODO = r"(?i)#\s*(TODO|FIXME|XXX|HACK|NOTE|BUG)\b(?:\(([^)]*)\))?\s*:?\s*(.*)$"
ISSUE = r"(#\d+|\bGH-\d+|\b[A-Z][A-Z0-9]+-\d+)"
DATE = r"\b(\d{4}-\d{2}-\d{2})\b"


def _part(text: Column | str, pattern: str, group: int) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def todos(files: DataFrame) -> DataFrame:
    """todos(path, line_number, type, text, author, priority, issue_ref, date, line): the first marker of each line.

    The parenthesis after the marker is a priority if it reads P1..P9, else an author.
    """
    rows = explode_lines(files).where(F.col("text").rlike(TODO))
    meta, body = _part("text", TODO, 2), strip(F.regexp_extract("text", TODO, 3))
    priority = F.regexp_extract(meta, r"(?i)^\s*P(\d)\s*$", 1)
    return rows.select(
        "path", "line_number", F.upper(F.regexp_extract("text", TODO, 1)).alias("type"), body.alias("text"),
        F.when(priority == "", strip(meta)).alias("author"), F.when(priority != "", priority.cast("int")).alias("priority"),
        _part(F.concat_ws(" ", meta, body), ISSUE, 1).alias("issue_ref"), F.try_to_date(_part(F.concat_ws(" ", meta, body), DATE, 1), "yyyy-MM-dd").alias("date"), F.col("text").alias("line"),
    )


def stale(found: DataFrame, days: int = 90, today: Column | None = None) -> DataFrame:
    return found.where(F.col("date") < F.date_sub(today if today is not None else F.current_date(), days))


def high_priority(found: DataFrame) -> DataFrame:
    return found.where(F.col("type").isin("FIXME", "BUG") | (F.coalesce("priority", F.lit(99)) <= 1))


def unlinked(found: DataFrame) -> DataFrame:
    return found.where(F.col("issue_ref").isNull())


def by_author(found: DataFrame, author: str) -> DataFrame:
    return found.where(F.lower("author") == author.lower())


def matching(found: DataFrame, pattern: str) -> DataFrame:
    return found.where(F.col("text").rlike(f"(?i){pattern}"))


def todo_summary(found: DataFrame) -> DataFrame:
    """One row: total, high_priority, with_issue, without_issue, files, and counts by type and author as maps."""
    urgent = F.col("type").isin("FIXME", "BUG") | (F.coalesce("priority", F.lit(99)) <= 1)
    by_type = found.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    authors = found.where(F.col("author").isNotNull()).groupBy("author").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("author", "n")))).alias("by_author"))
    total = found.agg(F.count("*").alias("total"), F.count_if(urgent).alias("high_priority"), F.count("issue_ref").alias("with_issue"), F.count_if(F.col("issue_ref").isNull()).alias("without_issue"), F.countDistinct("path").alias("files"))
    return total.crossJoin(by_type).crossJoin(authors)  # one row each


def add_todo(content: Column | str, number: int, text: str, kind: str = "TODO", author: str | None = None, own_line: bool = False) -> Column:
    """A TODO at the end of a line, or on a line of its own before it with its indentation."""
    from ..functions.text import edit_lines, lines_of

    note = f"# {kind}({author}): {text}" if author else f"# {kind}: {text}"
    if not own_line:
        return edit_lines(content, number, number, lambda x: F.concat(F.rtrim(x), F.lit("  " + note)))
    own = lines_of(content)
    at = F.element_at(own, number)
    return F.array_join(F.concat(F.slice(own, F.lit(1), F.lit(number - 1)), F.array(F.concat(F.regexp_extract(at, r"^\s*", 0), F.lit(note))), F.slice(own, F.lit(number), F.greatest(F.size(own) - number + 1, F.lit(0)))), "\n")


def issues(found: DataFrame, tracker: str = "github") -> DataFrame:
    """One issue payload per TODO as JSON text: github, gitlab, jira, or generic fields."""
    title = F.concat(F.col("type"), F.lit(": "), F.substring("text", 1, 80))
    body = F.concat(F.col("text"), F.lit("\n\nFile: "), "path", F.lit(", line "), F.col("line_number").cast("string"))
    labels = F.array(F.lower("type"))
    shapes = {
        "github": F.struct(title.alias("title"), body.alias("body"), labels.alias("labels")),
        "gitlab": F.struct(title.alias("title"), body.alias("description"), F.array_join(labels, ",").alias("labels")),
        "jira": F.struct(F.struct(title.alias("summary"), body.alias("description"), F.struct(F.when(F.col("type").isin("FIXME", "BUG"), "Bug").otherwise("Task").alias("name")).alias("issuetype")).alias("fields")),
    }
    generic = F.struct(title.alias("title"), body.alias("description"), F.col("type").alias("type"), "path", "line_number", "author", "priority")
    return found.select("path", "line_number", F.to_json(shapes.get(tracker, generic)).alias("payload"))


# The directives and the patterns that find each in a line; group 1 has the codes, where a kind has codes.
DIRECTIVES = {
    "type_ignore": r"#\s*type:\s*ignore(?:\[([^\]]*)\])?",
    "noqa": r"(?i)#\s*noqa(?::\s*([A-Z][A-Z0-9]*(?:\s*,\s*[A-Z][A-Z0-9]*)*))?",
    "pylint_disable": r"#\s*pylint:\s*disable=([\w\-]+(?:\s*,\s*[\w\-]+)*)",
    "pragma_no_cover": r"#\s*pragma:\s*no\s*cover",
    "fmt_off": r"#\s*fmt:\s*off",
    "fmt_on": r"#\s*fmt:\s*on",
    "fmt_skip": r"#\s*fmt:\s*skip",
    "isort_skip": r"#\s*isort:\s*skip(?:_file)?",
}


def directives(files: DataFrame) -> DataFrame:
    """directives(path, line_number, type, codes, reason, line): at most one of each kind on a line; noqa codes are upper-cased."""

    def found(kind: str, pattern: str) -> Column:
        codes = F.regexp_extract("text", pattern, 1) if kind in ("type_ignore", "noqa", "pylint_disable") else F.lit("")
        codes = F.upper(codes) if kind == "noqa" else codes
        listed = F.filter(F.transform(F.split(codes, ","), strip), lambda c: c != "")
        reason = strip(F.regexp_extract("text", pattern + r"[\s:\-–—]*#?\s*(.*)$", 2 if "(" in pattern.replace("(?", "") else 1))
        return F.when(F.col("text").rlike(pattern), F.struct(F.lit(kind).alias("type"), listed.alias("codes"), F.when(reason != "", reason).alias("reason")))

    rows = explode_lines(files).where(F.col("text").contains("#"))
    every = F.filter(F.array(*(found(k, p) for k, p in DIRECTIVES.items())), lambda x: x.isNotNull())
    rows = rows.select("path", "line_number", F.explode(every).alias("d"), F.col("text").alias("line"))
    return rows.select("path", "line_number", "d.type", "d.codes", "d.reason", "line")


def bare(found: DataFrame, kind: str) -> DataFrame:
    return found.where((F.col("type") == kind) & (F.size("codes") == 0))


def specific(found: DataFrame, kind: str) -> DataFrame:
    return found.where((F.col("type") == kind) & (F.size("codes") > 0))


def fmt_directives(found: DataFrame) -> DataFrame:
    return found.where(F.col("type").isin("fmt_off", "fmt_on", "fmt_skip"))


def without_reason(found: DataFrame) -> DataFrame:
    return found.where(F.col("reason").isNull())


def with_code(found: DataFrame, code: str) -> DataFrame:
    return found.where(F.array_contains("codes", code))


def count_by_code(found: DataFrame, top: int | None = None) -> DataFrame:
    counts = found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "code").limit(top) if top else counts


def directive_audit(found: DataFrame) -> DataFrame:
    """By kind: total, bare, specific, without_reason and distinct files."""
    return found.groupBy("type").agg(F.count("*").alias("total"), F.count_if(F.size("codes") == 0).alias("bare"), F.count_if(F.size("codes") > 0).alias("specific"), F.count_if(F.col("reason").isNull()).alias("without_reason"), F.countDistinct("path").alias("files"))


def remove_directive(content: Column | str, kind: str, number: int | None = None) -> Column:
    """A content without a kind of directive, and the blanks before it, on one line or on all."""
    from ..functions.text import lines_of

    gone = lambda x: F.regexp_replace(x, r"\s*" + DIRECTIVES[kind], "")
    return F.array_join(F.transform(lines_of(content), lambda x, i: F.when(F.lit(number is None) | (i + 1 == F.lit(number or 0)), F.when(x.rlike(DIRECTIVES[kind]), gone(x)).otherwise(x)).otherwise(x)), "\n")


def audit_lines(found: DataFrame, kind: str) -> DataFrame:
    """(type, part, key, n): a kind of directive counted by file and by code."""
    own = found.where(F.col("type") == kind)
    parts = [own.select(F.lit("file").alias("part"), F.col("path").alias("key")), own.select(F.lit("code").alias("part"), F.explode("codes").alias("key"))]
    return parts[0].unionByName(parts[1]).groupBy("part", "key").agg(F.count("*").alias("n")).select(F.lit(kind).alias("type"), "part", "key", "n")
