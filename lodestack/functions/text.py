"""Text as lines and matches, in built-in expressions.

Lines are numbered from 1 and end where Python's `splitlines` ends them; a final line end adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
"""What `str.strip` strips."""
_START = r"(?:^|(?<=[\n\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])|(?<=\r)(?!\n))"
_BLANK = r"[\t\x1F \xA0\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines_of(content: Column | str) -> Column:
    """The lines of a text as an array; none for an empty or null one."""
    parts = F.split(_col(content), LINE_END, -1)
    n = F.size(parts)
    return F.when(_col(content).isNull(), F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts))


def count_lines(content: Column | str) -> tuple[Column, Column, Column]:
    """How many lines a text has, and how many of them are blank or comments, counted over the text as a whole."""
    count = lambda p: F.coalesce(F.regexp_count(_col(content), F.lit(_START + p)), F.lit(0))
    return count(r"(?=[\s\S])"), count(rf"(?=[\s\S]){_BLANK}(?={LINE_END}|\z)"), count(rf"{_BLANK}#")


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(SPACE))


def explode_lines(files: DataFrame) -> DataFrame:
    """lines(path, module, line_number, text, kind): kind is blank, comment (a first `#`) or code."""
    rows = files.select("path", "module", F.posexplode(lines_of("content")).alias("_at", "text"))
    bare = strip("text")
    kind = F.when(bare == "", "blank").when(bare.startswith("#"), "comment").otherwise("code")
    return rows.select("path", "module", (F.col("_at") + 1).alias("line_number"), "text", kind.alias("kind"))


def search(files: DataFrame, pattern: str) -> DataFrame:
    """The lines that a regular expression matches anywhere."""
    return explode_lines(files).where(F.col("text").rlike(pattern))


def find_pattern(files: DataFrame, pattern: str) -> DataFrame:
    """matches(path, nth, text, start, line_number, column): all matches over whole contents, in order; start and column from 0."""
    rows = files.where(F.col("content").rlike(pattern)).select("path", F.explode(match_places(F.col("content"), pattern)).alias("m"))
    return rows.select("path", "m.nth", "m.text", "m.start", "m.line_number", "m.column")


def match_places(content: Column, pattern: str) -> Column:
    """The matches of a pattern as an array of (nth, text, start, line_number, column), in one pass.

    What stands between matches is cut once; starts, lines and columns are running sums over it.
    """
    parts = F.arrays_zip(F.split(content, pattern, -1).alias("before"), F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("text"))
    ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    after = lambda x, column: F.when(F.contains(x, F.lit("\n")), F.length(F.substring_index(x, "\n", -1))).otherwise(column + F.length(x))
    kind = "array<struct<nth:int,text:string,start:int,line_number:int,column:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit(0).alias("column"), F.array().cast(kind).alias("out"))

    def step(a: Column, p: Column) -> Column:
        at, line, column = a["at"] + F.length(p["before"]), a["line"] + ends(p["before"]), after(p["before"], a["column"])
        here = F.struct((F.size(a["out"]) + 1).alias("nth"), p["text"].alias("text"), at.alias("start"), line.alias("line_number"), column.alias("column"))
        more = F.struct((at + F.length(p["text"])).alias("at"), (line + ends(p["text"])).alias("line"), after(p["text"], column).alias("column"), F.array_append(a["out"], here).alias("out"))
        return F.when(p["text"].isNull(), a).otherwise(more)

    return F.aggregate(parts, start, step)["out"]


def replace_pattern(content: Column | str, pattern: str, replacement: str, count: int | None = None) -> Column:
    """All matches replaced, or the first `count`."""
    out = _col(content)
    if count is None:
        return F.regexp_replace(out, pattern, replacement)
    cuts = F.split(out, pattern, -1)
    found = F.regexp_extract_all(out, F.lit(pattern), F.lit(0))
    piece = lambda x, i: F.concat(x, F.when(i >= F.size(found), F.lit("")).when(i < count, F.regexp_replace(F.get(found, i), pattern, replacement)).otherwise(F.get(found, i)))
    return F.array_join(F.transform(cuts, piece), "")


def insert_at_line(content: Column | str, number: int, text: str) -> Column:
    """`text` as a line before line `number`; after the last line where the text is shorter."""
    own = lines_of(content)
    at = F.least(F.lit(number), F.size(own) + 1)
    return F.array_join(F.concat(F.slice(own, F.lit(1), at - 1), F.array(F.lit(text)), F.slice(own, at, F.greatest(F.size(own) - at + 1, F.lit(0)))), "\n")


def delete_lines(content: Column | str, start: int, end: int) -> Column:
    """Without lines start..end."""
    return F.array_join(F.filter(lines_of(content), lambda x, i: ~(i + 1).between(start, end)), "\n")


def edit_lines(content: Column | str, start: int, end: int, change) -> Column:
    """With `change` (Column -> Column) applied to lines start..end."""
    return F.array_join(F.transform(lines_of(content), lambda x, i: F.when((i + 1).between(start, end), change(x)).otherwise(x)), "\n")


def indent(content: Column | str, start: int, end: int, levels: int = 1, spaces: int = 4) -> Column:
    return edit_lines(content, start, end, lambda x: F.when(strip(x) == "", x).otherwise(F.concat(F.lit(" " * levels * spaces), x)))


def dedent(content: Column | str, start: int, end: int, levels: int = 1, spaces: int = 4) -> Column:
    return edit_lines(content, start, end, lambda x: F.regexp_replace(x, f"^ {{0,{levels * spaces}}}", ""))


def replace_in_lines(content: Column | str, start: int, end: int, pattern: str, replacement: str) -> Column:
    return edit_lines(content, start, end, lambda x: F.regexp_replace(x, pattern, replacement))


def move_lines(content: Column | str, start: int, end: int, before: int) -> Column:
    """Lines start..end moved to stand before line `before` (of the text as it was)."""
    own = lines_of(content)
    moved = F.slice(own, start, end - start + 1)
    head = F.filter(own, lambda x, i: (i + 1 < before) & ~(i + 1).between(start, end))
    tail = F.filter(own, lambda x, i: (i + 1 >= before) & ~(i + 1).between(start, end))
    return F.array_join(F.concat(head, moved, tail), "\n")
