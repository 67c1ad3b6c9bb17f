"""Source corpora rendered from a table by templates, with each line's place and meaning known in SQL.

A template is a list of blocks, each a condition and its lines. Conditions and what stands in braces
are SQL that Spark and other engines read alike, over the columns of `BASE`. So a corpus of any size
comes from a table of documents, one file for each, and what an analysis must find in it follows from
the template alone, without a parser: `rows` gives the SQL of the lines that carry a tag.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import of_columns

BASE = """SELECT doc_id AS d, CAST(floor(doc_id / 2) AS BIGINT) AS h, 2 * doc_id AS d2, 4 * doc_id AS d4, source AS s, coalesce(text, '') AS t,
  substr('p0, p1, p2, p3, p4, p5, p6, p7', 1, CAST(greatest(4 * (doc_id % 9) - 2, 0) AS INT)) AS ps, CASE WHEN doc_id % 3 = 0 THEN 'object' ELSE 'Root' END AS base,
  repeat(' ', CAST(4 * (doc_id % 7 + 1) AS INT)) AS deep FROM {documents}"""


@dataclass
class Line:
    """One line, or `times` equal ones, and its tags: a name and further columns as SQL for each."""

    text: str
    tags: dict[str, dict[str, str]] = field(default_factory=dict)
    times: int = 1


@dataclass
class Block:
    condition: str
    lines: list[Line]


def block(condition: str, *lines: str | Line) -> Block:
    return Block(condition, [x if isinstance(x, Line) else Line(x) for x in lines])


def literal(text: str) -> str:
    """A text with columns in braces as a SQL expression; `{{` and `}}` stand for braces."""
    if any(c in text for c in "'\\"):
        raise ValueError("quotes and backslashes differ between engines")
    out, plain, end = [], "", 0
    for m in [*re.finditer(r"\{(\w+)\}|\{\{|\}\}", text), None]:
        plain += text[end : m.start() if m else len(text)] + (m[0][0] if m and not m[1] else "")
        end = m.end() if m else end
        if plain and (m is None or m[1]):
            out.append(f"'{plain}'")
            plain = ""
        if m and m[1]:
            out.append(m[1])
    return " || ".join(out) if out else "''"


@dataclass
class Template:
    path: str
    blocks: list[Block]

    def content(self) -> str:
        """The content of a file as a SQL expression; every line ends."""
        parts = []
        for b in self.blocks:
            text = "".join(" || " * bool(k) + (f"repeat({literal(x.text)} || chr(10), {x.times})" if x.times > 1 else f"{literal(x.text)} || chr(10)") for k, x in enumerate(b.lines))
            parts.append(text if b.condition == "true" else f"CASE WHEN {b.condition} THEN {text} ELSE '' END")
        return " || ".join(f"({p})" for p in parts)

    def files(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The corpus: one file for each document."""
        documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        base = documents.selectExpr(*_columns())
        return of_columns(base.select(F.expr(literal(self.path)).alias("path"), F.expr(self.content()).alias("content")))

    def sql(self) -> str:
        """Common table expressions: m (path, columns of BASE, and b0, b1, ..., the line before each block) and files (path, content)."""
        before, starts = "0", []
        for k, b in enumerate(self.blocks):
            starts.append(f"{before} AS b{k}")
            size = sum(x.times for x in b.lines)
            before = f"b{k} + {size}" if b.condition == "true" else f"b{k} + CASE WHEN {b.condition} THEN {size} ELSE 0 END"
        return f"m AS (SELECT CAST({literal(self.path)} AS VARCHAR) AS path, *, {', '.join(starts)}, {before} AS total FROM ({BASE.format(documents='documents')})), files AS (SELECT path, d, {self.content()} AS content FROM m)"

    def rows(self, tag: str, columns: str = "") -> str:
        """SELECT path, line_number and the tag's columns of every line that carries the tag."""
        out = []
        for k, b in enumerate(self.blocks):
            at = 1
            for x in b.lines:
                if tag in x.tags:
                    own = "".join(f", {v.replace('LINE', f'(b{k} + {at})')} AS {n}" for n, v in sorted(x.tags[tag].items()))
                    out.append(f"SELECT path, (b{k} + {at})::INT AS line_number{own} FROM m WHERE {b.condition}")
                at += x.times
        return " UNION ALL ".join(out)


def _columns() -> list[str]:
    """The columns of BASE as Spark expressions."""
    body = BASE[len("SELECT ") : BASE.index(" FROM")]
    out, depth, start = [], 0, 0
    quoted = False
    for k, c in enumerate(body):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(body[start:k].strip())
                start = k + 1
    return [*out, body[start:].strip()]
