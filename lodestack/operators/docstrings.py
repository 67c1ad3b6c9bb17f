"""Docstrings: styles, structured parsing, and comparison with signatures."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .facts import Facts

# The section heads of the Google and NumPy styles, and the fields of the Sphinx style.
GOOGLE = r"(?m)^\s*(Args|Arguments|Parameters|Returns|Yields|Raises|Attributes|Examples?|Notes?):\s*$"
NUMPY = r"(?m)^\s*(Parameters|Returns|Yields|Raises|Attributes|Examples|Notes)\s*\n\s*-{3,}\s*$"
SPHINX = r"(?m)^\s*:(param|type|returns?|rtype|raises?)\b"
PARSED = "struct<style:string,summary:string,params:array<struct<name:string,type:string,text:string>>,returns:string,raises:array<string>>"


def style(docstring: Column | str) -> Column:
    """numpy, sphinx, google or plain, tested in that order."""
    doc = F.col(docstring) if isinstance(docstring, str) else docstring
    return F.when(doc.isNull(), None).when(doc.rlike(NUMPY), "numpy").when(doc.rlike(SPHINX), "sphinx").when(doc.rlike(GOOGLE), "google").otherwise("plain")


def parse_docstring(text: str) -> dict:
    """style, summary, params (name, type, text), returns and raises of a docstring."""
    kind = "numpy" if re.search(NUMPY, text) else "sphinx" if re.search(SPHINX, text) else "google" if re.search(GOOGLE, text) else "plain"
    out: dict = {"style": kind, "summary": text.strip().split("\n\n")[0].replace("\n", " ").strip() or None, "params": [], "returns": None, "raises": []}
    if kind == "sphinx":
        types = dict(re.findall(r"(?m)^\s*:type\s+(\w+):\s*(.*)$", text))
        out["params"] = [{"name": n, "type": t.strip() or types.get(n), "text": d.strip()} for t, n, d in re.findall(r"(?m)^\s*:param\s+((?:[\w.\[\], ]+\s)?)(\w+):\s*(.*)$", text)]
        out["returns"] = next(iter(re.findall(r"(?m)^\s*:returns?:\s*(.*)$", text)), None)
        out["raises"] = re.findall(r"(?m)^\s*:raises?\s+([\w.]+):", text)
    elif kind in ("google", "numpy"):
        parts = re.split(GOOGLE if kind == "google" else NUMPY, text)
        for head, body in zip(parts[1::2], parts[2::2], strict=True):
            lines = [x for x in body.split("\n") if x.strip()]
            least = min((len(x) - len(x.lstrip()) for x in lines), default=0)
            heads = [x.strip() for x in lines if len(x) - len(x.lstrip()) == least]
            if head in ("Args", "Arguments", "Parameters"):
                pattern = r"^\*{0,2}(\w+)\s*(?:\(([^)]*)\))?:\s*(.*)$" if kind == "google" else r"^\*{0,2}(\w+)\s*(?::\s*(.*))?()$"
                out["params"] += [{"name": m[1], "type": m[2] or None, "text": m[3]} for m in (re.match(pattern, h) for h in heads) if m]
            elif head in ("Returns", "Yields"):
                out["returns"] = " ".join(x.strip() for x in lines) or None
            elif head == "Raises":
                out["raises"] += [re.split(r"[:\s]", h)[0] for h in heads]
    return out


def _documented(facts: Facts, *of: str) -> DataFrame:
    """Definitions with `of` and `doc`, the structure of their docstring, null where there is none; the parse of the files gives both."""
    rows = facts.of("defs", "docs").select("path", F.explode(F.arrays_zip("defs", "docs")).alias("_x"))
    return rows.select("path", *(F.col(f"_x.defs.{c}").alias(c) for c in of), F.col("_x.docs").alias("doc"))


def parsed(facts: Facts) -> DataFrame:
    """(path, full_name, doc): the structured docstrings of functions and classes that have one."""
    return _documented(facts, "full_name").where("doc is not null")


def outdated(facts: Facts) -> DataFrame:
    """Functions whose docstring and signature differ: stale (documented, gone) and missing (there, undocumented) parameters.

    A function without a docstring misses all of its parameters.
    """
    real = F.transform(F.filter("params", lambda p: ~p["name"].isin("self", "cls")), lambda p: p["name"])
    own = _documented(facts, "kind", "full_name", "start_line", "params").where("kind <> 'class'").withColumn("names", real)
    documented = F.coalesce(F.transform("doc.params", lambda p: p["name"]), F.array().cast("array<string>"))
    rows = own.select("path", "full_name", "start_line", F.array_except(documented, "names").alias("stale"), F.array_except("names", documented).alias("missing"))
    return rows.where((F.size("stale") > 0) | (F.size("missing") > 0))


def missing(facts: Facts) -> DataFrame:
    return facts.heads.where("docstring is null").select("path", "full_name", "kind", "start_line")
