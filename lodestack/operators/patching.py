"""Patches: unified and git diffs as change rows, their algebra, application, and the operations behind them.

`parse` gives one row per changed line; line numbers are running counts within a hunk. A patch is
small beside the corpus, so applying one is a join on the path, and only patched files reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE = "patch_id string, file string, old_path string, status string, hunks array<struct<old_start:int,old_count:int,new_start:int,new_count:int,section:string,changes:array<struct<type:string,content:string>>>>"
HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$")
KINDS = {"+": "add", "-": "delete", " ": "context"}


def _plain(path: str) -> str:
    path = path.split("\t")[0].strip()
    return path[2:] if path[:2] in ("a/", "b/") else path


def parse_patch(text: str | None) -> list[dict]:
    """The file patches of a diff text; nothing for an empty one."""
    out: list[dict] = []
    own: dict | None = None
    left = [0, 0]

    def begin(old: str, new: str) -> dict:
        out.append({"file": new, "old_path": old, "status": "modified", "hunks": []})
        return out[-1]

    for line in (text or "").split("\n"):
        if own and own["hunks"] and (left[0] > 0 or left[1] > 0) and (line[:1] in KINDS or line == ""):
            kind = KINDS[line[:1] or " "]
            own["hunks"][-1]["changes"].append({"type": kind, "content": line[1:]})
            left[0] -= kind != "add"
            left[1] -= kind != "delete"
        elif m := re.match(r"^diff --git a/(.*) b/(.*)$", line):
            own = begin(m[1], m[2])
        elif line.startswith("new file mode") and own:
            own["status"] = "added"
        elif line.startswith("deleted file mode") and own:
            own["status"] = "deleted"
        elif line.startswith("rename from ") and own:
            own |= {"status": "renamed", "old_path": line[12:]}
        elif line.startswith("rename to ") and own:
            own["file"] = line[10:]
        elif line.startswith("Binary files ") and own:
            own["status"] = "binary"
        elif line.startswith("--- "):
            old = _plain(line[4:])
            if own is None or own["hunks"]:
                own = begin(old, old)
            own["old_path"] = old
            if old == "/dev/null":
                own["status"] = "added"
        elif line.startswith("+++ ") and own:
            new = _plain(line[4:])
            if new == "/dev/null":
                own |= {"status": "deleted", "file": own["old_path"]}
            else:
                own["file"] = new
        elif (m := HUNK.match(line)) and own:
            left = [int(m[2] or 1), int(m[4] or 1)]
            own["hunks"].append({"old_start": int(m[1]), "old_count": left[0], "new_start": int(m[3]), "new_count": left[1], "section": m[5] or None, "changes": []})
    return out


def parse(patches: DataFrame) -> DataFrame:
    """file patches, with their hunks, of patches (patch_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"patch_id": k} | f for k, t in zip(b["patch_id"], b["text"], strict=True) for f in parse_patch(t)]
            yield pd.DataFrame(rows, columns=["patch_id", "file", "old_path", "status", "hunks"])

    return patches.select(F.col("patch_id").cast("string"), "text").mapInPandas(run, FILE)


def changes(parsed: DataFrame) -> DataFrame:
    """One row per line of a hunk, with the old and new line numbers that it has."""
    rows = parsed.select("patch_id", "file", F.posexplode("hunks").alias("hunk", "h")).select("patch_id", "file", "hunk", "h.old_start", "h.new_start", F.posexplode("h.changes").alias("seq", "c"))
    w = Window.partitionBy("patch_id", "file", "hunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    old = F.col("old_start") - 1 + F.sum(F.when(F.col("c.type") != "add", 1).otherwise(0)).over(w)
    new = F.col("new_start") - 1 + F.sum(F.when(F.col("c.type") != "delete", 1).otherwise(0)).over(w)
    return rows.select("patch_id", "file", "hunk", "seq", F.col("c.type").alias("type"), F.when(F.col("c.type") != "add", old).cast("int").alias("old_line"), F.when(F.col("c.type") != "delete", new).cast("int").alias("new_line"), F.col("c.content").alias("content"))


def reverse(parsed: DataFrame) -> DataFrame:
    """The patch that undoes: additions and deletions, ranges, paths and statuses swapped."""
    swapped = F.transform("hunks", lambda h: F.struct(
        h["new_start"].alias("old_start"), h["new_count"].alias("old_count"), h["old_start"].alias("new_start"), h["old_count"].alias("new_count"), h["section"].alias("section"),
        F.transform(h["changes"], lambda c: F.struct(F.when(c["type"] == "add", "delete").when(c["type"] == "delete", "add").otherwise("context").alias("type"), c["content"].alias("content"))).alias("changes"),
    ))
    status = F.when(F.col("status") == "added", "deleted").when(F.col("status") == "deleted", "added").otherwise(F.col("status"))
    return parsed.select("patch_id", F.when(F.col("status") == "renamed", F.col("old_path")).otherwise(F.col("file")).alias("file"), F.when(F.col("status") == "renamed", F.col("file")).otherwise(F.col("old_path")).alias("old_path"), status.alias("status"), swapped.alias("hunks"))


def to_text(parsed: DataFrame) -> DataFrame:
    """(patch_id, text): unified diffs again, files in order of their path."""
    sign = lambda c: F.concat(F.when(c["type"] == "add", "+").when(c["type"] == "delete", "-").otherwise(" "), c["content"])
    hunk = lambda h: F.concat(F.format_string("@@ -%d,%d +%d,%d @@", h["old_start"], h["old_count"], h["new_start"], h["new_count"]), F.coalesce(F.concat(F.lit(" "), h["section"]), F.lit("")), F.lit("\n"), F.array_join(F.transform(h["changes"], sign), "\n"), F.lit("\n"))
    old = F.when(F.col("status") == "added", "/dev/null").otherwise(F.concat(F.lit("a/"), F.col("old_path")))
    new = F.when(F.col("status") == "deleted", "/dev/null").otherwise(F.concat(F.lit("b/"), F.col("file")))
    text = F.concat(F.lit("--- "), old, F.lit("\n+++ "), new, F.lit("\n"), F.array_join(F.transform("hunks", hunk), ""))
    parts = F.array_sort(F.collect_list(F.struct("file", text.alias("text"))))
    return parsed.groupBy("patch_id").agg(F.array_join(parts["text"], "").alias("text"))


def summary(parsed: DataFrame) -> DataFrame:
    count = lambda kind: F.aggregate("hunks", F.lit(0), lambda n, h: n + F.size(F.filter(h["changes"], lambda c: c["type"] == kind)))
    return parsed.select("patch_id", "file", "status", F.size("hunks").alias("n_hunks"), count("add").alias("additions"), count("delete").alias("deletions"))


def splice(content: str, hunks: list) -> str:
    """Hunks applied by position, the last first; what stands at the position is not compared."""
    end = content.endswith("\n") or not content
    lines = content.split("\n")[: -1 if end else None]
    for h in sorted(hunks, key=lambda h: -h["old_start"]):
        at = h["old_start"] - 1 if h["old_count"] else h["old_start"]
        lines[at : at + h["old_count"]] = [c["content"] for c in h["changes"] if c["type"] != "delete"]
    return "\n".join(lines) + ("\n" if end and lines else "")


def apply(files: DataFrame, parsed: DataFrame, strict: bool = False) -> DataFrame:
    """results of applying a patch: path, status, success, error, original, new.

    New files have no original; deleted ones no new content. A patched file that isn't there is an
    error. With `strict`, so is a hunk whose context or deletions differ from the file.
    """
    rows = parsed.select(F.when(F.col("status").isin("renamed", "modified", "deleted"), F.col("old_path")).otherwise(F.col("file")).alias("path"), "file", "status", "hunks").join(files.select("path", F.col("content").alias("original")), "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                new, error, text = None, None, r.original
                hunks = [] if r.hunks is None else list(r.hunks)
                if r.status == "added":
                    new = splice("", [{**h, "old_start": 0, "old_count": 0} for h in hunks])
                elif text is None:
                    error = "file not found"
                elif strict and not _fits(text, hunks):
                    error = "context differs"
                elif r.status != "deleted":
                    new = splice(text, hunks)
                out.append((r.path, r.file, r.status, error is None, error, text, new))
            yield pd.DataFrame(out, columns=["path", "file", "status", "success", "error", "original", "new"])

    return rows.mapInPandas(run, "path string, file string, status string, success boolean, error string, original string, new string")


def _fits(content: str, hunks: list) -> bool:
    lines = content.split("\n")
    return all([c["content"] for c in h["changes"] if c["type"] != "add"] == lines[h["old_start"] - 1 : h["old_start"] - 1 + h["old_count"]] for h in hunks if h["old_count"])


# The patterns that name what a changed line defines, and the operation each stands for.
DEFINES = [
    ("class", r"^\s*class\s+(\w+)"),
    ("function", r"^(?:async\s+)?def\s+(\w+)"),
    ("method", r"^\s+(?:async\s+)?def\s+(\w+)"),
    ("decorator", r"^\s*@([\w.]+)"),
    ("import", r"^\s*((?:from\s+\S+\s+)?import\s+.+)$"),
]


def operations(parsed: DataFrame) -> DataFrame:
    """operations(patch_id, file, hunk, operation, kind, name, new_name, confidence) behind a patch.

    What is added and not deleted, and the reverse, of classes, functions, methods, decorators and
    imports; an addition and a deletion of a class, function or method in one file, in order, pair as a
    rename of confidence 0.8. Hunks without any of these count as line changes.
    """
    rows = changes(parsed).where("type <> 'context'")
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for kind, pattern in reversed(DEFINES):
        found = F.when(F.col("content").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("content", pattern, 1).alias("name"))).otherwise(found)
    named = rows.withColumn("d", found).where("d is not null").select("patch_id", "file", "hunk", "seq", "type", "d.kind", "d.name")
    both = named.groupBy("patch_id", "file", "kind", "name").agg(F.min("hunk").alias("hunk"), F.min("seq").alias("seq"), F.count_if(F.col("type") == "add").alias("added"), F.count_if(F.col("type") == "delete").alias("deleted"))
    net = both.where("added <> deleted").withColumn("side", F.when(F.col("added") > F.col("deleted"), "add").otherwise("delete"))
    nth = F.row_number().over(Window.partitionBy("patch_id", "file", "kind", "side").orderBy("hunk", "seq", "name"))
    net = net.withColumn("nth", nth).withColumn("alone", F.when(F.col("kind").isin("decorator", "import"), F.concat_ws(":", "side", "name")).otherwise(""))
    gone, come = (net.where(F.col("side") == s).select("patch_id", "file", "kind", "nth", "alone", F.col("hunk").alias(f"hunk_{s}"), F.col("name").alias(f"name_{s}")) for s in ("delete", "add"))
    pairs = gone.join(come, ["patch_id", "file", "kind", "nth", "alone"], "full")
    verb = F.when(F.col("name_add").isNull(), "delete").when(F.col("name_delete").isNull(), "add").otherwise("rename")
    out = pairs.select("patch_id", "file", F.coalesce("hunk_delete", "hunk_add").alias("hunk"), F.concat_ws("_", verb, "kind").alias("operation"), "kind", F.coalesce("name_delete", "name_add").alias("name"), F.when(verb == "rename", F.col("name_add")).alias("new_name"), F.when(verb == "rename", 0.8).otherwise(0.95).alias("confidence"))
    lines = rows.groupBy("patch_id", "file", "hunk").agg(F.count_if(F.col("type") == "add").alias("a"), F.count_if(F.col("type") == "delete").alias("d")).join(named.select("patch_id", "file", "hunk").distinct(), ["patch_id", "file", "hunk"], "left_anti")
    plain = F.when(F.col("d") == 0, "insert_lines").when(F.col("a") == 0, "delete_lines").otherwise("replace_lines")
    return out.unionByName(lines.select("patch_id", "file", "hunk", plain.alias("operation"), F.lit("line").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("new_name"), F.lit(0.5).alias("confidence")))


def to_code(parsed: DataFrame) -> DataFrame:
    """(patch_id, seq, line): the detected operations of a patch as calls of this engine's edits; what is no such operation is a comment."""
    rows = operations(parsed)
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    name, new = quote(F.col("name")), quote(F.col("new_name"))
    call = lambda f, *args: F.concat(F.lit(f"corpus.edit(edits.{f}, "), F.concat_ws(", ", *args), F.lit(")"))
    verb = (
        F.when(F.col("operation") == "rename_class", call("rename_class", name, new))
        .when(F.col("operation").isin("rename_function", "rename_method"), call("rename_function", name, new))
        .when(F.col("operation") == "add_import", call("add_import", name))
        .when(F.col("operation") == "delete_import", call("remove_import", name))
        .otherwise(F.concat(F.lit("# "), "operation", F.lit(" in "), "file", F.coalesce(F.concat(F.lit(": "), "name"), F.lit(""))))
    )
    order = Window.partitionBy("patch_id").orderBy("file", "hunk", "operation", "name")
    return rows.select("patch_id", (F.row_number().over(order) - 1).alias("seq"), verb.alias("line"))


def to_script(parsed: DataFrame) -> DataFrame:
    """(patch_id, text): a script that repeats a patch's operations on a corpus."""
    lines = F.array_sort(F.collect_list(F.struct("seq", "line")))
    head = "from lodestack.operators import edits\n\n\ndef main(corpus):\n"
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("    "), x["line"], F.lit("\n"))), "")
    return to_code(parsed).groupBy("patch_id").agg(F.concat(F.lit(head), body, F.lit("    return corpus\n")).alias("text"))


def file_operations(parsed: DataFrame) -> DataFrame:
    """(patch_id, file, operation, old_path): files that a patch creates, deletes or renames."""
    verb = F.when(F.col("status") == "added", "create_file").when(F.col("status") == "deleted", "delete_file").when(F.col("status") == "renamed", "rename_file")
    return parsed.where(verb.isNotNull()).select("patch_id", "file", verb.alias("operation"), F.when(F.col("status") == "renamed", F.col("old_path")).alias("old_path"))
