"""Requirements and project metadata as rows, and conversion between their formats."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import dumps, loads

DEPENDENCY = "name string, version string, extras array<string>, marker string, url string, editable boolean"
_LINE = re.compile(r"^([A-Za-z0-9][\w.\-]*)\s*(?:\[([^\]]*)\])?\s*(?:@\s*(\S+)|\(?\s*((?:[<>=!~]=?=?\s*[^,;\s)]+\s*,?\s*)*)\)?)?\s*(?:;\s*(.*))?$")


def normal_name(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.col(name) if isinstance(name, str) else name, "[-_.]+", "-"))


def parse_line(line: str) -> dict | None:
    """One requirement, or None for a comment, an option or an empty line."""
    line = re.sub(r"\s#.*$|^#.*$", "", line).strip()
    editable = line.startswith(("-e ", "--editable "))
    if editable:
        url = line.split(None, 1)[1]
        name = re.search(r"#egg=([\w.\-]+)", url)
        return {"name": re.sub("[-_.]+", "-", name[1] if name else url.rstrip("/").split("/")[-1]).lower(), "version": None, "extras": [], "marker": None, "url": url, "editable": True}
    m = _LINE.match(line)
    if not line or line.startswith("-") or not m:
        return None
    return {"name": re.sub("[-_.]+", "-", m[1]).lower(), "version": re.sub(r"\s+", "", m[4] or "").rstrip(",") or None, "extras": [x.strip() for x in (m[2] or "").split(",") if x.strip()], "marker": m[5], "url": m[3], "editable": False}


def parse_requirements(text: str | None) -> tuple[list[dict], list[str]]:
    """(requirements, included files) of a requirements text; a backslash joins lines."""
    lines = re.sub(r"\\\r?\n", " ", text or "").splitlines()
    includes = [m[1] for x in lines if (m := re.match(r"^\s*(?:-r|--requirement)[ =]\s*(\S+)", x))]
    return [d for x in lines if (d := parse_line(x))], includes


def requirements(files: DataFrame) -> DataFrame:
    """(path, position, dependency columns) of requirement files, includes followed within the corpus by `includes`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p, "position": k} | d for p, t in zip(b["path"], b["content"], strict=True) for k, d in enumerate(parse_requirements(t)[0])]
            yield pd.DataFrame(rows, columns=["path", "position", "name", "version", "extras", "marker", "url", "editable"])

    return files.select("path", "content").mapInPandas(run, f"path string, position int, {DEPENDENCY}")


def includes(files: DataFrame) -> DataFrame:
    """edges (src, dst) from requirement files to those they include, for the closure of a file."""
    found = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:-r|--requirement)[ =]\s*(\S+)"), F.lit(1))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    return files.select(F.col("path").alias("src"), folder.alias("folder"), F.explode(found).alias("name")).select("src", F.concat("folder", "name").alias("dst"))


def package_format(document: Column | str, path: Column | str = "path") -> Column:
    """poetry, uv, pep621 or requirements, in that order, from a parsed configuration (JSON text) and its path."""
    doc = F.col(document) if isinstance(document, str) else document
    there = lambda p: F.coalesce(F.try_variant_get(F.try_parse_json(doc), p, "variant").isNotNull(), F.lit(False))
    return F.when(there("$.tool.poetry"), "poetry").when(there("$.tool.uv"), "uv").when(there("$.project"), "pep621").when((F.col(path) if isinstance(path, str) else path).rlike(r"requirements[^/]*\.txt$"), "requirements")


def dependencies_of(document: dict) -> list[dict]:
    """Requirements of a parsed pyproject document with their group: main, dev or an optional group's name."""
    out = [{"group": "main"} | d for x in document.get("project", {}).get("dependencies", []) if (d := parse_line(x))]
    groups = document.get("project", {}).get("optional-dependencies", {}) | document.get("dependency-groups", {})
    groups |= {"dev": document["tool"]["uv"]["dev-dependencies"]} if "dev-dependencies" in document.get("tool", {}).get("uv", {}) else {}
    out += [{"group": g} | d for g, own in groups.items() for x in own if isinstance(x, str) and (d := parse_line(x))]
    poetry = document.get("tool", {}).get("poetry", {})
    sections = {"main": poetry.get("dependencies", {}), "dev": poetry.get("dev-dependencies", {})} | {g: v.get("dependencies", {}) for g, v in poetry.get("group", {}).items()}
    for g, own in sections.items():
        for name, spec in own.items():
            if name != "python":
                version = spec.get("version") if isinstance(spec, dict) else spec
                version = None if version in (None, "*") else re.sub(r"^\^(\d.*)$", r">=\1", re.sub(r"^~(\d.*)$", r"~=\1", str(version)))
                out.append({"group": g, "name": re.sub("[-_.]+", "-", name).lower(), "version": version, "extras": spec.get("extras", []) if isinstance(spec, dict) else [], "marker": spec.get("markers") if isinstance(spec, dict) else None, "url": spec.get("git") if isinstance(spec, dict) else None, "editable": False})
    return out


def project_dependencies(config: DataFrame) -> DataFrame:
    """(path, group, dependency columns) of parsed pyproject documents (path, json)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p} | d for p, t in zip(b["path"], b["json"], strict=True) if t for d in dependencies_of(json.loads(t))]
            yield pd.DataFrame(rows, columns=["path", "group", "name", "version", "extras", "marker", "url", "editable"])

    return config.select("path", "json").mapInPandas(run, f"path string, group string, {DEPENDENCY}")


def requirement_text(d: dict) -> str:
    extras = f"[{','.join(d['extras'])}]" if d["extras"] else ""
    head = f"-e {d['url']}" if d["editable"] else f"{d['name']}{extras} @ {d['url']}" if d["url"] else f"{d['name']}{extras}{d['version'] or ''}"
    return head + (f" ; {d['marker']}" if d["marker"] else "")


def convert(content: str, source: str, target: str) -> str:
    """A dependency manifest from one format (requirements, pep621, poetry, uv) to another."""
    deps = [{"group": "main"} | d for d in parse_requirements(content)[0]] if source == "requirements" else dependencies_of(loads(content, "toml"))
    groups: dict[str, list[dict]] = {}
    for d in deps:
        groups.setdefault(d["group"], []).append(d)
    if target == "requirements":
        return "".join(f"{requirement_text(d)}\n" for d in groups.get("main", []))
    base = {} if source == "requirements" else loads(content, "toml")
    meta = base.get("project") or {k: v for k, v in base.get("tool", {}).get("poetry", {}).items() if k in ("name", "version", "description")}
    meta = {k: v for k, v in meta.items() if k not in ("dependencies", "optional-dependencies")}
    if target == "poetry":
        spec = lambda d: ({"version": d["version"] or "*", "extras": d["extras"]} if d["extras"] else d["version"] or "*")
        own = {g: {d["name"]: spec(d) for d in v} for g, v in groups.items()}
        return dumps({"tool": {"poetry": meta | {"dependencies": own.pop("main", {})} | ({"group": {g: {"dependencies": v} for g, v in own.items()}} if own else {})}}, "toml")
    project = meta | {"dependencies": [requirement_text(d) for d in groups.pop("main", [])]}
    if target == "uv":
        dev = groups.pop("dev", [])
        return dumps({"project": project | ({"optional-dependencies": {g: [requirement_text(d) for d in v] for g, v in groups.items()}} if groups else {}), "tool": {"uv": {"dev-dependencies": [requirement_text(d) for d in dev]}}}, "toml")
    return dumps({"project": project | ({"optional-dependencies": {g: [requirement_text(d) for d in v] for g, v in groups.items()}} if groups else {})}, "toml")


def bump_version(version: Column | str, part: str = "patch") -> Column:
    """The next version of `major.minor.patch` with any suffix dropped; null for other forms."""
    v = F.col(version) if isinstance(version, str) else version
    p = [F.regexp_extract(v, r"^(\d+)\.(\d+)\.(\d+)", k + 1).try_cast("long") for k in range(3)]
    k = ["major", "minor", "patch"].index(part)
    return F.when(v.rlike(r"^\d+\.\d+\.\d+"), F.concat_ws(".", *[(p[i] + 1 if i == k else p[i] if i < k else F.lit(0)).cast("string") for i in range(3)]))


def all_requirements(files: DataFrame) -> DataFrame:
    """(root, path, position, dependency columns): the requirements of each file and of all files that it includes, at whatever depth."""
    from .graph import closures

    roots = files.select(F.col("path").alias("root"))
    reach = closures(includes(files)).select("root", F.col("node").alias("path")).unionByName(roots.withColumn("path", F.col("root")))
    return reach.join(requirements(files), "path").select("root", "path", "position", "name", "version", "extras", "marker", "url", "editable")


def scripts(config: DataFrame) -> DataFrame:
    """(path, name, entry_point): the console scripts of parsed pyproject documents (path, json)."""
    kind = "struct<project:struct<scripts:map<string,string>>,tool:struct<poetry:struct<scripts:map<string,string>>>>"
    doc = F.from_json("json", kind)
    rows = config.select("path", F.map_concat(*(F.coalesce(c, F.from_json(F.lit("{}"), "map<string,string>")) for c in (doc["project"]["scripts"], F.map_filter(doc["tool"]["poetry"]["scripts"], lambda k, v: ~F.coalesce(F.map_contains_key(doc["project"]["scripts"], k), F.lit(False)))))).alias("s"))
    return rows.select("path", F.explode("s").alias("name", "entry_point"))
