"""Configuration documents as JSON text: dotted paths, sections and changes.

Reads are built-in expressions over VARIANT. Changes are plain functions on text, for a pandas UDF.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(dotted: str) -> str:
    """`a.b.0` as `$.a.b[0]`; numbers index lists."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in dotted.split(".") if p)


def get(doc: Column | str, dotted: str, kind: str = "string", default: Any = None) -> Column:
    got = F.try_variant_get(F.try_parse_json(doc), json_path(dotted), kind)
    return got if default is None else F.coalesce(got, F.lit(default).cast(kind))


def has_key(doc: Column | str, dotted: str) -> Column:
    """Whether the path is there; a null value counts."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(doc), json_path(dotted), "variant").isNotNull(), F.lit(False))


def keys(doc: Column | str, dotted: str = "") -> Column:
    return F.json_object_keys(F.to_json(F.try_variant_get(F.try_parse_json(doc), json_path(dotted), "variant")) if dotted else doc)


class Missing(KeyError):
    """A path that isn't there, or leads through something that isn't a section."""


def _parent(doc: Any, parts: list[str], create: bool) -> Any:
    for p in parts:
        if isinstance(doc, list) and p.isdigit() and int(p) < len(doc):
            doc = doc[int(p)]
        elif isinstance(doc, dict):
            if p not in doc and not create:
                raise Missing(p)
            doc = doc.setdefault(p, {})
        else:
            raise Missing(p)
    return doc


def set_value(doc: Any, dotted: str, value: Any) -> Any:
    doc, (*parts, last) = copy.deepcopy(doc), dotted.split(".")
    own = _parent(doc, parts, create=True)
    if isinstance(own, list) and last.isdigit() and int(last) < len(own):
        own[int(last)] = value
    elif isinstance(own, dict):
        own[last] = value
    else:
        raise Missing(last)
    return doc


def delete_key(doc: Any, dotted: str) -> Any:
    doc, (*parts, last) = copy.deepcopy(doc), dotted.split(".")
    own = _parent(doc, parts, create=False)
    if isinstance(own, dict) and last in own:
        del own[last]
    elif isinstance(own, list) and last.isdigit() and int(last) < len(own):
        del own[int(last)]
    else:
        raise Missing(last)
    return doc


def merge(doc: Any, other: Any, deep: bool = True) -> Any:
    if not (isinstance(doc, dict) and isinstance(other, dict)):
        return copy.deepcopy(other)
    out = copy.deepcopy(doc)
    for k, v in other.items():
        out[k] = merge(out[k], v) if deep and isinstance(out.get(k), dict) and isinstance(v, dict) else copy.deepcopy(v)
    return out


def append_to_list(doc: Any, dotted: str, value: Any) -> Any:
    doc, (*parts, last) = copy.deepcopy(doc), dotted.split(".")
    own = _parent(doc, parts, create=True)
    if not isinstance(own, dict) or not isinstance(own.setdefault(last, []), list):
        raise Missing(last)
    own[last].append(value)
    return doc


def remove_from_list(doc: Any, dotted: str, value: Any) -> Any:
    doc, parts = copy.deepcopy(doc), dotted.split(".")
    own = _parent(doc, parts, create=False)
    if not isinstance(own, list) or value not in own:
        raise Missing(dotted)
    own.remove(value)
    return doc


def changed(change: Callable[..., Any], *args: Any) -> Callable[[Column], Column]:
    """A column function: JSON text -> struct(json, error), by one of the changes above."""

    @F.pandas_udf("json string, error string")
    def run(docs: pd.Series) -> pd.DataFrame:
        rows = []
        for d in docs:
            try:
                rows.append((json.dumps(change(json.loads(d) if d else {}, *args)), None))
            except (Missing, ValueError) as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["json", "error"])

    return run


def loads(text: str, kind: str) -> Any:
    """A configuration text of a kind (json, yaml, toml, ini) as nested values."""
    if kind == "json":
        return json.loads(text)
    if kind == "yaml":
        import yaml

        return yaml.safe_load(text) or {}
    if kind == "toml":
        import tomllib

        return tomllib.loads(text)
    if kind == "ini":
        import configparser

        own = configparser.ConfigParser(interpolation=None)
        own.read_string(text)
        return {s: dict(own.items(s)) for s in own.sections()} | ({"DEFAULT": dict(own.defaults())} if own.defaults() else {})
    raise ValueError(f"unknown format {kind}")


def _toml(doc: dict, prefix: str = "") -> list[str]:
    """Tables as TOML lines, plain values before sub-tables, lists of tables last."""

    def scalar(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(scalar, v)) + "]"
        if isinstance(v, dict):
            return "{ " + ", ".join(f"{key(k)} = {scalar(x)}" for k, x in v.items()) + " }"
        return json.dumps(v, ensure_ascii=False) if isinstance(v, str) else str(v)

    def key(k: str) -> str:
        return k if k and all(c.isalnum() or c in "_-" for c in k) else json.dumps(k)

    tables = lambda v: isinstance(v, list) and v and all(isinstance(x, dict) for x in v)
    out = [f"{key(k)} = {scalar(v)}" for k, v in doc.items() if not isinstance(v, dict) and not tables(v)]
    for k, v in doc.items():
        name = f"{prefix}{key(k)}"
        if isinstance(v, dict):
            body = _toml(v, f"{name}.")
            plain = any(not isinstance(x, dict) and not tables(x) for x in v.values()) or not v
            out += ["", f"[{name}]", *body] if plain else body
        elif tables(v):
            for x in v:
                out += ["", f"[[{name}]]", *_toml(x, f"{name}.")]
    return out


def dumps(doc: Any, kind: str) -> str:
    """Nested values as a configuration text; comments of an earlier text are not kept."""
    if kind == "json":
        return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"
    if kind == "yaml":
        import yaml

        return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)
    if kind == "toml":
        return "\n".join(_toml(doc)).lstrip("\n") + "\n"
    if kind == "ini":
        return "\n".join(f"[{s}]\n" + "".join(f"{k} = {v}\n" for k, v in own.items()) for s, own in doc.items())
    raise ValueError(f"unknown format {kind}")
