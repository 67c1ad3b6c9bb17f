"""Registered queries of edits, patches, loops, repetition, frameworks and manifests, over corpora rendered from all documents.

What an edit must give is the template's own text with the change written out, as SQL replacements.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import config, text
from .operators import analysis, conversions, edits, frameworks, modernize, packaging, patching, transactions
from .operators.facts import Facts
from .operators.findings import GROUPS, Findings
from .plans import reports
from .plans.corpus import Corpus
from .plans.rendered import Line, Template, block, literal
from .queries import query
from .rounds import cut
from .schemas import union
from .sources.files import of_columns, parse_config


def _every(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _q(x: str) -> str:
    """A text as a DuckDB literal."""
    return "'" + x.replace("'", "''") + "'" if "\n" not in x else "(" + " || chr(10) || ".join(_q(p) for p in x.split("\n")) + ")"


# One file for each document, with everything that the edits change.
SHOP = Template("shop/s{d}.py", [
    block("true", "import os", "from typing import Optional", "", "", "@dec", "class Store(object):", '    """Keeps {d}."""', "", "    size: int = 1", "    name: str = str({d})", "", "    def get(self, key, other: int = {d}) -> int:", '        """Get."""', "        if key:", "            return self.get(other, key)", "        raise KeyError(key)", "", "    @staticmethod", "    def make(value):", "        return value"),
    block("true", "", "", "async def fetch(url, count=None):", "    async with open(url) as f:", "        return await f.read()", "", "", "def plain(a, b=1):  # keep", '    text = "{{}} {{}}".format(a, b)', "    return Store(text)", "", "", "def old(x: Optional[int], *rest, **more) -> int:", '    return "%s-%d" % (x, {d})', "", "", "limit = {d}"),
])

# Each edit, and what it must change in the text: pairs of old and new, in order.
NAMES = {
    "rename_class": (edits.rename_class, ("Store", "Depot"), [("class Store(", "class Depot("), ("return Store(", "return Depot(")]),
    "rename_method": (edits.rename_function, ("get", "take", "Store"), [("def get(", "def take("), ("self.get(", "self.take(")]),
    "rename_function": (edits.rename_function, ("plain", "simple"), [("def plain(", "def simple(")]),
    "replace_identifier": (edits.replace_identifier, ("Store", "make", "value", "thing"), [("return value", "return thing")]),
    "add_class_decorator": (edits.add_decorator, ("Store", "frozen", None, "class"), [("@dec\n", "@frozen\n@dec\n")]),
    "add_function_decorator": (edits.add_decorator, ("plain", "@cache"), [("def plain(", "@cache\ndef plain(")]),
    "add_method_decorator": (edits.add_decorator, ("get", "cache", "Store"), [("    def get(", "    @cache\n    def get(")]),
    "remove_decorator": (edits.remove_decorator, ("Store", "dec", None, "class"), [("@dec\n", "")]),
    "remove_method_decorator": (edits.remove_decorator, ("make", "staticmethod", "Store"), [("    @staticmethod\n", "")]),
    "static_to_class_method": (edits.static_to_class_method, ("Store", "make"), [("@staticmethod", "@classmethod"), ("make(value)", "make(cls, value)")]),
    "add_base_class": (edits.add_base_class, ("Store", "Base"), [("Store(object)", "Store(object, Base)")]),
    "remove_base_class": (edits.remove_base_class, ("Store", "object"), [("Store(object)", "Store")]),
    "old_style": (edits.remove_object_bases, (), [("Store(object)", "Store")]),
}
PARAMETERS = {
    "add_parameter": (edits.add_parameter, ("plain", "c", "str", '"x"'), [("plain(a, b=1)", 'plain(a, b=1, c: str = "x")')]),
    "add_required": (edits.add_parameter, ("plain", "c"), [("plain(a, b=1)", "plain(a, c, b=1)")]),
    "add_first_parameter": (edits.add_parameter, ("get", "first", None, None, "Store", "start"), [("get(self, key", "get(self, first, key")]),
    "remove_parameter": (edits.remove_parameter, ("plain", "b"), [("plain(a, b=1)", "plain(a)")]),
    "remove_star": (edits.remove_parameter, ("old", "rest"), [(", *rest", "")]),
    "rename_parameter": (edits.rename_parameter, ("get", "key", "name", "Store"), [("get(self, key", "get(self, name"), ("if key:", "if name:"), ("(other, key)", "(other, name)"), ("KeyError(key)", "KeyError(name)")]),
    "reorder_parameters": (edits.reorder_parameters, ("fetch", ["url"]), []),
    "set_parameter_type": (edits.set_parameter_type, ("plain", "a", "int"), [("plain(a,", "plain(a: int,")]),
    "set_return_type": (edits.set_return_type, ("plain", "str"), [("b=1):", "b=1) -> str:")]),
    "remove_type_hints": (edits.remove_type_hints, ("old",), [("x: Optional[int]", "x"), ("more) -> int", "more)")]),
    "infer_type_hints": (edits.infer_type_hints, ("fetch",), [("(url, count=None)", "(url: str, count: int=None)")]),
    "modernize_hints": (edits.modernize_hints, (), [("Optional[int]", "int | None")]),
}
BODIES = {
    "to_async": (edits.convert_to_async, ("plain",), [("def plain(", "async def plain(")]),
    "to_sync": (edits.convert_to_sync, ("fetch",), [("async def fetch", "def fetch"), ("async with", "with"), ("await f", "f")]),
    "insert_start": (edits.insert_statement, ("get", "check(key)", "Store"), [("        if key:", "        check(key)\n        if key:")]),
    "insert_end": (edits.insert_statement, ("plain", "done()", None, "end"), [("return Store(text)\n", "return Store(text)\n    done()\n")]),
    "add_logging": (edits.add_logging, ("plain", None, "info", "log"), [("  # keep\n", '  # keep\n    log.info("plain called")\n')]),
    "wrap_with_try": (edits.wrap_with_try, ("make", ["ValueError"], "raise", "Store"), [("        return value\n", "        try:\n            return value\n        except ValueError as e:\n            raise\n")]),
    "insert_at_match": (modernize.insert_at_match, (r"raise KeyError", "note()", "after", "Store", "get"), [("raise KeyError(key)\n", "raise KeyError(key)\n        note()\n")]),
    "replace_at_match": (modernize.insert_at_match, (r"^limit", "limit = -1", "replace"), [("limit = {d}", "limit = -1")]),
    "format_to_fstring": (edits.format_to_fstring, (), [('"{} {}".format(a, b)', 'f"{a} {b}"')]),
    "percent_to_fstring": (conversions.percent_to_fstring, (), [('"%s-%d" % (x, {d})', 'f"{x}-{{d}:d}"')]),
    "set_docstring": (edits.set_docstring, ("get", "New.", "Store"), [('"""Get."""', '"""New."""')]),
    "replace_in": (edits.replace_in, ("plain", "Store", "Other"), [("return Store(", "return Other(")]),
    "delete_function": (modernize.delete_definition, ("plain",), [('\ndef plain(a, b=1):  # keep\n    text = "{} {}".format(a, b)\n    return Store(text)\n', "")]),
}
MODULES = {
    "add_class_attribute": (edits.add_class_attribute, ("Store", "kind", "str"), [("    size: int", "    kind: str = None\n    size: int")]),
    "remove_class_attribute": (edits.remove_class_attribute, ("Store", "size"), [("    size: int = 1\n", "")]),
    "remove_assignment": (edits.remove_assignment, ("limit",), [("limit = {d}\n", "")]),
    "add_import": (edits.add_import, ("import sys",), [("import os\n", "import sys\nimport os\n")]),
    "remove_import": (edits.remove_import, ("import os",), [("import os\n", "")]),
    "rename_import": (edits.rename_import, ("typing", "kinds"), [("from typing", "from kinds")]),
    "set_header": (edits.set_header, ("Copyright 2020",), [("import os\n", "# Copyright 2020\nimport os\n")]),
    "set_exports": (edits.set_exports, (["Store"],), [("Optional\n", 'Optional\n\n__all__ = [\n    "Store",\n]\n')]),
    "add_property": (conversions.add_property, ("Store", "double", "int", "self.size"), [("        return value\n", "        return value\n\n    @property\n    def double(self) -> int:\n        return self.size\n")]),
    "add_context_manager": (conversions.add_context_manager, ("Store",), [("        return value\n", "        return value\n\n    def __enter__(self):\n        return self\n\n    def __exit__(self, kind, value, trace):\n        self.close()\n")]),
    "add_repr": (edits.add_dunder, ("Store", "repr"), [("        return value\n", '        return value\n\n    def __repr__(self) -> str:\n        return f"Store(size={self.size!r}, name={self.name!r})"\n')]),
    "extract_protocol": (conversions.extract_protocol, ("Store",), [("import os\n", "from typing import Protocol\nimport os\n"), ("@dec\n", "class StoreProtocol(Protocol):\n    def get(self, key, other: int={d}) -> int: ...\n\n    def make(value): ...\n\n\n@dec\n")]),
    "extract_abstract_base": (conversions.extract_abstract_base, ("Store",), [("import os\n", "from abc import ABC, abstractmethod\nimport os\n"), ("@dec\n", "class AbstractStore(ABC):\n    @abstractmethod\n    def get(self, key, other: int={d}) -> int: ...\n\n    @abstractmethod\n    def make(value): ...\n\n\n@dec\n")]),
    "organize_imports": (modernize.organize_imports, (), []),
}


def _expected(changes: list[tuple[str, str]]) -> str:
    out = "content"
    for old, new in changes:
        put = lambda x: _q(x).replace("{d}", "' || d || '").replace("{' || d || ':d}", "{' || d || ':d}")
        out = f"replace({out}, {put(old)}, {put(new)})"
    return out


def _edit_sql(table: dict) -> str:
    return f"WITH {SHOP.sql()} " + " UNION ALL ".join(f"SELECT '{k}' AS operation, path, {'true' if changes else 'false'} AS success, {f'md5({_expected(changes)})' if changes else 'NULL::VARCHAR'} AS new_md5 FROM files" for k, (_, _, changes) in table.items())


def _edited(spark: SparkSession, sf_dir: str, table: dict) -> DataFrame:
    """All edits of a table on all files; one that changes nothing is an error."""
    files = SHOP.files(spark, sf_dir)
    done = edits.edit_all(files, {k: (f, args, {}) for k, (f, args, _) in table.items()}, ("success", "path", "operation", "original", "new"))
    changed = done["success"] & (done["new"] != done["original"])
    return done.select("operation", "path", changed.alias("success"), F.when(changed, F.md5(F.col("new").cast("binary"))).alias("new_md5"))


@query("edit_names", _edit_sql(NAMES))
def edit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, NAMES)


@query("edit_parameters", _edit_sql(PARAMETERS))
def edit_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, PARAMETERS)


@query("edit_bodies", _edit_sql(BODIES))
def edit_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, BODIES)


@query("edit_modules", _edit_sql(MODULES))
def edit_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, MODULES)


@query("edit_rename_class", f"WITH {SHOP.sql()} SELECT path, 'edits done' AS message, 'edits' AS operation, NULL::VARCHAR AS error, md5(replace(replace(content, 'class Store(', 'class Depot('), 'return Store(', 'return Depot(')) AS new_md5, '--- a/' || path AS first_line FROM files")
def edit_rename_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result of an edit: message, error, diff and content."""
    done = Corpus(SHOP.files(spark, sf_dir)).edit(edits.rename_class, "Store", "Depot", operation="edits")
    return done.select("path", "message", "operation", "error", F.md5(F.col("new").cast("binary")).alias("new_md5"), F.substring_index("diff", "\n", 1).alias("first_line"))


_TARGETS = {
    "rename": (edits.rename_matching, ("^(get|plain)$", r"\1_it"), [("def get(", "def get_it("), ("self.get(", "self.get_it("), ("def plain(", "def plain_it(")]),
    "insert_statement": (edits.insert_statement, ("trace()",), [("        if key:", "        trace()\n        if key:"), ("  # keep\n", "  # keep\n    trace()\n")]),
    "replace_all": (edits.replace_in, ("key|text", "item"), [("get(self, key", "get(self, item"), ("if key:", "if item:"), ("(other, key)", "(other, item)"), ("KeyError(key)", "KeyError(item)"), ("text = ", "item = "), ("Store(text)", "Store(item)")]),
    "delete": (modernize.delete_definition, (), [("\n    def get(self, key, other: int = {d}) -> int:\n        \"\"\"Get.\"\"\"\n        if key:\n            return self.get(other, key)\n        raise KeyError(key)\n", ""), ('\ndef plain(a, b=1):  # keep\n    text = "{} {}".format(a, b)\n    return Store(text)\n', "")]),
}


@query("target_verbs", f"WITH {SHOP.sql()} " + " UNION ALL ".join(f"SELECT '{k}' AS operation, path, NULL::VARCHAR AS error, md5({_expected(changes)}) AS new_md5 FROM files" for k, (_, _, changes) in _TARGETS.items()))
def target_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of targets renamed, deleted, given a statement and replaced in: two functions of every file."""
    files = SHOP.files(spark, sf_dir)
    targets = Facts(files).heads.where("full_name in ('Store.get', 'plain')")
    done = edits.edit_all_targets(files, targets, {k: (f, args, {}) for k, (f, args, _) in _TARGETS.items()}, ("path", "operation", "error", "new"))
    return done.select("operation", "path", "error", F.md5(F.col("new").cast("binary")).alias("new_md5"))


@query("find_definitions", f"WITH {SHOP.sql()} SELECT path, 'class' AS kind, 'Store' AS name FROM files UNION ALL SELECT path, 'function', unnest(['plain', 'old']) FROM files UNION ALL SELECT path, 'method', 'get' FROM files UNION ALL SELECT path, 'string', 'Keeps ' || d || '.' FROM files")
def find_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = Corpus(SHOP.files(spark, sf_dir))
    found = [corpus.find_classes(r"^S\w+$"), corpus.find_functions("^(plain|old)$"), corpus.find_methods("^g")]
    rows = [x.select("path", "kind", "name") for x in found]
    return _every([*rows, corpus.find_strings(r"^Keeps \d+").select("path", F.lit("string").alias("kind"), F.col("value").alias("name"))])


@query("stub_signatures", f"WITH {SHOP.sql()} SELECT path, unnest(['    def get(self, key, other: int=' || d || ') -> int:', '    def make(value):', 'async def fetch(url, count=None):', 'def plain(a, b=1):', 'def old(x: Optional[int], *rest, **more) -> int:']) AS line FROM files")
def stub_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits.edit(SHOP.files(spark, sf_dir), edits.generate_stub).select("path", F.explode(F.split("new", "\n")).alias("line"))
    return rows.where("line rlike '^ *(async )?def '")


# Classes and tests that the larger conversions change.
KINDS = Template("kinds/k{d}.py", [
    block("true", "from __future__ import division, annotations", "import unittest", "import six", "from dataclasses import dataclass", "", "", "class Point:", "    x: int", "    y: int = {d}", "", "", "@dataclass", "class Pair:", "    a: int", "    b: int = {d}", "", "", "class Box:", "    def __init__(self, w: int, h=2):", "        self.w = w", "        self.h = h", "", "", "class TestBox(unittest.TestCase):", "    def test_it(self):", "        self.assertEqual(Box({d}).w, {d})", "        self.assertEquals(Box(1).h, 2)", "        with self.assertRaises(TypeError):", "            Box()", "", "", "def total(a, b):", "    # type: (int, six.text_type) -> int", "    values = []  # type: list[int]", "    return values", "", "", "text = six.text_type({d})"),
])
CONVERSIONS = {
    "to_typed_dict": (conversions.to_typed_dict, ("Point",), [("import unittest\n", "from typing import TypedDict\nimport unittest\n"), ("class Point:\n    x: int\n    y: int = {d}\n", "class Point(TypedDict):\n    x: int\n    y: int\n")]),
    "to_named_tuple": (conversions.to_named_tuple, ("Point",), [("import unittest\n", "from typing import NamedTuple\nimport unittest\n"), ("class Point:\n", "class Point(NamedTuple):\n")]),
    "to_dataclass": (edits.convert_to_dataclass, ("Box",), [("class Box:\n    def __init__(self, w: int, h=2):\n        self.w = w\n        self.h = h\n", "@dataclass\nclass Box:\n    w: int\n    h: object = 2\n")]),
    "from_dataclass": (conversions.from_dataclass, ("Pair",), [("@dataclass\nclass Pair:\n    a: int\n    b: int = {d}\n", "class Pair:\n\n    def __init__(self, a: int, b: int = {d}) -> None:\n        self.a = a\n        self.b = b\n")]),
    "to_pytest": (conversions.unittest_to_pytest, (), [("import unittest\n", "import pytest\n"), ("TestBox(unittest.TestCase)", "TestBox"), ("self.assertEqual(Box({d}).w, {d})", "assert Box({d}).w == {d}"), ("self.assertRaises", "pytest.raises")]),
    "python2": (conversions.remove_future_imports, (), [("import division, annotations", "import annotations")]),
    "deprecated": (modernize.replace_deprecated, (), [("assertEquals", "assertEqual")]),
    "six": (modernize.remove_six, (), [("import six\n", ""), ("= six.text_type(", "= str(")]),
    "type_comments": (modernize.type_comments, (), [("(a, b):\n    # type: (int, six.text_type) -> int\n", "(a: int, b: six.text_type) -> int:\n"), ("values = []  # type: list[int]", "values: list[int] = []")]),
    "to_property": (modernize.attribute_to_property, ("Box", "w", "int", False), [("self.w = w", "self._w = w"), ("        self.h = h\n", "        self.h = h\n\n    @property\n    def w(self) -> int:\n        return self._w\n")]),
    "organize": (modernize.organize_imports, (), [("import unittest\nimport six\nfrom dataclasses import dataclass\n", "\nimport unittest\nfrom dataclasses import dataclass\n\nimport six\n")]),
}


@query("edit_conversions", _edit_sql(CONVERSIONS).replace(SHOP.sql(), KINDS.sql()))
def edit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = KINDS.files(spark, sf_dir)
    done = edits.edit_all(files, {k: (f, args, {}) for k, (f, args, _) in CONVERSIONS.items()}, ("success", "path", "operation", "new"))
    return done.select("operation", "path", "success", F.md5(F.col("new").cast("binary")).alias("new_md5"))


@query("deprecated_usage", f"WITH {KINDS.sql()} SELECT path, 27::INT AS line_number, 'assertEquals' AS old, 'assertEqual' AS new, 'method' AS category FROM files")
def deprecated_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modernize.deprecated(KINDS.files(spark, sf_dir))


@query("split_and_merge", f"WITH {SHOP.sql()} SELECT path, 5 AS files, '__init__.py,fetch.py,old.py,plain.py,store.py' AS names, true AS merged FROM files")
def split_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules split into one file for each definition, and merged again: all definitions are there."""
    names = F.udf(lambda c: ",".join(sorted(edits.split_module(c))), "string")
    merged = F.udf(lambda c: all(x in conversions.merge_modules(list(edits.split_module(c).values())) for x in ("class Store", "def fetch", "def plain", "def old")), "boolean")
    rows = SHOP.files(spark, sf_dir).select("path", names("content").alias("names"), merged("content").alias("merged"))
    return rows.select("path", F.size(F.split("names", ",")).alias("files"), "names", "merged")


@query("test_stub_lines", f"WITH {SHOP.sql()} SELECT path, unnest(['def test_plain():', 'def test_old():', 'def test_fetch():', 'class TestStore:']) AS line FROM files")
def test_stub_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits.edit(SHOP.files(spark, sf_dir), conversions.test_stubs, "shop").select("path", F.explode(F.split("new", "\n")).alias("line"))
    return rows.where("line rlike '^(def|class) '")


# Loops: one for each pattern, picked by the id. What each may become, and how sure that is.
_LOOPS = [
    (["for i in a{d}:", "    out.append(i)"], [("LOOP_TO_COMPREHENSION", "out = list(a{d})", 0.95)]),
    (["for i in a{d}:", "    out.append(g(i))"], [("LOOP_TO_COMPREHENSION", "out = [g(i) for i in a{d}]", 0.95), ("LOOP_TO_MAP", "out = list(map(g, a{d}))", 0.85)]),
    (["for i in a{d}:", "    out[i] = i + {d}"], [("LOOP_TO_DICT_COMPREHENSION", "out = {{i: i + {d} for i in a{d}}}", 0.9)]),
    (["for i in a{d}:", "    out.add(i * 2)"], [("LOOP_TO_SET_COMPREHENSION", "out = {{i * 2 for i in a{d}}}", 0.95)]),
    (["for i in a{d}:", "    out += i * 2"], [("LOOP_TO_SUM", "out = sum(i * 2 for i in a{d})", 0.95)]),
    (["for i in a{d}:", "    out += str(i)"], [("LOOP_TO_SUM", "out = sum(str(i) for i in a{d})", 0.95), ("LOOP_TO_JOIN", "out = {q}{q}.join(str(i) for i in a{d})", 0.8)]),
    (["def any{d}():", "    for i in a{d}:", "        if i > {d}:", "            return True", "    return False"], [("LOOP_TO_ANY_ALL", "return any(i > {d} for i in a{d})", 0.85)]),
    (["for i in a{d}:", "    if i > {d}:", "        out.append(i)"], [("LOOP_TO_FILTER", "out = [i for i in a{d} if i > {d}]", 0.9)]),
    (["for i in a{d}:", "    print(i, n)", "    n += 1"], [("LOOP_TO_ENUMERATE", "for n, i in enumerate(a{d})", 0.9)]),
    (["for i in range(len(a{d})):", "    print(a{d}[i])"], [("LOOP_TO_ZIP", "for i, item in enumerate(a{d})", 0.7)]),
]


def _suggest(x: str) -> str:
    return " || chr(39) || ".join(literal(p) for p in x.split("{q}")) if "{q}" in x else literal(x)


LOOPS = Template("loops/l{d}.py", [
    block("true", "a{d} = [{d}]", "out = n = 0"),
    *(block(f"d % {len(_LOOPS)} = {k}", *(Line(x, {f"loop{n}": {"type": f"'{p}'", "suggested": _suggest(s), "confidence": f"{c}::DOUBLE"} for n, (p, s, c) in enumerate(found)} if x.strip().startswith("for ") else {}) for x in lines)) for k, (lines, found) in enumerate(_LOOPS)),
])


@query("loop_findings", f"WITH {LOOPS.sql()} {LOOPS.rows('loop0')} UNION ALL {LOOPS.rows('loop1')}".replace("||  || chr(39)", "|| chr(39)"))
def loop_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten patterns."""
    rows = analysis.loop_issues(Facts(LOOPS.files(spark, sf_dir)))
    return rows.select(F.col("file_path").alias("path"), "line_number", "type", F.col("suggested_code").alias("suggested"), F.col("value_num").alias("confidence"))


_LOOP_GROUPS = {"comprehension": "'LOOP_TO_COMPREHENSION', 'LOOP_TO_DICT_COMPREHENSION', 'LOOP_TO_SET_COMPREHENSION', 'LOOP_TO_FILTER'", "builtin": "'LOOP_TO_SUM', 'LOOP_TO_JOIN', 'LOOP_TO_ANY_ALL', 'LOOP_TO_MAP', 'LOOP_TO_FILTER', 'LOOP_TO_ENUMERATE'", "iterator": "'LOOP_TO_ENUMERATE', 'LOOP_TO_ZIP'"}


@query("loop_groups", f"WITH {LOOPS.sql()}, f AS ({LOOPS.rows('loop0')} UNION ALL {LOOPS.rows('loop1')}) " + " UNION ALL ".join(f"SELECT '{g}' AS pick, path, type FROM f WHERE type IN ({t})" for g, t in _LOOP_GROUPS.items()))
def loop_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = Facts(LOOPS.files(spark, sf_dir))
    picks = {"comprehension": analysis.comprehension_opportunities, "builtin": analysis.builtin_opportunities, "iterator": analysis.iterator_opportunities}
    return _every(f(facts).select(F.lit(g).alias("pick"), F.col("file_path").alias("path"), "type") for g, f in picks.items())


# Repetition: bodies that are equal but for names in some files, and literals that many share.
REPEATS = Template("dry/r{d}.py", [
    block("d % 4 < 3", "def f{d}(left{d}, right):", "    joined{d} = left{d} @ right", "    if joined{d}:", "        joined{d} = -joined{d}", "        right = ~joined{d}", "    return joined{d}"),
    block("d % 4 = 3", "def f{d}(left{d}, right):", "    wait = left{d} @ right", "    while wait:", "        wait = -wait + {d}", "        right = wait", "    return right"),
    block("d % 3 = 0", 'kind = "a shared literal"', "size = 4321"),
    block("d % 5 < 2", "answer = left_side_value @ right_side_value"),
])
_REPEATS = """SELECT 'SIMILAR_FUNCTION' AS type, path, count(*) OVER () ::DOUBLE AS value_num FROM files WHERE d % 4 < 3
UNION ALL SELECT 'DUPLICATE_LITERAL', path, count(*) OVER ()::DOUBLE FROM files WHERE d % 3 = 0 UNION ALL SELECT 'DUPLICATE_LITERAL', path, count(*) OVER ()::DOUBLE FROM files WHERE d % 3 = 0
UNION ALL SELECT 'DUPLICATE_CODE_BLOCK', path, count(*) OVER ()::DOUBLE FROM files WHERE d % 4 < 3"""


@query("repetition_findings", f"WITH {REPEATS.sql()} SELECT * FROM ({_REPEATS}) WHERE value_num >= CASE WHEN type = 'DUPLICATE_LITERAL' THEN 3 ELSE 2 END UNION ALL SELECT 'DUPLICATE_EXPRESSION', path, n FROM (SELECT path, count(*) OVER ()::DOUBLE AS n FROM files WHERE d % 5 < 2) WHERE n >= 3")
def repetition_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal bodies under other names, repeated expressions and literals."""
    found = analysis.repetition_issues(Facts(REPEATS.files(spark, sf_dir)))
    return found.where("not (type = 'DUPLICATE_EXPRESSION' and name is not null)").select("type", F.col("file_path").alias("path"), "value_num")


# Tests beside sources: some functions, classes and files have one.
SOURCES = Template("src/a{d}.py", [block("true", "def run{d}(): pass", "", "", "class Kit{d}: pass")])
TESTS = Template("tests/test_a{h}.py", [block("d % 4 = 0", "def test_run{h}(): pass"), block("d % 4 = 2", "class TestKit{h}: pass"), block("d % 2 = 1", "x{d} = 1")])
_TESTED = f"WITH {SOURCES.sql()}, t AS (SELECT d % 4 AS k, h FROM m)"


@query("test_gaps", _TESTED + """ SELECT 'function' AS part, path, 'run' || d AS name FROM files WHERE d NOT IN (SELECT h FROM t WHERE k = 0)
UNION ALL SELECT 'class', path, 'Kit' || d FROM files WHERE d NOT IN (SELECT h FROM t WHERE k = 2) UNION ALL SELECT 'file', path, NULL FROM files WHERE d NOT IN (SELECT h FROM t)""")
def test_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, classes and files without a test, as the report of gaps lists them."""
    files = SOURCES.files(spark, sf_dir).unionByName(TESTS.files(spark, sf_dir))
    return reports.coverage_gaps_report(Facts(files)).select("part", "path", "name")


# Patches: one for each document, against the file that SOURCES gives it.
PATCHES = Template("{d}", [
    block("true", "--- a/src/a{d}.py", "+++ b/src/a{d}.py", "@@ -1,5 +1,6 @@ head {d}"),
    block("d % 3 = 0", Line("-def run{d}(): pass", {"change": {"type": "'delete'", "old_line": "1", "new_line": "NULL", "content": "'def run' || d || '(): pass'", "seq": "0"}}), Line("+def walk{d}(): pass", {"change": {"type": "'add'", "old_line": "NULL", "new_line": "1", "content": "'def walk' || d || '(): pass'", "seq": "1"}}), Line("+import re", {"change": {"type": "'add'", "old_line": "NULL", "new_line": "2", "content": "'import re'", "seq": "2"}})),
    block("d % 3 > 0", Line("+x = {d}", {"change": {"type": "'add'", "old_line": "NULL", "new_line": "1", "content": "'x = ' || d", "seq": "0"}}), Line(" def run{d}(): pass", {"change": {"type": "'context'", "old_line": "1", "new_line": "2", "content": "'def run' || d || '(): pass'", "seq": "1"}})),
    block("true", Line(" ", {"change": {"type": "'context'", "old_line": "2", "new_line": "3", "content": "''", "seq": "LINE - 4"}}), Line(" ", {"change": {"type": "'context'", "old_line": "3", "new_line": "4", "content": "''", "seq": "LINE - 4"}}), Line(" class Kit{d}: pass", {"change": {"type": "'context'", "old_line": "4", "new_line": "5", "content": "'class Kit' || d || ': pass'", "seq": "LINE - 4"}})),
    block("d % 7 = 0", "--- a/old{d}.py", "+++ /dev/null", "@@ -1,1 +0,0 @@", "-gone"),
    block("d % 7 = 1", "--- /dev/null", "+++ b/new{d}.py", "@@ -0,0 +1,1 @@", "+come"),
])
_PATCHES = f"WITH {PATCHES.sql().replace('m AS', 'pm AS').replace('FROM m)', 'FROM pm)').replace('files AS', 'patches AS')}, {SOURCES.sql()}"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the hunk's header has one line more than a file has, where nothing is added beyond one line
    patches = PATCHES.files(spark, sf_dir).select(F.col("path").alias("patch_id"), F.col("content").alias("text"))
    return patching.parse(patches.withColumn("text", F.regexp_replace("text", r"@@ -1,5 \+1,6 @@", "@@ -1,4 +1,5 @@")))


@query("patch_changes", _PATCHES + f" SELECT path AS patch_id, 'src/a' || path || '.py' AS file, 0 AS hunk, seq::INT AS seq, type, old_line::INT AS old_line, new_line::INT AS new_line, content FROM ({PATCHES.rows('change').replace('FROM m WHERE', 'FROM pm WHERE')}) UNION ALL SELECT path, 'old' || path || '.py', 0, 0, 'delete', 1, NULL, 'gone' FROM patches WHERE d % 7 = 0 UNION ALL SELECT path, 'new' || path || '.py', 0, 0, 'add', NULL, 1, 'come' FROM patches WHERE d % 7 = 1")
def patch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.changes(_parsed(spark, sf_dir))


@query("patch_summary", _PATCHES + " SELECT path AS patch_id, 'src/a' || d || '.py' AS file, 'modified' AS status, 1 AS n_hunks, CASE WHEN d % 3 = 0 THEN 2 ELSE 1 END AS additions, CASE WHEN d % 3 = 0 THEN 1 ELSE 0 END AS deletions FROM patches UNION ALL SELECT path, 'old' || d || '.py', 'deleted', 1, 0, 1 FROM patches WHERE d % 7 = 0 UNION ALL SELECT path, 'new' || d || '.py', 'added', 1, 1, 0 FROM patches WHERE d % 7 = 1")
def patch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.summary(_parsed(spark, sf_dir))


_APPLIED = "CASE WHEN d % 3 = 0 THEN replace(content, 'def run' || d || '(): pass', 'def walk' || d || '(): pass' || chr(10) || 'import re') ELSE 'x = ' || d || chr(10) || content END"


@query("patch_apply", _PATCHES + f" SELECT 'forward' AS way, path AS file, true AS success, md5({_APPLIED}) AS new_md5 FROM files UNION ALL SELECT 'forward', 'new' || d || '.py', true, md5('come' || chr(10)) FROM files WHERE d % 7 = 1 UNION ALL SELECT 'forward', 'old' || d || '.py', false, NULL FROM files WHERE d % 7 = 0 UNION ALL SELECT 'back', path, true, md5(content) FROM files")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied to all files, and undone again by the reversed patch."""
    files, parsed = SOURCES.files(spark, sf_dir), _parsed(spark, sf_dir)
    done = patching.apply(files, parsed, strict=True)
    patched = done.where("file like 'src/%'").select(F.col("file").alias("path"), F.lit("").alias("module"), F.col("new").alias("content"), F.lit(False).alias("is_test"))
    back = patching.apply(patched, patching.reverse(parsed.where("status = 'modified'")), strict=True)
    return _every(x.select(F.lit(way).alias("way"), "file", "success", F.md5(F.col("new").cast("binary")).alias("new_md5")) for way, x in (("forward", done), ("back", back)))


@query("patch_round_trip", _PATCHES + f" SELECT path AS patch_id, 'src/a' || path || '.py' AS file, seq::INT AS seq, type, content FROM ({PATCHES.rows('change').replace('FROM m WHERE', 'FROM pm WHERE')})")
def patch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches as text and parsed again."""
    again = patching.parse(patching.to_text(_parsed(spark, sf_dir).where("status = 'modified'")))
    return patching.changes(again).select("patch_id", "file", "seq", "type", "content")


@query("patch_operations", _PATCHES + """ SELECT path AS patch_id, 'src/a' || d || '.py' AS file, 'rename_function' AS operation, 'run' || d AS name, 'walk' || d AS new_name FROM patches WHERE d % 3 = 0 UNION ALL SELECT path, 'src/a' || d || '.py', 'add_import', 'import re', NULL FROM patches WHERE d % 3 = 0
UNION ALL SELECT path, 'src/a' || d || '.py', 'insert_lines', NULL, NULL FROM patches WHERE d % 3 > 0 UNION ALL SELECT path, 'old' || d || '.py', 'delete_lines', NULL, NULL FROM patches WHERE d % 7 = 0 UNION ALL SELECT path, 'new' || d || '.py', 'insert_lines', NULL, NULL FROM patches WHERE d % 7 = 1
UNION ALL SELECT path, 'old' || d || '.py', 'delete_file', NULL, NULL FROM patches WHERE d % 7 = 0 UNION ALL SELECT path, 'new' || d || '.py', 'create_file', NULL, NULL FROM patches WHERE d % 7 = 1""")
def patch_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, none = _parsed(spark, sf_dir), F.lit(None).cast("string")
    files = patching.file_operations(parsed).select("patch_id", "file", "operation", none.alias("name"), none.alias("new_name"))
    return patching.operations(parsed).select("patch_id", "file", "operation", "name", "new_name").unionByName(files)


@query("patch_script", _PATCHES + """ SELECT path AS patch_id, unnest(['    corpus.edit(edits.add_import, "import re")', '    corpus.edit(edits.rename_function, "run' || d || '", "walk' || d || '")']) AS line FROM patches WHERE d % 3 = 0""")
def patch_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patching.to_script(_parsed(spark, sf_dir)).select("patch_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where("line like '    corpus.%'")


@query("transactions", f"WITH {SOURCES.sql()} SELECT path, md5('# two' || chr(10) || '# one' || chr(10) || content) AS committed, md5(content) AS rolled_back, 'would apply one; two' AS message FROM files")
def transaction_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of every file, previewed, committed together, and rolled back."""
    files = SOURCES.files(spark, sf_dir)
    own = transactions.Transaction(files)
    for name in ("one", "two"):
        own.add(transactions.edits_of(own.current(), F.concat(F.lit(f"# {name}\n"), "content"), name))
    md5 = lambda df, name: df.select("path", F.md5(F.col("content").cast("binary")).alias(name))
    rows = own.preview().select("path", "message").join(md5(own.commit(), "committed"), "path")
    return rows.join(md5(own.rollback(), "rolled_back"), "path")


# Web frameworks: a file of each kind, picked by the id.
WEB = Template("app{h}/w{d}.py", [
    block("d % 5 = 0", "bp = Blueprint(" + '"b{d}", __name__)', "", '@bp.route("/a/{d}", methods=["get", "POST"])', "def view{d}():", "    pass", "", '@app.route("/home")', "@cached", "def home():", "    pass"),
    block("d % 5 = 1", "router = APIRouter()", '@router.get("/r/{d}", response_model=Item, status_code=201)', "async def read{d}(x=Depends(make{d})):", "    pass", "async def make{d}(): pass", "app.add_middleware(Gzip{d})"),
    block("d % 5 = 2", "class User{d}(Base):", '    __tablename__ = "users{d}"', "    id = Column(Integer, primary_key=True)", "    name: str = mapped_column(String)", '    posts = relationship("Post{d}")'),
    block("d % 5 = 3", 'urlpatterns = [path("u/{d}", views.index, name="index-{d}"), re_path("v", views.other)]'),
    block("d % 5 = 4", "class Handler{d}(Base): pass", "DEBUG = True"),
])
_WEB = f"WITH {WEB.sql()} "


@query("web_routes", _WEB + """SELECT path, '/a/' || d AS route, 'view' || d AS function, 'GET,POST' AS methods, 'bp' AS owner, NULL::VARCHAR AS response_model, NULL::VARCHAR AS status_code FROM files WHERE d % 5 = 0 UNION ALL SELECT path, '/home', 'home', 'GET', NULL, NULL, NULL FROM files WHERE d % 5 = 0
UNION ALL SELECT path, '/r/' || d, 'read' || d, 'GET', 'router', 'Item', '201' FROM files WHERE d % 5 = 1""")
def web_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameworks.routes(WEB.files(spark, sf_dir)).withColumn("methods", F.array_join("methods", ","))


@query("web_parts", _WEB + """SELECT 'group' AS part, path, CASE WHEN d % 5 = 0 THEN 'bp' ELSE 'router' END AS name, CASE WHEN d % 5 = 0 THEN 'blueprint:b' || d ELSE 'apirouter:' END AS detail FROM files WHERE d % 5 < 2
UNION ALL SELECT 'injected', path, 'make' || d, 'true' FROM files WHERE d % 5 = 1 UNION ALL SELECT 'middleware', path, 'Gzip' || d, '' FROM files WHERE d % 5 = 1
UNION ALL SELECT 'model', path, 'User' || d, 'users' || d FROM files WHERE d % 5 = 2 UNION ALL SELECT 'column', path, 'id', 'Integer' FROM files WHERE d % 5 = 2 UNION ALL SELECT 'column', path, 'name', 'String' FROM files WHERE d % 5 = 2
UNION ALL SELECT 'relationship', path, 'posts', 'Post' || d FROM files WHERE d % 5 = 2 UNION ALL SELECT 'url', path, 'u/' || d, 'views.index:index-' || d FROM files WHERE d % 5 = 3 UNION ALL SELECT 'url', path, 'v', 'views.other:' FROM files WHERE d % 5 = 3
UNION ALL SELECT 'app', path, 'app' || h, '' FROM m WHERE d % 5 = 4""")
def web_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = WEB.files(spark, sf_dir)
    found = frameworks.models(files.where("content like '%__tablename__%'"))
    empty = F.lit("")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), empty)
    parts = [
        ("group", frameworks.groups_of_routes(files), F.col("variable"), F.concat("kind", F.lit(":"), text_of("name"))), ("injected", frameworks.injected(files), F.col("name"), text_of("is_async")), ("middleware", frameworks.middleware(files), F.col("name"), empty),
        ("model", found, F.col("name"), F.col("table")), ("column", frameworks.columns(found), F.col("column"), F.col("type")), ("relationship", frameworks.relationships(files), F.col("attribute"), F.col("target")),
        ("url", frameworks.url_patterns(files), F.col("route"), F.concat("view", F.lit(":"), text_of("name"))), ("app", frameworks.apps_containing(files, r"class Handler\d+"), F.col("app"), empty),
    ]
    return _every(df.select(F.lit(p).alias("part"), "path", n.alias("name"), x.alias("detail")) for p, df, n, x in parts)


# Requirement files that include each other by halves, and the manifests that they convert to.
REQUIREMENTS = Template("r{d}-requirements.txt", [
    block("d > 1", "-r r{h}-requirements.txt"),
    block("true", "Pkg_{d}>=1.{d},<2  # why", "other.Name[fast, big] == 2.0 ; python_version < {q}3.12{q}".replace("{q}", '"')),
    block("d % 2 = 0", "direct{d} @ https://example.org/{d}.zip"),
    block("d % 3 = 0", "-e git+https://example.org/r#egg=My_Egg{d}", "long{d} >= 1, \x01".replace("\x01", "< 9")),
    block("true", "# nothing", "--no-index"),
])
_REQUIREMENTS = f"WITH {REQUIREMENTS.sql()}, q AS (SELECT path, d, 'pkg-' || d AS name, '>=1.' || d || ',<2' AS version, '' AS extras, NULL::VARCHAR AS marker, NULL::VARCHAR AS url, false AS editable FROM files UNION ALL SELECT path, d, 'other-name', '==2.0', 'fast,big', 'python_version < \"3.12\"', NULL, false FROM files UNION ALL SELECT path, d, 'direct' || d, NULL, '', NULL, 'https://example.org/' || d || '.zip', false FROM files WHERE d % 2 = 0 UNION ALL SELECT path, d, 'my-egg' || d, NULL, '', NULL, 'git+https://example.org/r#egg=My_Egg' || d, true FROM files WHERE d % 3 = 0 UNION ALL SELECT path, d, 'long' || d, '>=1,<9', '', NULL, NULL, false FROM files WHERE d % 3 = 0)"


@query("requirement_rows", _REQUIREMENTS + " SELECT path, name, version, extras, marker, url, editable FROM q")
def requirement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packaging.requirements(REQUIREMENTS.files(spark, sf_dir)).withColumn("extras", F.array_join("extras", ",")).drop("position")


@query("requirement_closure", _REQUIREMENTS.replace("WITH ", "WITH RECURSIVE ", 1) + ", c(root, node) AS (SELECT d, d FROM files UNION SELECT root, CAST(floor(node / 2) AS BIGINT) FROM c WHERE node > 1) SELECT 'r' || root || '-requirements.txt' AS root, q.path, q.name FROM c JOIN q ON q.d = c.node")
def requirement_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file requires with all that it includes."""
    return packaging.all_requirements(REQUIREMENTS.files(spark, sf_dir)).select("root", "path", "name")


@query("requirement_conversions", _REQUIREMENTS + """ SELECT path, 'poetry' AS target, 'pkg-' || d AS name, '>=1.' || d || ',<2' AS version FROM files UNION ALL SELECT path, 'pep621', 'pkg-' || d, '>=1.' || d || ',<2' FROM files UNION ALL SELECT path, 'uv', 'pkg-' || d, '>=1.' || d || ',<2' FROM files""")
def requirement_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file as a manifest of three other formats, read again."""
    rows = []
    for target in ("poetry", "pep621", "uv"):
        there = F.udf(lambda c, target=target: json.dumps(config.loads(packaging.convert(c, "requirements", target), "toml")), "string")
        made = REQUIREMENTS.files(spark, sf_dir).select("path", there("content").alias("json"))
        assert_format = packaging.package_format("json", F.lit("pyproject.toml"))
        found = packaging.project_dependencies(made).where("name like 'pkg-%'").join(made.select("path", assert_format.alias("format")), "path")
        rows.append(found.select("path", F.when(F.col("format") == ("pep621" if target == "pep621" else target), target).alias("target"), "name", "version"))
    return _every(rows)


@query("project_scripts", "SELECT doc_id::VARCHAR AS path, 'run-' || doc_id AS name, 'pkg.m' || doc_id || ':main' AS entry_point FROM documents UNION ALL SELECT doc_id::VARCHAR, 'old', 'pkg:old' FROM documents WHERE doc_id % 2 = 0")
def project_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "doc_id")
    own = F.format_string('{"project": {"scripts": {"run-%d": "pkg.m%d:main"}}%s}', "doc_id", "doc_id", F.when(F.col("doc_id") % 2 == 0, ', "tool": {"poetry": {"scripts": {"old": "pkg:old"}}}').otherwise(""))
    return packaging.scripts(docs.select("path", own.alias("json")))


# The verbs of lists of findings, on the findings of the rendered modules.
def _module_findings(spark: SparkSession, sf_dir: str) -> Findings:
    from .code_queries import _complexity, _facts

    facts = _facts(spark, sf_dir).once("defs", "measures", "assigned", "used")
    return Findings(union(_complexity(facts), analysis.dead_code(facts)), "analysis")


def _module_rows() -> str:
    from .code_queries import _DEAD, _DEFS, _MODULES, _OVER

    return _MODULES + f", {_DEFS}, v AS (SELECT path, type, name, line_number, value_num, severity FROM ({_OVER}) UNION ALL SELECT path, type, name, line_number, NULL, CASE WHEN type = 'UNREACHABLE_CODE' THEN 'warning' ELSE 'info' END FROM ({_DEAD}))"


_VERBS = {
    "in_file": ("path = 'pkg/m7.py'", lambda f: f.in_file("pkg/m7.py")), "in_directory": ("true", lambda f: f.in_directory("pkg/")), "matching": ("regexp_matches(name, '^f1')", lambda f: f.matching("^f1")), "by_type": ("type IN ('DEEP_NESTING', 'LONG_CLASS')", lambda f: f.by_types("DEEP_NESTING", "LONG_CLASS")),
    "by_severity": ("severity = 'info'", lambda f: f.by_severity("info")), "at_least": ("severity = 'warning'", lambda f: f.at_least("warning")), "above": ("value_num > 10", lambda f: f.above(10)), "below": ("value_num < 10", lambda f: f.below(10)), "filter": ("line_number > 20", lambda f: f.filter("line_number > 20")),
    **{g: (f"type IN ({', '.join(repr(t) for t in GROUPS[g])})", lambda f, g=g: f.select_group(g)) for g in ("complexity_issues", "dead_code", "pattern_issues")},
    "first": ("true QUALIFY row_number() OVER (ORDER BY path, line_number, type) <= 5", lambda f: f.first(5)), "last": ("true QUALIFY row_number() OVER (ORDER BY path DESC, line_number DESC, type DESC) <= 5", lambda f: f.last(5)),
    "by_severity_order": ("true QUALIFY row_number() OVER (ORDER BY severity DESC, path, line_number, type) <= 7", lambda f: Findings(f.sorted_by_severity().df.limit(7), f.domain)), "by_location_order": ("true QUALIFY row_number() OVER (ORDER BY path, line_number, type) <= 7", lambda f: Findings(f.sorted_by_location().df.limit(7), f.domain)),
    "by_value_order": ("true QUALIFY row_number() OVER (ORDER BY coalesce(value_num, 0) DESC, path, line_number) <= 7", lambda f: Findings(f.sorted_by_value().df.limit(7), f.domain)),
}


def _register_findings() -> None:
    rows = _module_rows()

    @query("finding_verbs", rows + " " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS verb, path, type, name FROM v WHERE {sql})" for k, (sql, _) in _VERBS.items()))
    def finding_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Findings(cut(_module_findings(spark, sf_dir).df.select("file_path", "line_number", "type", "name", "severity", "value_num")), "analysis")
        return _every(f(found).df.select(F.lit(k).alias("verb"), F.col("file_path").alias("path"), "type", "name") for k, (_, f) in _VERBS.items())

    @query("finding_groups", rows + " SELECT 'path' AS part, path AS key, string_agg(path || ':' || line_number || ':' || type, ',' ORDER BY path, line_number, type) AS findings FROM v WHERE path <> '' GROUP BY path UNION ALL SELECT 'severity', severity, count(*)::VARCHAR FROM v GROUP BY severity UNION ALL SELECT 'type', type, count(*)::VARCHAR FROM v GROUP BY type")
    def finding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Findings(cut(_module_findings(spark, sf_dir).df.select("file_path", "line_number", "type", "severity")), "analysis")
        text_of = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["file_path"], x["line_number"].cast("string"), x["type"])), ",")
        parts = [found.grouped("file_path").select(F.lit("path").alias("part"), F.col("file_path").alias("key"), text_of.alias("findings"))]
        return _every([*parts, *(found.count_by(c).select(F.lit(c).alias("part"), F.col(c).alias("key"), F.col("n").cast("string").alias("findings")) for c in ("severity", "type"))])

    @query("finding_summary", rows + " SELECT 'Total: ' || count(*) || ' findings' AS line FROM v UNION ALL SELECT '  ' || severity || ': ' || count(*) FROM v GROUP BY severity UNION ALL SELECT '  ' || type || ': ' || count(*) FROM v GROUP BY type")
    def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(x,) for x in _module_findings(spark, sf_dir).summary().split("\n")], "line string")

    @query("sarif_rows", rows + """ SELECT type AS "ruleId", CASE severity WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, path AS uri, line_number AS line FROM v""")
    def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.from_json("value", "ruleId string, level string, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>")
        own = reports.as_sarif(_module_findings(spark, sf_dir).df).select(value.alias("v"))
        place = F.col("v.locations")[0]["physicalLocation"]
        return own.select("v.ruleId", "v.level", place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line"))

    @query("analysis_report", rows.split(", v AS")[0] + f""", fm AS (SELECT count(*) AS files, sum(total) AS total_lines, count(*) AS classes, count(*) AS functions, sum(1 + CASE WHEN d % 4 = 2 THEN 1 ELSE 0 END) AS methods FROM m2), w AS (SELECT type FROM ({_counted(rows)}))
SELECT 'summary' AS section, unnest(['files', 'total_lines', 'class_count', 'function_count', 'method_count']) AS key, unnest([files, total_lines, classes, functions, methods])::BIGINT AS value FROM fm UNION ALL SELECT 'findings', type, count(*) FROM w GROUP BY type""")
    def analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .code_queries import _facts

        return reports.full_report(_facts(spark, sf_dir)).where("section = 'summary' and key <> 'code_lines' or section = 'findings' and key not like 'MISSING%' and key <> 'BARE_EXCEPT'")


def _counted(rows: str) -> str:
    """The findings that the full report counts, of those in `rows`."""
    return "SELECT type FROM (" + rows[rows.index(", v AS (") + len(", v AS (") : -1] + ") WHERE type NOT IN ('TOO_MANY_BRANCHES', 'TOO_MANY_RETURNS')"


_register_findings()


@query("module_outline", f"WITH {SHOP.sql()} SELECT path, md5(path || chr(10) || '  class Store' || chr(10) || '    def get' || chr(10) || '    def make' || chr(10) || '  def fetch' || chr(10) || '  def plain' || chr(10) || '  def old' || chr(10)) AS text_md5 FROM files")
def module_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.module_structure(Facts(SHOP.files(spark, sf_dir))).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("api_summary", f"WITH {SHOP.sql()} SELECT path, md5('## ' || path || chr(10) || chr(10) || '- `Store`: Keeps ' || d || '.' || chr(10) || '- `Store.get`: Get.' || chr(10) || '- `Store.make`' || chr(10) || '- `fetch`' || chr(10) || '- `plain`' || chr(10) || '- `old`' || chr(10)) AS text_md5 FROM files")
def api_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.api_summary(Facts(SHOP.files(spark, sf_dir)).heads).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("complexity_report", f"WITH {SHOP.sql()} SELECT path, 5::BIGINT AS functions, 0::BIGINT AS above, 1.2::DOUBLE AS avg_complexity, 2 AS max_complexity FROM files")
def complexity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.complexity_report(Facts(SHOP.files(spark, sf_dir)))


# Line edits and configuration changes of all documents and events.
_LINES5 = "list_transform(range(1, 6), lambda i: 'line ' || i || ' of ' || doc_id)"


@query("line_edits", f"""WITH b AS (SELECT doc_id, {_LINES5} AS l FROM documents)
SELECT doc_id::VARCHAR AS path, array_to_string([l[1], 'new', l[2], l[3], l[4], l[5]], '|') AS inserted, array_to_string([l[1], l[4], l[5], l[2], l[3]], '|') AS moved, array_to_string([l[1], '    ' || l[2], l[3], l[4], l[5]], '|') AS indented, array_to_string(l, '|') AS dedented,
array_to_string([l[1], replace(l[2], 'line', 'row'), replace(l[3], 'line', 'row'), l[4], l[5]], '|') AS replaced, 'row 1 of ' || doc_id || '|row 2 of ' || doc_id || '|' || array_to_string(l[3:], '|') AS first_two FROM b""")
def line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of "), F.col("doc_id").cast("string"))), "\n")
    rows = docs.select(F.col("doc_id").cast("string").alias("path"), own.alias("c"))
    bar = lambda c: F.replace(c, F.lit("\n"), F.lit("|"))
    return rows.select("path", bar(text.insert_at_line("c", 2, "new")).alias("inserted"), bar(text.move_lines("c", 2, 3, 6)).alias("moved"), bar(text.indent("c", 2, 2)).alias("indented"), bar(text.dedent(text.indent("c", 1, 5), 1, 5)).alias("dedented"), bar(text.replace_in_lines("c", 2, 3, "line", "row")).alias("replaced"), bar(text.replace_pattern("c", "line", "row", 2)).alias("first_two"))


@query("config_changes", """SELECT event_id, NULL::VARCHAR AS deleted, (props->>'$.k') || ',1' AS merged, '[' || (props->>'$.k') || ',7]' AS appended, 'Missing' AS error FROM events""")
def config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props", F.format_string('{"l": [%s]}', F.get_json_object("props", "$.k")).alias("listed"))
    gone, merged = config.changed(config.delete_key, "k")(F.col("props")), config.changed(config.merge, {"z": 1})(F.col("props"))
    more, bad = config.changed(config.append_to_list, "l", 7)(F.col("listed")), config.changed(config.remove_from_list, "l", "none")(F.col("listed"))
    rows = rows.select("event_id", gone.alias("gone"), merged.alias("merged"), more.alias("more"), bad.alias("bad"))
    return rows.select("event_id", F.get_json_object("gone.json", "$.k").alias("deleted"), F.concat_ws(",", F.get_json_object("merged.json", "$.k"), F.get_json_object("merged.json", "$.z")).alias("merged"), F.regexp_replace(F.get_json_object("more.json", "$.l"), " ", "").alias("appended"), F.regexp_extract("bad.error", "^([A-Za-z]+)", 1).alias("error"))



_LIMIT = sum(x.times for b in SHOP.blocks for x in b.lines)
_DIFF = f"'--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -{_LIMIT - 3},4 +{_LIMIT - 3},4 @@' || chr(10) || '     return \"%s-%d\" % (x, ' || d || ')' || chr(10) || ' ' || chr(10) || ' ' || chr(10) || '-limit = ' || d || chr(10) || '+limit = 0' || d || chr(10)"


def _previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = SHOP.files(spark, sf_dir)
    return transactions.preview(transactions.edits_of(files, F.replace("content", F.lit("limit = "), F.lit("limit = 0")), "pad"))


@query("unified_diff", f"WITH {SHOP.sql()} SELECT path, 'would apply pad' AS message, {_DIFF} AS diff FROM files")
def unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _previewed(spark, sf_dir).select("path", "message", "diff")


@query("combined_diffs", f"WITH {SHOP.sql()}, x AS (SELECT path, {_DIFF} AS diff FROM files) SELECT md5(string_agg(diff, chr(10) ORDER BY path)) AS all_md5 FROM x")
def combined_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.combine_diffs(_previewed(spark, sf_dir)).select(F.md5(F.col("diff").cast("binary")).alias("all_md5"))


@query("last_diffs", f"WITH {SHOP.sql()} SELECT path, {_DIFF} AS diff FROM files")
def last_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several results for a path, the diff of the last one that has any."""
    done = _previewed(spark, sf_dir).select("path", "diff", F.lit(1).alias("seq"))
    older = done.select("path", F.lit("older").alias("diff"), F.lit(0).alias("seq"))
    failed = done.select("path", F.lit(None).cast("string").alias("diff"), F.lit(2).alias("seq"))
    return transactions.last_diffs(_every([older, done, failed]), "seq")


@query("parsed_configs", """SELECT 'c' || doc_id || '.' || ['json', 'yaml', 'toml', 'ini'][doc_id % 4 + 1] AS path, ['json', 'yaml', 'toml', 'ini'][doc_id % 4 + 1] AS format, doc_id::VARCHAR AS a, 'x y' AS b, NULL::VARCHAR AS error FROM documents WHERE doc_id % 9 > 0
UNION ALL SELECT 'c' || doc_id || '.json', 'json', NULL, NULL, 'JSONDecodeError' FROM documents WHERE doc_id % 9 = 0""")
def parsed_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files of four formats, some of them broken."""
    d = F.col("doc_id").cast("string")
    forms = [("json", F.concat(F.lit('{"top": {"a": '), d, F.lit(', "b": "x y"}}'))), ("yaml", F.concat(F.lit("top:\n  a: "), d, F.lit("\n  b: x y\n"))), ("toml", F.concat(F.lit("[top]\na = "), d, F.lit('\nb = "x y"\n'))), ("ini", F.concat(F.lit("[top]\na = "), d, F.lit("\nb = x y\n")))]
    kind = F.when(F.col("doc_id") % 9 == 0, -1).otherwise(F.col("doc_id") % 4)
    path, content = F.concat(F.lit("c"), d, F.lit(".json")), F.lit("{broken")
    for k, (name, text_of) in enumerate(forms):
        path = F.when(kind == k, F.concat(F.lit("c"), d, F.lit(f".{name}"))).otherwise(path)
        content = F.when(kind == k, text_of).otherwise(content)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(path.alias("path"), content.alias("content"))
    rows = parse_config(of_columns(docs))
    return rows.select("path", "format", config.get("json", "top.a").alias("a"), config.get("json", "top.b").alias("b"), F.regexp_extract("error", r"^(\w+)", 1).alias("error"))


@query("package_formats", "SELECT doc_id, ['poetry', 'uv', 'pep621', 'requirements', NULL][doc_id % 5 + 1] AS format FROM documents")
def package_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    doc = F.when(k == 0, '{"project": {}, "tool": {"poetry": {"name": "x"}}}').when(k == 1, '{"project": {}, "tool": {"uv": {"dev": 1}}}').when(k == 2, '{"project": {"name": "x"}}').otherwise("{}")
    path = F.when(k == 3, "requirements-dev.txt").otherwise("pyproject.toml")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", packaging.package_format(doc, path).alias("format"))


_NAMED = {"_id": "int", "_count": "int", "_ratio": "float", "_name": "str", "_path": "str | Path", "_items": "list", "_config": "dict", "_callback": "Callable", "_enabled": "bool", "_thing": None}


@query("inferred_types", "SELECT 'a' || doc_id || x.suffix AS name, x.kind AS kind, NULL::VARCHAR AS value FROM documents, (VALUES " + ", ".join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in _NAMED.items()) + ") x(suffix, kind) UNION ALL SELECT 'a' || doc_id, ['int', 'str', 'bool', 'list', 'float', 'dict'][doc_id % 6 + 1], ['1', '\"s\"', 'not x', '[1]', '1.5', '{}'][doc_id % 6 + 1] FROM documents")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types from names and from default values."""
    infer = F.udf(edits.infer_type, "string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("stem"))
    names = docs.select("stem", F.explode(F.array(*map(F.lit, _NAMED))).alias("suffix")).select(F.concat("stem", "suffix").alias("name"), F.lit(None).cast("string").alias("value"))
    values = docs.select(F.col("stem").alias("name"), F.element_at(F.array(*map(F.lit, ("1", '"s"', "not x", "[1]", "1.5", "{}"))), (F.col("doc_id") % 6 + 1).cast("int")).alias("value"))
    rows = names.unionByName(values)
    return rows.select("name", infer("name", "value").alias("kind"), "value")
