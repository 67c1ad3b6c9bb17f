import pytest

from lodestack.functions import config
from lodestack.operators import edits as e
from lodestack.operators import patching, transactions
from lodestack.sources.files import of_columns

CODE = '''import os
from typing import Optional, List


@dec
class A(object):
    """Doc é."""

    x: int = 1

    @staticmethod
    def make(v=")"):
        return v

    def go(self, a, b: int = 2, *, k=None) -> int:
        """Go."""
        old = a  # keep
        return self.go(old, b)


async def fetch(url, n: Optional[List[int]] = None):
    async with open(url) as f:
        return await f.read()


def plain(a, b=1):
    return "{} {}".format(a, b) + A.x
'''


def test_every_edit_parses_and_keeps_the_rest():
    assert "class B(object):" in e.rename_class(CODE, "A", "B") and "+ B.x" in e.rename_class(CODE, "A", "B")
    assert "def run(self" in e.rename_function(CODE, "go", "run", "A") and "self.run(old" in e.rename_function(CODE, "go", "run", "A")
    assert "def simple(a" in e.rename_function(CODE, "plain", "simple")
    assert "    @cache\n    def go" in e.add_decorator(CODE, "go", "@cache", "A") and "@x\n@dec\nclass" in e.add_decorator(CODE, "A", "x", kind="class")
    assert "@dec" not in e.remove_decorator(CODE, "A", "dec", kind="class")
    assert '@classmethod\n    def make(cls, v=")")' in e.static_to_class_method(CODE, "A", "make")
    assert "def go(self, a, t: str, b: int = 2" in e.add_parameter(CODE, "go", "t", "str", class_name="A")
    assert "b: int = 2, t: int = 3, *, k=None" in e.add_parameter(CODE, "go", "t", "int", "3", "A")
    assert "def go(self, t, a" in e.add_parameter(CODE, "go", "t", class_name="A", position="start")
    assert "def go(self, a, *, k=None)" in e.remove_parameter(CODE, "go", "b", "A") and "def plain(a):" in e.remove_parameter(CODE, "plain", "b")
    assert "def go(self, z, b" in e.rename_parameter(CODE, "go", "a", "z", "A") and "old = z  # keep" in e.rename_parameter(CODE, "go", "a", "z", "A")
    assert "def plain(a: str, b=1)" in e.set_parameter_type(CODE, "plain", "a", "str")
    assert "def plain(a, b=1) -> str:" in e.set_return_type(CODE, "plain", "str") and "k=None) -> str:" in e.set_return_type(CODE, "go", "str", "A")
    assert "def go(self, a, b = 2, *, k=None):" in e.remove_type_hints(CODE, "go", "A")
    assert "async def fetch(url: str" in e.infer_type_hints(CODE, "fetch")
    assert "n: list[int] | None = None" in e.modernize_hints(CODE)
    assert "async def plain" in e.convert_to_async(CODE, "plain")
    sync = e.convert_to_sync(CODE, "fetch")
    assert "\ndef fetch" in sync and "    with open" in sync and "return f.read()" in sync
    assert '"""Go."""\n        check(a)\n        old' in e.insert_statement(CODE, "go", "check(a)", "A")
    assert e.insert_statement(CODE, "plain", "done()", position="end").endswith("A.x\n    done()\n")
    assert 'logger.info("plain called, a=%r, b=%r", a, b)' in e.add_logging(CODE, "plain", level="info", with_args=True)
    assert "        try:\n            old = a  # keep\n            return self.go(old, b)\n        except (ValueError, KeyError) as e:\n            raise\n" in e.wrap_with_try(CODE, "go", ["ValueError", "KeyError"], "raise", "A")
    assert '"""Doc é."""\n\n    y: str = None\n    x: int' in e.add_class_attribute(CODE, "A", "y", "str")
    assert "x: int" not in e.remove_class_attribute(CODE, "A", "x") and "class A(object, Base):" in e.add_base_class(CODE, "A", "Base")
    assert "class A:\n" in e.remove_object_bases(CODE)
    assert 'f"{a} {b}" + A.x' in e.format_to_fstring(CODE)
    assert e.add_import(CODE, "import sys").startswith("import sys\nimport os\n") and "import os" not in e.remove_import(CODE, "import os")
    assert "import path" in e.rename_import(CODE, "os", "path") and "from kinds import" in e.rename_import(CODE, "typing", "kinds")
    assert "def go(self, b: int=2, a" not in CODE and "def plain(b" not in CODE
    assert '    """New."""\n    return "{}' in e.set_docstring(CODE, "plain", "New.") and '"""Gone."""' in e.set_docstring(CODE, "go", "Gone.", "A")
    assert e.set_header("# Copyright 2019\nx = 1\n", "Copyright 2020\n\nMIT") == "# Copyright 2020\n#\n# MIT\nx = 1\n"
    assert '"A",\n    "fetch",\n    "plain",\n]' in e.set_exports(CODE)
    for text in (e.rename_class(CODE, "A", "B"), sync, e.generate_stub(CODE), e.set_exports(CODE), *e.split_module(CODE).values()):
        e.ast.parse(text)
    point = "class P:\n    a: int\n    b: str = 'x'\n"
    for kind in ("init", "repr", "eq", "hash"):
        scope: dict = {}
        exec(e.add_dunder(e.add_dunder(point, "P", "init"), "P", kind) if kind != "init" else e.add_dunder(point, "P", "init"), scope)
        p = scope["P"](1)
        checks = {"init": lambda: p.b == "x", "repr": lambda: repr(p) == "P(a=1, b='x')", "eq": lambda: p == scope["P"](1, "x") and p != scope["P"](2), "hash": lambda: hash(p) == hash((1, "x"))}  # noqa: B023
        assert checks[kind]()
    assert "@dataclass\nclass Q:\n    a: int\n    b: object = 2\n" in e.convert_to_dataclass("class Q:\n    def __init__(self, a: int, b=2):\n        self.a = a\n        self.b = b\n", "Q")


SIGNATURE = """def f(
    a,  # first, it's "quoted
    b: int = (1),
    /,
    *rest,
    k="x,y",
    **more,
):
    return a
"""


def test_parameter_edits_touch_one_parameter():
    assert e.set_parameter_type(SIGNATURE, "f", "a", "int") == SIGNATURE.replace("    a,", "    a: int,")
    assert e.set_parameter_type(SIGNATURE, "f", "b", "float") == SIGNATURE.replace("b: int", "b: float")
    assert e.set_parameter_type(SIGNATURE, "f", "more", "int") == SIGNATURE.replace("**more", "**more: int")
    assert e.add_parameter(SIGNATURE, "f", "z", default="0") == SIGNATURE.replace("*rest", "z=0, *rest")
    assert e.remove_parameter(SIGNATURE, "f", "k") == SIGNATURE.replace('k="x,y",\n    ', "")
    assert e.remove_parameter(SIGNATURE, "f", "rest") == SIGNATURE.replace("*rest", "*")
    assert e.remove_parameter("def f(a, *, k): pass\n", "f", "k") == "def f(a): pass\n" and e.remove_parameter("def f(a, /, b): pass\n", "f", "a") == "def f(b): pass\n"
    assert e.remove_type_hints(SIGNATURE, "f") == SIGNATURE.replace("b: int", "b") and e.rename_parameter(SIGNATURE, "f", "a", "z") == SIGNATURE.replace("    a,", "    z,").replace("return a", "return z")
    assert e.add_parameter("def f(): pass\n", "f", "x") == "def f(x): pass\n" and e.add_parameter("def f[T: (int, str)](a): pass\n", "f", "x") == "def f[T: (int, str)](a, x): pass\n"
    assert e.add_parameter("def f(a=1): pass\n", "f", "c", "int", "2", position="start") == "def f(c: int = 2, a=1): pass\n"
    with pytest.raises(e.NoTarget):
        e.add_parameter("def f(a, b=1): pass\n", "f", "c", "int", "2", position="start")
    assert e.reorder_parameters("def f(self, a, b, c=1): pass\n", "f", ["b", "a"]) == "def f(self, b, a, c=1): pass\n"


def test_renaming_keeps_to_its_scope():
    text = """def f(x):
    return x
class C:
    def f(self):
        return f(1)
    g = f
def g(f):
    return f
def h():
    f = 1
    return [f for _ in "a"], lambda f: f
def i():
    global f
    return f"{f(2)}", [f for f in "a"]
"""
    want = text.replace("def f(x)", "def go(x)").replace("return f(1)", "return go(1)").replace("global f", "global go").replace('f"{f(2)}"', 'f"{go(2)}"')
    assert e.rename_function(text, "f", "go") == want
    assert e.rename_parameter("def f(a):\n    def g(a): return a\n    return a, g\n", "f", "a", "b") == "def f(b):\n    def g(a): return a\n    return b, g\n"


def test_multi_line_strings_headers_and_names():
    text = 'def f():\n    x = """a\n  b\n"""\n    return x\n'
    scope: dict = {}
    exec(e.wrap_with_try(text, "f", ["ValueError"], "raise"), scope)
    assert scope["f"]() == "a\n  b\n"
    assert e.set_header("#!/bin/sh\n# -*- coding: utf-8 -*-\n# Copyright 1\nx = 1\n", "Copyright 2") == "#!/bin/sh\n# -*- coding: utf-8 -*-\n# Copyright 2\nx = 1\n"
    assert e.set_header("#!/bin/sh\nx = 1\n", "MIT") == "#!/bin/sh\n# MIT\nx = 1\n"
    assert [e.infer_type(n) for n in ("path", "data", "file_path", "user_id", "is_on", "on_callback", "zebra")] == ["str | Path", "bytes", "str | Path", "int", "bool", "Callable", None]
    assert "def f(a: int): pass" in e.set_parameter_type("x = 1\x0c\ndef f(a): pass\n", "f", "a", "int")


def test_an_edit_never_stops_the_others(spark):
    def odd(content: str) -> str:
        return content + 1 if "bad" in content else content + "\n"

    files = of_columns(spark.createDataFrame([("a.py", "bad = 1"), ("b.py", "x = 1")], "path string, content string"))
    rows = {r["path"]: r for r in e.edit(files, odd).collect()}
    assert rows["a.py"]["error"].startswith("TypeError") and rows["b.py"]["success"]


@pytest.mark.parametrize(("change", "args"), [(e.rename_class, ("Z", "Y")), (e.add_parameter, ("plain", "a")), (e.remove_parameter, ("plain", "zz")), (e.convert_to_sync, ("plain",)), (e.remove_import, ("import re",)), (e.reorder_parameters, ("plain", ["b", "a"])), (e.add_base_class, ("A", "object"))])
def test_no_target(change, args):
    with pytest.raises(e.NoTarget):
        change(CODE, *args)


def test_edits_over_a_corpus(spark):
    files = of_columns(spark.createDataFrame([("a.py", CODE), ("b.py", "x = 1\n"), ("c.py", "def (:\n"), ("d.py", None)], "path string, content string"))
    results = e.edit(files, e.rename_class, "A", "B")
    rows = {r["path"]: r for r in results.collect()}
    assert rows["a.py"]["success"] and "+class B(object):" in rows["a.py"]["diff"] and not rows["b.py"]["success"] and rows["c.py"]["error"].startswith("SyntaxError") and not rows["d.py"]["success"]
    again = e.edit_log(results).withColumn("original", results["original"])
    committed = {r["path"]: r["content"] for r in transactions.commit(files, again).collect()}
    assert "class B" in committed["a.py"] and committed["b.py"] == "x = 1\n" and len(committed) == 4
    assert transactions.preview(again).first()["diff"].startswith("--- a/a.py\n+++ b/a.py\n")
    got = transactions.batch(results).first()
    assert (got["success"], got["partial_success"], got["all_failed"]) == (False, True, False)


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,4 @@ head
 a = 1
-def old(): pass
+def new(): pass
+import re
 b = 2
@@ -9,1 +9,0 @@
-gone
diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1,2 @@
+one
+two
diff --git a/p.txt b/q.txt
rename from p.txt
rename to q.txt
"""


def test_patches(spark):
    parsed = patching.parse(spark.createDataFrame([("p", DIFF), ("e", ""), ("w", "  \n"), ("z", None)], "patch_id string, text string"))
    rows = {r["file"]: r for r in parsed.collect()}
    assert {f: r["status"] for f, r in rows.items()} == {"x.py": "modified", "n.py": "added", "q.txt": "renamed"}
    lines = [(r["hunk"], r["type"], r["old_line"], r["new_line"]) for r in patching.changes(parsed).where("file = 'x.py'").orderBy("hunk", "seq").collect()]
    assert lines == [(0, "context", 1, 1), (0, "delete", 2, None), (0, "add", None, 2), (0, "add", None, 3), (0, "context", 3, 4), (1, "delete", 9, None)]
    assert {(r["file"], r["additions"], r["deletions"]) for r in patching.summary(parsed).collect()} == {("x.py", 2, 2), ("n.py", 2, 0), ("q.txt", 0, 0)}
    ops = {(r["operation"], r["name"], r["new_name"]) for r in patching.operations(parsed).where("file = 'x.py'").collect()}
    assert ops == {("rename_function", "old", "new"), ("add_import", "import re", None), ("delete_lines", None, None)}
    text = "a = 1\ndef old(): pass\nb = 2\n" + "".join(f"{k}\n" for k in range(4, 9)) + "gone\nend\n"
    files = of_columns(spark.createDataFrame([("x.py", text), ("p.txt", "t")], "path string, content string"))
    done = {r["file"]: r for r in patching.apply(files, parsed, strict=True).collect()}
    assert done["x.py"]["new"] == "a = 1\ndef new(): pass\nimport re\nb = 2\n" + "".join(f"{k}\n" for k in range(4, 9)) + "end\n" and done["n.py"]["new"] == "one\ntwo\n" and done["q.txt"]["new"] == "t"
    patched = of_columns(spark.createDataFrame([(f, r["new"]) for f, r in done.items()], "path string, content string"))
    back = {r["file"]: r for r in patching.apply(patched, patching.reverse(parsed)).collect()}
    assert back["x.py"]["new"] == text and back["n.py"]["new"] is None and back["p.txt"]["new"] == "t"
    missing = patching.apply(files.where("path = 'p.txt'"), parsed).where("not success").collect()
    assert [(r["path"], r["error"]) for r in missing] == [("x.py", "file not found")]
    again = patching.parse(patching.to_text(parsed.where("status <> 'renamed'")))
    assert sorted(map(tuple, patching.changes(again).collect())) == sorted(map(tuple, patching.changes(parsed).collect()))


def test_config_changes():
    doc = {"a": {"b": [1, {"c": 2}]}}
    assert config.set_value(doc, "a.b.1.c", 5) == {"a": {"b": [1, {"c": 5}]}} and config.set_value({}, "x.y", 1) == {"x": {"y": 1}}
    assert config.delete_key(doc, "a.b") == {"a": {}} and config.merge(doc, {"a": {"z": 1}}) == {"a": {"b": [1, {"c": 2}], "z": 1}} and config.merge(doc, {"a": 1}, deep=False) == {"a": 1}
    assert config.append_to_list(doc, "a.b", 3)["a"]["b"][-1] == 3 and config.remove_from_list(doc, "a.b", 1) == {"a": {"b": [{"c": 2}]}}
    for f, args in ((config.set_value, ("a.b.x", 1)), (config.delete_key, ("q",)), (config.remove_from_list, ("a.b", 9)), (config.append_to_list, ("a", 1))):
        with pytest.raises(config.Missing):
            f(doc, *args)
    toml = {"tool": {"x": {"on": True, "n": 1, "list": ["a", "b c"], "s": 'q"'}}, "top": 1.5, "many": [{"k": 1}, {"k": 2, "in": {"z": "é"}}]}
    assert config.loads(config.dumps(toml, "toml"), "toml") == toml and config.loads(config.dumps(doc, "yaml"), "yaml") == doc and config.loads(config.dumps({"s": {"k": "v"}}, "ini"), "ini") == {"s": {"k": "v"}}
