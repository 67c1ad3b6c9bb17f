import pytest

from lodestack.operators import edits as e
from lodestack.operators import frameworks, graph, packaging, patching, transactions
from lodestack.operators import modernize as m
from lodestack.plans import reports
from lodestack.plans.corpus import Corpus
from lodestack.sources.files import of_columns


def test_deprecated_names():
    code = "import imp\nfrom collections import Mapping, OrderedDict\nimport typing\nx: typing.List = []\nself.assertEquals(collections.Sequence, 1)\nlogger.warn('x')\nlogging.warn('y')\n"
    found = m.deprecated_of(code)
    assert [(line, old, new) for line, old, new, _ in found] == [(1, "imp", "importlib"), (2, "collections.Mapping", "collections.abc.Mapping"), (4, "typing.List", "list"), (5, "assertEquals", "assertEqual"), (5, "collections.Sequence", "collections.abc.Sequence"), (6, "logger.warn", "logger.warning"), (7, "logging.warn", "logging.warning")]
    done = m.replace_deprecated(code)
    assert "x: list = []" in done and "self.assertEqual(collections.abc.Sequence" in done and "logger.warning('x')" in done
    with pytest.raises(e.NoTarget):
        m.replace_deprecated("x = 1\n")


def test_six_and_type_comments():
    code = "import six\n\n@six.add_metaclass(Meta)\nclass A(object):\n    pass\n\nfor i in six.moves.range(3):\n    print(six.PY2, isinstance(i, six.string_types))\n"
    assert m.remove_six(code) == "\nclass A(metaclass=Meta):\n    pass\n\nfor i in range(3):\n    print(False, isinstance(i, str))\n"
    assert m.type_comments("x = []  # type: List[int]\n\ndef f(a, b=1):\n    # type: (int, Dict[str, int]) -> str\n    return a\n\ndef g(self, a):  # type: (...) -> None\n    y = a  # type: ignore\n") == "x: List[int] = []\n\ndef f(a: int, b: Dict[str, int]=1) -> str:\n    return a\n\ndef g(self, a) -> None:\n    y = a  # type: ignore\n"
    with pytest.raises(e.NoTarget):
        m.type_comments("x = 1  # type: ignore\n")


def test_insert_delete_and_properties():
    code = "class A:\n    def __init__(self, x):\n        self.x = x\n\n    def f(self):\n        return self.x\n\n\ndef g():\n    a = 1\n    b = 2\n"
    assert m.insert_at_match(code, "b = 2", "log()", "before") == code.replace("    b = 2", "    log()\n    b = 2")
    assert m.insert_at_match(code, "return", "log()", "before", "A", "f") == code.replace("        return", "        log()\n        return")
    assert m.insert_at_match(code, "a = 1", "a = 3", "replace", None, "g") == code.replace("a = 1", "a = 3")
    assert m.delete_definition(code, "f", "A") == code.replace("\n    def f(self):\n        return self.x\n", "")
    assert m.delete_definition("class A:\n    def f(self): pass\n", "f", "A") == "class A:\n    pass\n"
    scope: dict = {}
    exec(m.attribute_to_property(code, "A", "x", "int"), scope)
    a = scope["A"](5)
    a.x = 6
    assert (a.x, a._x, isinstance(scope["A"].x, property)) == (6, 6, True)
    for bad in (lambda: m.insert_at_match(code, "zzz", "x"), lambda: m.attribute_to_property(code, "A", "y")):
        with pytest.raises(e.NoTarget):
            bad()


def test_organize_imports():
    code = '"""Doc."""\nimport requests\nimport os\nfrom mine.b import z, a\nfrom __future__ import annotations\n\nimport abc\nfrom . import near\nfrom os import path\n\nx = 1\n'
    want = '"""Doc."""\nfrom __future__ import annotations\n\nimport abc\nimport os\nfrom os import path\n\nimport requests\n\nfrom . import near\nfrom mine.b import z, a\n\nx = 1\n'
    assert m.organize_imports(code, ("mine",)) == want
    with pytest.raises(e.NoTarget):
        m.organize_imports(want, ("mine",))


def test_transactions(spark):
    files = of_columns(spark.createDataFrame([("a.py", "x = 1\n"), ("b.py", "y = 1\n")], "path string, content string"))
    text = lambda df: {r["path"]: r["content"] for r in df.collect()}
    with transactions.Transaction(files) as t:
        t.add(e.edit_log(e.edit(t.current(), lambda c: c.replace("1", "2")).where("path = 'a.py'")))
        t.add(e.edit_log(e.edit(t.current(), lambda c: c + "z = 3\n").where("path = 'a.py'")))
        with pytest.raises(RuntimeError), transactions.Transaction(files):
            pass
    assert text(t.committed) == {"a.py": "x = 2\nz = 3\n", "b.py": "y = 1\n"}
    with pytest.raises(ValueError), transactions.Transaction(files) as t:
        t.add(e.edit_log(e.edit(files, lambda c: c + "\n")))
        raise ValueError
    assert t.committed is None and not t.logs and text(t.files) == text(files)


def test_graphs_have_no_depth(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(9, 0), (20, 21), (3, 3)], "src long, dst long")
    found = graph.closure(edges, spark.range(0, 1).withColumnRenamed("id", "root")).collect()
    assert {r["node"]: r["depth"] for r in found} == {**{k: k for k in range(1, 10)}, 0: 10} or {r["node"]: r["depth"] for r in found} == {k: k for k in range(1, 10)}
    assert [r["cycle"] for r in graph.cycles(edges).collect()] == [list(range(10))]
    assert graph.cycles(edges, longest=4).count() == 0 and graph.cycles(edges.limit(0)).count() == 0


def test_projects(spark):
    files = of_columns(spark.createDataFrame([("shop/urls.py", "urlpatterns = []"), ("shop/models.py", "class Item(Model): pass"), ("site/settings.py", "DEBUG = True\nNAME = 'x'\n"), ("requirements.txt", "-r base.txt\na"), ("base.txt", "b==1")], "path string, content string"))
    assert [r["path"] for r in frameworks.url_files(files).collect()] == ["shop/urls.py"]
    assert [tuple(r) for r in frameworks.apps_containing_class(files, "Item").collect()] == [("shop", "shop/models.py")]
    assert [tuple(r) for r in frameworks.settings(files, "DEBUG").collect()] == [("site/settings.py", "True")]
    assert {(r["root"], r["name"]) for r in packaging.all_requirements(files.where("path like '%.txt'")).collect()} == {("requirements.txt", "a"), ("requirements.txt", "b"), ("base.txt", "b")}


def test_patches_with_clashing_hashes(spark):
    """Imports and decorators of any name; they never pair as renames."""
    names = [f"import module_{k}" for k in range(400)]
    diff = "--- a/x.py\n+++ b/x.py\n" + f"@@ -1,{len(names)} +1,{len(names)} @@\n" + "".join(f"-{n}\n+{n}x\n" for n in names)
    parsed = patching.parse(spark.createDataFrame([("p", diff)], "patch_id string, text string"))
    found = [(r["operation"], r["name"]) for r in patching.operations(parsed).collect()]
    assert sorted(found) == sorted([("delete_import", n) for n in names] + [("add_import", f"{n}x") for n in names])


def test_reports_say_what_they_leave_out(spark):
    rows = spark.createDataFrame([(f"f{k}.py", "TODO_COMMENT", "low", f"n{k}") for k in range(7)], "file_path string, type string, severity string, name string").selectExpr("*", "1 as line_number", "'m' as message")
    assert reports.table(rows, top=5).endswith("... and 2 more") and "more" not in reports.table(rows)
    assert reports.sarif_document(rows).count("ruleId") == 7 and '"resultsLeftOut": 4' in reports.sarif_document(rows, most=3)


def test_class_keywords_and_patterns(spark):
    code = "from a import Meta\n\nclass Live(type):\n    pass\n\nclass Foo1(metaclass=Meta):\n    pass\n\nclass Bar(metaclass=Live):\n    pass\n"
    corpus = Corpus.of_table(spark.createDataFrame([("a.py", code)], "path string, content string"), "path", "content")
    assert [r["name"] for r in corpus.find_classes(r"^Foo\d$").collect()] == ["Foo1"] and corpus.find_classes("it's").count() == 0
    from lodestack.operators import analysis

    assert analysis.unused_imports(corpus.facts).count() == 0
    assert {r["name"] for r in analysis.unused_classes(corpus.facts).collect()} == {"Foo1", "Bar"}
