import pytest

from lodestack.operators import analysis as a
from lodestack.operators import comments, graph, metrics, rules
from lodestack.operators.facts import Facts
from lodestack.operators.findings import Findings
from lodestack.operators.rules import Rule
from lodestack.sources.files import of_columns, parse_config, read_tree

FILES = {
    "pkg/__init__.py": "",
    "pkg/models.py": '''"""Models."""
from __future__ import annotations
import os
import sys as system
from . import utils
from typing import TYPE_CHECKING
if TYPE_CHECKING:
    import decimal

LIMIT = 77
timeout = 4321


class User:
    name: str = "u"

    def __init__(self, name, age: int = 3):
        self.name = name

    def greet(self) -> str:
        """Say hello."""
        if self.name and self.age or LIMIT:
            for k in range(3):
                while k:
                    with open("f") as f:
                        if f:
                            return "x"
        elif self.name:
            return "y"
        return "unused text value here"
        print("never")


class Plain(object):
    pass
''',
    "pkg/utils.py": '''import json
import os.path

def recursive(n):
    return recursive(n - 1) if n else undefined_name

def helper(items, a, b, c, d, e, f):
    out = []
    for x in items:
        out.append(x * 2)
    total = 0
    for x in items:
        total += x
    try:
        out = json.loads("1")
    except:
        pass
    return out

def helper_two(things, a, b, c, d, e, f):
    res = []
    for y in things:
        res.append(y * 2)
    total = 0
    for y in things:
        total += y
    try:
        res = json.loads("1")
    except:
        pass
    return res
''',
    "tests/test_utils.py": "from pkg.utils import helper\ndef test_helper():\n    assert helper([], 1, 2, 3, 4, 5, 6) == []\n",
    "bad.py": "def broken(:\n",
    "app.py": 'import pkg.models\n# TODO(ann): tidy up #12 2020-01-05\nx = 1  # FIXME(P1) now\npassword = "hunter22"\nimport yaml; yaml.load(s)  # noqa: e501,F401\ncursor.execute(f"select {x}")\n# eval(x)\nv = 1  # type: ignore[arg-type] - legacy\nw = 2  # type: ignore\n',
}


@pytest.fixture(scope="module")
def files(spark):
    return of_columns(spark.createDataFrame(list(FILES.items()), "path string, content string"))


@pytest.fixture(scope="module")
def facts(files):
    return Facts(files).persist()


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_tree(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r["path"]: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {k for k, t in FILES.items() if t} and rows["pkg/models.py"]["module"] == "pkg.models" and rows["tests/test_utils.py"]["is_test"] and not rows["app.py"]["is_test"]


def test_parse_errors(facts):
    assert [r["path"] for r in facts.errors.collect()] == ["bad.py"]


def test_complexity(facts):
    greet = facts.functions.where("name = 'greet'").first()
    # if, and, or, for, while, if, elif; for > while > with > if inside the first if
    assert (greet["cyclomatic"], greet["nesting"], greet["n_returns"], greet["n_params"], greet["full_name"], greet["kind"]) == (8, 5, 3, 0, "User.greet", "method")
    assert names(a.deeply_nested(facts)) == ["User.greet"] and names(a.many_parameters(facts)) == ["helper", "helper_two"]
    assert names(a.complex_functions(facts, 7)) == ["User.greet"] and a.complex_functions(facts).count() == 0
    assert a.long_functions(facts, 11).where("name like 'helper%'").count() == 2 and names(a.long_classes(facts, 5)) == ["User"]
    assert a.many_returns(facts, 2).count() == 1 and a.many_branches(facts, 2).count() == 1
    assert a.complexity_issues(facts).count() == 3


def test_dead_code(facts):
    assert names(a.unused_functions(facts)) == ["helper_two", "recursive"]
    assert names(a.unused_classes(facts)) == ["Plain", "User"]
    assert names(a.unused_variables(facts)) == ["password", "timeout", "v", "w"]
    assert [(r["name"], r["line_number"]) for r in a.unreachable_code(facts).collect()] == [("User.greet", 31)]
    assert a.dead_code(facts).count() == 9


def test_patterns(facts, files):
    assert names(a.functions_without_type_hints(facts)) == ["helper", "helper_two", "recursive", "test_helper"]
    assert names(a.classes_without_docstrings(facts)) == ["Plain", "User"]
    assert "User.greet" not in names(a.functions_without_docstrings(facts)) and "User.__init__" in names(a.functions_without_docstrings(facts))
    assert a.bare_excepts(files).count() == 2
    assert names(a.hardcoded_strings(facts), "value_str") == ["unused text value here"]
    numbers = names(a.magic_numbers(facts), "value_str")
    assert "4321" in numbers and "77" not in numbers and "2" not in numbers
    assert ("User.__init__", "name") in [(r["full_name"], r["param"]) for r in a.parameters_without_type_hints(facts).collect()]


def test_repetition_and_loops(facts):
    assert {r["name"] for r in a.similar_functions(facts).collect()} == {"helper", "helper_two"}
    assert a.duplicate_blocks(facts).where("name in ('helper', 'helper_two')").count() == 2
    found = {(r["type"], r["suggested_code"]) for r in a.loop_issues(facts).collect()}
    assert ("LOOP_TO_COMPREHENSION", "out = [x * 2 for x in items]") in found and ("LOOP_TO_SUM", "total = sum(items)") in found
    assert {r["type"] for r in a.comprehension_opportunities(facts).collect()} == {"LOOP_TO_COMPREHENSION"}


def test_imports(facts):
    assert names(a.unused_imports(facts), "code_snippet") == ["from . import utils", "import decimal", "import os", "import os.path", "import pkg.models", "import sys as system"]
    assert ("pkg/utils.py", "undefined_name") in [(r["path"], r["name"]) for r in a.missing_imports(facts).collect()]
    edges = a.import_edges(facts).select("src", "dst").distinct()
    assert ("pkg.models", "pkg") in [tuple(r) for r in edges.collect()] and ("app", "pkg") in [tuple(r) for r in edges.collect()]
    assert {(r["module"], r["group"]) for r in a.classify_imports(facts).collect()} >= {("__future__", "future"), ("decimal", "type_checking"), ("json", "stdlib"), ("pkg.utils", "firstparty"), ("yaml", "thirdparty")}
    assert names(a.external_dependencies(facts)) == ["decimal", "json", "os", "sys", "typing", "yaml"]
    assert names(a.functions_without_tests(facts)) == ["helper_two", "recursive"] and names(a.classes_without_tests(facts)) == ["Plain", "User"]
    assert names(a.old_style_classes(facts), "full_name") == ["Plain"]


def test_enclosing_block(facts, spark):
    lines = spark.createDataFrame([("pkg/models.py", 24), ("pkg/models.py", 15), ("pkg/models.py", 1)], "path string, line_number int")
    assert {(r["line_number"], r["full_name"]) for r in a.enclosing_block(facts, lines).collect()} == {(24, "User.greet"), (15, "User")}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "c"), ("x", "x")], "src string, dst string")
    assert sorted(r["cycle"] for r in graph.cycles(edges).collect()) == [["a", "b", "c"], ["c", "d"]]
    start = spark.createDataFrame([("a",)], "root string")
    assert {(r["node"], r["depth"]) for r in graph.closure(edges, start).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert names(graph.modules(edges), "module") == ["a", "b", "c", "d", "x"]
    assert names(graph.dependents(edges, "c"), "src") == ["b", "d"]


def test_comments(files):
    todos = {r["line_number"]: r for r in comments.todos(files).collect()}
    assert (todos[2]["type"], todos[2]["author"], todos[2]["issue_ref"], str(todos[2]["date"])) == ("TODO", "ann", "#12", "2020-01-05")
    assert (todos[3]["type"], todos[3]["priority"], todos[3]["author"]) == ("FIXME", 1, None)
    found = comments.todos(files)
    assert comments.stale(found).count() == 1 and comments.high_priority(found).count() == 1 and comments.unlinked(found).count() == 1
    summary = comments.todo_summary(found).first()
    assert summary["total"] == 2 and summary["by_type"] == {"FIXME": 1, "TODO": 1}
    directives = {(r["type"], r["line_number"]): r for r in comments.directives(files).collect()}
    assert directives["noqa", 5]["codes"] == ["E501", "F401"] and directives["type_ignore", 8]["codes"] == ["arg-type"] and directives["type_ignore", 8]["reason"] == "legacy"
    every = comments.directives(files)
    assert comments.bare(every, "type_ignore").count() == 1 and comments.with_code(every, "E501").count() == 1
    assert {r["code"]: r["n"] for r in comments.count_by_code(every).collect()} == {"E501": 1, "F401": 1, "arg-type": 1}
    assert '"title"' in comments.issues(found).first()["payload"]


def test_rules(files):
    found = Findings(rules.security_findings(files))
    got = {(r["name"], r["line_number"]) for r in found.df.collect()}
    assert got == {("Password", 4), ("yaml.load without Loader", 5), ("f-string in SQL", 6)}
    assert {r["type"]: r["n"] for r in found.count_by("type").collect()} == {"HARDCODED_PASSWORD": 1, "UNSAFE_YAML_LOAD": 1, "SQL_INJECTION": 1}
    assert found.at_least("critical").df.count() == 2 and found.select_group("injection_risks").df.count() == 1
    assert [r["severity"] for r in found.sorted_by_severity().df.collect()] == ["critical", "critical", "high"]
    assert found.in_directory("app.py").df.count() == 3 and found.in_directory("app").df.count() == 0
    assert found.summary().startswith("Total: 3 findings\n  critical: 2\n  high: 1")
    assert rules.scan(files, [Rule("n", "T", "low", "nothing like this")]).count() == 0


def test_metrics(files):
    per_file = {r["path"]: r for r in metrics.file_metrics(files).collect()}
    assert (per_file["app.py"]["total_lines"], per_file["app.py"]["comment_lines"], per_file["app.py"]["code_lines"]) == (9, 2, 7) and per_file["pkg/__init__.py"]["total_lines"] == 0
    assert {r["path"] for r in metrics.coverage_gaps(files).collect()} == {"app.py", "bad.py", "pkg/models.py"}
    assert metrics.project_summary(metrics.file_metrics(files)).first()["files"] == 6


def test_config(spark):
    texts = {"a.json": '{"a": {"b": [1, 2]}}', "b.yaml": "a:\n  b: [1, 2]\n", "c.toml": "[a]\nb = [1, 2]\n", "d.ini": "[a]\nb = 100%\n", "e.json": "{"}
    rows = {r["path"]: r for r in parse_config(of_columns(spark.createDataFrame(list(texts.items()), "path string, content string"))).collect()}
    assert rows["a.json"]["json"] == rows["b.yaml"]["json"] == rows["c.toml"]["json"] == '{"a": {"b": [1, 2]}}'
    assert rows["d.ini"]["json"] == '{"a": {"b": "100%"}}' and rows["e.json"]["error"].startswith("JSONDecodeError")
