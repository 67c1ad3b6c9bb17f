"""How often an analysis parses its files: once, whatever the number of its findings or edits."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from lodestack import code_queries, edit_queries
from lodestack.operators import analysis, docstrings, graph, metrics
from lodestack.operators import facts as facts_module
from lodestack.operators.edits import check, edit_all, rename_class
from lodestack.operators.facts import Facts, facts_of
from lodestack.plans import reports
from lodestack.sources.files import of_columns


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.py", "import os\n\ndef f(a):\n    if a: return 1\n    return lambda: 2 if a else 3\n"), ("b.py", "class A:\n    def g(self): return f(1)\n"), ("c.py", "def (")]
    return of_columns(spark.createDataFrame(rows, "path string, content string"))


def nodes(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_findings_of_complexity_come_from_one_parse(files):
    assert nodes(analysis.complexity_issues(Facts(files), exits=True), "MapIn") == 1


def test_dead_code_and_repetition_read_what_one_parse_wrote(files):
    assert nodes(analysis.dead_code(Facts(files)), "MapIn") == 0
    assert nodes(analysis.repetition_issues(Facts(files)), "MapIn") == 0


def test_unused_imports_metrics_and_reports_join_no_second_parse(files):
    facts = Facts(files)
    for df in (analysis.unused_imports(facts), metrics.code_metrics(facts), reports.complexity_report(facts)):
        assert (nodes(df, "MapIn"), nodes(df, "Join"), nodes(df, "Aggregate")) == (1, 0, 0)
    assert nodes(docstrings.outdated(facts), "Join") == 0
    assert nodes(analysis.external_dependencies(facts), "MapIn") == 1


def test_edits_of_a_table_are_one_pass(spark):
    assert nodes(edit_queries._edited(spark, "/root/testdata/sf0.001", edit_queries.NAMES), "MapIn") == 1


def test_edits_leave_out_columns_and_keep_errors(files):
    rows = {(r["operation"], r["path"]): r for r in edit_all(files, {"x": (rename_class, ("A", "B"), {}), "y": (lambda c: None, (), {})}, ("path", "operation", "success", "error", "new")).collect()}
    assert len(rows) == 6 and rows["x", "b.py"]["new"].startswith("class B:") and rows["x", "c.py"]["error"].startswith("SyntaxError")
    assert not any(rows["y", p]["success"] for p in ("a.py", "b.py", "c.py"))


def test_parts_of_facts_equal_those_of_all():
    text = "import os\nif TYPE_CHECKING:\n    import re\nX = 5\ndef f(a):\n    for i in a: out.append(i)\n    return lambda: 2 if a else 3\n"
    whole = facts_of(text, False)
    assert whole["defs"][0]["cyclomatic"] == 2 and whole["imports"][1]["is_type_checking"]
    for part in ("imports", "loops", "assigned", "literals", "used"):
        assert facts_of(text, False, (part,))[part] == whole[part]


@pytest.mark.parametrize("new", ["x = 1\n\n\nclass A:\n    b = 3\ny = (\n", "x = 1\nelse:\n    pass\n", "x = 1 \\\n\nclass A:\n    b = 2\n", "x = 1\nclass A:\n    b = 2\n  c = 3\n", "x = 2\n", ""])
def test_a_changed_part_parses_as_the_whole_does(new):
    def said(f):
        try:
            f()
        except SyntaxError as e:
            return str(e)

    assert said(lambda: check("x = 1\n\n\nclass A:\n    b = 2\n", new)) == said(lambda: ast.parse(new))


def test_closures_of_all_nodes_double_their_depth_each_round(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: cuts.append(df) or cut(df))
    code_queries.import_closure(spark, "/root/testdata/sf0.001")
    assert len(cuts) <= 8


@pytest.mark.parametrize("nodes, links, depth", [(30, 60, None), (30, 40, None), (40, 60, 3), (12, 50, None)])
def test_closures_equal_the_closure_of_each_node(spark, nodes, links, depth):
    pick = random.Random(links)
    pairs = [(f"n{pick.randrange(nodes)}", f"n{pick.randrange(nodes)}") for _ in range(links)] + [(f"c{k}", f"c{k + 1}") for k in range(11)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    want = graph.closure(edges, edges.select(F.col("src").alias("root")), depth)
    assert sorted(graph.closures(edges, depth).collect()) == sorted(want.collect())


def test_neighbours_and_modules_read_the_edges_once(spark, files):
    edges = analysis.import_edges(Facts(files), "module").select("src", "dst").distinct()
    assert nodes(graph.neighbours(edges, "os"), "MapIn") == nodes(graph.modules(edges), "MapIn") == 1
    loops = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("c", "d")], "src string, dst string")
    assert sorted(graph.neighbours(loops, "a").collect()) == [("dependency", "a"), ("dependency", "b"), ("dependent", "a"), ("dependent", "b")]


def test_dead_code_reads_what_was_written_three_times(files):
    assert nodes(analysis.dead_code(Facts(files)), "LogicalRDD") == 3


def test_reports_write_no_contents(files, monkeypatch):
    kept = []
    monkeypatch.setattr(facts_module, "cut", lambda df, cut=facts_module.cut: kept.append(df.columns) or cut(df))
    rows = {(r["section"], r["key"]): r["value"] for r in reports.full_report(Facts(files)).collect()}
    assert len(kept) == 1 and "content" not in kept[0]
    assert [rows["summary", k] for k in ("files", "total_lines", "code_lines", "class_count", "function_count", "method_count")] == [3, 8, 7, 1, 1, 1]
    assert rows["findings", "UNUSED_CLASS"] == 1 and ("findings", "UNUSED_FUNCTION") not in rows


def test_repetition_groups_and_joins_all_kinds_at_once(files):
    assert nodes(analysis.repetition_issues(Facts(files)), "Join Inner") == 1


def test_hashes_of_fragments_take_no_second_parse(monkeypatch):
    text = "def f(a, *, b: int = 2):\n    'Doc.'\n    x = g(a.size + b, key=f'{a!r:>{b}} y')\n    if x:\n        x = -x\n        return None\n    return print(x)\n"
    parsed = []
    with monkeypatch.context() as m:
        m.setattr(facts_module.ast, "parse", lambda t, parse=ast.parse: parsed.append(t) or parse(t))
        whole = facts_of(text)
    assert len(parsed) == 1
    renamed = facts_of(text.replace("a", "left").replace("b:", "c:").replace("+ b", "+ c").replace("{b}", "{c}").replace("size", "own"))
    assert {f["norm_hash"] for f in whole["fragments"]} == {f["norm_hash"] for f in renamed["fragments"]} and whole["defs"][0]["body_hash"] == renamed["defs"][0]["body_hash"]
    assert facts_module.norm_hash(ast.parse("x = len(y)").body) != facts_module.norm_hash(ast.parse("x = z(y)").body)


def test_statements_of_imports_take_no_unparser(monkeypatch):
    text = "import a, b.c as d\nfrom . import e\nfrom ..f import g as h, i\nfrom j.k import *\ndef m():\n    import n as o\n"
    want = [ast.unparse(n) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.Import, ast.ImportFrom))]
    with monkeypatch.context() as m:
        m.setattr(facts_module.ast, "unparse", lambda node: 1 / 0)
        got = facts_of(text, False, ("imports",))["imports"]
    assert sorted({i["statement"] for i in got}) == sorted(want)


def test_heads_and_imports_leave_statements_without_a_body_unread(monkeypatch):
    text = "if a:\n    import b\n    c = d = 1\nelse:\n    e()\ndef f():\n    g = lambda: 1\n    h(g)\n    return g\nfor i in j:\n    class K: pass\nmatch l:\n    case 1:\n        import m\n"
    seen = []
    with monkeypatch.context() as p:
        p.setattr(facts_module, "_nested", lambda kind, nested=facts_module._nested: seen.append(kind) or nested(kind))
        p.setattr(facts_module, "_NESTED", {})
        got = facts_of(text, False, ("defs", "imports", "assigned"))
    assert [d["full_name"] for d in got["defs"]] == ["f", "K"] and [i["module"] for i in got["imports"]] == ["b", "m"] and [v["name"] for v in got["assigned"]] == ["c", "d"]
    assert not {ast.Expr, ast.Return} & set(seen)


def test_docstrings_come_from_the_parse_of_the_files(files):
    assert nodes(docstrings.parsed(Facts(files)), "MapIn") == nodes(docstrings.outdated(Facts(files)), "MapIn") == 1
    kept = Facts(files).once("defs")
    assert docstrings.outdated(kept).collect() == docstrings.outdated(Facts(files)).collect() and docstrings.parsed(kept).count() == 0
