"""Analyzers over facts: complexity, dead code, patterns, repetition, loops and imports, all as `findings`."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import explode_lines, strip
from ..rounds import cut
from ..schemas import finding, union
from .duplicates import duplicate_findings
from .facts import BUILTINS, Facts, parse

STDLIB = sorted(sys.stdlib_module_names)


Rule = tuple[Column, list[Column]]
"""When a row is a finding, and the finding's columns."""


def _found(rows: DataFrame, *rules: Rule) -> DataFrame:
    """The findings of all rules, from one pass over the rows."""
    every = F.filter(F.array(*(F.when(when, F.struct(*columns)) for when, columns in rules)), lambda x: x.isNotNull())
    return rows.select(F.explode(every).alias("_f")).select("_f.*")


def _over(is_class: bool, type_: str, value: str | Column, threshold: float, severity: str, what: str) -> Rule:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    own = F.col("kind") == "class" if is_class else F.col("kind") != "class"
    return own & (v > threshold), finding("analysis", type_, file_path=F.col("path"), line_number=F.col("start_line"), end_line=F.col("end_line"), name=F.col("full_name"), message=F.concat(F.col("full_name"), F.lit(f": {what} "), v.cast("int").cast("string"), F.lit(f", more than {threshold:g}")), severity=severity, value_num=v, threshold=float(threshold))


def _lines() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


def _complex(most: int = 10) -> Rule:
    return _over(False, "HIGH_COMPLEXITY", "cyclomatic", most, "warning", "cyclomatic complexity")


def _long_function(most: int = 50) -> Rule:
    return _over(False, "LONG_FUNCTION", _lines(), most, "warning", "lines")


def _long_class(most: int = 500) -> Rule:
    return _over(True, "LONG_CLASS", _lines(), most, "warning", "lines")


def _nested(most: int = 4) -> Rule:
    return _over(False, "DEEP_NESTING", "nesting", most, "warning", "nesting depth")


def _parameters(most: int = 5) -> Rule:
    return _over(False, "TOO_MANY_PARAMETERS", "n_params", most, "info", "parameters")


def _branches(most: int = 10) -> Rule:
    return _over(False, "TOO_MANY_BRANCHES", "branches", most, "info", "branches")


def _returns(most: int = 5) -> Rule:
    return _over(False, "TOO_MANY_RETURNS", "n_returns", most, "info", "returns")


def complex_functions(facts: Facts, most: int = 10) -> DataFrame:
    return _found(facts.defs, _complex(most))


def long_functions(facts: Facts, most: int = 50) -> DataFrame:
    return _found(facts.heads, _long_function(most))


def long_classes(facts: Facts, most: int = 500) -> DataFrame:
    return _found(facts.heads, _long_class(most))


def deeply_nested(facts: Facts, most: int = 4) -> DataFrame:
    return _found(facts.heads, _nested(most))


def many_parameters(facts: Facts, most: int = 5) -> DataFrame:
    return _found(facts.heads, _parameters(most))


def many_branches(facts: Facts, most: int = 10) -> DataFrame:
    return _found(facts.defs, _branches(most))


def many_returns(facts: Facts, most: int = 5) -> DataFrame:
    return _found(facts.defs, _returns(most))


def complexity_issues(facts: Facts, exits: bool = False) -> DataFrame:
    """Complexity, length, nesting and parameters, and with `exits` branches and returns too, from one parse."""
    return _found(facts.defs, _complex(), _long_function(), _long_class(), _nested(), _parameters(), *([_branches(), _returns()] if exits else []))


def _defined(kind: str, exempt: str, type_: str) -> Column:
    """What may go unused of a file's definitions: those of a kind at its top level."""
    own = F.filter("defs", lambda d: (d["kind"] == kind) & (d["depth"] == 0) & ~d["name"].rlike(exempt))
    return F.transform(own, lambda d: F.struct(F.lit(type_).alias("type"), F.lit(kind).alias("what"), d["name"].alias("name"), d["start_line"].alias("line")))


def _functions() -> Column:
    return _defined("function", r"^(_|main|setup|teardown|setUp|tearDown|test_)", "UNUSED_FUNCTION")


def _classes() -> Column:
    return _defined("class", r"^(_|Test|Mock|Fake|Base|Abstract|Mixin)|(Test|Mock|Fake|Base|Abstract|Mixin)$", "UNUSED_CLASS")


def _variables() -> Column:
    own = F.filter("assigned", lambda v: ~v["name"].startswith("_") & (v["name"] != F.upper(v["name"])))
    return F.transform(own, lambda v: F.struct(F.lit("UNUSED_VARIABLE").alias("type"), F.lit("variable").alias("what"), v["name"].alias("name"), v["line_number"].alias("line")))


def _unused(facts: Facts, parts: tuple[str, ...], *own: Column) -> DataFrame:
    """Names that no file uses, of all kinds in one read; what is used is one distinct name each, so a common name shuffles once per task."""
    rows = facts.of(*parts).select("path", F.explode(F.concat(*own)).alias("_x")).select("path", "_x.*")
    unused = rows.join(facts.used.select("name").distinct(), "name", "left_anti")
    return unused.select(*finding("analysis", F.col("type"), file_path=F.col("path"), line_number=F.col("line"), name=F.col("name"), message=F.concat("what", F.lit(" "), "name", F.lit(" is never used")), severity="info"))


def unused_functions(facts: Facts) -> DataFrame:
    return _unused(facts, ("defs",), _functions())


def unused_classes(facts: Facts) -> DataFrame:
    return _unused(facts, ("defs",), _classes())


def unused_variables(facts: Facts) -> DataFrame:
    return _unused(facts, ("assigned",), _variables())


def unreachable_code(facts: Facts) -> DataFrame:
    rows = facts.heads.where("kind <> 'class'").select("path", "full_name", F.explode("unreachable").alias("line_number"))
    return rows.select(*finding("analysis", "UNREACHABLE_CODE", file_path=F.col("path"), line_number=F.col("line_number"), name=F.col("full_name"), message="statement after return or raise", severity="warning"))


def dead_code(facts: Facts) -> DataFrame:
    """All four from one parse, which is written once, as names and what may go unused are read each by itself."""
    facts = facts if facts.kept else facts.once("defs", "assigned", "used")
    return union(_unused(facts, ("defs", "assigned"), _functions(), _classes(), _variables()), unreachable_code(facts))


def _missing(when: Column, type_: str, what: str) -> Rule:
    return when, finding("analysis", type_, file_path=F.col("path"), line_number=F.col("start_line"), end_line=F.col("end_line"), name=F.col("full_name"), message=F.concat("full_name", F.lit(f" has no {what}")), severity="info")


def _real_params() -> Column:
    return F.filter("params", lambda p: ~p["name"].isin("self", "cls"))


def _unhinted() -> Rule:
    hinted = F.exists(_real_params(), lambda p: p["annotation"].isNotNull())
    dunder = F.col("name").rlike("^__.*__$") & (F.size(_real_params()) == 0)
    return _missing((F.col("kind") != "class") & F.col("returns").isNull() & ~hinted & ~dunder, "MISSING_TYPE_HINT", "type hint")


def _undocumented_class() -> Rule:
    return _missing((F.col("kind") == "class") & F.col("docstring").isNull(), "MISSING_DOCSTRING", "docstring")


def _undocumented_function() -> Rule:
    keep = ~F.col("name").startswith("_") | F.col("name").rlike("^__.*__$")
    return _missing((F.col("kind") != "class") & F.col("docstring").isNull() & keep, "MISSING_DOCSTRING", "docstring")


def functions_without_type_hints(facts: Facts) -> DataFrame:
    return _found(facts.heads, _unhinted())


def parameters_without_type_hints(facts: Facts) -> DataFrame:
    rows = facts.heads.where("kind <> 'class'").select("path", "full_name", "start_line", F.explode(_real_params()).alias("p"))
    return rows.where("p.annotation is null").select("path", "full_name", "start_line", F.col("p.name").alias("param"))


def classes_without_docstrings(facts: Facts) -> DataFrame:
    return _found(facts.heads, _undocumented_class())


def functions_without_docstrings(facts: Facts) -> DataFrame:
    return _found(facts.heads, _undocumented_function())


def bare_excepts(files: DataFrame) -> DataFrame:
    rows = explode_lines(files.where(F.col("content").contains("except:"))).where(strip("text").rlike("^except:( .*)?$"))
    return rows.select(*finding("analysis", "BARE_EXCEPT", file_path=F.col("path"), line_number=F.col("line_number"), message="except without an exception", severity="warning", code_snippet=strip("text")))


def _hardcoded(least: int = 10) -> Rule:
    plain = (F.col("kind") == "string") & (F.length("value") >= least) & ~F.col("in_call") & ~F.col("constant_target") & ~F.col("is_docstring") & ~F.col("value").rlike(r"[/\\]|://|\{\}|\{\{|\}\}|%s|%d")
    return plain, finding("analysis", "HARDCODED_STRING", file_path=F.col("path"), line_number=F.col("line_number"), message="hardcoded string", severity="info", value_str=F.substring("value", 1, 50))


def _magic() -> Rule:
    number = F.col("value").try_cast("double")
    odd = F.when(F.col("kind") == "int", ~number.isin(0, 1, 2, -1, 10, 100, 1000, 60, 24, 365) & (F.abs(number) > 2)).otherwise((F.col("kind") == "float") & ~number.isin(0.0, 0.5, 1.0, 2.0))
    return odd & ~F.col("constant_target"), finding("analysis", "MAGIC_NUMBER", file_path=F.col("path"), line_number=F.col("line_number"), message=F.concat(F.lit("magic number "), "value"), severity="info", value_num=number, value_str=F.col("value"))


def hardcoded_strings(facts: Facts, least: int = 10) -> DataFrame:
    return _found(facts.literals, _hardcoded(least))


def magic_numbers(facts: Facts) -> DataFrame:
    return _found(facts.literals, _magic())


def literal_issues(facts: Facts) -> DataFrame:
    return _found(facts.literals, _hardcoded(), _magic())


def pattern_issues(facts: Facts) -> DataFrame:
    return union(_found(facts.heads, _unhinted(), _undocumented_class(), _undocumented_function()), bare_excepts(facts.files))


def definition_issues(facts: Facts) -> DataFrame:
    """`complexity_issues` and `pattern_issues`, with one read of the definitions."""
    return union(_found(facts.defs, _complex(), _long_function(), _long_class(), _nested(), _parameters(), _unhinted(), _undocumented_class(), _undocumented_function()), bare_excepts(facts.files))


# What repeats: its least number of occurrences and its severity.
_REPEATED = {"DUPLICATE_CODE_BLOCK": (2, "warning"), "DUPLICATE_EXPRESSION": (3, "suggestion"), "DUPLICATE_LITERAL": (3, "suggestion"), "SIMILAR_FUNCTION": (2, "suggestion")}


def _repeatable(type_: str, key: Column, start: Column, end: Column, context: Column, source: Column) -> Column:
    return F.struct(F.lit(type_).alias("type"), key.alias("norm_hash"), start.alias("start_line"), end.alias("end_line"), context.alias("context"), source.alias("source"))


def _fragments(type_: str, keep) -> Column:
    own = F.filter("fragments", lambda f: (F.length(f["source"]) > 20) & keep(f))
    return F.transform(own, lambda f: _repeatable(type_, f["norm_hash"], f["start_line"], f["end_line"], f["context"], f["source"]))


def _block_rows(lines: int = 3) -> Column:
    return _fragments("DUPLICATE_CODE_BLOCK", lambda f: (f["kind"] != "expression") & (f["end_line"] - f["start_line"] + 1 >= lines))


def _expression_rows() -> Column:
    return _fragments("DUPLICATE_EXPRESSION", lambda f: f["kind"] == "expression")


def _literal_rows() -> Column:
    long = lambda x: F.when(x["kind"] == "string", (F.length(x["value"]) > 3) & ~x["is_docstring"]).otherwise((x["kind"] == "int") & (F.abs(x["value"].try_cast("double")) > 2))
    return F.transform(F.filter("literals", long), lambda x: _repeatable("DUPLICATE_LITERAL", F.concat_ws(":", x["kind"], x["value"]), x["line_number"], x["line_number"], F.lit(None).cast("string"), x["value"]))


def _body_rows() -> Column:
    own = F.filter("defs", lambda d: (d["kind"] != "class") & d["body_hash"].isNotNull())
    return F.transform(own, lambda d: _repeatable("SIMILAR_FUNCTION", d["body_hash"], d["start_line"], d["end_line"], d["full_name"], d["full_name"]))


def _repeated(facts: Facts, least: dict[str, int], parts: tuple[str, ...], *own: Column) -> DataFrame:
    """Findings of all kinds from one parse, of which only what may repeat is written, once; one grouping and one join serve all kinds."""
    rows = (facts.whole if facts.kept else parse(facts.files, True, parts)).select("path", F.explode(F.concat(*own)).alias("_x")).select("path", "_x.*")
    pick = lambda of: reduce(lambda out, t: F.when(F.col("type") == t, of(t)).otherwise(out), _REPEATED, F.lit(None))
    return duplicate_findings(rows if facts.kept else cut(rows), F.col("type"), least=pick(lambda t: F.lit(least.get(t, _REPEATED[t][0]))), severity=pick(lambda t: F.lit(_REPEATED[t][1])), within=("type",))


def duplicate_blocks(facts: Facts, lines: int = 3, least: int = 2) -> DataFrame:
    return _repeated(facts, {"DUPLICATE_CODE_BLOCK": least}, ("fragments",), _block_rows(lines))


def duplicate_expressions(facts: Facts, least: int = 3) -> DataFrame:
    return _repeated(facts, {"DUPLICATE_EXPRESSION": least}, ("fragments",), _expression_rows())


def duplicate_literals(facts: Facts, least: int = 3) -> DataFrame:
    return _repeated(facts, {"DUPLICATE_LITERAL": least}, ("literals",), _literal_rows())


def similar_functions(facts: Facts) -> DataFrame:
    return _repeated(facts, {}, ("defs",), _body_rows())


def repetition_issues(facts: Facts) -> DataFrame:
    return _repeated(facts, {}, ("defs", "literals", "fragments"), _block_rows(), _expression_rows(), _literal_rows(), _body_rows())


def loop_issues(facts: Facts, *patterns: str, least: float = 0.7) -> DataFrame:
    rows = facts.loops.where(F.col("confidence") >= least)
    rows = rows.where(F.col("pattern").isin(*patterns)) if patterns else rows
    return rows.select(*finding("optimize", F.col("pattern"), file_path=F.col("path"), line_number=F.col("start_line"), end_line=F.col("end_line"), message=F.concat(F.lit("could be "), "suggestion"), severity=F.when(F.col("confidence") >= 0.85, "suggestion").otherwise("info"), value_num=F.col("confidence"), suggested_code=F.col("suggestion")))


def comprehension_opportunities(facts: Facts) -> DataFrame:
    return loop_issues(facts, "LOOP_TO_COMPREHENSION", "LOOP_TO_DICT_COMPREHENSION", "LOOP_TO_SET_COMPREHENSION", "LOOP_TO_FILTER")


def builtin_opportunities(facts: Facts) -> DataFrame:
    return loop_issues(facts, "LOOP_TO_SUM", "LOOP_TO_JOIN", "LOOP_TO_ANY_ALL", "LOOP_TO_MAP", "LOOP_TO_FILTER", "LOOP_TO_ENUMERATE")


def iterator_opportunities(facts: Facts) -> DataFrame:
    return loop_issues(facts, "LOOP_TO_ENUMERATE", "LOOP_TO_ZIP")


def bound_names() -> Column:
    """The names that an import statement binds: aliases, else the first segment of a plain import."""
    return F.transform("names", lambda n: F.coalesce(F.col("aliases")[n], F.when(F.col("is_from"), n).otherwise(F.substring_index(n, ".", 1))))


def unused_imports(facts: Facts) -> DataFrame:
    """Imports none of whose names their own file uses; future and star imports are exempt."""
    rows = facts.of("imports", "named").select("path", "named", F.explode("imports").alias("_x")).select("path", "named", "_x.*")
    rows = rows.where(~F.col("is_future") & ~F.array_contains("names", "*")).where(~F.arrays_overlap(bound_names(), "named"))
    return rows.select(*finding("analysis", "UNUSED_IMPORT", file_path=F.col("path"), line_number=F.col("line_number"), name=F.col("module"), message=F.concat("statement", F.lit(" is never used")), severity="info", code_snippet=F.col("statement")))


def missing_imports(facts: Facts) -> DataFrame:
    """(path, name): names that a file uses and neither imports, defines, assigns anywhere nor gets from the builtins."""
    known = F.array(*map(F.lit, sorted(BUILTINS | {"self", "cls", "super", "type", "object", "__file__", "__name__", "__doc__"})))
    imported = F.flatten(F.transform("imports", lambda i: F.transform(i["names"], lambda n: F.coalesce(i["aliases"][n], F.when(i["is_from"], n).otherwise(F.substring_index(n, ".", 1))))))
    defined = F.transform("defs", lambda d: d["name"])
    left = F.array_except(F.array_except(F.array_except(F.array_except("used", imported), defined), F.col("stored")), known)
    return facts.of("used", "imports", "defs", "stored").where("error is null").select("path", F.explode(left).alias("name"))


def import_edges(facts: Facts, granularity: str = "top") -> DataFrame:
    """edges(src, dst, path, line_number): relative imports resolved by level; absolute ones cut to the top package, or whole with granularity 'module'."""
    rows = facts.imports.where("not is_future")
    parts = F.split("file_module", r"\.")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
    relative = F.concat_ws(".", F.when(up != "", up), F.when(F.col("module") != "", F.col("module")))
    absolute = F.substring_index("module", ".", 1) if granularity == "top" else F.col("module")
    return rows.select(F.col("file_module").alias("src"), F.when(F.col("level") > 0, relative).otherwise(absolute).alias("dst"), "path", "line_number").where("dst <> ''")


def classify_imports(facts: Facts) -> DataFrame:
    """imports with `group`: future, type_checking, firstparty, stdlib or thirdparty; first-party names are the corpus's own."""
    own = facts.files.select(F.substring_index("module", ".", 1).alias("top")).distinct().withColumn("own", F.lit(True))
    rows = facts.imports.withColumn("top", F.substring_index("module", ".", 1)).join(own, "top", "left")
    group = F.when(F.col("is_future"), "future").when(F.col("is_type_checking"), "type_checking").when((F.col("level") > 0) | F.col("own"), "firstparty").when(F.col("top").isin(*STDLIB), "stdlib").otherwise("thirdparty")
    return rows.withColumn("group", group).drop("own")


def external_dependencies(facts: Facts) -> DataFrame:
    """Top packages that are imported and not the corpus's own."""
    own = facts.files.select(F.substring_index("module", ".", 1).alias("name")).distinct()
    return facts.imports.where("level = 0 and not is_future").select(F.substring_index("module", ".", 1).alias("name")).distinct().join(own, "name", "left_anti")


def functions_without_tests(facts: Facts) -> DataFrame:
    """Public top-level functions of source files that no `test_<name>` names."""
    tested = facts.heads.where("is_test and name like 'test\\\\_%'").select(F.regexp_replace("name", "^test_", "").alias("name")).distinct()
    return facts.heads.where("not is_test and kind = 'function' and depth = 0 and not name like '\\\\_%'").join(tested, "name", "left_anti").select("path", "name", "start_line")


def classes_without_tests(facts: Facts) -> DataFrame:
    tested = facts.classes.where("is_test and name like 'Test%'").select(F.regexp_replace("name", "^Test", "").alias("name")).distinct()
    return facts.classes.where("not is_test and depth = 0 and not name like '\\\\_%'").join(tested, "name", "left_anti").select("path", "name", "start_line")


def old_style_classes(facts: Facts) -> DataFrame:
    return facts.classes.where(F.col("bases") == F.array(F.lit("object"))).select("path", "full_name", "start_line")


def enclosing_block(facts: Facts, lines: DataFrame) -> DataFrame:
    """For (path, line_number), the narrowest definition around it; an equi-join on the path, then a least span."""
    near = lines.join(facts.heads.select("path", "full_name", "kind", "start_line", "end_line"), "path").where("line_number between start_line and end_line")
    return near.groupBy("path", "line_number").agg(F.min_by(F.struct("full_name", "kind", "start_line", "end_line"), _lines()).alias("block")).select("path", "line_number", "block.*")
