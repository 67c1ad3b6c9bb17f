"""A corpus with the analyses as methods: one parse, shared by all of them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions import text
from ..operators import analysis, comments, docstrings, edits, frameworks, metrics, packaging, patching, rules, transactions
from ..operators.facts import Facts
from ..operators.findings import Findings
from ..schemas import union
from ..sources.files import of_columns, read_tree


class Corpus:
    """Files and everything that is asked of them; results are DataFrames or `Findings`."""

    def __init__(self, files: DataFrame):
        self.files = files

    @classmethod
    def read(cls, spark: SparkSession, root: str, glob: str = "*.py") -> Corpus:
        return cls(read_tree(spark, root, glob))

    @classmethod
    def of_table(cls, df: DataFrame, path: str, content: str, module: str | None = None) -> Corpus:
        return cls(of_columns(df, path, content, module))

    @cached_property
    def facts(self) -> Facts:
        return Facts(self.files).persist()

    def find_classes(self, pattern: str = "") -> DataFrame:
        rows = self.facts.classes.where("depth = 0")
        return rows.where(rows["name"].rlike(pattern)) if pattern else rows

    def find_functions(self, pattern: str = "") -> DataFrame:
        rows = self.facts.functions.where("depth = 0")
        return rows.where(rows["name"].rlike(pattern)) if pattern else rows

    def find_methods(self, pattern: str = "") -> DataFrame:
        rows = self.facts.functions.where("kind = 'method'")
        return rows.where(rows["name"].rlike(pattern)) if pattern else rows

    def find_strings(self, pattern: str = "", docstrings: bool = True) -> DataFrame:
        rows = self.facts.literals.where("kind = 'string'")
        rows = rows if docstrings else rows.where("not is_docstring")
        return rows.where(rows["value"].rlike(pattern)) if pattern else rows

    def search(self, pattern: str) -> DataFrame:
        return text.search(self.files, pattern)

    def analysis_issues(self) -> Findings:
        return Findings(union(analysis.complexity_issues(self.facts), analysis.pattern_issues(self.facts), analysis.dead_code(self.facts)), "analysis")

    def optimization_opportunities(self) -> Findings:
        return Findings(union(analysis.repetition_issues(self.facts), analysis.loop_issues(self.facts)), "optimize")

    def security_issues(self) -> Findings:
        return Findings(rules.security_findings(self.files))

    def todos(self) -> DataFrame:
        return comments.todos(self.files)

    def directives(self) -> DataFrame:
        return comments.directives(self.files)

    def metrics(self) -> DataFrame:
        return metrics.file_metrics(self.files)

    def outdated_docstrings(self) -> DataFrame:
        return docstrings.outdated(self.facts)

    def import_edges(self, granularity: str = "top") -> DataFrame:
        return analysis.import_edges(self.facts, granularity)

    def routes(self) -> DataFrame:
        return frameworks.routes(self.files)

    def requirements(self) -> DataFrame:
        return packaging.requirements(self.files)

    def edit(self, change, *args, **named) -> DataFrame:
        return edits.edit(self.files, change, *args, **named)

    def patch(self, parsed: DataFrame, strict: bool = False) -> DataFrame:
        return patching.apply(self.files, parsed, strict)

    def commit(self, log: DataFrame) -> Corpus:
        """A corpus with an edit log applied; this one stays as it is."""
        return Corpus(transactions.commit(self.files, log))
