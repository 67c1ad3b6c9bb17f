"""One parse pass over Python files: definitions, names, imports, literals, fragments, loops and more, as fact rows.

`parse` maps each file to one row with an array for every kind of fact; `Facts` explodes an array
only where it is asked for. A file that doesn't parse gives an error and no facts. Parsing is the one
step in Python; everything that is computed from facts is built from DataFrame operations.
"""

from __future__ import annotations

import ast
import builtins
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..rounds import cut
from .docstrings import PARSED, parse_docstring

PARAM = "struct<name:string,annotation:string,default:string,kind:string>"
DEF = f"struct<kind:string,name:string,full_name:string,class_name:string,start_line:int,end_line:int,depth:int,params:array<{PARAM}>,returns:string,decorators:array<string>,bases:array<string>,docstring:string,is_async:boolean,body_hash:string,cyclomatic:int,nesting:int,branches:int,n_returns:int,n_params:int,unreachable:array<int>>"
IMPORT = "struct<line_number:int,module:string,names:array<string>,aliases:map<string,string>,is_from:boolean,level:int,is_future:boolean,is_type_checking:boolean,statement:string>"
LITERAL = "struct<kind:string,value:string,line_number:int,in_call:boolean,constant_target:boolean,is_docstring:boolean>"
FRAGMENT = "struct<kind:string,norm_hash:string,source:string,start_line:int,end_line:int,context:string,statements:int>"
LOOP = "struct<pattern:string,suggestion:string,confidence:double,start_line:int,end_line:int>"
KINDS = {
    "docstring": "string", "defs": f"array<{DEF}>", "used": "array<string>", "named": "array<string>", "stored": "array<string>", "assigned": "array<struct<name:string,line_number:int>>",
    "imports": f"array<{IMPORT}>", "literals": f"array<{LITERAL}>", "fragments": f"array<{FRAGMENT}>", "loops": f"array<{LOOP}>", "docs": f"array<{PARSED}>",
}
# Files that become one Arrow batch, so that a worker holds the facts of no more.
ROWS = 500

_BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
BUILTINS = set(dir(builtins))


def nesting(body: list[ast.stmt], depth: int = 0) -> int:
    """The deepest block; an `elif` is a block within its `if`."""
    most = depth
    for s in body:
        if type(s) in _BLOCK:
            for part in ("body", "orelse", "finalbody"):
                if inner := getattr(s, part, None):
                    most = max(most, nesting(inner, depth + 1))
            for h in getattr(s, "handlers", ()):
                most = max(most, nesting(h.body, depth + 1))
            most = max(most, depth + 1)
    return most


def _text(node: ast.AST) -> str:
    """A node as source; most are names, which need no unparser."""
    return node.id if type(node) is ast.Name else ast.unparse(node)


def _import_text(node: ast.Import | ast.ImportFrom) -> str:
    """What the unparser gives."""
    names = ", ".join([f"{a.name} as {a.asname}" if a.asname else a.name for a in node.names])
    return f"import {names}" if type(node) is ast.Import else f"from {'.' * (node.level or 0)}{node.module or ''} import {names}"


def params_of(args: ast.arguments) -> list[dict]:
    text = lambda x: None if x is None else _text(x)
    plain = [*((a, "positional_only") for a in args.posonlyargs), *((a, "positional") for a in args.args)]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    rows = [(a, kind, d) for (a, kind), d in zip(plain, defaults, strict=True)]
    rows += [(args.vararg, "var_positional", None)] if args.vararg else []
    rows += [(a, "keyword_only", d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    rows += [(args.kwarg, "var_keyword", None)] if args.kwarg else []
    return [{"name": a.arg, "annotation": text(a.annotation), "default": text(d), "kind": kind} for a, kind, d in rows]


# The fields that hold a name of the program's own: they are numbered. Annotations of arguments are left out.
_NAMES = {(ast.Name, "id"), (ast.Attribute, "attr"), (ast.keyword, "arg"), (ast.arg, "arg"), *((k, "name") for k in (*_DEFS, ast.ClassDef))}
_DUMPED: dict[type, tuple[tuple[str, str, bool], ...]] = {}
"""The fields of each kind of node as a dump has them: name, text before the value, and whether it is a name to number."""


def _dumped(kind: type) -> tuple[tuple[str, str, bool], ...]:
    out = _DUMPED[kind] = tuple((f, f"{f}=", (kind, f) in _NAMES) for f in kind._fields if (kind, f) != (ast.arg, "annotation"))
    return out


def _renamed(node: object, seen: dict[str, str]) -> str:
    """The dump of a node, with names, of attributes, arguments and definitions too, but builtins as _var0, _var1, ... in the order of appearance."""
    kind = type(node)
    if kind is list:
        return f"[{', '.join([_renamed(x, seen) for x in node])}]"
    if not isinstance(node, ast.AST):
        return repr(node)
    args, bare = [], kind is ast.Constant or kind is ast.MatchSingleton
    for field, before, named in _DUMPED[kind] if kind in _DUMPED else _dumped(kind):
        value = getattr(node, field, None)
        if value is None and (field != "value" or not bare) or type(value) is list and not value:
            continue
        if named and value not in BUILTINS:
            value = seen.get(value) or seen.setdefault(value, f"_var{len(seen)}")
        args.append(before + (repr(value) if type(value) is str else _renamed(value, seen)))
    return f"{kind.__name__}({', '.join(args)})"


def norm_hash(nodes: list[ast.AST]) -> str:
    """The hash of nodes whatever their names, each as a module of its own; dumped as they stand, without a second parse."""
    seen: dict[str, str] = {}
    own = [f"Module(body=[{_renamed(n, seen) if isinstance(n, ast.stmt) else f'Expr(value={_renamed(n, seen)})'}])" for n in nodes]
    return hashlib.md5("\n".join(own).encode()).hexdigest()


def after_exit(body: list[ast.stmt]) -> list[int]:
    """The first statement after a return or raise of the body itself."""
    for a, b in zip(body, body[1:]):
        if isinstance(a, (ast.Return, ast.Raise)):
            return [b.lineno]
    return []


def _def(node: ast.AST, kind: str, scope: list[str], class_name: str | None, body_hash: str | None = None) -> dict:
    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    row = {"kind": kind, "name": node.name, "full_name": ".".join([*scope, node.name]), "class_name": class_name, "start_line": first, "end_line": node.end_lineno, "depth": len(scope), "decorators": [_text(d) for d in node.decorator_list], "docstring": ast.get_docstring(node, clean=False)}
    if kind == "class":
        return row | {"bases": [_text(b) for b in node.bases], "params": [], "is_async": False, "unreachable": []}
    params = params_of(node.args)
    counted = [p for p in params if p["kind"] != "positional_only" and p["name"] not in ("self", "cls")]
    return row | {
        "bases": [], "params": params, "returns": _text(node.returns) if node.returns else None, "is_async": isinstance(node, ast.AsyncFunctionDef), "body_hash": body_hash,
        "nesting": nesting(node.body), "n_params": len(counted), "unreachable": after_exit(node.body),
    }


def _type_checking(test: ast.expr) -> bool:
    if isinstance(test, ast.Attribute):
        return test.attr == "TYPE_CHECKING" and isinstance(test.value, ast.Name) and test.value.id == "typing"
    return isinstance(test, ast.Name) and test.id == "TYPE_CHECKING"


def _fragment(kind: str, nodes: list[ast.AST], context: str | None, digest: str | None = None) -> dict:
    text = "\n".join(ast.unparse(n) for n in nodes)
    return {"kind": kind, "norm_hash": digest or norm_hash(nodes), "source": text, "start_line": nodes[0].lineno, "end_line": nodes[-1].end_lineno, "context": context, "statements": len(nodes)}


def loop_patterns(node: ast.For) -> Iterator[tuple[str, str, float]]:
    """(pattern, suggestion, confidence) of a `for` that a comprehension, builtin or iterator could replace."""
    target, over, body = ast.unparse(node.target), ast.unparse(node.iter), node.body
    call = lambda s, m: isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Attribute) and s.value.func.attr == m and len(s.value.args) == 1
    one = body[0] if len(body) == 1 else None
    if call(one, "append"):
        into, value = ast.unparse(one.value.func.value), ast.unparse(one.value.args[0])
        yield "LOOP_TO_COMPREHENSION", f"{into} = list({over})" if value == target else f"{into} = [{value} for {target} in {over}]", 0.95
        if isinstance(one.value.args[0], ast.Call) and [ast.unparse(a) for a in one.value.args[0].args] == [target]:
            yield "LOOP_TO_MAP", f"{into} = list(map({ast.unparse(one.value.args[0].func)}, {over}))", 0.85
    if isinstance(one, ast.Assign) and isinstance(one.targets[0], ast.Subscript):
        yield "LOOP_TO_DICT_COMPREHENSION", f"{ast.unparse(one.targets[0].value)} = {{{ast.unparse(one.targets[0].slice)}: {ast.unparse(one.value)} for {target} in {over}}}", 0.9
    if call(one, "add"):
        yield "LOOP_TO_SET_COMPREHENSION", f"{ast.unparse(one.value.func.value)} = {{{ast.unparse(one.value.args[0])} for {target} in {over}}}", 0.95
    if isinstance(one, ast.AugAssign) and isinstance(one.op, ast.Add):
        into, value = ast.unparse(one.target), ast.unparse(one.value)
        yield "LOOP_TO_SUM", f"{into} = sum({over})" if value == target else f"{into} = sum({value} for {target} in {over})", 0.95
        if value == target or value.startswith("str("):
            yield "LOOP_TO_JOIN", f"{into} = ''.join({over if value == target else f'{value} for {target} in {over}'})", 0.8
    if isinstance(one, ast.If) and not one.orelse and len(one.body) == 1:
        inner, test = one.body[0], ast.unparse(one.test)
        if isinstance(inner, ast.Return) and isinstance(inner.value, ast.Constant) and isinstance(inner.value.value, bool):
            yield "LOOP_TO_ANY_ALL", f"return any({test} for {target} in {over})" if inner.value.value else f"return not any({test} for {target} in {over})", 0.85
        if call(inner, "append"):
            value = ast.unparse(inner.value.args[0])
            yield "LOOP_TO_FILTER", f"{ast.unparse(inner.value.func.value)} = [{value} for {target} in {over} if {test}]", 0.9
    last = body[-1]
    if len(body) >= 2 and isinstance(last, ast.AugAssign) and isinstance(last.op, ast.Add) and isinstance(last.value, ast.Constant) and last.value.value == 1:
        yield "LOOP_TO_ENUMERATE", f"for {ast.unparse(last.target)}, {target} in enumerate({over})", 0.9
    if isinstance(node.iter, ast.Call) and ast.unparse(node.iter.func) == "range" and len(node.iter.args) == 1 and ast.unparse(node.iter.args[0]).startswith("len("):
        yield "LOOP_TO_ZIP", f"for {target}, item in enumerate({ast.unparse(node.iter.args[0])[4:-1]})", 0.7


_BLOCK, _DEF = frozenset(_BLOCKS), frozenset((*_DEFS, ast.ClassDef))
_SCOPED = frozenset((ast.ExceptHandler, ast.MatchAs, ast.MatchStar))
_FORKS = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp))
# Statements that hold nothing but expressions; assignments hold more only at the top level.
_BARE = frozenset((ast.Expr, ast.Return, ast.Delete, ast.AugAssign, ast.Raise, ast.Assert, ast.Global, ast.Nonlocal, ast.Pass, ast.Break, ast.Continue))
_ASSIGNS = frozenset((ast.Assign, ast.AnnAssign))
_PLAIN = (bool, type(None), type(...))
_PARTS = ("body", "handlers", "orelse", "finalbody", "cases")
_CHILDREN: dict[type, tuple[str, ...]] = {}
"""The fields of each kind of node that may hold nodes with a meaning of their own."""


def _children(kind: type) -> tuple[str, ...]:
    out = _CHILDREN[kind] = tuple(f for f in kind._fields if f not in ("ctx", "op", "ops", "id", "attr", "name", "names", "type_comment", "conversion", "simple", "is_async", "rest", "kwd_attrs"))
    return out


_NESTED: dict[type, tuple[str, ...]] = {}
"""The fields of each kind of node that hold statements; most kinds have none."""


def _nested(kind: type) -> tuple[str, ...]:
    own = kind._fields if issubclass(kind, (ast.stmt, ast.ExceptHandler, ast.match_case)) else ()
    out = _NESTED[kind] = tuple(f for f in _PARTS if f in own)
    return out


def _documented(body: list[ast.stmt]) -> bool:
    return bool(body) and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str)


class _Scope:
    """Where a node stands: the names around it, the class whose body it is in, the definitions it is part of, and whether only type checkers run it."""

    __slots__ = ("names", "class_name", "defining", "checking")

    def __init__(self, names: list[str], class_name: str | None, defining: tuple, checking: bool):
        self.names, self.class_name, self.defining, self.checking = names, class_name, defining, checking


class _Walk:
    """One walk over a tree; expressions are entered only if some of the facts asked for are in them."""

    def __init__(self, parts: frozenset[str], fragments: bool):
        self.fragments, self.whole = fragments, fragments or not parts.isdisjoint(("used", "named", "stored", "literals", "measures", "fragments"))
        self.defs, self.imports, self.literals, self.found, self.loops, self.assigned = [], [], [], [], [], []
        self.used, self.named, self.stored = set(), set(), set()
        self.with_defs, self.with_loops, self.with_literals = "defs" in parts, "loops" in parts, "literals" in parts
        self.doc = None

    def body(self, nodes: list[ast.stmt], at: _Scope, measures: list[int] | None) -> None:
        """The statements of a module, class or function."""
        before, self.doc = self.doc, nodes[0].value if _documented(nodes) else None
        for n in nodes:
            self.visit(n, at, False, False, measures)
        self.doc = before

    def define(self, node: ast.AST, at: _Scope, in_call: bool, constant: bool) -> None:
        kind = "class" if type(node) is ast.ClassDef else "method" if at.class_name else "function"
        row = None
        body = node.body[1:] if _documented(node.body) else node.body
        digest = norm_hash(body) if self.fragments and kind != "class" and body else None
        if self.with_defs:
            row = _def(node, kind, at.names, at.class_name if kind == "method" else None, digest)
            self.defs.append(row)
        if digest and node.end_lineno - node.lineno >= 3:
            self.found.append(_fragment("function", body, ".".join([*at.names, node.name]), digest))
        if self.whole:
            for child in [*node.decorator_list, *getattr(node, "bases", ()), *(k.value for k in getattr(node, "keywords", ())), *([node.args] if kind != "class" else []), *([node.returns] if getattr(node, "returns", None) else [])]:
                self.visit(child, at, in_call, constant, None)
        measures = None if kind == "class" else [1, 0, 0]
        self.body(node.body, _Scope([*at.names, node.name], node.name if kind == "class" else None, (*at.defining, node.name), at.checking), measures)
        if row is not None and measures and self.whole:
            row["cyclomatic"], row["branches"], row["n_returns"] = measures

    def visit(self, node: ast.AST, at: _Scope, in_call: bool, constant: bool, measures: list[int] | None) -> None:
        kind = type(node)
        if not self.whole and (kind in _BARE or kind in _ASSIGNS and at.names):
            return
        if kind is ast.Name:
            name = node.id
            self.named.add(name)
            if type(node.ctx) is not ast.Load:
                self.stored.add(name)
            elif name not in at.defining:
                self.used.add(name)
            return
        if kind is ast.Constant:
            value = node.value
            if self.with_literals and not isinstance(value, _PLAIN):
                own = "string" if isinstance(value, str) else "bytes" if isinstance(value, bytes) else "int" if isinstance(value, int) else "float"
                self.literals.append({"kind": own, "value": value if own == "string" else repr(value), "line_number": node.lineno, "in_call": in_call, "constant_target": constant, "is_docstring": node is self.doc})
            return
        if kind in _DEF:
            self.define(node, at, in_call, constant)
            return
        if kind is ast.Import or kind is ast.ImportFrom:
            is_from = kind is ast.ImportFrom
            names = [(a.name, a.asname) for a in node.names]
            statement = _import_text(node)
            for module, own in [(node.module or "", names)] if is_from else [(n, [(n, a)]) for n, a in names]:
                self.imports.append({"line_number": node.lineno, "module": module, "names": [n for n, _ in own], "aliases": {n: a for n, a in own if a}, "is_from": is_from, "level": node.level if is_from else 0, "is_future": module == "__future__", "is_type_checking": at.checking, "statement": statement})
            return
        if kind is ast.arg:
            self.stored.add(node.arg)
        elif kind in _SCOPED:
            if node.name:
                self.stored.add(node.name)
        elif measures is not None:
            if kind in _FORKS:
                measures[0] += 1
                measures[1] += kind is ast.If
            elif kind is ast.BoolOp:
                measures[0] += len(node.values) - 1
            elif kind is ast.Try:
                measures[0] += len(node.handlers)
            elif kind is ast.Return:
                measures[2] += 1
            elif kind is ast.Lambda:
                measures = None
        if self.fragments:
            if kind is ast.BinOp or kind is ast.Call:
                self.found.append(_fragment("expression", [node], at.names[-1] if at.names else None))
            elif kind in _BLOCK and len(node.body) >= 2:
                self.found.append(_fragment(kind.__name__.lower(), node.body, at.names[-1] if at.names else None))
        if kind is ast.For and self.with_loops:
            self.loops += [{"pattern": p, "suggestion": s, "confidence": c, "start_line": node.lineno, "end_line": node.end_lineno} for p, s, c in loop_patterns(node)]
        elif kind is ast.Assign or kind is ast.AnnAssign:
            targets = node.targets if kind is ast.Assign else [node.target]
            if not at.names:
                self.assigned += [{"name": t.id, "line_number": node.lineno} for t in targets if type(t) is ast.Name]
            constant = constant or all(type(t) is ast.Name and t.id.isupper() for t in targets)
        elif kind is ast.If and not at.checking and _type_checking(node.test):
            if self.whole:
                self.visit(node.test, at, in_call, constant, measures)
            inner = _Scope(at.names, at.class_name, at.defining, True)
            for child in node.body:
                self.visit(child, inner, in_call, constant, measures)
            for child in node.orelse:
                self.visit(child, at, in_call, constant, measures)
            return
        if not self.whole:
            for name in _NESTED[kind] if kind in _NESTED else _nested(kind):
                for child in getattr(node, name):
                    self.visit(child, at, in_call, constant, measures)
            return
        if kind is ast.JoinedStr:
            for child in node.values:
                if type(child) is ast.FormattedValue:
                    self.visit(child, at, in_call, constant, measures)
            return
        if kind is ast.Call:
            self.visit(node.func, at, in_call, constant, measures)
            for child in (*node.args, *node.keywords):
                self.visit(child, at, True, constant, measures)
            return
        for name in _CHILDREN.get(kind) or _children(kind):
            child = getattr(node, name, None)
            if type(child) is list:
                for c in child:
                    if isinstance(c, ast.AST):
                        self.visit(c, at, in_call, constant, measures)
            elif isinstance(child, ast.AST):
                self.visit(child, at, in_call, constant, measures)


def facts_of(content: str, fragments: bool = True, parts: Iterable[str] | None = None) -> dict:
    """All facts of one file, or those named; fragments and hashes of bodies, which cost the most, only if asked for.

    The measures of functions are a part by themselves, as they need all expressions: `defs` has them only with `measures`.
    `docs` has the structure of the docstring of each of `defs`, null where there is none.
    """
    asked = frozenset(parts) if parts is not None else frozenset((*KINDS, "measures"))
    tree = ast.parse(content)
    own = _Walk(asked, fragments)
    own.body(tree.body, _Scope([], None, (), False), None)
    return {
        "docstring": ast.get_docstring(tree) if "docstring" in asked else None, "defs": own.defs, "imports": own.imports, "literals": own.literals, "fragments": own.found, "loops": own.loops, "assigned": own.assigned,
        "used": sorted(own.used), "named": sorted(own.named), "stored": sorted(own.stored),
        "docs": [None if d["docstring"] is None else parse_docstring(d["docstring"]) for d in own.defs] if "docs" in asked else [],
    }


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the collector's passes over every new tree, which take as long as parsing; trees go by their reference counts.

    What was there before is frozen, so a `gc.collect()` within looks at what is new alone.
    """
    gc.freeze()
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.unfreeze()


def parse(files: DataFrame, fragments: bool = True, parts: Iterable[str] | None = None, keep: tuple[str, ...] = ("path", "module", "is_test")) -> DataFrame:
    """One row per file with its columns `keep` and all its facts, or those in `parts`, fragments if asked for; `error` tells why a file has none."""
    asked = tuple(parts) if parts is not None else (*KINDS, "measures")
    columns = [c for c in KINDS if c in asked]
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "error string", *(f"{c} {KINDS[c]}" for c in columns)])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = {c: None if c == "docstring" else [] for c in columns}
        with uncollected():
            for b in batches:
                for k in range(0, b.num_rows, ROWS):
                    part = b.slice(k, ROWS)
                    rows, errors = [], []
                    for content in part.column(part.schema.get_field_index("content")).to_pylist():
                        try:
                            rows.append(facts_of(content or "", fragments, asked))
                            errors.append(None)
                        except (SyntaxError, ValueError, RecursionError) as e:
                            rows.append(empty)
                            errors.append(f"{type(e).__name__}: {e}")
                    own = [part.column(part.schema.get_field_index(c)).cast(arrow.field(c).type) for c in keep]
                    own += [pa.array(errors, pa.string()), *(pa.array([r[c] for r in rows], arrow.field(c).type) for c in columns)]
                    del rows
                    yield pa.RecordBatch.from_arrays(own, schema=arrow)
                gc.collect()

    return files.select(*dict.fromkeys((*keep, "content"))).mapInArrow(run, schema)


class Facts:
    """The parsed corpus; each property is the table of one kind of fact.

    A table parses the files for its own kind of fact, and leaves expressions out where it can; `of` gives several kinds
    from one parse, so that an analysis of more than one reads and parses the files once. Kept facts (`persist`) are all
    from one parse, fragments and hashes of bodies from another.
    """

    def __init__(self, files: DataFrame):
        self.files, self.kept = files, False
        self.parsed, self.whole = parse(files, fragments=False), parse(files)

    def persist(self) -> Facts:
        self.parsed, self.whole, self.kept = self.parsed.persist(), self.whole.persist(), True
        return self

    def once(self, *parts: str, content: bool = False, fragments: bool = False) -> Facts:
        """These kinds of facts, and contents if asked for, from one parse that is written to the session's checkpoint folder, for an analysis that reads them more than once."""
        out = Facts(self.files)
        kept = cut(self.parsed if self.kept and not content and not fragments else parse(self.files, fragments, parts, ("path", "module", "is_test", *(["content"] if content else []))))
        out.parsed, out.whole, out.kept = kept, kept, True
        return out

    def of(self, *parts: str, keep: tuple[str, ...] = ("path", "module", "is_test")) -> DataFrame:
        """One row per file with `keep`, error and these kinds of facts; measures of definitions with `measures`."""
        if self.kept and all(c in self.parsed.columns for c in (*keep, *(c for c in KINDS if c in parts))):
            return self.parsed.select(*keep, "error", *(c for c in KINDS if c in parts))
        return parse(self.files, False, parts, keep)

    def _table(self, column: str, *more: str, whole: bool = False) -> DataFrame:
        rows = self.whole if whole else self.of(column, *more)
        return rows.select("path", F.col("module").alias("file_module"), "is_test", F.explode(column).alias("_x")).select("path", "file_module", "is_test", "_x.*")

    @property
    def defs(self) -> DataFrame:
        return self._table("defs", "measures")

    @property
    def heads(self) -> DataFrame:
        """Definitions without cyclomatic, branches and n_returns, which need all expressions."""
        return self._table("defs").drop("cyclomatic", "branches", "n_returns")

    @property
    def functions(self) -> DataFrame:
        return self.defs.where("kind <> 'class'")

    @property
    def classes(self) -> DataFrame:
        return self.heads.where("kind = 'class'")

    @property
    def imports(self) -> DataFrame:
        return self._table("imports")

    @property
    def literals(self) -> DataFrame:
        return self._table("literals")

    @property
    def fragments(self) -> DataFrame:
        return self._table("fragments", whole=True)

    @property
    def bodies(self) -> DataFrame:
        """Functions with the hash of their body."""
        return self._table("defs", whole=True).where("kind <> 'class'")

    @property
    def loops(self) -> DataFrame:
        return self._table("loops")

    @property
    def variables(self) -> DataFrame:
        return self._table("assigned")

    @property
    def used(self) -> DataFrame:
        return self.of("used").select("path", F.explode("used").alias("name"))

    @property
    def errors(self) -> DataFrame:
        return self.of().where("error is not null").select("path", "error")
