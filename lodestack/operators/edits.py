"""Source edits: content -> content functions that splice the spans of syntax nodes and leave all else as it is.

An edit is a plain function of a content and its arguments; `edit` applies it to the files of a
corpus and gives one result per file with the new content, a diff and an error. An edit that finds
no target, or whose outcome doesn't parse, is an error row, never an exception.
"""

from __future__ import annotations

import ast
import bisect
import functools
import gc
import io
import itertools
import re
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import ROWS, uncollected
from .transactions import unified_diff

Splice = tuple[int, int, str]
RESULT = ("success", "message", "path", "operation", "error", "diff", "original", "new")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class NoTarget(LookupError):
    """The edit has nothing to change."""


@functools.lru_cache(maxsize=4)
def _read(content: str) -> tuple[ast.Module, list[str], list[int]]:
    """The tree of a content, its lines and their offsets. Several edits of one file share them; no edit changes a tree."""
    lines = list(io.StringIO(content, newline=""))
    return ast.parse(content), lines, [0, *itertools.accumulate(map(len, lines))]


def _bounds(tree: ast.Module, lines: list[str]) -> Iterator[int]:
    """The numbers of lines before statements of a module that begin a line of their own."""
    end = 0
    for b in tree.body:
        marks = getattr(b, "decorator_list", None)
        k = (min(d.lineno for d in marks) if marks else b.lineno) - 1
        alone = lines[k].startswith("@") if marks else not b.col_offset
        if k >= end and alone and not (k and lines[k - 1].rstrip("\r\n").endswith("\\")):
            yield k
        end = b.end_lineno


def check(content: str, new: str) -> None:
    """Raise what `ast.parse` raises if `new` doesn't parse.

    The statements of a module parse one after the other, so where `content` parses only the lines between its unchanged
    first and last statements are parsed; all of `new` is if those don't parse by themselves.
    """
    if not isinstance(new, str):
        ast.parse(new)
        return
    if new == content:
        _read(content)
        return
    try:
        tree, before, _ = _read(content)
    except (SyntaxError, ValueError, RecursionError):
        ast.parse(new)
        return
    after = list(io.StringIO(new, newline=""))
    least = min(len(before), len(after))
    head = next((k for k in range(least) if before[k] != after[k]), least)
    tail = next((k for k in range(least - head) if before[-1 - k] != after[-1 - k]), least - head)
    bounds = list(_bounds(tree, before))
    first = max((k for k in bounds if k <= head), default=0)
    last = min((k for k in bounds if k >= len(before) - tail), default=len(before))
    try:
        ast.parse("".join(after[first : len(after) - (len(before) - last)]))
    except (SyntaxError, ValueError):
        ast.parse(new)


class Source:
    """A content with its tree, and offsets of nodes as characters."""

    def __init__(self, content: str):
        self.text = content
        self.tree, self.lines, self.starts = _read(content)

    def at(self, line: int, column: int) -> int:
        """Offset of a line from 1 and a column in UTF-8 bytes."""
        own = self.lines[line - 1] if line <= len(self.lines) else ""
        return self.starts[line - 1] + len(own.encode()[:column].decode(errors="ignore"))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def tokens(self, line: int = 1) -> Iterator[tuple[int, str, int, int]]:
        """(kind, text, start, end) of each token from the start of a line that begins a statement, as offsets."""
        for t in tokenize.generate_tokens(itertools.chain(itertools.islice(self.lines, line - 1, None), [""]).__next__):
            yield t.type, t.string, *(self.starts[min(row + line - 1, len(self.starts)) - 1] + col for row, col in (t.start, t.end))

    def line_span(self, first: int, last: int) -> tuple[int, int]:
        return self.starts[first - 1], self.starts[min(last, len(self.lines))]

    def indent(self, node: ast.AST) -> str:
        line = self.lines[node.lineno - 1]
        return line[: len(line) - len(line.lstrip())]

    def first_line(self, node: ast.AST) -> int:
        return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])

    def find_class(self, name: str) -> ast.ClassDef:
        for n in ast.walk(self.tree):
            if isinstance(n, ast.ClassDef) and n.name == name:
                return n
        raise NoTarget(f"class {name} not found")

    def find_function(self, name: str, class_name: str | None = None) -> ast.FunctionDef | ast.AsyncFunctionDef:
        for n in (self.find_class(class_name) if class_name else self.tree).body:
            if isinstance(n, _FUNCTIONS) and n.name == name:
                return n
        raise NoTarget(f"function {name} not found")

    def spliced(self, splices: list[Splice]) -> str:
        """All replacements at once; where two begin at one place they stand in the order given."""
        out, end = [], 0
        for a, b, new in sorted(splices, key=lambda s: (s[0], s[1])):
            out += [self.text[end:a], new]
            end = max(end, b)
        return "".join([*out, self.text[end:]])


def _body_indent(s: Source, node: ast.AST) -> str:
    first = node.body[0]
    return s.indent(first) if first.lineno > node.lineno else s.indent(node) + "    "


def _block(text: str, indent: str) -> str:
    return "".join(f"{indent}{line}\n" if line.strip() else "\n" for line in text.strip("\n").split("\n"))


def _after_docstring(node: ast.AST) -> int:
    return 1 if ast.get_docstring(node) is not None else 0


def rename_class(content: str, old: str, new: str) -> str:
    s = Source(content)
    node = s.find_class(old)
    return s.spliced([_name_splice(s, node, new), *_uses(s, s.tree.body, old, new)])


def rename_function(content: str, old: str, new: str, class_name: str | None = None) -> str:
    """A module's function with its uses, where no inner scope has that name of its own; or a method with its uses by self and cls."""
    s = Source(content)
    node = s.find_function(old, class_name)
    splices = [_name_splice(s, node, new)]
    if class_name is None:
        again = [n for n in s.tree.body if isinstance(n, _FUNCTIONS) and n.name == old and n is not node]
        return s.spliced([*splices, *(_name_splice(s, n, new) for n in again), *_uses(s, s.tree.body, old, new)])
    for n in ast.walk(s.find_class(class_name)):
        if isinstance(n, ast.Attribute) and n.attr == old and isinstance(n.value, ast.Name) and n.value.id in ("self", "cls"):
            end = s.span(n)[1]
            splices.append((end - len(old), end, new))
    return s.spliced(splices)


def _binds(body: list[ast.AST], name: str) -> bool:
    """Whether statements bind a name in their own scope."""
    todo, bound = list(body), False
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.Global, ast.Nonlocal)) and name in n.names:
            return False
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            bound |= n.name == name
            todo += n.decorator_list
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            bound |= name in [a.asname or a.name.split(".")[0] for a in n.names]
        elif not isinstance(n, (ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            bound |= isinstance(n, ast.Name) and n.id == name and not isinstance(n.ctx, ast.Load)
            bound |= isinstance(n, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and n.name == name
            todo += ast.iter_child_nodes(n)
    return bound


def _uses(s: Source, body: list[ast.AST], old: str, new: str) -> list[Splice]:
    """Renamings of a name in these statements and in the scopes within them that don't bind it themselves."""
    out: list[Splice] = []

    def walk(n: ast.AST, hidden: bool, around: bool) -> None:
        """hidden: in this scope the name means something else; around: so it does for functions within this scope."""
        if isinstance(n, ast.Name):
            if n.id == old and not hidden:
                out.append((*s.span(n), new))
        elif isinstance(n, (ast.Global, ast.Nonlocal)) and old in n.names and not hidden:
            a, z = s.span(n)
            out.extend((a + m.start(), a + m.end(), new) for m in re.finditer(rf"\b{re.escape(old)}\b", s.text[a:z]))
        elif isinstance(n, (*_FUNCTIONS, ast.Lambda)):
            own = {id(x) for x in _arguments(n.args)}
            outer = [*getattr(n, "decorator_list", []), *n.args.defaults, *filter(None, n.args.kw_defaults), *(x.annotation for x in _arguments(n.args) if x.annotation), *filter(None, [getattr(n, "returns", None)])]
            for x in outer:
                walk(x, hidden, around)
            inner = n.body if isinstance(n.body, list) else [n.body]
            bound = around or bool(own and old in [x.arg for x in _arguments(n.args)]) or _binds(inner, old)
            for x in inner:
                walk(x, bound, bound)
        elif isinstance(n, ast.ClassDef):
            for x in [*n.decorator_list, *n.bases, *(k.value for k in n.keywords)]:
                walk(x, hidden, around)
            bound = hidden or _binds(n.body, old)
            for x in n.body:
                walk(x, bound, around)
        elif isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            walk(n.generators[0].iter, hidden, around)
            bound = around or any(_binds([g.target], old) for g in n.generators)
            for x in ast.iter_child_nodes(n):
                for y in ([x] if not isinstance(x, ast.comprehension) else [x.target, *x.ifs, *([] if x is n.generators[0] else [x.iter])]):
                    walk(y, bound, bound)
        else:
            for x in ast.iter_child_nodes(n):
                walk(x, hidden, around)

    for n in body:
        walk(n, False, False)
    return out


def _name_splice(s: Source, node: ast.AST, new: str) -> Splice:
    start = s.at(node.lineno, node.col_offset)
    m = re.compile(r"(?:async\s+def|def|class)\s+(\w+)").match(s.text, start)
    return m.start(1), m.end(1), new


def _renamed(s: Source, within: ast.AST, old: str, new: str) -> str:
    splices = [(*s.span(n), new) for n in ast.walk(within) if isinstance(n, ast.Name) and n.id == old]
    if not splices:
        raise NoTarget(f"{old} not found")
    return s.spliced(splices)


def replace_identifier(content: str, class_name: str, method: str, old: str, new: str) -> str:
    s = Source(content)
    return _renamed(s, s.find_function(method, class_name), old, new)


def add_decorator(content: str, name: str, decorator: str, class_name: str | None = None, kind: str = "function") -> str:
    s = Source(content)
    node = s.find_class(name) if kind == "class" else s.find_function(name, class_name)
    decorator = decorator.lstrip("@")
    if decorator in [ast.unparse(d) for d in node.decorator_list]:
        raise NoTarget(f"{name} has {decorator} already")
    at = s.starts[s.first_line(node) - 1]
    return s.spliced([(at, at, f"{s.indent(node)}@{decorator}\n")])


def remove_decorator(content: str, name: str, decorator: str, class_name: str | None = None, kind: str = "function") -> str:
    s = Source(content)
    node = s.find_class(name) if kind == "class" else s.find_function(name, class_name)
    gone = [d for d in node.decorator_list if ast.unparse(d).split("(")[0] == decorator.lstrip("@").split("(")[0]]
    if not gone:
        raise NoTarget(f"{name} has no decorator {decorator}")
    return s.spliced([(*s.line_span(d.lineno, d.end_lineno), "") for d in gone])


def static_to_class_method(content: str, class_name: str, method: str) -> str:
    s = Source(content)
    node = s.find_function(method, class_name)
    for d in node.decorator_list:
        if ast.unparse(d) == "staticmethod":
            return add_parameter(s.spliced([(*s.span(d), "classmethod")]), method, "cls", class_name=class_name, position="start")
    raise NoTarget(f"{method} is no static method")


def _signature(s: Source, node: ast.AST) -> tuple[int, int]:
    """The span between the parentheses of a definition's parameters, or of a class's bases."""
    return _slots(s, node)[0]


def _slots(s: Source, node: ast.AST) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """The span between the parentheses after a definition's name, and those of the entries that commas part there, `*` and `/` too."""
    name_end, depth, brackets, first, slots = _name_splice(s, node, "")[1], 0, 0, None, []
    start = end = None
    for kind, text, a, z in s.tokens(node.lineno):
        if a < name_end or kind in (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT):
            continue
        if first is None:  # type parameters may come before
            brackets += (text == "[") - (text == "]")
            if text == "(" and not brackets:
                first = z
            continue
        if not depth and text in (",", ")"):
            if start is not None:
                slots.append((start, end))
            if text == ")":
                return (first, a), slots
            start = None
            continue
        depth += (text in ("(", "[", "{")) - (text in (")", "]", "}"))
        start, end = a if start is None else start, z
    raise NoTarget("no parentheses")


class Signature:
    """The parameters of a function as spans of its source; changes are splices of the parameter concerned alone."""

    def __init__(self, content: str, name: str, class_name: str | None = None):
        self.source = Source(content)
        self.node = self.source.find_function(name, class_name)
        self.inside, self.slots = _slots(self.source, self.node)
        args = self.node.args
        plain = [*args.posonlyargs, *args.args]
        defaults: list = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
        values = dict(zip([a.arg for a in [*plain, *args.kwonlyargs]], [*defaults, *args.kw_defaults], strict=True))
        nodes = {a.arg: a for a in _arguments(args)}
        self.entries: list[tuple[str, ast.arg | None, ast.expr | None]] = []  # of each slot: name or mark, argument, default
        for a, z in self.slots:
            text = self.source.text[a:z]
            name_ = re.match(r"\**\s*(\w*)", text)[1] or text
            self.entries.append((name_, nodes.get(name_), values.get(name_)))
        self.last_plain = next((k for k, (a, _) in enumerate(self.slots) if self.source.text[a] == "*"), len(self.slots))
        """The slot before which positional parameters end."""

    def find(self, param: str) -> int:
        for k, (name, arg, _) in enumerate(self.entries):
            if name == param and arg is not None:
                return k
        raise NoTarget(f"{self.node.name} has no parameter {param}")

    def insertion(self, k: int, text: str) -> Splice:
        """A new parameter before slot k."""
        if k < len(self.slots):
            return self.slots[k][0], self.slots[k][0], f"{text}, "
        at = self.slots[-1][1] if self.slots else self.inside[0]
        return at, at, f", {text}" if self.slots else text

    def removal(self, k: int) -> Splice:
        a, z = self.slots[k]
        if k + 1 < len(self.slots):
            return a, self.slots[k + 1][0], ""
        return self.slots[k - 1][1] if k else a, z, ""

    def annotation(self, k: int, text: str | None) -> Splice:
        arg = self.entries[k][1]
        at = self.source.at(arg.lineno, arg.col_offset) + len(arg.arg)
        end = self.source.at(arg.end_lineno, arg.end_col_offset)
        return at, end, f": {text}" if text else ""


def _arguments(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]


def add_parameter(content: str, name: str, param: str, annotation: str | None = None, default: str | None = None, class_name: str | None = None, position: str = "end") -> str:
    """A new positional parameter: last, before defaults unless it has one itself; or first, after self and cls.

    A first parameter with a default has to be followed by defaults only.
    """
    own = Signature(content, name, class_name)
    if param in [n for n, arg, _ in own.entries if arg is not None]:
        raise NoTarget(f"{name} has a parameter {param} already")
    text = param + (f": {annotation}" if annotation else "") + ("" if default is None else f" = {default}" if annotation else f"={default}")
    if position == "start":
        at = 1 if own.entries and own.entries[0][0] in ("self", "cls") else 0
        if default is not None and any(arg is not None and value is None for _, arg, value in own.entries[at : own.last_plain]):
            raise NoTarget(f"a default can't come before the required parameters of {name}")
    elif default is None:
        at = next((k for k in range(own.last_plain) if own.entries[k][2] is not None), own.last_plain)
    else:
        at = own.last_plain
    return own.source.spliced([own.insertion(at, text)])


def remove_parameter(content: str, name: str, param: str, class_name: str | None = None) -> str:
    own = Signature(content, name, class_name)
    k = own.find(param)
    texts = [own.source.text[a:z] for a, z in own.slots]
    if k and texts[k - 1] == "*" and (k + 1 == len(texts) or texts[k + 1].startswith("**")):  # a bare * needs a parameter
        a = own.slots[k - 1][0] if k + 1 < len(texts) or k == 1 else own.slots[k - 2][1]
        return own.source.spliced([(a, own.removal(k)[1], "")])
    if texts[k].startswith("*") and not texts[k].startswith("**") and k + 1 < len(texts) and not texts[k + 1].startswith("**"):
        return own.source.spliced([(*own.slots[k], "*")])  # what follows stays keyword-only
    if k + 1 < len(texts) and texts[k + 1] == "/" and k == 0:
        a, z, _ = own.removal(0)
        return own.source.spliced([(a, own.removal(1)[1], "")])
    return own.source.spliced([own.removal(k)])


def reorder_parameters(content: str, name: str, order: list[str], class_name: str | None = None) -> str:
    """Named parameters in `order` first, then the rest; self and cls stay in front, required ones before defaults."""
    own = Signature(content, name, class_name)
    plain = [k for k in range(own.last_plain) if own.entries[k][1] is not None and own.entries[k][1] in own.node.args.args]
    rank = {n: k for k, n in enumerate(order)}
    rows = sorted(plain, key=lambda k: (own.entries[k][0] not in ("self", "cls"), rank.get(own.entries[k][0], len(order))))
    if any(own.entries[a][2] is not None and own.entries[b][2] is None for a, b in zip(rows, rows[1:])):
        raise NoTarget("a required parameter would follow one with a default")
    return own.source.spliced([(*own.slots[to], own.source.text[slice(*own.slots[k])]) for to, k in zip(plain, rows, strict=True)])


def rename_parameter(content: str, name: str, old: str, new: str, class_name: str | None = None) -> str:
    """A parameter and its uses in the function's body, where no inner scope has that name of its own."""
    own = Signature(content, name, class_name)
    arg = own.entries[own.find(old)][1]
    start = own.source.at(arg.lineno, arg.col_offset)
    return own.source.spliced([(start, start + len(old), new), *_uses(own.source, own.node.body, old, new)])


def set_parameter_type(content: str, name: str, param: str, annotation: str, class_name: str | None = None) -> str:
    own = Signature(content, name, class_name)
    return own.source.spliced([own.annotation(own.find(param), annotation)])


def set_return_type(content: str, name: str, annotation: str | None, class_name: str | None = None) -> str:
    s = Source(content)
    node = s.find_function(name, class_name)
    close = _signature(s, node)[1] + 1
    colon = s.text.index(":", s.span(node.returns)[1] if node.returns else close)
    return s.spliced([(close, colon, f" -> {annotation}" if annotation else "")])


def remove_type_hints(content: str, name: str, class_name: str | None = None) -> str:
    own = Signature(content, name, class_name)
    bare = own.source.spliced([own.annotation(k, None) for k, (_, arg, _) in enumerate(own.entries) if arg is not None])
    return set_return_type(bare, name, None, class_name)


# Types that a parameter's name suggests, by the name's end or, for those with an underscore, its beginning.
NAME_TYPES = {
    "int": ["count", "size", "length", "index", "num", "number", "total", "id", "idx", "age", "year", "month", "day", "hour", "minute", "second"],
    "float": ["price", "amount", "rate", "ratio", "percent", "percentage", "score", "weight", "height", "width"],
    "str": ["name", "title", "description", "text", "message", "label", "key", "value", "url", "uri", "email", "username", "password", "content"],
    "str | Path": ["path"],
    "bytes": ["data"],
    "bool": ["enabled", "disabled", "active", "valid", "is_", "has_", "can_", "should_"],
    "list": ["items", "values", "results", "elements", "entries", "records", "rows"],
    "dict": ["mapping", "config", "settings", "options", "params", "kwargs"],
    "tuple": ["args"],
    "Callable": ["callback", "handler", "func", "function"],
}


def infer_type(name: str, default: str | None = None) -> str | None:
    """A type from the default value, else from the name; None if neither tells."""
    if default is not None:
        try:
            value = ast.parse(default, mode="eval").body
        except SyntaxError:
            return None
        if isinstance(value, ast.Constant) and value.value is not None:
            return type(value.value).__name__
        for kind, node in (("list", (ast.List, ast.ListComp)), ("dict", (ast.Dict, ast.DictComp)), ("set", (ast.Set, ast.SetComp)), ("tuple", (ast.Tuple,))):
            if isinstance(value, node):
                return kind
        if isinstance(value, ast.Call) and isinstance(value.func, ast.Name):
            return value.func.id
        if isinstance(value, ast.Compare | ast.UnaryOp) and not (isinstance(value, ast.UnaryOp) and not isinstance(value.op, ast.Not)):
            return "bool"
    own = name.lower()
    for test in (own.__eq__, lambda part: own.startswith(part) if part.endswith("_") else own.endswith("_" + part)):
        for kind, parts in NAME_TYPES.items():
            if any(test(part) for part in parts):
                return kind
    return None


def infer_type_hints(content: str, name: str, class_name: str | None = None, overwrite: bool = False) -> str:
    own, splices = Signature(content, name, class_name), []
    for k, (param, arg, value) in enumerate(own.entries):
        if arg is None or param in ("self", "cls") or own.source.text[own.slots[k][0]] == "*":
            continue
        kind = infer_type(param, ast.unparse(value) if value is not None else None)
        if kind and (overwrite or arg.annotation is None):
            splices.append(own.annotation(k, kind))
    if not splices:
        raise NoTarget(f"no type to infer in {name}")
    return own.source.spliced(splices)


def modernize_hints(content: str) -> str:
    """Optional and Union as `|`, List, Dict and the like as builtins, in annotations."""
    s = Source(content)
    plain = {"List": "list", "Dict": "dict", "Set": "set", "FrozenSet": "frozenset", "Tuple": "tuple", "Type": "type"}

    def new(n: ast.expr) -> str:
        if isinstance(n, ast.Subscript):
            head = ast.unparse(n.value).removeprefix("typing.")
            parts = n.slice.elts if isinstance(n.slice, ast.Tuple) else [n.slice]
            if head == "Optional":
                return f"{new(n.slice)} | None"
            if head == "Union":
                return " | ".join(map(new, parts))
            return f"{plain.get(head, ast.unparse(n.value))}[{', '.join(map(new, parts))}]"
        if isinstance(n, ast.List):
            return f"[{', '.join(map(new, n.elts))}]"
        text = ast.unparse(n)
        return plain.get(text.removeprefix("typing."), text)

    notes = [n for x in ast.walk(s.tree) for n in (getattr(x, "annotation", None), getattr(x, "returns", None)) if isinstance(n, ast.expr)]
    splices = [(*s.span(n), new(n)) for n in notes if new(n) != ast.unparse(n)]
    if not splices:
        raise NoTarget("no old annotation")
    return s.spliced(splices)


def convert_to_async(content: str, name: str, class_name: str | None = None) -> str:
    s = Source(content)
    node = s.find_function(name, class_name)
    if isinstance(node, ast.AsyncFunctionDef):
        raise NoTarget(f"{name} is async already")
    at = s.at(node.lineno, node.col_offset)
    return s.spliced([(at, at, "async ")])


def convert_to_sync(content: str, name: str, class_name: str | None = None) -> str:
    s = Source(content)
    node = s.find_function(name, class_name)
    if not isinstance(node, ast.AsyncFunctionDef):
        raise NoTarget(f"{name} isn't async")
    at = s.at(node.lineno, node.col_offset)
    gone = re.compile(r"async\s+").match(s.text, at).end()
    awaits = [(s.span(n)[0], s.span(n.value)[0], "") for n in ast.walk(node) if isinstance(n, ast.Await)]
    blocks = [(s.at(n.lineno, n.col_offset), re.compile(r"async\s+").match(s.text, s.at(n.lineno, n.col_offset)).end(), "") for n in ast.walk(node) if isinstance(n, (ast.AsyncFor, ast.AsyncWith))]
    return s.spliced([(at, gone, ""), *awaits, *blocks])


def insert_statement(content: str, name: str, statement: str, class_name: str | None = None, position: str = "start") -> str:
    """A statement at the start (after a docstring) or the end of a function's body."""
    s = Source(content)
    node = s.find_function(name, class_name)
    text = _block(statement, _body_indent(s, node))
    if node.body[0].lineno == node.lineno:
        return s.spliced([(s.at(node.body[0].lineno, node.body[0].col_offset), s.span(node)[1], "\n" + (text if position == "start" else "") + _block(ast.unparse(ast.Module(node.body, [])), s.indent(node) + "    ").rstrip("\n") + ("\n" + text.rstrip("\n") if position == "end" else ""))])
    k = _after_docstring(node)
    at = s.starts[s.first_line(node.body[k]) - 1] if position == "start" and k < len(node.body) else s.starts[node.end_lineno]
    gap = "" if at == 0 or s.text[at - 1] == "\n" else "\n"
    return s.spliced([(at, at, gap + text)])


def add_logging(content: str, name: str, class_name: str | None = None, level: str = "debug", logger: str = "logger", with_args: bool = False) -> str:
    args = [a.arg for a in _arguments(Source(content).find_function(name, class_name).args) if a.arg not in ("self", "cls")]
    shown = "".join(f", {a}=%r" for a in args) if with_args else ""
    values = "".join(f", {a}" for a in args) if with_args else ""
    return insert_statement(content, name, f'{logger}.{level}("{name} called{shown}"{values})', class_name)


def _later_lines(s: Source, at: int, text: str) -> range:
    """The lines, from 1, that begin within a token."""
    first = bisect.bisect_right(s.starts, at)
    return range(first + 1, bisect.bisect_right(s.starts, at + len(text)) + 1)


def wrap_with_try(content: str, name: str, exceptions: list[str], handler: str, class_name: str | None = None) -> str:
    s = Source(content)
    node = s.find_function(name, class_name)
    k = _after_docstring(node)
    if k >= len(node.body):
        raise NoTarget(f"{name} has no body")
    indent = _body_indent(s, node)
    first, last = s.first_line(node.body[k]), node.end_lineno
    inside = {n for kind, text, a, _ in s.tokens() if "\n" in text and kind not in (tokenize.NL, tokenize.NEWLINE) for n in _later_lines(s, a, text)}
    body = "".join(f"    {line}" if line.strip() and n not in inside else line for n, line in enumerate(s.lines[first - 1 : last], first))
    caught = exceptions[0] if len(exceptions) == 1 else f"({', '.join(exceptions)})"
    tail = "" if body.endswith("\n") else "\n"
    return s.spliced([(*s.line_span(first, last), f"{indent}try:\n{body}{tail}{indent}except {caught} as e:\n{_block(handler, indent + '    ')}")])


def add_class_attribute(content: str, class_name: str, name: str, annotation: str, default: str | None = "None") -> str:
    s = Source(content)
    node = s.find_class(class_name)
    if name in [ast.unparse(t) for b in node.body for t in (b.targets if isinstance(b, ast.Assign) else [b.target] if isinstance(b, ast.AnnAssign) else [])]:
        raise NoTarget(f"{class_name} has {name} already")
    k = _after_docstring(node)
    at = s.starts[s.first_line(node.body[k]) - 1] if k < len(node.body) else s.starts[node.end_lineno]
    return s.spliced([(at, at, f"{_body_indent(s, node)}{name}: {annotation}{f' = {default}' if default is not None else ''}\n")])


def _without(s: Source, body: list[ast.stmt], name: str, where: str) -> str:
    for b in body:
        targets = b.targets if isinstance(b, ast.Assign) else [b.target] if isinstance(b, ast.AnnAssign) else []
        if name in [ast.unparse(t) for t in targets]:
            filler = f"{s.indent(b)}pass\n" if len(body) == 1 and where != "module" else ""
            return s.spliced([(*s.line_span(b.lineno, b.end_lineno), filler)])
    raise NoTarget(f"{where} has no {name}")


def remove_class_attribute(content: str, class_name: str, name: str) -> str:
    s = Source(content)
    return _without(s, s.find_class(class_name).body, name, class_name)


def remove_assignment(content: str, name: str) -> str:
    s = Source(content)
    return _without(s, s.tree.body, name, "module")


def add_base_class(content: str, class_name: str, base: str) -> str:
    s = Source(content)
    node = s.find_class(class_name)
    bases = [ast.unparse(b) for b in node.bases]
    if base in bases:
        raise NoTarget(f"{class_name} derives from {base} already")
    return _with_bases(s, node, [*bases, base])


def remove_base_class(content: str, class_name: str, base: str) -> str:
    s = Source(content)
    node = s.find_class(class_name)
    bases = [ast.unparse(b) for b in node.bases]
    if base not in bases:
        raise NoTarget(f"{class_name} doesn't derive from {base}")
    return _with_bases(s, node, [b for b in bases if b != base])


def _with_bases(s: Source, node: ast.ClassDef, bases: list[str]) -> str:
    every = bases + [f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in node.keywords]
    start = _name_splice(s, node, "")[1]
    end = _signature(s, node)[1] + 1 if node.bases or node.keywords or re.match(r"\s*\(", s.text[start:]) else start
    return s.spliced([(start, end, f"({', '.join(every)})" if every else "")])


def remove_object_bases(content: str) -> str:
    """`class A(object)` as `class A`, all over a file."""
    names = [n.name for n in ast.walk(Source(content).tree) if isinstance(n, ast.ClassDef) and [ast.unparse(b) for b in n.bases] == ["object"]]
    if not names:
        raise NoTarget("no class derives from object alone")
    for n in names:
        content = remove_base_class(content, n, "object")
    return content


def _fields(node: ast.ClassDef) -> list[tuple[str, str, str | None]]:
    return [(b.target.id, ast.unparse(b.annotation), ast.unparse(b.value) if b.value else None) for b in node.body if isinstance(b, ast.AnnAssign) and isinstance(b.target, ast.Name)]


def add_dunder(content: str, class_name: str, kind: str) -> str:
    """__init__, __repr__, __eq__ or __hash__ from the class's annotated attributes."""
    s = Source(content)
    node = s.find_class(class_name)
    name, fields = f"__{kind}__", _fields(node)
    if any(isinstance(b, _FUNCTIONS) and b.name == name for b in node.body):
        raise NoTarget(f"{class_name} has {name} already")
    every = "".join(f"{f}, " for f, _, _ in fields)
    own = [f"self.{f}" for f, _, _ in fields]
    order = [x for x in fields if x[2] is None] + [x for x in fields if x[2] is not None]
    texts = {
        "init": f"def __init__(self{''.join(f', {f}: {t}' + (f' = {d}' if d is not None else '') for f, t, d in order)}) -> None:\n" + ("\n".join(f"    self.{f} = {f}" for f, _, _ in fields) or "    pass"),
        "repr": f"def __repr__(self) -> str:\n    return f\"{class_name}({', '.join(f'{f}={{self.{f}!r}}' for f, _, _ in fields)})\"",
        "eq": f"def __eq__(self, other: object) -> bool:\n    if not isinstance(other, {class_name}):\n        return NotImplemented\n    return ({', '.join(own)}{',' if len(own) == 1 else ''}) == ({', '.join(x.replace('self', 'other') for x in own)}{',' if len(own) == 1 else ''})",
        "hash": f"def __hash__(self) -> int:\n    return hash(({every.rstrip()}))".replace(every.rstrip(), "".join(f"{x}, " for x in own).rstrip()) if own else "def __hash__(self) -> int:\n    return hash(())",
    }
    if kind not in texts:
        raise NoTarget(f"unknown method {kind}")
    at = s.starts[node.end_lineno] if node.end_lineno < len(s.starts) else len(s.text)
    gap = "" if not at or s.text[at - 1] == "\n" else "\n"
    return s.spliced([(at, at, f"{gap}\n{_block(texts[kind], _body_indent(s, node))}")])


def convert_to_dataclass(content: str, class_name: str) -> str:
    """An __init__ that only stores its parameters becomes annotated fields under @dataclass."""
    s = Source(content)
    node = s.find_class(class_name)
    init = next((b for b in node.body if isinstance(b, _FUNCTIONS) and b.name == "__init__"), None)
    splices: list[Splice] = []
    if init is not None:
        args = init.args.args[1:]
        pad: list = [None] * (len(args) - len(init.args.defaults)) + list(init.args.defaults)
        stores = {ast.unparse(b.targets[0]) for b in init.body if isinstance(b, ast.Assign)}
        if any(f"self.{a.arg}" not in stores for a in args) or len(init.body) != len(args):
            raise NoTarget("__init__ does more than store its parameters")
        lines = [f"{a.arg}: {ast.unparse(a.annotation) if a.annotation else 'object'}" + (f" = {ast.unparse(d)}" if d is not None else "") for a, d in zip(args, pad, strict=True)]
        splices.append((*s.line_span(s.first_line(init), init.end_lineno), _block("\n".join(lines) or "pass", _body_indent(s, node))))
    at = s.starts[s.first_line(node) - 1]
    splices.append((at, at, f"{s.indent(node)}@dataclass\n"))
    done = s.spliced(splices)
    return done if re.search(r"^from dataclasses import .*\bdataclass\b", done, re.M) else add_import(done, "from dataclasses import dataclass")


def add_import(content: str, statement: str) -> str:
    """An import after the docstring and the future imports, unless it is there."""
    s = Source(content)
    if statement in [ast.unparse(b) for b in s.tree.body]:
        raise NoTarget("it is imported already")
    line = 0
    for k, b in enumerate(s.tree.body):
        doc = k == 0 and isinstance(b, ast.Expr) and isinstance(b.value, ast.Constant) and isinstance(b.value.value, str)
        if doc or isinstance(b, ast.ImportFrom) and b.module == "__future__":
            line = b.end_lineno
    at = s.starts[line]
    return s.spliced([(at, at, ("" if not at or s.text[at - 1] == "\n" else "\n") + f"{statement}\n")])


def remove_import(content: str, statement: str) -> str:
    s = Source(content)
    for b in ast.walk(s.tree):
        if isinstance(b, (ast.Import, ast.ImportFrom)) and ast.unparse(b) == statement:
            return s.spliced([(*s.line_span(b.lineno, b.end_lineno), "")])
    raise NoTarget("it isn't imported")


def rename_import(content: str, old: str, new: str) -> str:
    """A module's name in import statements, submodules too."""
    s, splices = Source(content), []
    for n in ast.walk(s.tree):
        if isinstance(n, ast.ImportFrom) and n.module and n.level == 0 and (n.module == old or n.module.startswith(old + ".")):
            at = s.text.index(n.module, s.span(n)[0])
            splices.append((at, at + len(old), new))
        elif isinstance(n, ast.Import):
            splices += [(s.span(a)[0], s.span(a)[0] + len(old), new) for a in n.names if a.name == old or a.name.startswith(old + ".")]
    if not splices:
        raise NoTarget(f"{old} isn't imported")
    return s.spliced(splices)


def format_to_fstring(content: str) -> str:
    """`"..{}..".format(a)` with plain names and positions as f-strings; others stay."""
    s, splices = Source(content), []
    for n in ast.walk(s.tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "format" and isinstance(n.func.value, ast.Constant) and isinstance(n.func.value.value, str) and not any(isinstance(a, ast.Starred) for a in n.args):
            named, at = {k.arg: ast.unparse(k.value) for k in n.keywords}, iter(range(len(n.args)))

            def put(m: re.Match, n=n, named=named, at=at) -> str:
                key = m[1] or str(next(at, "x"))
                text = named.get(key) or (ast.unparse(n.args[int(key)]) if key.isdigit() and int(key) < len(n.args) else None)
                if text is None or any(c in text for c in "\"'\\{}"):
                    raise NoTarget("not plain")
                return "{" + text + (m[2] or "") + "}"

            literal = s.text[slice(*s.span(n.func.value))]
            if literal[0] in "'\"" and "{{" not in literal and "}}" not in literal:
                try:
                    splices.append((*s.span(n), "f" + re.sub(r"\{(\w*)((?:![rsa])?(?::[^{}]*)?)\}", put, literal)))
                except NoTarget:
                    continue
    if not splices:
        raise NoTarget("no format call")
    return s.spliced(splices)


def set_docstring(content: str, name: str, text: str, class_name: str | None = None, kind: str = "function") -> str:
    s = Source(content)
    node = s.find_class(name) if kind == "class" else s.find_function(name, class_name)
    doc = _block(f'"""{text}"""', _body_indent(s, node))
    if _after_docstring(node):
        return s.spliced([(*s.line_span(node.body[0].lineno, node.body[0].end_lineno), doc)])
    at = s.starts[s.first_line(node.body[0]) - 1]
    return s.spliced([(at, at, doc)])


def set_header(content: str, header: str) -> str:
    """A comment block at the head of a file, after a `#!` line and a coding line, in place of one that mentions copyright or a licence."""
    lines = content.split("\n")
    top = 1 if lines[0].startswith("#!") else 0
    if top < min(2, len(lines)) and re.match(r"#.*?coding[:=]", lines[top]):
        top += 1
    k = top
    while k < len(lines) and lines[k].startswith("#"):
        k += 1
    rest = lines[k:] if re.search(r"(?i)copyright|licen[cs]e", "\n".join(lines[top:k])) else lines[top:]
    return "\n".join([*lines[:top], *(f"# {x}".rstrip() for x in header.split("\n")), *rest])


def set_exports(content: str, names: list[str] | None = None) -> str:
    """`__all__` with the given names, or all public top-level definitions."""
    s = Source(content)
    found = names if names is not None else sorted(b.name for b in s.tree.body if isinstance(b, (*_FUNCTIONS, ast.ClassDef)) and not b.name.startswith("_"))
    text = "__all__ = [\n" + "".join(f'    "{n}",\n' for n in found) + "]\n"
    for b in s.tree.body:
        if isinstance(b, ast.Assign) and [ast.unparse(t) for t in b.targets] == ["__all__"]:
            return s.spliced([(*s.line_span(b.lineno, b.end_lineno), text)])
    at = next((s.starts[b.end_lineno] for b in reversed(s.tree.body) if isinstance(b, (ast.Import, ast.ImportFrom))), 0)
    return s.spliced([(at, at, ("\n" if at else "") + text)])


def generate_stub(content: str) -> str:
    """The `.pyi` text of a file: signatures, annotated names and bases."""
    tree = ast.parse(content)

    def stub(body: list[ast.stmt]) -> list[ast.stmt]:
        out = []
        for b in body:
            if isinstance(b, _FUNCTIONS):
                out.append(type(b)(b.name, b.args, [ast.Expr(ast.Constant(...))], b.decorator_list, b.returns, None, b.type_params))
            elif isinstance(b, ast.ClassDef):
                out.append(ast.ClassDef(b.name, b.bases, b.keywords, stub(b.body) or [ast.Expr(ast.Constant(...))], b.decorator_list, b.type_params))
            elif isinstance(b, (ast.Import, ast.ImportFrom)):
                out.append(b)
            elif isinstance(b, ast.AnnAssign):
                out.append(ast.AnnAssign(b.target, b.annotation, None, b.simple))
        return out

    return ast.unparse(ast.fix_missing_locations(ast.Module(stub(tree.body), []))) + "\n"


def split_module(content: str) -> dict[str, str]:
    """One file per top-level class or function, with the module's imports, and an `__init__.py` that exports all."""
    s = Source(content)
    head = "".join(s.text[slice(*s.line_span(b.lineno, b.end_lineno))] for b in s.tree.body if isinstance(b, (ast.Import, ast.ImportFrom)))
    own = [b for b in s.tree.body if isinstance(b, (*_FUNCTIONS, ast.ClassDef))]
    snake = lambda n: re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", n).lower()
    out = {f"{snake(b.name)}.py": head + ("\n\n" if head else "") + s.text[slice(*s.line_span(s.first_line(b), b.end_lineno))] for b in own}
    names = [b.name for b in own]
    return out | {"__init__.py": "".join(f"from .{snake(n)} import {n}\n" for n in names) + f"\n__all__ = {names!r}\n"}


def _results(files: DataFrame, every: Callable[..., Iterator[tuple]], columns: tuple[str, ...]) -> DataFrame:
    """The results of `every`, which gives (operation, whether it is done, error, new) for each change of a file's content and what else `files` has."""
    arrow = pa.schema([(c, pa.bool_() if c == "success" else pa.string()) for c in columns])
    own = [c for c in files.columns if c not in ("path", "content")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with uncollected():
            for b in batches:
                for k in range(0, b.num_rows, ROWS):
                    part = b.slice(k, ROWS).to_pydict()
                    out: dict[str, list] = {c: [] for c in columns}
                    for n, (path, content, *more) in enumerate(zip(part["path"], part["content"], *(part[c] for c in own), strict=True)):
                        if n % 100 == 99:
                            gc.collect()  # closures and errors keep trees in cycles
                        for title, good, error, new in every(content or "", *more):
                            row = {"success": good, "message": f"{title} {'done' if good else 'failed'}", "path": path, "operation": title, "error": error, "original": content, "new": new if good else None}
                            if "diff" in out:
                                row["diff"] = unified_diff(content, new, path) if good else None
                            for c, values in out.items():
                                values.append(row[c])
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
                    del part, out
                gc.collect()

    return files.mapInArrow(run, ", ".join(f"{c} {'boolean' if c == 'success' else 'string'}" for c in columns))


def edit_all(files: DataFrame, changes: dict[str, tuple[Callable[..., str], tuple, dict]], columns: tuple[str, ...] = RESULT) -> DataFrame:
    """results of several edits, each of the files as they are, by operation: (change, args, named). One pass, in which a file is parsed once for all of them.

    Any function content -> content serves, as a user's own transformer too. Of the columns, diff costs the most.
    """

    def every(content: str) -> Iterator[tuple]:
        for title, (change, args, named) in changes.items():
            new, error = None, None
            try:
                new = change(content, *args, **named)
                check(content, new)
            except Exception as e:  # whatever a file or a user's function does, the other files go on
                new, error = None, f"{type(e).__name__}: {e}"
            yield title, error is None, error, new

    return _results(files.select("path", "content"), every, columns)


def edit(files: DataFrame, change: Callable[..., str], *args, operation: str | None = None, **named) -> DataFrame:
    """results(success, message, path, operation, error, diff, original, new) of an edit on each file."""
    return edit_all(files, {operation or change.__name__: (change, args, named)})


def edit_log(results: DataFrame, seq: int = 0) -> DataFrame:
    """The successful results as edits for a transaction."""
    return results.where("success").select("path", F.lit(seq).alias("seq"), "original", "new", "operation")


def edit_all_targets(files: DataFrame, targets: DataFrame, changes: dict[str, tuple[Callable[..., str], tuple, dict]], columns: tuple[str, ...] = RESULT) -> DataFrame:
    """results of several changes of definitions, each of the files as they are: a row per change and file with targets (path, full_name), all applied in order of their names.

    A change takes a content, a name and a class's name, as edits of functions and methods do; a target
    that fails is in the file's error, and the others of the file still apply.
    """
    own = targets.select("path", "full_name").distinct().groupBy("path").agg(F.array_sort(F.collect_list("full_name")).alias("names"))

    def every(content: str, names: list[str]) -> Iterator[tuple]:
        for title, (change, args, named) in changes.items():
            new, errors = content, []
            for full in names:
                owner, _, name = full.rpartition(".")
                try:
                    after = change(new, name, *args, class_name=owner or None, **named)
                    check(new, after)
                    new = after
                except Exception as e:  # noqa: PERF203
                    errors.append(f"{full}: {type(e).__name__}: {e}")
            yield title, len(errors) < len(names), "; ".join(errors) or None, new

    return _results(files.select("path", "content").join(own, "path"), every, columns)


def edit_targets(files: DataFrame, targets: DataFrame, change: Callable[..., str], *args, operation: str | None = None, **named) -> DataFrame:
    """results of one change of definitions, one row per file with targets."""
    return edit_all_targets(files, targets, {operation or change.__name__: (change, args, named)})


def rename_matching(content: str, name: str, pattern: str, replacement: str, class_name: str | None = None) -> str:
    """A definition under the name that replacing a pattern in its own gives."""
    new = re.sub(pattern, replacement, name)
    if new == name:
        raise NoTarget(f"{pattern} doesn't match {name}")
    return rename_function(content, name, new, class_name)


def replace_in(content: str, name: str, pattern: str, replacement: str, class_name: str | None = None) -> str:
    """A pattern replaced in a definition's text."""
    s = Source(content)
    node = s.find_function(name, class_name)
    a, z = s.line_span(s.first_line(node), node.end_lineno)
    new = re.sub(pattern, replacement, s.text[a:z])
    if new == s.text[a:z]:
        raise NoTarget(f"{pattern} doesn't match in {name}")
    return s.spliced([(a, z, new)])
