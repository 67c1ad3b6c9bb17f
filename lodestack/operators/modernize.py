"""Old APIs and forms: deprecated names as findings and edits, compatibility imports, type comments, imports in order, code at a matched statement."""

from __future__ import annotations

import ast
import re
import sys
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .edits import _FUNCTIONS, NoTarget, Source, Splice, _block, _body_indent

# Names that moved or were renamed, and what stands for them now.
ABSTRACT = "Awaitable Coroutine AsyncIterable AsyncIterator AsyncGenerator Hashable Iterable Iterator Generator Reversible Container Collection Callable Set MutableSet Mapping MutableMapping MappingView KeysView ItemsView ValuesView Sequence MutableSequence ByteString".split()
MOVED = {f"collections.{n}": f"collections.abc.{n}" for n in ABSTRACT} | {f"typing.{n}": n.lower() for n in ("List", "Dict", "Set", "FrozenSet", "Tuple", "Type")}
MOVED |= {"imp": "importlib", "optparse": "argparse", "cgi.escape": "html.escape", "pipes.quote": "shlex.quote", "platform.linux_distribution": "distro.linux_distribution"}
METHODS = {
    "assertEquals": "assertEqual", "assertNotEquals": "assertNotEqual", "assertAlmostEquals": "assertAlmostEqual", "assertNotAlmostEquals": "assertNotAlmostEqual", "assertRegexpMatches": "assertRegex", "assertNotRegexpMatches": "assertNotRegex",
    "assertRaisesRegexp": "assertRaisesRegex", "assertItemsEqual": "assertCountEqual", "failUnlessEqual": "assertEqual", "failIfEqual": "assertNotEqual", "failUnless": "assertTrue", "failIf": "assertFalse", "failUnlessRaises": "assertRaises",
    "failUnlessAlmostEqual": "assertAlmostEqual", "failIfAlmostEqual": "assertNotAlmostEqual", "asyncio.get_event_loop": "asyncio.get_running_loop", "logger.warn": "logger.warning", "logging.warn": "logging.warning",
}
SIX = {"text_type": "str", "binary_type": "bytes", "integer_types": "int", "string_types": "str", "PY2": "False", "PY3": "True"}
SIX_MOVES = {"range": "range", "map": "map", "filter": "filter", "zip": "zip", "input": "input", "intern": "sys.intern", "reduce": "functools.reduce", "reload_module": "importlib.reload"}


def dotted(node: ast.AST) -> str | None:
    """`a.b.c` of an attribute chain on a name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


def _old(node: ast.AST) -> tuple[str, str, str] | None:
    """(old, new, category) of a node that names something deprecated."""
    name = dotted(node) if isinstance(node, (ast.Attribute, ast.Name)) else None
    if name is None:
        return None
    if name in MOVED and "." in name:
        return name, MOVED[name], "import"
    for old, new in METHODS.items():
        if name == old or name.endswith("." + old):
            return old, new, "method"
    return None


def deprecated_of(content: str) -> list[tuple[int, str, str, str]]:
    """(line, old, new, category) of each deprecated use and import, in order."""
    out = []
    for n in ast.walk(Source(content).tree):
        if found := _old(n):
            out.append((n.lineno, *found))
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            out += [(n.lineno, k, MOVED[k], "import") for k in (f"{n.module}.{a.name}" for a in n.names) if k in MOVED]
            out += [(n.lineno, n.module, MOVED[n.module], "import")] if n.module in MOVED else []
        elif isinstance(n, ast.Import):
            out += [(n.lineno, a.name, MOVED[a.name], "import") for a in n.names if a.name in MOVED]
    return sorted(out)


def deprecated(files: DataFrame) -> DataFrame:
    """(path, line_number, old, new, category) over a corpus; files that don't parse have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, *x) for x in deprecated_of(content or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "line_number", "old", "new", "category"])

    return files.select("path", "content").mapInPandas(run, "path string, line_number int, old string, new string, category string")


def replace_deprecated(content: str) -> str:
    """Deprecated attributes and methods by what stands for them now."""
    s, splices = Source(content), []
    for n in ast.walk(s.tree):
        found = _old(n)
        if found and isinstance(n, ast.Attribute):
            end = s.span(n)[1]
            old, new, _ = found
            if s.text[end - len(old) : end] == old:
                splices.append((end - len(old), end, new))
    if not splices:
        raise NoTarget("nothing deprecated")
    return s.spliced(splices)


def remove_six(content: str) -> str:
    """Names of `six` as plain ones, its metaclass decorator as a keyword, its import dropped."""
    s, splices, left = Source(content), [], False
    for n in ast.walk(s.tree):
        name = dotted(n) if isinstance(n, ast.Attribute) else None
        if name and name.startswith("six.moves.") and name[10:] in SIX_MOVES:
            splices.append((*s.span(n), SIX_MOVES[name[10:]]))
        elif name and name.startswith("six.") and name[4:] in SIX:
            splices.append((*s.span(n), SIX[name[4:]]))
        elif isinstance(n, ast.ClassDef):
            for d in n.decorator_list:
                if isinstance(d, ast.Call) and dotted(d.func) == "six.add_metaclass" and len(d.args) == 1:
                    splices.append((*s.line_span(d.lineno, d.end_lineno), ""))
                    at = re.compile(r"class\s+\w+").match(s.text, s.at(n.lineno, n.col_offset)).end()
                    bases = [ast.unparse(b) for b in n.bases if ast.unparse(b) != "object"]
                    close = s.text.index(")", s.span(n.bases[-1])[1]) + 1 if n.bases else at
                    splices.append((at, close, f"({', '.join([*bases, f'metaclass={ast.unparse(d.args[0])}'])})"))
    if not splices:
        raise NoTarget("no use of six")
    done = s.spliced(splices)
    left = any(isinstance(n, ast.Name) and n.id == "six" for n in ast.walk(ast.parse(done)))
    return done if left else re.sub(r"(?m)^import six\n", "", done)


def type_comments(content: str) -> str:
    """`x = v  # type: T` as `x: T = v`, and a function's `# type: (A, B) -> R` as annotations."""
    s, notes = Source(content), {}
    for kind, text, a, z in s.tokens():
        if kind == tokenize.COMMENT and (m := re.match(r"#\s*type:\s*(?!\s|ignore\b)(.*\S)", text)):
            notes[s.text.count("\n", 0, a) + 1] = (m[1], a, z)
    splices: list[Splice] = []

    def drop(line: int) -> tuple[int, int]:
        _, a, z = notes[line]
        while a and s.text[a - 1] in " \t":
            a -= 1
        return (a, z) if a and s.text[a - 1] != "\n" else s.line_span(line, line)

    for n in ast.walk(s.tree):
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], (ast.Name, ast.Attribute)) and n.end_lineno in notes and not notes[n.end_lineno][0].startswith("("):
            end = s.span(n.targets[0])[1]
            splices += [(end, end, f": {notes[n.end_lineno][0]}"), (*drop(n.end_lineno), "")]
        elif isinstance(n, _FUNCTIONS):
            line = next((k for k in range(n.lineno, n.body[0].lineno + 1) if k in notes and notes[k][0].startswith("(")), None)
            if line is None:
                continue
            m = re.match(r"\((.*)\)\s*->\s*(.+)$", notes[line][0])
            kinds = ast.parse(f"f({m[1]})", mode="eval").body.args if m and m[1] != "..." else []
            args = [a for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs] if a.arg not in ("self", "cls")]
            if not m or n.returns or kinds and len(kinds) != len(args):
                continue
            for a, kind in zip(args, kinds, strict=False):
                end = s.at(a.lineno, a.col_offset) + len(a.arg)
                splices.append((end, end, f": {ast.unparse(kind)}"))
            from .edits import _signature

            close = _signature(s, n)[1] + 1
            splices += [(close, close, f" -> {m[2]}"), (*drop(line), "")]
    if not splices:
        raise NoTarget("no type comment")
    return s.spliced(splices)


def insert_at_match(content: str, pattern: str, code: str, position: str = "before", class_name: str | None = None, method: str | None = None) -> str:
    """Code before, after or in place of the first statement of a body that a pattern matches, in the whole file, a class or a method."""
    s = Source(content)
    top: ast.AST = s.find_function(method, class_name) if method else s.find_class(class_name) if class_name else s.tree

    def innermost(node: ast.AST) -> ast.stmt | None:
        """The first match in a node's bodies; a statement counts after those within it."""
        for part in ("body", "handlers", "orelse", "finalbody", "cases"):
            own = getattr(node, part, None)
            for b in own if isinstance(own, list) else []:
                if found := innermost(b):
                    return found
                if isinstance(b, ast.stmt) and re.search(pattern, s.text[slice(*s.span(b))]):
                    return b
        return None

    if b := innermost(top):
        a, z = s.line_span(s.first_line(b), b.end_lineno)
        text = _block(code, s.indent(b))
        if position == "replace":
            return s.spliced([(a, z, text)])
        if position == "before":
            return s.spliced([(a, a, text)])
        return s.spliced([(z, z, ("" if s.text[z - 1 : z] == "\n" else "\n") + text)])
    raise NoTarget(f"nothing matches {pattern}")


def delete_definition(content: str, name: str, class_name: str | None = None, kind: str = "function") -> str:
    """A function, method or class with its decorators and one blank line before it; a body that would be empty gets `pass`."""
    s = Source(content)
    node = s.find_class(name) if kind == "class" else s.find_function(name, class_name)
    owner = next(n for n in ast.walk(s.tree) if node in getattr(n, "body", []) or node in getattr(n, "orelse", []))
    a, z = s.line_span(s.first_line(node), node.end_lineno)
    filler = f"{s.indent(node)}pass\n" if owner is not s.tree and len(owner.body) == 1 else ""
    if not filler and s.first_line(node) > 1 and not s.lines[s.first_line(node) - 2].strip():
        a = s.starts[s.first_line(node) - 2]
    return s.spliced([(a, z, filler)])


def attribute_to_property(content: str, class_name: str, name: str, annotation: str | None = None, setter: bool = True) -> str:
    """`self.x` stored as `self._x`, with a property of that name; in __init__ the parameter is left as it is."""
    s = Source(content)
    node = s.find_class(class_name)
    if any(isinstance(b, _FUNCTIONS) and b.name == name for b in node.body):
        raise NoTarget(f"{class_name} has {name} already")
    init = next((b for b in node.body if isinstance(b, _FUNCTIONS) and b.name == "__init__"), None)
    stores = [n for n in ast.walk(init or ast.Module([], [])) if isinstance(n, ast.Attribute) and n.attr == name and isinstance(n.ctx, ast.Store) and dotted(n) == f"self.{name}"]
    if not stores:
        raise NoTarget(f"__init__ of {class_name} doesn't store {name}")
    splices: list[Splice] = []
    for n in stores:
        end = s.span(n)[1]
        splices.append((end - len(name), end, f"_{name}"))
    text = f"@property\ndef {name}(self){f' -> {annotation}' if annotation else ''}:\n    return self._{name}"
    text += f"\n\n@{name}.setter\ndef {name}(self, value{f': {annotation}' if annotation else ''}) -> None:\n    self._{name} = value" if setter else ""
    at = s.starts[node.end_lineno] if node.end_lineno < len(s.starts) else len(s.text)
    gap = "" if s.text[at - 1 : at] == "\n" else "\n"
    return s.spliced([*splices, (at, at, gap + "\n" + _block(text, _body_indent(s, node)))])


def organize_imports(content: str, first_party: tuple[str, ...] = ()) -> str:
    """The imports at a file's head in groups, future, standard, third-party and first-party, each sorted: plain ones first, then by module and names.

    Imports elsewhere, as under TYPE_CHECKING, stay where they are, and so do comments on lines of their own.
    """
    s = Source(content)
    own = [b for b in s.tree.body if isinstance(b, (ast.Import, ast.ImportFrom))]
    if not own:
        raise NoTarget("no imports")
    groups: dict[str, list[tuple]] = {"future": [], "stdlib": [], "thirdparty": [], "firstparty": []}
    for b in own:
        plain = isinstance(b, ast.Import)
        module = b.names[0].name if plain else b.module or ""
        top = module.split(".")[0]
        level = 0 if plain else b.level
        group = "future" if module == "__future__" else "firstparty" if level or top in first_party else "stdlib" if top in sys.stdlib_module_names else "thirdparty"
        groups[group].append((not plain, "." * level + module.lower(), sorted(a.name.lower() for a in b.names), ast.unparse(b)))
    text = "\n".join("".join(f"{line}\n" for *_, line in sorted(rows)) for rows in groups.values() if rows)
    spans = [s.line_span(b.lineno, b.end_lineno) for b in own]
    splices: list[Splice] = [(a, z, "") for a, z in spans]
    first = spans[0][0]
    for (_, z), (a, _) in zip(spans, spans[1:]):
        if not s.text[z:a].strip():  # blank lines between imports go
            splices.append((z, a, ""))
    done = s.spliced([(first, first, text), *splices])
    if done == content:
        raise NoTarget("imports are in order already")
    return done
