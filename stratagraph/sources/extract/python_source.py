"""Symbols and relationships of Python files, by the standard library's parser.

Where a file doesn't parse, the lines at fault are blanked, with what hangs
below them, until it does: the rest is extracted and an error is reported.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

from .base import TOP, Extractor, edge, error, node

#: Folders at which the way up from a file to its package ends.
ROOTS = ("", "/", "src", "lib", "packages")


#: Lines at fault that are blanked with a parse of the whole file each, before it is taken in parts.
WHOLE_TRIES = 16


def tolerant(text: str) -> tuple[ast.Module, str | None]:
    """The tree of as much of a text as parses, and what was wrong with it.

    A file with many faults is taken in parts, one from each line that begins
    at the margin to the next, so that a fault costs a parse of its part only.
    """
    lines, problem = text.split("\n"), None
    for tries in range(len(lines) + 1):
        if tries == WHOLE_TRIES:
            margins = [k for k, x in enumerate(lines) if x[:1].strip() and x[0] not in ")]}#@" and not re.match(r"(?:el|except|finally)", x)]
            for a, b in zip([0, *margins], [*margins, len(lines)]):
                _blank(lines, a, b)
        try:
            return ast.parse("\n".join(lines)), problem
        except (SyntaxError, ValueError) as e:
            problem = problem or f"Syntax error: {getattr(e, 'msg', e)} (line {getattr(e, 'lineno', 0)})"
            if not _blank_at(lines, e, 0, len(lines)):
                break
    return ast.parse(""), problem


def _blank(lines: list[str], start: int, end: int) -> None:
    """Blank lines at fault from ``start`` up to ``end`` until they parse by themselves."""
    for _ in range(end - start):
        try:
            ast.parse("\n".join(lines[start:end]))
            return
        except (SyntaxError, ValueError) as e:
            if not _blank_at(lines, e, start, end):
                return


def _blank_at(lines: list[str], e: Exception, start: int, end: int) -> bool:
    """Blank the line that an error names, or the filled one before it; whether there was one."""
    at = min(max(start + (getattr(e, "lineno", None) or 1) - 1, start), end - 1)
    filled = next((k for k in range(at, start - 1, -1) if lines[k].strip()), None)
    if filled is None:
        filled = next((k for k in range(start, end) if lines[k].strip()), None)
    if filled is None:
        return False
    lines[filled] = ""
    return True


def absolute_module(path: str, dots: int, module: str | None) -> str:
    """The dotted name that a relative import means in a file at ``path``."""
    parts = path.strip("/").split("/")[:-1]
    above = parts[: len(parts) - (dots - 1)] if dots > 1 else parts
    package: list[str] = []
    for part in reversed(above):
        if part in ROOTS:
            break
        package.insert(0, part)
    return ".".join([*package, *([module] if module else [])])


def _dotted(e: ast.expr) -> str | None:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        parts = []
        while isinstance(e, ast.Attribute):
            parts.append(e.attr)
            e = e.value
        return ".".join([e.id, *reversed(parts)]) if isinstance(e, ast.Name) else None
    return None


class Source:
    """A file's text by the lines and byte columns that the parser counts in."""

    def __init__(self, text: str):
        self.lines = [x.encode() for x in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)]

    def between(self, line: int, column: int, end_line: int, end_column: int) -> str:
        if line == end_line:
            return self.lines[line - 1][column:end_column].decode()
        inner = self.lines[line : end_line - 1]
        return b"".join([self.lines[line - 1][column:], *inner, self.lines[end_line - 1][:end_column]]).decode()

    def of(self, e: ast.expr) -> str:
        return self.between(e.lineno, e.col_offset, e.end_lineno, e.end_col_offset)

    def parameters(self, f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        """A function's parameters as they are written, brackets included."""
        first = f.body[0]
        decorators = getattr(first, "decorator_list", None)
        first = decorators[0] if decorators else first
        head = self.between(f.lineno, f.col_offset, first.lineno, first.col_offset)
        head_lines, depth, start = head.splitlines(keepends=True), 0, None
        for t in tokenize.generate_tokens(io.StringIO(head).readline):
            if t.type != tokenize.OP:
                continue
            if t.string == "(" and depth == 0:
                start = t.start
            depth += (t.string in "([{") - (t.string in ")]}")
            if t.string == ")" and depth == 0 and start is not None:
                (a, i), (b, j) = start, t.end
                return head_lines[a - 1][i:j] if a == b else "".join([head_lines[a - 1][i:], *head_lines[a : b - 1], head_lines[b - 1][:j]])
        return f"({ast.unparse(f.args)})"


class PythonExtractor(Extractor):
    language = "python"
    extensions = (".py", ".pyi")

    def extract(self, path: str, text: str) -> Iterator[dict]:
        tree, problem = tolerant(text)
        if problem:
            yield error(problem)
        names: dict[str, tuple[str, str | None]] = {}  # local name: module, symbol
        self.source = Source(text)
        yield from self._symbols(path, tree.body, [], names, in_class=False, top=True)
        yield from self._calls(tree, names)

    # --- symbols ---

    def _symbols(self, path, body, scope, names, in_class, top) -> Iterator[dict]:
        for s in body:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                yield self._function(s, scope, in_class)
            elif isinstance(s, ast.ClassDef):
                qualified = ".".join([*scope, s.name])
                bases = [b for b in map(_dotted, s.bases) if b]
                yield node("class", s.name, _span(s), qualified, None, ast.get_docstring(s), bases=bases, decorators=_decorators(self.source, s))
                for b in bases:
                    module, target = self._via(b, names)
                    yield edge("inherits", qualified, target, s.lineno, s.col_offset, module)
                yield from self._symbols(path, s.body, [*scope, s.name], names, in_class=True, top=False)
            elif isinstance(s, ast.Import):
                for a in s.names:
                    names[a.asname or a.name.split(".")[0] if not a.asname else a.asname] = (a.name, None) if a.asname else (a.name.split(".")[0], None)
                    if not a.asname:
                        names[a.name] = (a.name, None)
                    yield node("import", a.asname or a.name, _span(s), a.name)
                    yield edge("imports", TOP, a.name, s.lineno, s.col_offset)
            elif isinstance(s, ast.ImportFrom):
                module = absolute_module(path, s.level, s.module) if s.level else s.module or ""
                for a in s.names:
                    qualified = f"{module}.{a.name}" if module else a.name
                    if a.name != "*":
                        names[a.asname or a.name] = (module, a.name)
                    yield node("import", a.asname or a.name, _span(s), qualified, None, None, module=module, relative=bool(s.level))
                    yield edge("imports", TOP, qualified, s.lineno, s.col_offset, None, module=module, name=a.name)
            elif top and isinstance(s, ast.Assign | ast.AnnAssign):
                for target in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    for x in target.elts if isinstance(target, ast.Tuple | ast.List) else [target]:
                        if isinstance(x, ast.Name):
                            yield node("variable", x.id, _span(s), x.id)
            else:
                for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                    for inner in getattr(s, field, []) or []:
                        below = inner.body if isinstance(inner, ast.ExceptHandler | ast.match_case) else [inner]
                        yield from self._symbols(path, below, scope, names, in_class, top=False)

    def _function(self, s, scope, in_class) -> dict:
        is_async = isinstance(s, ast.AsyncFunctionDef)
        returns = f" -> {self.source.of(s.returns)}" if s.returns else ""
        signature = f"{'async ' * is_async}def {s.name}{self.source.parameters(s)}{returns}"
        return node("method" if in_class else "function", s.name, _span(s), ".".join([*scope, s.name]), signature, ast.get_docstring(s), decorators=_decorators(self.source, s), **{"async": is_async})

    # --- calls ---

    def _calls(self, tree, names) -> Iterator[dict]:
        todo = [(tree, "")]  # without recursion, for expressions nested deeply
        while todo:
            at, scope = todo.pop()
            inner = scope
            if isinstance(at, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inner = f"{scope}.{at.name}" if scope else at.name
            elif isinstance(at, ast.Call):
                found = self._callee(at.func, names)
                if found:
                    target, module, same = found
                    yield edge("calls", scope or TOP, target, at.lineno, at.col_offset, module, same_class_call=same)
            below = []
            for field in at._fields:
                value = getattr(at, field, None)
                own = scope if field == "decorator_list" else inner  # decorators are called where the definition stands
                if isinstance(value, list):
                    below += [(child, own) for child in value if isinstance(child, ast.AST)]
                elif isinstance(value, ast.AST) and not isinstance(value, ast.expr_context):
                    below.append((value, own))
            todo += reversed(below)

    def _callee(self, f: ast.expr, names) -> tuple[str, str | None, bool] | None:
        dotted = _dotted(f)
        if dotted is None:
            return None
        head, _, rest = dotted.partition(".")
        if rest and head in ("self", "cls"):
            return rest, None, True
        module, target = self._via(dotted, names)
        return target, module, False

    def _via(self, dotted: str, names) -> tuple[str | None, str]:
        """The module that an imported name comes from, and the name there."""
        head, _, rest = dotted.partition(".")
        if head not in names:
            return None, dotted
        module, symbol = names[head]
        if not rest:
            return (module, symbol) if symbol else (None, dotted)
        if symbol:
            return (f"{module}.{symbol}" if module else symbol), rest
        # of "import a.b" the longest module whose name the call begins with
        longest = max((n for n, (m, s) in names.items() if s is None and n == m and dotted.startswith(n + ".")), key=len, default=head)
        return names[longest][0], rest


def _decorators(source: Source, s) -> list[str]:
    return [source.of(d) for d in s.decorator_list]


def _span(s) -> tuple[int, int, int, int]:
    return s.lineno, s.col_offset, s.end_lineno or s.lineno, s.end_col_offset or 0
