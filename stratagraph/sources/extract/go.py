"""Symbols and relationships of Go files, by a scan over tokens and brackets."""

from __future__ import annotations

from collections.abc import Iterator

from .base import TOP, Extractor, Tokens, edge, error, node

_RULES = [  # no two begin alike but for "op", so that those that most tokens match can be first
    ("skip", r"[^\S\n]+"), ("word", r"[^\W\d]\w*"), ("line", r"\n"), ("comment", r"//[^\n]*|/\*.*?\*/"), ("string", r"`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'"),
    ("number", r"\d[\w.]*"), ("op", r":=|\.\.\.|<-|[^\s\w]"),
]
_NO_CALL = set("if for switch select func return go defer range case chan map struct interface type var const".split())


def _exported(name: str) -> bool:
    return name[:1].isupper()


class GoExtractor(Extractor):
    language = "go"
    extensions = (".go",)

    def extract(self, path: str, text: str) -> Iterator[dict]:
        t = Tokens(text, _RULES)
        if t.unclosed:
            yield error("Syntax error: brackets don't match")
        package, imports, i = "", {}, 0
        while i < len(t):
            if t.is_word(i, "package") and t.is_word(i + 1):
                package = t[i + 1].text
                yield node("package", package, t.span(i, i + 1), package)
                i += 2
            elif t.is_word(i, "import", "const", "var", "type"):
                i, found = self._group(t, i, package, imports)
                yield from found
            elif t.is_word(i, "func"):
                i, found = self._function(t, i, package, imports)
                yield from found
            else:
                i = t.close.get(i, i) + 1

    def _group(self, t: Tokens, i: int, package: str, imports: dict):
        """The specs of a declaration, one or many in parentheses."""
        word, start, out = t[i].text, i, []
        if t.is_op(i + 1, "("):
            last = t.close[i + 1]
            specs, a = [], i + 2
            while a < last:
                b = self._spec_end(t, a, last)
                if b > a:
                    specs.append((a, b))
                a = b + 1
            i = last + 1
        else:
            b = self._spec_end(t, i + 1, len(t))
            specs, i = [(i + 1, b)], b
        for a, b in specs:
            out += {"import": self._import, "type": self._type}.get(word, self._values)(t, a, b, start if len(specs) == 1 else a, package, word, imports)
        return i, out

    @staticmethod
    def _spec_end(t: Tokens, i: int, end: int) -> int:
        while i < end and t[i].kind != "line" and not t.is_op(i, ";"):
            i = t.close.get(i, i) + 1
        return i

    def _import(self, t, a, b, start, package, word, imports) -> list[dict]:
        path_at = next((k for k in range(a, b) if t[k].kind == "string"), None)
        if path_at is None:
            return []
        path = t[path_at].text[1:-1]
        alias = t[a].text if path_at > a else None
        name = alias or path.split("/")[-1]
        if name not in ("_", "."):
            imports[name] = path
        return [node("import", name, t.span(a, path_at), path, None, None, alias=alias), edge("imports", TOP, path, t[a].line, t[a].column)]

    def _type(self, t, a, b, start, package, word, imports) -> list[dict]:
        if not t.is_word(a):
            return []
        name, k = t[a].text, a + 1
        if t.is_op(k, "[") and t.is_word(k + 1):  # type parameters
            k = t.close[k] + 1
        k += t.is_op(k, "=")
        meta = {"exported": _exported(name)}
        kind, doc = "type", t.doc(start, "//|/\\*") or self._doc(t, start)
        if t.is_word(k, "struct") and t.is_op(k + 1, "{"):
            kind, fields = "struct", []
            for x, y in self._lines(t, k + 2, t.close[k + 1]):
                tag = t[y - 1].text.strip("`") if t[y - 1].kind == "string" else None
                y -= tag is not None
                names = [x]
                while t.is_op(names[-1] + 1, ",") and t.is_word(names[-1] + 2):
                    names.append(names[-1] + 2)
                if y - x == 1 or not t.is_word(x) or t.is_op(x + 1, "."):
                    fields.append({"name": t.source(x, y).lstrip("*").split(".")[-1], "type": t.source(x, y), "embedded": True, "tag": tag})
                else:
                    fields += [{"name": t[n].text, "type": t.source(names[-1] + 1, y), "embedded": False, "tag": tag} for n in names]
            meta["fields"] = fields
        elif t.is_word(k, "interface") and t.is_op(k + 1, "{"):
            kind, methods, embeds = "interface", [], []
            for x, y in self._lines(t, k + 2, t.close[k + 1]):
                (methods if t.is_word(x) and t.is_op(x + 1, "(") else embeds).append(t.source(x, y))
            meta |= {"methods": methods, "embeds": embeds}
        else:
            meta["underlying_type"] = t.source(k, b)
        return [node(kind, name, t.span(start, b - 1), f"{package}.{name}" if package else name, None, doc, **meta)]

    @staticmethod
    def _lines(t: Tokens, i: int, end: int) -> list[tuple[int, int]]:
        out = []
        while i < end:
            j = GoExtractor._spec_end(t, i, end)
            if j > i:
                out.append((i, j))
            i = j + 1
        return out

    def _values(self, t, a, b, start, package, word, imports) -> list[dict]:
        names, k = [], a
        while t.is_word(k) and k < b:
            names.append(k)
            if not t.is_op(k + 1, ","):
                break
            k += 2
        kind = "constant" if word == "const" else "variable"
        return [node(kind, t[n].text, t.span(a, b - 1), f"{package}.{t[n].text}" if package else t[n].text, None, self._doc(t, start), exported=_exported(t[n].text)) for n in names]

    @staticmethod
    def _doc(t: Tokens, i: int) -> str | None:
        """The comment lines right above a declaration."""
        found, k = [], i
        while True:
            own = t.comments.get(k, [])
            found = own + found
            if t[k - 1].kind != "line" or k < 1 or (own and own[0] is not found[0]):
                break
            k -= 1
            if not t.comments.get(k):
                break
        lines = [c.text.removeprefix("//").removeprefix("/*").removesuffix("*/").strip() for c in found]
        return "\n".join(lines).strip() or None

    def _function(self, t: Tokens, i: int, package: str, imports: dict):
        start, k, receiver = i, i + 1, None
        if t.is_op(k, "("):
            inner = [x for x in range(k + 1, t.close[k]) if t[x].kind == "word"]
            pointer = any(t.is_op(x, "*") for x in range(k + 1, t.close[k]))
            generic = any(t.is_op(x, "[") for x in range(k + 1, t.close[k]))
            if inner:
                own = inner[1] if generic and len(inner) > 1 else inner[-1]
                receiver = {"name": t[inner[0]].text if len(inner) > 1 else None, "type": t[own].text, "pointer": pointer}
            k = t.close[k] + 1
        if not t.is_word(k):
            return self._skip_body(t, k), []
        name, k = t[k].text, k + 1
        if t.is_op(k, "["):
            k = t.close[k] + 1
        if not t.is_op(k, "("):
            return k, []
        params = [t.source(*p) for p in t.split(k + 1, t.close[k])]
        after = t.close[k] + 1
        body = after
        while body < len(t) and not t.is_op(body, "{") and t[body].kind != "line":
            body = (t.close[body + 1] + 1) if t.is_word(body, "interface", "struct") and t.is_op(body + 1, "{") else t.close.get(body, body) + 1
        returns = t.source(after, body)
        last = t.close[body] if t.is_op(body, "{") else body - 1
        owner = receiver["type"] if receiver else None
        qualified = ".".join(x for x in (package, owner, name) if x)
        head = f"({t.source(start + 2, t.close[start + 1])}) " if receiver else ""
        signature = f"func {head}{name}({', '.join(params)}){' ' + returns if returns else ''}"
        out = [node("method" if receiver else "function", name, t.span(start, last), qualified, signature, self._doc(t, start), receiver=receiver, parameters=params, returns=returns, exported=_exported(name))]
        if t.is_op(body, "{"):
            out += self._calls(t, body + 1, last, f"{owner}.{name}" if owner else name, imports)
        return last + 1, out

    @staticmethod
    def _skip_body(t: Tokens, k: int) -> int:
        while k < len(t) and not t.is_op(k, "{") and t[k].kind != "line":
            k = t.close.get(k, k) + 1
        return t.close.get(k, k) + 1

    @staticmethod
    def _calls(t: Tokens, i: int, end: int, caller: str, imports: dict) -> Iterator[dict]:
        for k in range(i, end):
            a = k - 1
            if not t.is_op(k, "(") or not t.is_word(a) or t[a].text in _NO_CALL:
                continue
            while t.is_op(a - 1, ".") and t.is_word(a - 2):
                a -= 2
            if t.is_op(a - 1, "."):
                continue
            full = t.source(a, k).replace(" ", "").replace("\n", "")
            head, _, rest = full.partition(".")
            if rest and head in imports:
                yield edge("calls", caller, rest, t[a].line, t[a].column, imports[head])
            else:
                yield edge("calls", caller, full, t[a].line, t[a].column)
