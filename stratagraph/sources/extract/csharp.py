"""Symbols and relationships of C# files, by a scan over tokens and brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .base import TOP, Extractor, Tokens, edge, error, node

_RULES = [  # no two begin alike but for "op", so that those that most tokens match can be first
    ("skip", r"\s+|\#[^\n]*"), ("word", r"@?[^\W\d]\w*"), ("comment", r"///[^\n]*|//[^\n]*|/\*.*?\*/"),
    ("string", r'\$?@\$?"(?:[^"]|"")*"|\$?"""(?:.*?)"""|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\''), ("number", r"\d[\w.]*"), ("op", r"=>|\?\.|::|&&|\|\||[^\s\w]"),
]
MODIFIERS = set("public private protected internal static abstract sealed partial readonly virtual override async const extern unsafe volatile new required file".split())
_TYPES = {"class": "class", "struct": "struct", "interface": "interface", "record": "record", "enum": "enum"}
#: Words before a parenthesis that call nothing.
_NO_CALL = set("if for foreach while switch catch using lock fixed return typeof sizeof nameof default checked unchecked new await throw when in is as and or not base this".split())


class CSharpExtractor(Extractor):
    language = "csharp"
    extensions = (".cs",)

    def extract(self, path: str, text: str) -> Iterator[dict]:
        t = Tokens(text, _RULES)
        if t.unclosed:
            yield error("Syntax error: brackets don't match")
        yield from self._members(t, 0, len(t), "", [])

    def _members(self, t: Tokens, i: int, end: int, space: str, types: list[str]) -> Iterator[dict]:
        """Declarations among the tokens ``i`` up to ``end``."""
        while i < end:
            start = i
            attributes = []
            while t.is_op(i, "[") and i in t.close:
                attributes.append(t.source(i + 1, t.close[i]))
                i = t.close[i] + 1
            modifiers = []
            while t[i].text in MODIFIERS and i < end:
                modifiers.append(t[i].text)
                i += 1
            if t.is_word(i, "using") and not types:
                j = self._until(t, i, end, ";")
                first = i + 1 + t.is_word(i + 1, "static")
                first = first + 2 if t.is_op(first + 1, "=") else first
                name = t.source(first, j).replace(" ", "")
                if name and "(" not in name:
                    yield node("import", name, t.span(start, j), name)
                    yield edge("imports", TOP, name, t[start].line, t[start].column)
                i = j + 1
            elif t.is_word(i, "namespace"):
                j = i + 1
                while j < end and not (t.is_op(j, "{") or t.is_op(j, ";")):
                    j += 1
                name = t.source(i + 1, j).replace(" ", "")
                full = f"{space}.{name}" if space else name
                last = t.close.get(j, end - 1) if t.is_op(j, "{") else end - 1
                yield node("namespace", name, t.span(start, last), full)
                yield from self._members(t, j + 1, last if t.is_op(j, "{") else end, full, types)
                i = last + 1
            elif t[i].text in _TYPES and t.is_word(i + 1):
                i, found = self._type(t, i, start, end, space, types, modifiers, attributes)
                yield from found
            elif i < end and t[i].kind in ("word", "op") and (types or t.is_word(i, "delegate")):
                i, found = self._member(t, i, start, end, space, types, modifiers, attributes)
                yield from found
            else:
                i = t.close.get(i, i) + 1

    @staticmethod
    def _until(t: Tokens, i: int, end: int, *ops: str) -> int:
        """The next of these operators outside of brackets."""
        while i < end and not (t[i].kind == "op" and t[i].text in ops):
            i = t.close.get(i, i) + 1
        return min(i, end)

    @staticmethod
    def _generic_end(t: Tokens, i: int) -> int:
        """Past the type arguments that begin at ``i``."""
        depth = 0
        while i < len(t):
            depth += t.is_op(i, "<")
            depth -= t.is_op(i, ">")
            i += 1
            if not depth:
                return i
        return i

    def _type(self, t, i, start, end, space, types, modifiers, attributes):
        kind = _TYPES[t[i].text]
        i += 1 + (kind == "record" and t.is_word(i + 1, "struct", "class"))
        name = t[i].text
        outer = [*([space] if space else []), *types]
        qualified = ".".join([*outer, name])
        j, generics, params = i + 1, [], []
        if t.is_op(j, "<"):
            k = self._generic_end(t, j)
            generics = [t.source(*p) for p in t.split(j + 1, k - 1)]
            j = k
        if t.is_op(j, "("):
            params = [t.source(*p) for p in t.split(j + 1, t.close[j])]
            j = t.close[j] + 1
        bases = []
        body = self._until(t, j, end, "{", ";")
        if t.is_op(j, ":"):
            stop = next((k for k in range(j, body) if t.is_word(k, "where")), body)
            bases = [re.sub(r"\s+", "", t.source(*p)) for p in t.split(j + 1, stop)]
        last = t.close.get(body, body) if t.is_op(body, "{") else body
        out = []
        meta = {"modifiers": modifiers, "attributes": attributes, "bases": bases, "type_parameters": generics, "partial": "partial" in modifiers, "primary_constructor_params": params}
        if kind == "enum":
            meta["members"] = [t[a].text for a, _ in t.split(body + 1, last)]
        out.append(node(kind, name, t.span(start, min(last, len(t) - 1)), qualified, None, t.doc(start, "///"), **meta))
        for b in [] if kind == "enum" else bases:
            bare = re.sub(r"\(.*", "", b)
            out.append(edge("implements" if re.match(r"(?:\w+\.)*I", bare) and bare.split(".")[-1].startswith("I") else "inherits", qualified, bare, t[start].line, t[start].column))
        if kind != "enum" and t.is_op(body, "{"):
            out += self._members(t, body + 1, last, space, [*types, name])
        i = last + 1
        return i + t.is_op(i, ";"), out

    def _member(self, t, i, start, end, space, types, modifiers, attributes):
        """A method, constructor, property, field, event or delegate."""
        owner = ".".join([*([space] if space else []), *types])
        j = i
        while j < end and not (t[j].kind == "op" and t[j].text in ("(", "{", ";", "=", "=>")):
            j = self._generic_end(t, j) if t.is_op(j, "<") else t.close.get(j, j) + 1
        if t.is_op(j, "(") and j == i:  # a tuple type
            j = t.close[j] + 1
            while j < end and not (t[j].kind == "op" and t[j].text in ("(", "{", ";", "=", "=>")):
                j += 1
        if j >= end:
            return end, []
        meta = {"modifiers": modifiers, "attributes": attributes}
        name_at = j - 1
        if t.is_op(name_at, ">"):  # a generic method's own parameters
            depth = 0
            while name_at > i:
                depth += t.is_op(name_at, ">")
                depth -= t.is_op(name_at, "<")
                name_at -= 1
                if not depth:
                    break
        if t.is_op(j, "(") and t.is_word(name_at):
            name, close = t[name_at].text, t.close[j]
            body = self._until(t, close + 1, end, "{", ";", "=>")
            last = t.close.get(body, body) if t.is_op(body, "{") else self._until(t, body, end, ";")
            last = min(last, len(t) - 1)
            params = t.source(j + 1, close)
            qualified = f"{owner}.{name}" if owner else name
            if t.is_word(i, "delegate"):
                return last + 1, [node("delegate", name, t.span(start, last), qualified, f"delegate {t.source(i + 1, name_at)} {name}({params})", t.doc(start, "///"), **meta)]
            is_ctor = bool(types) and name == types[-1] and name_at == i
            head = "async " * ("async" in modifiers) + ("" if is_ctor else t.source(i, name_at) + " ")
            parameters = [t.source(*p) for p in t.split(j + 1, close)]
            out = [node("constructor" if is_ctor else "method", name, t.span(start, last), qualified, f"{head}{name}({params})", t.doc(start, "///"), parameters=parameters, return_type=None if is_ctor else t.source(i, name_at), **meta)]
            out += self._calls(t, body, last, f"{types[-1]}.{name}" if types else name)
            return last + 1, out
        if t.is_op(j, "{") or t.is_op(j, "=>"):
            if not t.is_word(name_at) or name_at == i:
                return (t.close.get(j, j) if t.is_op(j, "{") else self._until(t, j, end, ";")) + 1, []
            name = t[name_at].text
            last = t.close.get(j, j) if t.is_op(j, "{") else self._until(t, j, end, ";")
            body = t.source(j, last + 1)
            out = [node("property", name, t.span(start, min(last, len(t) - 1)), f"{owner}.{name}", t.source(i, name_at + 1), t.doc(start, "///"), property_type=t.source(i, name_at), has_getter="get" in body or t.is_op(j, "=>"), has_setter="set" in body, **meta)]
            out += self._calls(t, j, last, f"{types[-1]}.{name}" if types else name)
            if t.is_op(last + 1, "="):
                last = self._until(t, last + 1, end, ";")
            return last + 1, out
        last = self._until(t, j, end, ";")
        out, first, of = [], True, ""
        is_event = t.is_word(i, "event")
        for a, b in t.split(i, last):
            stop = next((k for k in range(a, b) if t.is_op(k, "=")), b)
            if t.is_word(stop - 1) and (not first or stop - 1 > a):
                name = t[stop - 1].text
                of = t.source(i + is_event, stop - 1) if first else of
                out.append(node("event" if is_event else "field", name, t.span(start, min(last, len(t) - 1)), f"{owner}.{name}" if owner else name, None, t.doc(start, "///"), field_type=of, **meta))
                first = False
        out += self._calls(t, j, last, ".".join(types[-1:]) or TOP)
        return last + 1, out

    @staticmethod
    def _calls(t: Tokens, i: int, end: int, caller: str) -> Iterator[dict]:
        for k in range(i, end):
            if not t.is_op(k, "(") or k == 0:
                continue
            a = k - 1
            if t.is_op(a, ">"):
                depth = 0
                while a > i:
                    depth += t.is_op(a, ">")
                    depth -= t.is_op(a, "<")
                    a -= 1
                    if not depth:
                        break
            if not t.is_word(a) or t[a].text in _NO_CALL:
                continue
            while (t.is_op(a - 1, ".") or t.is_op(a - 1, "?.")) and t.is_word(a - 2):
                a -= 2
            if t.is_word(a - 1, "new") or (t.is_word(a - 1) and t[a - 1].text not in _NO_CALL) or t.is_op(a - 1, "."):
                continue
            callee = re.sub(r"\s+", "", t.source(a, k))
            yield edge("calls", caller, callee, t[a].line, t[a].column)
