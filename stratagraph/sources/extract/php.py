"""Symbols and relationships of PHP files, WordPress hooks included, by a scan over tokens and brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .base import TOP, Extractor, Tokens, edge, error, node

_RULES = [
    ("skip", r"\A.*?<\?(?:php|=)?|\?>.*?(?:<\?(?:php|=)?|\Z)|\s+|\#\[[^\]]*\]"), ("word", r"\\?[^\W\d][\w]*(?:\\\w+)*"), ("comment", r"/\*.*?\*/|//[^\n]*|\#[^\n]*"),
    ("string", r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|<<<['\"]?(\w+)['\"]?\n.*?\n\s*\b(?:\w+)\b;?"), ("var", r"\$\w+"), ("number", r"\d[\w.]*"), ("op", r"=>|\?->|->|::|\.\.\.|[^\s\w]"),
]
_MODIFIERS = set("public private protected static abstract final readonly var".split())
_NO_CALL = set("if elseif for foreach while switch catch function fn array list isset unset empty echo print return include require include_once require_once exit die match new and or xor clone use declare".split())
#: WordPress functions that tie callbacks to hooks, or fire hooks (fixed values).
REGISTERS = {"add_action": "registers_action", "add_filter": "registers_filter"}
TRIGGERS = {"do_action": "triggers_action", "do_action_ref_array": "triggers_action", "apply_filters": "triggers_filter", "apply_filters_ref_array": "triggers_filter"}


class PhpExtractor(Extractor):
    language = "php"
    extensions = (".php", ".inc")

    def extract(self, path: str, text: str) -> Iterator[dict]:
        t = Tokens(text, _RULES)
        if t.unclosed:
            yield error("Syntax error: brackets don't match")
        yield from self._body(t, 0, len(t), "", {}, None)

    def _body(self, t: Tokens, i: int, end: int, space: str, imports: dict, cls: dict | None) -> Iterator[dict]:
        """Declarations and calls at the top level, in a namespace or in a class (``cls``)."""
        while i < end:
            start, modifiers = i, []
            while t[i].text in _MODIFIERS and i < end:
                modifiers.append(t[i].text)
                i += 1
            found: list[dict] = []
            if t.is_word(i, "namespace") and cls is None:
                name = t[i + 1].text if t.is_word(i + 1) else ""
                j = i + 1 + bool(name)
                if t.is_op(j, "{"):
                    yield from self._body(t, j + 1, t.close[j], name, imports, None)
                    i = t.close[j] + 1
                    continue
                space, i = name, j + 1
            elif t.is_word(i, "use"):
                i, found = self._use(t, i, end, imports, cls)
            elif t.is_word(i, "class", "interface", "trait", "enum") and t.is_word(i + 1):
                i, found = self._class(t, i, start, end, space, imports, modifiers)
            elif t.is_word(i, "function") and (t.is_word(i + 1) or t.is_op(i + 1, "&")):
                i, found = self._function(t, i, start, end, space, imports, modifiers, cls)
            elif t.is_word(i, "const"):
                i, found = self._const(t, i, start, end, space, cls)
            elif cls is not None:
                i, found = self._property(t, i, start, end, modifiers, cls)
            else:
                j = i
                while j < end and not (t.is_op(j, ";") or t.is_op(j, "}")) and not (j > i and t.is_word(j, "function", "class", "namespace") and not t.is_op(j + 1, "(")):
                    j += 1
                found = list(self._calls(t, i, j, TOP, space, imports))
                i = max(j + (t.is_op(j, ";") or t.is_op(j, "}")), i + 1)
            yield from found

    def _use(self, t, i, end, imports, cls):
        j = i + 1
        while j < end and not (t.is_op(j, ";") or t.is_op(j, "{")):
            j += 1
        last = t.close[j] if t.is_op(j, "{") else j
        if cls is not None:
            out = []
            for a, _ in t.split(i + 1, j):
                name = self._full(t[a].text, "", imports)
                cls["traits"].append(name)
                out.append(edge("uses_trait", cls["name"], name, t[a].line, t[a].column))
            return last + 1, out
        kind = t[i + 1].text if t.is_word(i + 1, "function", "const") else None
        first, prefix, parts = i + 1 + bool(kind), "", []
        if t.is_op(j, "{"):
            prefix = t[first].text.strip("\\") + "\\"
            parts = t.split(j + 1, last)
            last += 1
        else:
            parts = t.split(first, j)
        out = []
        for a, b in parts:
            full = prefix + t[a].text.strip("\\")
            alias = t[b - 1].text if t.is_word(b - 2, "as") else None
            name = alias or full.split("\\")[-1]
            imports[name] = full
            out += [node("import", name, t.span(a, b - 1), full, None, None, alias=alias, import_kind=kind), edge("imports", TOP, full, t[a].line, t[a].column)]
        return last + 1, out

    @staticmethod
    def _full(name: str, space: str, imports: dict) -> str:
        if name.startswith("\\"):
            return name[1:]
        head, sep, rest = name.partition("\\")
        if head in imports:
            return imports[head] + sep + rest
        return name

    def _class(self, t, i, start, end, space, imports, modifiers):
        kind, name = t[i].text, t[i + 1].text
        qualified = f"{space}\\{name}" if space else name
        body = i + 2
        while body < end and not t.is_op(body, "{"):
            body += 1
        lists: dict[str, list[str]] = {"extends": [], "implements": []}
        key = None
        for k in range(i + 2, body):
            if t.is_word(k, "extends", "implements"):
                key = t[k].text
            elif key and t.is_word(k):
                lists[key].append(self._full(t[k].text, space, imports))
        last = t.close.get(body, end - 1)
        cls = {"name": qualified, "traits": []}
        inner = list(self._body(t, body + 1, last, space, imports, cls))
        raw = {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}[kind]
        meta = {"modifiers": modifiers, "base_class": lists["extends"][0] if kind == "class" and lists["extends"] else None, "interfaces": lists["implements"], "extends": lists["extends"] if kind == "interface" else None, "traits": cls["traits"]}
        out = [node(raw, name, t.span(start, last), qualified, None, t.doc(start, r"/\*\*"), **meta)]
        at = (t[i].line, t[i].column)
        out += [edge("extends" if kind == "interface" else "inherits", qualified, x, *at) for x in lists["extends"]]
        out += [edge("implements", qualified, x, *at) for x in lists["implements"]]
        return last + 1, out + inner

    def _function(self, t, i, start, end, space, imports, modifiers, cls):
        k = i + 1 + t.is_op(i + 1, "&")
        name, k = t[k].text, k + 1
        if not t.is_op(k, "("):
            return k, []
        close = t.close[k]
        params = t.source(k + 1, close)
        body = close + 1
        while body < end and not (t.is_op(body, "{") or t.is_op(body, ";")):
            body += 1
        returns = t.source(close + 2, body) if t.is_op(close + 1, ":") else None
        last = t.close.get(body, body) if t.is_op(body, "{") else body
        signature = f"function {name}({params}){': ' + returns if returns else ''}"
        doc = t.doc(start, r"/\*\*")
        if cls is None:
            qualified = f"{space}\\{name}" if space else name
            caller = name
        else:
            qualified = f"{cls['name']}::{name}"
            caller = f"{cls['name'].split(chr(92))[-1]}::{name}"
        out = [node("function" if cls is None else "method", name, t.span(start, min(last, len(t) - 1)), qualified, signature, doc, modifiers=modifiers, return_type=returns)]
        out += self._calls(t, body, last, caller, space, imports)
        return last + 1, out

    def _const(self, t, i, start, end, space, cls):
        j = i
        while j < end and not t.is_op(j, ";"):
            j = t.close.get(j, j) + 1
        out = []
        for a, b in t.split(i + 1, j):
            stop = next((k for k in range(a, b) if t.is_op(k, "=")), b)
            name = t[stop - 1].text
            if t.is_word(stop - 1):
                out.append(node("constant", name, t.span(start, min(j, len(t) - 1)), f"{cls['name']}::{name}" if cls else (f"{space}\\{name}" if space else name), None, t.doc(start, r"/\*\*")))
        return j + 1, out

    def _property(self, t, i, start, end, modifiers, cls):
        j = i
        while j < end and not t.is_op(j, ";"):
            j = t.close.get(j, j) + 1
        out = []
        if modifiers:
            for a, b in t.split(i, j):
                var = next((k for k in range(a, b) if t[k].kind == "var"), None)
                if var is not None:
                    name = t[var].text[1:]
                    out.append(node("property", name, t.span(start, min(j, len(t) - 1)), f"{cls['name']}::${name}", None, t.doc(start, r"/\*\*"), modifiers=modifiers, property_type=t.source(a, var) or None))
        return j + 1, out

    def _calls(self, t: Tokens, i: int, end: int, caller: str, space: str, imports: dict) -> Iterator[dict]:
        for k in range(i, end):
            a = k - 1
            if not t.is_op(k, "(") or not t.is_word(a) or t[a].text.lower() in _NO_CALL:
                continue
            name, at = t[a].text, (t[a].line, t[a].column)
            if t.is_word(a - 1, "new", "function"):
                continue
            if t.is_op(a - 1, "->") or t.is_op(a - 1, "?->"):
                owner = t[a - 2].text
                yield edge("calls", caller, name, *at, None, same_class_call=owner == "$this", object=None if owner == "$this" else owner)
            elif t.is_op(a - 1, "::"):
                owner = t[a - 2].text
                if owner in ("self", "static", "parent"):
                    yield edge("calls", caller, name, *at, None, same_class_call=True, static=True)
                else:
                    yield edge("calls", caller, f"{self._full(owner, space, imports)}::{name}", *at, None, static=True)
            else:
                args = t.split(k + 1, t.close[k])
                if name in REGISTERS and len(args) > 1:
                    yield from self._hook(t, args, REGISTERS[name], at)
                elif name in TRIGGERS and args:
                    hook = self._string(t, args[0])
                    if hook:
                        yield edge(TRIGGERS[name], caller, hook, *at)
                elif name == "add_shortcode" and len(args) > 1:
                    tag, callback = self._string(t, args[0]), self._callback(t, args[1])
                    if tag and callback:
                        yield edge("registers_shortcode", callback, f"[{tag}]", *at)
                head = name.strip("\\")
                yield edge("calls", caller, head.split("\\")[-1] if "\\" in head else head, *at, imports.get(name), qualified=head if "\\" in head else None)

    @staticmethod
    def _string(t: Tokens, part: tuple[int, int]) -> str | None:
        return t[part[0]].text[1:-1] if t[part[0]].kind == "string" else None

    def _callback(self, t: Tokens, part: tuple[int, int]) -> str | None:
        """The function that a callback names: a string, or the second of a pair; closures have no name."""
        own = self._string(t, part)
        if own:
            return own
        a = part[0]
        first = a + 2 if t.is_word(a, "array") and t.is_op(a + 1, "(") else a + 1 if t.is_op(a, "[") else None
        if first is None:
            return None
        inner = t.split(first, t.close[first - 1])
        return self._string(t, inner[1]) if len(inner) > 1 else None

    def _hook(self, t, args, kind, at) -> Iterator[dict]:
        hook, callback = self._string(t, args[0]), self._callback(t, args[1])
        if hook and callback:
            ajax = re.match(r"wp_ajax_(nopriv_)?(.+)", hook)
            meta = {"ajax_action": ajax[2], "nopriv": bool(ajax[1])} if ajax else {}
            yield edge(kind, callback, hook, *at, None, hook=hook, **meta)
