"""Pages, named elements, resources and handlers of XAML files."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from .base import Extractor, edge, error, node

# --- fixed values: namespaces, and attributes that name event handlers ---
X_SPACES = ("http://schemas.microsoft.com/winfx/2006/xaml", "http://schemas.microsoft.com/winfx/2009/xaml")
EVENTS = {
    "Clicked", "Tapped", "DoubleTapped", "LongPressed", "Pressed", "Released",
    "Unfocused", "Focused", "TextChanged", "Completed", "SearchButtonPressed", "SelectedIndexChanged",
    "SelectionChanged", "ItemSelected", "ItemTapped", "Appearing", "Disappearing", "Loaded",
    "Unloaded", "SizeChanged", "LayoutChanged", "ChildAdded", "ChildRemoved", "Scrolled",
    "ScrollToRequested", "PropertyChanged", "PropertyChanging", "Click", "MouseDown", "MouseUp",
    "MouseEnter", "MouseLeave", "KeyDown", "KeyUp", "PreviewKeyDown", "PreviewKeyUp",
    "GotFocus", "LostFocus", "GotKeyboardFocus", "LostKeyboardFocus", "DragEnter", "DragLeave",
    "DragOver", "Drop", "Closing", "Closed", "Opening", "Opened",
}
_MARKUP = re.compile(r"\{(Binding|StaticResource|DynamicResource|TemplateBinding)(?:\s+([^}]*))?\}")


def binding_parts(content: str) -> tuple[list[str], dict[str, str]]:
    """Positional and named parts of a binding, split at commas outside of braces."""
    parts, depth, at = [], 0, 0
    for k, c in enumerate(content):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(content[at:k])
            at = k + 1
    parts.append(content[at:])
    plain, named = [], {}
    for p in filter(None, map(str.strip, parts)):
        k, is_named, v = p.partition("=")
        if is_named:
            named[k.strip()] = v.strip()
        else:
            plain.append(p)
    return plain, named


def _local(tag: str) -> tuple[str, str]:
    space, _, name = tag.rpartition("}")
    return space.lstrip("{"), name


class XamlExtractor(Extractor):
    language = "xaml"
    extensions = (".xaml",)

    def extract(self, path: str, text: str) -> Iterator[dict]:
        try:
            root = ET.fromstring(text)
        except ET.ParseError as e:
            yield error(f"XML parse error: {e}")
            return
        lines = text.split("\n")
        base = path.split("/")[-1]
        cls = next((root.get(f"{{{s}}}Class") for s in X_SPACES if root.get(f"{{{s}}}Class")), None)
        page = cls or base.removesuffix(".xaml")
        if cls:
            yield node("page", cls.split(".")[-1], (1, 0, len(lines), 0), cls, None, None, root_element=_local(root.tag)[1])
        first: dict[str, int] = {}  # of each tag the first line that has it
        for element in root.iter():
            if not isinstance(element.tag, str):
                continue
            space, tag = _local(element.tag)
            if tag not in first:
                first[tag] = next((k for k, x in enumerate(lines, 1) if re.search(rf"<(?:\w+:)?{re.escape(tag)}\b", x)), 1)
            line = first[tag]
            here = (line, 0, line, 0)
            for attr, value in element.attrib.items():
                a_space, name = _local(attr)
                if name == "Name" and (a_space in X_SPACES or not a_space):
                    yield node("named_element", value, here, f"{page}.{value}", None, None, element_type=tag)
                elif name == "Key" and a_space in X_SPACES:
                    yield node("resource", value, here, f"{page}.{value}", None, None, element_type=tag)
                yield from self._links(base, page, name, value, line)

    @staticmethod
    def _links(base: str, page: str, attr: str, value: str, line: int) -> Iterator[dict]:
        markup = _MARKUP.search(value)
        if attr in EVENTS and not value.startswith("{"):
            yield edge("event_handler", base, f"{page}.{value}", line, 0, None, event=attr)
        if not markup:
            return
        kind, content = markup[1], (markup[2] or "").strip()
        if kind == "Binding":
            plain, named = binding_parts(content)
            target = named.get("Path") or (plain[0] if plain else "")
            if target:
                yield edge("binding", base, target, line, 0, None, property=attr, **{k.lower(): v for k, v in named.items() if k != "Path"})
            if attr == "Command" and target:
                yield edge("command", base, target, line, 0)
            elif named.get("Command"):
                yield edge("command", base, named["Command"], line, 0)
        elif kind == "TemplateBinding":
            yield edge("template_binding", base, content, line, 0, None, property=attr)
        elif content:
            yield edge("resource_ref", base, content, line, 0, None, property=attr, dynamic=kind == "DynamicResource")


def controls(text: str) -> list[dict]:
    """All elements of a page: type, namespace, name, attributes."""
    found = []
    for element in ET.fromstring(text).iter():
        space, tag = _local(element.tag)
        attrs = {_local(k)[1]: v for k, v in element.attrib.items()}
        name = next((v for k, v in element.attrib.items() if _local(k)[1] == "Name" and _local(k)[0] in (*X_SPACES, "")), None)
        found.append({"type": tag, "namespace": space, "name": name, "attributes": attrs})
    return found
