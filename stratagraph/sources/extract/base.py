"""What extractors share: records, the registry, and the job that runs them over files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType

from ...schema import EXTRACTED
from ...scratch import spread_out

TOP = "<module>"


class Extractor:
    """Symbols and relationships of one language.

    ``extract`` yields records made by ``node``, ``edge`` and ``error``.
    Lines count from 1, columns are byte offsets from 0.
    """

    language = ""
    extensions: tuple[str, ...] = ()

    def extract(self, path: str, text: str) -> Iterator[dict]:
        raise NotImplementedError


def _bag(metadata: dict) -> str | None:
    kept = {k: v for k, v in metadata.items() if v not in (None, False, [], {}, "")}
    return json.dumps(kept) if kept else None


def node(kind: str, name: str, span: tuple[int, int, int, int], qualified: str | None = None, signature: str | None = None, doc: str | None = None, **metadata) -> dict:
    line, column, end_line, end_column = span
    return {"record": "node", "node_type": kind, "name": name, "qualified_name": qualified or name, "signature": signature, "docstring": doc, "start_line": line, "start_column": column, "end_line": end_line, "end_column": end_column, "metadata": _bag(metadata)}


def edge(kind: str, source: str, target: str, line: int, column: int, module: str | None = None, /, **metadata) -> dict:
    return {"record": "edge", "edge_type": kind, "source_name": source, "target_name": target, "start_line": line, "start_column": column, "target_module": module, "metadata": _bag(({"target_module": module} if module else {}) | metadata)}


def error(message: str) -> dict:
    return {"record": "error", "message": message}


class Registry:
    """Extractors by language and by extension; a second one for either is refused."""

    def __init__(self, extractors: list[Extractor] | None = None):
        self._by_language: dict[str, Extractor] = {}
        self._by_extension: dict[str, Extractor] = {}
        for e in extractors or []:
            self.register(e)

    def register(self, extractor: Extractor) -> None:
        if extractor.language in self._by_language:
            raise ValueError(f"there is an extractor for {extractor.language} already")
        taken = [x for x in extractor.extensions if x in self._by_extension]
        if taken:
            raise ValueError(f"there is an extractor for {', '.join(taken)} already")
        self._by_language[extractor.language] = extractor
        self._by_extension |= dict.fromkeys(extractor.extensions, extractor)

    def unregister(self, language: str) -> None:
        gone = self._by_language.pop(language)
        self._by_extension = {k: v for k, v in self._by_extension.items() if v is not gone}

    def get(self, language: str) -> Extractor | None:
        return self._by_language.get(language)

    def for_extension(self, extension: str) -> Extractor | None:
        extension = extension.lower()
        return self._by_extension.get(extension if extension.startswith(".") else f".{extension}")

    def for_file(self, path: str) -> Extractor | None:
        found = re.search(r"\.[^./]+$", path)
        return self.for_extension(found[0]) if found else None

    @property
    def languages(self) -> list[str]:
        return sorted(self._by_language)

    @property
    def extensions(self) -> list[str]:
        return sorted(self._by_extension)

    def __contains__(self, language: str) -> bool:
        return language in self._by_language

    def __len__(self) -> int:
        return len(self._by_language)


#: The registry of the process, which ``register`` and the look-ups below use.
_shared = Registry()


def shared_registry() -> Registry:
    return _shared


def register(extractor: Extractor) -> None:
    _shared.register(extractor)


def extractor_for_file(path: str) -> Extractor | None:
    return _shared.for_file(path)


def extractor_of(language: str) -> Extractor | None:
    return _shared.get(language)


def records(registry: Registry, path: str, content: bytes | None, problem: str | None = None, extractor: Extractor | None = None) -> Iterator[dict]:
    """The records of one file, numbered; whatever goes wrong is an error record. ``extractor`` goes before the path's own."""
    found: list[dict] = []
    extractor = extractor or registry.for_file(path)
    if content is None or problem:
        found.append(error(problem or "no content"))
    elif extractor is None:
        found.append(error("no extractor for this extension"))
    else:
        try:
            for record in extractor.extract(path, content.decode("utf-8")):
                found.append(record)
        except UnicodeDecodeError as e:
            found.append(error(f"not UTF-8: {e}"))
        except Exception as e:  # an extractor's fault concerns its file only
            found.append(error(f"{type(e).__name__}: {e}"))
    for k, record in enumerate(found):
        yield {"file_path": path, "ordinal": k} | record


#: Records that leave a task at a time.
RECORDS_A_BATCH = 8192


def extract_files(files: DataFrame, registry: Registry, extractor: Extractor | None = None, spread: bool = True) -> DataFrame:
    """Rows of ``EXTRACTED`` from files (``file_path``, ``content``, perhaps ``problem``); each file has a row of its own besides.

    ``extractor`` reads all of them, whatever their extensions.  ``spread``
    deals the files out first; a source that has few files a task needs none.
    """
    names = EXTRACTED.names
    schema = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, IntegerType) else pa.string()) for f in EXTRACTED])
    has_problem = "problem" in files.columns
    rows = files.select("file_path", "content", *(["problem"] if has_problem else []))

    def run(batches):
        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.get(f.name) for x in out], f.type) for f in schema], schema=schema)

        for batch in batches:
            out: list[dict] = []
            columns = [c.to_pylist() for c in batch.columns]
            for path, content, problem in zip(columns[0], columns[1], columns[2] if has_problem else [None] * batch.num_rows):
                out.append({"file_path": path, "record": "file", "ordinal": -1, "end_line": (content or b"").count(b"\n") + 1})
                out += records(registry, path, content, problem, extractor)
                if len(out) >= RECORDS_A_BATCH:
                    yield packed()
                    out = []
            if out:
                yield packed()

    return (spread_out(rows, "file_path") if spread else rows).mapInArrow(run, EXTRACTED)


class Token:
    __slots__ = ("kind", "text", "line", "column", "start", "end")

    def __init__(self, kind: str, text: str, line: int, column: int, start: int, end: int):
        self.kind, self.text, self.line, self.column, self.start, self.end = kind, text, line, column, start, end

    def __repr__(self) -> str:
        return f"{self.kind}:{self.text}@{self.line}"


class Tokens:
    """A text's tokens without comments, and where each bracket closes.

    ``rules`` are ``(kind, pattern)``; of kind ``comment`` are kept aside, for
    what documents the token after them.
    """

    def __init__(self, text: str, rules: list[tuple[str, str]]):
        self.text = text
        master = re.compile("|".join(f"(?P<{k}>{p})" for k, p in rules), re.S)
        self.tokens: list[Token] = []
        self.comments: dict[int, list[Token]] = {}  # by the number of the token after
        self._ops: list[str | None] = []  # the text of each token that is an operator, or a word
        self._words: list[str | None] = []
        self.close: dict[int, int] = {}
        self.unclosed = 0
        stack: list[int] = []
        ascii_only = text.isascii()
        line, line_start = 1, 0
        at, width = 0, 0  # of a line the bytes ``width`` up to the character ``at``
        for m in master.finditer(text):
            kind, found = m.lastgroup, m[0]
            if kind != "skip":
                start, end = m.span()
                if ascii_only:
                    width = start - line_start
                else:
                    width, at = width + len(text[at:start].encode()), start
                t = Token(kind, found, line, width, start, end)
                if kind == "comment":
                    self.comments.setdefault(len(self.tokens), []).append(t)
                else:
                    i = len(self.tokens)
                    self.tokens.append(t)
                    self._ops.append(found if kind == "op" else None)
                    self._words.append(found if kind == "word" else None)
                    if kind == "op" and found in "([{":
                        stack.append(i)
                    elif kind == "op" and found in ")]}":
                        while stack and "([{".index(self.tokens[stack[-1]].text) != ")]}".index(found):
                            self.close[stack.pop()] = i
                            self.unclosed += 1
                        if stack:
                            self.close[stack.pop()] = i
                        else:
                            self.unclosed += 1
            if "\n" in found:
                line += found.count("\n")
                line_start = m.start() + found.rindex("\n") + 1
                at, width = line_start, 0
        self.unclosed += len(stack)
        for i in stack:
            self.close[i] = len(self.tokens) - 1

    def __len__(self) -> int:
        return len(self.tokens)

    def __getitem__(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else _NONE

    def is_op(self, i: int, text: str) -> bool:
        return 0 <= i < len(self._ops) and self._ops[i] == text

    def is_word(self, i: int, *texts: str) -> bool:
        word = self._words[i] if 0 <= i < len(self._words) else None
        return word is not None and (not texts or word in texts)

    def source(self, i: int, j: int) -> str:
        """The text from token ``i`` up to token ``j``, white space as one space."""
        return " ".join(self.text[self[i].start : self[j - 1].end].split()) if i < j else ""

    def span(self, i: int, j: int) -> tuple[int, int, int, int]:
        """Lines and columns of tokens ``i`` to ``j``, both included."""
        a, b = self[i], self[j]
        tail = b.text.rsplit("\n", 1)
        end_line = b.line + b.text.count("\n")
        return a.line, a.column, end_line, (b.column if len(tail) == 1 else 0) + len(tail[-1].encode())

    def doc(self, i: int, pattern: str) -> str | None:
        """The comments right before a token that match ``pattern``, without their marks."""
        found = [c for c in self.comments.get(i, []) if re.match(pattern, c.text)]
        if not found:
            return None
        lines = "\n".join(c.text for c in found).split("\n")
        bare = [re.sub(r"^\s*(?:/\*\*?|\*/|\*|///?|#)?\s?|\s*\*/\s*$", "", x).rstrip() for x in lines]
        return "\n".join(bare).strip() or None

    def split(self, i: int, j: int, by: str = ",") -> list[tuple[int, int]]:
        """Parts of the tokens ``i`` up to ``j`` between separators outside of brackets."""
        out, at, depth = [], i, 0
        for k in range(i, j):
            t = self[k]
            if t.kind == "op":
                depth += t.text in "([{<"
                depth -= t.text in ")]}>"
                if t.text == by and depth <= 0:
                    out.append((at, k))
                    at = k + 1
        if at < j:
            out.append((at, j))
        return [x for x in out if x[0] < x[1]]


_NONE = Token("end", "", 0, 0, 0, 0)
