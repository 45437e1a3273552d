"""Source trees as frames.

Names that begin with ``_`` or ``.`` count like any other, which Spark's own
file sources leave out; so a Python data source walks the tree on the driver
and reads the files on the executors, from a path that all of them see.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# --- fixed values: folders that are left out by default ---
DEFAULT_EXCLUDES = [
    "**/node_modules/**", "**/.git/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/.tox/**",
    "**/dist/**", "**/build/**", "**/.eggs/**", "**/*.egg-info/**", "**/.mypy_cache/**", "**/.pytest_cache/**",
]
#: Files that a task reads.
FILES_A_TASK = 64
# --- fixed values: languages by file extension, whether or not there is an extractor for them ---
LANGUAGES = {".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".cs": "csharp"}


def exclude_rules(patterns: list[str]) -> Callable[[str, str], bool]:
    """A test ``(root, relative path) -> excluded`` for glob patterns.

    ``**/d/**`` excludes paths with a part that is ``d``, letter by letter;
    ``**/x`` paths that end in ``x`` or hold ``/x``; ``p/**`` paths that begin
    with ``p``; anything else is a glob over the last parts of the path.
    """

    def one(pattern: str) -> Callable[[str, str], bool]:
        if pattern.startswith("**/") and pattern.endswith("/**"):
            part = pattern[3:-3]
            return lambda root, p: part in p.split("/")
        if pattern.startswith("**/") and "*" not in pattern[3:]:
            end = pattern[3:]
            return lambda root, p: p.endswith(end) or f"/{end}" in f"/{p}"
        if pattern.endswith("/**"):
            start = pattern[:-3]
            return lambda root, p: p.startswith(start)
        globs = pattern.strip("/").split("/")

        def tail(p: str) -> bool:
            parts = p.strip("/").split("/")
            return len(parts) >= len(globs) and all(map(fnmatchcase, parts[-len(globs) :], globs))

        if pattern.startswith("/"):
            return lambda root, p: fnmatchcase(f"{root}/{p}", pattern)
        return lambda root, p: tail(p) or tail(f"{root}/{p}")

    tests = [one(p) for p in patterns]
    return lambda root, p: any(test(root, p) for test in tests)


def excluded(path: Column, patterns: list[str]) -> Column:
    """``exclude_rules`` over a column of relative paths."""

    def one(pattern: str) -> Column:
        if pattern.startswith("**/") and pattern.endswith("/**"):
            return F.array_contains(F.split(path, "/"), pattern[3:-3])
        if pattern.startswith("**/") and "*" not in pattern[3:]:
            return path.endswith(pattern[3:]) | F.concat(F.lit("/"), path).contains("/" + pattern[3:])
        if pattern.endswith("/**"):
            return path.startswith(pattern[:-3])
        regex = "/".join("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in part) for part in pattern.strip("/").split("/"))
        return path.rlike(f"(?:^|/){regex}$")

    return functools.reduce(Column.__or__, map(one, patterns), F.lit(False))


def discover(root: str, extensions: list[str], excludes: list[str] | None = None) -> list[str]:
    """Relative paths of the files with these extensions, sorted; excluded folders aren't entered."""
    out = exclude_rules(DEFAULT_EXCLUDES if excludes is None else excludes)
    found = []
    for top, dirs, files in os.walk(root):
        below = os.path.relpath(top, root)
        at = "" if below == "." else below.replace(os.sep, "/") + "/"
        dirs[:] = [d for d in dirs if not out(root, f"{at}{d}/x")]
        found += [at + f for f in files if os.path.splitext(f)[1].lower() in extensions and not out(root, at + f)]
    return sorted(found, key=lambda p: p.split("/"))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.extensions = options.get("extensions", ".py").split(",")
        self.excludes = options["excludes"].split("\n") if "excludes" in options else None

    def partitions(self) -> list[_Files]:
        files = list(enumerate(discover(self.root, self.extensions, self.excludes)))
        return [_Files(files[k : k + FILES_A_TASK]) for k in range(0, len(files), FILES_A_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for ordinal, path in partition.files:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    yield path, ordinal, f.read(), None
            except OSError as e:
                yield path, ordinal, None, str(e)


class RepoFiles(DataSource):
    """``spark.read.format("repo_files").option("extensions", ".py,.cs").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "file_path string, ordinal long, content binary, problem string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_repo(spark: SparkSession, root: str, extensions: list[str], excludes: list[str] | None = None) -> DataFrame:
    """The files of a tree: ``file_path`` (relative), ``ordinal``, ``content``, ``problem``."""
    spark.dataSource.register(RepoFiles)
    reader = spark.read.format("repo_files").option("extensions", ",".join(extensions))
    if excludes is not None:
        reader = reader.option("excludes", "\n".join(excludes))
    return reader.load(root)


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Whether a path ends in one of the extensions, its case aside."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(extensions)


def infer_language(path: Column, more: dict[str, str] | None = None) -> Column:
    """The language of a path's extension; null if unknown."""
    table = (more or {}) | LANGUAGES
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def language_of(path: str, registry=None) -> str:
    """The language of a path's extension, by the fixed table and then by a registry of extractors; ValueError if unknown."""
    extension = os.path.splitext(path)[1].lower()
    extractor = registry.for_extension(extension) if registry is not None and extension else None
    language = LANGUAGES.get(extension) or (extractor.language if extractor else None)
    if language is None:
        raise ValueError(f"no language is known for {extension or 'a file without extension'}: {path}")
    return language
