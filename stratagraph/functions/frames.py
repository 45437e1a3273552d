"""Profiler frame names to functions, classes and namespaces, as column expressions.

Languages are tried in the order .NET, Python, JavaScript; what none claims is
parsed by dots.  Every rule is an expression over the name, so that Catalyst
compiles the cascade; parsers that users register run as a pandas UDF before.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Columns of a normalised frame, after ``name``.
FIELDS = ("language", "function_name", "class_name", "namespace", "qualified_name", "file_path", "line_number", "column", "metadata")
_TYPES = {"line_number": "int", "column": "int"}
#: .NET type names that give argument lists away.
_NET_ARGS = r"\([^)]*(?:System\.|Int32|String|Boolean|Object)"
_PY_PROFILE = r"^(.+):(\d+)\((.+)\)$"
_PY_SYNTHETIC = ("<module>", "<listcomp>", "<dictcomp>", "<genexpr>", "<lambda>", "<setcomp>")
_JS_AT = r"^(?:(.*?) )?\(?([^()\s]+):(\d+):(\d+)\)?$"
_JS_AT_STRICT = r"\([^()]+:\d+:\d+\)"


def _pick(c: Column, pattern: str, group: int) -> Column:
    """A group of a pattern; null where it doesn't match or is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def _last(parts: Column, k: int = 1) -> Column:
    """The k-th last part; null if there is none."""
    return F.when(F.size(parts) >= k, F.try_element_at(parts, F.lit(-k)))


def _join(parts: Column, dropped: int) -> Column:
    """All but the last ``dropped`` parts by dots; null if none are left."""
    return F.when(F.size(parts) > dropped, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dropped, F.lit(0))), "."))


def _no_args(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\([^()]*\)$", ""))


def is_dotnet(name: Column) -> Column:
    parts = F.filter(F.split(F.split_part(name, F.lit("("), F.lit(1)), r"\."), lambda p: p != "")
    upper = F.size(F.filter(parts, _upper))
    return name.rlike(r"[!+`]") | name.rlike(_NET_ARGS) | ((F.size(parts) >= 2) & (upper * 4 >= F.size(parts) * 3) & ~name.rlike(r"[\s:/]"))


def is_python(name: Column) -> Column:
    return name.rlike(_PY_PROFILE) | name.rlike(r"\.py:\d+") | name.rlike("(?:" + "|".join(_PY_SYNTHETIC) + ")") | (name.contains("_") & ~name.rlike(r"[`!]") & ~name.rlike(r"\.(?:js|ts)\b"))


def is_javascript(name: Column) -> Column:
    return name.rlike(_JS_AT_STRICT) | name.contains(".prototype.") | name.rlike(r"(?i)anonymous") | name.rlike(r"\.(?:js|ts|jsx|tsx|mjs):") | name.contains("module.exports")


def _dotnet(name: Column) -> dict[str, Column]:
    module = _pick(name, r"^([^!]+)!", 1)
    bare = _no_args(F.regexp_replace(name, r"^[^!]*!", ""))
    generic = bare.rlike(r"`\d+")
    parts = F.filter(F.split(F.regexp_replace(bare, r"`\d+", ""), r"\."), lambda p: p != "")
    nested = _last(parts, 2)
    fn = _last(parts)
    cls = F.element_at(F.split(nested, r"\+"), -1)
    space = _join(parts, 2)
    bag = F.to_json(F.struct(module.alias("module"), F.when(generic, F.lit(True)).alias("is_generic")))
    return {"function_name": fn, "class_name": cls, "namespace": space, "qualified_name": F.concat_ws(".", space, cls, fn), "metadata": bag}


def _python(name: Column) -> dict[str, Column]:
    profiled = name.rlike(_PY_PROFILE)
    at_line = r"^(.*?)\s*\(?([^\s()]+\.py):(\d+)\)?$"
    where = F.when(profiled, _pick(name, _PY_PROFILE, 1)).otherwise(_pick(name, at_line, 2))
    line = F.when(profiled, _pick(name, _PY_PROFILE, 2)).otherwise(_pick(name, at_line, 3)).try_cast("int")
    bare = F.when(profiled, F.regexp_extract(name, _PY_PROFILE, 3)).when(name.rlike(at_line), F.coalesce(_pick(name, at_line, 1), name)).otherwise(_no_args(name))
    parts = F.filter(F.split(bare, r"\."), lambda p: p != "")
    fn, before = F.coalesce(_last(parts), bare), _last(parts, 2)
    cls = F.when(_upper(before), before)
    space = F.when(_upper(before), _join(parts, 2)).otherwise(_join(parts, 1))
    file = F.when(~where.isin(*_PY_SYNTHETIC), where)
    return {"function_name": fn, "class_name": cls, "namespace": space, "qualified_name": F.concat_ws(".", space, cls, fn), "file_path": file, "line_number": line}


def _javascript(name: Column) -> dict[str, Column]:
    at = name.rlike(_JS_AT)
    bare = F.trim(F.when(at, F.coalesce(F.regexp_extract(name, _JS_AT, 1), F.lit(""))).otherwise(name))
    unnamed = (bare == "") | bare.rlike(r"(?i)^[<(]?anonymous[>)]?$")
    proto = r"^(.+)\.prototype\.(.+)$"
    parts = F.filter(F.split(F.regexp_replace(bare, r"\.prototype\.", "."), r"\."), lambda p: p != "")
    fn = F.when(unnamed, F.lit("<anonymous>")).otherwise(F.coalesce(_last(parts), bare))
    before = _last(parts, 2)
    is_class = bare.rlike(proto) | _upper(before)
    cls = F.when(~unnamed & is_class, before)
    space = F.when(~unnamed, F.when(is_class, _join(parts, 2)).otherwise(_join(parts, 1)))
    return {
        "function_name": fn, "class_name": cls, "namespace": space, "qualified_name": F.concat_ws(".", space, cls, fn),
        "file_path": F.when(at, _pick(name, _JS_AT, 2)), "line_number": F.when(at, _pick(name, _JS_AT, 3)).try_cast("int"), "column": F.when(at, _pick(name, _JS_AT, 4)).try_cast("int"),
    }


def _unknown(name: Column) -> dict[str, Column]:
    bare = F.trim(F.split_part(name, F.lit("("), F.lit(1)))
    parts = F.filter(F.split(bare, r"\."), lambda p: p != "")
    fn, cls, space = F.coalesce(_last(parts), name), _last(parts, 2), _join(parts, 2)
    return {"function_name": fn, "class_name": cls, "namespace": space, "qualified_name": F.concat_ws(".", space, cls, fn)}


_RULES = {"dotnet": _dotnet, "python": _python, "javascript": _javascript, "unknown": _unknown}


def detect_language(name: Column, hint: str | None = None) -> Column:
    """The language that a frame name is in; a hint skips the detection."""
    if hint:
        return F.lit(hint if hint in _RULES else "unknown")
    return F.when(is_dotnet(name), "dotnet").when(is_python(name), "python").when(is_javascript(name), "javascript").otherwise("unknown")


class FrameParser:
    """A parser of frame names that users register.

    ``can_parse(name)`` says whether it takes a name; ``parse(name)`` returns
    a dictionary with ``function_name`` and any of the other ``FIELDS``.
    """

    language = "custom"

    def can_parse(self, name: str) -> bool:
        raise NotImplementedError

    def parse(self, name: str) -> dict:
        raise NotImplementedError


class FrameNormaliser:
    """Frame names to structures; parsers registered last are asked first."""

    def __init__(self):
        self.parsers: list[FrameParser] = []

    def register_parser(self, parser: FrameParser) -> None:
        self.parsers.insert(0, parser)

    def __call__(self, frames: DataFrame, name_col: str = "name", hint: str | None = None) -> DataFrame:
        """``frames`` with the columns ``FIELDS``; a frame's own ``file`` and ``line`` fill what the name lacks."""
        found = normalise(frames, name_col, hint)
        if not self.parsers:
            return found
        parsers, schema = list(self.parsers), ", ".join(f"`{f}` {_TYPES.get(f, 'string')}" for f in FIELDS)

        @F.pandas_udf(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")
        def custom(names: pd.Series) -> pd.DataFrame:
            rows = []
            for name in names:
                p = next((p for p in parsers if name is not None and p.can_parse(name)), None)
                got = {} if p is None else {"language": p.language} | p.parse(name)
                rows.append([got.get(f) for f in FIELDS])
            return pd.DataFrame(rows, columns=list(FIELDS)).astype({f: "Int32" for f in _TYPES})

        taken: Callable[[str], Column] = lambda f: F.when(F.col("_own.language").isNotNull(), F.col(f"_own.{f}")).otherwise(F.col(f))
        return found.withColumn("_own", custom(F.col(name_col))).withColumns({f: taken(f) for f in FIELDS}).drop("_own")


def normalise(frames: DataFrame, name_col: str = "name", hint: str | None = None) -> DataFrame:
    """``frames`` with the columns ``FIELDS`` from the names; names of each language by its rules."""
    name = F.col(name_col)
    tagged = frames.withColumn("language", detect_language(name, hint))
    rules = {lang: rule(name) for lang, rule in _RULES.items()}
    out = {}
    for f in FIELDS[1:]:
        value = F.lit(None).cast(_TYPES.get(f, "string"))
        for lang, fields in rules.items():
            if f in fields:
                value = F.when(F.col("language") == lang, fields[f]).otherwise(value)
        out[f] = value
    if "file" in frames.columns:
        out["file_path"] = F.coalesce(F.nullif("file", F.lit("")), out["file_path"])
    if "line" in frames.columns:
        out["line_number"] = F.coalesce("line", out["line_number"])
    return tagged.withColumns(out)


def qualified_name(name: Column) -> Column:
    """What stands before the arguments of a frame name."""
    return F.split_part(name, F.lit("("), F.lit(1))
