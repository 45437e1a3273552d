"""Graphs from what a language server said, as JSON lines.

The server itself runs elsewhere.  Two kinds of dumps are read: symbol trees,
one line a file (``{"FileName": ..., "Elements": [...]}``), and usages, one
line a symbol (``{"SymbolId": ..., "QuickFixes": [...]}``).  Lines and columns
in them count from 0.
"""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import containing_nodes
from ..operators.resolve import RECORDS, node_id
from ..schema import SERVER_KIND_OF
from ..scratch import numbered

#: Kinds whose usages are looked for; those of the first row are calls, the others references.
CALLED = ("method", "function", "property")
REFERRED = ("class", "interface", "enum", "variable", "constant")
_NODE = "file_path string, ordinal int, node_type string, name string, qualified_name string, parent_ordinal int, start_line int, start_column int, end_line int, end_column int"
_FIXES = "SymbolId string, QuickFixes array<struct<FileName:string, Line:int, Column:int, EndLine:int, EndColumn:int, Text:string>>"


def _range(element: dict, wanted: str) -> tuple[int, int, int, int]:
    ranges = element.get("Ranges") or {}
    r = ranges.get(wanted) or ranges.get("name") or ranges.get("full") or {}
    a, b = r.get("Start") or {}, r.get("End") or {}
    return a.get("Line", 0) + 1, a.get("Column", 0), b.get("Line", 0) + 1, b.get("Column", 0)


def flatten(elements: list[dict], wanted: str = "name") -> list[tuple]:
    """The elements of a tree in order, each with its parent's number; without recursion."""
    out: list[tuple] = []
    todo = [(e, "", None) for e in reversed(elements)]
    while todo:
        e, scope, parent = todo.pop()
        name = e.get("Name") or e.get("DisplayName") or ""
        qualified = f"{scope}.{name}" if scope else name
        out.append((len(out), SERVER_KIND_OF.get((e.get("Kind") or "").lower(), "variable"), name, qualified, parent, *_range(e, wanted)))
        todo += [(c, qualified, len(out) - 1) for c in reversed(e.get("Children") or [])]
    return out


def server_nodes(spark: SparkSession, path: str, repo_path: str, wanted: str = "name", after: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes, and ``contains`` edges, from symbol trees; ``wanted`` is the range to take, ``name`` or ``full``."""
    lines = spark.read.text(path)

    def run(parts):
        for part in parts:
            rows = []
            for line in part["value"]:
                tree = json.loads(line)
                rows += [(tree["FileName"], *x) for x in flatten(tree.get("Elements") or [], wanted)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _NODE.split(", ")], dtype=object)
            yield frame.astype({c: "Int32" for c in ("ordinal", "parent_ordinal", "start_line", "start_column", "end_line", "end_column")})

    flat = lines.mapInPandas(run, _NODE).withColumn("id", node_id(repo_path, F.col("file_path"), F.col("name"), F.col("start_line")))
    nodes = flat.groupBy("id").agg(F.max_by(F.struct("file_path", "node_type", "name", "qualified_name", "start_line", "start_column", "end_line", "end_column", "ordinal"), F.col("ordinal")).alias("n")).select("id", F.lit(repo_path).alias("repo_path"), "n.*")
    files = numbered(nodes.select("file_path").distinct().orderBy("file_path"), "rank", -(-after // RECORDS))
    nodes = nodes.join(files, "file_path").withColumn("seq", F.col("rank") * F.lit(RECORDS) + F.col("ordinal") + 1).drop("ordinal", "rank")
    parent = flat.select("file_path", F.col("ordinal").alias("parent_ordinal"), F.col("id").alias("source_id"))
    inside = flat.join(parent, ["file_path", "parent_ordinal"]).where("source_id != id")
    edges = inside.select("source_id", F.col("id").alias("target_id"), F.lit("contains").alias("edge_type"), F.col("file_path").alias("location_file"), F.col("start_line").alias("location_start_line"), F.col("start_column").alias("location_start_column"), F.col("end_line").alias("location_end_line"), F.col("end_column").alias("location_end_column"))
    return nodes, edges


def usage_edges(spark: SparkSession, path: str, nodes: DataFrame, repo_path: str) -> DataFrame:
    """Calls and references from usages: from the innermost node around each usage to the symbol, itself excepted.

    A dump names symbols ``file:name:line``, the file as its symbol trees have it.
    """
    fixes = spark.read.schema(_FIXES).json(path).select(F.concat(F.lit(f"{repo_path}/" if repo_path else ""), "SymbolId").alias("target_id"), F.explode("QuickFixes").alias("q"))
    kinds = nodes.where(F.col("node_type").isin(*CALLED, *REFERRED)).select(F.col("id").alias("target_id"), F.when(F.col("node_type").isin(*CALLED), "calls").otherwise("references").alias("edge_type"))
    places = fixes.join(kinds, "target_id").select(F.lit(repo_path).alias("repo_path"), F.col("q.FileName").alias("file_path"), (F.col("q.Line") + 1).alias("line"), "target_id", "edge_type", F.col("q.Column").alias("start_column"), (F.col("q.EndLine") + 1).alias("end_line"), F.col("q.EndColumn").alias("end_column"))
    found = containing_nodes(nodes, places).where("node_id != target_id")
    return found.select(F.col("node_id").alias("source_id"), "target_id", "edge_type", F.col("file_path").alias("location_file"), F.col("line").alias("location_start_line"), F.col("start_column").alias("location_start_column"), F.col("end_line").alias("location_end_line"), F.col("end_column").alias("location_end_column"))


def project_files(spark: SparkSession, path: str) -> DataFrame:
    """``project`` and ``file_path`` of every source file that the server's projects name, without repeats.

    A line is what the server says of its workspace: ``{"MsBuild": {"Projects": [{"Path": ..., "SourceFiles": [...]}]}}``.
    """
    schema = "MsBuild struct<Projects:array<struct<Path:string, SourceFiles:array<string>>>>"
    projects = spark.read.schema(schema).json(path).select(F.explode("MsBuild.Projects").alias("p"))
    return projects.select(F.col("p.Path").alias("project"), F.explode("p.SourceFiles").alias("file_path")).distinct()


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """Where the server says that symbols are defined: the place asked for, and ``definition_file`` with lines from 1.

    A line is one question with its answer: ``{"FileName", "Line", "Column", "Definition": {"FileName", "Range"}}``;
    an answer without a file is none.
    """
    at = "struct<Line:int, Column:int>"
    schema = f"FileName string, Line int, Column int, Definition struct<FileName:string, Range:struct<Start:{at}, End:{at}>>"
    d = spark.read.schema(schema).json(path).where("Definition.FileName is not null")
    start, end = F.col("Definition.Range.Start"), F.col("Definition.Range.End")
    return d.select(F.col("FileName").alias("file_path"), (F.col("Line") + 1).alias("line"), F.col("Column").alias("column"), F.col("Definition.FileName").alias("definition_file"), (start["Line"] + 1).alias("start_line"), start["Column"].alias("start_column"), (end["Line"] + 1).alias("end_line"), end["Column"].alias("end_column"))


def discover_solution(root: str) -> str | None:
    """The solution of a tree, or else its project: in the root (of the root's name first), one level down, or at most three."""
    own = os.path.basename(os.path.abspath(root))
    found: list[tuple[int, str, str]] = []
    for top, dirs, files in os.walk(root):
        below = os.path.relpath(top, root)
        level = 0 if below == "." else below.count(os.sep) + 1
        if level >= 3:
            dirs.clear()
        found += [(level, os.path.join(top, f), f) for f in files if f.endswith((".sln", ".csproj"))]
    for ending in (".sln", ".csproj"):
        some = [(level, name != own + ending, path) for level, path, name in found if name.endswith(ending)]
        if some:
            return min(some)[2]
    return None


def count_projects(path: str) -> int:
    """Projects that a solution names; 1 for another file, 0 for a missing one."""
    if not os.path.exists(path):
        return 0
    if not path.endswith(".sln"):
        return 1
    with open(path, encoding="utf-8", errors="replace") as f:
        return len(re.findall(r'^Project\(.*?"[^"]*\.(?:cs|fs|vb)proj"', f.read(), re.M))
