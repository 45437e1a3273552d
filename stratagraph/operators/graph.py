"""Queries over ``nodes`` and ``edges`` frames: look-ups, callers, callees, references, closures.

All of them are lazy frames.  Ties in an order are broken by id, so that pages
are stable.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import REFERENCE_KINDS, EdgeKind
from ..scratch import materialise

#: Files of one level of a closure that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def where_given(df: DataFrame, **equal: str | None) -> DataFrame:
    """Rows equal in every column that is given; None and "" mean any."""
    tests = [F.col(k) == str(v) for k, v in equal.items() if v]
    return df.where(functools.reduce(Column.__and__, tests)) if tests else df


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows from ``offset`` on, ``limit`` of them; ``df`` is sorted."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def nodes_by_name(nodes: DataFrame, name: str, repo_path: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes of exactly this name."""
    return where_given(nodes, repo_path=repo_path, node_type=kind).where(F.col("name") == name)


def nodes_by_file(nodes: DataFrame, file_path: str, repo_path: str) -> DataFrame:
    return nodes.where((F.col("file_path") == file_path) & (F.col("repo_path") == repo_path))


def edges_from(edges: DataFrame, node_id: str, kind: str | None = None) -> DataFrame:
    return where_given(edges, edge_type=kind).where(F.col("source_id") == node_id)


def edges_to(edges: DataFrame, node_id: str, kind: str | None = None) -> DataFrame:
    return where_given(edges, edge_type=kind).where(F.col("target_id") == node_id)


def all_nodes(nodes: DataFrame, repo_path: str | None = None) -> DataFrame:
    return where_given(nodes, repo_path=repo_path)


def all_edges(nodes: DataFrame, edges: DataFrame, repo_path: str | None = None) -> DataFrame:
    """Edges that begin in a repository; any number of nodes is merged, not broadcast."""
    if not repo_path:
        return edges
    own = nodes.where(F.col("repo_path") == repo_path).select(F.col("id").alias("source_id"))
    return edges.join(own.hint("merge"), "source_id", "left_semi").select(*edges.columns)


def symbol_info(nodes: DataFrame, name: str, repo_path: str, qualified_name: str | None = None, kind: str | None = None) -> DataFrame:
    """The first node of that name, or no row."""
    found = where_given(nodes, qualified_name=qualified_name, node_type=kind).where((F.col("name") == name) & (F.col("repo_path") == repo_path))
    return found.orderBy("seq", "id").limit(1)


def _linked(nodes: DataFrame, edges: DataFrame, name: str, repo_path: str, kinds: Iterable[str], incoming: bool) -> DataFrame:
    """Distinct nodes at the other end of edges of these kinds.

    Each step is a semi join that hands on ids only, and a semi join has no
    duplicates to remove.
    """
    here, there = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    named, repo = F.col("name") == name, F.col("repo_path") == repo_path
    start = nodes.where(named if incoming else named & repo).select(F.col("id").alias(here))
    links = edges.where(F.col("edge_type").isin(*kinds)).select(here, there).join(start, here, "left_semi")
    ends = nodes.where(repo) if incoming else nodes
    return ends.join(links.select(F.col(there).alias("id")), "id", "left_semi").select(*nodes.columns)


def _by_place(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    return page(df.orderBy("file_path", "start_line", "id"), limit, offset)


def find_callers(nodes: DataFrame, edges: DataFrame, name: str, repo_path: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Nodes of the repository that call a symbol of that name, wherever it lies."""
    return _by_place(_linked(nodes, edges, name, repo_path, [EdgeKind.CALLS], True), limit, offset)


def find_callees(nodes: DataFrame, edges: DataFrame, name: str, repo_path: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Nodes, of any repository, that the repository's symbols of that name call."""
    return _by_place(_linked(nodes, edges, name, repo_path, [EdgeKind.CALLS], False), limit, offset)


def find_references(nodes: DataFrame, edges: DataFrame, name: str, repo_path: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Nodes of the repository that refer to a symbol of that name in any way."""
    return _by_place(_linked(nodes, edges, name, repo_path, REFERENCE_KINDS, True), limit, offset)


def node_stats(nodes: DataFrame, repo_path: str | None = None) -> DataFrame:
    """Nodes and distinct files by kind, and over all kinds (null), in one pass."""
    rows = where_given(nodes, repo_path=repo_path)
    by_kind = rows.groupingSets([["node_type"], []], "node_type")
    return by_kind.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file_path").alias("n_files"))


def edge_stats(nodes: DataFrame, edges: DataFrame, repo_path: str | None = None) -> DataFrame:
    """Edges by kind, and over all kinds (null)."""
    return all_edges(nodes, edges, repo_path).rollup("edge_type").agg(F.count(F.lit(1)).alias("n_edges"))


def _near(df: DataFrame, n: int) -> DataFrame:
    """A broadcast of a table of ``n`` rows, while that is few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _spread(start: DataFrame, links: DataFrame, depth: int | None) -> DataFrame:
    """Keys reachable from ``start`` (``key``) over ``links`` (``a``, ``b``) with their ``level``.

    A round is one join of the newly found keys and one anti join with those
    found before, both written to the shared folder; no key is expanded twice,
    so cycles end.
    """
    levels = [materialise(start.distinct().withColumn("level", F.lit(0)), "level")]
    while depth is None or len(levels) <= depth:
        front = levels[-1]
        n = front.count()
        if not n:
            break
        found = links.join(_near(front.select(F.col("key").alias("a")), n), "a", "left_semi").select(F.col("b").alias("key")).distinct()
        seen = functools.reduce(DataFrame.unionByName, levels).select("key")
        found = found.join(seen, "key", "left_anti")
        levels.append(materialise(found.withColumn("level", F.lit(len(levels))), "level"))
    return functools.reduce(DataFrame.unionByName, levels)


def import_graph(nodes: DataFrame, edges: DataFrame, file_path: str, repo_path: str, depth: int = 1) -> DataFrame:
    """Import edges whose file is at most ``depth`` - 1 imports away from ``file_path``; none below depth 1."""
    imports = edges.where(F.col("edge_type") == EdgeKind.IMPORTS)
    if depth < 1:
        return imports.limit(0)
    sources = nodes.where(F.col("repo_path") == repo_path).select(F.col("id").alias("source_id"), F.col("file_path").alias("a"))
    targets = nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("b"))
    links = imports.join(sources, "source_id").join(targets, "target_id").select("a", "b").where("a != b").distinct()
    if depth > 2:  # read in several rounds
        links = materialise(links, "import-links")
    first = nodes.sparkSession.createDataFrame([(file_path,)], "key string")
    files = _spread(first, links, depth - 1)
    inside = sources.join(files.select(F.col("key").alias("a")), "a", "left_semi").select("source_id")
    return imports.join(inside, "source_id", "left_semi").select(*edges.columns)


def impact(nodes: DataFrame, edges: DataFrame, name: str, repo_path: str, depth: int | None = None) -> DataFrame:
    """Nodes, of any repository, that depend on the repository's symbols of that name, over any number of references, with their distance."""
    links = edges.where(F.col("edge_type").isin(*REFERENCE_KINDS)).select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    start = nodes.where((F.col("repo_path") == repo_path) & (F.col("name") == name)).select(F.col("id").alias("key"))
    found = _spread(start, links, depth).where("level > 0")
    return nodes.join(found.select(F.col("key").alias("id"), "level"), "id")


def containing_nodes(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """For each place (``repo_path``, ``file_path``, ``line``, and what else it has) the innermost node around it.

    The node with the smallest span of lines; of equal spans the last method,
    or else the first node.  Places without a node are absent.

    A range join by bins: of nodes of one span the best is kept, and a node of
    up to 2**k lines lies in one or two bins of 2**k lines.  A place looks in
    one bin for each k that its file has, so that it meets nodes near it only,
    not all of a file.
    """
    keys = places.columns
    method = F.col("node_type") == "method"
    best = F.struct(F.when(method, 0).otherwise(1).alias("kind"), F.when(method, -F.col("seq")).otherwise(F.col("seq")).alias("seq"), F.col("id").alias("node_id"))
    lines = F.col("_to") - F.col("_from")
    n = nodes.groupBy("repo_path", "file_path", F.col("start_line").alias("_from"), F.col("end_line").alias("_to")).agg(F.min(best).alias("_best")).where("_to >= _from")
    n = n.withColumn("_k", F.ceil(F.log2((lines + 1).cast("double"))).cast("int"))
    levels = n.groupBy("repo_path", "file_path").agg(F.collect_set("_k").alias("_ks"))  # 32 at most
    bin_of = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_k"))).cast("long")
    n = n.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_from")), bin_of(F.col("_to")))))
    at = places.join(levels, ["repo_path", "file_path"]).withColumn("_k", F.explode("_ks")).withColumn("_bin", bin_of(F.col("line"))).drop("_ks")
    both = at.join(n, ["repo_path", "file_path", "_k", "_bin"]).where(F.col("line").between(F.col("_from"), F.col("_to")))
    return both.groupBy(*keys).agg(F.min(F.struct(lines.alias("span"), "_best")).alias("_m")).select(*keys, F.col("_m._best.node_id").alias("node_id"))
