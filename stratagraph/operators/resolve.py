"""Extracted names to ids: nodes, and edges whose ends are looked up by rank.

All nodes come first, then one job resolves every edge: left joins look each
end up by file, module and repository, and the best hit is kept.  What is
looked up in holds one node per name and file or repository, so that a join
never multiplies rows and no rows of an edge have to be brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import EDGE_KIND_OF, NODE_KIND_OF
from ..scratch import numbered

MODULE = "<module>"


def _mapped(c: Column, table: dict[str, str], other: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(c)), F.lit(other))


#: Records of a file that ``seq`` tells apart.
RECORDS = 1 << 24


def node_id(repo_path: str, file_path: Column, name: Column, line: Column) -> Column:
    """``repository/file:name:line``: files of the same relative path in two repositories have nodes of their own."""
    return F.concat_ws(":", F.concat(F.lit(f"{repo_path}/" if repo_path else ""), file_path), name, line.cast("string"))


def nodes_of(extracted: DataFrame, repo_path: str, modules: bool = True, after: int = 0) -> DataFrame:
    """Nodes from the extractors' rows, with ids (see ``node_id``) and ``seq`` in order of file and place, beyond ``after``.

    Of nodes with one id the later stays.  ``modules`` adds a node for each
    file, which stands for its top level and is named as the file is.
    """
    rows = extracted.where("record = 'node'").select(
        "file_path", "ordinal", _mapped(F.col("node_type"), NODE_KIND_OF, "variable").alias("node_type"),
        "name", "qualified_name", "signature", "docstring", "start_line", "start_column", "end_line", "end_column", "metadata",
    )
    if modules:
        files = extracted.groupBy("file_path").agg(F.max(F.coalesce("end_line", F.lit(1))).alias("end_line"))
        stem = F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
        rows = rows.unionByName(files.select(
            "file_path", F.lit(-1).alias("ordinal"), F.lit("module").alias("node_type"), stem.alias("name"), F.lit(MODULE).alias("qualified_name"),
            F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.lit(1).alias("start_line"), F.lit(0).alias("start_column"),
            "end_line", F.lit(0).alias("end_column"), F.lit(None).cast("string").alias("metadata"),
        ))
    rows = rows.withColumn("id", node_id(repo_path, F.col("file_path"), F.col("name"), F.col("start_line")))
    rows = rows.groupBy("id").agg(F.max_by(F.struct(*rows.drop("id").columns), F.col("ordinal")).alias("r")).select("id", "r.*")
    # a file's rank among files, and the place within it; merged, as estimates from a table's bytes say nothing of the nodes in its files
    files = numbered(rows.select("file_path").distinct().orderBy("file_path"), "rank", -(-after // RECORDS))
    rows = rows.join(files.hint("merge"), "file_path").withColumn("seq", F.col("rank") * F.lit(RECORDS) + F.col("ordinal") + 1)
    return rows.select("id", F.lit(repo_path).alias("repo_path"), "file_path", "node_type", "name", "qualified_name", "start_line", "start_column", "end_line", "end_column", "signature", "docstring", "metadata", "seq")


def edges_of(extracted: DataFrame) -> DataFrame:
    """Unresolved edges from the extractors' rows."""
    return extracted.where("record = 'edge'").select(
        "file_path", "ordinal", "source_name", "target_name", "target_module",
        _mapped(F.col("edge_type"), EDGE_KIND_OF, "references").alias("edge_type"), "start_line", "start_column", "end_line", "end_column", "metadata",
    )


def module_files(files: DataFrame) -> DataFrame:
    """``module`` and ``module_file``: which file a dotted module name means.

    ``a.b`` is ``a/b.py``, or else ``a/b/__init__.py``, or else either below ``src``.
    """
    path = F.col("file_path")
    src = path.startswith("src/")
    under = F.when(src, F.substr(path, F.lit(5))).otherwise(path)
    as_module = lambda p: F.translate(F.regexp_replace(p, r"(?:/__init__)?\.pyi?$", ""), "/", ".")
    package = path.endswith("/__init__.py").cast("int")
    python = files.select("file_path").distinct().where(path.endswith(".py"))
    plain = python.select(as_module(path).alias("module"), package.alias("rank"), path.alias("module_file"))
    below = python.where(src).select(as_module(under).alias("module"), (package + 2).alias("rank"), path.alias("module_file"))
    return plain.unionByName(below).groupBy("module").agg(F.min(F.struct("rank", "module_file")).alias("m")).select("module", "m.module_file")


def resolve_edges(nodes: DataFrame, edges: DataFrame, visibility: str = "full") -> DataFrame:
    """``edges`` with ``source_id`` and ``target_id``; those with an end that names nothing are left out.

    An end is looked up, in this order: the last node of the file with that
    qualified name; for ``<module>`` the file's module node and nothing else;
    for a target with a module, the first node of the module's file with that
    name or qualified name, or a qualified name that ends in it; the first
    node of the file with that name or qualified name; the first node of the
    repository with that name.  ``visibility="sequential"`` looks only at
    files up to the edge's own, in order of path.
    """
    n = nodes.select("id", "file_path", "name", "qualified_name", "seq", "node_type").withColumn("at", F.struct("seq", "id"))
    sequential = visibility == "sequential"
    # what a file offers under a name, one row each, so that a join never multiplies edges
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce(tails, F.array().cast("array<string>"))))
    offer = n.select("file_path", "at", "name", "qualified_name", F.explode(names).alias("sought")).where("sought is not null")
    whole = F.col("sought").eqNullSafe(F.col("qualified_name"))
    offer = offer.select("file_path", "sought", F.when(whole, F.col("at")).alias("own"), F.when(whole | F.col("sought").eqNullSafe(F.col("name")), F.col("at")).alias("named"), F.col("at").alias("any"))
    offer = offer.groupBy("file_path", "sought").agg(F.max("own").alias("own"), F.min("named").alias("named"), F.min("any").alias("any"))
    tops = n.where("node_type = 'module'").groupBy("file_path").agg(F.min("at").alias("own")).withColumn("sought", F.lit(MODULE))
    in_file = offer.where(F.col("sought") != MODULE).select("file_path", "sought", "own", "named").unionByName(tops, allowMissingColumns=True)
    in_module = offer.where(F.col("sought") != MODULE).select(F.col("file_path").alias("module_file"), "sought", F.col("any").alias("by_module"))
    # the first of the repository is also the first of those seen so far, if any is
    anywhere = n.where(F.col("name") != MODULE).groupBy(F.col("name").alias("sought")).agg(F.min(F.struct("seq", "id", "file_path")).alias("wide"))

    def looked_up(e: DataFrame, sought: str, found: str) -> DataFrame:
        """``e`` with what the edge's file offers by qualified name, and the best of what it and the repository offer otherwise."""
        both = e.join(in_file.withColumnRenamed("sought", sought), ["file_path", sought], "left").join(anywhere.withColumnRenamed("sought", sought), sought, "left")
        wide = F.when(F.col("wide.file_path") <= F.col("file_path"), F.col("wide.id")) if sequential else F.col("wide.id")
        return both.withColumn(f"{found}_own", F.col("own.id")).withColumn(f"{found}_rest", F.coalesce(F.col("named.id"), wide)).drop("own", "named", "wide")

    e = looked_up(edges, "source_name", "_s").withColumn("source_id", F.coalesce("_s_own", "_s_rest")).drop("_s_own", "_s_rest").where("source_id is not null")
    e = looked_up(e, "target_name", "_t")
    module = F.when(F.col("target_name") != MODULE, F.col("target_module"))
    e = e.withColumn("_module", module).join(module_files(nodes).withColumnRenamed("module", "_module"), "_module", "left")
    asked = F.col("target_name")
    if not sequential:  # of a call a.b.f() the extractor says b.f in a.b
        own_name = F.concat(F.element_at(F.split("_module", r"\."), -1), F.lit("."))
        asked = F.when(F.startswith("target_name", own_name), F.substr("target_name", F.length(own_name) + 1)).otherwise(asked)
    seen = F.col("module_file") <= F.col("file_path") if sequential else F.lit(True)
    e = e.withColumn("sought", F.when(F.col("module_file").isNotNull() & seen, asked)).join(in_module, ["module_file", "sought"], "left")
    e = e.withColumn("target_id", F.coalesce("_t_own", "by_module.id", "_t_rest")).where("target_id is not null")
    return e.select(*[c for c in edges.columns if c not in ("source_id", "target_id")], "source_id", "target_id")


def edge_rows(resolved: DataFrame) -> DataFrame:
    """Resolved edges as rows of the ``edges`` table, but for their number."""
    return resolved.select(
        F.lit(None).cast("long").alias("id"), "source_id", "target_id", "edge_type", F.col("file_path").alias("location_file"),
        F.col("start_line").alias("location_start_line"), F.col("start_column").alias("location_start_column"),
        F.coalesce("end_line", "start_line").alias("location_end_line"), F.coalesce("end_column", "start_column").alias("location_end_column"), "metadata",
    )
