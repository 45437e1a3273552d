"""A graph as a pair of frames, to be built up and handed to a store or taken from one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .operators import graph
from .store import Store


@dataclass(frozen=True)
class CodeGraph:
    nodes: DataFrame
    edges: DataFrame

    def add_nodes(self, rows: DataFrame) -> CodeGraph:
        """With more nodes; nothing is made unique here."""
        return CodeGraph(self.nodes.unionByName(rows, allowMissingColumns=True), self.edges)

    def add_edges(self, rows: DataFrame) -> CodeGraph:
        return CodeGraph(self.nodes, self.edges.unionByName(rows, allowMissingColumns=True))

    def get_node(self, node_id: str) -> DataFrame:
        return graph.get_node(self.nodes, node_id)

    def get_edges_from(self, node_id: str) -> DataFrame:
        return graph.edges_from(self.edges, node_id)

    def get_edges_to(self, node_id: str) -> DataFrame:
        return graph.edges_to(self.edges, node_id)


def to_code_graph(store: Store, repo_path: str | None = None) -> CodeGraph:
    """A repository's nodes and the edges that begin there; all of a store's for None."""
    return CodeGraph(graph.all_nodes(store.nodes, repo_path), graph.all_edges(store.nodes, store.edges, repo_path))


def from_code_graph(store: Store, g: CodeGraph, repo_path: str) -> None:
    """Put a graph into a store as a repository."""
    store.put_nodes(g.nodes.withColumn("repo_path", F.lit(repo_path)))
    store.put_edges(g.edges)


def with_location(edges: DataFrame) -> DataFrame:
    """Edges with their place as one struct, null where there is no file, and metadata as a map of strings."""
    parts = ("start_line", "start_column", "end_line", "end_column")
    place = F.struct(F.col("location_file").alias("file_path"), *[F.col(f"location_{p}").alias(p) for p in parts])
    out = edges.withColumn("location", F.when(F.col("location_file").isNotNull(), place)).drop("location_file", *[f"location_{p}" for p in parts])
    return out.withColumn("metadata", F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")))


def decoded(rows: DataFrame) -> DataFrame:
    """Nodes or profiles with their ``metadata`` as a map of strings, empty for none.

    Values that aren't strings are their JSON text.
    """
    return rows.withColumn("metadata", F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")))
