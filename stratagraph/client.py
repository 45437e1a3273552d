"""One object for everything: index source trees, ingest profiles, ask."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.frames import FrameNormaliser, FrameParser
from .operators import correlate, graph, profiles, resolve
from .scratch import discard, materialise, scope
from .sources import repo as files
from .sources import server
from .sources.extract import Extractor, default_registry, extract_files
from .store import Store
from .streaming.ingest import store_batch

Progress = Callable[[int, int, str], None]


@dataclass
class IndexResult:
    files_indexed: int = 0
    files_skipped: int = 0
    files_failed: int = 0
    nodes_created: int = 0
    edges_created: int = 0
    errors: list[str] = field(default_factory=list)


@dataclass
class IngestResult:
    profiles_ingested: int = 0
    frames_ingested: int = 0
    frames_correlated: int = 0
    profile_ids: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


#: Errors that an index run reports at most; the count is of all.
ERRORS_SHOWN = 1000


class Client:
    """The engine over one store; ``path`` None keeps it in a folder of its own.

    Queries return frames, which nothing runs until they are read.  A
    repository is named by its path as given, made absolute if it is local.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.store = spark, Store(spark, path)
        self.registry, self.normaliser = default_registry(), FrameNormaliser()
        self.correlator = correlate.Correlator(self.store, self.normaliser)

    def register_parser(self, parser: Extractor | FrameParser) -> None:
        """Add an extractor of a language, or a parser of frame names."""
        self.normaliser.register_parser(parser) if isinstance(parser, FrameParser) else self.registry.register(parser)

    @staticmethod
    def _repo(repo: str | None) -> str:
        """"" for none, which names no repository."""
        return "" if not repo else repo if "://" in repo else os.path.abspath(repo)

    # --- indexing ---

    def index_repo(self, repo: str, *, force: bool = False, extensions: list[str] | None = None, exclude_patterns: list[str] | None = None, visibility: str = "full", progress_callback: Progress | None = None) -> IndexResult:
        """Index all files of a tree.

        ``force`` clears the repository first; else symbols are replaced by
        their ids, and what is no longer in the tree stays.  A file that can't
        be read or parsed is counted as failed and reported.
        ``progress_callback`` is called with number, total and path of each
        file once the files were extracted, in order of path.
        """
        root = self._repo(repo)
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        rows = files.read_repo(self.spark, root, extensions or self.registry.extensions, exclude_patterns)
        return self._index(root, rows, visibility, progress_callback, clear=force)

    def index_file(self, path: str, repo: str, *, language: str | None = None) -> IndexResult:
        """Index one file anew; edges from other files into it are gone with its old nodes."""
        root, full = self._repo(repo), os.path.abspath(path)
        if not os.path.exists(full):
            raise FileNotFoundError(full)
        language = language or files.language_of(full, self.registry)
        extractor = self.registry.get(language)
        if extractor is None:
            raise ValueError(f"no extractor for {language}")
        relative = os.path.relpath(full, root).replace(os.sep, "/")
        with open(full, "rb") as f:
            rows = self.spark.createDataFrame([(relative, bytearray(f.read()))], "file_path string, content binary")
        return self._index(root, rows, "full", None, relative, extractor=extractor)

    def _index(self, *given, **named) -> IndexResult:
        with scope():
            return self._indexed(*given, **named)

    def _indexed(self, root: str, rows: DataFrame, visibility: str, progress: Progress | None, only: str | None = None, clear: bool = False, extractor: Extractor | None = None) -> IndexResult:
        found = materialise(extract_files(rows, self.registry, extractor, spread=False), "extracted")  # read_repo deals files out
        counts = found.groupBy("file_path").agg(F.max((F.col("record") == "node").cast("int")).alias("some"), F.max((F.col("record") == "error").cast("int")).alias("bad"))
        counts = counts.agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("bad") == 1) & (F.col("some") == 0)).cast("int")).alias("failed")).first()
        errors = [f"{r['file_path']}: {r['message']}" for r in found.where("record = 'error'").orderBy("file_path", "ordinal").limit(ERRORS_SHOWN).collect()]
        if progress is not None:
            paths = found.where("record = 'file'").select("file_path").orderBy("file_path")
            for k, r in enumerate(paths.toLocalIterator(), 1):
                progress(k, counts["n"], f"{root}/{r['file_path']}")
        with self.store.change():  # readers see the new graph or the old one
            if only is not None:
                self.store.clear_file(only, root)
            elif clear:
                self.store.clear_repo(root)
            nodes = materialise(resolve.nodes_of(found, root, visibility == "full", self.store.last_seq), "nodes")
            self.store.put_nodes(nodes, repo_path=root)
            known = self.store.read("nodes", root).where(F.col("repo_path") == root)
            edges = materialise(resolve.edge_rows(resolve.resolve_edges(known, resolve.edges_of(found), visibility)), "edges")
            self.store.put_edges(edges, check=False, repo_path=root)
        return IndexResult(counts["n"] - (counts["failed"] or 0), 0, counts["failed"] or 0, nodes.count(), edges.count(), errors)

    def index_server_dump(self, symbols: str, usages: str | None, repo: str, *, wanted: str = "name") -> IndexResult:
        """Index what a language server said of a repository (see ``sources.server``)."""
        root = self._repo(repo)
        with self.store.change():
            self.store.clear_repo(root)
            nodes, inside = server.server_nodes(self.spark, symbols, root, wanted, self.store.last_seq)
            self.store.put_nodes(nodes, repo_path=root)
            known = self.store.read("nodes", root).where(F.col("repo_path") == root)
            edges = inside if usages is None else inside.unionByName(server.usage_edges(self.spark, usages, known, root))
            edges = materialise(edges, "edges")
            self.store.put_edges(edges, check=False, repo_path=root)
        out = IndexResult(known.select("file_path").distinct().count(), 0, 0, known.count(), edges.count())
        discard(edges)
        return out

    def clear_server_index(self, repo: str) -> int:
        """Delete what was indexed of a repository; returns how many nodes."""
        return self.store.clear_repo(self._repo(repo))

    # --- graph queries ---

    def find_callers(self, symbol: str, repo: str | None = None, *, limit: int | None = None, offset: int = 0) -> DataFrame:
        return graph.find_callers(self.store.nodes, self.store.edges, symbol, self._repo(repo), limit, offset)

    def find_callees(self, symbol: str, repo: str | None = None, *, limit: int | None = None, offset: int = 0) -> DataFrame:
        return graph.find_callees(self.store.nodes, self.store.edges, symbol, self._repo(repo), limit, offset)

    def find_references(self, symbol: str, repo: str | None = None, *, limit: int | None = None, offset: int = 0) -> DataFrame:
        return graph.find_references(self.store.nodes, self.store.edges, symbol, self._repo(repo), limit, offset)

    def get_symbol_info(self, symbol: str, repo: str | None = None, *, qualified_name: str | None = None, node_type: str | None = None) -> DataFrame:
        return graph.symbol_info(self.store.nodes, symbol, self._repo(repo), qualified_name, node_type)

    def get_import_graph(self, file_path: str, repo: str, depth: int = 1) -> DataFrame:
        return graph.import_graph(self.store.nodes, self.store.edges, file_path, self._repo(repo), depth)

    def impact_analysis(self, symbol: str, repo: str, depth: int | None = None) -> DataFrame:
        return graph.impact(self.store.nodes, self.store.edges, symbol, self._repo(repo), depth)

    def get_stats(self, repo: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and files by kind, and edges by kind; null stands for all."""
        own = self.store.read("nodes", self._repo(repo)).where(F.col("repo_path") == self._repo(repo))
        ends = own.select(F.col("id").alias("source_id"))
        return graph.node_stats(own), self.store.edges.join(ends, "source_id", "left_semi").rollup("edge_type").agg(F.count(F.lit(1)).alias("n_edges"))

    # --- profiles ---

    def ingest_profile(self, path: str | list[str], repo: str | None = None, *, metadata: dict | None = None, correlate_symbols: bool = True) -> IngestResult:
        """Read speedscope files into the store; what goes wrong is reported, not raised."""
        try:
            raw = materialise(profiles.read_speedscope(self.spark, path), "raw")
        except Exception as e:  # a missing or unreadable path
            return IngestResult(errors=[f"{type(e).__name__}: {str(e).splitlines()[0]}"])
        root = self._repo(repo) or None
        bad = raw.where(~profiles.valid(raw)).select("source_file").limit(ERRORS_SHOWN).collect()
        errors = [f"{r['source_file']}: profiles, shared or shared.frames is missing" for r in bad]
        sources = raw.where(profiles.valid(raw)).select("source_file").distinct()
        n = store_batch(self.store, raw, root, metadata)
        mine = self.store.profiles.join(sources, "source_file", "left_semi")
        own = mine.select(F.col("id").alias("profile_id"))
        ids = [r["id"] for r in mine.select("id").orderBy("id").collect()]  # all are returned: an id a profile
        frames = self.store.frames.join(own, "profile_id", "left_semi").count()
        linked = self.correlator.correlate_profiles(own, root) if correlate_symbols and root else 0
        discard(raw)
        return IngestResult(n, frames, linked, ids, errors)

    def get_profile(self, profile_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """A profile's row, its frames in order, and its statistics."""
        of = F.col("profile_id") == profile_id
        return self.store.profiles.where(F.col("id") == profile_id), self.store.frames.where(of).orderBy("frame_index"), self.store.function_stats.where(of)

    def list_profiles(self, repo: str | None = None, *, limit: int | None = None, offset: int = 0) -> DataFrame:
        return profiles.list_profiles(self.store.profiles, self._repo(repo), limit, offset)

    def delete_profile(self, profile_id: str) -> bool:
        return self.store.delete_profile(profile_id)

    def top_functions(self, profile_id: str, *, limit: int = 10, by: str = "self") -> DataFrame:
        return profiles.top_functions(self.store.function_stats, profile_id, limit, by)

    def compare_profiles(self, before: str, after: str, *, threshold_pct: float = 5.0) -> tuple[DataFrame, DataFrame] | None:
        """Summary and functions of two profiles; None unless both exist."""
        summary = profiles.compare_summary(self.store.profiles, before, after)
        return None if summary.isEmpty() else (summary, profiles.compare(self.store.function_stats, before, after, threshold_pct))

    def function_trend(self, name: str, repo: str | None = None, *, limit: int = 10) -> DataFrame:
        return profiles.function_trend(self.store.profiles, self.store.function_stats, name, self._repo(repo), limit)

    def functions_by_symbol(self, symbol_id: str, *, limit: int = 10) -> DataFrame:
        return profiles.functions_by_symbol(self.store.profiles, self.store.function_stats, symbol_id, limit)

    def hot_callers(self, symbol: str, repo: str, *, profile_id: str | None = None) -> DataFrame:
        return profiles.hot_callers(self.find_callers(symbol, repo), self.store.function_stats, profile_id)

    def search_functions(self, pattern: str, *, profile_id: str | None = None, limit: int = 50) -> DataFrame:
        return profiles.search_functions(self.store.function_stats, pattern, profile_id, limit)

    # --- correlation ---

    def correlate_frame(self, frame: str, repo: str, *, file: str | None = None, line: int | None = None, use_cache: bool = True, min_confidence: float = 0.5) -> dict | None:
        return self.correlator.correlate_frame(frame, self._repo(repo), file, line, use_cache, min_confidence)

    def get_unmapped_frames(self, profile_id: str | None = None) -> DataFrame:
        return correlate.unmapped_frames(self.store.function_stats, self.store.mappings, profile_id)

    def get_symbol_mapping(self, frame: str) -> DataFrame:
        return correlate.symbol_mapping(self.store.mappings, frame)

    def clear_correlation_cache(self) -> int:
        return self.store.clear_mappings()
