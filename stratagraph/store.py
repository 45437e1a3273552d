"""Graph, profiles and correlation cache as tables of Parquet segments under one manifest.

A store is a folder.  A table is a list of segments, each a Parquet folder
that is never changed once written; an edit writes segments for what it adds
and for what is left of the segments that it takes rows from, and leaves all
others alone.  A segment may be tagged with the one repository that its rows
belong to, so that a repository is dropped without reading it.

Manifests are numbered, and the last one holds.  One manifest names the
segments of all tables, so that a change of several tables is seen whole or
not at all, and a failed job leaves no trace.  A manifest is put in place by a
rename that doesn't overwrite: of two writers that began at the same manifest
the second fails with ``ConcurrentChange``.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .schema import GRAPH_VERSION, PROFILE_VERSION, TABLES
from .scratch import discard, materialise, numbered, shared_dir

#: Segments of one tag in a table; beyond it they are written together as one.
SEGMENTS = 32
#: Ids that may be broadcast.
BROADCAST_IDS = 200_000


class ConcurrentChange(RuntimeError):
    """Another writer changed the store meanwhile; nothing was written, so the change can be made again."""


def latest(df: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """One row of each key: the one that ``by`` puts last."""
    order = Window.partitionBy(*keys).orderBy(by.desc())
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes``.

    Ids are merged: of a table of many columns the few that are read are
    estimated to be small however many rows it has, and a broadcast of them
    is held by each task.
    """
    ids = nodes.select("id").hint("merge")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def cascade(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges neither of whose ends is among the ``removed`` nodes (``id``)."""
    kept = edges.join(removed.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return kept.join(removed.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(*edges.columns)


def few_or_merged(ids: DataFrame) -> DataFrame:
    """A written table of ids: left to the planner while they are few, else merged whatever size is estimated."""
    return ids if ids.count() <= BROADCAST_IDS else ids.hint("merge")


def with_symbols(stats: DataFrame, found: DataFrame, keys: list[str], which: Column) -> DataFrame:
    """``stats`` with the symbols of ``found`` (``keys``, ``found``), where ``which`` holds and there is one."""
    both = stats.join(found, keys, "left")
    return both.withColumn("symbol_id", F.when(which, F.coalesce("found", "symbol_id")).otherwise(F.col("symbol_id"))).select(*stats.columns)


class Store:
    """The tables of ``schema.TABLES`` in a folder that all executors see; None makes one in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}").rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._open: dict | None = None
        self._check_version()

    # --- files ---

    def _text(self, name: str) -> str | None:
        at = self._path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str, replace: bool) -> bool:
        """Write aside, then rename: a reader never sees half a file. False if there is one and it isn't to be replaced."""
        jvm = self.spark._jvm
        aside, at = self._path(f"{self.path}/.{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, at, options)
        except Exception as e:
            self._fs.delete(aside, False)
            if not replace and "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _check_version(self) -> None:
        want = {"graph": GRAPH_VERSION, "profile": PROFILE_VERSION}
        text = self._text("schema.json")
        found = json.loads(text) if text else None
        if found and any(found[k] > want[k] for k in want):
            raise ValueError(f"{self.path} was written by a later version: {found}")
        if found != want:  # tables that an older version lacks are empty until written
            self._put("schema.json", json.dumps(want), True)

    # --- manifests and changes ---

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.path}/manifest")
        if not self._fs.exists(at):
            return []
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in self._fs.listStatus(at) if re.fullmatch(r"\d{12}\.json", x.getPath().getName()))

    def _current(self) -> dict:
        """The change that is being made, or else the last manifest: ``serial``, ``tables`` (``[segment, tag]`` each), ``seq``, ``edge``."""
        if self._open is not None:
            return self._open
        serials = self._manifests()
        if not serials:
            return {"serial": 0, "tables": {}, "seq": 0, "edge": 0}
        return json.loads(self._text(f"manifest/{serials[-1]:012d}.json"))

    @contextlib.contextmanager
    def change(self) -> Iterator[dict]:
        """What is done inside is seen by others at the end, all of it or nothing; a change inside another is part of it."""
        if self._open is not None:
            yield self._open
            return
        self._open = self._current()
        before = {s for t in self._open["tables"].values() for s, _ in t}
        try:
            yield self._open
            self._open["serial"] += 1
            if not self._put(f"manifest/{self._open['serial']:012d}.json", json.dumps(self._open), False):
                raise ConcurrentChange(self.path)
        except BaseException:
            for table, segments in self._open["tables"].items():
                for s, _ in segments:
                    if s not in before:
                        self._fs.delete(self._path(f"{self.path}/{table}/{s}"), True)
            raise
        finally:
            self._open = None

    def vacuum(self, hours: float = 24.0) -> int:
        """Delete segments that the last manifest doesn't name and that are older than any frame still being read; returns how many."""
        live = {s for t in self._current()["tables"].values() for s, _ in t}
        before, n = (time.time() - hours * 3600) * 1000, 0
        for table in TABLES:
            at = self._path(f"{self.path}/{table}")
            for x in self._fs.listStatus(at) if self._fs.exists(at) else ():
                if x.getPath().getName() not in live and x.getModificationTime() <= before:
                    n += self._fs.delete(x.getPath(), True)
        for serial in self._manifests()[:-1]:
            self._fs.delete(self._path(f"{self.path}/manifest/{serial:012d}.json"), False)
        return n

    # --- segments ---

    def _segments(self, table: str) -> list[list]:
        return self._current()["tables"].setdefault(table, [])

    def _read(self, table: str, segments: list[list]) -> DataFrame:
        """The rows of some segments, with the segment as ``_segment``."""
        schema = TABLES[table]
        if not segments:
            return self.spark.createDataFrame([], schema).withColumn("_segment", F.lit(None).cast("string"))
        found = self.spark.read.schema(schema).parquet(*[f"{self.path}/{table}/{s}" for s, _ in segments])
        return found.select(*schema.names, F.regexp_extract(F.col("_metadata.file_path"), rf"/{table}/([0-9a-f]{{32}})/", 1).alias("_segment"))

    def read(self, table: str, repo_path: str | None = None) -> DataFrame:
        """A table; with ``repo_path`` at least its rows, segments of other repositories being left out."""
        some = [s for s in self._segments(table) if repo_path is None or s[1] in (None, repo_path)]
        return self._read(table, some).drop("_segment")

    def _write(self, table: str, df: DataFrame) -> tuple[str, DataFrame]:
        """Write rows as a segment that no manifest names yet; returns its name and the rows as written."""
        new = uuid.uuid4().hex
        at = f"{self.path}/{table}/{new}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table]]).write.parquet(at)
        return new, self.spark.read.schema(TABLES[table]).parquet(at)

    def _append(self, table: str, df: DataFrame, tag: str | None = None) -> DataFrame:
        """Write rows as a segment; returns them as written."""
        new, written = self._write(table, df)
        self._add(table, new, tag)
        return written

    def _add(self, table: str, new: str, tag: str | None) -> None:
        """Name a segment that was written. Many segments of a tag become one."""
        with self.change():
            self._segments(table).append([new, tag])
            same = [s for s in self._segments(table) if s[1] == tag]
            if len(same) > SEGMENTS:
                self._replace(table, same, self._read(table, same).drop("_segment"), tag)

    def _replace(self, table: str, segments: list[list], rows: DataFrame | None, tag: str | None) -> None:
        """Put ``rows``, if any, in the place of some segments."""
        gone = {s for s, _ in segments}
        kept = [s for s in self._segments(table) if s[0] not in gone]
        if rows is not None:
            kept.append([self._write(table, rows)[0], tag])
        self._current()["tables"][table] = kept

    def _rewrite(self, table: str, found: Callable[[DataFrame], DataFrame] | None, into: Callable[[DataFrame], DataFrame], hit: set[str] | None = None) -> None:
        """Rewrite by ``into`` the segments that hold a row which ``found`` picks, or those of ``hit``; others aren't written.

        ``found`` keeps the column ``_segment``; what is collected are names of
        segments, of which compaction keeps few.
        """
        every = self._segments(table)
        if not every:
            return
        if hit is None:
            hit = {r["_segment"] for r in found(self._read(table, every)).select("_segment").distinct().collect()}
        for tag in sorted({t for s, t in every if s in hit}, key=lambda t: (t is not None, t)):
            some = [s for s in every if s[0] in hit and s[1] == tag]
            self._replace(table, some, into(self._read(table, some).drop("_segment")), tag)

    @property
    def nodes(self) -> DataFrame:
        return self.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.read("edges")

    @property
    def profiles(self) -> DataFrame:
        return self.read("profiles")

    @property
    def frames(self) -> DataFrame:
        return self.read("frames")

    @property
    def function_stats(self) -> DataFrame:
        return self.read("function_stats")

    @property
    def mappings(self) -> DataFrame:
        return self.read("frame_symbol_mappings")

    def _frame(self, rows: Iterable[dict] | DataFrame, table: str) -> DataFrame:
        """Rows of a table from dictionaries or a frame; absent columns are null, absent times now."""
        schema = TABLES[table]
        if isinstance(rows, DataFrame):
            df = rows
            for f in schema:
                if f.name not in df.columns:
                    df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        else:
            loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
            df = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], loose)
        for name in ("created_at", "last_updated"):
            if name in schema.names:
                df = df.withColumn(name, F.coalesce(F.col(name).cast("timestamp"), F.current_timestamp()))
        return df.select(*schema.names)

    # --- graph ---

    @property
    def last_seq(self) -> int:
        """The largest ``seq`` that a node was given so far."""
        return self._current()["seq"]

    def put_nodes(self, rows: Iterable[dict] | DataFrame, keep_edges: bool = False, repo_path: str | None = None) -> None:
        """Insert nodes, or replace those of equal id; of equal ids in ``rows`` the last ``seq`` stays.

        Replacing a node takes its edges away, in both directions, unless
        ``keep_edges`` is set.  Rows without ``seq`` come after all others.
        ``repo_path`` says that all rows are of that repository.
        """
        with self.change() as now:
            new = self._frame(rows, "nodes")
            new = new.withColumn("seq", F.coalesce(F.col("seq"), F.lit(now["seq"] + 1) + F.monotonically_increasing_id()))
            segment, new = self._write("nodes", latest(new, ["id"], F.col("seq")))
            try:
                ids = few_or_merged(new.select("id"))
                if self._segments("nodes"):
                    if not keep_edges and self._segments("edges"):
                        replaced = materialise(self.nodes.join(ids, "id", "left_semi").select("id"), "replaced")
                        self._drop_edges(replaced)
                        discard(replaced)
                    self._rewrite("nodes", lambda df: df.join(ids, "id", "left_semi"), lambda df: df.join(ids, "id", "left_anti"))
                last = new.agg(F.max("seq")).first()[0] or 0
            except BaseException:
                self._fs.delete(self._path(f"{self.path}/nodes/{segment}"), True)
                raise
            self._add("nodes", segment, repo_path)
            now["seq"] = max(now["seq"], last)

    def _drop_edges(self, removed: DataFrame) -> None:
        """Rewrite the segments of edges that touch ``removed`` (``id``, a written table), without those edges.

        The removed nodes that edges have at an end are found from ids alone
        and written; whole edges are shuffled only for an end that has any,
        and where these are few, for none.
        """
        every = self._segments("edges")
        if not every or removed.isEmpty():
            return
        edges, gone, found = self._read("edges", every), few_or_merged(removed.select("id")), {}
        for end in ("source_id", "target_id"):
            both = edges.select(end, "_segment").join(gone.withColumnRenamed("id", end), end, "left_semi")
            found[end] = materialise(both.groupBy(F.struct(end, "_segment").alias("k")).count().select("k.*"), "ends")  # one struct: a hot end's rows are combined first
        hit = {r["_segment"] for x in found.values() for r in x.select("_segment").distinct().collect()}
        ends = {end: few_or_merged(x.select(end)) for end, x in found.items() if not x.isEmpty()}

        def kept(df: DataFrame) -> DataFrame:
            for end, rows in ends.items():
                df = df.join(rows, end, "left_anti")
            return df

        self._rewrite("edges", None, kept, hit)
        for x in found.values():
            discard(x)

    def put_edges(self, rows: Iterable[dict] | DataFrame, check: bool = True, repo_path: str | None = None) -> int:
        """Append edges and number them; returns the largest number.

        An edge with an end that isn't among the nodes is refused (ValueError),
        and nothing is written.  ``repo_path`` says that all rows begin in that
        repository.
        """
        new = self._frame(rows, "edges")
        if check:
            n, good = new.count(), without_dangling(new, self.nodes).count()
            if n != good:
                raise ValueError(f"{n - good} edges have an end that is no node")
        with self.change() as now:
            written = self._append("edges", numbered(new.drop("id"), "id", now["edge"]), repo_path)
            now["edge"] = max(now["edge"], written.agg(F.max("id")).first()[0] or 0)
            return now["edge"]

    def clear_repo(self, repo_path: str) -> int:
        """Delete a repository's nodes and all edges that touch them; returns how many nodes."""
        return self._clear(F.col("repo_path") == repo_path, repo_path, True)

    def clear_file(self, file_path: str, repo_path: str) -> int:
        """Delete a file's nodes and all edges that touch them, those from other files too."""
        return self._clear((F.col("repo_path") == repo_path) & (F.col("file_path") == file_path), repo_path, False)

    def _clear(self, which: Column, repo_path: str, whole: bool) -> int:
        gone = materialise(self.read("nodes", repo_path).where(which).select("id"), "gone")
        n = gone.count()
        if n:
            with self.change():
                if whole:  # segments of the repository alone go unread
                    for table in ("edges", "nodes"):
                        self._replace(table, [s for s in self._segments(table) if s[1] == repo_path], None, None)
                self._drop_edges(gone)
                self._rewrite("nodes", lambda df: df.where(which), lambda df: df.where(~which))
        discard(gone)
        return n

    # --- profiles ---

    def put_profiles(self, profiles: Iterable[dict] | DataFrame, frames: Iterable[dict] | DataFrame, stats: Iterable[dict] | DataFrame) -> None:
        """Insert profiles with their frames and statistics, or replace those of equal id whole."""
        ids = materialise(self._frame(profiles, "profiles").select("id").distinct(), "profile-ids")
        with self.change():
            for table, rows, key in (("frames", frames, "profile_id"), ("function_stats", stats, "profile_id"), ("profiles", profiles, "id")):
                own = ids.withColumnRenamed("id", key)
                self._rewrite(table, lambda df, own=own, key=key: df.join(own, key, "left_semi"), lambda df, own=own, key=key: df.join(own, key, "left_anti"))
                self._append(table, self._frame(rows, table))
        discard(ids)

    def delete_profile(self, profile_id: str) -> bool:
        """Delete a profile with its frames and statistics; whether there was one."""
        if self.profiles.where(F.col("id") == profile_id).isEmpty():
            return False
        with self.change():
            for table, key in (("frames", "profile_id"), ("function_stats", "profile_id"), ("profiles", "id")):
                mine = F.col(key) == profile_id
                self._rewrite(table, lambda df, mine=mine: df.where(mine), lambda df, mine=mine: df.where(~mine))
        return True

    def _symbols(self, which: Column, found: DataFrame, keys: list[str]) -> int:
        """Set the symbols of the statistics where ``which`` holds and ``found`` (``keys``, ``found``) has one; returns how many rows."""
        n = self.function_stats.where(which).join(found, keys, "left_semi").count()
        if n:
            with self.change():
                self._rewrite("function_stats", lambda df: df.where(which).join(found, keys, "left_semi"), lambda df: with_symbols(df, found, keys, which))
        return n

    def correlate(self, profile_id: str, symbols: dict[int, str]) -> int:
        """Set the symbols of a profile's statistics by frame index; returns how many rows."""
        if not symbols:
            return 0
        new = self.spark.createDataFrame(list(symbols.items()), "frame_index int, found string")
        return self._symbols(F.col("profile_id") == profile_id, new, ["frame_index"])

    def correlate_names(self, found: DataFrame) -> int:
        """Set symbols of statistics by profile and name (``profile_id``, ``name``, ``found``); returns how many rows."""
        return self._symbols(F.lit(True), found, ["profile_id", "name"])

    def apply_mappings(self, profile_id: str) -> int:
        """Take over the cached symbols into a profile's statistics; returns how many rows have one."""
        known = self.mappings.where("symbol_id is not null").select(F.col("frame_name").alias("name"), F.col("symbol_id").alias("found"))
        return self._symbols(F.col("profile_id") == profile_id, known, ["name"])

    # --- correlation cache ---

    def put_mappings(self, rows: Iterable[dict] | DataFrame) -> None:
        """Insert mappings of frame names, or replace those of equal name."""
        new = self._frame(rows, "frame_symbol_mappings").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
        new = materialise(latest(new, ["frame_name"], F.struct("last_updated", "confidence", "symbol_id")), "put-mappings")
        names = new.select("frame_name")
        with self.change():
            self._rewrite("frame_symbol_mappings", lambda df: df.join(names, "frame_name", "left_semi"), lambda df: df.join(names, "frame_name", "left_anti"))
            self._append("frame_symbol_mappings", new)
        discard(new)

    def delete_mapping(self, frame_name: str) -> bool:
        mine = F.col("frame_name") == frame_name
        if self.mappings.where(mine).isEmpty():
            return False
        with self.change():
            self._rewrite("frame_symbol_mappings", lambda df: df.where(mine), lambda df: df.where(~mine))
        return True

    def clear_mappings(self) -> int:
        n = self.mappings.count()
        if n:
            with self.change():
                self._replace("frame_symbol_mappings", self._segments("frame_symbol_mappings"), None, None)
        return n
