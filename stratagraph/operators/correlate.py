"""Profile frames to graph symbols by ranked strategies, with a cache of matches.

Strategies, the first with a hit wins: place in a file, qualified name, name
and file, name and class, name alone.  Nodes are first reduced to one for each
key of a strategy, by aggregates that combine before the shuffle, so that a
frame meets one row a strategy however many nodes share its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import FIELDS, FrameNormaliser
from ..scratch import discard, materialise
from ..store import Store

#: Confidence of each way to match.
CONFIDENCE = {"exact": 1.0, "location": 0.95, "qualified_name": 0.9, "name_and_file": 0.85, "name_and_class": 0.8, "name_only": 0.7, "fuzzy": 0.6, "low": 0.5}


def match_frames(frames: DataFrame, nodes: DataFrame, repo_path: str, key: str = "name") -> DataFrame:
    """``key``, ``symbol_id``, ``confidence`` and ``match_reason`` of each frame that has a match.

    ``frames`` are normalised and distinct by ``key``.  Of several candidates
    of a strategy the first in the order of the nodes is taken.
    """
    f = frames.select(F.col(key).alias("key"), *FIELDS)
    n = nodes.where(F.col("repo_path") == repo_path).select(F.col("name").alias("function_name"), F.col("qualified_name").alias("q"), F.col("file_path"), "start_line", "end_line", F.struct("seq", "id").alias("at"))
    # only nodes that a frame may mean; those at a frame's line count whatever their name
    named = n.join(f.select("function_name").distinct(), "function_name", "left_semi")
    # Tables are merged, not broadcast: they may hold a row for each node, however small their estimates.  Names are
    # cut up only into pieces of a size that a frame of that name asks for.  Pieces are grouped by one struct, so that
    # they are combined and dealt out anew: those of a hot name needn't be in one task.
    first = lambda df, *by: df.groupBy(*by).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    wanted = lambda column, size: f.where(F.col(column).isNotNull()).groupBy("function_name").agg(F.collect_set(size).alias("sizes")).hint("merge")
    sized = lambda pieces, size: F.array_distinct(F.filter(pieces, lambda x: F.array_contains("sizes", size(x))))
    parts = lambda c: F.size(F.split(c, r"\."))
    full = named.where("q is not null")

    # a node is found by every dotted ending of its qualified name
    dotted = F.split("q", r"\.")
    tails = F.transform(F.array_intersect("sizes", F.sequence(F.lit(1), F.size(dotted))), lambda k: F.array_join(F.slice(dotted, F.size(dotted) - k + 1, k), "."))
    by_tail = full.join(wanted("qualified_name", parts("qualified_name")), "function_name").select("function_name", "q", "at", F.explode(tails).alias("qualified_name"))
    by_tail = by_tail.groupBy(F.struct("function_name", "qualified_name").alias("k")).agg(F.min(F.struct("at", (F.col("q") == F.col("qualified_name")).alias("equal"))).alias("x"))
    by_tail = by_tail.select("k.*", F.col("x.at").alias("at"), "x.equal")

    # and by its classes: runs of whole parts with a dot on either side, or any end of what stands before its name
    part_ends = F.sequence(F.lit(1), F.size(dotted) - 2)
    runs = F.flatten(F.transform(part_ends, lambda i: F.transform(F.sequence(i, F.size(dotted) - 2), lambda j: F.array_join(F.slice(dotted, i + 1, j - i + 1), "."))))
    runs = F.when(F.size(dotted) > 2, runs).otherwise(F.array().cast("array<string>"))
    before = F.substr(F.col("q"), F.lit(1), F.length("q") - F.length("function_name") - 1)
    ends = F.transform(F.filter("sizes", lambda k: (k >= 1) & (k <= F.length(before))), lambda k: F.substr(before, F.length(before) - k + 1))
    ends = F.when(F.endswith("q", F.concat(F.lit("."), "function_name")) & (F.length(before) > 0), ends).otherwise(F.array().cast("array<string>"))
    classed = full.join(wanted("class_name", F.length("class_name")), "function_name")
    in_class = first(classed.select("function_name", "at", F.explode(sized(F.concat(runs, ends), F.length)).alias("class_name")), F.struct("function_name", "class_name").alias("k")).select("k.*", "at", "n")
    class_in_file = first(classed.select("function_name", "file_path", "at", F.explode(sized(runs, F.length)).alias("class_name")), F.struct("function_name", "file_path", "class_name").alias("k")).select("k.*", "at", "n")

    at_line = first(n, "file_path", F.col("start_line").alias("line_number"))
    spot = f.where("file_path is not null and line_number is not null")
    around = spot.select("key", "file_path", "line_number", "function_name").join(named.hint("merge"), ["file_path", "function_name"]).where("line_number between start_line and end_line").groupBy("key").agg(F.min("at").alias("around"))

    def found(df: DataFrame, table: DataFrame, name: str, *by: str) -> DataFrame:
        return df.join(table.select(*by, *[F.col(c).alias(name if c == "at" else f"{name}_{c}") for c in table.columns if c not in by]).hint("merge"), list(by), "left")

    both = found(f, at_line, "line", "file_path", "line_number").join(around.hint("merge"), "key", "left")
    both = found(both, by_tail, "tail", "function_name", "qualified_name")
    both = found(both, first(named, "function_name", "file_path"), "file", "function_name", "file_path")
    both = found(both, class_in_file, "file_class", "function_name", "file_path", "class_name")
    both = found(both, in_class, "class", "function_name", "class_name")
    both = found(both, first(named, "function_name"), "any", "function_name")
    in_file = F.when(F.col("file_n") == 1, F.col("file.id")).when(F.col("file_n") > 1, F.col("file_class.id"))
    ways = [
        (F.least("line", "around")["id"], F.lit(CONFIDENCE["location"]), F.lit("Location match")),
        (F.col("tail.id"), F.when(F.col("tail_equal"), CONFIDENCE["qualified_name"]).otherwise(CONFIDENCE["name_and_file"]), F.when(F.col("tail_equal"), "Qualified name match").otherwise("Qualified name suffix match")),
        (in_file, F.lit(CONFIDENCE["name_and_file"]), F.lit("Name and file match")),
        (F.col("class.id"), F.lit(CONFIDENCE["name_and_class"]), F.lit("Name and class match")),
        (F.when(F.col("any_n") == 1, F.col("any.id")), F.lit(CONFIDENCE["name_only"]), F.lit("Unique name match")),
        (F.col("any.id"), F.lit(CONFIDENCE["fuzzy"]), F.concat(F.lit("Best guess from "), F.col("any_n").cast("string"), F.lit(" matches"))),
    ]
    best = F.coalesce(*[F.when(i.isNotNull(), F.struct(i.alias("symbol_id"), c.cast("double").alias("confidence"), r.alias("match_reason"))) for i, c, r in ways])
    return both.withColumn("m", best).where("m is not null").select(F.col("key").alias(key), "m.symbol_id", "m.confidence", "m.match_reason")


def unmapped_frames(stats: DataFrame, mappings: DataFrame, profile_id: str | None = None) -> DataFrame:
    """Distinct frame names without an entry in the cache, sorted; an entry without a symbol is one."""
    rows = stats.where(F.col("profile_id") == profile_id) if profile_id else stats
    known = mappings.select(F.col("frame_name").alias("name"))
    return rows.select("name").distinct().join(known, "name", "left_anti").orderBy("name")


def symbol_mapping(mappings: DataFrame, frame_name: str) -> DataFrame:
    """The cached mapping of a frame name, or no row."""
    return mappings.where(F.col("frame_name") == frame_name)


def symbol_mappings(mappings: DataFrame, min_confidence: float | None = None, limit: int | None = None) -> DataFrame:
    """Cached mappings, newest first."""
    rows = mappings if min_confidence is None else mappings.where(F.col("confidence") >= min_confidence)
    rows = rows.orderBy(F.desc("last_updated"), "frame_name")
    return rows if limit is None else rows.limit(limit)


class Correlator:
    """Matches frames against a store's graph and keeps the results in its cache."""

    def __init__(self, store: Store, normaliser: FrameNormaliser | None = None):
        self.store = store
        self.normaliser = normaliser or FrameNormaliser()

    def correlate_frames(self, frames: DataFrame, repo_path: str, use_cache: bool = True, min_confidence: float = 0.5) -> DataFrame:
        """``name``, ``symbol_id``, ``confidence`` and ``match_reason`` of frames (``name``, ``file``, ``line``, distinct names).

        Names in the cache keep what it says, a missing symbol included.  With
        the cache, new results go into it, misses as no symbol at confidence 0.
        """
        cached = self.store.mappings.select(F.col("frame_name").alias("name"), "symbol_id", "confidence", F.lit("Cached").alias("match_reason"))
        todo = frames.join(cached.select("name"), "name", "left_anti") if use_cache else frames
        found = match_frames(self.normaliser(todo), self.store.nodes, repo_path).where(F.col("confidence") >= min_confidence)
        if not use_cache:
            return frames.select("name").join(found, "name", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        new = todo.select("name").join(found, "name", "left")
        self.store.put_mappings(new.select(F.col("name").alias("frame_name"), "symbol_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit(None).cast("timestamp").alias("last_updated")))
        now = self.store.mappings.select(F.col("frame_name").alias("name"), "symbol_id", "confidence")
        return frames.select("name").join(now, "name").join(found.select("name", "match_reason"), "name", "left").withColumn("match_reason", F.when(F.col("symbol_id").isNotNull(), F.coalesce("match_reason", F.lit("Cached"))))

    def correlate_frame(self, name: str, repo_path: str, file: str | None = None, line: int | None = None, use_cache: bool = True, min_confidence: float = 0.5) -> dict | None:
        """One frame's symbol with its confidence, or None."""
        one = self.store.spark.createDataFrame([(name, file, line)], "name string, file string, line int")
        row = self.correlate_frames(one, repo_path, use_cache, min_confidence).where("symbol_id is not null").first()
        return row.asDict() if row else None

    def correlate_profile(self, profile_id: str, repo_path: str, use_cache: bool = True, min_confidence: float = 0.5) -> int:
        """Link a profile's statistics to symbols; returns how many frames have one.

        The first frame of a name decides for all frames of that name.
        """
        one = self.store.spark.createDataFrame([(profile_id,)], "profile_id string")
        return self.correlate_profiles(one, repo_path, use_cache, min_confidence)

    def correlate_profiles(self, profile_ids: DataFrame, repo_path: str, use_cache: bool = True, min_confidence: float = 0.5) -> int:
        """Link the statistics of any number of profiles (``profile_id``) to symbols in one job; returns how many frames have one.

        With the cache the first frame of a name decides for all of them, by
        profile id and then place; without it, for those of its profile.
        """
        frames = self.store.frames.join(profile_ids, "profile_id", "left_semi")
        first = lambda *by: frames.groupBy(*by).agg(F.min(F.struct("profile_id", "frame_index", "file", "line")).alias("f")).select("name", "f.profile_id", "f.file", "f.line")
        if use_cache:
            names = self.correlate_frames(first("name").drop("profile_id"), repo_path, True, min_confidence).where("symbol_id is not null").select("name", F.col("symbol_id").alias("found"))
            found = frames.select("profile_id", "name").distinct().join(names, "name")
        else:
            each = self.normaliser(first("profile_id", "name")).withColumn("key", F.struct("profile_id", "name"))
            found = match_frames(each, self.store.nodes, repo_path, key="key").where(F.col("confidence") >= min_confidence)
            found = found.select("key.profile_id", "key.name", F.col("symbol_id").alias("found"))
        found = materialise(found, "correlated")
        self.store.correlate_names(found)
        n = frames.join(found, ["profile_id", "name"], "left_semi").count()
        discard(found)
        return n
