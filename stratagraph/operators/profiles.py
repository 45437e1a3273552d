"""Performance profiles: speedscope files, statistics, hot spots, trends, comparison."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .graph import page
from ..schema import ValueUnit
from ..scratch import spread_out

_FRAME = StructType([StructField("name", StringType()), StructField("file", StringType()), StructField("line", IntegerType()), StructField("col", IntegerType())])
_EVENT = StructType([StructField("type", StringType()), StructField("frame", IntegerType()), StructField("at", DoubleType())])
_PROFILE = StructType(
    [
        StructField("type", StringType()), StructField("name", StringType()), StructField("unit", StringType()),
        StructField("startValue", DoubleType()), StructField("endValue", DoubleType()),
        StructField("samples", ArrayType(ArrayType(IntegerType()))), StructField("weights", ArrayType(DoubleType())), StructField("events", ArrayType(_EVENT)),
    ]
)
SPEEDSCOPE = StructType([StructField("name", StringType()), StructField("exporter", StringType()), StructField("shared", StructType([StructField("frames", ArrayType(_FRAME))])), StructField("profiles", ArrayType(_PROFILE))])

#: Columns that statistics functions add to ``profile_id`` and ``frame_index``.
_WEIGHTS = ("self_weight", "total_weight", "call_count")


def read_speedscope(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Speedscope files as rows: ``source_file`` and the fields of ``SPEEDSCOPE``.

    A missing path is an error here already.  Files are read whole, one
    each, in parallel.
    """
    raw = spark.read.schema(SPEEDSCOPE).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("source_file"), "*")


def parse_speedscope(texts: DataFrame, json_col: str = "json", source_col: str = "source_file") -> DataFrame:
    """Speedscope documents in a string column, as ``read_speedscope`` has them."""
    return texts.select(F.col(source_col).alias("source_file"), F.from_json(json_col, SPEEDSCOPE).alias("_p")).select("source_file", "_p.*")


def checked(raw: DataFrame) -> DataFrame:
    """``raw``; rows without profiles, shared data or frames raise an error when they are read."""
    problem = F.when(F.col("profiles").isNull(), "no profiles").when(F.col("shared").isNull(), "no shared data").when(F.col("shared.frames").isNull(), "no shared frames")
    fail = F.raise_error(F.concat(F.lit("invalid speedscope data: "), problem, F.lit(" in "), F.coalesce("source_file", F.lit("?"))))
    return raw.withColumn("profiles", F.when(problem.isNotNull(), fail.cast(raw.schema["profiles"].dataType)).otherwise(F.col("profiles")))


def valid(raw: DataFrame) -> Column:
    """Whether a row of ``read_speedscope`` has all that a profile needs."""
    return F.col("profiles").isNotNull() & F.col("shared.frames").isNotNull()


def bronze_profiles(raw: DataFrame, repo_path: str | None = None, metadata: dict | None = None) -> DataFrame:
    """One row per profile with its raw samples or events and its file's frames.

    The id is a hash of source file and place, so that reading a file again
    replaces its profiles.
    """
    base = F.element_at(F.split("source_file", "/"), -1)
    rows = raw.select("source_file", F.col("shared.frames").alias("frames"), "exporter", F.posexplode("profiles").alias("place", "p"))
    own = F.coalesce(F.nullif(F.col("p.name"), F.lit("")), F.concat(F.lit("Profile "), (F.col("place") + 1).cast("string")))
    prefix = F.concat(base, F.lit(" - "))
    name = F.when(F.col("source_file").isNull() | own.startswith(prefix), own).otherwise(F.concat(prefix, own))
    unit = F.lower(F.coalesce("p.unit", F.lit("none")))
    bag = {"commit_sha": None, "scenario": None, "tags": [], "extra": {}} | (metadata or {})
    return rows.select(
        F.sha2(F.concat_ws("\x00", F.coalesce("source_file", F.lit("")), F.col("place").cast("string")), 256).alias("id"),
        name.alias("name"),
        F.when(F.col("p.type") == "evented", "evented").otherwise("sampled").alias("profile_type"),
        F.when(unit.isin(*[str(u) for u in ValueUnit]), unit).otherwise("none").alias("unit"),
        F.coalesce("p.startValue", F.lit(0.0)).alias("start_value"),
        F.coalesce("p.endValue", F.lit(0.0)).alias("end_value"),
        F.lit(repo_path).cast("string").alias("repo_path"),
        "source_file",
        F.lit(json.dumps(bag)).alias("metadata"),
        F.current_timestamp().alias("created_at"),
        "frames",
        F.col("p.samples").alias("samples"),
        F.col("p.weights").alias("weights"),
        F.col("p.events").alias("events"),
    )


def frame_rows(bronze: DataFrame, profile_name: bool = False) -> DataFrame:
    """The frames of each profile; a frame without a name is ``<unknown>``. ``profile_name`` adds the profile's name."""
    named = {"profile_name": F.col("name")} if profile_name else {}
    rows = bronze.select(F.col("id").alias("profile_id"), *[c.alias(k) for k, c in named.items()], F.posexplode("frames").alias("frame_index", "f"))
    return rows.select("profile_id", *named, "frame_index", F.coalesce("f.name", F.lit("<unknown>")).alias("name"), F.col("f.file").alias("file"), F.col("f.line").alias("line"), F.col("f.col").alias("col"))


def percentage(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent; 0 of nothing."""
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def sampled_weights(samples: DataFrame, keys: list[str], stack: str = "stack", weight: str = "weight") -> DataFrame:
    """Self weight, total weight and samples on top of each frame, by ``keys``.

    ``stack`` has frames from the bottom to the top.  A sample counts once for
    each distinct frame in it, and for the last one as self weight.  One
    shuffle: a frame's row says whether it was on top.
    """
    top = F.get(stack, F.size(stack) - 1)
    each = samples.where(F.size(stack) > 0).select(*keys, F.explode(F.transform(F.array_distinct(stack), lambda f: F.struct(f.alias("frame"), f.eqNullSafe(top).alias("on_top")))).alias("x"), F.col(weight).alias("w"))
    rows = each.select(*keys, "x.frame", "x.on_top", "w")
    return rows.groupBy(*keys, "frame").agg(
        F.sum(F.when(F.col("on_top"), F.col("w")).otherwise(F.lit(0).cast(samples.schema[weight].dataType))).alias("self_weight"),
        F.sum("w").alias("total_weight"),
        F.sum(F.col("on_top").cast("long")).alias("call_count"),
    )


def _sampled(bronze: DataFrame) -> DataFrame:
    """Weights of sampled profiles by frame; weights of another number than the samples are all 1.

    A sample is paired with its weight, and the weights are summed, before the
    samples become rows: no row of a sample holds the profile's arrays.
    """
    fit = F.size(F.coalesce("weights", F.array().cast("array<double>"))) == F.size("samples")
    # one sum a profile; without weights it is the number of samples
    whole = F.when(fit, F.aggregate("weights", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).otherwise(F.size("samples").cast("double"))
    weighed = F.transform("samples", lambda s, i: F.struct(s.alias("stack"), F.when(F.col("fit"), F.coalesce(F.get("weights", i), F.lit(0.0))).otherwise(F.lit(1.0)).alias("weight")))
    rows = bronze.where("profile_type = 'sampled' and samples is not null").select(F.col("id").alias("profile_id"), F.size("frames").alias("n_frames"), "samples", "weights", fit.alias("fit"), whole.alias("whole"))
    rows = rows.select("profile_id", "n_frames", "whole", F.explode(weighed).alias("x")).select("profile_id", "n_frames", "whole", "x.stack", "x.weight")
    found = sampled_weights(rows, ["profile_id", "n_frames", "whole"])
    return found.where("frame >= 0 and frame < n_frames").select("profile_id", F.col("frame").alias("frame_index"), *_WEIGHTS, "whole")


def run_events(events: list[tuple[str, int, float]]) -> dict[int, list[float]]:
    """Self weight, total weight and opens of each frame, by the rules of a call stack.

    A frame that opens or closes ends a stretch of self weight of the frame on
    top.  A close that isn't the top's is left out; frames that stay open get
    no total.
    """
    found: dict[int, list[float]] = {}
    stack: list[tuple[int, float]] = []
    since = 0.0
    for kind, frame, at in events:
        mine = found.setdefault(frame, [0.0, 0.0, 0])
        if kind == "O":
            if stack:
                found[stack[-1][0]][0] += at - since
            stack.append((frame, at))
            mine[2] += 1
            since = at
        elif kind == "C" and stack and stack[-1][0] == frame:
            _, opened = stack.pop()
            mine[0] += at - since
            mine[1] += at - opened
            since = at
    return found


def _evented(bronze: DataFrame) -> DataFrame:
    """Weights of evented profiles by frame: an automaton over each profile's events, many profiles at a time."""
    rows = bronze.where("profile_type = 'evented'").select("id", F.size("frames").alias("n"), (F.col("end_value") - F.col("start_value")).alias("whole"), F.col("events.type").alias("k"), F.col("events.frame").alias("f"), F.col("events.at").alias("t"))

    def run(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.k is None:
                    continue
                number = lambda x: 0 if x is None or math.isnan(x) else x
                found = run_events([(k, int(number(f)), float(number(t))) for k, f, t in zip(r.k, r.f, r.t)])
                out += [(r.id, frame, own, total, n, r.whole) for frame, (own, total, n) in found.items() if 0 <= frame < r.n]
            yield pd.DataFrame(out, columns=["profile_id", "frame_index", *_WEIGHTS, "whole"])

    return spread_out(rows, "id").mapInPandas(run, "profile_id string, frame_index int, self_weight double, total_weight double, call_count long, whole double")


def well_formed(events: DataFrame, keys: list[str], order: str = "at_pos") -> DataFrame:
    """``keys`` with ``ok``: whether the events (``kind``, ``frame``) of each form a call tree that is closed at the end."""
    paired = _paired(events, keys, order)
    return paired.groupBy(*keys).agg((F.min("depth_ok") & (F.max("open_left") == 0) & F.min("match_ok")).alias("ok"))


def _paired(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    so_far = Window.partitionBy(*keys).orderBy(order)
    step = F.when(F.col("kind") == "O", 1).otherwise(-1)
    e = events.withColumn("depth", F.sum(step).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("level", F.when(F.col("kind") == "O", F.col("depth")).otherwise(F.col("depth") + 1))
    e = e.withColumn("depth_ok", F.col("depth") >= 0).withColumn("last", F.last("depth").over(so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    e = e.withColumn("open_left", F.col("last"))
    same_level = Window.partitionBy(*keys, "level").orderBy(order)
    e = e.withColumn("before", F.lag(F.struct("kind", "frame", "at")).over(same_level))
    good = (F.col("kind") == "O") | (F.col("before.kind").eqNullSafe(F.lit("O")) & F.col("before.frame").eqNullSafe(F.col("frame")))
    return e.withColumn("match_ok", good).withColumn("ahead", F.lead("at").over(so_far))


def evented_weights(events: DataFrame, keys: list[str], order: str = "at_pos") -> DataFrame:
    """``_evented`` by windows alone, for events (``kind``, ``frame``, ``at``) that are ``well_formed``.

    Depths are running sums; a close finds its open as the row before it on
    its level; the stretch up to the next event is self weight of the frame on
    top, which is the event's own after an open, and after a close the one
    last opened a level up.
    """
    e = _paired(events, keys, order)
    total = e.where("kind = 'C'").groupBy(*keys, "frame").agg(F.sum(F.col("at") - F.col("before.at")).alias("total_weight"))
    # an event leaves ``depth`` frames open; the last open of that level so far is on top
    last = Window.partitionBy(*keys, "depth").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on_top = F.last(F.when(F.col("kind") == "O", F.col("frame")), ignorenulls=True).over(last)
    own = e.withColumn("top", on_top).where("ahead is not null and depth > 0").groupBy(*keys, F.col("top").alias("frame")).agg(F.sum(F.col("ahead") - F.col("at")).alias("self_weight"))
    count = e.groupBy(*keys, "frame").agg(F.sum((F.col("kind") == "O").cast("long")).alias("call_count"))
    out = count.join(total, [*keys, "frame"], "left").join(own, [*keys, "frame"], "left")
    return out.select(*keys, "frame", F.coalesce("self_weight", F.lit(0.0)).alias("self_weight"), F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"), "call_count")


def function_stats(bronze: DataFrame, profile_name: bool = False) -> DataFrame:
    """Statistics of every frame that a profile's samples or events name; ``profile_name`` adds the profile's name.

    Spark's estimate of what JSON holds is far too small, so that it would
    broadcast the frames of any number of profiles: they are merged.
    """
    weights = _sampled(bronze).unionByName(_evented(bronze))
    rows = weights.join(frame_rows(bronze, profile_name).drop("col").hint("merge"), ["profile_id", "frame_index"])
    return rows.select(
        *(["profile_name"] if profile_name else []),
        "profile_id", "frame_index", "name", *_WEIGHTS,
        percentage(F.col("self_weight"), F.col("whole")).alias("self_percentage"),
        percentage(F.col("total_weight"), F.col("whole")).alias("total_percentage"),
        "file", "line", F.lit(None).cast("string").alias("symbol_id"),
    )


# --- queries ---


def top_functions(stats: DataFrame, profile_id: str, limit: int = 10, by: str = "self") -> DataFrame:
    """The heaviest functions of a profile; any ``by`` but ``self`` means total weight."""
    weight = "self_weight" if by == "self" else "total_weight"
    return stats.where(F.col("profile_id") == profile_id).orderBy(F.desc(weight), "frame_index").limit(limit)


def hotspots(stats: DataFrame, profile_id: str, limit: int = 10, by: str = "self") -> DataFrame:
    """As ``top_functions``; any ``by`` but ``total`` means self weight."""
    return top_functions(stats, profile_id, limit, "total" if by == "total" else "self")


def list_profiles(profiles: DataFrame, repo_path: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Profiles, newest first."""
    rows = profiles.where(F.col("repo_path") == repo_path) if repo_path else profiles
    return page(rows.orderBy(F.desc("created_at"), "id"), limit, offset)


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(c: Column, pattern: str) -> Column:
    """LIKE with ``%`` and ``_``, blind to the case of A-Z only, without an escape character."""
    lowered = pattern.translate(str.maketrans(_UP, _LOW)).replace("\\", "\\\\")
    return F.translate(c, _UP, _LOW).like(lowered)


def search_functions(stats: DataFrame, pattern: str, profile_id: str | None = None, limit: int = 50) -> DataFrame:
    """Distinct statistics rows whose name matches, the heaviest first; without wildcard the pattern may stand anywhere."""
    rows = stats.where(F.col("profile_id") == profile_id) if profile_id else stats
    wild = "%" in pattern or "_" in pattern
    found = rows.where(like(F.col("name"), pattern if wild else f"%{pattern}%")).distinct()
    return found.orderBy(F.desc("self_weight"), "profile_id", "frame_index").limit(limit)


def function_trend(profiles: DataFrame, stats: DataFrame, name: str, repo_path: str | None = None, limit: int = 10) -> DataFrame:
    """A function's statistics over profiles, newest first; a name with ``%`` or ``_`` is a pattern."""
    named = like(F.col("name"), name) if "%" in name or "_" in name else F.col("name") == name
    p = profiles.where(F.col("repo_path") == repo_path) if repo_path else profiles
    p = p.select(F.col("id").alias("profile_id"), F.col("name").alias("profile_name"), "created_at", F.col("metadata").alias("profile_metadata"))
    return stats.where(named).join(p, "profile_id").orderBy(F.desc("created_at"), "profile_id", "frame_index").limit(limit)


def functions_by_symbol(profiles: DataFrame, stats: DataFrame, symbol_id: str, limit: int = 10) -> DataFrame:
    """Statistics that are linked to a symbol, newest profile first."""
    p = profiles.select(F.col("id").alias("profile_id"), F.col("name").alias("profile_name"), "created_at")
    return stats.where(F.col("symbol_id") == symbol_id).join(p, "profile_id").orderBy(F.desc("created_at"), "profile_id", "frame_index").limit(limit)


#: Change classes in the order of a comparison.
CHANGES = ("regression", "improvement", "new", "removed", "unchanged")


def compare(stats: DataFrame, before: str, after: str, threshold_pct: float = 5.0) -> DataFrame:
    """Functions of two profiles by name, with differences and ``change_class``.

    A name that a profile has more than once counts by its last frame.  The
    class is ``new``, ``removed``, ``regression``, ``improvement`` or
    ``unchanged``; it goes by self weight, and a weight of 0 before is neither
    worse nor better.  Regressions come first, the largest first, then
    improvements likewise, then new, removed and unchanged ones by name.
    """

    def side(profile_id: str, tag: str) -> DataFrame:
        fields = F.struct("frame_index", "file", "self_weight", "total_weight", "call_count")
        rows = stats.where(F.col("profile_id") == profile_id).groupBy("name").agg(F.max(fields).alias("x"))
        return rows.select("name", F.col("x.file").alias(f"file_{tag}"), F.lit(True).alias(f"in_{tag}"), *[F.col(f"x.{c}").alias(f"{tag}_{c.removesuffix('_weight').removeprefix('call_')}") for c in _WEIGHTS])

    both = side(before, "before").join(side(after, "after"), "name", "full_outer")
    value = lambda tag, c: F.coalesce(F.col(f"{tag}_{c}"), F.lit(0))
    pct = lambda c: F.when(value("before", c) > 0, (value("after", c) - value("before", c)) / value("before", c) * 100)
    kind = (
        F.when(F.col("in_before").isNull(), "new").when(F.col("in_after").isNull(), "removed")
        .when(pct("self") > threshold_pct, "regression").when(pct("self") < -threshold_pct, "improvement").otherwise("unchanged")
    )
    out = both.select(
        "name", F.coalesce(F.nullif("file_after", F.lit("")), "file_before").alias("file"),
        *[value(t, c).alias(f"{t}_{c}") for c in ("self", "total", "count") for t in ("before", "after")],
        *[(value("after", c) - value("before", c)).alias(f"{c}_delta") for c in ("self", "total", "count")],
        pct("self").alias("self_pct"), pct("total").alias("total_pct"), kind.alias("change_class"),
    )
    place = F.array_position(F.array(*map(F.lit, CHANGES)), F.col("change_class"))
    return out.orderBy(place, F.when(place <= 2, -F.abs("self_delta")), "name")


def compare_summary(profiles: DataFrame, before: str, after: str) -> DataFrame:
    """Durations of two profiles and their difference; no row unless both exist."""
    of = lambda i, tag: profiles.where(F.col("id") == i).select((F.col("end_value") - F.col("start_value")).alias(f"{tag}_duration"), F.lit(1).alias("k"))
    both = of(before, "before").join(of(after, "after"), "k").drop("k")
    delta = F.col("after_duration") - F.col("before_duration")
    return both.withColumns({"duration_delta": delta, "duration_pct": F.when(F.col("before_duration") > 0, delta / F.col("before_duration") * 100)})


def hot_callers(callers: DataFrame, stats: DataFrame, profile_id: str | None = None) -> DataFrame:
    """Callers with the statistics of the function of their name, or else of their qualified name; the heaviest first."""
    rows = stats.where(F.col("profile_id") == profile_id) if profile_id else stats.limit(0)
    last = rows.groupBy("name").agg(F.max(F.struct("frame_index", "self_weight", "total_weight", "call_count")).alias("s"))
    by_name = last.select("name", F.col("s").alias("by_name"))
    by_qualified = last.select(F.col("name").alias("qualified_name"), F.col("s").alias("by_qualified"))
    both = callers.join(by_name, "name", "left").join(by_qualified, "qualified_name", "left").withColumn("s", F.coalesce("by_name", "by_qualified"))
    out = both.select(*callers.columns, *[F.col(f"s.{c}").alias(c) for c in _WEIGHTS])
    return out.orderBy(F.coalesce("self_weight", F.lit(0.0)).desc(), "file_path", "start_line", "id")
