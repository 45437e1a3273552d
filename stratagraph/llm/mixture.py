"""Mixing sources to target weights.

Words are summed per source, targets follow by filling up the sources in
proportion to their weights, and every document is emitted ``floor(rate)``
times plus once more with the probability of the rest, drawn from a hash of
its id.  All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratagraph.scratch import materialise

from .text import fresh, word_count


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """Per source of ``sizes`` (``source``, ``size``): ``source_size``, ``target``.

    Sources in order of code points, null last, have the ``weights`` in turn
    and share ``percent`` of all sizes; a target stops at ``most`` times the
    source's size and the excess is shared by weight again, until none is
    above.  Equivalently a target is ``min(most * size, level * weight)``;
    the level follows from running sums in order of ``size / weight``.  The
    windows run over one row per source, summed before.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("z", F.col("source_size").cast("decimal(18,0)"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.withColumn("w", weight.cast("decimal(4,0)"))
    order = Window.orderBy(F.col("source_size") / F.col("w").cast("double"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # decimals, since products of word counts pass the range of a long
    wide = "decimal(24,0)"
    s = s.withColumns({"full": F.coalesce(F.sum("z").over(before), F.lit(0)).cast(wide) * most, "w_left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(8,0)"), "total": F.sum("z").over(every).cast(wide)})
    # 100 times what the sources from here on share; a source is full while its cap is below its share
    s = s.withColumn("left", (F.col("total") * percent - F.col("full") * 100).cast("decimal(28,0)"))
    capped = F.col("z") * (most * 100) * F.col("w_left") <= F.col("left") * F.col("w")
    s = s.withColumn("open", ~capped)
    # the level is that of the first open source, in order
    first = F.first(F.when(F.col("open"), F.struct("left", "w_left")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", first)
    target = F.when(F.col("open"), (F.col("level.left") * F.col("w")).cast("double") / (F.col("level.w_left") * 100).cast("double")).otherwise((F.col("source_size") * most).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def copies(id_col: Column, rate: Column, seed: str = "") -> Column:
    """``floor(rate)`` plus one with the probability of the rest, by the hash of the seed and the id; a null id draws as the empty one."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    u = F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(16**13))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mixture(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "") -> DataFrame:
    """One row per document: id, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken``.

    A null text has size 0, a null source is a source of its own.  A source
    without words has target 0 and is not taken.  Rows of one id share one
    draw, whatever their text.
    """
    sizes = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    targets = source_targets(sizes, weights, percent, most).withColumnRenamed("source", "s")
    both = sizes.join(targets, F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = both.withColumn("copies", copies(F.col("id"), rate, seed))
    return both.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str | None = "copy", seed: str = "") -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken.

    ``copy_col`` numbers a document's copies from 0; null leaves it out.
    """
    rates = source_targets(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), weights, percent, most)
    rates = materialise(rates.select(F.col("source").alias("__s"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate")), "rates")
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = docs.join(F.broadcast(rates) if few else rates, F.col(source_col).eqNullSafe(F.col("__s")))
    (number,) = fresh(docs, copy_col or "copy")
    n = copies(F.col(id_col), F.col("__rate"), seed)
    out = out.where(n > 0).select(*docs.columns, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias(number))
    return out if copy_col else out.drop(number)


#: A table of rates is broadcast up to this many sources.
BROADCAST_SOURCES = 50_000


def op5_mixture(spark, sf_dir: str) -> DataFrame:
    return plan_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as z from d group by source),
s1 as (select source, z, [3, 1, 2][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3]::bigint as w from s0),
s as (select *, row_number() over (order by z::double / w, encode(source) nulls last) as k, sum(z) over () as total from s1),
a as (select *, (total * 150 - 200 * coalesce(sum(z) over (order by k rows between unbounded preceding and 1 preceding), 0))::bigint as lft, (sum(w) over (order by k rows between current row and unbounded following))::bigint as wl from s),
o as (select *, not (z * 200 * wl <= lft * w) as open from a),
f as (select lft, wl from o where open order by k limit 1),
t as (select o.source, o.z, case when open then (f.lft * o.w)::double / (f.wl * 100)::double else (o.z * 2)::double end as target from o left join f on true),
m as (select d.*, t.z, t.target, case when t.z > 0 then t.target / t.z else 0 end as rate, ('0x' || substr(md5(coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 as u from d join t on d.source is not distinct from t.source)
select doc_id, size, z as source_size, target, (size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from m
"""
