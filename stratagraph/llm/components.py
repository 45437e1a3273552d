"""Connected components of links, by random contraction in rounds.

In a round every node points at the one of itself and its neighbours whose
hash, another one each round, is least; pointers are followed once, and links
are carried over to what their ends point at.  A node with a neighbour stays
with a chance of a half at most, whatever the shape of the links, so that
rounds are few and their sizes fall geometrically.  Each round is written to
the shared folder, so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratagraph.scratch import discard, materialise


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``root`` (the least node reachable) of every linked node.

    Links may repeat, point either way or lead back to their node; links with
    a null end are none.  Nodes that are only linked to themselves are absent.
    """
    edges = links.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    edges = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    edges = materialise(edges, "links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        ranked = lambda c, k=len(maps): F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("n"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.min(ranked("v")).alias("m"))
        to = materialise(least.select("node", F.least(ranked("node"), "m")["n"].alias("to")), "pointers")
        onward = to.select(F.col("node").alias("to"), F.col("to").alias("further")).where("`to` != further")
        jumped = materialise(to.join(onward, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "jumps")
        discard(to)
        a = jumped.where("node != `to`").select(F.col("node").alias("u"), F.col("to").alias("a"))
        b = a.select(F.col("u").alias("v"), F.col("a").alias("b"))
        ends = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("a", "u").alias("x"), F.coalesce("b", "v").alias("y"))
        left = ends.where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        left = materialise(left, "links")
        discard(edges)
        edges = left
        maps.append(jumped)
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # from the last round back, so that a round's nodes are joined once
    found = maps[-1].withColumnRenamed("to", "name")
    for step in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("to"), "name")
        found = step.join(later, "to", "left").select("node", F.coalesce("name", "to").alias("name"))
    found = materialise(found, "named")
    for step in maps:
        discard(step)
    discard(edges)
    roots = materialise(found.groupBy("name").agg(F.min("node").alias("root")), "roots")
    return found.join(roots, "name").select("node", "root")
