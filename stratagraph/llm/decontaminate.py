"""Benchmark decontamination by a broadcast hash set of word n-grams.

Every run of ``n`` words of a benchmark item is a window; an item of fewer
words, but not none, is one window.  Document windows are hashed where they
stand and looked up in the broadcast set of the benchmark's hashes; only hits
leave their task, to be verified word by word.  A set that is too large for
one broadcast is looked up slice by slice, so that no number of windows makes
all positions of the documents move.  All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratagraph.scratch import materialise

from .text import alnum_words, fresh

#: Bytes of hashes that are broadcast at once, and what a hash takes in the broadcast table.
BROADCAST_BYTES, HASH_BYTES = 256 << 20, 32


def _key(hashes: Column, at: Column | int, length: int) -> Column:
    """Hash of ``length`` word hashes from ``at`` on."""
    return F.xxhash64(F.lit(length), *[F.get(hashes, F.lit(at) + k if isinstance(at, int) else at + k) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``w_id``, ``w_len``, ``w_gram``, ``w_key``), and the items of each (``w_id``, ``item``, a string).

    Items with a null or wordless text have no window.  Repeated items add
    nothing.  An item whose id is null still marks words but is not listed.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), alnum_words(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("w_len", F.least(F.size("w"), F.lit(n)))
    grams = items.select("item", "w_len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("w_len") + 1)).alias("p"))
    grams = grams.select("item", "w_len", F.slice("w", F.col("p"), F.col("w_len")).alias("w_gram")).distinct()
    hashes = F.transform("w_gram", lambda x: F.xxhash64(x))
    key = F.coalesce(*[F.when(F.col("w_len") == k, _key(hashes, 0, k)) for k in range(1, n + 1)])
    windows = materialise(grams.select("w_len", "w_gram").distinct().select(F.monotonically_increasing_id().alias("w_id"), "w_len", "w_gram", key.alias("w_key")), "windows")
    return windows, grams.where("item is not null").join(windows, ["w_len", "w_gram"]).select("w_id", "item")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, ``text_hash``, ``n_words``, ``n_hit``, ``items``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items``
    are the sorted ids (as strings) of the items with an occurring window.
    A null text has no words.  Repeated rows each get a row; rows of one id
    with different texts are told apart by ``text_hash``.  A null id is an id
    like any other.  With an empty benchmark nothing is hit.
    """
    windows, items = benchmark_windows(benchmark, n, item_col, item_text_col)
    lengths = sorted(r["w_len"] for r in windows.select("w_len").distinct().collect()) or [n]  # at most n
    slices = max(1, -(-windows.count() * HASH_BYTES // BROADCAST_BYTES))
    w = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), alnum_words(F.col(text_col)).alias("w"))
    w = w.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("nw", F.size("w"))
    # -1 stands for the document itself
    at = w.select("d", "t", "w", "h", "nw", F.explode(F.sequence(F.lit(-1), F.col("nw") - 1)).alias("p"))
    fits = lambda k: F.when((F.col("p") >= 0) & (F.col("p") + k <= F.col("nw")), _key(F.col("h"), F.col("p"), k))
    if len(lengths) == 1:
        at = at.withColumn("l", F.lit(lengths[0])).withColumn("k", fits(lengths[0]))
    else:
        each = F.array(*[F.struct(F.lit(k).alias("l"), fits(k).alias("k")) for k in lengths])
        at = at.select("d", "t", "w", "nw", "p", F.explode(each).alias("e")).select("d", "t", "w", "nw", "p", "e.l", "e.k")
        at = at.where((F.col("p") < 0) & (F.col("l") == lengths[0]) | F.col("k").isNotNull())
    gram = F.when(F.col("p") >= 0, F.slice("w", F.greatest(F.col("p") + 1, F.lit(1)), F.col("l")))

    def looked_up(s: int) -> DataFrame:
        keys = windows.select("w_key").where(F.pmod("w_key", F.lit(slices)) == s).distinct()
        some = at.where((F.pmod("k", F.lit(slices)) == s) | ((F.col("p") < 0) & F.lit(s == 0)))
        hits = some.join(F.broadcast(keys), F.col("k") == F.col("w_key"), "left")  # BROADCAST_BYTES at most
        return hits.where((F.col("p") < 0) | F.col("w_key").isNotNull()).select("d", "t", "nw", "p", "l", "k", gram.alias("g"))

    found = looked_up(0)
    for s in range(1, slices):
        found = found.unionByName(looked_up(s))
    found = materialise(found, "hits")
    # both sides are read anew for the join alone, so that adaptive execution can split a window that very many documents have
    hits = found.where("p >= 0").join(windows, (F.col("k") == F.col("w_key")) & (F.col("l") == F.col("w_len")) & (F.col("g") == F.col("w_gram"))).select("d", "t", "p", "l", "w_id")
    hits = materialise(hits, "windows-hit")
    named = hits.select("d", "t", "w_id").distinct().join(items, "w_id").select("d", "t", "item")
    null = lambda kind: F.lit(None).cast(kind)
    span = "struct<p:int,l:int>"
    rows = found.where("p < 0").select("d", "t", "nw", F.lit(1).alias("own"), null(span).alias("s"), null("string").alias("item"))
    rows = rows.unionByName(hits.select("d", "t", null("int").alias("nw"), F.lit(0).alias("own"), F.struct("p", "l").cast(span).alias("s"), null("string").alias("item")))
    rows = rows.unionByName(named.select("d", "t", null("int").alias("nw"), F.lit(0).alias("own"), null(span).alias("s"), "item"))
    by_doc = rows.groupBy("d", "t").agg(F.max("nw").alias("nw"), F.sum("own").alias("rows"), F.array_sort(F.collect_set("s")).alias("s"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    grown = lambda a, x: F.struct(F.greatest(a["end"], x["p"] + x["l"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["p"] + x["l"] - F.greatest(a["end"], x["p"]))).alias("n"))
    out = by_doc.select(
        F.col("d").alias(id_col),
        F.col("t").alias("text_hash"),
        F.col("nw").cast("long").alias("n_words"),
        F.aggregate("s", zero, grown)["n"].cast("long").alias("n_hit"),
        "items",
        F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("copy"),
    )
    return out.drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Drop the documents with a hit word; the columns stay as they are."""
    hit = find_contamination(docs, benchmark, n, id_col, text_col, item_col, item_text_col).where("n_hit > 0")
    hit = hit.select(F.col(id_col).alias("__hit_id"), F.col("text_hash").alias("__hit_text")).distinct()
    (mark,) = fresh(docs, "__text")
    kept = docs.withColumn(mark, F.xxhash64(text_col))
    return kept.join(hit, F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.col(mark) == F.col("__hit_text")), "left_anti").drop(mark)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select item_id, least(len(w), 10) as l, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from b where len(w) > 0),
g as (select distinct item_id, l, array_to_string(w[p:p + l - 1], ' ') as g from bw),
ls as (select distinct l from g),
dp as (select r, w, unnest(range(1, len(w) + 1)) as p from d),
dg as (select r, p, l, array_to_string(w[p:p + l - 1], ' ') as g from dp, ls where p + l - 1 <= len(w)),
h as (select dg.r, dg.p, dg.l, g.item_id from dg join g on dg.g = g.g and dg.l = g.l),
pos as (select r, count(*) as n_hit from (select distinct r, unnest(range(p, p + l)) as q from h) group by r),
it as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct r, item_id::varchar as item_id from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (r) left join it using (r)
"""
