"""Line dedup: lines that many documents share stay in one of them only.

Normalised lines are exploded and hashed to 128 bits, documents are counted
per hash, and the lines over the threshold are dropped by position.  All of
it is DataFrame operations; counts are combined before each shuffle.  The
frequent lines are written to the shared folder, so that both sides of the
join with them are shuffled for that join alone and adaptive execution can
split a hot key over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratagraph.scratch import materialise

from .text import SPACE_CHARS, ascii_lower, fresh, key128


def _lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


def _keys(c: Column, min_chars: int) -> Column:
    """The hash of each line's key, null where the key is too short."""

    # one transform a step, so that each step's value is named and worked out once
    chars = list(SPACE_CHARS)
    edged = lambda x: F.substring(x, 1, 1).isin(chars) | F.substring(x, -1, 1).isin(chars)
    bare = F.transform(_lines(c), lambda x: F.when(edged(x), F.btrim(x, F.lit(SPACE_CHARS))).otherwise(x))
    keys = F.transform(bare, lambda x: F.when(F.length(x) >= min_chars, ascii_lower(x)))
    return F.transform(keys, lambda x: F.when(x.isNotNull(), key128(x)))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id and ``text_hash`` that lose lines: ``positions`` (from 0)."""
    hashed = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), _keys(F.col(text_col), min_chars).alias("k"))
    each = hashed.select("d", F.explode(F.array_distinct(F.filter("k", lambda x: x.isNotNull()))).alias("k")).select("d", "k.a", "k.b")
    often = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last")).where(F.col("n") >= min_docs)
    spots = hashed.select("d", "t", F.posexplode("k").alias("p", "k")).where("k is not null").select("d", "t", "p", "k.a", "k.b")
    often = materialise(often.select("a", "b", "last"), "frequent")
    lost = spots.join(often, ["a", "b"]).where(~F.col("d").eqNullSafe(F.col("last")))
    return lost.groupBy("d", "t").agg(F.collect_set("p").alias("positions"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", stats: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the surplus lines taken out of ``text_col``.

    A line's key is the line without ASCII white space at its ends and with
    A-Z lower-cased.  Keys of ``min_chars`` code points or more that are found
    in ``min_docs`` documents lose all their lines except in the document with
    the largest id.  Each row is a document, so repeated rows count one each,
    and all rows with the largest id keep the line; a null id is the smallest.
    A null or empty text is one empty line; a null text in a row that loses
    nothing stays null.  ``stats`` names two columns to add: lines before, and
    lines dropped.
    """
    mark, at = fresh(docs, "__text", "__at")
    lost = dropped_lines(docs, min_chars, min_docs, id_col, text_col).select(F.col("d").alias("__lost_id"), F.col("t").alias("__lost_text"), F.col("positions").alias(at))
    both = docs.withColumn(mark, F.xxhash64(text_col)).join(lost, F.col(id_col).eqNullSafe(F.col("__lost_id")) & (F.col(mark) == F.col("__lost_text")), "left")
    lines = _lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    # the outer transform names the lines, so that they are split once, not once for each line
    joined = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col(at).isNull(), F.col(text_col)).otherwise(F.get(joined, F.lit(0)))
    more = {} if stats is None else {stats[0]: F.size(lines).cast("long"), stats[1]: F.when(F.col(at).isNull(), F.lit(0)).otherwise(F.size(at)).cast("long")}
    return both.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *[v.alias(k) for k, v in more.items()])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs, stats=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
with l as (select doc_id, r, unnest(range(1, len(a) + 1)) as p, unnest(a) as line from (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as a from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct r) >= 3),
m as (select k.*, f.key is not null and k.doc_id is distinct from f.last as lost from k left join f on k.key = f.key)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (not lost), '')) as kept_sha256
from m group by r
"""
