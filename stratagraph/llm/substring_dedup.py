"""Substring dedup by MinHash banding of paragraphs.

Passages are found wherever they stand: a text is cut into paragraphs where
the hash of ``WINDOW`` words is the least within ``REACH`` places on either
side.  The cuts depend on the words around them only, so that they fall alike
in all copies of a passage, and a passage of 50 words holds whole paragraphs.

A text's own paragraphs, its lines and its blocks between blank lines, are
taken next to these pieces if they have ``OWN_RUN`` words, so that near copies
of whole passages are compared as such.  The
two kinds never mix: the lowest bit of a paragraph's hash tells them apart.

Paragraphs are banded by MinHash over word shingles, equal ones among them.
Equal paragraphs are then counted as one; different ones that collide are
verified by their exact Jaccard similarity and linked.  Components of links
are classes.  Where paragraphs of classes that several documents share make up
a long enough run of words, edited places bridged, all but a class's first occurrence (by least
document id, then place) are to be removed.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratagraph.scratch import discard, materialise

from .batches import pieces
from .components import connected_components

#: Words that are hashed together for a cut, so that one very frequent word doesn't rule where cuts fall; places on
#: either side within which a cut has the least hash. 11 words decide on a cut; paragraphs have 5 to about 20.
WINDOW, REACH = 3, 4
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of one least hash each: 2 of similarity 0.8 collide with probability 1 - 0.2 ** 2 = 0.96.
BANDS = 2
#: Bands of lines and blocks, which are fewer: 3 find 1 - 0.2 ** 3 = 0.992.
OWN_BANDS = 3
#: Words that a run of repeated pieces must have, and words of the passages that are looked for: a passage of ``PASSAGE``
#: words ends within the pieces next to its run, so that a run with these has as many; lines and blocks are whole passages.
LEAST_RUN, PASSAGE, OWN_RUN = 20, 50, 40
#: Words between two repeated paragraphs that a run may bridge, if their classes' first occurrences lie alike.
GAP = 20
#: Members of a bucket that are compared in one task, and words of them; more are dealt out by pairs of chunks.
BUCKET_ROWS, BUCKET_WORDS = 500, 400_000
#: Shingles that become Python numbers at once.
VALUES = 100_000
#: Bytes of text that are cut at once, about; words whose hashes a Python worker remembers.
SLICE, MEMO = 1 << 19, 100_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_NONE = np.iinfo(np.uint64).max


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """64-bit hashes of words, worked out once each."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h


_words = _Words()


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def split_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and how many each text has.

    Words are separated by ASCII white space and compared with A-Z lower-cased.
    """
    return _hashed([_lines(t) for t in texts])


def _lines(text: str | None) -> list[list[bytes]]:
    """The words of each line of a text."""
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").lower().splitlines()]


def _hashed(texts: list[list[list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    of = _words.__getitem__
    return np.array([h for t in texts for ws in t for h in map(of, ws)], np.uint64), np.array([sum(map(len, t)) for t in texts], np.int64)


def own_paragraphs(lines: list[list[bytes]]) -> list[tuple[int, int]]:
    """First and last word of each line of a text, and of each block between blank lines where there are any."""
    spans, blocks, at, began = [], [], 0, 0
    for ws in lines:
        if ws:
            spans.append((at, at + len(ws)))
            at += len(ws)
        else:
            blocks.append((began, at))
            began = at
    if blocks:
        blocks.append((began, at))
    return sorted({(a, b) for a, b in spans + blocks if a < b})


def cut(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where paragraphs begin and end: at each text's first word, and where the hash of ``WINDOW`` words is the least around.

    Of equal ones within reach of each other the first is a cut, and then each
    that is over twice ``REACH`` words from the cut before, so that periodic
    text is cut too.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    whole = np.repeat(starts + lengths, lengths) - np.arange(n) >= WINDOW
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = _mix(mixed + np.append(hashes[k:], np.zeros(min(k, n), np.uint64)), _MIX[0])
    mixed[~whole] = _NONE
    at = np.arange(n) + REACH * (texts + 1)  # what lies between texts is greater than any
    padded = np.full(n + REACH * (len(lengths) + 1), _NONE, np.uint64)
    padded[at] = mixed
    least = whole & (mixed == _least(padded, 2 * REACH + 1)[at - REACH])
    first = least & (mixed < _least(padded, REACH)[at - REACH])
    first[starts[lengths > 0]] = True
    tied = np.flatnonzero(least & ~first)
    if len(tied):
        cuts = np.flatnonzero(first)
        last, more = -1, []
        for place, before in zip(tied.tolist(), cuts[np.searchsorted(cuts, tied) - 1].tolist()):
            last = max(last, before)
            if place - last > 2 * REACH:
                more.append(place)
                last = place
        first[more] = True
    begin = np.flatnonzero(first)
    return begin, np.append(begin[1:], n)


def _rolled(hashes: np.ndarray) -> np.ndarray:
    """A hash of each run of ``SHINGLE`` words."""
    out = np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        out = _mix(out + hashes[k : k + len(out)], _MIX[2])
    return out


def keys(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A hash of each paragraph's words, and its least shingle hash by band."""
    place = (np.arange(len(hashes)) - np.repeat(begin, end - begin)).astype(np.uint64)
    own = np.add.reduceat(_mix(hashes + place * _MIX[0], _MIX[1]), begin)
    shingles = np.concatenate([_rolled(hashes), np.full(min(len(hashes), SHINGLE - 1), _NONE, np.uint64)])
    inside = np.arange(len(hashes)) + SHINGLE <= np.repeat(end, end - begin)
    return own, [np.minimum.reduceat(np.where(inside, _mix(shingles, m), _NONE), begin) for m in _MIX[2 : 2 + BANDS]]


def own_keys(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same of lines and blocks, which may overlap, one after another."""
    words = end - begin
    flat = np.arange(words.sum()) + np.repeat(begin - (np.cumsum(words) - words), words)
    hashes = hashes[flat]
    end = np.cumsum(words)
    begin = end - words
    own = keys(hashes, begin, end)[0]
    shingles = np.concatenate([_rolled(hashes), np.full(min(len(hashes), SHINGLE - 1), _NONE, np.uint64)])
    inside = np.arange(len(hashes)) + SHINGLE <= np.repeat(end, words)
    return own, [np.minimum.reduceat(np.where(inside, _mix(shingles ^ _MIX[k], _MIX[0]), _NONE), begin) for k in range(1, 1 + OWN_BANDS)]


def _named(own: np.ndarray, kind: int) -> np.ndarray:
    """Hashes with the kind, 1 for lines and blocks, as the lowest bit."""
    return (own & ~np.uint64(1) | np.uint64(kind)).view(np.int64)


def _cut_all(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each paragraph with a shingle: ``d``, ``a`` (its hash), ``w`` (first and last word), ``e``, band keys ``m0`` and on.

    ``w`` is the first word times 2**32 and the last; ``e`` is how many words
    the pieces before and after a piece have, 63 at most, as one number.
    """
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    names = ["d", "a", "w", "e", *(f"m{k}" for k in range(OWN_BANDS))]

    def table(ids: pa.Array, owner: np.ndarray, own: np.ndarray, w0: np.ndarray, w1: np.ndarray, near: np.ndarray, bands: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(own), pa.array(w0.astype(np.int64) << 32 | w1.astype(np.int64)), pa.array(near.astype(np.int16)), *(pa.array(m.view(np.int64)) for m in bands)]
        columns += [pa.nulls(len(own), pa.int64())] * (OWN_BANDS - len(bands))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), *columns], names=names)

    def tables(ids: pa.Array, texts: list):
        lines = [_lines(t) for t in texts]
        hashes, lengths = _hashed(lines)
        if not len(hashes):
            return
        starts = np.cumsum(lengths) - lengths
        begin, end = cut(hashes, lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)[begin]
        own, bands = keys(hashes, begin, end)
        some = end - begin >= SHINGLE
        size, same = np.minimum(end - begin, 63), owner[1:] == owner[:-1]
        near = np.append(0, np.where(same, size[:-1], 0)) << 6 | np.append(np.where(same, size[1:], 0), 0)
        yield table(ids, owner[some], _named(own[some], 0), (begin - starts[owner])[some], (end - starts[owner])[some], near[some], [m[some] for m in bands])
        spans = np.array([(k, a, b) for k, t in enumerate(lines) for a, b in own_paragraphs(t) if b - a >= OWN_RUN], np.int64).reshape(-1, 3)
        if len(spans):
            owner, w0, w1 = spans.T
            own, bands = own_keys(hashes, w0 + starts[owner], w1 + starts[owner])
            yield table(ids, owner, _named(own, 1), w0, w1, np.zeros(len(owner), np.int16), bands)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 1, SLICE):
                yield from tables(piece.column(0), piece.column(1).to_pylist())

    return rows.mapInArrow(run, f"d {rows.schema['d'].dataType.simpleString()}, a long, w long, e short, " + ", ".join(f"m{k} long" for k in range(OWN_BANDS)))


def similar_links(sets: list[frozenset]) -> list[tuple[int, int]]:
    """Links that join the similar ones of some sets, as a forest.

    With members in order of how few sets have them, two sets of similarity
    0.8 share one of the first ``n - ceil(0.8 n) + 1`` of their ``n`` members,
    so that only sets that do are compared; and of the sets of a class, until
    one is similar.
    """
    often = Counter(h for s in sets for h in s)
    parent = list(range(len(sets)))
    by_first: dict[int, dict[int, list[int]]] = {}  # member, class, sets
    links = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for me, s in enumerate(sets):
        for h in sorted(s, key=lambda h: (often[h], h))[: len(s) - math.ceil(SIMILARITY * len(s) - 1e-9) + 1]:
            if often[h] == 1:
                continue
            classes = by_first.setdefault(h, {})
            for c in [c for c in classes if parent[c] != c]:
                classes.setdefault(find(c), []).extend(classes.pop(c))
            for c, members in classes.items():
                mine = find(me)
                if find(c) == mine:
                    continue
                for j in reversed(members):
                    both = len(s & sets[j])
                    if both >= SIMILARITY * (len(s) + len(sets[j]) - both) - 1e-9:
                        root = find(c)
                        links.append((root, me))
                        parent[max(root, mine)] = min(root, mine)
                        break
            classes.setdefault(find(me), []).append(me)
    return links


def _link(batches):
    """Links of paragraphs (``key``, ``i``, ``j``, ``a``, ``s``), which come in order of bucket."""
    names, sets, at = [], [], None

    def links() -> list[tuple[int, int]]:
        return [(names[x], names[y]) for x, y in similar_links(sets)]

    def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in (piece for b in batches for piece in pieces(b, 4, VALUES)):
        found = []
        for k, name, s in zip(zip(*(batch.column(c).to_pylist() for c in range(3))), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            if k != at:
                found += links()
                names, sets, at = [], [], k
            names.append(name)
            sets.append(frozenset(s))
        yield table(found)
    yield table(links())


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str, where: DataFrame) -> DataFrame:
    """``a`` and ``s`` (distinct shingle hashes) of the paragraphs ``where`` (``a``, ``d``, ``w``)."""
    spots = where.groupBy(F.col("d").alias("e")).agg(F.collect_list(F.struct("a", *_words_of("w"))).alias("p"))
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).join(spots, F.col("d").eqNullSafe(F.col("e"))).select("t", "p")

    def table(names: list, parts: list[list[bytes]]) -> pa.RecordBatch:
        of = _words.__getitem__
        hashes = np.array([h for p in parts for h in map(of, p)], np.uint64)
        end = np.cumsum([len(p) for p in parts])
        begin = np.append(0, end[:-1])
        # rows of one id may have different texts
        right = _named(keys(hashes, begin, end)[0], 0) == np.array(names, np.int64) & ~1
        inside = np.arange(len(hashes)) + SHINGLE <= np.repeat(end, end - begin)
        inside &= np.repeat(right, end - begin)
        shingles = np.append(_rolled(hashes), np.zeros(min(len(hashes), SHINGLE - 1), np.uint64))[inside].view(np.int64)
        offsets = np.append(0, np.cumsum((end - begin - SHINGLE + 1)[right])).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[right]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingles))], names=["a", "s"])

    def run(batches):
        for piece in (piece for batch in batches for piece in pieces(batch, 0, SLICE)):
            names, parts = [], []
            for t, spots in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                words = (t or "").encode("utf-8", "surrogatepass").lower().split()
                for p in spots:
                    part = words[p["w0"] : p["w1"]]
                    if len(part) == p["w1"] - p["w0"]:
                        names.append(p["a"])
                        parts.append(part)
                if len(parts) > SLICE >> 5:
                    yield table(names, parts)
                    names, parts = [], []
            if parts:
                yield table(names, parts)

    return rows.mapInArrow(run, "a long, s array<long>").dropDuplicates(["a"])


def _words_of(w: str) -> list:
    """The first and the last word of a place."""
    return [F.shiftright(w, 32).cast("int").alias("w0"), F.col(w).bitwiseAND(0xFFFFFFFF).cast("int").alias("w1")]


def _banded(cuts: DataFrame, *columns: str) -> DataFrame:
    """A row for each band, its number mixed into its key."""
    each = F.array(*[F.xxhash64(F.lit(k), f"m{k}") if k else F.col("m0") for k in range(OWN_BANDS)])
    each = F.when(F.col("m2").isNull(), F.slice(each, 1, BANDS)).otherwise(each)
    return cuts.select(*columns, F.explode(each).alias("key"))


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d``, ``w0``, ``w1``, ``class`` and ``first`` of each paragraph that documents share.

    ``class`` is the least hash of its paragraphs, ``first`` says whether the
    occurrence is the class's first, which stays.  Words are counted from 0,
    ends are exclusive.  Only runs that may be part of a passage of ``PASSAGE``
    words count, and lines and blocks of ``OWN_RUN`` words.  A
    null, empty or blank text has no paragraph.  Rows of one id are one
    document; a null id is the least.
    """
    cuts = materialise(_cut_all(docs, id_col, text_col), "cuts")
    # what shares no band with another occurrence can be left out
    often = _banded(cuts).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    often = materialise(often, "often")  # so that a hot key's rows can be split over tasks
    spots = materialise(_banded(cuts, "d", "a", "w", "e").join(often, "key").select("key", "d", "a", "w", "e"), "spots")
    discard(cuts)
    by_text = spots.groupBy("key", "a").agg(F.min(F.struct("d", "w")).alias("at"))
    mixed = spots.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low != high").select("key")
    member = by_text.join(mixed, "key").select("key", "a", "at.*")
    member = materialise(member.withColumn("n", F.col("w").bitwiseAND(0xFFFFFFFF) - F.shiftright("w", 32)), "members")
    where = member.groupBy("a").agg(F.min(F.struct("d", "w")).alias("at")).select("a", "at.*")
    sets = materialise(_shingle_sets(docs, id_col, text_col, where), "sets")
    # one bucket of those that hold the same paragraphs
    groups = member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words"), F.bit_xor(F.xxhash64("a")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "a")).alias("y"))
    chunks = F.greatest(F.ceil(F.col("n") / BUCKET_ROWS), F.ceil(F.col("words") / BUCKET_WORDS)).cast("int")
    once = groups.groupBy("n", "words", "x", "y").agg(F.min("key").alias("key")).select("key", chunks.alias("chunks"))
    dealt = member.select("a", "key").join(once, "key").withColumn("own", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("own", "p").alias("i"), F.greatest("own", "p").alias("j"), "a").join(sets, "a").select("key", "i", "j", "a", "s")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_link, "u long, v long")
    roots = connected_components(links).withColumnRenamed("node", "a")
    places = spots.select("d", "a", "w", "e").distinct().join(roots, "a", "left").select("d", *_words_of("w"), "e", F.coalesce("root", "a").alias("class"))
    places = materialise(places, "places")
    for x in (often, spots, member, sets):
        discard(x)
    shared = places.groupBy("class").agg(F.min(F.struct("d", "w0", "w1")).alias("f"), F.min(F.struct(F.coalesce(F.col("d").cast("string"), F.lit("")))).alias("x"), F.max(F.struct(F.coalesce(F.col("d").cast("string"), F.lit("")))).alias("y")).where("x != y")
    shared = materialise(shared.select("class", "f"), "shared")
    found = places.join(shared, "class")
    # runs of paragraphs that follow each other, within a document; an edit between is bridged where the firsts lie alike
    found = found.withColumn("own", F.col("class").bitwiseAND(1))
    in_doc = Window.partitionBy("d", "own").orderBy("w0", "w1")
    reached = F.coalesce(F.max("w1").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-GAP - 1))
    shift = F.col("w0") - F.col("f.w0")
    alike = F.lag("f.d").over(in_doc).eqNullSafe(F.col("f.d")) & (F.abs(shift - F.lag(shift).over(in_doc)) <= GAP)
    found = found.withColumn("reached", reached).withColumn("alike", F.coalesce(alike, F.lit(False)))
    far = F.col("w0") - F.col("reached")
    found = found.withColumn("new", (~((far <= 0) | (F.col("alike") & (far <= GAP)))).cast("int")).withColumn("run", F.sum("new").over(in_doc))
    more = F.greatest(F.col("w1") - F.greatest("w0", "reached"), F.lit(0))
    in_run = Window.partitionBy("d", "own", "run")
    around = F.max(F.when(F.col("new") == 1, F.shiftright("e", 6))).over(in_run) + F.max_by(F.col("e").bitwiseAND(63), "w1").over(in_run)
    span = F.max("w1").over(in_run) - F.min("w0").over(in_run)
    enough = F.when(F.col("own") == 1, F.col("words") >= OWN_RUN).otherwise((F.col("words") >= LEAST_RUN) & (F.col("span") + F.col("around") >= PASSAGE))
    found = found.withColumn("words", F.sum(more).over(in_run)).withColumn("span", span).withColumn("around", around).where(enough)
    # a line and its block may be of one class: what overlaps the first occurrence stays with it
    first = F.col("d").eqNullSafe(F.col("f.d")) & (F.col("w0") >= F.col("f.w0")) & (F.col("w0") < F.col("f.w1"))
    return found.select("d", "w0", "w1", "class", first.alias("first"))


def _left_over(x, covers):
    """The spans of ``x`` that none of ``covers``, in order of place, has."""
    span = lambda a, b: F.struct(a.alias("w0"), b.alias("w1"))
    none = F.array().cast("array<struct<w0:int,w1:int>>")
    upto = lambda s, a: F.when(s["at"] < a, F.concat(s["out"], F.array(span(s["at"], a)))).otherwise(s["out"])
    start = F.struct(x["w0"].alias("at"), none.alias("out"))
    return F.aggregate(covers, start, lambda s, c: F.struct(F.greatest(s["at"], c["w1"]).alias("at"), upto(s, c["w0"]).alias("out")), lambda s: upto(s, x["w1"]))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document with a repeated paragraph; spans are words, ``start:end``.

    Where repeated paragraphs overlap, a piece decides before a line or block,
    and a shorter one before a longer, so that no word is removed twice and
    what stays as a first occurrence isn't lost with a line around it.
    """
    found = repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = F.array_sort(F.collect_list(F.struct("w0", "w1", "class", "first")))
    by_doc = found.groupBy(F.col("d").alias("doc_id")).agg(rows.alias("r"))
    span = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["w0"], x["w1"])), ",")
    order = lambda x: F.struct(x["class"].bitwiseAND(1), x["w1"] - x["w0"], x["w0"], x["class"])
    before = lambda x: F.filter("r", lambda c: (c["w0"] < x["w1"]) & (c["w1"] > x["w0"]) & (order(c) < order(x)))
    whole = lambda x: F.array(F.struct(x["w0"].alias("w0"), x["w1"].alias("w1")))
    parts = F.transform(F.filter("r", lambda x: ~x["first"]), lambda x: F.when(x["class"].bitwiseAND(1) == 0, whole(x)).otherwise(_left_over(x, before(x))))
    by_doc = by_doc.withColumn("lost", F.array_sort(F.flatten(parts)))
    lost = F.col("lost")
    return by_doc.select(
        "doc_id",
        F.size("r").cast("long").alias("n_repeated"),
        F.size(lost).cast("long").alias("n_removed"),
        F.aggregate(lost, F.lit(0).cast("long"), lambda a, x: a + x["w1"] - x["w0"]).alias("n_words_removed"),
        span(F.col("r")).alias("repeated"),
        span(lost).alias("removed"),
        F.array_join(F.array_distinct(F.transform("r", lambda x: x["class"])), ",").alias("classes"),
    )
