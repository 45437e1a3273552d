"""SimHash near-dedup by a self-join of binary tries.

A document's fingerprint sums up the hashes of its word shingles bit by bit.
Equal fingerprints are joined into one first.  Two that differ in at most
three bits agree on one of four blocks of 16 bits at least, so each is dealt
out once for each block, by the block's value.  Where a block's value meets,
the fingerprints, turned so that the block comes first, are a binary trie
(a sorted array): pairs of nodes are traversed together from the top, and a
pair is dropped as soon as its two prefixes differ in more bits than allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratagraph.scratch import discard, materialise

from .batches import pieces
from .components import connected_components
from .text import fresh

BLOCKS, WIDTH = 4, 16
#: Fingerprints in a task of the trie join, about.
TASK_ROWS = 200_000
#: A block's value with more fingerprints than this is dealt out by pairs of chunks.
HOT_ROWS = 50_000
#: Pairs of nodes that a traversal holds at once, and pairs of leaves that are compared at once.
FRONT = 100_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(s, 42) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle))))]
    count, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):  # bits of one block of hashes at a time
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (count * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``d`` (the id), ``h`` (a hash of the text) and ``fp`` (a signed long)."""
    rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))

    def run(batches):
        for b in (piece for batch in batches for piece in pieces(batch, 2)):
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["d", "h", "fp"])

    return rows.mapInArrow(run, f"d {rows.schema['d'].dataType.simpleString()}, h long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Union-find over the places of an array; keeps the links that joined something."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = self.find(x), self.find(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)
                self.links.append((x, y))


def trie_links(values: np.ndarray, budget: int = 3, width: int = WIDTH, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what lies within ``budget`` bits and agrees on the first ``width``.

    ``values`` (uint64) are sorted and distinct.  The links are places in it
    and form a forest: as many components, not as many links, as all pairs
    would.  With ``side`` only pairs of both sides are compared.
    """
    forest = _Forest(len(values))
    if len(values) < 2:
        return []
    top = values >> np.uint64(64 - width)
    lo = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    hi = np.append(lo[1:], len(values))
    roots = hi - lo > 1
    lo, hi = lo[roots], hi[roots]
    todo = [(64 - width - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while todo:
        bit, alo, ahi, blo, bhi, err = todo.pop()
        if len(alo) > FRONT:
            h = len(alo) // 2
            todo += [(bit, *(x[:h] for x in (alo, ahi, blo, bhi, err))), (bit, *(x[h:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        # few leaves below both nodes: compare them
        small = (ahi - alo) * (bhi - blo) <= 64
        if bit < 0:
            small[:] = True
        if small.any():
            _compare(values, alo[small], ahi[small], blo[small], bhi[small], budget, side, forest)
        alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        amid, bmid = _middle(values, alo, ahi, bit), _middle(values, blo, bhi, bit)
        same = alo == blo
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err)]
        apart = err < budget
        parts.append(tuple(x[apart] for x in (alo, amid, bmid, bhi, err + 1)))
        other = apart & ~same
        parts.append(tuple(x[other] for x in (amid, ahi, blo, bmid, err + 1)))
        new = [np.concatenate(x) for x in zip(*parts)]
        some = (new[0] < new[1]) & (new[2] < new[3]) & ~((new[0] == new[2]) & (new[1] - new[0] < 2))
        todo.append((bit - 1, *(x[some] for x in new)))
    return forest.links


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the node's values begin whose ``bit`` is set."""
    low = np.uint64((1 << (bit + 1)) - 1)
    target = (values[lo] & ~low) | np.uint64(1 << bit)
    return np.clip(np.searchsorted(values, target), lo, hi)


def _compare(values, alo, ahi, blo, bhi, budget, side, forest) -> None:
    na, nb = ahi - alo, bhi - blo
    per = na * nb
    for at in range(0, len(per), FRONT // 8):
        s = slice(at, at + FRONT // 8)
        n = per[s]
        owner = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = alo[s][owner] + k // nb[s][owner], blo[s][owner] + k % nb[s][owner]
        near = (a < b) | (alo[s][owner] != blo[s][owner])
        if side is not None:
            near &= side[a] != side[b]
        a, b = a[near], b[near]
        hit = _popcount(values[a] ^ values[b]) <= budget
        forest.join(a[hit], b[hit])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` between the distinct fingerprints ``fp`` that connect what 3 bits or fewer keep apart."""
    n = fps.count()
    turned = [F.shiftleft("fp", WIDTH * b).bitwiseOR(F.shiftrightunsigned("fp", 64 - WIDTH * b)) if b else F.col("fp") for b in range(BLOCKS)]
    each = fps.select(F.posexplode(F.array(*turned)).alias("b", "x")).withColumn("key", F.shiftrightunsigned("x", 64 - WIDTH))
    hot = each.groupBy("b", "key").count().where(F.col("count") > HOT_ROWS)
    hot = materialise(hot.select("b", "key", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("chunks")), "hot")
    none = F.lit(-1)
    if hot.isEmpty():
        dealt = each.select("b", "key", "x", none.alias("i"), none.alias("j"), none.alias("own"))
    else:  # a chunk meets each other chunk, and itself, in a task of its own
        dealt = each.join(hot, ["b", "key"], "left").withColumn("own", F.when(F.col("chunks").isNull(), none).otherwise(F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int")))
        partner = F.explode(F.when(F.col("chunks").isNull(), F.array(none)).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = dealt.withColumn("p", partner).select("b", "key", "x", F.least("own", "p").alias("i"), F.greatest("own", "p").alias("j"), "own")
    tasks = max(1, -(-n * BLOCKS // TASK_ROWS), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        cols = [np.concatenate(c) for c in zip(*([b.column(i).to_numpy() for i in (0, 2, 3, 4, 5)] for b in batches))]
        if not cols:
            return
        block, x, i, j, own = cols
        x = x.view(np.uint64)
        order = np.lexsort((x, j, i, block))
        block, x, i, j, own = (c[order] for c in (block, x, i, j, own))
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)]):
            links = trie_links(x[lo:hi], side=own[lo:hi] if i[lo] != j[lo] else None)
            if links:
                at = np.array(links) + lo
                turn = int(block[lo]) * WIDTH
                back = (x >> np.uint64(turn)) | (x << np.uint64(64 - turn)) if turn else x
                yield pa.RecordBatch.from_arrays([pa.array(back[at[:, k]].view(np.int64)) for k in (0, 1)], names=["u", "v"])

    return dealt.repartition(tasks, "b", "key", "i", "j").mapInArrow(run, "u long, v long")


def _named(prints: DataFrame) -> DataFrame:
    """``fp``, ``root`` and ``least`` (the least id) of each distinct fingerprint."""
    first = prints.groupBy("fp").agg(F.min("d").alias("least"))
    roots = connected_components(fingerprint_links(prints.select("fp").distinct()))
    named = first.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    return materialise(named.select("fp", "root", "least"), "named")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` and ``component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A
    text of fewer words than a shingle is one shingle; a null, empty or blank
    text has fingerprint 0, which is linked like any other.  The component's
    id is the least document id that links reach; a null id reaches others
    but names a component only if it is alone.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "prints")
    named = _named(prints)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    out = prints.join(by_print, "fp")
    return out.select(F.col("d").alias(id_col), "fp", F.coalesce("component_id", "d").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each component of ``docs``: that of the least id, a null one only if there is no other.

    Of different texts of that id the one with the least hash stays, and of
    rows that repeat both the first by a hash of all columns.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "prints")
    named = _named(prints)
    first = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "h")).alias("x")
    stay = materialise(prints.join(named, "fp").groupBy("root").agg(first).select(F.col("x.d").alias("__d"), F.col("x.h").alias("__h")), "stay")
    discard(named)
    (mark,) = fresh(docs, "__mark")
    same = lambda few: F.col(f"`{id_col}`").eqNullSafe(F.col("__d")) & (F.col(mark) == F.col("__h"))
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    kept = marked.join(stay, same(stay), "left_semi")
    twice = prints.groupBy("d", "h").count().where("count > 1").select(F.col("d").alias("__d"), F.col("h").alias("__h"))
    twice = materialise(twice.join(stay.withColumnsRenamed({"__d": "e", "__h": "g"}), F.col("__d").eqNullSafe(F.col("e")) & (F.col("__h") == F.col("g")), "left_semi"), "twice")
    if not twice.isEmpty():  # only rows that repeat go through a window
        place, order = fresh(docs, "__place", "__order")
        again = kept.join(twice, same(twice), "left_semi").withColumn(order, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        again = again.withColumn(place, F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`"), mark).orderBy(order))).where(F.col(place) == 1)
        kept = kept.join(twice, same(twice), "left_anti").unionByName(again.drop(place, order))
    return kept.drop(mark)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
