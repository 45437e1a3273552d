"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, with counts of
the next byte, learned from labelled documents of that language alone.  An
unseen byte in a context pays the escape probability ``d / (n + d)`` (``d``
distinct of ``n`` bytes seen) and is coded in the context without its first
byte; the last resort is 1/256.  Bytes that a language's documents don't have
count as one byte, which also stands before each text.  Statistics are frozen after learning, so that
a text's code length in a language is exactly the sum over its bytes of a
table's entries, and the language with the shortest code is predicted.

Any number of languages can be told apart: trees are broadcast in groups of
bounded size, and a further group is a further pass over the documents, which
keeps the best language so far.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from stratagraph.scratch import discard, materialise

from .batches import pieces
from .text import fresh

#: Labelled documents a language, by order of a hash, and bytes of them, that are learned from; whole texts.
TRAIN_DOCS, TRAIN_BYTES = 300, 1_500_000
#: Contexts of two and of three bytes that a tree keeps, each: the most frequent ones, from this count on.
MAX_CONTEXTS, MIN_COUNT = 2048, 4
ORDER = 3
#: Bytes of trees in a group, about (at least one tree); languages whose samples are on the driver at once.
GROUP_BYTES, LANGS_AT_ONCE = 96 << 20, 16
UND = "und"
#: Bytes that are scored at once.
SLICE = 1 << 20


class Tree:
    """A language's contexts.

    ``classes``: of each byte, 0 for those that weren't seen; ``near``: the
    node of the last two classes; ``far``: of that node and the class before
    them; ``bits``: of node and class.
    """

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer((b"\0" * ORDER).join([b"", *texts, b""]), np.uint8)
        seen = np.unique(joined)
        seen = seen[seen > 0]
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        a = self.size = len(seen) + 1
        stream = self.classes[joined].astype(np.int64)
        at = np.flatnonzero(stream)  # what is coded: the bytes of the texts, but for NUL
        before = [stream[at - k] for k in range(1, ORDER + 1)] if len(at) else [np.zeros(0, np.int64)] * ORDER
        symbol = stream[at]
        codes = [np.zeros(len(at), np.int64)]
        for k in range(ORDER):
            codes.append(codes[-1] + before[k] * a**k)
        # order by order: kept contexts, in the order of their codes, and the node of each coded byte's context
        kept, nodes, first = [np.zeros(1, np.int64)], [np.zeros(len(at), np.int64)], [0]
        for order in range(1, ORDER + 1):
            inside = nodes[-1] >= 0  # only contexts whose ending is kept
            found, counts = np.unique(codes[order][inside], return_counts=True)
            if order > 1:
                rank = np.argsort(-counts, kind="stable")[:MAX_CONTEXTS]
                found = np.sort(found[rank[counts[rank] >= MIN_COUNT]])
            first.append(first[-1] + len(kept[-1]))
            kept.append(found)
            place = np.searchsorted(found, codes[order])
            hit = inside & (place < len(found)) & (found[np.minimum(place, max(len(found) - 1, 0))] == codes[order] if len(found) else False)
            nodes.append(np.where(hit, first[-1] + place, -1))
        n = first[-1] + len(kept[-1])
        self.near = np.zeros(a * a, np.int32)
        ones = np.zeros(a, np.int32)
        ones[kept[1]] = first[1] + np.arange(len(kept[1]))
        self.near[:] = ones[np.arange(a * a) % a]
        self.near[kept[2]] = first[2] + np.arange(len(kept[2]))
        self.far = np.repeat(np.arange(first[3], dtype=np.int32), a)
        self.far[self.near[kept[3] % a**2].astype(np.int64) * a + kept[3] // a**2] = first[3] + np.arange(len(kept[3]))
        p = np.zeros((n, a))
        parents = [None, np.zeros(len(kept[1]), np.int64), ones[kept[2] % a], self.near[kept[3] % a**2]]
        for order in range(ORDER + 1):
            mine = nodes[order] >= 0
            rows = slice(first[order], first[order] + len(kept[order]))
            count = np.bincount((nodes[order][mine] - first[order]) * a + symbol[mine], minlength=len(kept[order]) * a).reshape(-1, a).astype(np.float64)
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            up = p[parents[order]] if order else np.full((1, a), 1 / 256)
            share = np.where(count > 0, count / np.maximum(total + kinds, 1), kinds / np.maximum(total + kinds, 1) * up)
            p[rows] = np.where(total > 0, share, up)
        self.bits = -np.log2(p, where=p > 0, out=np.zeros_like(p)).astype(np.float32).ravel()

    @property
    def nbytes(self) -> int:
        return self.near.nbytes + self.far.nbytes + self.bits.nbytes

    def costs(self, raw: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first three."""
        s = self.classes[raw]
        near = self.near[s[1:-2] * np.int32(self.size) + s[2:-1]]
        node = self.far[near * np.int32(self.size) + s[:-3]]
        return self.bits[node * np.int32(self.size) + s[3:]]


def code_lengths(trees: list[Tree], texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each tree, whole texts, slice by slice."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + ORDER) - lengths
    pad = b"\0" * ORDER
    stream = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    owner_of = np.repeat(np.arange(len(texts)), lengths + ORDER)
    total = np.zeros((len(texts), len(trees)))
    for at in range(ORDER, len(stream), SLICE):
        end = min(at + SLICE, len(stream))
        owner = owner_of[at:end]
        own = np.arange(at, end) >= starts[owner]
        owner = owner[own]
        if not len(owner):
            continue
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for j, tree in enumerate(trees):
            total[owner[cuts], j] += np.add.reduceat(tree.costs(stream[at - ORDER : end])[own], cuts, dtype=np.float64)
    return total


@dataclass
class Model:
    """Languages and their trees, broadcast in groups."""

    groups: list[tuple[list[str], Broadcast]] = field(default_factory=list)

    @property
    def langs(self) -> list[str]:
        return [x for langs, _ in self.groups for x in langs]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all languages in ``lang_col`` from at most ``TRAIN_DOCS`` documents of each.

    Documents are taken in the order of a hash, whole, until they have
    ``TRAIN_BYTES`` bytes; longer ones only where a language has no others,
    and then one.  Equal texts count once.  Documents whose ``crc32(id)``
    modulo 4 is 2 are left for testing; a null id is the empty one.
    """
    spark = docs.sparkSession
    held = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 == 2
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    labelled = labelled.withColumn("h", F.xxhash64(F.lit(5), "t")).withColumn("n", F.octet_length("t"))
    # by hash, about eight times as many as are wanted come to the ranking, however many there are
    counts = labelled.groupBy("l").agg(F.count(F.lit(1)).alias("c"))
    few = labelled.join(materialise(counts, "langs"), "l").where(F.pmod("h", F.lit(1 << 32)) < F.least(F.lit(1.0), F.lit(8.0 * TRAIN_DOCS) / F.col("c")) * F.lit(float(1 << 32)))
    few = few.groupBy("l", "h").agg(F.first("t").alias("t"), F.first("n").alias("n"))
    order = Window.partitionBy("l").orderBy((F.col("n") > TRAIN_BYTES).cast("int"), F.xxhash64("h"), "h")
    ranked = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRAIN_DOCS)
    so_far = F.coalesce(F.sum("n").over(Window.partitionBy("l").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = materialise(ranked.withColumn("before", so_far).where((F.col("before") == 0) | (F.col("before") + F.col("n") <= TRAIN_BYTES)).select("l", "k", "t"), "labelled")
    langs = sorted(r["l"] for r in chosen.select("l").distinct().collect())
    model, trees, names = Model(), [], []

    def ship() -> None:
        if trees:
            model.groups.append((list(names), spark.sparkContext.broadcast(list(trees))))
            trees.clear()
            names.clear()

    for at in range(0, len(langs), LANGS_AT_ONCE):
        some = langs[at : at + LANGS_AT_ONCE]
        texts: dict[str, list[bytes]] = {x: [] for x in some}
        for r in chosen.where(F.col("l").isin(some)).orderBy("l", "k").collect():  # bounded: TRAIN_DOCS, TRAIN_BYTES
            texts[r["l"]].append(r["t"].encode())
        for x in some:
            tree = Tree(texts.pop(x))
            if trees and sum(t.nbytes for t in trees) + tree.nbytes > GROUP_BYTES:
                ship()
            trees.append(tree)
            names.append(x)
    ship()
    discard(chosen)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """``docs`` with the predicted language, its score and its bits a byte.

    A null text, or one without letters, is ``und`` with score 0.  A model
    without languages says ``und`` to all.  Of languages with codes of one
    length the first by name is taken.  Each row stands for itself.  A name
    that ``docs`` has already gets underscores in front.
    """
    from pyspark.sql.types import StructType

    names = fresh(docs, *names)
    best, least, weight = fresh(docs, *(f"__{n}" for n in ("best", "least", "weight")))
    at = docs.columns.index(text_col)
    rows, width = docs, len(docs.columns)
    for k, (langs, trees) in enumerate(model.groups):
        schema = StructType(list(docs.schema.fields)).add(best, "string").add(least, "double").add(weight, "double")

        def run(batches, langs=langs, trees=trees, first=k == 0):
            import regex

            letter = regex.compile(r"\p{L}").search
            for b in (piece for batch in batches for piece in pieces(batch, at, SLICE)):
                texts = b.column(at).to_pylist()
                some = np.array([t is not None and letter(t) is not None for t in texts], bool)
                bits = code_lengths(trees.value, [(t if good else "").encode("utf-8", "surrogatepass") for t, good in zip(texts, some)])
                pick = bits.argmin(1)
                low = bits[np.arange(len(texts)), pick]
                mass = np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                name = np.array(langs, object)[pick]
                if not first:
                    old, old_low, old_mass = (b.column(width + i).to_pylist() for i in range(3))
                    old_low = np.array([np.inf if x is None else x for x in old_low])
                    old_mass = np.array([0.0 if x is None else x for x in old_mass])
                    new_low = np.minimum(low, old_low)
                    mass = mass * np.exp2(np.maximum(new_low - low, -1000)) + old_mass * np.exp2(np.maximum(new_low - np.where(np.isinf(old_low), new_low, old_low), -1000))
                    name = np.where(old_low <= low, np.array(old, object), name)
                    low = new_low
                extra = [pa.array(np.where(some, name, None), pa.string()), pa.array(low, pa.float64(), mask=~some), pa.array(mass, pa.float64(), mask=~some)]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *extra], names=[*b.schema.names[:width], best, least, weight])

        rows = rows.mapInArrow(run, schema)
        if k + 1 < len(model.groups):  # so that workers hold one group at a time
            rows = materialise(rows, "languages")
    if not model.groups:
        rows = docs.select("*", F.lit(None).cast("string").alias(best), F.lit(None).cast("double").alias(least), F.lit(None).cast("double").alias(weight))
    found = [F.coalesce(best, F.lit(UND)), F.coalesce(1 / F.col(weight), F.lit(0.0)), F.coalesce(F.try_divide(F.col(least), F.octet_length(F.col(f"`{text_col}`"))), F.lit(0.0))]
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(found, names)])


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, columns as they are."""
    names = fresh(docs, "lang_pred", "score", "bits_per_byte")
    return identify(docs, model, text_col, tuple(names)).where(F.col(names[0]) != UND).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
