"""Exact top-k inner products by best-first search of M-trees.

Inner product is no metric; with every candidate x lifted to
``(x, sqrt(m^2 - |x|^2))`` and the query to ``(q, 0)``, the largest inner
product is the smallest Euclidean distance, since ``d^2 = |q|^2 + m^2 - 2qx``.

Candidates are dealt to cells by their nearest pivot, so that a cell is a ball
around it, and each cell (or part of a large one) becomes an M-tree of pages
once: a routing object, a covering radius and the distance to the parent's
routing object.  A query is first searched in its own cell, which gives a
bound; then only in cells whose ball the bound reaches.  In a tree pages are
taken best first, and a page is left out unseen if ``|d(q, parent) - d(parent,
page)| - radius`` is already too far.  Queries that take the same page are
scored together.  Scores are computed in whole numbers; bounds have a margin
over their rounding, so that nothing is lost.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratagraph.scratch import discard, materialise

#: Vectors in a cell, about, and cells at most; vectors in a tree at most, about (larger cells have several trees).
CELL_ROWS, MAX_CELLS, TREE_ROWS = 2_500, 1_024, 2_500
#: Vectors that pivots are fitted to, by order of a hash.
SAMPLE = 4_000
#: Queries of a block; vectors on a leaf page; pages below an inner page.
QUERY_ROWS, LEAF, FANOUT = 2_000, 128, 16
_MOST = np.iinfo(np.int64).max


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as whole doubles; beyond the range of doubles the largest one."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(scale * x), posinf=np.finfo(float).max, neginf=-np.finfo(float).max)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, by floating point where that is exact; beyond 64 bits the nearest number of 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    big = np.array([[int(v) for v in row] for row in a.tolist()], object).reshape(a.shape) @ np.array([[int(v) for v in row] for row in b.tolist()], object).reshape(b.shape).T
    return np.clip(big, -_MOST - 1, _MOST).astype(np.int64)


def _apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(-1))


class Space:
    """How vectors of one length are scaled and lifted: divided by ``unit``, with the last coordinate from ``most`` (largest squared norm)."""

    def __init__(self, unit: float, most: float):
        self.unit, self.most = unit, most
        self.slack = 1e-6 * (1.0 + math.sqrt(most))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        f = x / self.unit
        return np.hstack([f, np.sqrt(np.maximum(self.most - (f * f).sum(1), 0))[:, None]])

    def asked(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x / self.unit, np.zeros((len(x), 1))])

    def reach(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far from lifted queries a vector may lie to have at least these scores (infinite for none: the least number)."""
        rest = (queries * queries).sum(1) + self.most
        near = np.sqrt(np.maximum(rest - 2.0 * (scores.astype(np.float64) / self.unit / self.unit), 0.0)) + self.slack
        return np.where(scores == -_MOST - 1, np.inf, near)


class MTree:
    """Pages over the rows of ``x`` (whole numbers), rows of a leaf side by side."""

    FIELDS = ("ids", "x", "centre", "radius", "up", "child", "row")

    def __init__(self, space: Space, ids: np.ndarray, x: np.ndarray):
        self.space = space
        lifted = space.lifted(x)
        centre, radius, up, child, row, order = [], [], [], [], [], []
        todo = [(np.arange(len(ids)), None)] if len(ids) else []
        while todo:  # breadth first, so that the children of a page are side by side
            below, at = [], len(centre) + len(todo)
            for rows, parent in todo:
                part = lifted[rows]
                mid = part[np.argmin(((part - part.mean(0)) ** 2).sum(1))]
                far = _apart(part, mid)
                centre.append(mid)
                radius.append(float(far.max()))
                up.append(0.0 if parent is None else float(_apart(mid, parent)))
                if len(rows) <= LEAF or far.max() == 0:  # few rows, or rows of one place
                    child.append((0, 0))
                    row.append((len(order), len(order) + len(rows)))
                    order += rows.tolist()
                    continue
                seeds = [int(far.argmax())]  # far apart from each other
                nearest, owner = _apart(part, part[seeds[0]]), np.zeros(len(rows), np.int64)
                for k in range(1, min(FANOUT, -(-len(rows) // LEAF) + 1)):
                    if nearest.max() == 0:
                        break
                    seeds.append(int(nearest.argmax()))
                    d = _apart(part, part[seeds[-1]])
                    owner[d < nearest] = k
                    nearest = np.minimum(nearest, d)
                parts = [rows[owner == k] for k in range(len(seeds)) if (owner == k).any()]
                child.append((at + len(below), at + len(below) + len(parts)))
                row.append((0, 0))
                below += [(p, mid) for p in parts]
            todo = below
        self.ids, self.x = ids[order], x[order]
        self.centre = np.array(centre).reshape(len(centre), x.shape[1] + 1)
        self.radius, self.up = np.array(radius), np.array(up)
        self.child, self.row = np.array(child, np.int64).reshape(-1, 2), np.array(row, np.int64).reshape(-1, 2)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, space: Space, blob: bytes) -> MTree:
        tree = cls.__new__(cls)
        tree.space = space
        with np.load(io.BytesIO(blob), allow_pickle=False) as found:
            for f in cls.FIELDS:
                setattr(tree, f, found[f])
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which query, id and score of the k best rows of each query whose id isn't ``own``: by score, then by smaller id.

        Rows that score less than ``least`` may be left out.
        """
        best = _Best(len(queries), k, least)
        if not len(self.ids) or not len(queries):
            return best.result()
        space, lifted = self.space, self.space.asked(queries)
        every = np.arange(len(queries))
        if least is None:  # down to the nearest leaf, for a first bound
            at = np.zeros(len(queries), np.int64)
            while (inner := np.flatnonzero(self.child[at, 1] > self.child[at, 0])).size:
                for p in np.unique(at[inner]):
                    mine, (a, b) = inner[at[inner] == p], self.child[p]
                    d = np.stack([_apart(lifted[mine], c) for c in self.centre[a:b]])
                    at[mine] = a + d.argmin(0)
            for p in np.unique(at):
                self._score(p, every[at == p], queries, own, best)
            done = at
        else:
            done = np.full(len(queries), -1)
        reach = space.reach(lifted, best.least)
        pages, asked, bounds = [], [], []
        todo = [(0, every, _apart(lifted, self.centre[0]))]
        while todo:
            p, mine, d = todo.pop()
            low = d - self.radius[p] - space.slack
            near = low <= reach[mine]
            mine, d, low = mine[near], d[near], low[near]
            if not len(mine):
                continue
            a, b = self.child[p]
            if a == b:
                new = done[mine] != p
                pages.append(np.full(new.sum(), p))
                asked.append(mine[new])
                bounds.append(low[new])
                continue
            for c in range(a, b):
                some = np.abs(d - self.up[c]) - self.radius[c] - space.slack <= reach[mine]  # no distance needed
                if some.any():
                    todo.append((c, mine[some], _apart(lifted[mine[some]], self.centre[c])))
        if not pages:
            return best.result()
        pages, asked, bounds = map(np.concatenate, (pages, asked, bounds))
        # each query's pages best first, some more in each round
        order = np.lexsort((bounds, asked))
        pages, asked, bounds = pages[order], asked[order], bounds[order]
        place = np.arange(len(asked)) - np.searchsorted(asked, asked)
        at, to = 0, 1
        while at <= place.max(initial=-1):
            reach = space.reach(lifted, best.least)
            now = (place >= at) & (place < to) & (bounds <= reach[asked])
            turn, who = pages[now], asked[now]
            by_page = np.argsort(turn, kind="stable")
            turn, who = turn[by_page], who[by_page]
            cuts = np.flatnonzero(np.diff(turn)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(turn)]):
                if lo < hi:
                    self._score(turn[lo], who[lo:hi], queries, own, best)
            at, to = to, to * 4
        return best.result()

    def _score(self, page: int, mine: np.ndarray, queries: np.ndarray, own: np.ndarray, best: _Best) -> None:
        lo, hi = self.row[page]
        scores, ids = _exact(queries[mine], self.x[lo:hi]), self.ids[lo:hi]
        q, r = np.nonzero((scores >= best.least[mine][:, None]) & (ids[None, :] != own[mine][:, None]))
        best.take(mine[q], ids[r], scores[q, r])


class _Best:
    """The k best of each query so far; ``least``: the score from which a row can still be among them."""

    def __init__(self, n: int, k: int, least: np.ndarray | None):
        self.k = k
        self.least = np.full(n, -_MOST - 1) if least is None else least.copy()
        self.q, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def take(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.zeros(len(self.least), bool)
        touched[q] = True
        old = touched[self.q]
        q, ids, scores = np.append(self.q[old], q), np.append(self.ids[old], ids), np.append(self.scores[old], scores)
        order = np.lexsort((ids, ~scores, q))  # ~x falls as x grows, and can't overflow
        q, ids, scores = q[order], ids[order], scores[order]
        new = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1]))
        q, ids, scores = q[new], ids[new], scores[new]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], scores[full])
        top = place < self.k
        self.q, self.ids, self.scores = (np.append(a[~old], b[top]) for a, b in ((self.q, q), (self.ids, ids), (self.scores, scores)))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.q, self.ids, self.scores


def fit_pivots(x: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Centres of a sample: seeds drawn with the square of the distance to those before, then moved to the mean of what is nearest."""
    r = np.random.default_rng(seed)
    pivots = [x[0]]
    nearest = ((x - x[0]) ** 2).sum(1)
    while len(pivots) < count and nearest.sum() > 0:
        pivots.append(x[r.choice(len(x), p=nearest / nearest.sum())])
        nearest = np.minimum(nearest, ((x - pivots[-1]) ** 2).sum(1))
    p = np.array(pivots)
    for _ in range(4):
        owner = _nearest(x, p)[0]
        p = np.array([x[owner == k].mean(0) if (owner == k).any() else p[k] for k in range(len(p))])
    return p


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and how far it is."""
    owner = ((pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T).argmin(1)
    return owner, _apart(x, pivots[owner])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, id and ``score`` of the k best rows for each row where ``queries`` holds.

    Components count as ``floor(scale * x)``.  Rows whose vector is null or
    holds a null or a component that isn't finite take no part, nor do rows
    without an id or with an empty vector.  A query meets vectors of its own
    length only, and never a row of its own id; repeated rows with one id and
    vector count once.  Ties go to smaller ids.  A score beyond 64 bits is the
    nearest number of 64 bits.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(v, lambda x: x.cast("double"))).alias("x"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.where("id is not null and x is not null").withColumn("dim", F.size("x"))
    wide = F.transform("x", lambda x: F.abs(x) * float(scale) + 1)
    found = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(wide)).alias("unit"), F.max(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)).alias("most")).collect()  # a row for each length of vectors
    spaces, cells = {}, {}
    for r in found:
        unit = min(r["unit"], float(np.finfo(float).max))
        most = r["most"] / unit / unit if math.isfinite(r["most"]) else float(r["dim"])
        spaces[r["dim"]] = Space(unit, most * (1 + 1e-9))
        cells[r["dim"]] = min(MAX_CELLS, max(1, r["n"] // CELL_ROWS))
    share = F.coalesce(*[F.when(F.col("dim") == r["dim"], F.lit(min(1.0, 4.0 * SAMPLE / r["n"]))) for r in found], F.lit(0.0))
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    some = rows.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 32)) < share * F.lit(float(1 << 32))).withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= SAMPLE)
    sample: dict[int, list] = {}
    for r in some.select("dim", "x").collect():  # bounded: SAMPLE a length
        sample.setdefault(r["dim"], []).append(r["x"])
    pivots = {}
    for dim, space in spaces.items():
        x = np.array(sample.pop(dim, [[0.0] * dim]))
        pivots[dim] = fit_pivots(space.lifted(whole(x, scale)), cells[dim])
    known = spark.sparkContext.broadcast((spaces, pivots))  # bounded: MAX_CELLS a length

    def assign(batches):
        spaces, pivots = known.value
        for b in batches:
            dims = b.column(3).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x, ids = whole(_matrix(part.column(1), dim), scale), part.column(0).to_numpy()
                _, first = np.unique(np.hstack([ids[:, None].view(np.float64), x]).view(np.int64), axis=0, return_index=True)  # repeated rows
                first.sort()
                x, ids = x[first], ids[first]
                cell, far = _nearest(spaces[dim].lifted(x), pivots[dim])
                yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(x), part.column(2).take(pa.array(first)), pa.array(np.full(len(ids), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "x", "is_query", "dim", "cell", "far"])

    assigned = materialise(rows.select("id", "x", "is_query", "dim").mapInArrow(assign, "id long, x array<double>, is_query boolean, dim int, cell int, far double"), "cells")
    balls = {(r["dim"], r["cell"]): (r["n"], r["radius"]) for r in assigned.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}  # a row a cell
    parts = spark.createDataFrame([(d, c, max(1, -(-n // TREE_ROWS))) for (d, c), (n, _) in balls.items()], "dim int, cell int, parts int")
    dealt = assigned.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # parts: a row a cell

    def build(key, table):
        dim = key[0].as_py()
        x, ids = _matrix(table.column("x"), dim), table.column("id").to_numpy()
        _, first = np.unique(np.hstack([ids[:, None].view(np.float64), x]).view(np.int64), axis=0, return_index=True)
        tree = MTree(known.value[0][dim], ids[first], x[first])
        return pa.table({"dim": [dim], "cell": [key[1].as_py()], "part": [key[2].as_py()], "tree": pa.array([tree.dump()], pa.binary())}, schema=pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("tree", pa.binary())]))

    keys = ["dim", "cell", "part"]
    trees = materialise(dealt.select(*keys, "id", "x").groupBy(*keys).applyInArrow(build, "dim int, cell int, part int, tree binary"), "trees")

    def first_search(key, left, right):
        dim = key[0].as_py()
        schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("x", pa.list_(pa.float64())), ("least", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, ids = _matrix(right.column("x"), dim), right.column("id").to_numpy()
        tree = MTree.load(known.value[0][dim], left.column("tree")[0].as_py())
        q, found, scores = tree.search(x, ids, k)
        order = np.lexsort((found, ~scores, q))
        q, found, scores = q[order], found[order], scores[order]
        cuts = np.searchsorted(q, np.arange(len(ids) + 1)).astype(np.int32)
        least = np.full(len(ids), -_MOST - 1)
        full = np.diff(cuts) == k
        least[full] = scores[cuts[1:][full] - 1]
        same = lambda v: pa.array(np.full(len(ids), v.as_py(), np.int32))
        return pa.Table.from_arrays([*map(same, key[:3]), pa.array(ids), _lists(x), pa.array(least), pa.ListArray.from_arrays(pa.array(cuts), pa.array(found)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(scores))], schema=schema)

    def with_blocks(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries in blocks, and the trees that each block needs."""
        sizes = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
        sizes = materialise(sizes, "blocks")
        blocked = asked.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        needed = trees.join(sizes, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return blocked, needed

    asked, needed = with_blocks(dealt.where("is_query").select(*keys, "id", "x"))
    by = [*keys, "block"]
    first = needed.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(first_search, "dim int, cell int, part int, id long, x array<double>, least long, ids array<long>, scores array<long>")
    first = materialise(first, "first")
    directory = {d: (np.array([c for e, c in sorted(balls) if e == d]), np.array([balls[e, c][1] for e, c in sorted(balls) if e == d]), np.array([max(1, -(-balls[e, c][0] // TREE_ROWS)) for e, c in sorted(balls) if e == d])) for d in spaces}
    held = spark.sparkContext.broadcast(directory)  # bounded as the pivots are

    def reached(batches):
        """The trees that a query's bound reaches, but for the one it was searched in."""
        spaces, pivots = known.value
        for b in batches:
            dims = b.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                space, (names, radius, trees_of) = spaces[dim], held.value[dim]
                q = space.asked(_matrix(part.column(4), dim))
                least, cell, own = part.column(5).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy()
                reach = space.reach(q, least)
                for c, r, n in zip(names, radius, trees_of):
                    near = np.flatnonzero(_apart(q, pivots[dim][c]) - r - space.slack <= reach)
                    for p in range(n):
                        some = near[(cell[near] != c) | (own[near] != p)]
                        if len(some):
                            one = part.take(pa.array(some))
                            yield pa.RecordBatch.from_arrays([one.column(0), pa.array(np.full(len(some), c, np.int32)), pa.array(np.full(len(some), p, np.int32)), one.column(3), one.column(4), one.column(5)], names=[*keys, "id", "x", "least"])

    more = materialise(first.mapInArrow(reached, "dim int, cell int, part int, id long, x array<double>, least long"), "reached")

    def search(key, left, right):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = key[0].as_py()
        x, ids = _matrix(right.column("x"), dim), right.column("id").to_numpy()
        tree = MTree.load(known.value[0][dim], left.column("tree")[0].as_py())
        q, found, scores = tree.search(x, ids, k, right.column("least").to_numpy())
        return pa.Table.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(scores)], schema=schema)

    asked, needed = with_blocks(more)
    second = needed.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score long")
    pairs = first.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query_id", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = pairs.unionByName(second).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    discard(assigned)
    return best.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP9_SQL = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x::double[], c.x::double[])::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""
