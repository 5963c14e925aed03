"""Exact search by inner product with M-trees.

Components become whole numbers. A vector of squared length s gets one more
component, the root of M - s with M the greatest squared length, so that all
stored vectors are equally long and the largest inner product with a query is
the smallest Euclidean distance to it: d**2 = |q|**2 + M - 2 q.x. Over this metric
the vectors are indexed in subtrees, one stored row each: a root object, pages
with a routing object, a covering radius and the distance to the root object,
and entries with their distance to the routing object. Objects of a subtree
share the nearest of some sampled pivots; a pivot with very many is many subtrees.

A query keeps a queue of nodes by their least possible distance. It opens the
nearest first, and stops when that one is farther than its k-th best. Stored
distances to the parent give bounds by the triangle inequality, so pages and
entries that can't come in are passed over before any distance to them is
computed. Scores are whole numbers, computed exactly; distances only bound them,
with slack for their rounding.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import Workspace

#: Vectors in a page, and in a subtree.
PAGE_ROWS, TREE_ROWS = 128, 1 << 13
#: Pivots at most, and the bytes that they may take.
MOST_PIVOTS, PIVOT_BYTES = 1024, 8 << 20
#: Bytes of the queries that pass over the subtrees together (the driver reads them), and how many search at once.
PASS_BYTES, STEP_QUERIES = 32 << 20, 512
#: Squared lengths up to this keep every inner product within 64 bits.
LONGEST = 1 << 62
#: Whole numbers whose products and sums are exact in double precision.
EXACT = 1 << 53


def whole_vectors(table: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of rows with an id and a vector of finite components: floor(scale * component), as doubles."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(finite)
    floor = lambda c: F.when(F.abs(c * scale) < float(EXACT), F.floor(c * scale).cast("double")).otherwise(c * scale)
    return rows.select("vec_id", F.transform("v", floor).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(values) else np.zeros((len(column), 0))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes all equally long."""
    rest = np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs, and no smaller than 0."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _slack(most: float, own: np.ndarray, width: int) -> np.ndarray:
    """More than rounding can change a sum of four distances by, for queries of these squared lengths."""
    return 4e-7 * np.sqrt((width + 1) * (most + own)) + 1e-9


def _split(points: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows in groups of at most PAGE_ROWS near ones: dealt to the nearest of some of them until they fit; equal points by their order."""
    waiting, pages = [np.arange(len(points))], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= PAGE_ROWS:
            pages.append(rows)
            continue
        some = rng.choice(rows, size=min(len(rows), max(2, min(64, 2 * len(rows) // PAGE_ROWS))), replace=False)
        nearest = _distances(points[rows], points[some]).argmin(axis=1)
        parts = [rows[nearest == j] for j in range(len(some))]
        if max(map(len, parts)) == len(rows):
            pages += [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
        else:
            waiting += [p for p in parts if len(p)]
    return pages


_TREE = "width int, ids binary, x binary, ends binary, root binary, routes binary, radii binary, to_root binary, to_route binary"


def _tree(ids: np.ndarray, x: np.ndarray, root: np.ndarray, most: float, seed: int) -> list:
    """The columns of a subtree."""
    points = _lifted(x, most)
    pages = _split(points, np.random.default_rng(seed))
    order = np.concatenate(pages)
    ends = np.cumsum([len(p) for p in pages])
    routes, radii, to_route = [], [], np.zeros(len(order))
    for page, end in zip(pages, ends, strict=True):
        middle = points[page].mean(axis=0, keepdims=True)
        route = points[page[_distances(middle, points[page])[0].argmin()]]
        far = _distances(route[None, :], points[page])[0]
        routes.append(route)
        radii.append(far.max())
        to_route[end - len(page) : end] = far
    routes = np.array(routes)
    to_root = _distances(root[None, :], routes)[0]
    parts = (ids[order], x[order], ends.astype(np.int64), root, routes, np.array(radii), to_root, to_route)
    return [x.shape[1], *(np.ascontiguousarray(p).tobytes() for p in parts)]


def _lower(score):
    """A number below what rounding can make of a score."""
    return score - 1 - 1e-9 * np.abs(score)


class Subtree:
    """A stored row, opened."""

    def __init__(self, width: int, ids, x, ends, root, routes, radii, to_root, to_route):
        self.width = width
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.x = np.frombuffer(x).reshape(len(self.ids), width)
        self.ends = np.frombuffer(ends, dtype=np.int64)
        self.root = np.frombuffer(root)
        self.routes = np.frombuffer(routes).reshape(-1, width + 1)
        self.radii, self.to_root, self.to_route = (np.frombuffer(b) for b in (radii, to_root, to_route))
        self.radius = float((self.to_root + self.radii).max())

    def page(self, p: int) -> slice:
        return slice(self.ends[p - 1] if p else 0, self.ends[p])


def _widths(vectors: DataFrame) -> dict[int, tuple[int, float]]:
    """For each number of components: how many vectors, and their greatest squared length."""
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    rows = vectors.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n"), F.max(square).alias("most")).collect()
    if any(r["most"] > LONGEST for r in rows):
        raise OverflowError("inner products of these vectors don't fit in 64 bits")
    return {r["w"]: (r["n"], r["most"]) for r in rows}


def build(vectors: DataFrame, work: Workspace) -> tuple[DataFrame, dict[int, tuple[float, np.ndarray]]]:
    """Stored subtrees of vectors(vec_id, x), and for each width the greatest squared length and a bounded sample's vectors.

    The pivots come from a sample of at most MOST_PIVOTS rows a width (about the
    root of the rows); they only decide which vectors lie together.
    """
    widths, pivots = _widths(vectors), {}
    for w, (n, most) in widths.items():
        wanted = max(1, min(MOST_PIVOTS, int(n**0.5), PIVOT_BYTES // (8 * (w + 1) * len(widths))))
        rows = vectors.where(F.size("x") == w).orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").select("vec_id", "x").limit(wanted).collect()
        pivots[w] = (most, np.array([r["vec_id"] for r in rows], dtype=np.int64), np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), w))

    def assign(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            for w in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == w)
                most, _, x = pivots[w]
                cell[at] = _distances(_lifted(_matrix(batch.column(1).take(pa.array(at))), most), _lifted(x, most)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(cell)], names=["vec_id", "x", "width", "cell"])

    placed = work.keep(vectors.select("vec_id", "x").mapInArrow(assign, "vec_id long, x array<double>, width int, cell int"), "placed")
    # A cell of more than TREE_ROWS rows is as many subtrees as hold it.
    cells = placed.groupBy("width", "cell").agg(F.ceil(F.count("*") / TREE_ROWS).cast("int").alias("trees"))
    dealt = placed.join(F.broadcast(cells), ["width", "cell"]).withColumn("tree", F.pmod(F.xxhash64("vec_id", "x"), F.col("trees").cast("long")).cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        width, cell = table["width"][0].as_py(), table["cell"][0].as_py()
        most, _, x = pivots[width]
        ids = table["vec_id"].to_numpy()
        rows = _matrix(table["x"].combine_chunks()) if width else np.zeros((len(ids), 0))
        order = np.argsort(ids, kind="stable")
        parts = _tree(ids[order], rows[order], _lifted(x[cell : cell + 1], most)[0], most, cell)
        return pa.Table.from_arrays([pa.array([parts[0]], pa.int32()), *(pa.array([p], pa.binary()) for p in parts[1:])], names=[c.split()[0] for c in _TREE.split(", ")])

    trees = dealt.groupBy("width", "cell", "tree").applyInArrow(grow, _TREE)
    return work.keep(trees, "trees"), pivots


class Search:
    """The k best candidates of some queries of one width, entered subtree by subtree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float, k: int, floor: np.ndarray):
        """floor: a score that each query's k-th best is known to reach."""
        self.ids, self.x, self.most, self.k = ids, x, most, k
        self.own = (x * x).sum(axis=1)
        self.lifted = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
        self.slack = _slack(most, self.own, x.shape[1])
        self.floor = floor.copy()  # below this nothing comes in
        self.score = [np.zeros(0, dtype=np.int64) for _ in ids]
        self.vec = [np.zeros(0, dtype=np.int64) for _ in ids]
        self.computed = 0
        self.exact = bool(most * (self.own.max() if len(ids) else 0) < float(EXACT) ** 2)

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """The greatest distance at which an object can still come in."""
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.maximum(self.own[q] + self.most - 2 * self.floor[q], 0)) + self.slack[q]

    def _scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.x[q] @ x.T).astype(np.int64)
        return self.x[q].astype(np.int64) @ x.T.astype(np.int64)

    def _enter(self, q: int, score: np.ndarray, vec: np.ndarray) -> None:
        fits = (score >= self.floor[q]) & (vec != self.ids[q])
        if not fits.any():
            return
        score, vec = np.concatenate([self.score[q], score[fits]]), np.concatenate([self.vec[q], vec[fits]])
        order = np.lexsort((vec, -score))[: self.k]
        self.score[q], self.vec[q] = score[order], vec[order]
        if len(order) == self.k:
            least = float(score[order[-1]])
            self.floor[q] = max(self.floor[q], least if self.exact else _lower(least))

    def over(self, tree: Subtree) -> None:
        """Best-first over a subtree: queries that open the same node in a round do so together."""
        q = np.arange(len(self.ids))
        to_root = _distances(self.lifted, tree.root[None, :])[:, 0]
        q = q[to_root - tree.radius <= self._reach(q)]
        if not len(q):
            return
        # The root's pages, first by their stored distances to the root alone.
        least = np.abs(to_root[q, None] - tree.to_root[None, :]) - tree.radii[None, :]
        near = least <= self._reach(q)[:, None]
        used = np.flatnonzero(near.any(axis=0))
        if not len(used):
            return
        to_route = _distances(self.lifted[q], tree.routes[used])
        least = np.where(near[:, used], np.maximum(to_route - tree.radii[used][None, :], 0), np.inf)
        queues = []
        for i in range(len(q)):
            pages = np.flatnonzero(least[i] <= self._reach(q[i : i + 1])[0])
            queue = list(zip(least[i, pages].tolist(), pages.tolist(), strict=True))
            heapq.heapify(queue)
            queues.append(queue)
        active = [i for i, queue in enumerate(queues) if queue]
        while active:
            reach = dict(zip(active, self._reach(q[active]).tolist(), strict=True))
            opened: dict[int, list[int]] = {}
            for i in active:
                bound, page = heapq.heappop(queues[i])
                if bound > reach[i]:
                    queues[i].clear()  # all others are farther still
                else:
                    opened.setdefault(page, []).append(i)
            for page, who in opened.items():
                self._open(tree, int(used[page]), q[who], to_route[who, page])
            active = [i for i in active if queues[i]]

    def _open(self, tree: Subtree, page: int, q: np.ndarray, to_route: np.ndarray) -> None:
        """Score a page's entries whose stored distance to the routing object lets them come in for one of the queries."""
        at = tree.page(page)
        near = np.abs(to_route[:, None] - tree.to_route[at][None, :]) <= self._reach(q)[:, None]
        entries = np.flatnonzero(near.any(axis=0))
        if not len(entries):
            return
        vec = tree.ids[at][entries]
        scores = self._scores(q, tree.x[at][entries])
        self.computed += scores.size
        for i in np.flatnonzero((scores >= self.floor[q][:, None]).any(axis=1)).tolist():
            self._enter(int(q[i]), scores[i], vec)


def _floors(ids: np.ndarray, x: np.ndarray, pivot_ids: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """What each query's k-th best score reaches at least, from the sampled vectors."""
    least = np.full(len(ids), -np.inf)
    if len(pivot_ids) > k:
        scores = np.where(pivot_ids[None, :] == ids[:, None], -np.inf, x @ pivots.T)
        least = np.partition(scores, -k, axis=1)[:, -k]
        least = np.where(np.isfinite(least), _lower(least), -np.inf)
    return least


def _over_trees(queries: list[tuple[int, np.ndarray, np.ndarray]], pivots: dict, k: int):
    """The function that takes the passing queries (width, ids, vectors) over a task's subtrees."""

    def run(batches):
        searches = []
        for width, ids, x in queries:
            most, pivot_ids, sample = pivots[width]
            for a in range(0, len(ids), STEP_QUERIES):
                b = slice(a, a + STEP_QUERIES)
                searches.append((width, Search(ids[b], x[b], most, k, _floors(ids[b], x[b], pivot_ids, sample, k))))
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Subtree(batch.column(0)[i].as_py(), *(batch.column(j)[i].as_buffer() for j in range(1, batch.num_columns)))
                for width, search in searches:
                    if width == tree.width:
                        search.over(tree)
        none = [np.zeros(0, dtype=np.int64)]
        columns = [
            np.concatenate(none + [np.full(len(s), q) for _, x in searches for q, s in zip(x.ids, x.score, strict=True)]),
            np.concatenate(none + [v for _, x in searches for v in x.vec]),
            np.concatenate(none + [s for _, x in searches for s in x.score]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_products(table: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``table`` with the largest inner products for each row of ``queries``.

    Both tables have the id and vector columns; components x become floor(scale * x)
    first. A row is no candidate of a query with its own id. Ties go to the
    smaller id; fewer than k candidates are all returned. Null vectors, those with
    null or non-finite components, and rows with a null id take no part; zero and
    empty vectors do. Vectors meet those of the same length. A repeated id with
    one vector counts once; its vectors, if they differ, rank each, and the rows
    that they find as queries are ranked together. Tables without rows give
    none; other columns play no part. Vectors whose inner products
    could leave 64 bits raise an OverflowError.
    """
    spark = table.sparkSession
    work = Workspace(spark, "mtree")
    x = work.keep(whole_vectors(table, scale, id_col, vector_col).distinct(), "vectors")
    q = work.keep(whole_vectors(queries, scale, id_col, vector_col).distinct().withColumn("row", F.monotonically_increasing_id()), "queries")
    trees, pivots = build(x, work)
    _widths(q)
    total = q.agg(F.sum(8 * F.size("x") + 32)).first()[0] or 0
    passes = max(1, -(-total // PASS_BYTES))
    found = []
    for at in range(passes):
        mine = q.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == at).select("row", "vec_id", "x").collect()
        groups = []
        for w in sorted({len(r["x"]) for r in mine} & set(pivots)):
            rows = [r for r in mine if len(r["x"]) == w]
            groups.append((w, np.array([r["vec_id"] for r in rows], dtype=np.int64), np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), w)))
        found.append(work.keep(trees.mapInArrow(_over_trees(groups, pivots, k), "query_id long, vec_id long, score long"), f"found-{at}"))
    every = reduce(DataFrame.unionByName, found).distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
