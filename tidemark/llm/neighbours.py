"""Nearest neighbours by a block matrix join of quantised vectors.

Vectors are packed once into blocks of int8 rows, each with a scale, a power of
two and the length of what rounding took away. Every pair of a query block and a
candidate block is a tile: an int8 matrix product, from which the quantisation
error and the rounding of the arithmetic bound each true distance from both
sides. A candidate whose least possible distance exceeds the k-th smallest
greatest-possible one is out, in its tile and then over all tiles. Only the
surviving pairs fetch their original vectors; distances are computed again in
double precision, kept in heaps, and the heaps are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import Workspace

#: float32 sums of int8 products are exact up to so many terms.
EXACT_TERMS = 1000
#: Relative slack of the bounds: far above the rounding of sums of some thousand terms.
SLACK = 1e-12
#: Squares of what is left below this underflow; so much is added to each bound, in units of a tile's largest component.
TINY = 1e-150


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales and powers of two, and a bound on the length of what rounding took away (in that power)."""
    power = np.frexp(np.abs(vectors).max(axis=1))[1]
    unit = np.ldexp(vectors, -power[:, None])
    scale = np.abs(unit).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - small * scale[:, None]) ** 2).sum(axis=1)) * (1 + SLACK) + 1e-14 * np.sqrt(vectors.shape[1])
    return small, scale, power.astype(np.int32), error


def distance_bounds(queries, candidates) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest possible distance of every pair of two quantised blocks.

    The square of a distance is a difference of larger numbers: its rounding is
    bounded by their sum. All is computed in units of the tile's largest power
    of two, so that no square overflows.
    """
    (q, q_scale, q_power, q_error), (c, c_scale, c_power, c_error) = queries, candidates
    top = max(q_power.max(), c_power.max())
    q_scale, q_error = (np.ldexp(x, q_power - top) for x in (q_scale, q_error))
    c_scale, c_error = (np.ldexp(x, c_power - top) for x in (c_scale, c_error))
    product = np.zeros((len(q), len(c)))
    for k in range(0, q.shape[1], EXACT_TERMS):
        product += q[:, k : k + EXACT_TERMS].astype(np.float32) @ c[:, k : k + EXACT_TERMS].astype(np.float32).T
    product *= 2 * q_scale[:, None]
    product *= c_scale[None, :]
    both = ((q.astype(np.float64) ** 2).sum(axis=1) * q_scale**2)[:, None] + ((c.astype(np.float64) ** 2).sum(axis=1) * c_scale**2)[None, :]
    square, rounding = both - product, 1e-14 * both
    extra = (q_error[:, None] + c_error[None, :]) * (1 + SLACK) + TINY
    low = np.maximum(np.sqrt(np.maximum(square - rounding, 0)) * (1 - SLACK) - extra, 0) * (1 - SLACK)
    high = (np.sqrt(np.maximum(square, 0) + rounding) * (1 + SLACK) + extra) * (1 + SLACK)
    with np.errstate(over="ignore"):
        low, high = np.ldexp(low, top), np.ldexp(high, top)
        return np.where(np.isinf(low), np.finfo(np.float64).max, np.nextafter(low, 0)), np.nextafter(high, np.inf)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows in double precision, summed component by component.

    Where the squares overflow or underflow, differences are first divided by
    their greatest.
    """
    total, greatest = np.zeros(len(a)), np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore"):
        for k in range(a.shape[1]):
            step = a[:, k] - b[:, k]
            total += step * step
            greatest = np.maximum(greatest, np.abs(step))
        out = np.sqrt(total)
        odd = (~np.isfinite(total) | (total < 1e-290)) & (greatest > 0) & np.isfinite(greatest)
        if odd.any():
            steps = (a[odd] - b[odd]) / greatest[odd, None]
            out[odd] = greatest[odd] * np.sqrt((steps**2).sum(axis=1))
    return out


def surviving(q_ids, queries, c_ids, candidates, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places of query and candidate, bounds) of a tile that can be among a query's k nearest."""
    low, high = distance_bounds(queries, candidates)
    own = c_ids[None, :] == q_ids[:, None]
    others = np.where(own, np.inf, high)
    limit = np.partition(others, k - 1, axis=1)[:, k - 1] if len(c_ids) >= k else np.full(len(q_ids), np.inf)
    i, j = np.nonzero((low <= limit[:, None]) & ~own)
    return i, j, low[i, j], high[i, j]


_BLOCK = "row long, width int, rows binary, ids binary, small binary, scale binary, power binary, error binary"


def _packed(vectors: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows of vectors(row, vec_id, v) of one length; ``row`` is a block's first."""

    def pack(batches):
        for batch in batches:
            rows, ids, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            values, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)
            widths = np.diff(ends)
            for width in np.unique(widths):
                mine = np.flatnonzero(widths == width)
                for first in range(0, len(mine), most):
                    at = mine[first : first + most]
                    parts = quantise(values[ends[at][:, None] + np.arange(width)[None, :]])
                    raw = [pa.array([x.tobytes()], pa.binary()) for x in (rows[at], ids[at], *parts)]
                    yield pa.RecordBatch.from_arrays([pa.array([rows[at[0]]], pa.int64()), pa.array([width], pa.int32()), *raw], names=["row", "width", "rows", "ids", "small", "scale", "power", "error"])

    return vectors.select("row", "vec_id", "v").mapInArrow(pack, _BLOCK)


def _unpacked(block) -> tuple[np.ndarray, np.ndarray, tuple]:
    small = np.frombuffer(block.small, dtype=np.int8).reshape(-1, block.width)
    parts = (small, np.frombuffer(block.scale), np.frombuffer(block.power, dtype=np.int32), np.frombuffer(block.error))
    return np.frombuffer(block.rows, dtype=np.int64), np.frombuffer(block.ids, dtype=np.int64), parts


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite components that is not zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 1024, candidate_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``table`` for each row of ``queries``.

    Both tables have the id and vector columns. A row is no neighbour of a query
    with its own id. Nearness is the Euclidean distance of the original vectors
    in double precision; ties go to the smaller id. Null, zero and non-finite
    vectors, and rows with a null id, take no part; vectors are compared with
    those of the same length. Fewer than k candidates are all returned. A
    repeated id with one vector counts once; its vectors, if they differ, are
    ranked each. Of equal vectors only the k + 1 smallest ids can be among the k
    nearest of any query, so the others are left out first.
    """
    work = Workspace(table.sparkSession, "neighbours")

    def distinct(rows: DataFrame) -> DataFrame:
        rows = valid_vectors(rows, id_col, vector_col).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # no negative zeros
        return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")}).dropDuplicates(["h1", "h2", "vec_id"])

    def kept(rows: DataFrame, name: str) -> DataFrame:
        return work.keep(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), name)

    among_equals = F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))
    c = kept(distinct(table).withColumn("place", among_equals).where(F.col("place") <= k + 1), "candidates")
    q = kept(distinct(queries), "queries")
    q_blocks, c_blocks = work.keep(_packed(q, query_rows), "query-blocks"), work.keep(_packed(c, candidate_rows), "candidate-blocks")
    counts = {"q": max(1, q_blocks.count()), "c": max(1, c_blocks.count())}

    def dealt(blocks: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("row"), F.lit(counts[own])).cast("int")
        return blocks.withColumns({own: at, other: F.explode(F.sequence(F.lit(0), F.lit(counts[other] - 1)))})

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        for x in map(_unpacked, a.itertuples()):
            for y in map(_unpacked, b.itertuples()):
                i, j, low, high = surviving(x[1], x[2], y[1], y[2], k)
                found.append(pd.DataFrame({"q": x[0][i], "c": y[0][j], "low": low, "high": high}))
        return pd.concat(found) if found else pd.DataFrame({"q": [], "c": [], "low": [], "high": []}).astype({"q": "int64", "c": "int64"})

    keys = ["q", "c", "width"]
    left, right = dealt(q_blocks, "q", "c"), dealt(c_blocks, "c", "q")
    pairs = work.keep(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, "q long, c long, low double, high double"), "pairs")

    kth = F.row_number().over(W.partitionBy("q").orderBy("high", "c"))
    limits = pairs.select("q", "c", "high").withColumn("n", kth).where(F.col("n") == k).select("q", F.col("high").alias("limit"))
    near = pairs.join(limits, "q", "left").where("limit is null or low <= limit").select("q", "c")

    def recompute(batches):
        for batch in batches:
            heaps: dict[int, list] = {}
            (q_ids, c_ids), (a, b) = (batch.column(x).to_numpy() for x in (0, 1)), (batch.column(x) for x in (2, 3))
            values = [x.flatten().to_numpy() for x in (a, b)]
            ends = np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy())]).astype(np.int64)
            widths = np.diff(ends)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                places = ends[at][:, None] + np.arange(width)[None, :]
                for query, vec, score in zip(q_ids[at].tolist(), c_ids[at].tolist(), exact_distances(values[0][places], values[1][places]).tolist(), strict=True):
                    heap, entry = heaps.setdefault(query, []), (-score, -vec)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            rows = [(query, -vec, -score) for query, heap in heaps.items() for score, vec in heap]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    with_c = near.join(c.select(F.col("row").alias("c"), F.col("vec_id").alias("c_id"), F.col("v").alias("c_v")), "c")
    full = with_c.join(q.select(F.col("row").alias("q"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v")), "q")
    found = full.select("q_id", "c_id", "q_v", "c_v").mapInArrow(recompute, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
