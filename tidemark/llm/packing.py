"""Packing documents into batches of a token budget, in length buckets that minimise padding.

A dynamic programme over the histogram of all lengths chooses the bucket
boundaries: every sequence is padded to its bucket's boundary, and no other
choice of as many boundaries pads less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import Workspace


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` boundaries with the least total padding, by dynamic programming.

    The cost of a bucket is concave in the Monge sense, so the best split of a
    prefix never moves left; divide and conquer finds all splits of one layer in
    n log n steps.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    below = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = lengths * below[1:]
    splits = []
    for _ in range(1, min(buckets, n)):
        now, cut = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
        spans = [(0, n - 1, 0, n - 1)]
        while spans:
            low, high, left, right = spans.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(left, min(j, right) + 1)
            # The last bucket holds lengths i..j; those before i cost best[i - 1].
            cost = np.where(i > 0, best[i - 1], 0.0) + lengths[j] * (below[j + 1] - below[i])
            k = int(np.argmin(cost))
            now[j], cut[j] = cost[k], i[k]
            spans += [(low, j - 1, left, int(i[k])), (j + 1, high, int(i[k]), right)]
        splits.append(cut)
        best = now
    out, j = [], n - 1
    for cut in [*reversed(splits), np.zeros(n, dtype=np.int64)]:
        out.append(int(lengths[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    return sorted(set(out))


def pack(docs: DataFrame, buckets: int = 8, budget: int = 8192, length: Column | None = None, slice_rows: int = 20_000) -> DataFrame:
    """``doc_id, n_tokens, bucket, padded_length, batch, place`` for each row of ``docs``.

    length: tokens of a row (default: words of ``text``). A batch holds
    ``budget // padded_length`` sequences of one bucket, at least one, so a
    sequence over the budget has its own batch and stays whole. Batches are
    numbered from 0 in each bucket; all but a bucket's last are full. Rows of
    length 0 (null or empty texts) need no batch: bucket, batch and place are
    null. Null doc_ids are packed like others; a table without rows gives none.

    The driver reads the histogram, one row for each distinct length. As so many
    lengths take at least half their square in tokens, that is at most the root
    of twice all tokens: some six million rows for 1.6e13 tokens.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    n = (word_count(F.col("text")) if length is None else length).cast("long")
    # Rows are dealt to slices by where they lie, so repeated rows part too; any dealing packs as well.
    rows = work.keep(docs.select("doc_id", n.alias("n_tokens"), F.xxhash64(F.monotonically_increasing_id()).alias("deal")), "lengths")
    bins = rows.where("n_tokens > 0").groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("count")).toPandas()
    found = boundaries(bins["length"].to_numpy(np.int64), bins["count"].to_numpy(np.int64), buckets)
    slices = max(1, -(-int(bins["count"].sum()) // slice_rows))

    bucket = F.lit(None).cast("int")
    padded = F.lit(None).cast("long")
    for k in reversed(range(len(found))):
        fits = F.col("n_tokens") <= found[k]
        bucket, padded = F.when(fits, F.lit(k)).otherwise(bucket), F.when(fits, F.lit(found[k])).otherwise(padded)
    some = F.col("n_tokens") > 0
    rows = rows.withColumns({"bucket": F.when(some, bucket), "padded_length": F.when(some, padded).cast("long"), "slice": F.pmod("deal", F.lit(slices)).cast("int")})

    sizes = rows.where(some).groupBy("bucket", "slice").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(W.partitionBy("bucket").orderBy("slice")) - F.col("size")).drop("size")
    within = W.partitionBy("bucket", "slice").orderBy("doc_id", "n_tokens")
    placed = rows.withColumn("place", F.row_number().over(within) - 1).join(before, ["bucket", "slice"], "left")
    at = F.col("before") + F.col("place")
    capacity = F.greatest(F.lit(1), F.expr(f"{budget} div padded_length"))
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_length",
        F.when(some, F.floor(at / capacity)).cast("long").alias("batch"),
        F.when(some, at % capacity).cast("int").alias("place"),
    )
