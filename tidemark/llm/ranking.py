"""Ranked lexical search by presence masks.

Documents are packed into blocks, each an inverted index of its own: for every
term the documents that hold it and how often. An item meets a block with a
bitmap of its terms: a document's mask has a bit for each of the item's terms
that it holds. Documents of one mask share a bound, the sum of the greatest
contributions of the mask's terms in the block. Masks are evaluated from the
greatest bound down, and the rest is left once no bound reaches the item's k-th
best score so far. The blocks stay where they are; items pass over them in groups
of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as T
from .storage import Workspace, hint_small

#: A block ends when its texts have so many bytes (or with one longer text), or at so many documents.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 14
#: Terms of the items that pass over the blocks together, and what the driver holds of them at once.
PASS_TERMS = 1 << 18
#: Documents that are scored in one step after the first.
STEP_DOCS = 256

_BLOCK = "docs array<long>, sizes array<int>, terms array<long>, holders array<int>, doc binary, times binary"


def _pairs(split: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of distinct terms of each document, as places, hashes and counts."""
    doc = np.repeat(np.arange(len(split.docs) - 1), np.diff(split.docs))
    order = np.lexsort((split.hashes, doc))
    doc, term = doc[order], split.hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


def _blocks(batches):
    """Index blocks of record batches (doc_id, text)."""
    ids, sizes, found, held = [], [], [], 0

    def block():
        doc, term, times = (np.concatenate(x) for x in zip(*found, strict=True))
        term = T.signed(term)
        order = np.lexsort((doc, term))
        doc, term, times = doc[order], term[order], times[order]
        at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, dtype=np.int64)
        columns = [
            pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
            pa.array([np.concatenate(sizes)], pa.list_(pa.int32())),
            pa.array([term[at]], pa.list_(pa.int64())),
            pa.array([np.diff(np.append(at, len(term))).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([doc.astype(np.uint16).tobytes()], pa.binary()),
            pa.array([times.astype(np.int32).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["docs", "sizes", "terms", "holders", "doc", "times"])

    for batch in batches:
        data, offsets = T.text_bytes(batch.column(1))
        for first, last in T.chunks(offsets):
            for a in range(first, last, BLOCK_DOCS):
                b = min(a + BLOCK_DOCS, last)
                many = sum(map(len, sizes))
                if many and (held + int(offsets[b] - offsets[a]) > BLOCK_BYTES or many + b - a > BLOCK_DOCS):
                    yield block()
                    ids, sizes, found, held, many = [], [], [], 0, 0
                split = T.split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], T.NOT_ALNUM, T.LOWER)
                doc, term, times = _pairs(split)
                ids.append(batch.column(0).slice(a, b - a))
                sizes.append(np.diff(split.docs).astype(np.int32))
                found.append((doc + many, term, times))
                held += int(offsets[b] - offsets[a])
    if sizes:
        yield block()
    T.release()


def index(docs: DataFrame, work: Workspace) -> DataFrame:
    """Stored index blocks of docs(doc_id, text), every row and every term of it."""
    return work.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks, _BLOCK), "blocks")


def term_weights(blocks: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(term, weight) of the terms that some document holds: floor(1000 ln((2n + 2) / (2 holders + 1)))."""
    each = blocks.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.holders").alias("holders"))
    held = each.join(hint_small(terms, 16), "term", "left_semi").groupBy("term").agg(F.sum("holders").alias("holders"))
    odds: Column = F.lit(float(2 * n + 2)) / (2 * F.col("holders") + 1).cast("double")
    return held.select("term", F.floor(1000 * F.log(odds)).cast("long").alias("weight"))


@dataclass
class Best:
    """The k best documents of one item so far: scores descending, ties by id, null ids last."""

    k: int
    score: np.ndarray
    doc: np.ndarray
    no_id: np.ndarray

    @classmethod
    def empty(cls, k: int) -> Best:
        return cls(k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        score, doc, no_id = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((doc, no_id, -score))[: self.k]
        self.score, self.doc, self.no_id = score[order], doc[order], no_id[order]

    @property
    def least(self) -> int:
        """The least score that can still come in."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


@dataclass
class _Open:
    """A block with the contributions of the terms that the passing items have."""

    docs: np.ndarray
    no_id: np.ndarray
    places: np.ndarray  # of each passing term among the ranges, or -1
    starts: np.ndarray
    doc: np.ndarray
    gains: np.ndarray
    greatest: np.ndarray
    by_doc: np.ndarray  # postings in the order of documents
    doc_starts: np.ndarray
    owner: np.ndarray  # the range of each posting


def _open(row: dict, terms: np.ndarray, weights: np.ndarray, n: int, length: int) -> _Open:
    """row: a block's columns; terms, weights: of all passing items, in order."""
    sizes = np.asarray(row["sizes"], dtype=np.int64)
    measure = 100 - 90 + (90 * sizes * n) // max(length, 1)
    have, holders = row["terms"], np.asarray(row["holders"], dtype=np.int64)
    at = np.minimum(np.searchsorted(have, terms), max(len(have) - 1, 0))
    met = np.flatnonzero(have[at] == terms) if len(have) else np.zeros(0, dtype=np.int64)
    places = np.full(len(terms), -1)
    places[met] = np.arange(len(met))
    ends = np.concatenate([[0], np.cumsum(holders)])
    first, many = ends[at[met]], holders[at[met]]
    starts = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(met)), many)
    taken = np.arange(starts[-1]) - starts[owner] + first[owner]
    doc = np.frombuffer(row["doc"], dtype=np.uint16)[taken].astype(np.int64)
    times = np.frombuffer(row["times"], dtype=np.int32)[taken].astype(np.int64)
    gains = weights[met][owner] * ((1_000_000_000 * times) // (1000 * times + 8 * measure[doc]))
    greatest = np.maximum.reduceat(gains, starts[:-1]) if len(met) else np.zeros(0, dtype=np.int64)
    by_doc = np.argsort(doc, kind="stable")
    doc_starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sizes)))])
    return _Open(row["docs"], row["no_id"], places, starts, doc, gains, greatest, by_doc, doc_starts, owner)


def _scores(block: _Open, docs: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Exact scores of some documents of a block for the ranges that ``mine`` marks."""
    first, many = block.doc_starts[docs], np.diff(block.doc_starts)[docs]
    ends = np.cumsum(many)
    of = np.repeat(np.arange(len(docs)), many)
    posting = block.by_doc[np.arange(ends[-1] if len(ends) else 0) - (ends - many)[of] + first[of]]
    gains = np.where(mine[block.owner[posting]], block.gains[posting], 0)
    sums = np.concatenate([[0], np.cumsum(gains)])
    return sums[ends] - sums[ends - many]


def search_block(block: _Open, item: np.ndarray, best: Best) -> int:
    """Enter the block's documents for an item (places of its terms among the passing ones) into its best; how many were scored."""
    ranges = block.places[item]
    ranges = ranges[ranges >= 0]
    if not len(ranges) or int(block.greatest[ranges].sum()) < best.least:
        return 0
    # Masks of more than 64 terms are folded to one number; a mask's bound is the greatest of its documents', so a fold can't lower it.
    mask, bound = np.zeros(len(block.docs), dtype=np.uint64), np.zeros(len(block.docs), dtype=np.int64)
    for k, r in enumerate(ranges.tolist()):
        if k and k % 64 == 0:
            mask = T.mix(mask + np.uint64(k))
        holders = block.doc[block.starts[r] : block.starts[r + 1]]
        mask[holders] ^= np.uint64(1 << k % 64)
        bound[holders] += block.greatest[r]
    able = np.flatnonzero(bound >= best.least)
    if not len(able):
        return 0
    _, group = np.unique(mask[able], return_inverse=True)
    bounds = np.zeros(group.max() + 1, dtype=np.int64)
    np.maximum.at(bounds, group, bound[able])
    order = np.argsort(-bounds[group], kind="stable")
    able, falling = able[order], bounds[group][order]
    mine = np.zeros(len(block.greatest), dtype=bool)
    mine[ranges] = True
    done, size = 0, best.k
    while done < len(able) and falling[done] >= best.least:
        some = able[done : done + size]
        score = _scores(block, some, mine)
        enter = score >= best.least
        best.add(score[enter], block.docs[some[enter]], block.no_id[some[enter]])
        done, size = done + len(some), STEP_DOCS
    return done


def _over_blocks(items: list[np.ndarray], terms: np.ndarray, weights: np.ndarray, n: int, length: int, k: int):
    """The function that takes the passing items over a task's blocks."""

    def run(batches):
        best = [Best.empty(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column(0)[i].values
                row = {"docs": docs.fill_null(0).to_numpy(zero_copy_only=False), "no_id": docs.is_null().to_numpy(zero_copy_only=False)}
                row |= {x: batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j, x in ((1, "sizes"), (2, "terms"), (3, "holders"))}
                block = _open(row | {"doc": batch.column(4)[i].as_buffer(), "times": batch.column(5)[i].as_buffer()}, terms, weights, n, length)
                for item, mine in zip(items, best, strict=True):
                    search_block(block, item, mine)
        rows = [np.full(len(b.doc), i) for i, b in enumerate(best)]
        columns = [np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (rows, [b.doc for b in best], [b.score for b in best])]
        no_id = np.concatenate([*(b.no_id for b in best), np.zeros(0, dtype=bool)])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64), mask=no_id), pa.array(columns[2].astype(np.int64))], names=["item", "doc_id", "score"])
        T.release()

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of docs(doc_id, text) that score highest for each row of items(item_id, text).

    A document scores for each distinct term of the item that it holds: the
    term's weight (rarer is higher) times its occurrences, which count less and
    less, and less in long documents. Only scores above 0 rank; equal ones go by
    doc_id, null last. Null, empty and wordless texts hold no terms and count
    as no documents; items without terms find nothing. Rows of one doc_id or
    item_id each count and rank for themselves; null item_ids are searched too.
    Tables without rows give none. Other columns, whatever their names, play no
    part. Terms stand by 64-bit hashes.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ranking")
    blocks = index(docs, work)
    n, length = blocks.select(F.sum(F.size(F.filter("sizes", lambda x: x > 0))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, length = n or 0, length or 0

    def hashed(batches):
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(1))
            for a, b in T.chunks(offsets):
                doc, term, _ = _pairs(T.split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], T.NOT_ALNUM, T.LOWER))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + a)), pa.array(T.signed(term))], names=["item", "term"])

    named = work.keep(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    wanted = work.keep(named.select("item", "text").mapInArrow(hashed, "item long, term long"), "item-terms")
    weights = work.keep(term_weights(blocks, work.keep(wanted.select("term").distinct(), "terms"), n), "weights")
    # Items go over the blocks in groups of bounded size; each is read by the driver and sent to every task.
    held = wanted.join(hint_small(weights, 24), "term").where("weight > 0").groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    held = work.keep(held.withColumn("n", F.size("terms").cast("long")), "held-items")
    total = held.agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-total // PASS_TERMS))
    held = work.keep(held.withColumn("pass", F.pmod(F.xxhash64("item"), F.lit(passes))), "dealt-items") if passes > 1 else held.withColumn("pass", F.lit(0).cast("long"))

    found = []
    for at in range(passes):
        mine = held.where(F.col("pass") == at).select("item", "terms").collect()
        pairs = sorted({(t["term"], t["weight"]) for r in mine for t in r["terms"]})
        terms, weight = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
        places = [np.searchsorted(terms, np.array([t["term"] for t in r["terms"]], dtype=np.int64)) for r in mine]
        keys = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(mine)] or [(-1, -1)], "item long, key long")
        local = blocks.mapInArrow(_over_blocks(places, terms, weight, n, length, k), "item long, doc_id long, score long")
        found.append(work.keep(local.join(F.broadcast(keys), "item").select(F.col("key").alias("item"), "doc_id", "score"), f"found-{at}"))
    every = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(named.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
