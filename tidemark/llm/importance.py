"""Importance resampling towards a target corpus, over hashed word and word-pair features.

A feature's bucket is the CRC-32 of its bytes modulo the number of buckets.
Words and pairs are split in two: a head of the most frequent ones, whose CRC
states and buckets are worked out once and broadcast, and the tail, whose bytes
go through the CRC where they occur. Both give the same number, so the totals of
the buckets and the weights are exact whatever the head holds.

The head comes from counting summaries of bounded size, one a task, over all
texts; its size is a parameter, and so is that of the totals that the driver reads.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .storage import Workspace

#: Words of the head have at most so many bytes, which two 64-bit numbers hold: equal numbers are equal words.
HEAD_BYTES = 16
#: Longer words go through the library's CRC one by one.
LONG_BYTES = 64
_START = 0xFFFFFFFF


def _crc_table() -> np.ndarray:
    """The 256 remainders of the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def _step(states: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(states ^ byte) & np.uint32(0xFF)] ^ (states >> np.uint32(8))


def crc_states(states: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each range, from the given registers; the CRC is the complement."""
    sizes, out = ends - starts, states.astype(np.uint32)
    for i in np.flatnonzero(sizes > LONG_BYTES):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]) ^ _START) ^ _START
    short = np.flatnonzero(sizes <= LONG_BYTES)
    short = short[np.argsort(-sizes[short], kind="stable")]
    left = len(short) - np.cumsum(np.bincount(sizes[short], minlength=LONG_BYTES + 1))  # how many have more bytes than that
    now, at = out[short], starts[short]
    for step in range(int(sizes[short[0]]) if len(short) else 0):
        n = left[step]
        now[:n] = _step(now[:n], data[at[:n] + step])
    out[short] = now
    return out


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first sixteen bytes of each range as two numbers; no word has a zero byte."""
    padded = np.concatenate([data, np.zeros(HEAD_BYTES, dtype=np.uint8)])
    eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    sizes = ends - starts
    return eight[starts] & masks[np.minimum(sizes, 8)], eight[np.minimum(starts + 8, len(data))] & masks[np.clip(sizes - 8, 0, 8)]


@dataclass
class Head:
    """Frequent words in the order of their hashes, with CRC registers, and buckets of frequent pairs of them."""

    hashes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    registers: np.ndarray
    pairs: np.ndarray  # sorted: place of the first word times the number of words, plus place of the second
    pair_buckets: np.ndarray

    def places(self, split: T.Words) -> np.ndarray:
        """Each word's place in the head, or -1."""
        if not len(self.hashes):
            return np.full(len(split.hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, split.hashes), len(self.hashes) - 1)
        low, high = _packed(split.data, split.starts, split.ends)
        same = (self.low[at] == low) & (self.high[at] == high) & (split.ends - split.starts <= HEAD_BYTES)
        return np.where(same, at, -1)


def _splits(column: pa.Array):
    """(first document, words) of pieces of a text column."""
    data, offsets = T.text_bytes(column)
    for first, last in T.chunks(offsets):
        yield first, T.split_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], T.NOT_ALNUM, T.LOWER)


def _followed(split: T.Words) -> np.ndarray:
    """The words that have another after them in their document."""
    follows = np.ones(len(split.hashes), dtype=bool)
    ends = split.docs[1:] - 1
    follows[ends[ends >= 0]] = False
    return np.flatnonzero(follows)


def build_head(words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> Head:
    """The tables of a head of these words, and of those pairs whose words are among them."""
    words = sorted({w for w in words if 0 < len(w) <= HEAD_BYTES})
    data, offsets = T.text_bytes(pa.array(words, pa.binary()).cast(pa.string()))
    split = T.split_words(data, offsets, T.NOT_ALNUM, T.LOWER)
    if len(split.hashes) != len(words):
        raise ValueError("the head holds something that is no word")
    order = np.argsort(split.hashes, kind="stable")
    low, high = _packed(split.data, split.starts, split.ends)
    registers = crc_states(np.full(len(words), _START, dtype=np.uint32), split.data, split.starts, split.ends)
    place = {words[w]: at for at, w in enumerate(order.tolist())}
    known = sorted({(place[a] * len(words) + place[b], zlib.crc32(a + b" " + b) % buckets) for a, b in pairs if a in place and b in place})
    table = np.array(known, dtype=np.int64).reshape(-1, 2)
    return Head(split.hashes[order], low[order], high[order], registers[order], table[:, 0].copy(), table[:, 1].copy())


def feature_buckets(split: T.Words, head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, the words that begin a pair, and the buckets of the pairs."""
    place = head.places(split)
    registers = np.empty(len(place), dtype=np.uint32)
    known = place >= 0
    registers[known] = head.registers[place[known]]
    tail = np.flatnonzero(~known)
    registers[tail] = crc_states(np.full(len(tail), _START, dtype=np.uint32), split.data, split.starts[tail], split.ends[tail])

    first = _followed(split)
    pair = np.full(len(first), -1, dtype=np.int64)
    if len(head.pairs):
        both = np.flatnonzero(known[first] & known[first + 1])
        keys = place[first[both]] * len(head.hashes) + place[first[both] + 1]
        at = np.minimum(np.searchsorted(head.pairs, keys), len(head.pairs) - 1)
        hit = head.pairs[at] == keys
        pair[both[hit]] = head.pair_buckets[at[hit]]
    unseen = np.flatnonzero(pair < 0)
    after = first[unseen] + 1
    states = crc_states(_step(registers[first[unseen]], np.uint32(0x20)), split.data, split.starts[after], split.ends[after])
    pair[unseen] = (~states).astype(np.int64) % buckets
    return (~registers).astype(np.int64) % buckets, first, pair


@dataclass
class _Frequent:
    """Misra and Gries' summary: of all keys met, any with more than one in ``most`` of them is held."""

    most: int
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    names: dict = field(default_factory=dict)

    def add(self, keys: np.ndarray, name) -> None:
        """name(i) is what keys[i] stands for."""
        found, first, counts = np.unique(keys, return_index=True, return_counts=True)
        merged, back = np.unique(np.concatenate([self.keys, found]), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate([self.counts, counts]), minlength=len(merged)).astype(np.int64)
        if len(merged) > self.most:
            sums = sums - np.partition(sums, -self.most - 1)[-self.most - 1]
        held = sums > 0
        self.keys, self.counts = merged[held], sums[held]
        new = np.setdiff1d(self.keys, np.fromiter(self.names, dtype=np.uint64, count=len(self.names)), assume_unique=True)
        self.names = {k: self.names[k] for k in np.setdiff1d(self.keys, new, assume_unique=True).tolist()}
        self.names |= {k: name(first[i]) for k, i in zip(new.tolist(), np.searchsorted(found, new).tolist(), strict=True)}


def find_head(texts: DataFrame, buckets: int, words: int = 4096, pairs: int = 32768) -> Head:
    """The head of texts(text): at most so many words and pairs, which the driver reads.

    Each task counts in a summary of twice that size; the summaries are added up
    by Spark and the largest counts taken.
    """

    def count(batches):
        single, double = _Frequent(2 * words), _Frequent(2 * pairs)
        for batch in batches:
            for _, split in _splits(batch.column(0)):
                raw, sizes = split.data, split.ends - split.starts

                def word(i, split=split, raw=raw):
                    return raw[split.starts[i] : split.ends[i]].tobytes()

                short = np.flatnonzero(sizes <= HEAD_BYTES)
                single.add(split.hashes[short], lambda i, short=short, word=word: (word(short[i]), None))
                first = _followed(split)
                first = first[(sizes[first] <= HEAD_BYTES) & (sizes[first + 1] <= HEAD_BYTES)]
                double.add(T.mix(split.hashes[first] * np.uint64(3) + split.hashes[first + 1]), lambda i, first=first, word=word: (word(first[i]), word(first[i] + 1)))
        for summary in (single, double):
            names = [summary.names[k] for k in summary.keys.tolist()]
            columns = [pa.array([x[0] for x in names], pa.binary()), pa.array([x[1] for x in names], pa.binary()), pa.array(summary.counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])
        T.release()

    counts = texts.select("text").mapInArrow(count, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = Workspace(texts.sparkSession, "importance-head").keep(counts, "counts")
    most = [counts.where(c).orderBy(F.desc("n"), "a", "b").limit(n).collect() for c, n in (("b is null", words), ("b is not null", pairs))]
    return build_head([bytes(r["a"]) for r in most[0]], [(bytes(r["a"]), bytes(r["b"])) for r in most[1]], buckets)


def bucket_totals(texts: DataFrame, head: Head, buckets: int) -> np.ndarray:
    """How many features of all texts(text) fall in each bucket: a task sends one number a bucket, so does Spark to the driver."""

    def count(batches):
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, split in _splits(batch.column(0)):
                single, _, double = feature_buckets(split, head, buckets)
                totals += np.bincount(single, minlength=buckets) + np.bincount(double, minlength=buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at], pa.int64())], names=["bucket", "n"])
        T.release()

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of each bucket, with one added to every count."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, head: Head, gains: np.ndarray, columns: list[str]) -> DataFrame:
    """columns of docs with n_words, n_features and weight of the text, the floored mean gain of its features (none: 0)."""
    buckets = len(gains)
    schema = docs.select(*columns).schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")

    def score(batches):
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for at, split in _splits(batch.column(0)):
                single, first, double = feature_buckets(split, head, buckets)
                mine = slice(at, at + len(split.docs) - 1)
                n_words[mine] = np.diff(split.docs)
                n_features[mine] = n_words[mine] + np.diff(np.searchsorted(first, split.docs))
                for places, of in ((np.arange(len(single)), single), (first, double)):
                    sums = np.concatenate([[0], np.cumsum(gains[of])])
                    total[mine] += np.diff(sums[np.searchsorted(places, split.docs)])
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=schema.names)

    return docs.select("text", *columns).mapInArrow(score, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, head_words: int = 4096, head_pairs: int = 32768, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for each row of docs(doc_id, text), and its text if asked for.

    Features are the words and the pairs of neighbouring words of the lower-cased
    text. A bucket's gain compares how often target(text) and docs have it; weight
    is the floored mean gain; score adds Gumbel noise that the doc_id determines.
    Of the documents with at least least_words words, percent in 100 are drawn:
    the highest scores, ties to the smaller doc_id, null last; rank is their place
    and null for the others.

    Null, empty and wordless texts have no features, weight 0, and are not drawn.
    A null doc_id has the noise of an empty one; rows of one doc_id are weighed
    and drawn each. Without target texts every gain compares with nothing; tables
    without rows give none. Other columns, whatever their names, play no part.
    """
    work = Workspace(docs.sparkSession, "importance")
    docs, target = docs.select("doc_id", "text"), target.select("text")
    head = find_head(docs, buckets, head_words, head_pairs)
    gains = bucket_gains(bucket_totals(docs, head, buckets), bucket_totals(target, head, buckets))

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296)))
    weighed = work.keep(weigh(docs, head, gains, ["doc_id", "text"] if with_text else ["doc_id"]).withColumn("score", score.cast("long")), "weighed")

    # In order over all tasks: a row's place is its place in its range after the rows of the ranges before. Row numbers
    # part equal keys, so one doc_id in very many rows is still many ranges.
    ready = weighed.withColumn("row", F.monotonically_increasing_id())
    able = ready.where(F.col("n_words") >= least_words)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranged = able.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = work.keep(ranged.select("*", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at")).drop("place"), "ranged")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a shuffle partition
    drawn, before, starts = percent * sum(sizes.values()) // 100, 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = docs.sparkSession.createDataFrame(starts or [(-1, 0)], "part long, before long")
    ranked = ranged.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at") + 1)
    names = ["doc_id", *(["text"] if with_text else []), "n_words", "n_features", "weight", "score"]
    ranked = ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    unable = ready.where(F.col("n_words") < least_words)
    return ranked.unionByName(unable.select(*names, F.lit(None).cast("long").alias("rank")))
