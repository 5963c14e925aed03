"""Removal of long passages that repeat across documents, with a log-structured fingerprint index.

The index keeps sorted, immutable runs of fingerprints. A fingerprint is the
least hash of the eight-word windows inside a fifty-word window (winnowing), so
two equal fifty-word windows have equal fingerprints, and a document has one
fingerprint for each twenty words or so. A new batch of documents becomes a run,
a table sorted and bucketed by fingerprint, and is merge-joined with the runs
before it: buckets meet buckets, so the history is neither shuffled nor
aggregated again. The matches are verified: the windows under a shared
fingerprint are hashed again from the texts with two independent 64-bit hashes
and compared whole. When runs of one level reach the fan-in they are merged into
one run of the next, which later batches read in their stead.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace
from .text import ASCII_SPACE, SAME_CASE, Words, chunks, ngrams, release, signed, sliding_min, split_words, text_bytes, windows

#: Words of the short windows whose least hash is the fingerprint of a long one.
GRAM = 8


def _split(column: pa.Array):
    """Each text's place in the batch and its words, some documents at a time."""
    data, offsets = text_bytes(column)
    for first, last in chunks(offsets):
        base = offsets[first]
        yield first, last, split_words(data[base : offsets[last]], offsets[first : last + 1] - base, ASCII_SPACE, SAME_CASE)


def _fingerprints(split: Words, width: int) -> np.ndarray:
    """The fingerprint of the long window at every word; those that reach into the next document count for nothing."""
    return signed(sliding_min(ngrams(split.hashes, GRAM), width - GRAM + 1))


def _identity(text: bytes) -> tuple[bytes, int, int]:
    """SHA-256 of a word sequence, and two longs of it that tell which text a row is of."""
    digest = hashlib.sha256(text).digest()
    return digest, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def text_key(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """One pass over the texts: words, hash of the kept form, identity of the word sequence, distinct fingerprints."""

    def scan(batches):
        for batch in batches:
            for first, last, split in _split(batch.column(1)):
                at, prints = np.diff(split.docs), _fingerprints(split, width)
                ids = [_identity(t) for t in split.joined()]
                own = [np.unique(prints[split.docs[d] : split.docs[d + 1] - width + 1]).tobytes() if at[d] >= width else b"" for d in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(2).slice(first, last - first),
                        pa.array(at.astype(np.int64)),
                        *[pa.array(v, t) for v, t in zip(zip(*ids, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)],
                        pa.array(own, pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_words", "sha", "t1", "t2", "prints"],
                )
            release()

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(scan, "doc_id long, text_key long, n_words long, sha binary, t1 long, t2 long, prints binary")


def _unpacked(scanned: DataFrame) -> DataFrame:
    """(print, doc_id, t1, t2), one row for each distinct fingerprint of a document."""

    def unpack(batches):
        for batch in batches:
            if batch.num_rows:
                prints = [np.frombuffer(p, dtype=np.int64) for p in batch.column(3).to_pylist()]
                lengths = np.array([len(p) for p in prints])
                ids = [np.repeat(batch.column(i).to_numpy(), lengths) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prints)), *map(pa.array, ids)], names=["print", "doc_id", "t1", "t2"])

    return scanned.select("doc_id", "t1", "t2", "prints").mapInArrow(unpack, "print long, doc_id long, t1 long, t2 long")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucketed(work: Workspace, rows: DataFrame, key: str, buckets: int, kind: str) -> tuple[str, DataFrame]:
    """A written table bucketed and sorted by a key, and its name."""
    name = f"tidemark_{kind}_{uuid.uuid4().hex}"
    rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{work.path}/{name}").saveAsTable(name)
    return name, work.spark.table(name)


def _forget(work: Workspace, name: str) -> None:
    work.spark.sql(f"drop table {name}")
    work.drop(name)


class FingerprintIndex:
    """Runs of historical fingerprints in a workspace folder; ``ingest`` adds a batch and says what it shares.

    Run rows: print, doc_id, t1, t2 (which text), in tables bucketed and sorted
    by print. All runs of an index have the same buckets, so their joins need no
    exchange. Runs are never changed; a merge writes a new one. A fingerprint
    that many documents have fills one bucket with narrow rows, which the joins
    stream past and never hold.
    """

    def __init__(self, work: Workspace, fan_in: int = 2, buckets: int | None = None):
        self.work, self.fan_in = work, fan_in
        self.buckets = buckets or _partitions(work.spark)
        self.runs: list[tuple[int, str, DataFrame]] = []

    def _table(self, rows: DataFrame, kind: str) -> tuple[str, DataFrame]:
        return _bucketed(self.work, rows, "print", self.buckets, kind)

    def _forget(self, name: str) -> None:
        _forget(self.work, name)

    def ingest(self, rows: DataFrame) -> DataFrame:
        """Add a batch; return (doc_id, t1, t2, print) of all texts, old and new, with a print that the batch shares with another text."""
        older = [run for _, _, run in self.runs]
        name, run = self._table(rows, "run")
        self.runs.append((0, name, run))
        known = run.groupBy("print").agg((F.min("doc_id") < F.max("doc_id")).alias("met"))
        for k, old in enumerate(older):
            known = known.join(old.select("print").distinct().withColumn(f"in_{k}", F.lit(True)), "print", "left").withColumn("met", F.col("met") | F.coalesce(f"in_{k}", F.lit(False))).drop(f"in_{k}")
        name, shared = self._table(known.where("met").select("print"), "shared")
        found = reduce(DataFrame.unionByName, (r.join(shared, "print", "left_semi") for r in [run, *older]))
        found = self.work.keep(found.select("doc_id", "t1", "t2", "print"), f"found-{name}")
        self._forget(name)
        return found

    def compact(self) -> None:
        """Merge the runs of a level that has reached the fan-in, level by level."""
        level = 0
        while any(at == level for at, _, _ in self.runs):
            here = [r for r in self.runs if r[0] == level]
            if len(here) >= self.fan_in:
                name, run = self._table(reduce(DataFrame.unionByName, (run for _, _, run in here)), "run")
                self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, name, run)]
                for _, old, _ in here:
                    self._forget(old)
            level += 1

    def close(self) -> None:
        for _, name, _ in self.runs:
            self._forget(name)
        self.runs = []


def _with_texts(texts: DataFrame, per_doc: DataFrame) -> DataFrame:
    """Texts beside their rows of a narrow table. The texts lie in buckets of doc_id and stay there: only the narrow rows travel, each to its bucket, at every size."""
    return texts.join(per_doc.hint("shuffle_hash"), "doc_id")


def _shared_windows(texts: DataFrame, prints: DataFrame, width: int) -> DataFrame:
    """(h1, h2, doc_id, t1, t2, start): the windows under a shared fingerprint, hashed from the texts."""
    per_doc = prints.groupBy("doc_id", "t1", "t2").agg(F.array_join(F.collect_set(F.col("print").cast("string")), ",").alias("prints"))

    def find(batches):
        for batch in batches:
            ids, t1s, t2s, wanted = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for first, _, split in _split(batch.column(1)):
                prints, texts = _fingerprints(split, width), split.joined()
                h1, h2 = (signed(windows(split.hashes, width, check)) for check in (False, True))
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                for d, text in enumerate(texts):
                    part, row = split.of(d), first + d
                    if part.stop - part.start < width or _identity(text)[1:] != (t1s[row], t2s[row]):
                        continue  # short, or another text with this doc_id
                    mine = np.sort(np.array(wanted[row].split(","), dtype=np.int64))
                    here = prints[part.start : part.stop - width + 1]
                    at = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, here), len(mine) - 1)] == here)
                    own = (np.full(len(at), v, dtype=np.int64) for v in (ids[row], t1s[row], t2s[row]))
                    for column, values in zip(out, (h1[part.start + at], h2[part.start + at], *own, at), strict=True):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["h1", "h2", "doc_id", "t1", "t2", "start"])
            release()

    rows = _with_texts(texts, per_doc).select("doc_id", "text", "t1", "t2", "prints")
    return rows.mapInArrow(find, "h1 long, h2 long, doc_id long, t1 long, t2 long, start long")


def _removed(found: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(doc_id, t1, t2, starts) of windows that also start in a document with a smaller doc_id.

    The least ids are written first, and both sides of their join are plain
    shuffles at every size, of which Spark splits the partitions that a frequent
    window fills.
    """
    least = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = work.keep(least, name)
    hit = found.join(least.hint("merge"), ["h1", "h2"]).where("least < doc_id")
    return hit.groupBy("doc_id", "t1", "t2").agg(F.array_join(F.collect_set(F.col("start").cast("string")), ",").alias("starts"))


def _cut(texts: DataFrame, removed: DataFrame, width: int) -> DataFrame:
    """(doc_id, t1, t2, n_removed, kept_sha, kept) after the words of removed windows are gone."""

    def cut(batches):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            ids, t1s, t2s, starts = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for first, _, split in _split(batch.column(1)):
                edges, mine = np.zeros(len(split.hashes) + 1, dtype=np.int64), []
                for d, text in enumerate(split.joined()):
                    part, row = split.of(d), first + d
                    if _identity(text)[1:] == (t1s[row], t2s[row]):
                        at = part.start + np.array(starts[row].split(","), dtype=np.int64)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + width, -1)
                        mine.append(d)
                keep = np.cumsum(edges[:-1]) == 0
                gone = np.concatenate([[0], np.cumsum(~keep)])[split.docs]
                kept = split.joined(keep)
                rows = [(ids[first + d], t1s[first + d], t2s[first + d], int(gone[d + 1] - gone[d]), hashlib.sha256(kept[d]).hexdigest(), kept[d]) for d in mine]
                if rows:
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names=["doc_id", "t1", "t2", "n_removed", "kept_sha", "kept"])
            release()

    rows = _with_texts(texts, removed).select("doc_id", "text", "t1", "t2", "starts")
    return rows.mapInArrow(cut, "doc_id long, t1 long, t2 long, n_removed long, kept_sha string, kept string")


def _batches(scanned: DataFrame, batches: int) -> list[DataFrame]:
    """Equal ranges of doc_id, in order, so that the index holds smaller ids only."""
    low, high = scanned.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return []
    edges = [low + (high - low + 1) * k // batches for k in range(batches + 1)]
    return [scanned.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def remove_repeats(docs: DataFrame, width: int = 50, batches: int = 3, fan_in: int = 2, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs``, and ``kept`` if with_text.

    A window is ``width`` consecutive words of one document. Words covered by a
    window that also starts in a document with a smaller doc_id are removed; the
    rest are joined by one space. The documents enter the index in ``batches``
    ranges of doc_id.

    docs: ``doc_id`` (long) and ``text``; other columns are not read. Null texts
    have no words. Rows with a null doc_id neither lose words nor make others
    lose any. Rows that share a doc_id do not repeat each other. With with_text,
    ``kept`` is null where nothing is removed (the text stays as it is), and
    ``text_key`` tells rows of one doc_id apart.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "substring")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = work.keep(_scan(docs, width), "scan")

    # Exact copies of a text stand behind the one with the least doc_id.
    least = work.keep(scanned.where(f"doc_id is not null and n_words >= {width}").groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id")), "texts")
    firsts = scanned.join(least, ["doc_id", "t1", "t2"], "left_semi").dropDuplicates(["doc_id", "t1", "t2"])
    firsts = work.keep(firsts.select("doc_id", "t1", "t2", "prints"), "firsts")

    # A text of so many words has so many bytes at least; shorter ones have no window.
    long = docs.where((F.octet_length("text") >= 2 * width - 1) & F.col("doc_id").isNotNull())
    texts_name, texts = _bucketed(work, long, "doc_id", _partitions(spark), "texts")
    index = FingerprintIndex(work, fan_in)
    gone = []
    for k, batch in enumerate(every := _batches(firsts, batches)):
        shared = index.ingest(_unpacked(batch))
        found = work.keep(_shared_windows(texts, shared, width), f"windows-{k}")
        low = batch.agg(F.min("doc_id")).first()[0]
        if low is not None:
            gone.append(work.keep(_removed(found, work, f"least-{k}").where(F.col("doc_id") >= low), f"removed-{k}"))
            work.drop(f"least-{k}")
        work.drop(f"windows-{k}")
        if k + 1 < len(every):
            index.compact()
    index.close()

    copies = least.withColumnRenamed("doc_id", "least")
    rows = scanned.drop("prints").join(copies, ["t1", "t2"], "left")
    whole = F.col("least").isNotNull() & (F.col("least") < F.col("doc_id"))
    empty = hashlib.sha256(b"").hexdigest()
    if gone:
        cuts = work.keep(_cut(texts, reduce(DataFrame.unionByName, gone), width).select("doc_id", "t1", "t2", "n_removed", "kept_sha", *(["kept"] if with_text else [])), "cut")
        rows = rows.join(cuts.dropDuplicates(["doc_id", "t1", "t2"]), ["doc_id", "t1", "t2"], "left")
    else:
        rows = rows.withColumns({"n_removed": F.lit(None).cast("long"), "kept_sha": F.lit(None).cast("string")} | ({"kept": F.lit(None).cast("string")} if with_text else {}))
    _forget(work, texts_name)
    out = [
        F.col("doc_id"),
        F.col("n_words"),
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
    ]
    if with_text:
        out += [F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"), "text_key"]
    return rows.select(*out)
