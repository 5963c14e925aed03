"""Near-duplicate documents by a set-similarity join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles. Shingles have one global
order, rare ones first. If two sets have a Jaccard similarity of at least t,
then for every l the first ``n - ceil(t n) + l`` shingles of both share at least
l of them. Each document chooses its own l: a longer prefix costs more postings,
but a pair then needs that many shared shingles before it is verified. A pair is
held to the smaller of its two l.

Components do not need all pairs. A first round verifies a few neighbours in
every posting list and joins them up; a second, exact round holds every set that
shares enough prefix shingles with another component's sets against those sets,
a block of them at a time. So a group of copies is never expanded into all its
pairs, and no link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .storage import Workspace, hint_small
from .text import binaries, chunks, mix, ngrams, release, sequence_hash, signed, split_words, text_bytes

#: Counters of the frequency sketch, a bound on what is broadcast (one byte each).
SKETCH_BITS = 22
_SLICE_BITS = 16
#: Prefixes are lengthened by at most so many shingles.
MOST_MATCHES = 64
#: Other sets that a rare shingle is expected to meet by chance; the sketch can't tell so few.
CHANCE = 0.1
#: Posting lists of shingles in a higher frequency class are dealt out by document as well.
_SALT_CLASS = 13
#: Lists up to this size propose a pair for every shingle in the first round.
SHORT_LIST = 8
#: Shingles of a block of sets, and sets that visit one task's block.
BLOCK_SHINGLES, BLOCK_VISITS = 1 << 18, 512
#: Components of up to so many sets share blocks; larger ones have their own.
SMALL_COMPONENT = 64


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words make one shingle, none an empty set."""
    data, offsets = text_bytes(column)
    for first, last in chunks(offsets):
        base = offsets[first]
        split = split_words(data[base : offsets[last]], offsets[first : last + 1] - base)
        grams = ngrams(split.hashes, words)
        for d in range(last - first):
            part = split.of(d)
            n = part.stop - part.start
            if n >= words:
                yield np.unique(grams[part.start : part.stop - words + 1])
            elif n:
                yield np.array([sequence_hash(split.hashes[part])], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)
    release()


def _frequency_classes(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """floor(log2(1 + count)) of every counter of a sketch over all documents' shingles."""
    shift, slices = np.uint64(64 - bits), 1 << max(0, bits - _SLICE_BITS)

    def count(batches):
        counts, waiting, n = np.zeros(1 << bits, dtype=np.uint32), [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                waiting.append(s)
                n += len(s)
                if n > 1 << 21:
                    counts += np.bincount(np.concatenate(waiting) >> shift, minlength=1 << bits).astype(np.uint32)
                    waiting, n = [], 0
        if n:
            counts += np.bincount(np.concatenate(waiting) >> shift, minlength=1 << bits).astype(np.uint32)
        for i, part in enumerate(np.split(counts, slices)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": binaries([zlib.compress(part.tobytes(), 1)])})

    def merge(batches):
        at, total = None, None
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), dtype=np.uint32).astype(np.uint64)
                if i != at:
                    if at is not None:
                        yield _classes_row(at, total)
                    at, total = i, part
                else:
                    total = total + part
        if at is not None:
            yield _classes_row(at, total)

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, classes binary")
    out = np.zeros((slices, (1 << bits) // slices), dtype=np.uint8)
    for row in merged.collect():  # 2**bits bytes at every size of the input
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["classes"]), dtype=np.uint8)
    return out.reshape(-1)


def _classes_row(i: int, total: np.ndarray) -> pa.RecordBatch:
    classes = np.floor(np.log2(total + 1)).astype(np.uint8)
    return pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "classes": binaries([zlib.compress(classes.tobytes(), 1)])})


def required(n, num: int, den: int):
    """Least overlap of a set of n with any set that links with it: ceil(t n)."""
    return -(-num * n // den)


def _choose(classes: np.ndarray, n: int, need: int, floor: float) -> int:
    """The number of matches l with the least estimated cost of postings and verifications."""
    most = min(MOST_MATCHES, need)
    load = np.maximum(np.exp2(classes[: n - need + most].astype(np.float64)) - floor, 0.0) + CHANCE
    scanned = np.cumsum(load)[n - need :]
    matches = np.arange(1, most + 1)
    return int(np.argmin(matches + scanned + n * scanned / (64 * matches))) + 1


def _signatures(docs: DataFrame, words: int, num: int, den: int, classes, floor: float, bits: int) -> DataFrame:
    """(doc_id, n, k1, k2, matches, prefix): 128 bits that identify the set, and its prefix in order of rarity."""
    shift = np.uint64(64 - bits)

    def sign(batches):
        table = classes.value
        for batch in batches:
            rows = {"n": [], "k1": [], "k2": [], "matches": [], "prefix": []}
            for s in shingle_sets(batch.column(1), words):
                n = len(s)
                rows["n"].append(n)
                if not n:
                    for k in ("k1", "k2", "matches", "prefix"):
                        rows[k].append(None)
                    continue
                for k, salt in (("k1", 0xE7037ED1A0B428DB), ("k2", 0xA0761D6478BD642F)):
                    rows[k].append(int(signed(mix(s ^ np.uint64(salt)).sum(keepdims=True, dtype=np.uint64))[0]))
                own = table[s >> shift]
                order = np.argsort(own, kind="stable")
                need = required(n, num, den)
                matches = _choose(own[order], n, need, floor)
                rows["matches"].append(matches)
                rows["prefix"].append(s[order[: n - need + matches]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows["n"], pa.int32()), pa.array(rows["k1"], pa.int64()), pa.array(rows["k2"], pa.int64()), pa.array(rows["matches"], pa.int32()), pa.array(rows["prefix"], pa.binary())],
                names=["doc_id", "n", "k1", "k2", "matches", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n int, k1 long, k2 long, matches int, prefix binary")


def _postings(sets: DataFrame, classes, bits: int) -> DataFrame:
    """One row for each prefix shingle of each distinct set."""
    shift = np.uint64(64 - bits)

    def explode(batches):
        table = classes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            prefixes = [np.frombuffer(p, dtype=np.uint64) for p in batch.column(3).to_pylist()]
            lengths = np.array([len(p) for p in prefixes])
            doc, n, matches = (np.repeat(batch.column(i).to_numpy(), lengths) for i in range(3))
            token = np.concatenate(prefixes)
            rank = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            lists = np.uint64(1) << np.maximum(table[token >> shift].astype(np.int64) - _SALT_CLASS, 0).astype(np.uint64)
            salt = mix(doc.astype(np.int64).view(np.uint64)) % lists
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(token)), pa.array(salt.astype(np.int32)), pa.array(doc), pa.array(n.astype(np.int32)), pa.array(matches.astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(lists > 1)],
                names=["token", "salt", "doc", "n", "matches", "rank", "salted"],
            )

    return sets.select("doc_id", "n", "matches", "prefix").mapInArrow(explode, "token long, salt int, doc long, n int, matches int, rank int, salted boolean")


def _lists(postings: DataFrame) -> DataFrame:
    """Postings of shingles that more than one set has, each with the set before it in its list (``other``).

    Lists have one of four random orders, so that a set meets a few partners,
    not the same one for every shingle; salts bound the length of a list.
    """
    # Dealt first, so that the random order is made of what has arrived and is not sent along.
    postings = postings.repartition("token", "salt").withColumn("place", F.xxhash64("doc", F.pmod("token", F.lit(4))))
    whole = W.partitionBy("token", "salt")
    order = whole.orderBy("place")
    before = [F.lag(c).over(order).alias(f"other_{c}") for c in ("doc", "n", "rank", "matches")]
    return (
        postings.select("token", "doc", "n", "matches", "rank", "salted", *before, F.count("*").over(whole).alias("size"))
        .where("size > 1 or salted")
        .drop("salted")
    )


def _may_link(num: int, den: int, a: str, b: str) -> str:
    """SQL: sizes and the positions of a shared shingle leave room for the required overlap."""
    room = f"least({a}rank, {b}rank) + least({a}n - {a}rank, {b}n - {b}rank)"
    return f"{num} * greatest({a}n, {b}n) <= {den} * least({a}n, {b}n) and {num + den} * ({room}) >= {num} * ({a}n + {b}n)"


def _verified(pairs: DataFrame, docs: DataFrame, work: Workspace, name: str, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the required similarity."""
    sets = _sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), docs, work, name, words)

    def hold(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set")
    return work.keep(full.mapInArrow(hold, "a long, b long"), f"{name}-links")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Classes of near-duplicate documents: ``doc_id, n_shingles, component_id`` for each row of ``docs``.

    docs: ``doc_id`` (long) and ``text``; other columns are not read.
    threshold: Jaccard similarity as a fraction (numerator, denominator).

    A null or empty text, or one of white space, has no shingles and is its own
    component. Rows with a null doc_id link with nothing and get a null
    component. Rows that share a doc_id count as one document. A table without
    rows gives none.
    """
    num, den = threshold
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    table = _frequency_classes(docs, words, sketch_bits)
    floor = float(2 * np.exp2(table.astype(np.float64)).mean())
    classes = spark.sparkContext.broadcast(table)
    signed_docs = work.keep(_signatures(docs, words, num, den, classes, floor, sketch_bits), "signatures")

    sets = work.keep(signed_docs.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("least")), "sets")
    firsts = signed_docs.join(hint_small(sets.withColumnRenamed("least", "doc_id"), 40), ["doc_id", "k1", "k2"], "left_semi")
    lists = work.keep(_lists(_postings(firsts, classes, sketch_bits)), "lists")

    # In long lists every eighth shingle will do: their sets meet in many. In short ones a pair must meet twice if it can.
    near = lists.where(f"other_doc <> doc and (size <= {SHORT_LIST} or token % 8 = 0) and " + _may_link(num, den, "", "other_"))
    near = near.groupBy(F.least("doc", "other_doc").alias("a"), F.greatest("doc", "other_doc").alias("b")).agg(F.count("*").alias("shared"), F.max("size").alias("size"), F.min(F.least("matches", "other_matches")).alias("need"))
    near = near.where(f"shared >= least(need, 2) or size > {SHORT_LIST}").select("a", "b")
    first = components(_verified(work.keep(near, "near"), docs, work, "near", words, num, den), work, "first")
    first = work.keep(first, "first")
    for name in ("near", "near-ids", "near-sets", "near-links"):
        work.drop(name)

    rest = _open_links(lists, first, docs, work, words, num, den)
    for name in ("lists", "open-rows", "open-labels", "open-blocks", "open-visits", "open-rolls", "open-ids", "open-sets"):
        work.drop(name)
    # What is linked already counts as one node.
    tree = first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    last = components(tree.unionByName(rest), work, "last") if rest.head(1) else first

    classes_of = sets.join(last, sets["least"] == last["node"], "left").select("k1", "k2", F.coalesce("component", "least").alias("component"))
    found = signed_docs.join(classes_of, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def _sets(wanted: DataFrame, docs: DataFrame, work: Workspace, name: str, words: int) -> DataFrame:
    """(doc_id, shingles) of the documents in wanted(doc_id), written."""

    def build(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(sets)], names=["doc_id", "shingles"])

    wanted = work.keep(wanted, f"{name}-ids")
    texts = docs.select("doc_id", "text").join(hint_small(wanted, 16), "doc_id", "left_semi")
    return work.keep(texts.mapInArrow(build, "doc_id long, shingles binary"), f"{name}-sets")


def _links_in_block(members: pd.DataFrame, visitors: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """For each visitor, one member that it links with in every other component of the block."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in members["shingles"]]
    sizes = np.array([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    ids, homes, out = members["doc"].to_numpy(), members["component"].to_numpy(), []
    for doc, home, raw in zip(visitors["doc"], visitors["component"], visitors["shingles"], strict=True):
        x = np.frombuffer(raw, dtype=np.uint64)
        low, high = np.searchsorted(tokens, x, side="left"), np.searchsorted(tokens, x, side="right")
        spans = high - low
        at = np.repeat(low - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((den * both >= num * (len(x) + sizes - both)) & (homes != home) & (ids != doc))
        _, first = np.unique(homes[near], return_index=True)
        out += [(int(doc), int(ids[near[k]])) for k in first]
    return out


def _open_links(lists: DataFrame, first: DataFrame, docs: DataFrame, work: Workspace, words: int, num: int, den: int) -> DataFrame:
    """Links between sets that the first round has left in two components; every such pair is held against the rules.

    Sets of one large component, and sets of small ones that share their most
    frequent shingle, form blocks of like sizes. A set visits a block if it shares as many prefix shingles with
    its sets as the smaller l asks for; the task counts the overlaps with all
    sets of the block at once. So the rows are visits of blocks, not pairs, and a
    visitor returns one link a component. Of two components only the one of fewer
    sets (of equals, the one of the lesser id) visits: that holds for all
    shingles alike, so the visitor counts every one that a pair shares.
    """
    of = first.select(F.col("node").alias("doc"), "component")
    weights = work.keep(of.groupBy("component").agg(F.count("*").alias("weight")), "open-weights")
    of = of.join(hint_small(weights, 40), "component")
    rows = lists.select("token", "doc", "n", "matches", "rank").join(of, "doc", "left")
    rows = rows.withColumns({"component": F.coalesce("component", "doc"), "weight": F.coalesce("weight", F.lit(1))}).withColumn("small", F.col("weight") <= SMALL_COMPONENT)
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("size"))
    lists_open = sizes.groupBy("token").agg(F.count("*").alias("parts"), F.sum("size").alias("length")).where("parts > 1").drop("parts")
    rows = work.keep(rows.join(lists_open, "token").dropDuplicates(["token", "doc"]), "open-rows")

    # Small components go together by the most frequent shingle, which the sets of one family share.
    label = rows.groupBy("doc", "component", "small", "n").agg(F.max_by("token", F.struct("length", "token")).alias("token"))
    label = label.select("doc", "component", "small", F.when(F.col("small"), F.col("token")).otherwise(F.col("component")).alias("label"), F.floor(F.log(F.col("n").cast("double")) / np.log(1.2)).cast("int").alias("band"), "n")
    label = work.keep(label, "open-labels")
    group = ["label", "small", "band"]
    crowded = label.groupBy(*group).agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts")).where("parts > 1")
    placed = label.join(hint_small(work.keep(crowded, "open-crowded"), 40), group, "left")
    block = F.xxhash64(*group, F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))))
    placed = work.keep(placed.select("doc", "component", block.alias("block")), "open-blocks")

    level = F.expr(f"greatest(1, rank + 1 - (n - cast(ceil({num} * n / {den}) as int)))")
    rows = rows.withColumn("level", level).join(placed.select("doc", "block"), "doc")
    of_block = rows.groupBy("token", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("level").alias("block_level"), F.min("matches").alias("least"), F.max("matches").alias("most"), F.max("weight").alias("block_weight"), F.max("component").alias("last")
    )
    fits = f"{num} * n <= {den} * high and {num} * low <= {den} * n and (weight < block_weight or weight = block_weight and component < last)"
    met = rows.select("token", "doc", "n", "matches", "level", "component", "weight").join(of_block, "token").where(fits)
    met = met.where("greatest(level, block_level) <= least(matches, most)")
    visits = met.groupBy("doc", "component", "block").agg(F.count("*").alias("shared"), F.min(F.least("matches", "least")).alias("need")).where("shared >= need").select("doc", "component", "block")
    visits = work.keep(visits, "open-visits")

    blocks = visits.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_VISITS).cast("int").alias("shares"))
    members = placed.join(blocks, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    visitors = visits.join(blocks, "block").withColumn("share", F.pmod(F.xxhash64("doc"), "shares").cast("int"))
    # One join gives members and visitors their sets.
    both = members.select("block", "share", "doc", "component", F.lit(False).alias("visits")).unionByName(visitors.select("block", "share", "doc", "component", F.lit(True).alias("visits")))
    both = work.keep(both, "open-rolls")
    sets = _sets(both.select(F.col("doc").alias("doc_id")).distinct(), docs, work, "open", words)

    def hold(rows: pd.DataFrame) -> pd.DataFrame:
        visits = rows["visits"].to_numpy()
        links = _links_in_block(rows[~visits], rows[visits], num, den) if 0 < visits.sum() < len(rows) else []
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    full = both.withColumnRenamed("doc", "doc_id").join(sets, "doc_id").withColumnRenamed("doc_id", "doc")
    return work.keep(full.groupBy("block", "share").applyInPandas(hold, "a long, b long"), "open-links")
