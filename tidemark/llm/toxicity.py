"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct unigrams, bigrams and one-gap skip-grams of a whole
text, each a 64-bit hash. Training takes a sample of labelled rows, bounded in
rows and in bytes, and goes over it in rounds with per-coordinate rates. L1
leaves few weights, which are broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import Workspace
from .text import LOWER, NOT_ALNUM, chunks, mix, release, signed, split_words, text_bytes

_U = np.uint64
_BIGRAM, _SKIP = _U(0xD1342543DE82EF95), _U(0xAF251AF3B0F025B5)
BIAS = 0
#: States of a round that enter the mean.
STATES = 16


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """All n-gram hashes of each text, repeats included."""
    data, offsets = text_bytes(column)
    for first, last in chunks(offsets):
        base = offsets[first]
        split = split_words(data[base : offsets[last]], offsets[first : last + 1] - base, NOT_ALNUM, LOWER)
        h = split.hashes
        pairs, skips = mix(h[:-1] * _BIGRAM + h[1:]), mix(h[:-2] * _SKIP + h[2:])
        for d in range(last - first):
            part = split.of(d)
            yield np.concatenate([h[part], pairs[part.start : max(part.start, part.stop - 1)], skips[part.start : max(part.start, part.stop - 2)]])


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of FTRL-proximal; ``weights`` is its closed form of the state."""

    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0

    def weights(self, z: np.ndarray, n: np.ndarray, free: np.ndarray | None = None) -> np.ndarray:
        l1 = np.full(len(z), self.l1)
        if free is not None:
            l1[free] = 0.0
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, bias: int) -> None:
        """One pass in the given order; rows hold coordinates, z and n change in place."""
        for x, y in zip(rows, labels, strict=True):
            w = self.weights(z[x], n[x], x == bias)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / self.alpha
            z[x] += g - sigma * w
            n[x] += g * g


def _distinct(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text, and the bias."""
    return (np.unique(np.append(f, _U(BIAS))) for f in features(column))


def _repeated(texts: list[pa.Array], least: int) -> np.ndarray:
    """The features that at least so many texts have, in order, and the bias."""
    every = np.concatenate([np.zeros(0, dtype=_U), *(x for t in texts for x in _distinct(t))])
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(every)))
    return np.union1d(every[first[counts >= least]], [_U(BIAS)])


def _learner(ftrl: Ftrl, rounds: int):
    """All rounds over the sample (text, label) of one task; yields the weights that are not 0, and the bias.

    The weights are those of the mean state (z, n) over the second half of the
    rounds, so that the last rows do not decide.
    While a weight is 0 an update changes its z by less than 1. A feature in so
    few rows that rounds times rows is at most L1 is therefore 0 at all times and
    has no part in any score: it is left out, which changes nothing.
    """

    def learn(batches):
        texts, labels = [], []
        for batch in batches:
            texts.append(batch.column(0))
            labels.append(batch.column(1).to_numpy(zero_copy_only=False))
        names = _repeated(texts, int(ftrl.l1 // rounds) + 1)
        rows = []
        for x in (x for t in texts for x in _distinct(t)):
            at = np.minimum(np.searchsorted(names, x), len(names) - 1)
            rows.append(at[names[at] == x].astype(np.int32))
        bias = int(np.searchsorted(names, _U(BIAS)))
        z, n, y = np.zeros(len(names)), np.zeros(len(names)), np.concatenate([np.zeros(0), *labels])
        z_sum, n_sum, taken = np.zeros(len(names)), np.zeros(len(names)), 0
        for k in range(rounds):
            for part in np.array_split(np.arange(len(rows)), STATES):
                ftrl.learn([rows[i] for i in part], y[part], z, n, bias)
                if 2 * k >= rounds:
                    z_sum, n_sum, taken = z_sum + z, n_sum + n, taken + 1
        weights = ftrl.weights(z_sum / max(taken, 1), n_sum / max(taken, 1), np.arange(len(names)) == bias)
        keep = (weights != 0) | (np.arange(len(names)) == bias)
        del rows, texts
        release()
        yield pa.RecordBatch.from_arrays([pa.array(signed(names[keep])), pa.array(weights[keep])], names=["feature", "weight"])

    return learn


def train(labelled: DataFrame, rows: int = 24_000, sample_bytes: int = 40 << 20, row_bytes: int = 1 << 20, rounds: int = 8, ftrl: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature hashes and their weights from labelled(doc_id, text, label).

    The bounds of the sample: at most ``rows`` rows of together ``sample_bytes``
    of text, none of more than ``row_bytes``; of the labelled rows those with the
    least hash of doc_id and text are taken, whole. One task learns from them, at
    every size of the input. Rows with a null label, doc_id or text are left out;
    repeated doc_ids count as rows each. Without rows of both labels the model is
    the bias alone (without any rows 0: every score is 0.5).
    """
    work = Workspace(labelled.sparkSession, "toxicity")
    known = labelled.where("label is not null and doc_id is not null and text is not null").select("doc_id", "text", F.col("label").cast("double").alias("label"), F.octet_length("text").cast("long").alias("size"))
    known = known.where(F.col("size") <= row_bytes).withColumn("deal", F.xxhash64("doc_id", "text"))
    # The rows are bounded before the bytes are added up, so this is a window over that many rows.
    order = ["deal", "doc_id", "label"]
    chosen = work.keep(known.orderBy(*order).limit(rows), "chosen")
    sample = chosen.withColumn("sum", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("sum") <= sample_bytes)
    learnt = sample.repartition(1).sortWithinPartitions(*order).select("text", "label").mapInArrow(_learner(ftrl, rounds), "feature long, weight double").toPandas()
    names, weights = signed_to_hash(learnt["feature"]), learnt["weight"].to_numpy()
    order = np.argsort(names)
    return names[order], weights[order]


def signed_to_hash(values) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.int64).view(_U)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of the positive label, from the whole text.

    Null, empty and wordless texts get the score of the bias alone. All other
    columns stay; one of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    schema = docs.select(*kept).schema.add(name, "double")
    at = kept.index("text")

    def apply(batches):
        names, weights = shared.value
        bias = float(weights[names == BIAS].sum())
        seen = np.zeros(1 << 16, dtype=bool)  # most features have no weight; their leading bits say so at once
        seen[names >> _U(48)] = True
        for batch in batches:
            scores = []
            for f in features(batch.column(at)):
                f = f[seen[f >> _U(48)]]
                place = np.minimum(np.searchsorted(names, f), len(names) - 1)
                hit = np.unique(place[(names[place] == f) & (f != BIAS)])
                scores.append(1.0 / (1.0 + np.exp(-np.clip(bias + weights[hit].sum(), -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*kept, name])
            release()

    return docs.select(*kept).mapInArrow(apply, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, **options) -> tuple[np.ndarray, np.ndarray]:
    """A model from the rows of docs that labels(doc_id, toxic) marks and that are not held out."""
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # The marks are bounded before the texts are read: a table of that many rows.
    work = Workspace(docs.sparkSession, "toxicity-marks")
    some = work.keep(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.get("rows", 24_000)), "marks")
    return train(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), **options)
