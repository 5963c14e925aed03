"""Inner-product search, ranked search and importance resampling against plain versions of the same rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, mtree, ranking
from tidemark.llm import text as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def products(rows, queries, k, scale=64):
    whole = lambda v: [math.floor(scale * x) for x in v]
    out = []
    for q, a in queries:
        near = sorted((-sum(x * y for x, y in zip(whole(a), whole(b), strict=True)), v) for v, b in rows if v != q and len(a) == len(b))
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(near[:k])]
    return sorted(out)


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE_ROWS", 8)
    monkeypatch.setattr(mtree, "TREE_ROWS", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5))
    common = [float(x) for x in rng.normal(size=5)]
    rows = [(i, common if i % 3 == 0 else [float(x) for x in centres[i % 6] + 0.1 * rng.normal(size=5)]) for i in range(400)]
    rows += [(401, [0.0] * 5), (420, [0.001, -0.001, 0.0, 0.0, 0.0]), (440, [1.0, 2.0]), (441, [1.5, -2.0]), (460, []), (461, [])]
    odd = [(500, None), (520, [float("nan")] * 5), (540, [None] * 5), (560, [float("inf")] + [1.0] * 4), (None, common)]
    table = spark.createDataFrame(rows + odd + rows[:9], "vec_id long, embedding array<double>").withColumns({"rank": F.lit("clash"), "x": F.lit(1), "row": F.lit(2)})
    for passed in (32 << 20, 1000):
        monkeypatch.setattr(mtree, "PASS_BYTES", passed)
        found = mtree.top_products(table, table.where("vec_id % 20 = 0"), 20)
        assert sorted(tuple(r) for r in found.collect()) == products(rows, [r for r in rows if r[0] % 20 == 0], 20)
    few = table.where("vec_id in (1, 20)")
    assert mtree.top_products(few, few.where("vec_id % 20 = 0")).count() == 1
    assert mtree.top_products(table.limit(0), table.limit(0)).count() == 0
    # One id with two vectors: both are candidates, and what both find is ranked together.
    twice = spark.createDataFrame([(20, [1.0]), (20, [-1.0]), (3, [2.0]), (3, [5.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in mtree.top_products(twice, twice.where("vec_id = 20"), 3).orderBy("rank").collect()] == [(3, 20480), (3, 8192), (3, -8192)]


def test_top_products_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-(2**24), 2**24, 4)]) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mtree.top_products(table, table.where("vec_id % 20 = 0"), 5)
    assert sorted(tuple(r) for r in found.collect()) == products(rows, [r for r in rows if r[0] % 20 == 0], 5)
    huge = spark.createDataFrame([(20, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        mtree.top_products(huge, huge)


def test_stored_distances_save_computations():
    rng = np.random.default_rng(8)
    x = np.floor(64 * np.concatenate([c + 0.02 * rng.normal(size=(500, 16)) for c in rng.normal(size=(12, 16))]))
    most = float((x * x).sum(axis=1).max())
    tree = mtree.Subtree(*mtree._tree(np.arange(len(x)), x, mtree._lifted(x[:1], most)[0], most, 1))
    queries = np.arange(0, len(x), 200)
    search = mtree.Search(queries, x[queries], most, 5, np.full(len(queries), -np.inf))
    search.over(tree)
    for i, q in enumerate(queries):
        score = x @ x[q]
        order = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != q][:5]
        assert search.vec[i].tolist() == order and search.score[i].tolist() == score[order].astype(int).tolist()
    assert search.computed < 0.3 * len(x) * len(queries)


def ranks(docs, items, k):
    held = [(i, words(t)) for i, t in docs]
    n, length = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    holders = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            m, times = 10 + (90 * len(w) * n) // max(length, 1), Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holders[t] + 1))) * ((10**9 * times[t]) // (1000 * times[t] + 8 * m)) for t in set(words(text)) if times[t])
            scored.append((-s, i is None, i or 0))
        out += [(item, p + 1, None if no else i, -s) for p, (s, no, i) in enumerate(sorted(scored)[:k]) if s < 0]
    return sorted(out, key=str)


def test_ranked(spark, monkeypatch):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(pool[: rng.choice([10, 60, 300])]).capitalize() for _ in range(n))
    docs = [(i, some(rng.randint(1, 120))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (8, "other Words"), (None, docs[9][1]), (None, None), (2000, None), (2001, ""), (2002, "; ,"), (2003, some(20_000))]
    items = [(i, docs[i][1]) for i in range(12)] + [(20, some(200)), (20, "twice twice"), (None, docs[3][1]), (21, ""), (22, None), (23, "unheardof"), (24, pool[0])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(1), "score": F.lit("x")}).repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(0))
    want = ranks(docs, items, 10)
    assert len(want) > 100
    for block, passed in ((8 << 20, 1 << 18), (4000, 60)):
        monkeypatch.setattr(ranking, "BLOCK_BYTES", block)
        monkeypatch.setattr(ranking, "PASS_TERMS", passed)
        assert sorted(map(tuple, ranking.ranked(table, wanted, 10).collect()), key=str) == want
    assert ranking.ranked(table.limit(0), wanted).count() == 0 and ranking.ranked(table, wanted.limit(0)).count() == 0


def test_masks_end_early():
    rng = random.Random(6)
    texts = ["rare words only here"] + [" ".join(rng.choice("abcdefgh") for _ in range(40)) + " words" for _ in range(3000)]
    [batch] = ranking._blocks([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])
    row = {"docs": np.arange(len(texts)), "no_id": np.zeros(len(texts), dtype=bool)} | {n: batch.column(n)[0].values.to_numpy() for n in ("sizes", "terms", "holders")} | {n: batch.column(n)[0].as_buffer() for n in ("doc", "times")}
    split = T.split_words(*T.text_bytes(pa.array(["rare words only a b c"])), T.NOT_ALNUM, T.LOWER)
    terms = np.sort(T.signed(split.hashes))
    weights = np.array([10 if h in T.signed(split.hashes[[1, 3, 4, 5]]) else 9000 for h in terms])
    best = ranking.Best.empty(1)
    scored = ranking.search_block(ranking._open(row, terms, weights, len(texts), sum(len(t.split()) for t in texts)), np.arange(len(terms)), best)
    assert best.doc.tolist() == [0] and scored < 300


def drawn(docs, target, percent=25, least=20, buckets=10_000):
    def features(text):
        w = words(text)
        return w, [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    held = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, w, f in held:
        weight = math.floor(Fraction(sum(map(gain, f)), max(len(f), 1)))
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    n = percent * len(able) // 100
    return Counter((*r, i + 1 if i < n else None) for i, r in enumerate(able)) + Counter((*r, None) for r in rows if r[1] < least)


def test_resample(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdefghé漢") for _ in range(rng.choice([1, 2, 3, 9, 20]))) for _ in range(400)] + ["z" * 70]
    some = lambda n: ", ".join(rng.choice(pool[: rng.choice([8, 50, 401])]).capitalize() for _ in range(n))
    docs = [(i, some(rng.randint(1, 90))) for i in range(400)]
    docs += [(900 + i, docs[5][1]) for i in range(60)] + [(5, docs[5][1]), (6, some(30)), (None, some(30)), (None, some(40)), (None, None), (800, None), (801, ""), (802, ".."), (803, some(20_000))]
    target = [some(30) for _ in range(20)] + [None, ""]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit(1), "part": F.lit("x"), "weight": F.lit(0)}).repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    for words_, pairs in ((4096, 32768), (20, 30), (1, 1)):
        found = importance.resample(table, items, head_words=words_, head_pairs=pairs).collect()
        assert Counter(map(tuple, found)) == drawn(docs, target)
    with_text = importance.resample(table, items, with_text=True).where("doc_id = 800 or doc_id = 802").select("text").collect()
    assert sorted(str(r["text"]) for r in with_text) == ["..", "None"]
    assert Counter(map(tuple, importance.resample(table, items.limit(0)).collect())) == drawn(docs, [])
    assert importance.resample(table.limit(0), items).count() == 0


def test_head_and_tail_give_one_bucket():
    texts = ["The the cat-sat on THE mat", "", "x" * 100 + " y " + "é" * 9, "the cat"]
    plain = [zlib.crc32(f.encode()) % 997 for t in texts for f in words(t)]
    data, offsets = T.text_bytes(pa.array(texts))
    split = T.split_words(data, offsets, T.NOT_ALNUM, T.LOWER)
    for head in ([], [b"the", b"cat", b"y"]):
        single, first, double = importance.feature_buckets(split, importance.build_head(head, [(b"the", b"cat"), (b"the", b"dog")], 997), 997)
        assert single.tolist() == plain
        assert double.tolist() == [zlib.crc32(f"{a} {b}".encode()) % 997 for t in texts for a, b in zip(words(t), words(t)[1:], strict=False)]
        assert len(first) == len(double)


def test_frequent_words_are_held():
    rng = np.random.default_rng(1)
    summary = importance._Frequent(8)
    keys = np.concatenate([np.repeat(np.uint64(7), 900), rng.integers(100, 10_000, 2000).astype(np.uint64)])
    rng.shuffle(keys)
    for part in np.split(keys, 10):
        summary.add(part, lambda i, part=part: int(part[i]))
    assert len(summary.keys) <= 8 and 7 in summary.keys.tolist() and set(summary.names) == set(summary.keys.tolist())
