"""Document operators against brute force, with nulls, empty and long texts, repeats, empty tables and odd columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, packing, substring
from tidemark.llm.storage import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, starts string, n int"
RULE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5):
    """Originals, near and exact copies, shared passages, and the odd rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of"]) if rng.random() < 0.2 else "".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 6)))
    texts = [[word() for _ in range(rng.randint(5, 160))] for _ in range(60)]
    passage = [word() for _ in range(70)]
    out = []
    for t in texts:
        out.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            c = list(t)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = word()
            out.append(c)
    base = [word() for _ in range(90)]
    for _ in range(30):
        c = list(base)
        for _ in range(rng.randint(1, 3)):
            c[rng.randrange(90)] = word()
        out.append(c)
    for _ in range(12):
        own = [word() for _ in range(rng.randint(0, 60))]
        out.append(own[:20] + passage[rng.randint(0, 15) :] + own[20:])
    out += [list(out[3])] * 8 + [["one"], ["one"], ["two", "words"], ["Two", "WORDS"]]
    rng.shuffle(out)
    rows = [(i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(out)]
    return rows + [(900_001, None), (900_002, ""), (900_003, " \n"), (None, rows[0][1]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 7, "x", 1) for i, t in rows], SCHEMA)


def shingles(text, n):
    w = RULE.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80)])
def test_near_duplicates(spark, words, num):
    rows = corpus()
    found = jaccard.near_duplicates(frame(spark, rows), words, (num, 100), sketch_bits=18).collect()
    known = [(i, shingles(t, words)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if a and b and 100 * len(a & b) >= num * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == sorted((i, len(s), root(i)) for i, s in known)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None, None]


def test_open_links_counts_shingles_of_both_main_components(spark):
    """Two components meet in two shingles; each is the larger one in one of them."""
    common = " ".join(f"w{i}" for i in range(10))
    texts = {1: common, 11: f"{common} v"} | {i: " ".join(f"u{i}x{k}" for k in range(10)) for i in (2, 3, 12, 13)}
    n = {i: len(t.split()) for i, t in texts.items()}
    lists = [(token, i, n[i], 2, rank) for token, rank, ids in ((101, 0, (1, 2, 3, 11)), (102, 1, (11, 12, 13, 1))) for i in ids]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    first = spark.createDataFrame([(i, 1 if i < 10 else 11) for i in texts], "node long, component long")
    found = jaccard._open_links(spark.createDataFrame(lists, "token long, doc long, n int, matches int, rank int"), first, docs, Workspace(spark, "test"), 1, 85, 100)
    assert {tuple(sorted(r)) for r in found.collect()} == {(1, 11)}


def families(seed=3):
    """Families of two variant groups whose centres alone link; one-word shingles, so that texts are plain sets."""
    rng = random.Random(seed)
    docs = []
    for f in range(12):
        core = [f"f{f}c{i}" for i in range(85)]
        groups = []
        for side in "xy":
            own = core if side == "x" else [*core, *(f"f{f}y{i}" for i in range(15))]
            groups.append(own)
            docs.append(own)
            for v in range(5):
                swap = rng.sample(range(len(own)), 6)
                docs.append([f"f{f}{side}{v}s{i}" if i in swap else w for i, w in enumerate(own)])
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_families_that_link_by_their_centres(spark):
    rows = families()
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, rows), 1, (85, 100), sketch_bits=18).collect()}
    sets = [(i, set(t.split())) for i, t in rows]
    least = {i: i for i, _ in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                least[y] = x
    assert found == {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("batches", [1, 4])
def test_remove_repeats(spark, batches):
    rows = corpus()
    found = substring.remove_repeats(frame(spark, rows), width=50, batches=batches, with_text=True).collect()
    first = {}
    words = {i: RULE.findall(t or "") for i, t in rows if i is not None}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][s : s + 50]), i)
    assert len(found) == len(rows)
    removed = 0
    for r in found:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
            continue
        w = words[r["doc_id"]]
        keep = [True] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < r["doc_id"]:
                keep[s : s + 50] = [False] * 50
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
        assert r["kept"] == (kept if r["n_removed"] else None)
        removed += r["n_removed"]
    assert removed > 500


def test_contamination(spark):
    rows = corpus()
    lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t or "")
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(k, rows[k * 5][1]) for k in range(12)] + [(50, "one"), (51, "Two, words!"), (52, ""), (53, None), (54, "never seen anywhere"), (55, rows[0][1])]
    found = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    owners = {}
    for i, t in items:
        w = rule.findall(lower(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            owners.setdefault(tuple(w[s : s + 10]), set()).add(i)
    want = []
    for i, t in rows:
        w, hit, seen = rule.findall(lower(t)), set(), set()
        for n in {len(k) for k in owners}:
            for s in range(len(w) - n + 1):
                if (who := owners.get(tuple(w[s : s + n]))) is not None:
                    seen |= who
                    hit |= set(range(s, s + n))
        digest = hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(seen), digest, bool(hit)))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert sum(w[5] for w in want) > 20


def test_contamination_counts_near_items(spark):
    """Items of which a window's words all lie near each other, shuffled or not, beside those that occur as they are."""
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"x {item} y"), (2, "ten nine eight seven six five x four three two one"), (3, "ten nine eight seven six x x x x x x x x x x five four three two one"), (4, "one two"), (5, None), (1, item)]
    items = spark.createDataFrame([(1, item), (2, "two one"), (2, "two one"), (3, None), (4, "absent")], "item_id long, text string")
    found = decontaminate.contamination(frame(spark, docs), items, 10, near=12).collect()
    assert sorted((r["doc_id"], r["n_items"], r["n_near"]) for r in found) == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 0, 1), (5, 0, 0)]


@pytest.mark.parametrize("span", [3, 7])
def test_proximity(spark, span):
    """Least runs of words with all terms of a window, against every run of every document."""
    from tidemark.llm.storage import Workspace

    rng = random.Random(span)
    docs = [(i, " ".join(rng.choice("aabcdef") for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(70, "a b c b a c"), (71, None), (72, ""), (73, "x " * 5), (None, "c b a"), (70, "a b c")]
    items = [(1, "a b c"), (2, "a a"), (3, "d e f d"), (4, "b"), (5, "a zz"), (6, None), (7, "f a"), (8, "a b c d e f")]
    windows, _ = decontaminate.item_windows(spark.createDataFrame(items, "item_id long, text string"), 10)
    work = Workspace(spark, "test")
    windows = work.keep(windows, "w")
    vocabulary = work.keep(windows.select(F.explode("terms").alias("term")).unionByName(spark.createDataFrame([("",)], "term string")).distinct(), "v")
    index = decontaminate.PositionalIndex(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary, work)
    found = index.proximity(windows, span).join(windows, "window").join(index.documents(), "row").collect()
    want = []
    for i, text in docs:
        w = (text or "").split()
        for _, item in items:
            terms = set((item or "").split())
            runs = [b - a for a in range(len(w)) for b in range(a + 1, len(w) + 1) if terms and terms <= set(w[a:b])]
            if runs and min(runs) <= span:
                want.append((i, tuple(sorted(terms)), min(runs)))
    assert sorted(((r["doc_id"], tuple(sorted(set(r["terms"]))), r["least"]) for r in found), key=str) == sorted(want, key=str) and len(want) > 40


def test_packing(spark):
    rows = corpus()
    docs = frame(spark, rows)
    found = packing.pack(docs, buckets=4, budget=300, slice_rows=40).collect()
    lengths = sorted(len(RULE.findall(t or "")) for _, t in rows)
    assert sorted(r["n_tokens"] for r in found) == lengths
    some = [r for r in found if r["n_tokens"]]
    assert all(r["bucket"] is None and r["batch"] is None for r in found if not r["n_tokens"])
    assert all(r["n_tokens"] <= r["padded_length"] for r in some)
    for bucket in {r["bucket"] for r in some}:
        mine = [r for r in some if r["bucket"] == bucket]
        room = max(1, 300 // mine[0]["padded_length"])
        assert sorted((r["batch"], r["place"]) for r in mine) == [(k // room, k % room) for k in range(len(mine))]


def test_long_and_repeated_rows_are_packed_exactly(spark):
    """Lengths beyond 65,536 are boundaries as they are; rows of one doc_id and length part."""
    lengths = [70_001, 70_002, 140_003, 3, 3, 5]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)] + [(None, 4)] * 50, "doc_id long, n long")
    found = packing.pack(docs, buckets=6, budget=100_000, length=F.col("n"), slice_rows=10).collect()
    assert {r["padded_length"] for r in found} == {3, 4, 5, 70_001, 70_002, 140_003}
    fours = [r for r in found if r["padded_length"] == 4]
    assert sorted((r["batch"], r["place"]) for r in fours) == [(0, k) for k in range(50)]


def test_boundaries_are_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 60, 9))
        counts = rng.integers(1, 9, len(lengths))

        def padding(cuts, lengths=lengths, counts=counts):
            return sum(c * (min(b for b in cuts if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

        for k in (1, 2, 3, 5):
            mine = packing.boundaries(lengths, counts, k)
            best = min(padding([*cut, lengths[-1]]) for r in range(min(k, len(lengths))) for cut in itertools.combinations(lengths[:-1], r))
            assert len(mine) <= k and padding(mine) == best
    assert packing.boundaries(np.array([]), np.array([]), 3) == []


@pytest.mark.parametrize("rows", [[], [(None, None)], [(5, None), (6, "")], [(2, "a b " * 30_000), (1, "a b " * 30_000), (1, "c")]])
def test_odd_tables(spark, rows):
    docs = frame(spark, rows)
    items = spark.createDataFrame([(1, "a b a b"), (None, None)], "item_id long, text string")
    for found in (jaccard.near_duplicates(docs, sketch_bits=18), substring.remove_repeats(docs), decontaminate.contamination(docs, items), decontaminate.contamination(docs, items.limit(0)), packing.pack(docs)):
        assert found.count() == len(rows)
    if len(rows) == 3:
        kept = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring.remove_repeats(docs).collect()}
        assert kept == {(2, 60_000): 60_000, (1, 60_000): 0, (1, 1): 0}
        assert decontaminate.contamination(docs, items).agg(F.sum("n_hit")).first()[0] == 120_000
