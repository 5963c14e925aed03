"""The pipeline on small tables against its parts by brute force."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(3, 7)))
    rows, labels = [], []
    for i in range(500):
        words = [word() for _ in range(80)]
        if toxic := i % 5 == 0:
            words[5], words[60] = "scum", "vile"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    passage = " ".join(word() for _ in range(55))
    item = " ".join(word() for _ in range(14))
    plain = [i for i in range(500) if i % 5]
    near, shared, leaked = plain[:20], plain[20:50], plain[50:60]
    texts = dict(rows)
    for k, i in enumerate(near):  # near copies of one earlier document
        copy = texts[plain[100]].split()
        copy[k % 3] = word()
        texts[1000 + i] = " ".join(copy)
    for i in shared:
        texts[i] += f" {passage} " + word()
    for i in leaked:
        texts[i] += f" {item} end"
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(9000, None, None, None, None), (9001, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # A removed toxic document must not be kept; a clean one must not go.
    want = {i: len((t or "").split()) for i, t, *_ in docs if not (i < 500 and i % 5 == 0) and i not in leaked and i < 1000 or i >= 9000}
    for i in shared[1:]:
        want[i] -= 55
    assert kept == want


def test_stages_tell_rows_of_one_doc_id_apart(spark, tmp_path):
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcde")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (2, e), (3, c), (3, c), (None, a), (None, d)], "doc_id long, text string")
    found = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == [(0, d), (1, a), (1, b), (2, e), (3, c)]

    spark.createDataFrame([(1, " ".join(a.split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == [(0, d), (1, b), (2, e), (3, c), (3, c)]


CLASHES = ["row_key", "text_key", "kept", "score", "row", "n_tokens", "component_id", "deal", "label"]


def test_stages_with_clashing_names_nulls_and_repeats(spark, tmp_path):
    """Every stage beside columns that are named as those that it makes; with null and repeated doc_ids; and on no rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(3, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    labelled = [(i, " ".join([word() for _ in range(30)] + ["scum", "vile"] * (i % 4 == 0))) for i in range(300)]
    clean = [" ".join(word() for _ in range(120)) for _ in range(4)]
    passage, item = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(12))
    rows = labelled + [(None, f"scum vile {word()} scum"), (8, "vile scum"), (7, clean[0]), (None, clean[1]), (None, clean[1]), (1000, clean[2]), (1000, clean[2]), (1000, clean[2])]
    rows += [(2000, f"{clean[3]} {passage}"), (2001, f"{passage} {some(60)}"), (None, f"{some(60)} {passage}"), (3000, f"{item} {some(60)}"), (None, f"{word()} {item}"), (None, None), (None, ""), (7, "")]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame([(i, t, *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = {f"row_key{k}": t for k, (_, t) in enumerate(rows)}

    def left(stage):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = {r["row_key"]: r for r in out.collect()}
        for r in found.values():  # the user's columns are as they were
            assert len({r[c].removeprefix(c) for c in CLASHES}) == 1
        return {k: r["text"] for k, r in found.items()}

    gone = set(text) - set(left(corpus_pipeline.drop_toxic))
    assert gone == {k for k, t in text.items() if t and "scum" in t}
    gone = set(text) - set(left(corpus_pipeline.drop_near_duplicates))
    assert sorted(text[k] for k in gone) == sorted([clean[1], clean[2], clean[2]])
    cut = left(corpus_pipeline.cut_repeats)
    assert {k: t for k, t in cut.items() if t != text[k]} == {k: t.removeprefix(f"{passage} ") for k, t in text.items() if t and t.startswith(passage)}
    gone = set(text) - set(left(corpus_pipeline.drop_contaminated))
    assert gone == {k for k, t in text.items() if t and item in t}
    packed = corpus_pipeline.pack_batches(spark, docs, str(tmp_path)).collect()
    assert sorted(r["n_tokens"] for r in packed) == sorted(len((t or "").split()) for t in text.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
