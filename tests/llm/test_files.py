"""File-backed operators: exact round trips, lookups, known damage."""

import hashlib
import io
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import sstable, warc
from tidemark.llm.storage import Workspace

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")


def test_shard_round_trip_and_lookup():
    rng = np.random.default_rng(1)
    docs = [(None, np.array([9, 0])), *[(i, rng.integers(0, 50_000, rng.integers(1, 3000))) for i in sorted(rng.integers(-(10**6), 10**6, 400).tolist())]]
    docs.insert(50, docs[50])
    for wide in (False, True):
        out = io.BytesIO()
        out.close, raw = (lambda: None), out
        writer = sstable.ShardWriter(raw, wide)
        for doc_id, ids in docs:
            writer.add(doc_id, ids)
        writer.close()

        class File(io.BytesIO):
            def size(self):
                return len(self.getvalue())

        shard = sstable.Shard(File(raw.getvalue()))
        assert len(shard.blocks) > 1
        assert [(i, x.tolist()) for i, x in shard.scan()] == [(i, x.tolist()) for i, x in docs]
        for doc_id, _ in docs[::17]:
            assert [x.tolist() for x in shard.lookup(doc_id)] == [x.tolist() for i, x in docs if i == doc_id]
        assert sum(bool(shard.lookup(10**7 + i)) for i in range(200)) == 0


def test_encode(spark):
    path = vocabularies.path("byte_bpe_50k.json")
    rows = [(7, "Hello, world"), (-3, None), (2, ""), (2, "é漢" * 2000), (None, "null id"), (5, "<|endoftext|> is text"), (6, "a <|endoftext|> b"), (8, "a<|endoftext|>  b")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start long, shard int")
    found = sstable.encode(docs, path)
    tokenizer = tokenizers.Tokenizer.from_file(path)
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found.drop("shard").collect()), key=str) == sorted(want, key=str)
    assert sstable.encode(docs.limit(0), path).count() == 0


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    rng = random.Random(3)
    path = vocabularies.path("byte_bpe_50k.json")
    encoder, tokenizer = sstable.Encoder(path), tokenizers.Tokenizer.from_file(path)
    bits = ["the", "isn't", "'s", "'treaty", "'LL", "ation", "ÀÉ", "à", "ſ", "é", "漢", "Жд", "ɏ", "ɐ", "\u0301", "²", "ª", "×", "12", " ", "  ", "\n", "\n\n", "\r\n", "\xa0", " \xa0", "\x85", "\x1c", "\u180e", "\u200b", ".", ",", "…", "###", "😀", "\0", "<|endoftext|>", "<|endof", ""]
    texts = [rng.choice(["", " ", " "]).join(rng.choice(bits) + rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += [None, *(f"x {c}a b{c} c {c}{c}." for c in map(chr, range(0x250)))]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == want
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.large_string()).slice(50, 100))] == want[50:150]
    monkeypatch.setattr(encoder, "TOGETHER", 60)
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == want
    assert list(encoder.encode(pa.array([], pa.string()))) == []
    # A model that joins letters to the space after them can't do without the tokenizer's cut.
    rules = json.loads(tokenizer.to_str())["model"]
    assert encoder.model is not None
    assert not encoder._keeps_apart({**rules, "merges": [*rules["merges"], ["e", "\u0120t"]]})


def test_encoder_asks_for_fronts_and_tails_once():
    encoder = sstable.Encoder(vocabularies.path("byte_bpe_50k.json"))
    asked = []

    class Asked:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    encoder.tokenizer, encoder.model = Asked(encoder.tokenizer), Asked(encoder.model)
    fronts = [a + b for a in ("Water", "stone", "élan", "mark", "tide") for b in ("ing", "ed", "er", "less", "ful", "ly", "s", "y")]
    tails = ["", ".", ",", "!", "?", ".\nThen", ",***", "###", ":", ";", ")", "'s", "-like", "/2", "...", ".\nAnd"]
    words = [f + t for f in fronts for t in tails]
    texts = [" ".join(words[k:] + words[:k]) for k in range(0, len(words), 160)]
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == [encoder.tokenizer.inner.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(map(len, asked)) < sum(map(len, words)) / 8


def test_shards_follow_the_ids(spark):
    docs = spark.range(1000).select((F.lit(5000) - F.col("id") * 5).alias("doc_id"), F.concat(F.lit("number "), F.col("id")).alias("text"))
    work = Workspace(spark, "test")
    manifest = sstable.write_shards(docs, vocabularies.path("byte_bpe_50k.json"), f"{work.path}/s", work, shard_docs=128)
    files = manifest.orderBy("shard").collect()
    assert len(files) > 3 and all(a["high"] < b["low"] for a, b in zip(files, files[1:], strict=False))
    rows = sstable.read_shards(manifest).orderBy("doc_id").collect()
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]


def pages(spark, n=60):
    rows = [(i, f"http://h/{i}", "<p>" + "word " * (i % 50) + "</p>") for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None), (n, "u\r\nx", ""), (n + 1, "v", "é" * 90_000)], "page_id long, url string, html string")


def replicas(spark, tables, **options):
    """The manifest of each table's files; each is a replica of its own."""
    work = Workspace(spark, "test")
    return [work.keep(warc.write_replicas(t, [f"{work.path}/files-{k}"], **options), f"manifest-{k}") for k, t in enumerate(tables)]


def test_audit_finds_the_damage(spark):
    work = Workspace(spark, "test")
    spoiled = lambda k, i: k == 1 and i in (3, 17, 44, 61)
    both = work.keep(warc.write_replicas(pages(spark), [f"{work.path}/a", f"{work.path}/b"], spoiled, file_pages=20), "both")
    first, second = (both.where(F.col("replica") == k) for k in (0, 1))
    found = warc.audit(first, second).collect()
    assert len(found) == 63
    assert {r["page_id"] for r in found if r["status"] == "corrupt"} == {3, 17, 44, 61}
    assert {r["status"] for r in found} == {"ok", "corrupt"}
    same = warc.audit(first, first).collect()
    assert {r["status"] for r in same} == {"ok"}


def test_audit_against_brute_force(spark):
    """Leaves, offsets and digests by a plain reading of the files."""
    from tidemark.llm.files import reader

    (manifest,) = replicas(spark, [pages(spark)], file_pages=20)
    want = set()
    for m in manifest.collect():
        with reader(m["path"]) as file:
            raw = file.read()
        at = leaf = 0
        while at < len(raw):
            pack = zlib.decompressobj(31)
            body = pack.decompress(raw[at:])
            end = len(raw) - len(pack.unused_data)
            name = body.split(b"<urn:page:")[1].split(b">")[0]
            want.add((m["file"], leaf, at, end - at, int(name) if name else None, hashlib.sha256(raw[at:end]).hexdigest()))
            at, leaf = end, leaf + 1
        assert leaf == m["records"] and at == m["bytes"]
    assert {tuple(r) for r in warc.read_leaves(manifest).collect()} == want


def test_audit_of_short_and_empty_replicas(spark):
    rows = [(i, f"u{i}", "x" * i) for i in range(42)]
    full, short, empty = replicas(spark, [spark.createDataFrame(r, "page_id long, url string, html string").coalesce(1) for r in (rows, rows[:21], [])], file_pages=1000)
    assert {r["status"]: r["count"] for r in warc.audit(full, short).groupBy("status").count().collect()} == {"ok": 21, "missing": 21}
    assert warc.audit(short, full).where("status = 'extra'").count() == 21
    assert warc.audit(empty, empty).count() == 0


def test_null_and_repeated_pages_are_dealt_over_files(spark):
    rows = [(None, None, None)] * 40 + [(7, "u", "same")] * 40
    (manifest,) = replicas(spark, [spark.createDataFrame(rows, "page_id long, url string, html string")], file_pages=10)
    assert manifest.count() > 4 and max(m["records"] for m in manifest.collect()) < 30
    assert warc.read_leaves(manifest).groupBy("page_id").count().orderBy("page_id").collect() == [(None, 40), (7, 40)]


def test_damaged_members_end_at_the_next_header():
    raws = [bytearray(warc.member(warc.record(i, "u", "text " * 60_000))) for i in range(5)]
    raws[1][len(raws[1]) // 2] ^= 0x5A
    raws[3][12] ^= 0xFF
    found = list(warc.members(io.BytesIO(b"".join(raws))))
    assert [r[2] for r in found] == [0, None, 2, None, 4]
    assert [r[1] for r in found] == [len(r) for r in raws]
    assert [r[3] for r in found] == [hashlib.sha256(r).hexdigest() for r in raws]


def test_records_are_warc():
    raw = zlib.decompress(warc.member(warc.record(4, "http://x/", "<p>é</p>")), 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 9" in head and body == "<p>é</p>".encode() + b"\r\n\r\n"
