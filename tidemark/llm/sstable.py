"""Token ids in sorted-string-table shards, looked up by document id.

A shard holds documents in ascending order of doc_id. Layout, little-endian:

    blocks          zstd: keys, each as (shared prefix length u8, rest length u8, rest), with
                    the count of its ids u64; then the ids of all keys, u16 or u32
    block index     per block: offset u64, stored bytes u32, entries u32, first id's number u64,
                    last key (length u8, bytes)
    Bloom filter    bits over the keys
    footer          56 bytes: index offset, index bytes, filter offset, filter bytes, documents,
                    ids (u64 each), id width u8, hashes u8, zeros u16, magic "TMS1"

Keys are one byte (0 for a null id, 1 otherwise) and the id as a big-endian
integer with its sign bit flipped, so that byte order is the order of the ids.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import reader, writer
from .storage import Workspace

MAGIC = b"TMS1"
FOOTER = struct.Struct("<6QBBH4s")
BLOCK_IDS = 1 << 18
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Documents of one shard, by which the table is cut into ranges.
SHARD_DOCS = 8_192


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 32) | 1
    return [(h + k * step) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard; documents must come in order of their keys."""

    def __init__(self, out, wide: bool = False):
        self.out, self.type = out, np.dtype("<u4" if wide else "<u2")
        self.at = self.docs = self.ids = self.block_ids = self.block_first = 0
        self.keys: list[bytes] = []
        self.parts: list[np.ndarray] = []
        self.index: list[bytes] = []
        self.hashes: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.keys.append(key_of(doc_id))
        self.parts.append(ids.astype(self.type))
        self.block_ids += len(ids)
        if self.block_ids >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        if not self.keys:
            return
        body, before = [], b""
        for key, ids in zip(self.keys, self.parts, strict=True):
            shared = next((i for i, (a, b) in enumerate(zip(key, before, strict=False)) if a != b), min(len(key), len(before)))
            body.append(struct.pack("<BB", shared, len(key) - shared) + key[shared:] + struct.pack("<Q", len(ids)))
            before = key
        raw = self.pack.compress(b"".join(body) + b"".join(p.tobytes() for p in self.parts))
        self.out.write(raw)
        last = self.keys[-1]
        self.index.append(struct.pack("<QIIQB", self.at, len(raw), len(self.keys), self.ids, len(last)) + last)
        self.at += len(raw)
        self.docs += len(self.keys)
        self.ids += self.block_ids
        self.hashes += self.keys
        self.keys, self.parts, self.block_ids = [], [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.hashes))
        bloom = np.zeros(bits, dtype=bool)
        for key in self.hashes:
            bloom[_bloom_places(key, bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.docs, self.ids, self.type.itemsize, BLOOM_HASHES, 0, MAGIC))
        self.out.close()


class Shard:
    """Reads one shard: in order, or one document by filter, index search and block."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - FOOTER.size)
        at, size, self.bloom_at, self.bloom_size, self.docs, self.ids, width, _, _, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.type = np.dtype("<u2" if width == 2 else "<u4")
        file.seek(at)
        raw, self.blocks, place = file.read(size), [], 0
        while place < len(raw):
            offset, stored, entries, first, length = struct.unpack_from("<QIIQB", raw, place)
            place += 25 + length
            self.blocks.append((raw[place - length : place], offset, stored, entries, first))

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, stored, entries, _ = self.blocks[k]
        self.file.seek(offset)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(stored))
        at, before, heads = 0, b"", []
        for _ in range(entries):
            shared, rest = raw[at], raw[at + 1]
            before = before[:shared] + raw[at + 2 : at + 2 + rest]
            at += 2 + rest
            heads.append((before, struct.unpack_from("<Q", raw, at)[0]))
            at += 8
        for key, n in heads:
            yield key, np.frombuffer(raw, dtype=self.type, count=n, offset=at)
            at += n * self.type.itemsize

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this id (none: an empty list)."""
        key = key_of(doc_id)
        self.file.seek(self.bloom_at)
        raw = self.file.read(self.bloom_size)
        bits = struct.unpack_from("<Q", raw)[0]
        if not all(raw[8 + (p >> 3)] >> (p & 7) & 1 for p in _bloom_places(key, bits)):
            return []
        found, k = [], bisect_left([b[0] for b in self.blocks], key)
        while k < len(self.blocks):
            found += [ids for other, ids in self._block(k) if other == key]
            if self.blocks[k][0] > key:
                break
            k += 1
        return found


class Encoder:
    """Ids of whole texts as the tokenizer gives them, each distinct word of a call encoded once.

    A byte-level tokenizer with its own pattern cuts before every single space
    between two other characters, and encodes the pieces one by one. Where that
    is so, Arrow cuts the texts there and numbers the distinct pieces, these are
    encoded, and Arrow gathers their ids again; texts with other spaces, texts
    that spell an added token, and other tokenizers, are encoded whole. The
    pattern also ends a run of letters before any other character and never looks
    back, so a piece's letters and what follows them are encoded apart.
    """

    #: Texts of one call of the tokenizer; longer lists are slower by the text.
    CALL = 64
    #: Pieces that are joined to one text for the tokenizer.
    JOINED = 256
    #: Bytes of texts whose pieces are numbered together, unless one text has more.
    TOGETHER = 16 << 20
    #: A run of letters to the end or to an ASCII character that is none; only letters of which every version of Unicode agrees.
    LETTERS = (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250))
    HALVES = r"^(?P<front>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<back>(?:[\x00-\x40\x5B-\x60\x7B-\x7F](?s:.*))?)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in rules["added_tokens"]]
        cutter = rules["pre_tokenizer"] or {}
        self.by_piece = rules["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter["add_prefix_space"]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        # Ids of tokens whose first byte is a space, which the byte-level alphabet writes as a G with a dot.
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        #: What the tokenizer's model is given for a space and for the letters of a front.
        self.spelled = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in (0x20, *self.LETTERS)}
        self.model = Tokenizer.from_str(json.dumps({**rules, "pre_tokenizer": None})) if self.by_piece and self._keeps_apart(rules["model"]) else None

    def _keeps_apart(self, model: dict) -> bool:
        """Whether the model alone, without a cut, gives spaced runs of letters the ids that it gives each: no merge joins letters to a space after them."""
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        letters, space = set("".join(self.spelled[c] for c in self.LETTERS)), self.spelled[0x20]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return not any(right.startswith(space) and letters.issuperset(left.removeprefix(space)) and left != space for left, right in pairs)

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        encode = (tokenizer or self.tokenizer).encode_batch_fast
        calls = (texts[i : i + self.CALL] for i in range(0, len(texts), self.CALL))
        return [np.array(e.ids, dtype=self.type) for some in calls for e in encode(some, add_special_tokens=False)]

    def _stored(self, ids: list[np.ndarray], sizes: np.ndarray | None = None) -> pa.Array:
        """The ids of many pieces as one column of bytes; sizes: how many ids each has, where the arrays hold several pieces."""
        sizes = np.array([len(x) for x in ids], dtype=np.int64) if sizes is None else sizes
        offsets = np.append(0, np.cumsum(sizes)) * self.type.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([np.zeros(0, self.type), *ids]))])

    def _after_space(self, pieces: list[str], letters: np.ndarray) -> pa.Array:
        """Ids of each piece after a space (an empty one: none), many pieces to a call: only a piece's first id begins with a space.

        letters: which pieces are fronts; these need no cut by the tokenizer's pattern.
        """
        asked = np.fromiter(map(bool, pieces), dtype=bool, count=len(pieces))
        fronts = letters & asked if self.model else np.zeros(len(pieces), dtype=bool)
        found, order, sizes = [], [], []
        for mine, alone in ((fronts, True), (asked & ~fronts, False)):
            places = np.flatnonzero(mine).tolist()
            order += places
            for i in range(0, len(places), self.JOINED):
                some = [pieces[k] for k in places[i : i + self.JOINED]]
                text = " " + " ".join(some)
                ids = self._ids([text.translate(self.spelled)], self.model) if alone else self._ids([text])
                starts = np.flatnonzero(self.spaced[ids[0]])
                if len(starts) != len(some):
                    ids = self._ids([" " + p for p in some])
                    starts = np.cumsum([0, *map(len, ids[:-1])])
                sizes.append(np.diff(starts, append=sum(map(len, ids))))
                found += ids
        # Stored in the order asked, with the empty ones last; taken back into the order given.
        place = np.full(len(pieces), len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return self._stored(found, np.concatenate([*sizes, np.zeros(1, dtype=np.int64)])).take(pa.array(place))

    def _distinct(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of each piece after a space, and which pieces can't be encoded alone: empty ones, and those with white space at an end."""
        halves = pc.extract_regex(pieces, self.HALVES)
        fronts = pc.coalesce(pc.struct_field(halves, "front"), pieces).dictionary_encode()
        backs = pc.fill_null(pc.struct_field(halves, "back"), "").dictionary_encode()
        front, back = fronts.indices.to_numpy(), backs.indices.to_numpy()
        after, tails = fronts.dictionary.to_pylist(), backs.dictionary.to_pylist()
        # Pieces that have no such halves are their own fronts.
        uncut = np.flatnonzero(halves.is_null().to_numpy(zero_copy_only=False))
        letters = np.ones(len(after), dtype=bool)
        letters[front[uncut]] = False
        odd = np.array([t != t.strip() for t in tails], dtype=bool)[back]
        odd[uncut] = [not after[k] or after[k] != after[k].strip() for k in front[uncut].tolist()]
        for k in front[uncut[odd[uncut]]].tolist():
            after[k] = ""
        either = pa.concat_arrays([self._after_space(after, letters), self._stored(self._ids(tails))])
        _, at, raw = either.take(pa.array(np.stack([front, back + len(after)], axis=1).ravel())).buffers()
        offsets = np.frombuffer(at, dtype=np.int64)[: 2 * len(pieces) + 1 : 2].copy()
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(offsets), raw or pa.py_buffer(b"")]), odd

    def _by_piece(self, texts: pa.Array) -> list[np.ndarray | None]:
        """Ids of each text by its pieces; None where one of them can't be encoded alone."""
        cut = pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        numbered = cut.flatten().dictionary_encode()
        pieces, codes = numbered.dictionary, numbered.indices.to_numpy().copy()
        del cut, numbered
        spaced, odd = self._distinct(pieces)
        whole = np.logical_or.reduceat(odd[codes], ends[:-1])
        # The pieces at the start of a text have no space before them: they are numbered after the others.
        heads, place = np.unique(codes[ends[:-1]], return_inverse=True)
        codes[ends[:-1]] = len(pieces) + place
        first = self._stored(self._ids(pieces.take(pa.array(heads)).to_pylist()))
        _, at, raw = pa.concat_arrays([spaced, first]).take(pa.array(codes)).buffers()
        bounds = np.frombuffer(at, dtype=np.int64)[ends] // self.type.itemsize
        ids = np.frombuffer(raw or b"", dtype=self.type)
        return [None if w else ids[a:b] for w, a, b in zip(whole.tolist(), bounds.tolist(), bounds[1:].tolist(), strict=False)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends, a = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + self.TOGETHER, "right")))
            yield from self._encode(texts.slice(a, b - a))
            a = b

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        found: list[np.ndarray | None] = [None] * len(texts)
        if self.by_piece:
            mine = np.ones(len(texts), dtype=bool)
            for token in self.added:
                mine &= ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
            if mine.any():
                for k, ids in zip(np.flatnonzero(mine).tolist(), self._by_piece(texts.filter(pa.array(mine))), strict=True):
                    found[k] = ids
        whole = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(whole, self._ids(texts.take(pa.array(whole, pa.int64())).to_pylist()), strict=True):
            found[k] = ids
        return found


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, whatever the number of its tasks.

    The tokenizer's own threads are off: a worker has one core, and small calls
    to a pool of threads cost as much again as their work.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, work: Workspace, end_id: int = 0, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Tokenize and write documents(doc_id, text); return the manifest.

    Manifest: shard (in order of doc_id), path, docs, ids, low, high. A retried
    task writes a file of its own; only files in the manifest count. Null texts
    are empty; every document ends with ``end_id``. Null doc_ids come first.
    """

    def write(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer_path)
        path = f"{folder}/{uuid.uuid4().hex}.sst"
        out = low = high = None
        for batch in batches:
            for doc_id, e in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1)), strict=True):
                if out is None:
                    out, low = ShardWriter(writer(path), encode.wide), doc_id
                out.add(doc_id, np.append(e, e.dtype.type(end_id)))
                high = doc_id
        if out is not None:
            out.close()
            row = {"part": [TaskContext.get().partitionId()], "path": [path], "docs": [out.docs], "ids": [out.ids], "low": [low], "high": [high]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(1, -(-rows.count() // shard_docs))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = work.keep(ranged.mapInArrow(write, "part int, path string, docs long, ids long, low long, high long"), "files")
    # One row a file: the running totals need their order only.
    order = W.orderBy("part")
    return work.keep(files.select((F.row_number().over(order) - 1).alias("shard"), "path", "docs", "ids", "low", "high", (F.sum("ids").over(order) - F.col("ids")).alias("before")), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard`` of every stored document, from the files."""

    def read(batches):
        for batch in batches:
            for shard, path, before in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = [[], [], [], []]
                with reader(path) as file:
                    for doc_id, ids in Shard(file).scan():
                        for r, v in zip(rows, (doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            r.append(v)
                        before += len(ids)
                yield pa.RecordBatch.from_arrays([*[pa.array(r, pa.int64()) for r in rows], pa.array([shard] * len(rows[0]), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    spread = manifest.select("shard", "path", "before").repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def encode(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the token shards of ``docs`` and return what ``read_shards`` finds in them.

    folder: where the files go (default: the shared folder). A table without
    rows writes no file and returns no row. Repeated doc_ids are stored each, in
    order of their texts.
    """
    work = Workspace(docs.sparkSession, "sstable")
    return read_shards(write_shards(docs, tokenizer_path, folder or f"{work.path}/shards", work, end_id))
