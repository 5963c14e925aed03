"""Fixity audit of replicated WARC files with Merkle trees.

Records are hashed where they lie: a leaf covers one record, named by its file
and offset; a parent hashes its children in order of offset. Two replicas
compare the roots of their files and go down only where digests differ.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import reader, writer
from .storage import Workspace

FAN_OUT = 16
#: Pages of one WARC file, and the numbers that a task has for its files.
FILE_PAGES, TASK_FILES = 2_000, 1 << 32
_DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One WARC/1.1 resource record, not compressed."""
    body = (html or "").encode()
    head = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {'' if url is None else url.replace(chr(13), ' ').replace(chr(10), ' ')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member of one record, the same bytes each time."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def write_replicas(pages: DataFrame, folders: list[str], damaged=None, file_pages: int = FILE_PAGES) -> DataFrame:
    """Write pages(page_id, url, html) as WARC files, once into each folder; return their manifest (replica, file, path, records, bytes).

    replica counts the folders from 0. Each task writes its rows as they come, in
    files of at most ``file_pages`` records; nothing is shuffled, and neither
    null nor repeated page_ids fill a file. All replicas come from one pass over
    the pages: they hold the same records at the same offsets. Null urls and
    html are empty; null page_ids and repeated rows are records like others. A
    table without rows writes no file. A task that runs again writes files of
    its own; only those in the manifest count.

    damaged(replica, page_id) -> bool spoils one stored byte of a record (for
    audits of known faults).
    """
    schema = "replica int, file long, path string, records long, bytes long"

    def write(batches):
        from pyspark import TaskContext

        paths, outs, at, count, file = [], [], 0, 0, TaskContext.get().partitionId() * TASK_FILES

        def ended():
            for out in outs:
                out.close()
            n = len(paths)
            return pa.RecordBatch.from_pydict({"replica": pa.array(range(n), pa.int32()), "file": pa.array([file] * n, pa.int64()), "path": paths, "records": [count] * n, "bytes": [at] * n})

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if count == file_pages:
                    yield ended()
                    file, outs = file + 1, []
                if not outs:
                    at = count = 0
                    paths = [f"{folder}/{file:012d}-{uuid.uuid4().hex}.warc.gz" for folder in folders]
                    outs = [writer(path) for path in paths]
                raw = member(record(page_id, url, html))
                for k, out in enumerate(outs):
                    if damaged is not None and damaged(k, page_id):
                        place = len(raw) // 2
                        out.write(raw[:place] + bytes([raw[place] ^ 0x5A]) + raw[place + 1 :])
                    else:
                        out.write(raw)
                at += len(raw)
                count += 1
        if outs:
            yield ended()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(write, schema)


#: How every member starts: no name, no time.
_HEADER = member(b"")[:10]
_PIECE = 1 << 16
#: Leaves of one record batch.
_ROWS = 4_096


class _Window:
    """The bytes of a file from some place on, read a piece at a time."""

    def __init__(self, file):
        self.file, self.raw, self.at = file, bytearray(), 0

    def more(self) -> bool:
        piece = self.file.read(_PIECE)
        self.raw += piece
        return bool(piece)

    def drop(self, n: int) -> None:
        del self.raw[:n]
        self.at += n

    def inflate(self) -> tuple[int, bytes] | None:
        """Stored bytes of the member that starts here, and its record's head; None if it can't be inflated."""
        pack, head, fed = zlib.decompressobj(31), b"", 0
        try:
            while not pack.eof:
                if fed == len(self.raw) and not self.more():
                    return None
                out = pack.decompress(bytes(self.raw[fed : fed + _PIECE]))
                fed = min(fed + _PIECE, len(self.raw))
                if b"\r\n\r\n" not in head:
                    head += out
        except zlib.error:
            return None
        return fed - len(pack.unused_data), head

    def next_header(self) -> int:
        """Where the next member after the one that starts here begins, or the end of the file."""
        start = 1
        while (found := self.raw.find(_HEADER, start)) < 0:
            start = max(1, len(self.raw) - len(_HEADER) + 1)
            if not self.more():
                return len(self.raw)
        return found


def members(file):
    """(offset, length, page_id, SHA-256) of each member of a file, which is read piece by piece."""
    window = _Window(file)
    while window.raw or window.more():
        found = window.inflate()
        end, head = found or (window.next_header(), b"")
        name = head[: head.find(b"\r\n\r\n")].partition(b"<urn:page:")[2].partition(b">")[0]
        yield window.at, end, int(name) if name.lstrip(b"-").isdigit() else None, hashlib.sha256(window.raw[:end]).hexdigest()
        window.drop(end)


def read_leaves(manifest: DataFrame) -> DataFrame:
    """(file, leaf, offset, length, page_id, digest) of every record of a replica, by one pass over its files.

    A member that can't be inflated ends where the next member's header starts;
    it is a record like others, with a null page_id. A task holds one record at
    a time. A manifest without files gives no leaves.
    """
    names = ["file", "leaf", "offset", "length", "page_id", "digest"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def read(batches):
        for batch in batches:
            for f, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with reader(path) as file:
                    found = ((f, leaf, *row) for leaf, row in enumerate(members(file)))
                    while rows := list(islice(found, _ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    spread = manifest.select("file", "path").repartition(max(1, manifest.count()), "file")
    return spread.mapInArrow(read, "file long, leaf long, offset long, length long, page_id long, digest string")


def _parents(nodes: DataFrame) -> DataFrame:
    """One level up: (file, node, digest) over ranges of FAN_OUT children in order."""
    inside = F.array_sort(F.collect_list(F.struct("node", "digest")))
    grouped = nodes.groupBy("file", F.expr(f"node div {FAN_OUT}").alias("parent")).agg(inside.alias("c"))
    joined = F.array_join(F.transform("c", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), "|")
    return grouped.select("file", F.col("parent").alias("node"), F.sha2(joined, 256).alias("digest"))


def tree(leaves: DataFrame, work: Workspace, name: str) -> list[DataFrame]:
    """Levels from the leaves (file, node, digest; a leaf digests its offset range too) up to one root a file."""
    seal = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    level = leaves.select("file", F.col("leaf").alias("node"), seal.alias("digest"))
    highest = leaves.agg(F.max("leaf")).first()[0] or 0
    out = [work.keep(level, f"{name}-0")]
    while highest:
        highest //= FAN_OUT
        out.append(work.keep(_parents(out[-1]), f"{name}-{len(out)}"))
    return out


def differing_leaves(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(file, node, in_a, in_b) of the leaves that differ, found from the roots down.

    Trees of unequal height are compared from the lower one's top.
    """
    top = min(len(a), len(b)) - 1
    suspects = None
    for level in range(top, -1, -1):
        left, right = a[level].withColumnRenamed("digest", "x"), b[level].withColumnRenamed("digest", "y")
        if suspects is not None:
            under = suspects.select("file", F.col("node").alias("parent"))

            def below(side: DataFrame, under=under) -> DataFrame:
                return side.withColumn("parent", F.expr(f"node div {FAN_OUT}")).join(under, ["file", "parent"], "left_semi").drop("parent")

            left, right = below(left), below(right)
        suspects = left.join(right, ["file", "node"], "full").where("not (x <=> y)")
    return suspects.select("file", "node", F.col("x").isNotNull().alias("in_a"), F.col("y").isNotNull().alias("in_b"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every record of the first replica: file, leaf, offset, length, page_id, digest, status.

    first, second: manifests. status is ok, corrupt (the other replica's record
    at this place differs) or missing (it has none); a record that only the
    second has is extra. Replicas without files give no rows. Records with null
    or repeated page_ids are audited each, by file and offset.
    """
    work = Workspace(first.sparkSession, "warc")
    a, b = (work.keep(read_leaves(m), f"leaves-{n}") for m, n in ((first, "a"), (second, "b")))
    found = work.keep(differing_leaves(tree(a, work, "tree-a"), tree(b, work, "tree-b")), "differing")
    status = F.when(F.col("in_a").isNull(), "ok").when(~F.col("in_b"), "missing").otherwise("corrupt")
    own = a.join(found.where("in_a").withColumnRenamed("node", "leaf"), ["file", "leaf"], "left")
    extra = b.join(found.where("not in_a").withColumnRenamed("node", "leaf"), ["file", "leaf"])
    columns = ["file", "leaf", "offset", "length", "page_id", "digest"]
    return own.select(*columns, status.alias("status")).unionByName(extra.select(*columns, F.lit("extra").alias("status")))
