"""Documents as files that appear whole or not at all: JSON objects, reports, contracts of a root, archives before a change.

``spark.write.format("document_files")`` writes each row (name, body) as a file.
Tasks write under a folder of their own below ``_pending``; the files take their
places when all tasks are done, and a failed job removes what it wrote. A task
that still runs then may leave its part below ``_pending``, which is no output.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..expect import ExpectationError

_NAME = re.compile(r"[\w][\w.-]*")


def _resolved(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/+", uri):
        uri = "/" + re.sub(r"^file:/+", "", uri)
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return system, path.rstrip("/")


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is, and its name


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return f"{root}/_pending/{self.job}"

    def write(self, iterator):
        system, root = _resolved(self.path)
        folder = f"{self._pending(root)}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        files = []
        for row in iterator:
            if row.name is None or not _NAME.fullmatch(row.name):
                raise ValueError(f"not a file name: {row.name!r}")
            with system.open_output_stream(f"{folder}/{row.name}", compression=None) as out:
                out.write((row.body or "").encode())
            files.append((f"{folder}/{row.name}", row.name))
        return _Written(files)

    def commit(self, messages):
        system, root = _resolved(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        there = [] if self.overwrite else [name for name, info in zip(names, system.get_file_info([f"{root}/{n}" for n in names]), strict=True) if info.type != fs.FileType.NotFound]
        if len(set(names)) < len(names) or there:
            self._clean(system, root)
            raise ExpectationError(f"files that are there already, or twice: {there[:5] or sorted({n for n in names if names.count(n) > 1})[:5]}")
        for source, name in files:
            system.move(source, f"{root}/{name}")
        self._clean(system, root)

    def abort(self, messages):
        self._clean(*_resolved(self.path))

    def _clean(self, system, root: str) -> None:
        if system.get_file_info(self._pending(root)).type != fs.FileType.NotFound:
            system.delete_dir(self._pending(root))
        pending = f"{root}/_pending"
        if system.get_file_info(pending).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(pending)):
            system.delete_dir(pending)


class DocumentFiles(DataSource):
    """Option: path, in a store that driver and tasks share. Columns: name, body. Mode append refuses names that are there; overwrite replaces them."""

    @classmethod
    def name(cls):
        return "document_files"

    def schema(self):
        return "name string, body string"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def write_documents(documents: DataFrame, path: str, overwrite: bool = False) -> None:
    """documents(name, body) as files of a folder, all or none."""
    documents.sparkSession.dataSource.register(DocumentFiles)
    rows = documents.select(F.col("name").cast("string"), F.col("body").cast("string"))
    rows.write.format("document_files").option("path", path).mode("overwrite" if overwrite else "append").save()


def json_objects(rows: DataFrame, name: Column, columns: list[str] | None = None) -> DataFrame:
    """(name, body): each row's columns, in the order of their names, as a JSON object."""
    value = F.struct(*sorted(columns or rows.columns))
    return rows.select(name.alias("name"), F.to_json(value, {"ignoreNullFields": "false", "pretty": "true"}).alias("body"))


def report(sections: list[tuple[str, DataFrame, str]], name: str, title: str) -> DataFrame:
    """(name, body): one Markdown document. Of each section (heading, rows, a format over the rows' columns) every row is a line, in the order of the lines' columns.

    For tables of few rows, as an aggregation leaves them; the lines of a section
    meet in one row.
    """
    parts = None
    for at, (heading, rows, form) in enumerate(sections):
        line = F.format_string(form, *rows.columns)
        lines = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*rows.columns).alias("k"), line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
        part = lines.select(F.lit(at).alias("at"), F.concat(F.lit(f"## {heading}\n\n"), F.col("lines")).alias("text"))
        parts = part if parts is None else parts.unionByName(part)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return parts.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(texts, "\n\n"), F.lit("\n")).alias("body")).select(F.lit(name).alias("name"), "body")


def content_hash(rows: DataFrame) -> dict:
    """How many rows, and a digest of them that their order and partitions do not change: sums of two 64-bit hashes of each row.

    Nulls count as values, equal rows as often as they occur, and a column's
    name and type are part of the digest.
    """
    cells = [x for c in rows.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"s{seed}") for seed in (1, 2)]
    found = rows.agg(F.count("*").alias("rows"), *sums).first()
    text = "|".join([rows.schema.simpleString(), str(found["rows"]), found["s1"], found["s2"]])
    digest = rows.sparkSession.range(1).select(F.sha2(F.lit(text), 256).alias("d")).first()["d"]
    return {"rows": found["rows"], "digest": digest}


def _read_json(spark: SparkSession, path: str) -> dict | None:
    system, file = _resolved(path)
    if system.get_file_info(file).type == fs.FileType.NotFound:
        return None
    with system.open_input_file(file) as f:
        return json.loads(f.read())


def _write_json(spark: SparkSession, folder: str, name: str, value: dict) -> None:
    write_documents(spark.createDataFrame([(name, json.dumps(value, sort_keys=True, indent=2))], "name string, body string"), folder)


def open_root(census: DataFrame, path: str, terms: dict) -> dict:
    """The contract of a root folder: written with a first census, checked with every later one.

    census: the keys (dates, say) that the root is for; terms: whatever else must
    not change. A root without a contract, or with one of another census or other
    terms, is an error: nothing is mixed into it.
    """
    spark = census.sparkSession
    wanted = {"census": content_hash(census), "terms": json.loads(json.dumps(terms))}
    system, folder = _resolved(path)
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        _write_json(spark, path, "contract.json", wanted)
        return wanted
    found = _read_json(spark, f"{path.rstrip('/')}/contract.json")
    if found is None:
        raise ExpectationError(f"{path} is there without a contract")
    if found != wanted:
        raise ExpectationError(f"{path} has another contract: {found} instead of {wanted}")
    return found


def archive(spark: SparkSession, table: str, archive_path: str) -> dict:
    """Copy a Parquet table to a new archive beside a manifest of its content; an archive that is there is an error."""
    system, folder = _resolved(archive_path)
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        raise ExpectationError(f"{archive_path} is there already")
    rows = spark.read.parquet(table)
    manifest = {"table": table, "content": content_hash(rows)}
    copy = f"{archive_path.rstrip('/')}/rows"
    rows.write.mode("errorifexists").parquet(copy)
    if content_hash(spark.read.parquet(copy)) != manifest["content"]:
        raise ExpectationError("the copy is not the table")
    _write_json(spark, archive_path, "manifest.json", manifest)
    return manifest


def replace_archived(rows: DataFrame, table: str, archive_path: str) -> dict:
    """Overwrite a Parquet table whose present state an archive holds; refused if it holds another or none.

    After the change the archive no longer holds the present state, so that a
    second change needs another archive. Returns the new content. The rows are
    written beside the table first, so they may derive from it.
    """
    spark = rows.sparkSession
    manifest = _read_json(spark, f"{archive_path.rstrip('/')}/manifest.json")
    if manifest is None:
        raise ExpectationError(f"no archive at {archive_path}")
    held = content_hash(spark.read.parquet(f"{archive_path.rstrip('/')}/rows"))
    if manifest["content"] != held or manifest["content"] != content_hash(spark.read.parquet(table)):
        raise ExpectationError(f"{archive_path} does not hold the present state of {table}")
    beside = f"{table.rstrip('/')}-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    spark.read.schema(rows.schema).parquet(beside).write.mode("overwrite").parquet(table)
    system, folder = _resolved(beside)
    system.delete_dir(folder)
    return content_hash(spark.read.parquet(table))
