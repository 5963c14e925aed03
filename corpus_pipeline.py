"""Corpus pipeline: toxic documents go, one of each near-duplicate class stays, repeated passages and
benchmark-contaminated documents go, and the rest is packed into batches.

doc_ids may repeat or be null. Stages that decide by row write a copy of what
they get with a key of their own, under a name that no column has, and return
the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, packing, substring, toxicity
from tidemark.llm.storage import Workspace, hint_small


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as make them names of no column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _keyed(docs: DataFrame, work: Workspace) -> tuple[DataFrame, str]:
    """A written copy of docs with row keys, and the keys' name."""
    [row] = _fresh(docs, "row_key")
    return work.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7.

    Null, empty and wordless texts score by the bias alone. Repeated rows and
    null doc_ids are scored each. Without labels of both kinds every score is
    that of the bias, 0.5 without labels, so that all stay then; a table without
    rows gives none.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    [score] = _fresh(docs, "score")
    return toxicity.score(docs, model, score).where(F.col(score) < 0.7).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each class, null last: shingles of five words, similarity 0.8.

    Rows are told apart by their key, so of exact repeats one stays, whatever
    their doc_ids; of rows with one doc_id each is judged by its own text.
    Null, empty and wordless texts are in no class and stay. No rows give none.
    """
    work = Workspace(spark, "pipeline")
    keyed, row = _keyed(docs, work)
    classes = jaccard.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), words=5, threshold=(80, 100))
    linked = work.keep(classes.where("component_id <> doc_id").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "linked")
    members = work.keep(linked.unionByName(linked.select(F.col("component").alias("row"), "component").distinct()), "members")
    members = work.keep(keyed.select(F.col(row).alias("row"), "doc_id").join(hint_small(members, 32), "row"), "members-ids")
    stays = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))["row"].alias("stays"))
    gone = members.join(hint_small(work.keep(stays, "stays"), 32), "component").where("row <> stays")
    return keyed.join(work.keep(gone.select(F.col("row").alias(row)), "duplicates"), row, "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of fifty words that an earlier document has; what is left empty by that goes.

    Earlier is a smaller doc_id. Rows with a null doc_id stay whole and take
    nothing from others; rows of one doc_id are not compared with each other.
    Null and empty texts stay as they are. n_chars, if there is one, follows the
    text. No rows give none.
    """
    work = Workspace(spark, "pipeline")
    key, kept = _fresh(docs, "text_key", "kept")
    found = substring.remove_repeats(docs.select("doc_id", "text"), width=50, with_text=True)
    changed = work.keep(found.where("n_removed > 0").select("doc_id", F.col("text_key").alias(key), F.col("kept").alias(kept)).dropDuplicates(["doc_id", key]), "changed")
    joined = docs.withColumn(key, substring.text_key(F.col("text"))).join(changed, ["doc_id", key], "left")
    whole = joined.where(F.col(kept).isNull() | (F.col(kept) != ""))
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return whole.withColumns(new).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs.

    A row goes by its own text, whatever its doc_id: null and repeated doc_ids
    are judged each. Null and empty texts stay; without items all stay. No rows
    give none.
    """
    work = Workspace(spark, "pipeline")
    keyed, row = _keyed(docs, work)
    texts = keyed.select(F.col(row).alias("row"), "doc_id", "text")
    found = decontaminate.contamination(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, row="row")
    gone = work.keep(found.where("contaminated").select(F.col("row").alias(row)), "contaminated")
    return keyed.join(gone, row, "left_anti").select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and place.

    Every row is packed, repeats and null doc_ids too; null and empty texts have
    no tokens and null places. No rows give none.
    """
    return packing.pack(docs, buckets=8, budget=8192)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_batches),
]

#: Trained scores decide the first stage; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again by the next."""
    work = Workspace(spark, "pipeline-run")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return docs
