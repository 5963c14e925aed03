"""The queries of this subpackage over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, importance, jaccard, mtree, neighbours, packing, ranking, sstable, substring, toxicity, urls, warc
from .storage import Workspace

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Every page_id of this remainder has a spoiled byte in the second replica.
DAMAGE = (997, 5)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark, folder, "embeddings")
    return neighbours.nearest(table, table.where("vec_id % 100 = 0"), 10)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), buckets=8, budget=8192)


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return html.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op5_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return sstable.encode(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"), words=4, threshold=(85, 100))


def op7_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, folder, "documents"), width=50)


def op8_fixity(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    work = Workspace(spark, "replicas")
    modulus, rest = DAMAGE
    manifest = work.keep(warc.write_replicas(pages, [f"{work.path}/a", f"{work.path}/b"], lambda replica, i: replica == 1 and i is not None and i % modulus == rest), "manifest")
    return warc.audit(manifest.where("replica = 0"), manifest.where("replica = 1"))


def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), URL_RULES)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), 10)


def op11_products(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark, folder, "embeddings")
    return mtree.top_products(table, table.where("vec_id % 20 = 0"), 20)


def op12_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), 10)


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_neighbours, op3_packing, op4_main_text, op5_token_shards, op6_jaccard, op7_substring, op8_fixity, op9_urls, op10_decontamination, op11_products, op12_ranking, op13_resampling]
    return {f.__name__: f for f in found}
