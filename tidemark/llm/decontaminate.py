"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Postings hold the terms of the documents that any benchmark item uses, each with
its place and the term after it. A window of an item is looked up from its
rarest pair of adjacent terms: the places in that list, less the pair's offset,
are possible starts; they are intersected with the list of the next rarest pair,
and the pairs that are left must then all be at their places.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import Workspace, hint_small

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
#: The posting that ends each document; its place is the number of words.
END = ""


def _lower_ascii(word: Column) -> Column:
    """Lower-case A-Z only. Most words have no capitals and skip the character map."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(window, terms) of distinct windows, and which items have them (window, item_id)."""
    words = items.select("item_id", _words(F.translate("text", _UPPER, _LOWER)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    every = words.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("terms"))
    distinct = every.select("terms").distinct().withColumn("window", F.monotonically_increasing_id())
    return distinct, every


class PositionalIndex:
    """Stored postings (row, doc_id, term, pos, next) of ``docs`` for the terms of ``vocabulary``.

    row numbers the documents, if docs has no such column, so that null and repeated doc_ids stay apart;
    next is the following term if the vocabulary has it.
    """

    def __init__(self, docs: DataFrame, vocabulary: DataFrame, work: Workspace):
        terms = hint_small(vocabulary.select("term"), 80)
        row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
        words = docs.select(row.alias("row"), "doc_id", F.array_append(_words(F.col("text")), F.lit(END)).alias("w"))
        each = words.select("row", "doc_id", "w", F.posexplode("w").alias("pos", "raw"))
        each = each.select("row", "doc_id", "pos", _lower_ascii(F.col("raw")).alias("term"), F.get("w", F.col("pos") + 1).alias("raw_next"))
        mine = each.join(terms, "term", "left_semi").withColumn("next_word", _lower_ascii(F.col("raw_next")))
        follows = terms.select(F.col("term").alias("next"))
        rows = mine.join(follows, mine["next_word"] == follows["next"], "left").select("row", "doc_id", "term", "pos", "next")
        self.work = work
        self.postings = work.keep(rows, "postings")

    def documents(self) -> DataFrame:
        """(row, doc_id, n_words) of every document."""
        return self.postings.where(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))

    def phrases(self, windows: DataFrame) -> DataFrame:
        """(row, start, window, length) of every exact occurrence of windows(window, terms)."""
        work, postings = self.work, self.postings
        one = windows.where(F.size("terms") == 1).select("window", F.element_at("terms", 1).alias("term"))
        single = postings.join(hint_small(one, 80), "term").select("row", F.col("pos").alias("start"), "window", F.lit(1).alias("length"))

        pairs = (
            windows.where(F.size("terms") > 1)
            .select("window", "terms", (F.size("terms") - 1).alias("pairs"), F.explode(F.sequence(F.lit(0), F.size("terms") - 2)).alias("offset"))
            .select("window", "pairs", "offset", F.get("terms", F.col("offset")).alias("term"), F.get("terms", F.col("offset") + 1).alias("next"))
        )
        pairs = work.keep(pairs, "pairs")
        wanted = hint_small(work.keep(pairs.select("term", "next").distinct(), "pair-terms"), 120)
        counts = postings.join(wanted, ["term", "next"], "left_semi").groupBy("term", "next").agg(F.count("*").alias("n"))
        rarity = W.partitionBy("window").orderBy("n", "offset")
        ranked = pairs.join(counts, ["term", "next"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(rarity))
        # A window with a pair that no document has occurs nowhere.
        ranked = work.keep(ranked.withColumn("least", F.min("n").over(W.partitionBy("window"))).where("least > 0").drop("least"), "ranked")

        first = hint_small(work.keep(ranked.where("rank = 1").select("window", "pairs", "offset", "term", "next"), "rarest"), 160)
        starts = postings.join(first, ["term", "next"]).select("row", (F.col("pos") - F.col("offset")).alias("start"), "window", "pairs").where("start >= 0")
        starts = work.keep(starts, "starts")
        near = hint_small(work.keep(starts.select("row").distinct(), "rows"), 16)
        lists = work.keep(postings.join(near, "row", "left_semi").join(wanted, ["term", "next"], "left_semi").select("row", "pos", "term", "next"), "lists")

        def at(candidates: DataFrame, ranks: str) -> DataFrame:
            look = candidates.join(hint_small(ranked.where(ranks), 160).select("window", "offset", "term", "next"), "window")
            look = look.withColumn("pos", F.col("start") + F.col("offset")).drop("offset")
            return look.join(lists, ["row", "pos", "term", "next"]).select("row", "start", "window", "pairs")

        second = at(starts.where("pairs > 1"), "rank = 2")
        rest = at(second.where("pairs > 2"), "rank > 2").groupBy("row", "start", "window", "pairs").agg(F.count("*").alias("met")).where("met = pairs - 2").drop("met")
        found = starts.where("pairs = 1").unionByName(second.where("pairs = 2")).unionByName(rest)
        return single.unionByName(found.select("row", "start", "window", (F.col("pairs") + 1).alias("length")))

    def proximity(self, windows: DataFrame, span: int) -> DataFrame:
        """(row, window, least): the least number of words in a row that hold all distinct terms of windows(window, terms), in any order, where that is at most ``span``.

        Every such run holds an occurrence of the window's rarest term, and one
        of the next rarest within ``span`` words of it. Only the anchors that
        have both look for the others; what an anchor meets lies in less than
        twice ``span`` places of one document. A window of one distinct term is
        near wherever that occurs (least is 1).
        """
        work, postings = self.work, self.postings.where(F.col("term") != END).select("row", "term", "pos")
        terms = windows.select("window", F.array_distinct("terms").alias("t")).select("window", F.size("t").alias("n"), F.explode("t").alias("term"))
        wanted = hint_small(work.keep(terms.select("term").distinct(), "near-terms"), 80)
        counts = postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("count"))
        rarity = W.partitionBy("window").orderBy("count", "term")
        ranked = terms.join(counts, "term", "left").withColumns({"count": F.coalesce("count", F.lit(0)), "rank": F.row_number().over(rarity)})
        # A window with a term that no document has is near nowhere.
        ranked = work.keep(ranked.withColumn("least", F.min("count").over(W.partitionBy("window"))).where("least > 0").drop("least", "count"), "near-ranked")

        def places(ranks: str, of: DataFrame, name: str) -> DataFrame:
            return of.join(hint_small(ranked.where(ranks), 100).select("term", "window", "rank", "n"), "term").select("row", "window", "n", "rank", F.col("pos").alias(name))

        block = lambda c: F.floor(F.col(c) / span)
        near = F.abs(F.col("at") - F.col("anchor")) < span
        around = F.explode(F.array(block("anchor") - 1, block("anchor"), block("anchor") + 1))
        first = places("rank = 1", postings, "anchor")
        single = first.where("n = 1").select("row", "window", F.lit(1).alias("least"))
        second = places("rank = 2", postings, "at").withColumn("block", block("at")).select("row", "window", "block", "at")
        met = first.where("n > 1").withColumn("block", around).join(second, ["row", "window", "block"]).where(near)
        pairs = work.keep(met.select("row", "window", "n", "anchor", "at"), "near-pairs")
        anchors = work.keep(pairs.select("row", "window", "n", "anchor").distinct(), "near-anchors")
        rows = hint_small(work.keep(anchors.select("row").distinct(), "near-rows"), 16)
        rest = places("rank > 2", postings.join(rows, "row", "left_semi"), "at").withColumn("block", block("at")).select("row", "window", "block", "rank", "at")
        others = anchors.where("n > 2").withColumn("block", around).join(rest, ["row", "window", "block"]).where(near).select("row", "window", "n", "anchor", "rank", "at")
        seen = others.unionByName(pairs.withColumn("rank", F.lit(2))).unionByName(anchors.withColumns({"rank": F.lit(1), "at": F.col("anchor")}))

        # For the run that ends at each place: the last place of every term up to there. The anchor is in the run.
        here = W.partitionBy("row", "window", "anchor").orderBy("at")
        lasts = F.array_agg(F.struct("rank", "at")).over(here.rowsBetween(W.unboundedPreceding, W.currentRow))
        newest = F.array_min(F.map_values(F.map_from_entries(F.transform(F.array_distinct(F.transform(lasts, lambda x: x["rank"])), lambda r: F.struct(r, F.array_max(F.transform(F.filter(lasts, lambda x: x["rank"] == r), lambda x: x["at"])))))))
        full = F.size(F.array_distinct(F.transform(lasts, lambda x: x["rank"]))) == F.col("n")
        ends = seen.select("row", "window", "n", "at", F.when(full, F.col("at") - newest + 1).alias("length"))
        found = ends.where(F.col("length") <= span).groupBy("row", "window").agg(F.min("length").alias("least"))
        return found.unionByName(single.distinct())


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, row: str | None = None, near: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of docs.

    row: a column of docs that differs in all rows; the result has it as well.
    near: also ``n_near``, how many items have a window of which all distinct
    terms lie within so many words of the document, in any order.

    A window is ``size`` consecutive words of an item(item_id, text), or all
    words of a shorter item; a document word inside any occurrence of a window
    is hit. items_sha256 is of the item_ids whose windows occur, sorted as
    strings and joined by commas. Null and empty texts have no words and no
    hits; items without words, or a table without items, hit nothing. Null and
    repeated doc_ids each keep their own row.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    docs, items = docs.select(*([F.col(row).alias("row")] if row else []), "doc_id", "text"), items.select("item_id", "text")
    distinct, every = item_windows(items, size)
    windows = work.keep(distinct, "windows")
    owners = work.keep(every.distinct().join(windows, "terms").select("window", "item_id").distinct(), "owners")
    vocabulary = windows.select(F.explode("terms").alias("term")).unionByName(docs.sparkSession.sql(f"select '{END}' as term")).distinct()
    index = PositionalIndex(docs, work.keep(vocabulary, "vocabulary"), work)
    hits = work.keep(index.phrases(windows), "hits")

    words = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    seen = hits.select("row", "window").distinct().join(hint_small(owners, 32), "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    found = seen.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    result = index.documents().join(words, "row", "left").join(found, "row", "left")
    if near is not None:
        close = index.proximity(windows, near).select("row", "window").join(hint_small(owners, 32), "window").select("row", "item_id").distinct()
        result = result.join(close.groupBy("row").agg(F.count("*").alias("n_near")), "row", "left")
    return (
        result
        .select(
            *([F.col("row").alias(row)] if row else []),
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            *([F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if near is not None else []),
        )
    )
