"""URL filter: host and path rules first, gradient-boosted trees on lexical features elsewhere."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, hint_small

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Folds of hosts, and the urls' weight that draws a suffix's odds to those of all urls.
FOLDS, PRIOR = 5, 10.0
FEATURES = ["length", "host_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "parameters", "has_fragment", "secure", "suffix_seen", "suffix_odds"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def _fits(rule: Rule) -> Column:
    _, host, path = rule
    return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)


def first_rule(rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(_fits(rule), F.lit(value(rule))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")

    def term(total: Column, c: Column) -> Column:
        share = F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
        return total - share * F.log2(share)

    return F.when(text == "", F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), term))


def lexical(urls: DataFrame) -> DataFrame:
    """urls with host, path, suffix (the host's last label) and the lexical features."""
    host, path = split_url(F.col("url"))
    rows = urls.withColumns({"host": host, "path": path})
    text = F.coalesce("url", F.lit(""))
    count = lambda pattern, of=text: F.regexp_count(of, F.lit(pattern)).cast("double")
    return rows.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "length": F.length(text).cast("double"),
            "host_length": F.length("host").cast("double"),
            "labels": count(r"[^.]+", F.col("host")),
            "depth": count(r"/[^/]", F.col("path")),
            "digit_ratio": count(r"[0-9]") / F.greatest(F.length(text), F.lit(1)),
            "hyphens": count("-", F.col("host")),
            "entropy": _entropy(F.col("host")),
            "parameters": count(r"[?&][^=&#]+="),
            "has_fragment": F.contains(text, F.lit("#")).cast("double"),
            "secure": F.startswith(text, F.lit("https:")).cast("double"),
        }
    )


def _odds(blocked: Column, n: Column, base: float) -> Column:
    """Log-odds of a block, drawn to those of all urls as if by PRIOR urls more."""
    return F.log((blocked + PRIOR * base) / (n - blocked + PRIOR * (1 - base)))


def suffix_statistics(labelled: DataFrame, base: float) -> DataFrame:
    """(suffix, fold, suffix_seen, suffix_odds) over all labelled rows: log count and smoothed log-odds of a block.

    Those of a fold leave out the hosts of that fold, so that no url's own label
    is in its features; fold -1 has all, for urls without a label.
    """
    each = labelled.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    every = each.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
    others = each.join(every, "suffix").select("suffix", "fold", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_blocked") - F.col("blocked")).alias("blocked"))
    whole = every.select("suffix", F.lit(-1).alias("fold"), F.col("all_n").alias("n"), F.col("all_blocked").alias("blocked"))
    return others.unionByName(whole).select("suffix", "fold", F.log1p("n").alias("suffix_seen"), _odds(F.col("blocked"), F.col("n"), base).alias("suffix_odds"))


@dataclass
class UrlModel:
    """Trees over lexical features and suffix statistics."""

    trees: GBTClassificationModel
    statistics: DataFrame
    base: float

    def score(self, rows: DataFrame, name: str = "block_score") -> DataFrame:
        """rows of lexical with a fold (-1: not trained on) and the probability of a block."""
        scored = self.trees.transform(_assembled(rows.join(self.statistics, ["suffix", "fold"], "left"), self.base))
        return scored.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "suffix_seen", "suffix_odds")


def _assembled(rows: DataFrame, base: float) -> DataFrame:
    """rows with the feature vector; a suffix that was not seen has the odds of all urls."""
    unseen = F.log(F.lit(base / (1 - base)))
    rows = rows.withColumns({"suffix_seen": F.coalesce("suffix_seen", F.lit(0.0)), "suffix_odds": F.coalesce("suffix_odds", unseen)})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def folded(labelled: DataFrame) -> DataFrame:
    """labelled with the fold of each host."""
    return labelled.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))


def train(labelled: DataFrame, work: Workspace, rows: int = 20_000, trees: int = 12, depth: int = 4) -> UrlModel | None:
    """A model from labelled(url, label, the columns of lexical and folded); None unless both labels occur.

    The statistics cover all rows; the trees learn from at most ``rows`` of them
    (least hash of the url). Each is learnt from twice, with its suffix's
    statistics from the other hosts and as if its suffix had not been seen, so
    that urls of new suffixes are judged by what they look like.
    """
    known = labelled.agg(F.avg("label")).first()[0]
    if known is None or known in (0.0, 1.0):
        return None
    statistics = hint_small(work.keep(suffix_statistics(labelled, known), f"suffixes-{uuid.uuid4().hex}"), 100)
    lexical_only = [c for c in FEATURES if not c.startswith("suffix_")]
    sample = work.keep(labelled.select("suffix", "fold", "label", *lexical_only, F.xxhash64("url", "host").alias("deal")).orderBy("deal").limit(rows), f"sample-{uuid.uuid4().hex}")
    unseen = sample.withColumns({"suffix_seen": F.lit(None).cast("double"), "suffix_odds": F.lit(None).cast("double")})
    both = sample.join(statistics, ["suffix", "fold"], "left").unionByName(unseen)
    if both.select("label").distinct().count() < 2:
        return None
    fitted = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, seed=7).fit(_assembled(both, known).select("features", "label"))
    return UrlModel(fitted, statistics, known)


def held_out_quality(labelled: DataFrame, work: Workspace, **options) -> DataFrame:
    """One row (rows, accuracy, commonest, log_loss): a model of all folds but the first, on the hosts of the first.

    commonest is the accuracy of always naming the commoner label.
    """
    rows = folded(labelled)
    model = train(rows.where("fold <> 0"), work, **options)
    if model is None:
        raise ValueError("urls of both labels are wanted")
    scored = model.score(rows.where("fold = 0").withColumn("fold", F.lit(-1)))
    p = F.least(F.greatest("block_score", F.lit(1e-6)), F.lit(1 - 1e-6))
    right = ((F.col("block_score") >= 0.5) == (F.col("label") == 1)).cast("double")
    return scored.agg(F.count("*").alias("rows"), F.avg(right).alias("accuracy"), F.greatest(F.avg("label"), 1 - F.avg("label")).alias("commonest"), F.avg(-F.log(F.when(F.col("label") == 1, p).otherwise(1 - p))).alias("log_loss"))


def judge(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for each row of pages(page_id, url).

    The longest rule that fits decides. Other urls are blocked if the trees'
    probability of a block is at least ``threshold``; they learn from the urls
    that rules label. Without urls of both labels they decide for the only
    label, or to allow. Null urls have empty hosts and paths, fit no rule and
    are scored like others. Repeated rows are judged each.
    """
    work = Workspace(pages.sparkSession, "urls")
    verdict, name = first_rule(rules, lambda r: r[0]), first_rule(rules, lambda r: r[1] + r[2])
    rows = lexical(pages.select("page_id", "url")).withColumns({"ruled": verdict, "rule": name})
    rows = work.keep(rows, "features")
    labelled = folded(rows.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double")))
    model = train(labelled, work, **options)
    if model is None:
        only = labelled.agg(F.coalesce(F.max("label"), F.lit(0.0))).first()[0]
        scored = rows.withColumn("block_score", F.lit(float(only)))
    else:
        scored = model.score(rows.withColumn("fold", F.lit(-1)))
    learnt = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), "block_score")
