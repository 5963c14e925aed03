"""Vector, text and kernel-backed queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import sets
from ..sources import html_table
from . import bootstrap, fits, market_scores
from .registry import query, r6, rounded, table

_BASE = "select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings"


def _vectors(spark, folder):
    """Every vector, as doubles."""
    return table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query(f"""
with e as ({_BASE}), z as (select a.vec_id, a.v, b.v as u from e a join e b on b.vec_id = a.vec_id + 1)
select vec_id, round(list_sum(list_transform(list_zip(v, u), lambda p: p[1] * p[2])), 6) as dot, round(list_sum(list_transform(list_zip(v, u), lambda p: abs(p[1] - p[2]))), 6) as l1 from z
""")
def vector_dot_l1(spark, folder):
    """Dot product and L1 distance of consecutive vectors."""
    e = _vectors(spark, folder)
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")
    return pairs.select("vec_id", r6(vectors.dot(F.col("v"), F.col("u"))).alias("dot"), r6(vectors.l1(F.col("v"), F.col("u"))).alias("l1"))


@query(f"""
with e as ({_BASE}), a as (select vec_id, list_transform(v, lambda x: abs(x) + 0.01) as v from e),
     n as (select vec_id, list_transform(v, lambda x: x / list_sum(v)) as p from a), c as (select vec_id, list_transform(p, lambda x: least(greatest(x, 1e-6), 1 - 1e-6)) as c, p from n)
select vec_id, round(-ln(c[1 + vec_id % 6] / list_sum(c)), 6) as log_loss,
       round(list_sum(list_transform(p, lambda x, i: (x - (case when i = 1 + vec_id % 6 then 1.0 else 0.0 end)) ** 2)), 6) as brier,
       cast(list_position(p, list_max(p)) as int) as top from c
""")
def normalize_log_brier(spark, folder):
    """Proper scores of vectors made into probabilities."""
    p = _vectors(spark, folder).select("vec_id", vectors.normalised(F.transform("v", lambda x: F.abs(x) + 0.01)).alias("p"), (F.col("vec_id") % 6 + 1).cast("int").alias("y"))
    return p.select("vec_id", r6(vectors.log_loss(F.col("p"), F.col("y"))).alias("log_loss"), r6(vectors.brier(F.col("p"), F.col("y"))).alias("brier"), vectors.first_argmax(F.col("p")).alias("top"))


@query(f"""
with e as ({_BASE}), s as (select vec_id, list_transform(v, lambda x, i: 0.7 * x + 0.1 * i) as s from e), x as (select vec_id, list_transform(s, lambda y: exp(y - list_max(s))) as x from s)
select vec_id, round(x[1] / list_sum(x), 6) as p1, round(list_max(x) / list_sum(x), 6) as p_max from x
""")
def softmax_predict(spark, folder):
    """Softmax with fixed coefficients."""
    s = _vectors(spark, folder).select("vec_id", vectors.softmax(F.transform("v", lambda x, i: 0.7 * x + 0.1 * (i + 1))).alias("p"))
    return s.select("vec_id", r6(F.element_at("p", 1)).alias("p1"), r6(F.array_max("p")).alias("p_max"))


@query(f"""
with e as ({_BASE}), a as (select vec_id, list_transform(v, lambda x: greatest(x, 0.0)) as v from e), n as (select vec_id, list_transform(v, lambda x: x / list_sum(v)) as p, cast(vec_id % 64 + 1 as int) as y from a),
     c as (select *, list_transform(p, lambda x: least(greatest(x, 1e-6), 1 - 1e-6)) as c from n), s as (select *, list_transform(c, lambda x: x / list_sum(c)) as s from c)
select vec_id % 10 as city, count(*) as events, round(avg(-ln(s[y])), 6) as log_loss, round(avg(list_sum(list_transform(s, lambda x, i: (x - (case when i = y then 1.0 else 0.0 end)) ** 2))), 6) as brier,
       round(avg(case when list_position(p, list_max(p)) = y then 1.0 else 0.0 end), 6) as top1, round(avg(p[y]), 6) as winner_prob, round(median(p[y]), 6) as median_winner_prob, count(*) filter (p[y] = 0) as zero_winners
from s group by 1
""")
def market_summary(spark, folder):
    """Scores of vectors as markets' probabilities (negative components are 0), by groups of ten."""
    p = _vectors(spark, folder).select("vec_id", vectors.normalised(F.transform("v", lambda x: F.greatest(x, F.lit(0.0)))).alias("p"), (F.col("vec_id") % 64 + 1).cast("int").alias("y"), (F.col("vec_id") % 10).alias("city"))
    names = ["log_loss", "brier", "top1", "winner_prob", "median_winner_prob"]
    return rounded(market_scores.summary(market_scores.event_scores(p, "p", "y"), ["city"]), *names)


@query("""
select sha256(text) as text_sha, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1
""")
def dup_values(spark, folder):
    """Texts that occur more than once."""
    docs = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("text_sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""
select lang, min(doc_id) as doc_id, text_sha from (select doc_id, lang, sha256(text) as text_sha from documents) group by lang, text_sha
""")
def dedupe_keep_first(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "lang", "text").select("doc_id", "lang", F.sha2("text", 256).alias("text_sha"))
    return sets.keep_first(docs, ["lang", "text_sha"], ["doc_id"]).select("lang", "doc_id", "text_sha")


@query()
def html_table_extract(spark, folder):
    """Cells of all tables and lists in the pages; HTML is beyond SQL."""
    return html_table.cells(table(spark, folder, "pages", "page_id", "html"), "page_id", "html")


@query()
def block_bootstrap_ci(spark, folder):
    """Moving-block bootstrap interval of the mean daily revenue."""
    days = table(spark, folder, "orders", "o_orderdate", "o_totalprice").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("num"), F.count("*").cast("double").alias("den"))
    found = bootstrap.ratio_interval(days, "day", "num", "den", block=7, reps=500, seed=20260930)
    return rounded(found, "estimate", "low", "high")


#: Which features the models of the rolling fits use, and the penalties that are tried.
MODELS, PENALTIES = {"M0": ("by_value",), "M1": ("by_mean",), "M2": ("by_value", "by_mean")}, [1e-3, 1e-2, 0.1, 1.0, 10.0]


@query()
def rolling_origin_fit(spark, folder):
    """Softmax fits of three models and five penalties on expanding windows of days, each scored on the next day."""
    rows, types = fits.hourly_outcomes(table(spark, folder, "events", "event_id", "ts", "event_type", "value"))
    return rounded(fits.rolling_origin(rows, MODELS, PENALTIES, least_days=26, buckets=types), "log_loss", "brier", "top1")


@query()
def frozen_refit(spark, folder):
    """The same models fitted once on the days before 2024-01-25, each with its frozen penalty, and scored on the days from then."""
    rows, types = fits.hourly_outcomes(table(spark, folder, "events", "event_id", "ts", "event_type", "value"))
    found = fits.frozen_evaluation(rows, MODELS, {"M0": 0.01, "M1": 1.0, "M2": 0.001}, dt.date(2024, 1, 25), types)
    return rounded(found, "log_loss", "brier", "top1")
