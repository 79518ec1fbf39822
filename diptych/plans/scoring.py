"""Decisions against labels: documents' lengths stand for model answers, their quality labels for human ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.operators import scoring

from .catalog import Tables, query


def labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars", "lang", "source").join(t.labels, "doc_id")


_W = "round(CASE WHEN {n}=0 THEN 0 ELSE {k}/{n} END,6) AS {x}, round(CASE WHEN {n}>0 THEN greatest(({k}/{n}+3.8416/(2*{n}))/(1+3.8416/{n}) - 1.96*sqrt(({k}/{n})*(1-{k}/{n})/{n}+3.8416/(4*{n}*{n}))/(1+3.8416/{n}),0.0) END,6) AS {x}_low, round(CASE WHEN {n}>0 THEN least(({k}/{n}+3.8416/(2*{n}))/(1+3.8416/{n}) + 1.96*sqrt(({k}/{n})*(1-{k}/{n})/{n}+3.8416/(4*{n}*{n}))/(1+3.8416/{n}),1.0) END,6) AS {x}_high"


@query(f"""
WITH j AS (SELECT quality=0 AS y, n_chars<600 AS a, n_chars%3=0 AS b FROM documents JOIN labels USING (doc_id)),
r AS (SELECT 'first' AS rule, y, a AS f FROM j UNION ALL SELECT 'second', y, b FROM j UNION ALL SELECT 'both', y, a AND b FROM j UNION ALL SELECT 'either', y, a OR b FROM j),
c AS (SELECT rule, count(*) FILTER (f) AS flagged, count(*) FILTER (y AND f) AS found, count(*) FILTER (NOT y AND f) AS alarms, CAST(count(*) FILTER (y) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT y) AS DOUBLE) AS n, CAST(count(*) FILTER (f) AS DOUBLE) AS fl FROM r GROUP BY 1)
SELECT rule, flagged, found, alarms, {_W.format(k="found", n="p", x="recall")}, {_W.format(k="found", n="fl", x="precision")}, {_W.format(k="alarms", n="n", x="alarm_rate")} FROM c""")
def rule_scoring_wilson(t: Tables) -> DataFrame:
    a, b = F.col("n_chars") < 600, F.col("n_chars") % 3 == 0
    return scoring.rules(labelled(t), F.col("quality") == 0, {"first": a, "second": b, "both": a & b, "either": a | b})


@query("""
WITH j AS (SELECT quality=0 AS y, n_chars<600 AS p, lang='fr' AS skip, n_chars>=50 AS ok FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (NOT skip AND ok AND y AND p) AS tp, count(*) FILTER (NOT skip AND ok AND NOT y AND p) AS fp, count(*) FILTER (NOT skip AND ok AND NOT y AND NOT p) AS tn, count(*) FILTER (NOT skip AND ok AND y AND NOT p) AS fn, count(*) FILTER (skip) AS n_excluded, count(*) FILTER (NOT skip AND NOT ok) AS n_unparsed FROM j)
SELECT *, round(coalesce((tp+tn)/nullif(tp+fp+tn+fn,0),0),6) AS accuracy, round(coalesce(tp/nullif(tp+fp,0),0),6) AS "precision", round(coalesce(tp/nullif(tp+fn,0),0),6) AS recall, round(coalesce(fp/nullif(fp+tn,0),0),6) AS false_reject FROM c""")
def confusion_with_exclusions(t: Tables) -> DataFrame:
    return scoring.confusion(labelled(t), F.col("quality") == 0, F.col("n_chars") < 600, F.col("lang") == "fr", F.col("n_chars") >= 50)


_SCORED = "j AS (SELECT quality=0 AS y, 1000.0/(1000+n_chars) AS score FROM documents JOIN labels USING (doc_id)), g AS (SELECT score, count(*) FILTER (y) AS pos, count(*) AS n FROM j GROUP BY 1), s AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS flagged FROM g)"


@query(f"WITH {_SCORED} SELECT round(sum(pos*tp/flagged)/sum(pos),6) AS average_precision, CAST(sum(pos) AS BIGINT) AS positives FROM s")
def average_precision(t: Tables) -> DataFrame:
    return scoring.average_precision(labelled(t), F.col("quality") == 0, 1000.0 / (1000 + F.col("n_chars")))


@query(f"""WITH {_SCORED}, t AS (SELECT sum(pos) AS p, max(flagged) AS n FROM s), b AS (SELECT max(score) AS threshold FROM s, t WHERE pos>0 AND tp >= p - floor(round(p*0.1,9)))
SELECT threshold, round(tp/p,6) AS recall, round(flagged/n,6) AS kept_share FROM b JOIN s ON score=threshold, t""")
def recall_threshold(t: Tables) -> DataFrame:
    return scoring.recall_threshold(labelled(t), F.col("quality") == 0, 1000.0 / (1000 + F.col("n_chars")))


@query("""
SELECT source, count(*) AS comparable, count(*) FILTER ((quality=1)=(n_chars>300)) AS agreed, round(count(*) FILTER ((quality=1)=(n_chars>300))/greatest(count(*),1),6) AS agreement FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def agreement_by_group(t: Tables) -> DataFrame:
    same = (F.col("quality") == 1).eqNullSafe(F.col("n_chars") > 300)
    agreed = F.count_if(same)
    return labelled(t).groupBy("source").agg(F.count(F.lit(1)).alias("comparable"), agreed.alias("agreed"), F.round(agreed / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("agreement"))


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props,'$.k') AS BIGINT)) AS BIGINT) AS tokens_in, round(sum(CAST(json_extract(props,'$.k') AS BIGINT)*0.3 + event_id%50*2.5)/1e6, 9) AS cost FROM events GROUP BY 1""")
def token_cost(t: Tables) -> DataFrame:
    """What answers cost at a price for each million tokens read and written."""
    read, written = F.get_json_object("props", "$.k").cast("long"), F.pmod("event_id", F.lit(50))
    spent = F.sum(read) * F.lit(0.3) + F.sum(written) * F.lit(2.5)
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(read).alias("tokens_in"), F.round(spent / 1e6, 9).alias("cost"))


@query("""
SELECT lang, count(*) FILTER (toxic=1 AND n_chars<600) AS both, count(*) FILTER (toxic=1) AS toxic, count(*) FILTER (n_chars<600) AS short, count(DISTINCT source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def contingency_by_variant(t: Tables) -> DataFrame:
    toxic, short = F.col("toxic") == 1, F.col("n_chars") < 600
    return labelled(t).groupBy("lang").agg(F.count_if(toxic & short).alias("both"), F.count_if(toxic).alias("toxic"), F.count_if(short).alias("short"), F.count_distinct("source").alias("sources"))


@query("""
SELECT source, count(*) AS n, round(CAST(count(*) FILTER (quality=0 AND n_chars<600) AS DOUBLE)/nullif(count(*) FILTER (quality=0),0),6) AS missed_share, count(DISTINCT md5(text)) AS captions FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def prediction_collapse(t: Tables) -> DataFrame:
    """Each source as a run: poor documents stand for changed pairs, short ones for the answer that nothing differs."""
    rows = t.documents.join(t.labels, "doc_id")
    return scoring.collapse(rows, "source", F.col("quality") == 0, F.col("n_chars") < 600, F.col("text"))
