"""Screening of patches: line items stand for patches, events for what a model answers about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diptych.operators import screening

from .catalog import Tables, query


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount > 0.095 THEN 'nodata' WHEN l_tax > 0.075 THEN 'cloud_shadow' WHEN l_quantity > 49 THEN 'snow' WHEN l_discount + l_tax > 0.15 THEN 'water' WHEN l_extendedprice > 90000 THEN 'whiteout' END AS reason,
 CASE WHEN l_discount > 0.095 OR l_tax > 0.075 OR l_quantity > 49 OR l_discount + l_tax > 0.15 OR l_extendedprice > 90000 THEN 'rejected' ELSE 'accepted' END AS status FROM lineitem""")
def screen_first_failing_rule(t: Tables) -> DataFrame:
    c = F.col
    limits = [("nodata", c("l_discount"), 0.095), ("cloud_shadow", c("l_tax"), 0.075), ("snow", c("l_quantity"), 49.0), ("water", c("l_discount") + c("l_tax"), 0.15), ("whiteout", c("l_extendedprice"), 90_000.0)]
    reason = screening.first_failing(limits)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", reason.alias("reason")).withColumn("status", F.when(c("reason").isNull(), "accepted").otherwise("rejected"))


@query("""
SELECT l_linestatus AS stage, split_part(reason, ':', 1) AS reason, count(*) AS n FROM (SELECT l_linestatus, CASE WHEN l_discount > 0.08 THEN 'haze: ' || l_quantity WHEN l_tax > 0.06 THEN 'water: ' || l_tax ELSE 'ok' END AS reason FROM lineitem) GROUP BY 1, 2""")
def reason_stage_counts(t: Tables) -> DataFrame:
    reason = F.when(F.col("l_discount") > 0.08, F.concat(F.lit("haze: "), F.col("l_quantity").cast("string"))).when(F.col("l_tax") > 0.06, F.concat(F.lit("water: "), F.col("l_tax").cast("string"))).otherwise("ok")
    return t.lineitem.groupBy(F.col("l_linestatus").alias("stage"), F.split(reason, ":")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _answers(t: Tables) -> DataFrame:
    """What a model says of each event: a rating in JSON with words around it, or no JSON at all."""
    k = F.get_json_object("props", "$.k").cast("int")
    haze, cloud = F.pmod(k, F.lit(4)), F.pmod(F.floor(k / 4).cast("int"), F.lit(3))
    said = F.concat(F.lit("Sure: {\"haze\": "), haze.cast("string"), F.lit(", \"cloud\": "), cloud.cast("string"), F.lit("} as asked."))
    return t.events.select("event_id", F.when(k % 10 == 9, F.lit("no idea")).otherwise(said).alias("answer"))


_ANSWERS_SQL = """WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
a AS (SELECT event_id, CASE WHEN k % 10 = 9 THEN 'no idea' ELSE 'Sure: {"haze": ' || (k % 4) || ', "cloud": ' || ((k // 4) % 3) || '} as asked.' END AS answer FROM k),
j AS (SELECT event_id, answer, nullif(regexp_extract(answer, '\\{.*\\}'), '') AS body FROM a),
r AS (SELECT event_id, answer, body, CAST(json_extract(body, '$.haze') AS INTEGER) AS haze, CAST(json_extract(body, '$.cloud') AS INTEGER) AS cloud FROM j)
"""


@query(_ANSWERS_SQL + "SELECT event_id, body, haze, cloud FROM r")
def extract_json_from_text(t: Tables) -> DataFrame:
    body = screening.json_in(F.col("answer"))
    rows = _answers(t).select("event_id", body.alias("body"))
    return rows.select("event_id", "body", screening.whole_number(F.col("body"), "$.haze").alias("haze"), screening.whole_number(F.col("body"), "$.cloud").alias("cloud"))


@query(_ANSWERS_SQL + "SELECT event_id, CASE WHEN haze IS NULL OR cloud IS NULL THEN 'unparsed' WHEN haze >= 2 OR cloud >= 2 THEN 'reject' ELSE 'keep' END AS verdict FROM r")
def haze_verdict(t: Tables) -> DataFrame:
    return extract_json_from_text(t).select("event_id", screening.haze_verdict([F.col("haze")], [F.col("cloud")]).alias("verdict"))


@query("""
SELECT event_type, CASE WHEN e IN ('view','click') THEN e ELSE 'unparsed' END AS mark, count(*) AS n FROM (SELECT event_type, trim(regexp_replace(lower(trim('  ' || upper(event_type) || '. ')), '^\\.+|\\.+$', '', 'g')) AS e FROM events) GROUP BY 1, 2""")
def closed_answers(t: Tables) -> DataFrame:
    said = F.concat(F.lit("  "), F.upper("event_type"), F.lit(". "))
    return t.events.groupBy("event_type", screening.closed_answer(said, ["view", "click"]).alias("mark")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag='R' THEN 'land_use' WHEN l_returnflag='A' THEN 'seasonal' ELSE 'none' END AS a, 1-l_discount AS conf,
 CASE WHEN l_linestatus='F' THEN 'land_use' WHEN l_tax > 0.04 THEN 'seasonal' ELSE 'none' END AS b, l_tax AS changed FROM lineitem)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN a='land_use' AND conf>=0.9 AND b='land_use' AND changed>=0.02 THEN 'land_use' WHEN a='land_use' AND b='seasonal' THEN 'seasonal' WHEN a='land_use' THEN 'none' ELSE a END AS verdict FROM m) GROUP BY 1""")
def verdict_reconciliation(t: Tables) -> DataFrame:
    a = F.when(F.col("l_returnflag") == "R", "land_use").when(F.col("l_returnflag") == "A", "seasonal").otherwise("none")
    b = F.when(F.col("l_linestatus") == "F", "land_use").when(F.col("l_tax") > 0.04, "seasonal").otherwise("none")
    return t.lineitem.groupBy(screening.reconciled(a, 1 - F.col("l_discount"), b, F.col("l_tax")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def _hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("int")


@query("""
SELECT o_orderkey, o_custkey, s.patch AS first_patch, CAST(len(s.items) AS INTEGER) AS n_items, CAST(o_orderdate AS DATE) AS day FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS patch, list(l_partkey) AS items FROM lineitem GROUP BY 1) s ON s.l_orderkey=o_orderkey""")
def flatten_nested(t: Tables) -> DataFrame:
    """A nested record of each job, with its patches, flattened again; a missing level gives nulls."""
    items = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_partkey").alias("patch"), "l_discount"))).alias("items"))
    nested = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.struct("o_orderkey", F.struct("o_custkey", F.to_date("o_orderdate").alias("day")).alias("site"), "items").alias("record"))
    return nested.select("record.o_orderkey", "record.site.o_custkey", F.col("record.items")[0]["patch"].alias("first_patch"), F.size("record.items").alias("n_items"), "record.site.day")
