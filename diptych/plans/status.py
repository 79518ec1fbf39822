"""Status reports over job tables: orders stand for jobs, customers for sites, nations for states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.operators import counts

from .catalog import Tables, query

STATUSES = ("O", "P", "F", "X")


@query("""
SELECT s.place, s.o_orderstatus, CAST(count(o.o_orderkey) AS BIGINT) AS n
FROM (VALUES (0,'O'),(1,'P'),(2,'F'),(3,'X')) s(place, o_orderstatus) LEFT JOIN orders o USING (o_orderstatus) GROUP BY 1, 2""")
def status_counts_zero_filled(t: Tables) -> DataFrame:
    return counts.counts_of_all(t.orders, "o_orderstatus", STATUSES)


@query("""
SELECT coalesce(n_name,'?') AS n_name, count(*) AS n, count(*) FILTER (o_orderstatus='F') AS n_done,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1""")
def summary_by_state(t: Tables) -> DataFrame:
    sites = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    jobs = t.orders.join(sites, F.col("o_custkey") == F.col("c_custkey"))
    return counts.summary(jobs, ["n_name"], F.col("o_orderstatus") == "F", "o_totalprice")


@query("""
SELECT event_type, count(*) AS n_all, count(*) FILTER (ts > m.now - INTERVAL 30 MINUTE) AS n_recent,
  count(*) FILTER (ts > m.now - INTERVAL 1 DAY) AS n_day FROM events, (SELECT max(ts) AS now FROM events) m GROUP BY 1""")
def recent_window_count(t: Tables) -> DataFrame:
    """Events of each type in windows that end now, the last event's time."""
    events = t.events.select("event_type", "ts")
    now = events.agg(F.max("ts").alias("now"))
    return events.join(F.broadcast(now)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 30 MINUTES")).alias("n_recent"),
        F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 1 DAY")).alias("n_day"),
    )


@query("""
SELECT substr(props, 1, 90) AS reason, count(*) AS n FROM events WHERE event_type='error' GROUP BY 1 ORDER BY n DESC, reason LIMIT 10""")
def error_breakdown_top10(t: Tables) -> DataFrame:
    return counts.most_common(t.events.where("event_type = 'error'"), F.substring("props", 1, 90), 10, "reason")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O','P') AND o_orderpriority='1-URGENT'
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='MACHINERY') ORDER BY o_orderkey LIMIT 100""")
def dynamic_queue(t: Tables) -> DataFrame:
    """The next hundred jobs in the order in which they came; keys are applied before the limit."""
    from diptych.operators.logs import queue

    keys = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return queue(t.orders, "o_orderstatus", ["O", "P"], "o_orderkey", keys=keys, key="o_custkey", conditions=[F.col("o_orderpriority") == "1-URGENT"], most=100).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""
SELECT event_id, user_id, coalesce(nullif(event_type,'error'), props) AS reason FROM events WHERE event_type IN ('error','signup') ORDER BY ts DESC, event_id LIMIT 50""")
def failures_latest(t: Tables) -> DataFrame:
    failed = t.events.where(F.col("event_type").isin("error", "signup")).orderBy(F.desc("ts"), "event_id").limit(50)
    return failed.select("event_id", "user_id", F.coalesce(F.nullif("event_type", F.lit("error")), "props").alias("reason"))


@query("""
WITH p AS (SELECT l_orderkey, count(*) AS n_patches FROM lineitem GROUP BY 1), j AS (SELECT o_orderstatus, n_patches FROM orders LEFT JOIN p ON o_orderkey=l_orderkey),
a AS (SELECT count(*) FILTER (o_orderstatus='F') AS n_done, count(*) FILTER (o_orderstatus='P') AS n_waiting, count(*) FILTER (o_orderstatus='O') AS n_left,
  coalesce(sum(n_patches) FILTER (o_orderstatus='F'),0) AS done_patches, count(*) FILTER (o_orderstatus='F' AND n_patches IS NOT NULL) AS n_hit FROM j)
SELECT n_done, n_waiting, n_left, CAST(done_patches AS BIGINT) AS done_patches, round(CASE WHEN n_done=0 THEN 0 ELSE n_hit/n_done END, 6) AS hit_rate,
  round(CASE WHEN n_done=0 THEN 0 ELSE done_patches/n_done END, 6) AS per_site, round(done_patches + (n_waiting+n_left)*CASE WHEN n_done=0 THEN 0 ELSE done_patches/n_done END, 4) AS projected FROM a""")
def yield_projection(t: Tables) -> DataFrame:
    """How many patches the jobs that are left will give, at the rate of those done."""
    patches = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_patches"))
    jobs = t.orders.select("o_orderkey", "o_orderstatus").join(patches, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    done = F.col("o_orderstatus") == "F"
    a = jobs.agg(
        F.count_if(done).alias("n_done"), F.count_if(F.col("o_orderstatus") == "P").alias("n_waiting"), F.count_if(F.col("o_orderstatus") == "O").alias("n_left"),
        F.coalesce(F.sum(F.when(done, F.col("n_patches"))), F.lit(0)).alias("done_patches"), F.count_if(done & F.col("n_patches").isNotNull()).alias("n_hit"),
    )
    rate, hits = counts.share(F.col("done_patches"), F.col("n_done")), counts.share(F.col("n_hit"), F.col("n_done"))
    return a.select("n_done", "n_waiting", "n_left", "done_patches", F.round(hits, 6).alias("hit_rate"), F.round(rate, 6).alias("per_site"), F.round(F.col("done_patches") + (F.col("n_waiting") + F.col("n_left")) * rate, 4).alias("projected"))


@query("""
SELECT coalesce(n_name,'?') AS state, count(DISTINCT c_custkey) AS n_sites, count(DISTINCT c_mktsegment) AS n_segments FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1""")
def distinct_sites_states(t: Tables) -> DataFrame:
    sites = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return sites.groupBy(F.coalesce("n_name", F.lit("?")).alias("state")).agg(F.count_distinct("c_custkey").alias("n_sites"), F.count_distinct("c_mktsegment").alias("n_segments"))


@query("""
SELECT r_name, count(*) FILTER (o_orderstatus='O') AS "O", count(*) FILTER (o_orderstatus='P') AS "P", count(*) FILTER (o_orderstatus='F') AS "F"
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1""")
def region_status_pivot(t: Tables) -> DataFrame:
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    sites = t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    jobs = t.orders.select("o_custkey", "o_orderstatus").join(sites, F.col("o_custkey") == F.col("c_custkey"))
    return counts.outcome_matrix(jobs, "r_name", "o_orderstatus", ["O", "P", "F"])


@query("""
WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus='F' THEN 'train' WHEN o_orderstatus='P' THEN 'val' ELSE 'test' END AS split FROM orders)
SELECT o_custkey, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leak_check(t: Tables) -> DataFrame:
    """Sites whose jobs are in several splits when jobs, not sites, are split: what a split by site must not have."""
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "P", "val").otherwise("test")
    return counts.leaks(t.orders.select("o_custkey", split.alias("split")), "o_custkey", "split")


@query("""
SELECT r_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance,
  CAST(grouping(r_name) AS INTEGER) AS is_total FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ROLLUP (r_name)""")
def totals_with_grand_total(t: Tables) -> DataFrame:
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    sites = t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return sites.rollup("r_name").agg(F.count(F.lit(1)).alias("n"), F.sum(counts.money("c_acctbal")).cast("double").alias("balance"), F.grouping("r_name").cast("int").alias("is_total"))
