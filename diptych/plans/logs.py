"""Keyed logs: conversations stand for append-only logs, events for state changes of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.operators import logs

from .catalog import Tables, query


@query("""
SELECT conv_id, role, turn, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r=1""")
def last_record_wins(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "role", "turn", F.length("text").cast("long").alias("n_chars"))
    return logs.last_of_each(rows, ["conv_id", "role"], ["turn"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(t: Tables) -> DataFrame:
    return logs.left_to_do(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("""
SELECT conv_id, turn, role FROM conversations c WHERE role='user' AND NOT EXISTS
 (SELECT 1 FROM conversations d WHERE d.conv_id=c.conv_id AND d.turn=c.turn+1 AND d.role='assistant')""")
def resume_composite_anti(t: Tables) -> DataFrame:
    """Questions without an answer: an anti-join on three columns."""
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", "role")
    answered = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("user").alias("role"))
    return logs.left_to_do(asked, answered, ["conv_id", "turn", "role"])


@query("""
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')
  AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')""")
def semi_join_keys(t: Tables) -> DataFrame:
    """Sites that have a job of either season."""
    sites = t.customer.select("c_custkey", "c_mktsegment")
    for status in ("F", "P"):
        sites = sites.join(t.orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return sites


@query("""
SELECT c_custkey AS site, 'never' AS pool FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT site, 'both' FROM (SELECT o_custkey AS site FROM orders WHERE o_orderpriority='1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority='5-LOW')
UNION ALL SELECT site, 'urgent only' FROM (SELECT o_custkey AS site FROM orders WHERE o_orderpriority='1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority='5-LOW')""")
def set_ops_sites(t: Tables) -> DataFrame:
    urgent, low = (t.orders.where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("site")) for p in ("1-URGENT", "5-LOW"))
    never = t.customer.select(F.col("c_custkey").alias("site")).subtract(t.orders.select("o_custkey"))
    pools = [never.withColumn("pool", F.lit("never")), urgent.intersect(low).withColumn("pool", F.lit("both")), urgent.subtract(low).withColumn("pool", F.lit("urgent only"))]
    return pools[0].unionByName(pools[1]).unionByName(pools[2])


@query("""
SELECT d.doc_id, CASE WHEN l.quality=1 THEN 'good' WHEN l.quality=0 THEN 'poor' WHEN d.n_chars < 200 THEN 'short' ELSE '' END AS label,
 CASE WHEN l.quality IS NOT NULL THEN 'human' WHEN d.n_chars < 200 THEN 'rule' ELSE 'none' END AS label_source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_default_label(t: Tables) -> DataFrame:
    """A human label before a rule's, and an empty one for the rest."""
    joined = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    human = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    rule = F.when(F.col("n_chars") < 200, "short")
    source = F.when(F.col("quality").isNotNull(), "human").when(rule.isNotNull(), "rule").otherwise("none")
    return joined.select("doc_id", F.coalesce(human, rule, F.lit("")).alias("label"), source.alias("label_source"))


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS block, l_orderkey AS site FROM lineitem), o AS (SELECT block, min(site) AS owned_by FROM c GROUP BY 1)
SELECT block, site, owned_by, site = owned_by AS is_owner FROM c JOIN o USING (block)""")
def first_claim_owner(t: Tables) -> DataFrame:
    claims = t.lineitem.select(F.col("l_partkey").alias("block"), F.col("l_orderkey").alias("site")).distinct()
    return logs.first_claims(claims, "block", "site", [])


@query("""
WITH old AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_acctbal<0 THEN 'failed' ELSE 'done' END AS status FROM supplier), new AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(old.k,new.k) AS k, coalesce(new.name, old.name) AS name, coalesce(status,'pending') AS status, old.k IS NULL AS added FROM old FULL JOIN new ON old.k=new.k""")
def upsert_seed(t: Tables) -> DataFrame:
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "failed").otherwise("done").alias("status"))
    new = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return logs.seeded(old, new, "k", ["name"], "status", "pending")


@query("""
WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (event_type='signup') AS attempts, count(*) AS n_events FROM events GROUP BY 1)
SELECT * FROM s WHERE state <> 'error'""")
def fold_events(t: Tables) -> DataFrame:
    return logs.folded(t.events, "user_id", "event_type", ["ts", "event_id"], start="signup", drop="error")


@query("""
SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderkey) AS number FROM orders WHERE o_orderstatus='F'""")
def dense_numbering(t: Tables) -> DataFrame:
    kept = t.orders.where("o_orderstatus = 'F'").select("o_orderkey").withColumn("part", F.floor(F.col("o_orderkey") / 100_000))
    return logs.numbered(kept, ["o_orderkey"], 1000, by="part").select("o_orderkey", F.col("number").cast("long"))


@query("""
WITH r AS (SELECT event_id, CAST(value AS DECIMAL(18,2)) AS cost, sum(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY event_id) AS spent FROM events WHERE event_type='purchase')
SELECT event_id, CAST(spent AS DOUBLE) AS spent FROM r WHERE spent - cost < 5000""")
def running_cost_cap(t: Tables) -> DataFrame:
    bought = t.events.where("event_type = 'purchase'").select("event_id", "value").withColumn("part", F.floor(F.col("event_id") / 100_000))
    return logs.within_budget(bought, F.col("value").cast("decimal(18,2)"), ["event_id"], 5000, "part").select("event_id", F.col("spent").cast("double"))


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (event_type='error') AS n_errors,
 CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) // 3600 AS hours FROM events GROUP BY 1 HAVING count(*) FILTER (event_type='error') >= 3""")
def retry_budget_spent(t: Tables) -> DataFrame:
    """Sites that used up three tries, and over how long."""
    hours = F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 3600).cast("long")
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), hours.alias("hours")).where("n_errors >= 3")


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS block, l_orderkey AS site FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority='1-URGENT')), o AS (SELECT block, min(site) AS owned_by FROM c GROUP BY 1)
SELECT block, site, owned_by, site = owned_by AS is_owner FROM c JOIN o USING (block)""")
def release_claims(t: Tables) -> DataFrame:
    """Claims after those of some sites are deleted: what these owned goes to the next."""
    claims = t.lineitem.select(F.col("l_partkey").alias("block"), F.col("l_orderkey").alias("site")).distinct()
    released = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("site"))
    return logs.first_claims(logs.left_to_do(claims, released, ["site"]), "block", "site", [])


@query("""
WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS was FROM events GROUP BY 1)
SELECT user_id, CASE was WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'queued' ELSE was END AS state, was IN ('signup','click') AS requeued FROM s""")
def requeue_interrupted(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return logs.requeued(last, "state", {"signup": "pending", "click": "queued"})


@query("""
WITH c AS (SELECT l_orderkey AS k, CASE WHEN bool_or(l_returnflag='R') THEN 'R' END AS s, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, coalesce(s, o_orderstatus) AS o_orderstatus, CAST(q AS DOUBLE) AS quantity FROM orders LEFT JOIN c ON k=o_orderkey""")
def batch_stage_update(t: Tables) -> DataFrame:
    """Stages of some batches are changed, and a column is added to all."""
    changes = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(F.bool_or(F.col("l_returnflag") == "R"), "R").alias("o_orderstatus"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity")
    )
    return logs.updated(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), changes, "o_orderkey")


@query("""
WITH c AS (SELECT l_orderkey AS k, max(CAST(l_shipdate AS DATE)) AS made, arg_max(l_returnflag, (CAST(l_shipdate AS DATE), l_returnflag)) AS v FROM lineitem WHERE l_linenumber <> 2 AND l_quantity < 40 GROUP BY 1)
SELECT * FROM (SELECT o_orderkey, CASE WHEN made IS NULL THEN 'missing' WHEN v <> 'N' THEN 'version' WHEN CAST(o_orderdate AS DATE) + INTERVAL 60 DAY > made THEN 'older' END AS why FROM orders LEFT JOIN c ON k = o_orderkey) WHERE why IS NOT NULL""")
def stale_renders(t: Tables) -> DataFrame:
    """Orders whose render is missing, of another version, or older than the order (sixty days after its date)."""
    work = t.orders.select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 60).alias("changed"))
    made = t.lineitem.where("l_linenumber <> 2 AND l_quantity < 40").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("made"), F.col("l_returnflag").alias("version"))
    # Of renders of one day the greatest version counts.
    made = made.groupBy("o_orderkey", "made").agg(F.max("version").alias("version"))
    return logs.stale(work, made, "o_orderkey", "changed", "made", "version", "N").select("o_orderkey", "why")


@query("""
WITH b AS (SELECT user_id, min(ts) AS began FROM events WHERE event_type = 'signup' GROUP BY 1),
r AS (SELECT e.* FROM events e JOIN b ON b.user_id = e.user_id AND ts >= began), e AS (SELECT user_id, max(ts) AS ended FROM r WHERE event_type = 'error' GROUP BY 1),
d AS (SELECT r.user_id, count(*) AS n FROM r LEFT JOIN e ON e.user_id = r.user_id WHERE event_type = 'purchase' AND (ended IS NULL OR ts <= ended) GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY began, b.user_id) AS BIGINT) AS run_id, b.user_id, began, ended, coalesce(n, 0) AS processed FROM b LEFT JOIN e ON e.user_id = b.user_id LEFT JOIN d ON d.user_id = b.user_id""")
def run_table(t: Tables) -> DataFrame:
    """Runs, numbered as they began, with when they ended and what they processed; a user stands for a run."""
    log = t.events.select("user_id", "event_type", "ts")
    return logs.run_table(log, "user_id", "event_type", "ts", "signup", "error", "purchase", by="to_date(began)").withColumn("run_id", F.col("run_id").cast("long"))
