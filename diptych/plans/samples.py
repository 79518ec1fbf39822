"""Sampling and splitting: customers and documents stand for sites and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.operators import samples

from .catalog import Tables, query


@query("""
SELECT c_custkey, n_name, CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS turn FROM customer JOIN nation ON c_nationkey=n_nationkey""")
def interleave_by_state(t: Tables) -> DataFrame:
    sites = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_acctbal")
    return samples.interleaved(sites, "n_name", "c_acctbal", "c_custkey").drop("c_acctbal")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer), b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS q FROM a WHERE r<=2)
SELECT c_custkey, c_mktsegment, c_nationkey FROM b WHERE q<=24""")
def capped_per_subgroup(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    return samples.capped(rows, "c_mktsegment", "c_nationkey", [F.col("c_custkey")], 2, 24)


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7|'||doc_id), doc_id) AS turn FROM documents) SELECT doc_id, source FROM r ORDER BY turn, source, doc_id LIMIT 100""")
def round_robin_quota(t: Tables) -> DataFrame:
    """A quota of a hundred drawn in turns from every source; no source can need more than a hundred turns."""
    first = samples.ranked(t.documents.select("doc_id", "source"), ["source"], [samples.draw(7, "doc_id"), F.col("doc_id")], "turn").where("turn <= 100")
    return first.orderBy("turn", "source", "doc_id").limit(100).select("doc_id", "source")


@query("""
WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42|'||c_custkey), c_custkey)-1 AS i, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN i/n < 0.8 THEN 'train' WHEN i/n < 0.9 THEN 'val' ELSE 'test' END AS split FROM s""")
def site_split_80_10_10(t: Tables) -> DataFrame:
    return samples.split_by_group(t.customer, "c_custkey", 42, [("train", 0.8), ("val", 0.1), ("test", 0.1)])


@query("""
WITH s AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('42|'||c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
q AS (SELECT *, CASE WHEN n>=3 THEN greatest(1, CAST(round_even(n*0.1,0) AS INTEGER)) ELSE 0 END AS quota FROM s)
SELECT c_nationkey, c_custkey, CASE WHEN r<=quota THEN 'test' WHEN r<=2*quota THEN 'val' ELSE 'train' END AS split FROM q""")
def state_quota_split(t: Tables) -> DataFrame:
    return samples.quota_split(t.customer, "c_nationkey", "c_custkey", 42)


@query("""
WITH r AS (SELECT l_orderkey*100000000+l_partkey*10000+l_suppkey*10+l_linenumber AS id, l_returnflag='R' AND l_discount>0.05 AS changed FROM lineitem), d AS (SELECT id, bool_or(changed) AS changed FROM r GROUP BY 1),
n AS (SELECT count(*) FILTER (changed) AS y, count(*) FILTER (NOT changed) AS n FROM d), k AS (SELECT id, changed, row_number() OVER (PARTITION BY changed ORDER BY md5('1|'||id), id) AS q FROM d)
SELECT id, changed FROM k, n WHERE q <= CASE WHEN changed THEN least(y,n) ELSE least(n, least(y,n)) END""")
def balanced_selection(t: Tables) -> DataFrame:
    key = F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    rows = t.lineitem.select(key.alias("id"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)).alias("changed")).groupBy("id").agg(F.bool_or("changed").alias("changed"))
    return samples.balanced(rows, "changed", "id", 1)


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('3|'||o_orderkey), o_orderkey) AS r FROM orders) WHERE r=1""")
def random_one_per_site(t: Tables) -> DataFrame:
    return samples.first_of_each(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [samples.draw(3, "o_orderkey"), F.col("o_orderkey")])


@query("""
WITH b AS (SELECT o_custkey, max(o_totalprice) AS score FROM orders GROUP BY 1), p AS (SELECT o.o_custkey, min(o.o_orderkey) AS o_orderkey, b.score FROM orders o JOIN b ON b.o_custkey=o.o_custkey AND o.o_totalprice=b.score GROUP BY 1,3)
SELECT o_custkey, o_orderkey, score FROM p ORDER BY score DESC, o_custkey LIMIT 60""")
def hard_stratum(t: Tables) -> DataFrame:
    """The sixty sites whose best-scored patch scores highest, with that patch."""
    best = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("o_orderkey"), F.max("o_totalprice").alias("score"))
    return best.orderBy(F.desc("score"), "o_custkey").limit(60)


@query("""
WITH j AS (SELECT d.doc_id, l.quality, CASE WHEN d.n_chars > 300 THEN 1 ELSE 0 END AS guess FROM documents d JOIN labels l USING (doc_id)), a AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9|'||doc_id), doc_id) AS r FROM j WHERE quality=guess)
SELECT doc_id, 'differ' AS pool FROM j WHERE quality<>guess UNION ALL SELECT doc_id, 'agree' FROM a WHERE r<=50""")
def disagreement_sample(t: Tables) -> DataFrame:
    """All on which human and rule differ, and fifty on which they agree."""
    guess = F.when(F.col("n_chars") > 300, 1).otherwise(0)
    joined = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id").withColumn("same", F.col("quality") == guess)
    agree = joined.where("same").orderBy(samples.draw(9, "doc_id"), "doc_id").limit(50)
    return joined.where("not same").select("doc_id", F.lit("differ").alias("pool")).unionByName(agree.select("doc_id", F.lit("agree").alias("pool")))


@query("""
WITH r AS (SELECT n_regionkey AS region, c_custkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY md5('4|'||c_custkey), c_custkey) AS r FROM customer JOIN nation ON c_nationkey=n_nationkey),
n AS (SELECT region, count(*) AS n FROM r GROUP BY 1), q AS (SELECT region, CAST(round_even(200*n/sum(n) OVER (),0) AS INTEGER) AS quota FROM n) SELECT region, c_custkey FROM r JOIN q USING (region) WHERE r<=quota""")
def proportional_draw(t: Tables) -> DataFrame:
    """Two hundred sites, of each region by its share, rounded."""
    sites = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), "c_custkey")
    counts = sites.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    quota = counts.join(F.broadcast(total)).select("region", F.bround(200 * F.col("n") / F.col("total"), 0).cast("int").alias("quota"))
    placed = samples.placed(sites, ["region"], 4, "c_custkey")
    return placed.join(F.broadcast(quota), "region").where("place <= quota").select("region", "c_custkey")


@query("""
SELECT source, CAST(CAST('0x'||substr(md5('5|'||source),1,8) AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS n FROM documents GROUP BY 1,2""")
def group_kfold(t: Tables) -> DataFrame:
    folds = samples.group_folds(t.documents, "source", 5, 5)
    return t.documents.join(folds, "source").groupBy("source", "fold").agg(F.count(F.lit(1)).alias("n"))


def _remainder_round(k: int) -> str:
    """Round k of a thousand shared out: what is given before it is in g{k}, after it in g{k+1}."""
    open_ = "given < lim AND area > 0"
    return f"""s{k} AS (SELECT 1000 - sum(given) AS rest, sum(area) FILTER ({open_}) AS whole FROM g{k}),
h{k} AS (SELECT g{k}.*, {open_} AS is_open, rest, whole, CASE WHEN {open_} THEN rest*area/whole ELSE 0 END AS share FROM g{k}, s{k}),
r{k} AS (SELECT *, least(floor(share), lim - given) AS portion, max(least(floor(share), lim - given)) OVER () AS most, row_number() OVER (ORDER BY is_open DESC, share - floor(share) DESC, nation) AS place FROM h{k}),
g{k + 1} AS MATERIALIZED (SELECT nation, area, lim, CAST(given + CASE WHEN rest <= 0 OR whole IS NULL THEN 0 WHEN most > 0 THEN portion WHEN is_open AND place <= rest THEN 1 ELSE 0 END AS BIGINT) AS given FROM r{k})"""


@query(f"""
WITH g0 AS (SELECT c_nationkey AS nation, CAST(greatest(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS area, count(*) AS lim, CAST(least(10, count(*)) AS BIGINT) AS given FROM customer GROUP BY 1),
{", ".join(_remainder_round(k) for k in range(16))}
SELECT nation, given FROM g16""")
def largest_remainder(t: Tables) -> DataFrame:
    """A thousand samples shared out to nations by their customers' balance, ten at least and none over its customers."""
    area = F.greatest(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), F.lit(0)).cast("double")
    nations = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(area.alias("area"), F.count(F.lit(1)).alias("n"))
    return samples.apportioned(nations, "nation", "area", 1000, least=10, capacity="n")


@query("""
WITH a AS (SELECT c_nationkey, c_custkey, c_acctbal >= 0 AS old FROM customer), s0 AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('42|'||c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM a WHERE old),
q0 AS (SELECT *, CASE WHEN n>=3 THEN greatest(1, CAST(round_even(n*0.1,0) AS INTEGER)) ELSE 0 END AS quota FROM s0), e AS (SELECT c_custkey, CASE WHEN r<=quota THEN 'test' WHEN r<=2*quota THEN 'val' ELSE 'train' END AS split FROM q0),
n AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (split='test') AS t, count(*) FILTER (split='val') AS v FROM a LEFT JOIN e USING (c_custkey) GROUP BY 1),
w AS (SELECT *, CASE WHEN n>=3 THEN greatest(1, CAST(round_even(n*0.1,0) AS INTEGER)) ELSE 0 END AS quota FROM n), x AS (SELECT c_nationkey, greatest(0, quota-t) AS wt, greatest(0, quota-v) AS wv FROM w),
r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('43|'||c_custkey), c_custkey) AS r FROM a WHERE NOT old)
SELECT c_nationkey, c_custkey, CASE WHEN r<=wt THEN 'test' WHEN r<=wt+wv THEN 'val' ELSE 'train' END AS split FROM r JOIN x USING (c_nationkey) UNION ALL SELECT c_nationkey, c_custkey, split FROM a JOIN e USING (c_custkey)""")
def state_quota_resplit(t: Tables) -> DataFrame:
    """Sites that came later are split so that each state has its quota, and those of the first round stay where they are."""
    first = samples.quota_split(t.customer.where("c_acctbal >= 0"), "c_nationkey", "c_custkey", 42)
    return samples.quota_split(t.customer, "c_nationkey", "c_custkey", 43, earlier=first)


@query("""
WITH d AS (SELECT d.doc_id, quality=0 AS changed, lang IS NOT DISTINCT FROM (SELECT min(lang) FROM documents) AS early FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL), n AS (SELECT count(*) FILTER (changed) AS y, count(*) FILTER (NOT changed) AS n FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY changed ORDER BY CASE WHEN early THEN 0 ELSE 1 END, md5('6|'||doc_id), doc_id) AS q FROM d) SELECT doc_id, changed FROM k, n WHERE q <= least(y,n)""")
def balanced_reselection(t: Tables) -> DataFrame:
    """A balanced selection in which documents of the first language, selected before, come first."""
    rows = t.documents.join(t.labels, "doc_id").where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("changed"))
    lang = t.documents.agg(F.min("lang").alias("lang"))
    return samples.balanced(rows, "changed", "doc_id", 6, earlier=t.documents.join(F.broadcast(lang), "lang", "left_semi"))


@query("""
WITH free AS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT')
SELECT 'trial' AS "set", c_custkey FROM free ORDER BY md5('8|'||c_custkey), c_custkey LIMIT 60""")
def issue_set(t: Tables) -> DataFrame:
    """A trial of sixty sites that are in no set so far."""
    earlier = t.orders.where("o_orderpriority = '1-URGENT'").select(F.lit("urgent").alias("set"), F.col("o_custkey").alias("c_custkey"))
    return samples.issued(t.customer, "c_custkey", earlier, "trial", 60, 8)


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('17|'||o_orderkey), o_orderkey) AS r FROM orders),
p AS (SELECT o_orderkey, o_orderstatus FROM r WHERE r <= CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 40 WHEN 'P' THEN 20 ELSE 0 END),
c AS (SELECT o_orderkey, 'control' AS o_orderstatus FROM p WHERE o_orderstatus IN ('F','O') ORDER BY md5('18|'||o_orderkey), o_orderkey LIMIT 15)
SELECT *, false AS control FROM p UNION ALL SELECT *, true FROM c""")
def quotas_with_controls(t: Tables) -> DataFrame:
    return samples.quotas_with_controls(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", {"F": 30, "O": 40, "P": 20}, ["F", "O"], 15, 17)


@query("""
WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents WHERE n_chars > 300),
y AS (SELECT * FROM d WHERE labelled ORDER BY md5('30|'||doc_id), doc_id LIMIT 60), n AS (SELECT *, row_number() OVER (ORDER BY md5('30|'||doc_id), doc_id) AS r FROM d WHERE NOT labelled),
c AS (SELECT * FROM d ORDER BY md5('31|'||doc_id), doc_id LIMIT 10)
SELECT *, false AS control FROM y UNION ALL SELECT doc_id, labelled, false FROM n WHERE r <= 90 - (SELECT count(*) FROM y) UNION ALL SELECT *, true FROM c""")
def labelled_and_not(t: Tables) -> DataFrame:
    """A hundred documents that pass a gate: ten controls, and of the others two thirds labelled."""
    known = t.labels.select("doc_id").distinct().withColumn("labelled", F.lit(True))
    passed = t.documents.where("n_chars > 300").select("doc_id").join(known, "doc_id", "left")
    return samples.labelled_and_not(passed, "labelled", "doc_id", 100, 10, 30)


@query("""
SELECT o_orderkey, o_orderstatus, CAST(CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) THEN 0 WHEN o_orderstatus='P' THEN 1 WHEN o_orderstatus='O' THEN 2 ELSE 3 END AS INTEGER) AS turn
FROM orders WHERE o_orderstatus IN ('P','O','F') OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)""")
def label_queue(t: Tables) -> DataFrame:
    """Orders to be labelled: those of large lines first, then by status, each shuffled."""
    gold = t.lineitem.where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return samples.label_queue(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", ["P", "O", "F"], gold, 29)


@query("""
SELECT c_nationkey, c_custkey, rich FROM (SELECT c_nationkey, c_custkey, c_acctbal >= 0 AS rich, row_number() OVER (PARTITION BY c_nationkey, c_acctbal >= 0 ORDER BY md5('12|'||c_custkey), c_custkey) AS r FROM customer) WHERE r <= 4""")
def gallery_sample(t: Tables) -> DataFrame:
    """Four sites of either kind from each nation, for a gallery."""
    sites = t.customer.select("c_nationkey", "c_custkey", (F.col("c_acctbal") >= 0).alias("rich"))
    return samples.first_of_each(sites, ["c_nationkey", "rich"], [samples.draw(12, "c_custkey"), F.col("c_custkey")], 4)
