"""Embeddings: sentence and picture vectors, in batches of 64 by their id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.operators import vectors

from .catalog import Tables, query

_COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))/sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))*list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"


@query(f"""
WITH s AS (SELECT q.vec_id AS query, v.vec_id AS found, {_COS.format(a="q.embedding", b="v.embedding")} AS score FROM embeddings q JOIN embeddings v ON q.vec_id<>v.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, found) AS place FROM s)
SELECT query, found, CAST(place AS INTEGER) AS place, round(score,6) AS score FROM r WHERE place<=5""")
def embedding_cosine_topk(t: Tables) -> DataFrame:
    """The five nearest of each query; queries are the rows whose id is a multiple of fifty, against all rows."""
    found = vectors.nearest(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return found.select("query", "found", "place", F.round("score", 6).alias("score"))


def _pairs(t: Tables) -> DataFrame:
    """Vector 2k and vector 2k + 1 as the views of pair k."""
    both = t.embeddings.groupBy(F.floor(F.col("vec_id") / 2).alias("pair")).agg(
        F.max(F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))).alias("a"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("embedding"))).alias("b"))
    return both.where("a is not null and b is not null")


@query("""
SELECT CAST(x.vec_id//2 AS BIGINT) AS pair, CAST(3*len(x.embedding) AS INTEGER) AS n, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: abs(CAST(z[1] - z[2] AS DOUBLE)))), 4) AS gap FROM embeddings x JOIN embeddings y ON y.vec_id=x.vec_id+1 WHERE x.vec_id % 2 = 0""")
def abs_diff_fusion(t: Tables) -> DataFrame:
    rows = _pairs(t).select("pair", vectors.fused(F.col("a"), F.col("b")).alias("f"), F.size("a").alias("d"))
    gap = F.aggregate(F.slice("f", 2 * F.col("d") + 1, F.col("d")), F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rows.select("pair", F.size("f").alias("n"), F.round(gap, 4).alias("gap"))


@query(f"""
WITH p AS (SELECT x.vec_id//2 AS pair, x.vec_id//128 AS batch, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id=x.vec_id+1 WHERE x.vec_id % 2 = 0),
s AS (SELECT l.batch, l.pair AS i, r.pair AS j, {_COS.format(a="l.a", b="r.b")}/0.07 AS s FROM p l JOIN p r USING (batch)),
m AS (SELECT batch, ln(sum(exp(s))) - max(CASE WHEN i=j THEN s END) AS l FROM s GROUP BY batch, i UNION ALL SELECT batch, ln(sum(exp(s))) - max(CASE WHEN i=j THEN s END) FROM s GROUP BY batch, j)
SELECT CAST(batch AS BIGINT) AS batch, round(avg(l),6) AS loss FROM m GROUP BY 1""")
def info_nce(t: Tables) -> DataFrame:
    batched = _pairs(t).withColumn("batch", F.floor(F.col("pair") / 64))
    return vectors.contrastive_loss(batched, "batch", "pair", "a", "b").select("batch", F.round("loss", 6).alias("loss"))


@query("""
SELECT label, CAST(place AS INTEGER) AS place, round(avg(CAST(x AS DOUBLE)),6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY 1,2""")
def masked_mean_pool(t: Tables) -> DataFrame:
    return vectors.pooled(t.embeddings, "label", "embedding", F.col("vec_id") % 3 != 0).select("label", "place", F.round("mean", 6).alias("mean"))


@query("""
WITH s AS (SELECT label, embedding, (SELECT max(x) FROM (SELECT unnest(embedding) AS x)) AS m FROM embeddings WHERE label<>0)
SELECT round(avg(ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)-m)))) + m - CAST(embedding[label+1] AS DOUBLE)),6) AS loss, count(*) AS n FROM s""")
def token_cross_entropy(t: Tables) -> DataFrame:
    return vectors.cross_entropy(t.embeddings, F.col("embedding"), F.col("label")).select(F.round("loss", 6).alias("loss"), "n")


@query(f"""
WITH p AS (SELECT x.vec_id//128 AS batch, round(1 - {_COS.format(a="x.embedding", b="y.embedding")}, 4) AS d FROM embeddings x JOIN embeddings y ON y.vec_id=x.vec_id+1 WHERE x.vec_id % 2 = 0)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, round(avg(d),6) AS mean, min(d) AS least, max(d) AS most, round(quantile_cont(d, 0.9),6) AS p90, round(avg(CASE WHEN d>0.9 THEN 1.0 ELSE 0.0 END),6) AS far_share FROM p GROUP BY 1""")
def vector_distance_stats(t: Tables) -> DataFrame:
    batched = _pairs(t).withColumn("batch", F.floor(F.col("pair") / 64))
    return vectors.distance_stats(batched, "batch", "a", "b", 0.9)


@query("""
WITH h AS (SELECT vec_id//64 AS batch, CASE WHEN list_position(embedding, list_max(embedding))-1=label THEN 1.0 ELSE 0.0 END AS hit FROM embeddings WHERE label<>0), b AS (SELECT batch, avg(hit) AS accuracy, count(*) AS n FROM h GROUP BY 1)
SELECT round(avg(accuracy),9) AS accuracy, count(*) AS batches, CAST(sum(n) AS BIGINT) AS n FROM b""")
def token_accuracy(t: Tables) -> DataFrame:
    """A vector's largest place stands for the token predicted, its label for the one meant, label 0 for padding."""
    out = vectors.token_accuracy(t.embeddings, F.floor(F.col("vec_id") / 64), F.col("embedding"), F.col("label"))
    return out.withColumn("accuracy", F.round("accuracy", 9))
