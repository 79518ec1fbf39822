"""Pixel tables: line items stand for pixels, a hundred parts for an image, the price and quantity for its two dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.functions import geo
from diptych.operators import rasters
from diptych.operators.images import in_place

from .catalog import Tables, query
from .images import _VIEWS, trimmed_rounds, views

_PIXELS = "(SELECT l_suppkey AS image, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(min(l_quantity*5) AS DOUBLE) AS a, CAST(max(l_quantity*5) AS DOUBLE) AS b FROM (SELECT *, (l_partkey // 10) % 20 AS y, l_partkey % 20 AS x FROM lineitem) GROUP BY 1,2,3)"


def pixels(t: Tables) -> DataFrame:
    """image, y, x and the values a and b of the two dates, 0 .. 250, each image in one partition."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("image"), F.pmod(F.floor(F.col("l_partkey") / 10), F.lit(20)).cast("int").alias("y"), F.pmod("l_partkey", F.lit(20)).cast("int").alias("x"), (F.col("l_quantity") * 5).alias("v"))
    return in_place(rows, "image", t.lineitem.count()).groupBy("image", "y", "x").agg(F.min("v").alias("a"), F.max("v").alias("b"))


@query(f"""SELECT image, round(avg(abs(b-a)),6) AS mean_gap, round(avg(CASE WHEN abs(b-a)>40 THEN 1.0 ELSE 0.0 END),6) AS share, avg(CASE WHEN abs(b-a)>40 THEN 1.0 ELSE 0.0 END)>=0.05 AS changed FROM {_PIXELS} GROUP BY 1""")
def changed_fraction(t: Tables) -> DataFrame:
    out = rasters.changed_share(pixels(t), "image", F.col("a"), F.col("b"))
    return out.select("image", F.round("mean_gap", 6).alias("mean_gap"), F.round("share", 6).alias("share"), "changed")


@query(f"""
WITH p AS {_PIXELS}, s AS (SELECT image, CAST(least(3*y//20,2)*3+least(3*x//20,2) AS INTEGER) AS zone, abs(b-a)>40 AS c FROM p)
SELECT image, zone, count(*) AS n, round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END),6) AS share FROM s GROUP BY 1,2""")
def zone_3x3(t: Tables) -> DataFrame:
    z = geo.zone(F.col("y"), F.col("x"), 20, 20)
    return pixels(t).groupBy("image", z.alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.abs(F.col("b") - F.col("a")) > 40, 1.0).otherwise(0.0)), 6).alias("share"))


@query(f"""
WITH p AS {_PIXELS} SELECT image, abs(quantile_cont(b,0.01)-quantile_cont(a,0.01)) > 25 AS haze, greatest(avg(CASE WHEN a>=245 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN b>=245 THEN 1.0 ELSE 0.0 END)) > 0.3 AS white FROM p GROUP BY 1""")
def quality_flags_pixels(t: Tables) -> DataFrame:
    """Haze where the darkest hundredth of the dates differs by over 25, white where over three tenths of a date are at 245."""
    white = F.greatest(*[F.avg(F.when(F.col(c) >= 245, 1.0).otherwise(0.0)) for c in "ab"]) > 0.3
    haze = F.abs(F.percentile("b", F.lit(0.01)) - F.percentile("a", F.lit(0.01))) > 25
    return pixels(t).groupBy("image").agg(haze.alias("haze"), white.alias("white"))


@query(f"""
WITH p AS {_PIXELS}, q AS (SELECT image, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM (SELECT image, a AS v FROM p UNION ALL SELECT image, b FROM p) WHERE v>0 GROUP BY 1)
SELECT image, round(avg(least(greatest((a-lo)*255/greatest(hi-lo,1e-9),0),255)),4) AS a, round(avg(least(greatest((b-lo)*255/greatest(hi-lo,1e-9),0),255)),4) AS b FROM p JOIN q USING (image) GROUP BY 1""")
def joint_stretch(t: Tables) -> DataFrame:
    out = rasters.stretch(pixels(t), "image", ["a", "b"], 0.02, 0.98)
    return out.groupBy("image").agg(F.round(F.avg("a"), 4).alias("a"), F.round(F.avg("b"), 4).alias("b"))


@query(f"""
WITH p AS {_PIXELS}, f AS (SELECT image, least(greatest(coalesce(regr_slope(b,a),1),0.5),2) AS gain, avg(a) AS ma, avg(b) AS mb, corr(a,b) AS r FROM p GROUP BY 1) SELECT image, round(gain,6) AS gain, round(mb-gain*ma,5) AS "offset", round(r,6) AS r FROM f""")
def linear_match(t: Tables) -> DataFrame:
    return rasters.fitted_line(pixels(t), "image", "a", "b").select("image", F.round("gain", 6).alias("gain"), F.round("offset", 5).alias("offset"), F.round("r", 6).alias("r"))


@query(f"""
WITH v AS {_VIEWS},
w0 AS (SELECT image, y, x, CAST(rb AS DOUBLE) AS a, CAST(ra AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS off, true AS used FROM v),
{trimmed_rounds(3, "image")}
SELECT image, round(max(gain), 4) AS gain, round(max(off), 3) AS "offset", count(*) FILTER (used) AS n_used FROM w3 GROUP BY 1""")
def trimmed_linear_match(t: Tables) -> DataFrame:
    return rasters.trimmed_line(views(t), "image", "rb", "ra")


@query(f"""
WITH p AS {_PIXELS}, c AS (SELECT image, CAST(least(floor(a/42),5) AS INTEGER) AS f, CAST(least(floor(b/42),5) AS INTEGER) AS t FROM p), n AS (SELECT image, CAST(1+f*6+t AS INTEGER) AS code, count(*) AS n FROM c GROUP BY 1,2)
SELECT image, code, n, round(100*n/sum(n) OVER (PARTITION BY image),4) AS percent FROM n""")
def transition_matrix(t: Tables) -> DataFrame:
    classes = pixels(t).select("image", F.least(F.floor(F.col("a") / 42), F.lit(5)).cast("int").alias("f"), F.least(F.floor(F.col("b") / 42), F.lit(5)).cast("int").alias("t"))
    return rasters.transitions(classes, "image", "f", "t")


@query(f"""
WITH p AS {_PIXELS} SELECT o.image, o.y, o.x, round(avg(n.b-n.a),6) AS blurred FROM p o JOIN p n ON o.image=n.image AND abs(o.y-n.y)<=1 AND abs(o.x-n.x)<=1 GROUP BY 1,2,3""")
def box_blur(t: Tables) -> DataFrame:
    gap = pixels(t).select("image", "y", "x", (F.col("b") - F.col("a")).alias("gap"))
    return rasters.blurred(gap, "image", "gap", placed=True).select("image", "y", "x", F.round("blurred", 6).alias("blurred"))


@query(f"""
WITH RECURSIVE p AS (SELECT image, y, x, b-a AS gap FROM {_PIXELS} WHERE b-a > 150), r AS (SELECT image, y, x, y AS sy, x AS sx FROM p UNION SELECT r.image, p.y, p.x, r.sy, r.sx FROM r JOIN p ON p.image=r.image AND abs(p.y-r.y)+abs(p.x-r.x)=1),
l AS (SELECT image, y, x, min(sy*1000+sx) AS label FROM r GROUP BY 1,2,3)
SELECT image, CAST(min(x) AS BIGINT) AS x0, CAST(min(y) AS BIGINT) AS y0, CAST(max(x) AS BIGINT) AS x1, CAST(max(y) AS BIGINT) AS y1, count(*) AS pixels, round(avg(gap),6) AS score FROM l JOIN p USING (image,y,x) GROUP BY image, label HAVING count(*) >= 2""")
def connected_regions(t: Tables) -> DataFrame:
    gap = pixels(t).select("image", "y", "x", (F.col("b") - F.col("a")).alias("gap"))
    return rasters.regions(gap, "image", "gap", 150.0, smallest=2)


@query()
def image_shift(t: Tables) -> DataFrame:
    return rasters.shift(pixels(t), "image", "a", "b")


@query(f"""
WITH p AS {_PIXELS} SELECT image, round(quantile_cont(abs(b-a),0.25),6) AS p25, round(quantile_cont(abs(b-a),0.5),6) AS p50, round(quantile_cont(abs(b-a),0.9),6) AS p90 FROM p GROUP BY 1""")
def percentile_numpy(t: Tables) -> DataFrame:
    gap = F.abs(F.col("b") - F.col("a"))
    q = pixels(t).groupBy("image").agg(F.percentile(gap, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select("image", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p25", "p50", "p90"))])


@query("""
WITH n AS (SELECT l_orderkey, l_suppkey % 10 AS g, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY 1,2), r AS (SELECT g, total, row_number() OVER (PARTITION BY g ORDER BY total) AS k, count(*) OVER (PARTITION BY g) AS n FROM n)
SELECT g, CAST(max(total) FILTER (k = n//2+1) AS DOUBLE) AS upper_median, CAST(max(total) AS DOUBLE) AS most FROM r GROUP BY 1""")
def upper_median_max(t: Tables) -> DataFrame:
    """The upper median and the largest of the totals of each group."""
    totals = t.lineitem.groupBy("l_orderkey", F.pmod("l_suppkey", F.lit(10)).alias("g")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CAST(total AS DOUBLE) DESC)")
    return totals.groupBy("g").agg(median.alias("upper_median"), F.max("total").cast("double").alias("most"))
