"""Places: suppliers and customers stand for sites, at coordinates that their keys give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diptych.functions import geo
from diptych.operators import pairing

from .catalog import Tables, query


def _at(key: str) -> tuple[Column, Column]:
    return 68 + F.pmod(F.col(key) * 7919, F.lit(2900)) / 100, 8 + F.pmod(F.col(key) * 104729, F.lit(2800)) / 100


_AT_SQL = "68 + (({k} * 7919) % 2900)/100.0 AS lon, 8 + (({k} * 104729) % 2800)/100.0 AS lat"


@query(f"""
WITH s AS (SELECT s_suppkey, {_AT_SQL.format(k="s_suppkey")} FROM supplier)
SELECT s_suppkey, round_even(lon - 5/111.320/cos(radians(lat)), 6) AS west, round_even(lat - 5/110.574, 6) AS south, round_even(lon + 5/111.320/cos(radians(lat)), 6) AS east, round_even(lat + 5/110.574, 6) AS north FROM s""")
def bbox_from_center(t: Tables) -> DataFrame:
    lon, lat = _at("s_suppkey")
    return t.supplier.select("s_suppkey", geo.box_around(lon, lat, F.lit(10.0)).alias("b")).select("s_suppkey", "b.*")


_BOX_SQL = "SELECT c_custkey AS k, c_nationkey AS block, x AS x0, y AS y0, x + 6.0 AS x1, y + 6.0 AS y1 FROM (SELECT *, ((c_custkey*7919)%2000)/10.0 AS x, ((c_custkey*104729)%2000)/10.0 AS y FROM customer)"


def _boxes(t: Tables) -> DataFrame:
    x, y = F.pmod(F.col("c_custkey") * 7919, F.lit(2000)) / 10, F.pmod(F.col("c_custkey") * 104729, F.lit(2000)) / 10
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("block"), x.alias("x0"), y.alias("y0"), (x + 6.0).alias("x1"), (y + 6.0).alias("y1"))


@query(f"""
WITH b AS ({_BOX_SQL}) SELECT a.k AS earlier, b.k AS later, round(CAST(greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0))/((b.x1-b.x0)*(b.y1-b.y0)) AS DOUBLE), 6) AS share
FROM b a JOIN b ON a.block=b.block AND a.k<b.k WHERE CAST(greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0))/((b.x1-b.x0)*(b.y1-b.y0)) AS DOUBLE) > 0.1""")
def bbox_overlap_pairs(t: Tables) -> DataFrame:
    """Pairs of boxes of a block that overlap by over a tenth of the later one: an equality join on the cells that they touch.

    A pair is kept at one cell only, the first that both touch, so it is not found twice.
    """
    size = 6.0
    boxes = _boxes(t)
    span = lambda c: F.sequence(F.floor(F.col(f"{c}0") / size), F.floor(F.col(f"{c}1") / size))
    cells = boxes.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    a, b = (cells.select("block", "cx", "cy", *[F.col(c).alias(f"{p}{c}") for c in ("k", "x0", "y0", "x1", "y1")]) for p in "ab")
    pairs = a.join(b, ["block", "cx", "cy"]).where("ak < bk")
    pairs = pairs.where((F.col("cx") == F.floor(F.greatest("ax0", "bx0") / size)) & (F.col("cy") == F.floor(F.greatest("ay0", "by0") / size)))
    share = geo.overlap_area("a", "b") / ((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")))
    return pairs.where(share > 0.1).select(F.col("ak").alias("earlier"), F.col("bk").alias("later"), F.round(share, 6).alias("share"))


@query(f"""
WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY k) AS i FROM ({_BOX_SQL})),
r AS (SELECT DISTINCT block, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS kept, CAST(NULL AS BIGINT) AS k, false AS refused FROM b
UNION ALL SELECT block, i, CASE WHEN hit THEN kept ELSE list_append(kept, {{'x': x, 'y': y}}) END, k, hit FROM
 (SELECT r.block, b.i, r.kept, CAST(b.k AS BIGINT) AS k, CAST(b.x0 AS DOUBLE) AS x, CAST(b.y0 AS DOUBLE) AS y,
   len(list_filter(r.kept, lambda o: greatest(0, 6 - abs(o.x - b.x0)) * greatest(0, 6 - abs(o.y - b.y0)) > 0.1 * 36)) > 0 AS hit FROM r JOIN b ON b.block = r.block AND b.i = r.i + 1))
SELECT k, block FROM r WHERE refused""")
def bbox_overlap_greedy(t: Tables) -> DataFrame:
    """Boxes refused because they overlap an earlier kept one."""
    return pairing.greedy_overlaps(_boxes(t), "block", "k", "k")


#: A ring with a notch, in degrees.
RING = [(70.0, 10.0), (90.0, 12.0), (88.0, 30.0), (80.0, 20.0), (72.0, 31.0)]


@query(f"""
WITH s AS (SELECT c_custkey, {_AT_SQL.format(k="c_custkey")} FROM customer), e AS (SELECT * FROM (VALUES (70.0,10.0,90.0,12.0),(90.0,12.0,88.0,30.0),(88.0,30.0,80.0,20.0),(80.0,20.0,72.0,31.0),(72.0,31.0,70.0,10.0)) e(ax,ay,bx,by_)),
c AS (SELECT c_custkey, any_value(c_nationkey) AS n FROM customer GROUP BY 1)
SELECT n AS nation, count(*) FILTER (inside) AS n_inside, count(*) AS n FROM (SELECT c_custkey, sum(CASE WHEN (ay>lat)<>(by_>lat) AND lon < CAST(lat-ay AS DOUBLE)*(CAST(bx-ax AS DOUBLE)/CAST(by_-ay AS DOUBLE))+ax THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM s, e GROUP BY 1) JOIN c USING (c_custkey) GROUP BY 1""")
def point_in_polygon(t: Tables) -> DataFrame:
    lon, lat = _at("c_custkey")
    inside = geo.in_ring(lon, lat, RING)
    return t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count_if(inside).alias("n_inside"), F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT p_partkey, CAST((p_partkey*7919)%120000 - 5000 AS DOUBLE) AS x, CAST((p_partkey*104729)%120000 - 5000 AS DOUBLE) AS y FROM part),
b AS (SELECT *, CAST(least(greatest(floor(x/10240),0),9) AS INTEGER) AS col, CAST(least(greatest(floor((109800-y)/10240),0),9) AS INTEGER) AS "row" FROM p)
SELECT p_partkey, col, "row", least(x-col*10240, col*10240+10240-x, 109800-"row"*10240-y, y-(109800-"row"*10240-10240)) AS margin FROM b""")
def block_index_margin(t: Tables) -> DataFrame:
    x, y = (F.pmod(F.col("p_partkey") * m, F.lit(120_000)) - 5000 for m in (7919, 104_729))
    return t.part.select("p_partkey", geo.block_index(x.cast("double"), y.cast("double"), 0.0, 109_800.0, 10_240.0, 10).alias("b")).select("p_partkey", "b.*")


@query("""
WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 1024 AS INTEGER) AS h FROM orders), g AS (SELECT unnest(range(16)) AS i)
SELECT o_orderkey, CAST(i//4 AS INTEGER) AS patch_row, CAST(i%4 AS INTEGER) AS patch_col, 's' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '_r' || (i//4) || 'c' || (i%4) AS patch_id,
 CAST((i%4)*256*10 AS BIGINT) AS west, CAST(-(i//4)*256*10 AS BIGINT) AS north FROM r, g""")
def patch_explode_16(t: Tables) -> DataFrame:
    """Sixteen patches of each site's block, with their ids and the offset of their corner in metres."""
    rows = t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    row, col = F.floor(F.col("i") / 4).cast("int"), F.col("i") % 4
    name = F.concat(F.lit("s"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("_r"), row.cast("string"), F.lit("c"), col.cast("string"))
    return rows.select("o_orderkey", row.alias("patch_row"), col.cast("int").alias("patch_col"), name.alias("patch_id"), (col * 2560).cast("long").alias("west"), (-row * 2560).cast("long").alias("north"))


@query(f"""
WITH c AS (SELECT *, f/(2-f) AS n FROM (SELECT 6378137.0::DOUBLE AS a, 1/298.257223563::DOUBLE AS f)),
k AS (SELECT n, 0.9996::DOUBLE*a/(1+n)*(1+n*n/4+n*n*n*n/64) AS scale, 2*sqrt(n)/(1+n) AS e, n/2-2*n*n/3+5*n*n*n/16 AS a1, 13*n*n/48-3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3 FROM c),
s AS (SELECT s_suppkey, radians(CAST(lat AS DOUBLE)) AS phi, radians(CAST(lon AS DOUBLE)-81) AS lam FROM (SELECT s_suppkey, {_AT_SQL.format(k="s_suppkey")} FROM supplier)),
t AS (SELECT *, sinh(atanh(sin(phi)) - e*atanh(e*sin(phi))) AS t FROM s, k),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM t)
SELECT s_suppkey, round(500000+scale*(eta+a1*cos(2*xi)*sinh(2*eta)+a2*cos(4*xi)*sinh(4*eta)+a3*cos(6*xi)*sinh(6*eta)), 3) AS east,
 round(scale*(xi+a1*sin(2*xi)*cosh(2*eta)+a2*sin(4*xi)*cosh(4*eta)+a3*sin(6*xi)*cosh(6*eta)), 3) AS north FROM x""")
def projected_sites(t: Tables) -> DataFrame:
    """Sites in metres of a transverse Mercator zone."""
    lon, lat = _at("s_suppkey")
    east, north = geo.utm(lon, lat, 44)
    return t.supplier.select("s_suppkey", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


def _farther(k: int) -> str:
    """The k-th pick of each nation, as a common table expression over those before it."""
    before = [f"p{i}" for i in range(1, k)]
    gaps = ", ".join(f"(c.s.lon-{p}.s.lon)*(c.s.lon-{p}.s.lon)+(c.s.lat-{p}.s.lat)*(c.s.lat-{p}.s.lat)" for p in before)
    joins = " ".join(f"JOIN {p} ON {p}.nation=c.nation" for p in before)
    free = " AND ".join(f"c.s.site<>{p}.s.site" for p in before)
    return f"p{k} AS (SELECT nation, arg_min(s, {{'g': -gap, 's': s.site}}) AS s FROM (SELECT c.nation, c.s, least({gaps}) AS gap FROM c {joins} WHERE {free}) GROUP BY 1)"


@query(f"""
WITH c AS (SELECT c_nationkey AS nation, {{'site': c_custkey, 'lon': lon, 'lat': lat}} AS s FROM (SELECT c_nationkey, c_custkey, {_AT_SQL.format(k="c_custkey")} FROM customer)),
p1 AS (SELECT nation, arg_min(s, s.site) AS s FROM c GROUP BY 1), {", ".join(_farther(k) for k in range(2, 6))}
{" UNION ALL ".join(f"SELECT nation, s.site AS site, CAST({k} AS INTEGER) AS place FROM p{k}" for k in range(1, 6))}""")
def farthest_points(t: Tables) -> DataFrame:
    """Five sites of each nation, each as far as can be from those before it, the first being the smallest key.

    Each pick is one aggregation over all sites, which combines before it shuffles: a nation's farthest site by its distance to
    those picked so far, which come to the sites as one row a nation.
    """
    lon, lat = _at("c_custkey")
    sites = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("site"), lon.alias("lon"), lat.alias("lat"))
    first = F.min(F.struct("site", "lon", "lat")).alias("pick")
    chosen = sites.groupBy("nation").agg(first).select("nation", F.array("pick").alias("picks"))
    for _ in range(4):
        gap = lambda p: (F.col("lon") - p["lon"]) * (F.col("lon") - p["lon"]) + (F.col("lat") - p["lat"]) * (F.col("lat") - p["lat"])
        left = sites.join(chosen, "nation").where(~F.exists("picks", lambda p: p["site"] == F.col("site")))
        far = left.withColumn("gap", F.array_min(F.transform("picks", gap)))
        far = far.groupBy("nation").agg(F.min(F.struct((-F.col("gap")).alias("less"), "site", "lon", "lat")).alias("next"))
        chosen = chosen.join(far, "nation", "left").select("nation", F.when(F.col("next").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(F.struct("next.site", "next.lon", "next.lat")))).alias("picks"))
    return chosen.select("nation", F.posexplode("picks").alias("k", "pick")).select("nation", "pick.site", (F.col("k") + 1).cast("int").alias("place"))
