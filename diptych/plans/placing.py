"""New sites among old ones: nations stand for regions, suppliers for occupied sites, customers for candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.operators import placing

from .catalog import Tables, query
from .geometry import _AT_SQL, _at

_MOST = 5


def _pick_sql(k: int) -> str:
    """The k-th pick of each region that asks for as many, as a common table over those before it."""
    joins = " ".join(f"JOIN p{i} ON p{i}.nation = f.nation" for i in range(1, k))
    gap = "least(gap" + "".join(f", sqrt((f.lon-p{i}.s.lon)*(f.lon-p{i}.s.lon)+(f.lat-p{i}.s.lat)*(f.lat-p{i}.s.lat))" for i in range(1, k)) + ")"
    free = "".join(f" AND f.site <> p{i}.s.site" for i in range(1, k))
    return f"p{k} AS (SELECT nation, arg_min({{'site': site, 'lon': lon, 'lat': lat}}, {{'g': -g, 's': site}}) AS s FROM (SELECT f.*, {gap} AS g FROM f JOIN n ON n.nation = f.nation {joins} WHERE n.n >= {k}{free}) GROUP BY 1)"


@query(f"""
WITH c AS (SELECT c_nationkey AS nation, c_custkey AS site, {_AT_SQL.format(k="c_custkey")} FROM customer), o AS (SELECT {_AT_SQL.format(k="s_suppkey")} FROM supplier),
f AS MATERIALIZED (SELECT nation, site, c.lon, c.lat, min(sqrt((c.lon-o.lon)*(c.lon-o.lon)+(c.lat-o.lat)*(c.lat-o.lat))) AS gap FROM c, o GROUP BY 1, 2, 3, 4 HAVING gap > 0.5),
r AS (SELECT nation, count(*) AS area FROM c GROUP BY 1 HAVING count(*) > 3),
n AS (SELECT nation, CAST(round_even(area*50/sum(area) OVER (), 0) AS INTEGER) AS n FROM r),
{", ".join(_pick_sql(k) for k in range(1, _MOST + 1))}
{" UNION ALL ".join(f"SELECT nation, s.site AS site, CAST({k} AS INTEGER) AS place FROM p{k}" for k in range(1, _MOST + 1))}""")
def top_up_sites(t: Tables) -> DataFrame:
    """Fifty new sites shared among the larger nations by size, none within half a degree of a supplier, each far from all."""
    (lon, lat), (old_lon, old_lat) = _at("c_custkey"), _at("s_suppkey")
    candidates = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("site"), lon.alias("x"), lat.alias("y"))
    regions = placing.shares(candidates.groupBy("nation").agg(F.count(F.lit(1)).alias("area")), "area", 50, over=3)
    return placing.top_up(candidates, t.supplier.select(old_lon.alias("x"), old_lat.alias("y")), regions, "nation", "site", 1.0, clear=0.5)


@query(f"""
WITH c AS (SELECT c_custkey AS site, {_AT_SQL.format(k="c_custkey")} FROM customer), o AS (SELECT {_AT_SQL.format(k="s_suppkey")} FROM supplier)
SELECT site, round(min(sqrt((c.lon-o.lon)*(c.lon-o.lon)+(c.lat-o.lat)*(c.lat-o.lat))), 9) AS gap FROM c, o GROUP BY 1""")
def nearest_occupied(t: Tables) -> DataFrame:
    """How far each customer is from the nearest supplier."""
    (lon, lat), (old_lon, old_lat) = _at("c_custkey"), _at("s_suppkey")
    gaps = placing.nearest_gap(t.customer.select(F.col("c_custkey").alias("site"), lon.alias("x"), lat.alias("y")), t.supplier.select(old_lon.alias("x"), old_lat.alias("y")), "site", 0.5)
    return gaps.select("site", F.round("gap", 9).alias("gap"))
