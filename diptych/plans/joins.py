"""Season-matched pairs: a customer's orders stand for a place's scenes, their price for the cloud share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.functions import seasons
from diptych.operators import pairing

from .catalog import Tables, query

_SCENES_SQL = """
WITH scenes AS (SELECT o_custkey AS place, o_orderkey AS scene, CAST(o_orderdate AS DATE) AS day, o_orderstatus, (o_orderkey % 100)/100.0 AS cloud, (o_orderkey % 7)/100.0 AS snow,
  CASE WHEN month(o_orderdate) < 7 THEN year(o_orderdate)-1 ELSE year(o_orderdate) END AS cycle FROM orders),
placed AS (SELECT *, CAST(day - make_date(cycle, 7, 1) AS INTEGER) AS season_day FROM scenes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY place, side ORDER BY cloud, day, scene) AS r FROM (SELECT *, CASE WHEN day < DATE '1998-07-01' THEN 'before' ELSE 'after' END AS side FROM placed)),
b AS (SELECT * FROM ranked WHERE side='before' AND r<=8), a AS (SELECT * FROM ranked WHERE side='after' AND r<=8),
pairs AS (SELECT b.place, b.scene AS before_scene, a.scene AS after_scene, b.season_day AS before_day, abs(b.season_day-a.season_day) AS gap_days,
  CASE WHEN abs(b.season_day-a.season_day) > 30 THEN 'rejected_gap' WHEN round(abs(b.snow-a.snow),6) > 0.05 THEN 'rejected_snow' ELSE 'paired' END AS outcome,
  round(b.cloud+a.cloud+abs(b.season_day-a.season_day)/100.0, 6) AS score FROM b JOIN a USING (place))
"""


def scenes(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.select(
        F.col("o_custkey").alias("place"), F.col("o_orderkey").alias("scene"), day.alias("day"), (F.pmod("o_orderkey", F.lit(100)) / 100).alias("cloud"),
        (F.pmod("o_orderkey", F.lit(7)) / 100).alias("snow"), seasons.season_day(day, 7).alias("season_day"), F.when(day < F.lit("1998-07-01").cast("date"), "before").otherwise("after").alias("side"),
    )


def scored_pairs(t: Tables) -> DataFrame:
    """Each place's eight clearest scenes of either side, paired; the score is cloud on both sides and the season gap."""
    best = pairing.best_scenes(scenes(t), ["place", "side"], [F.col("cloud"), F.col("day"), F.col("scene")], 8).drop("rank", "day")
    sides = [best.where(F.col("side") == s).drop("side") for s in ("before", "after")]
    pairs = pairing.season_pairs(*sides, ["place"], "season_day", 30, "snow", 0.05000001)
    return pairs.withColumn("score", F.round(F.col("before_cloud") + F.col("after_cloud") + F.col("gap_days") / 100, 6))


@query(_SCENES_SQL + "SELECT place, before_scene, after_scene, CAST(gap_days AS INTEGER) AS gap_days, CAST(score AS DOUBLE) AS score FROM pairs WHERE outcome='paired'")
def season_gap_pairs(t: Tables) -> DataFrame:
    return scored_pairs(t).where("outcome = 'paired'").select("place", "before_scene", "after_scene", "gap_days", "score")


@query(_SCENES_SQL + """SELECT place, count(*) FILTER (outcome='paired') AS paired, count(*) FILTER (outcome='rejected_gap') AS rejected_gap,
  count(*) FILTER (outcome='rejected_snow') AS rejected_snow FROM pairs GROUP BY 1""")
def rank_pairs_diagnostics(t: Tables) -> DataFrame:
    return pairing.outcomes(scored_pairs(t), ["place"])


def _pick(k: int) -> str:
    """The k-th pick of each place, as a common table expression over those before it."""
    before = [f"p{i}" for i in range(1, k)]
    joins = " ".join(f"JOIN {p} ON {p}.place=g.place" for p in before)
    free = " AND ".join(f"g.s.b<>{p}.s.b AND g.s.a<>{p}.s.a AND abs(g.s.day-{p}.s.day)>=15" for p in before) or "true"
    return f"p{k} AS (SELECT g.place, min(g.s) AS s FROM g {joins} WHERE {free} GROUP BY 1)"


@query(f"""{_SCENES_SQL}, g AS (SELECT place, {{'score': CAST(score AS DOUBLE), 'b': before_scene, 'a': after_scene, 'day': before_day}} AS s FROM pairs WHERE outcome='paired'), {", ".join(_pick(k) for k in (1, 2, 3))}
{" UNION ALL ".join(f"SELECT place, s.b AS before_scene, s.a AS after_scene, s.day AS before_day, s.score AS score FROM p{k}" for k in (1, 2, 3))}""")
def diverse_pairs(t: Tables) -> DataFrame:
    """Up to three pairs of a place that share no scene, before days a fortnight apart; each choice depends on the last."""
    pairs = scored_pairs(t).where("outcome = 'paired'").select("place", "before_scene", "after_scene", F.col("before_season_day").alias("before_day"), "score")
    return pairing.diverse(pairs, "place", "before_scene", "after_scene", "before_day", ["score"])


@query("""
SELECT o_orderkey, CASE WHEN month(o_orderdate)<7 THEN year(o_orderdate)-1 ELSE year(o_orderdate) END AS cycle,
 make_date(CASE WHEN month(o_orderdate)<7 THEN year(o_orderdate)-1 ELSE year(o_orderdate) END, 10, 1) AS dry_start,
 make_date(1+CASE WHEN month(o_orderdate)<7 THEN year(o_orderdate)-1 ELSE year(o_orderdate) END, 3, 1) AS dry_end,
 CAST(o_orderdate AS DATE) >= make_date(CASE WHEN month(o_orderdate)<7 THEN year(o_orderdate)-1 ELSE year(o_orderdate) END, 10, 1) AND
 CAST(o_orderdate AS DATE) < make_date(1+CASE WHEN month(o_orderdate)<7 THEN year(o_orderdate)-1 ELSE year(o_orderdate) END, 3, 1) AS in_dry FROM orders""")
def season_windows(t: Tables) -> DataFrame:
    """The dry season, October to February, of the July-to-June year of each scene."""
    day = F.to_date("o_orderdate")
    start, end = seasons.season_bounds(seasons.cycle_year(day), 10, 5)
    return t.orders.select("o_orderkey", seasons.cycle_year(day).cast("long").alias("cycle"), start.alias("dry_start"), end.alias("dry_end"), ((day >= start) & (day < end)).alias("in_dry"))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_shipdate, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3""")
def topk_before_check(t: Tables) -> DataFrame:
    """The three clearest of each site, before a costly check sees them."""
    order = [F.col(c) for c in ("l_discount", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")]
    return pairing.best_scenes(t.lineitem, ["l_orderkey"], order, 3).select("l_orderkey", "l_partkey", "l_linenumber", F.col("rank").alias("r"))


@query("""
SELECT o.o_orderkey, CAST(l.l_linenumber AS INTEGER) AS l_linenumber, CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS INTEGER) AS days FROM orders o JOIN lineitem l ON l.l_orderkey=o.o_orderkey
 AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate <= o.o_orderdate + INTERVAL 60 DAY""")
def scenes_within_days(t: Tables) -> DataFrame:
    """An interval join: records of a job within sixty days after it; the equal key is joined, the interval filters."""
    days = F.datediff("l_shipdate", "o_orderdate")
    joined = t.orders.select("o_orderkey", "o_orderdate").join(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.where((F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))).select("o_orderkey", "l_linenumber", days.alias("days"))
