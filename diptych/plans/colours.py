"""Colour differences of the views of an image, and colours that are told apart well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.functions import colour
from diptych.operators import images

from .catalog import Tables, query
from .images import _VIEWS, AFTER, BEFORE, views


def _lab_sql(bands: list[str], suffix: str) -> str:
    linear = [f"(CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92 ELSE power(({c}/255.0::DOUBLE+0.055)/1.055, 2.4) END)" for c in bands]
    f = []
    for row, white in zip(colour._XYZ, colour._WHITE, strict=True):
        t = f"(({' + '.join(f'{v}*CAST({k!r} AS DOUBLE)' for v, k in zip(linear, row, strict=True))})/CAST({white!r} AS DOUBLE))"
        f.append(f"(CASE WHEN {t} > CAST(216 AS DOUBLE)/24389 THEN cbrt({t}) ELSE ({t}*(CAST(24389 AS DOUBLE)/27)+16)/116 END)")
    return f"116*{f[1]}-16 AS l{suffix}, 500*({f[0]}-{f[1]}) AS a{suffix}, 200*({f[1]}-{f[2]}) AS b{suffix}"


def _distance_sql(rows: str) -> str:
    """Common tables from x (l1, a1, b1, l2, a2, b2 and others) to z, which has d."""
    root = "sqrt({0}/({0}+power(CAST(25 AS DOUBLE), 7)))"
    hue = "(CASE WHEN {a} = 0 AND {b} = 0 THEN 0 ELSE CASE WHEN atan2({b}, {a}) < 0 THEN degrees(atan2({b}, {a}))+360 ELSE degrees(atan2({b}, {a})) END END)"
    return f"""x AS ({rows}),
x1 AS (SELECT *, 0.5*(1-{root.format("power((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2, 7)")}) AS g FROM x),
x2 AS (SELECT *, a1*(1+g) AS p1, a2*(1+g) AS p2 FROM x1),
x3 AS (SELECT *, sqrt(p1*p1+b1*b1) AS c1, sqrt(p2*p2+b2*b2) AS c2, {hue.format(a="p1", b="b1")} AS h1, {hue.format(a="p2", b="b2")} AS h2 FROM x2),
x4 AS (SELECT *, CASE WHEN c1*c2=0 THEN 0 WHEN h2-h1>180 THEN h2-h1-360 WHEN h2-h1 < -180 THEN h2-h1+360 ELSE h2-h1 END AS step, (l1+l2)/2 AS light, (c1+c2)/2 AS mean,
 CASE WHEN c1*c2=0 THEN h1+h2 WHEN abs(h2-h1)<=180 THEN (h1+h2)/2 WHEN h1+h2<360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS h FROM x3),
x5 AS (SELECT *, (l2-l1)/(1+0.015*(light-50)*(light-50)/sqrt(20+(light-50)*(light-50))) AS dl, (c2-c1)/(1+0.045*mean) AS dc,
 2*sqrt(c1*c2)*sin(radians(step/2))/(1+0.015*mean*(1-0.17*cos(radians(h-30))+0.24*cos(radians(2*h))+0.32*cos(radians(3*h+6))-0.20*cos(radians(4*h-63)))) AS dh,
 -sin(radians(60*exp(-((h-275)/25)*((h-275)/25))))*2*{root.format("power(mean, 7)")} AS rt FROM x4),
z AS (SELECT *, sqrt(dl*dl+dc*dc+dh*dh+rt*dc*dh) AS d FROM x5)"""


@query(f"""WITH {_distance_sql(f"SELECT image, {_lab_sql(BEFORE, '1')}, {_lab_sql(AFTER, '2')} FROM {_VIEWS}")}
SELECT image, round(avg(d), 5) AS distance, round(avg(CASE WHEN sqrt((l2-l1)*(l2-l1)+(a2-a1)*(a2-a1)+(b2-b1)*(b2-b1)) > 40 THEN 1.0 ELSE 0.0 END), 6) AS share FROM z GROUP BY 1""")
def colour_change(t: Tables) -> DataFrame:
    """For each image the mean CIEDE2000 distance of its views, and the share of pixels that are over 40 apart in Lab."""
    one, other = (colour.lab(*[F.col(c) for c in bands]) for bands in (BEFORE, AFTER))
    rows = views(t).select("image", *[c.alias(f"{n}{k}") for k, side in ((1, one), (2, other)) for n, c in zip("lab", side, strict=True)])
    first, second = (tuple(F.col(f"{n}{k}") for n in "lab") for k in (1, 2))
    gap = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(first, second, strict=True)), F.lit(0.0)))
    return rows.groupBy("image").agg(F.round(F.avg(colour.ciede2000(first, second)), 5).alias("distance"), F.round(F.avg(F.when(gap > 40, 1.0).otherwise(0.0)), 6).alias("share"))


def _farthest_sql(k: int) -> str:
    """Pick k of each image's colours, by the least distance to those before, as a common table."""
    return f"p{k} AS (SELECT image, arg_min(y, {{'g': -g, 'y': y}}) AS y, {k} AS place FROM (SELECT image, y, min(d) AS g FROM z JOIN ({' UNION ALL '.join(f'SELECT image, y AS oy FROM p{i}' for i in range(1, k))}) USING (image, oy) GROUP BY 1, 2) WHERE g > 0 GROUP BY 1)"


_LINES = f"(SELECT image, y, CAST(avg(rb) AS DOUBLE) AS r, CAST(avg(gb) AS DOUBLE) AS g_, CAST(avg(bb) AS DOUBLE) AS b_ FROM {_VIEWS} GROUP BY 1, 2)"


@query(f"""WITH c AS MATERIALIZED (SELECT image, y, {_lab_sql(["r", "g_", "b_"], "1")} FROM {_LINES}),
{_distance_sql("SELECT c.*, o.y AS oy, o.l1 AS l2, o.a1 AS a2, o.b1 AS b2 FROM c JOIN c o ON o.image = c.image")},
p1 AS (SELECT image, min(y) AS y, 1 AS place FROM c GROUP BY 1), {", ".join(_farthest_sql(k) for k in range(2, 5))}
{" UNION ALL ".join(f"SELECT image, y, place FROM p{k}" for k in range(1, 5))}""")
def distinct_colours(t: Tables) -> DataFrame:
    """Of the mean colours of each image's rows four that are told apart best, each the farthest from those before."""
    means = views(t).groupBy("image", "y").agg(*[F.avg(c).alias(c) for c in BEFORE])
    lab = colour.lab(*[F.col(c) for c in BEFORE])
    rows = means.select("image", "y", *[c.alias(n) for n, c in zip(("l", "a", "b"), lab, strict=True)])
    return images.distinct(rows, "image", "y", 4)
