"""Patches of two dates with three bands: line items stand for pixels, a supplier for an image of 20 by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.operators import images

from .catalog import Tables, query

_Y, _X = "(l_orderkey*7 + l_linenumber*3) % 20", "(l_partkey + l_linenumber*5 + floor(l_orderkey/20)) % 20"
_RED, _GREEN, _BLUE = "l_quantity*5", "(l_partkey*37 + l_linenumber*11) % 250 + 1", "(l_orderkey*17 + l_suppkey) % 250 + 1"
_BANDS = ", ".join(f"CAST({kind}({band}) AS INTEGER) AS {name}{date}" for kind, date in (("min", "b"), ("max", "a")) for name, band in (("r", _RED), ("g", _GREEN), ("b", _BLUE)))
_VIEWS = f"(SELECT l_suppkey AS image, CAST({_Y} AS INTEGER) AS y, CAST({_X} AS INTEGER) AS x, {_BANDS} FROM lineitem GROUP BY 1, 2, 3)"
#: The mean difference is a multiple of a fraction that often lies halfway between numbers of six places.
_PLACES = {"colour_mean": 3}
BEFORE, AFTER = ["rb", "gb", "bb"], ["ra", "ga", "ba"]


def views(t: Tables) -> DataFrame:
    """image, y, x and three bands of each date, each image in one partition; some places have no pixel."""
    at = t.lineitem.select(F.col("l_suppkey").alias("image"), F.expr(_Y).cast("int").alias("y"), F.expr(_X).cast("int").alias("x"), *[F.expr(band).alias(name) for name, band in (("r", _RED), ("g", _GREEN), ("b", _BLUE))])
    return images.in_place(at, "image", t.lineitem.count()).groupBy("image", "y", "x").agg(*[kind(name).cast("int").alias(f"{name}{date}") for kind, date in ((F.min, "b"), (F.max, "a")) for name in "rgb"])


def trimmed_rounds(rounds: int, key: str, least: int = 100) -> str:
    """Common tables w0 (key, y, x, a, b: b is fitted on a) to w{rounds}: gain and offset after each round, and the pixels it keeps."""
    out, columns = [], key.split(", ")
    names = ", ".join(columns)
    same = " AND ".join(f"r.{c} = f.{c}" for c in columns)
    for k in range(1, rounds + 1):
        out.append(f"f{k} AS (SELECT {names}, max(gain) AS og, max(off) AS oo, count(*) FILTER (used) AS n, coalesce(regr_slope(b, a) FILTER (used), 1) AS slope, avg(a) FILTER (used) AS ma, avg(b) FILTER (used) AS mb FROM w{k - 1} GROUP BY {names})")
        out.append(f"h{k} AS (SELECT r.* EXCLUDE (gain, off, used), used AS before, n >= {least} AS again, CASE WHEN n >= {least} THEN least(greatest(slope, 0.5), 2) ELSE og END AS gain, CASE WHEN n >= {least} THEN mb - slope*ma ELSE oo END AS off FROM w{k - 1} r JOIN f{k} f ON {same})")
        out.append(f"w{k} AS MATERIALIZED (SELECT * EXCLUDE (before, again), CASE WHEN again THEN round(abs(b - (gain*a + off)), 9) <= quantile_cont(round(abs(b - (gain*a + off)), 9), 0.4) OVER (PARTITION BY {names}) ELSE before END AS used FROM h{k})")
    return ",\n".join(out)


_GRID = f"""p AS {_VIEWS},
s AS (SELECT image, max(y) AS h, max(x) AS w FROM p GROUP BY 1),
g AS MATERIALIZED (SELECT s.image, s.h, s.w, yy.y, xx.x, {", ".join(f"CAST(coalesce(p.{c}, 0) AS DOUBLE) AS {c}" for c in BEFORE + AFTER)}
 FROM s, unnest(range(0, s.h + 1)) AS yy(y), unnest(range(0, s.w + 1)) AS xx(x) LEFT JOIN p ON p.image = s.image AND p.y = yy.y AND p.x = xx.x)"""
_VALID = " AND ".join(f"{c} > 0" for c in BEFORE + AFTER)


@query(f"""WITH RECURSIVE {_GRID},
w0 AS (SELECT image, k, y, x, CASE k WHEN 0 THEN ra WHEN 1 THEN ga ELSE ba END AS a, CASE k WHEN 0 THEN rb WHEN 1 THEN gb ELSE bb END AS b, CAST(1 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS off, true AS used FROM g, (SELECT unnest(range(0, 3)) AS k) WHERE {_VALID}),
{trimmed_rounds(3, "image, k")},
o AS (SELECT s.image, {", ".join(f"round(coalesce(max(gain) FILTER (k = {k}), 1), 4) AS g{k}, round(coalesce(max(off) FILTER (k = {k}), 0), 3) AS o{k}" for k in range(3))} FROM s LEFT JOIN w3 ON w3.image = s.image GROUP BY 1),
m AS MATERIALIZED (SELECT g.*, {", ".join(f"least(greatest({c}*g{k} + o{k}, 0), 255) AS m{k}" for k, c in enumerate(AFTER))} FROM g JOIN o ON o.image = g.image),
e AS MATERIALIZED (SELECT *, (abs(m0-rb)+abs(m1-gb)+abs(m2-bb))/3 AS gap, rb+gb+bb AS lb, m0+m1+m2 AS la FROM m),
d AS (SELECT a.image, a.y, a.x, {", ".join(f"sqrt(power(sum(n.{v}*dy*(2-abs(dx))), 2) + power(sum(n.{v}*dx*(2-abs(dy))), 2)) AS e{v[1]}" for v in ("lb", "la"))}
 FROM e a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx), e n WHERE n.image = a.image AND n.y = least(greatest(a.y+dy, 0), a.h) AND n.x = least(greatest(a.x+dx, 0), a.w) GROUP BY 1, 2, 3),
q AS (SELECT image, quantile_cont(v, 0.85) AS t FROM (SELECT image, eb AS v FROM d UNION ALL SELECT image, ea FROM d) GROUP BY 1),
st AS MATERIALIZED (SELECT e.*, eb, ea, eb > t AS sb, ea > t AS sa FROM e JOIN d ON d.image = e.image AND d.y = e.y AND d.x = e.x JOIN q ON q.image = e.image),
nw AS MATERIALIZED (SELECT *, sa AND NOT EXISTS (SELECT 1 FROM st n WHERE n.image = a.image AND n.sb AND abs(n.y-a.y)+abs(n.x-a.x) <= 2) AS is_new, sb AND NOT EXISTS (SELECT 1 FROM st n WHERE n.image = a.image AND n.sa AND abs(n.y-a.y)+abs(n.x-a.x) <= 2) AS is_lost FROM st a),
l AS (SELECT image, quantile_cont(lb, 0.8) AS tb, quantile_cont(la, 0.8) AS ta FROM e GROUP BY 1),
c AS MATERIALIZED (SELECT nw.*, (la > ta AND m1-(m0+m2)/2 < 2 AND greatest(m0,m1,m2)-least(m0,m1,m2) < 40) AND NOT (lb > tb AND gb-(rb+bb)/2 < 2 AND greatest(rb,gb,bb)-least(rb,gb,bb) < 40) AS became FROM nw JOIN l ON l.image = nw.image),
k AS MATERIALIZED (SELECT *, gap > 40 AND (became OR EXISTS (SELECT 1 FROM c n WHERE n.image = a.image AND n.is_new AND abs(n.y-a.y)+abs(n.x-a.x) <= 1)) AS changed FROM c a),
v AS (SELECT image, y, x, y*1000+x AS label FROM k WHERE changed UNION SELECT n.image, n.y, n.x, v.label FROM v JOIN k n ON n.image = v.image AND n.changed AND abs(n.y-v.y)+abs(n.x-v.x) = 1),
b AS (SELECT image, label, count(*) AS size, (max(y)-min(y)+1)*(max(x)-min(x)+1) AS box FROM (SELECT image, y, x, min(label) AS label FROM v GROUP BY 1, 2, 3) GROUP BY 1, 2),
z AS (SELECT image, count(*) AS n, max(size) AS top, arg_min(box, label - 1000000*size) AS box FROM b GROUP BY 1),
f AS (SELECT image, count(*) AS area, avg(gap) AS colour_mean, {", ".join(f"avg(CASE WHEN {what} THEN 1.0 ELSE 0.0 END) AS {name}" for name, what in (("colour_frac25", "gap > 25"), ("colour_frac40", "gap > 40"), ("edge_new", "is_new"), ("edge_lost", "is_lost"), ("bright_new", "became"), ("blob_struct", "changed")))}, corr(eb, ea) AS edge_corr FROM k GROUP BY 1)
SELECT f.image, {", ".join(f"round({n}, {_PLACES.get(n, 6)}) AS {n}" for n in images.FEATURES if not n.startswith("blob") or n == "blob_struct")}, round(coalesce(top, 0)/area, 6) AS blob_max, CAST(coalesce(n, 0) AS DOUBLE) AS blob_n, round(coalesce(top/box, 0), 6) AS blob_fill FROM f LEFT JOIN z ON z.image = f.image""")
def image_pair_features(t: Tables) -> DataFrame:
    """What sets the two views of each image apart: colour, edges, new bright surfaces, and the blobs of these."""
    out = images.gate_features(views(t), "image", BEFORE, AFTER)
    return out.select("image", *[F.round(f, _PLACES.get(f, 6)).alias(f) for f in images.FEATURES])


def _around(inner: str, kind: str, name: str) -> str:
    """A common table of the least or greatest of a cross of three pixels."""
    return f"{name} AS MATERIALIZED (SELECT a.image, a.y, a.x, {kind}(n.v) AS v FROM {inner} a JOIN {inner} n ON n.image = a.image AND abs(n.y-a.y)+abs(n.x-a.x) <= 1 GROUP BY 1, 2, 3)"


@query(f"""WITH RECURSIVE p AS {_VIEWS}, m AS MATERIALIZED (SELECT image, y, x, CASE WHEN ra-rb > 40 THEN 1 ELSE 0 END AS v FROM p),
{_around("m", "min", "m1")}, {_around("m1", "max", "m2")}, {_around("m2", "max", "m3")}, {_around("m3", "min", "m4")},
r AS (SELECT image, y, x, y*1000+x AS label FROM m4 WHERE v = 1 UNION SELECT n.image, n.y, n.x, r.label FROM r JOIN m4 n ON n.image = r.image AND n.v = 1 AND greatest(abs(n.y-r.y), abs(n.x-r.x)) = 1),
l AS (SELECT image, y, x, min(label) AS label FROM r GROUP BY 1, 2, 3),
k AS (SELECT image, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image, label) AS n FROM l) WHERE n >= 6)
SELECT m.image, m.y, m.x, m.v AS marked, m2.v AS opened, CASE WHEN k.image IS NULL THEN 0 ELSE 1 END AS cleaned FROM m JOIN m2 USING (image, y, x) LEFT JOIN k USING (image, y, x)""")
def cleaned_masks(t: Tables) -> DataFrame:
    """Change masks, opened, and cleaned: opened, closed, and without regions of under six pixels."""
    mask = views(t).select("image", "y", "x", F.when(F.col("ra") - F.col("rb") > 40, 1).otherwise(0).alias("marked"))
    opened = images.opened(mask.withColumn("v", F.col("marked")), "image", "v")
    closed = images.closed(opened.withColumn("opened", F.col("v")), "image", "v")
    return images.without_small(closed, "image", "v", 6, ["marked", "opened"]).select("image", "y", "x", "marked", "opened", F.col("v").alias("cleaned"))


@query(f"""WITH p AS {_VIEWS}, m AS MATERIALIZED (SELECT image, y, x, ra AS v FROM p),
d AS (SELECT a.image, a.y, a.x, max(n.v) AS dilated FROM m a JOIN m n ON n.image = a.image AND abs(n.y-a.y) <= 1 AND abs(n.x-a.x) <= 2 GROUP BY 1, 2, 3),
e AS (SELECT a.image, a.y, a.x, min(n.dilated) AS closed FROM d a JOIN d n ON n.image = a.image AND abs(n.y-a.y) <= 1 AND abs(n.x-a.x) <= 2 GROUP BY 1, 2, 3)
SELECT image, y, x, dilated, closed FROM d JOIN e USING (image, y, x)""")
def grey_dilation(t: Tables) -> DataFrame:
    """The greatest value in a box of 3 by 5 around each pixel, and of these the least: grey dilation and closing."""
    out = images.whole_grids(views(t).select("image", "y", "x", F.col("ra").alias("dilated")), "image")
    out = images.filtered(out, "image", "dilated", F.max, 3, 5)
    # Dilated values of places without a pixel take no part in the closing.
    out = out.withColumn("closed", F.when(F.col("there"), F.col("dilated")))
    return images.filtered(out, "image", "closed", F.min, 3, 5).where("there").drop("there")


_MIRROR = "CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > {last} THEN 2*{last}-({i}) ELSE {i} END"


def _cover_sql(r: str, g: str, b: str) -> str:
    c = images.COVER
    top, low = f"greatest({r},{g},{b})", f"least({r},{g},{b})"
    span = f"CAST({top}-{low} AS DOUBLE)"
    turn = f"CASE WHEN {span} = 0 THEN 0 WHEN {top} = {r} THEN 60*({g}-{b})/{span} WHEN {top} = {g} THEN 120+60*({b}-{r})/{span} ELSE 240+60*({r}-{g})/{span} END"
    hue = f"floor((CASE WHEN {turn} < 0 THEN {turn}+360 ELSE {turn} END)/2+0.5)"
    s = f"(CASE WHEN {top} = 0 THEN 0 ELSE floor(255*{span}/{top}+0.5) END/255)"
    v = f"({top}/255)"
    water = f"({b} > {r} AND {b} >= CAST(0.9 AS DOUBLE)*{g} AND {s} > CAST(0.15 AS DOUBLE) AND {v} < CAST(0.45 AS DOUBLE))"
    excess = f"((2*{g}-{r}-{b})/({r}+{g}+{b}+CAST(1e-6 AS DOUBLE)))"
    between = lambda x, a, z: f"{x} >= CAST({a} AS DOUBLE) AND {x} <= CAST({z} AS DOUBLE)"
    soil = f"({between(hue, 8, 30)} AND {between(s, 0.12, 0.55)} AND {between(v, 0.25, 0.85)})"
    return f"CASE WHEN {v} < CAST(0.18 AS DOUBLE) AND NOT {water} THEN {c['shadow']} WHEN {water} THEN {c['water']} WHEN {excess} > CAST(0.06 AS DOUBLE) THEN {c['vegetation']} WHEN {soil} THEN {c['soil']} ELSE {c['built']} END"


@query(f"""WITH p AS {_VIEWS}, c AS MATERIALIZED (SELECT image, y, x, {_cover_sql("rb", "gb", "bb")} AS colour, max(y) OVER (PARTITION BY image) AS h, max(x) OVER (PARTITION BY image) AS w FROM p),
v AS (SELECT a.image, a.y, a.x, a.colour, n.colour AS k, count(*) AS n FROM c a, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx), c n
 WHERE n.image = a.image AND n.y = {_MIRROR.format(i="a.y+dy", last="a.h")} AND n.x = {_MIRROR.format(i="a.x+dx", last="a.w")} GROUP BY ALL)
SELECT image, y, x, colour, arg_min(k, k - 100*n) AS cover FROM v GROUP BY 1, 2, 3, 4""")
def land_cover(t: Tables) -> DataFrame:
    """Each pixel's class by colour, and the commonest class of the 5 by 5 pixels around it."""
    rows = views(t).select("image", "y", "x", images.cover(*[F.col(c) for c in BEFORE]).alias("colour"))
    return images.commonest(rows.withColumn("cover", F.col("colour")), "image", "cover", len(images.COVER), placed=True)


@query(f"""WITH RECURSIVE {_GRID}, a AS MATERIALIZED (SELECT image, h, w, y, x, abs(ra-rb) AS gap FROM g),
b AS (SELECT a.image, a.y, a.x, sum(n.gap)/25.0 AS m FROM a, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx), a n
 WHERE n.image = a.image AND n.y = {_MIRROR.format(i="a.y+dy", last="a.h")} AND n.x = {_MIRROR.format(i="a.x+dx", last="a.w")} GROUP BY 1, 2, 3),
l AS MATERIALIZED (SELECT image, y, x, m/greatest(max(m) OVER (PARTITION BY image), 1e-6) AS level FROM b),
k AS MATERIALIZED (SELECT l.* FROM l JOIN (SELECT image, quantile_cont(level, 0.75) AS cut FROM l GROUP BY 1) q ON q.image = l.image AND l.level >= q.cut),
r AS (SELECT image, y, x, y*1000+x AS label FROM k UNION SELECT n.image, n.y, n.x, r.label FROM r JOIN k n ON n.image = r.image AND abs(n.y-r.y)+abs(n.x-r.x) = 1),
c AS (SELECT image, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS pixels, avg(level) AS score FROM (SELECT image, y, x, min(label) AS label FROM r GROUP BY 1, 2, 3) JOIN k USING (image, y, x) GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT image, x0, y0, x1, y1, pixels, round(score, 6) AS score, row_number() OVER (PARTITION BY image ORDER BY round(pixels*score, 9) DESC, label) AS rank FROM c QUALIFY rank <= 4""")
def change_regions(t: Tables) -> DataFrame:
    """The four regions of each image where the smoothed change stands out most, by pixels times score."""
    gap = views(t).select("image", "y", "x", F.abs(F.col("ra") - F.col("rb")).alias("gap"))
    return images.ranked_regions(gap, "image", "gap", reach=2, smallest=5, most=4).withColumn("score", F.round("score", 6))
