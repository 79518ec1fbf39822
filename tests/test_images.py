"""Kernels over images against plain versions, kept gates, and sites among others."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diptych import registry
from diptych.functions import colour
from diptych.operators import images, learning, logs, placing, rasters, samples


def _flooded(mask, diagonal):
    seen, out = set(), []
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * diagonal
    for at in zip(*np.nonzero(mask)):
        if at in seen:
            continue
        todo, cells = [at], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in cells or not (0 <= y < mask.shape[0] and 0 <= x < mask.shape[1]) or not mask[y, x]:
                continue
            cells.add((int(y), int(x)))
            todo += [(y + dy, x + dx) for dy, dx in steps]
        seen |= cells
        out.append(cells)
    return out


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels(diagonal):
    draw = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        mask = draw.random((17, 23)) < share
        found = images.labels(mask, diagonal)
        wanted = _flooded(mask, diagonal)
        assert {frozenset(zip(*(k.tolist() for k in np.nonzero(found == v)))) for v in np.unique(found[found > 0])} == {frozenset(c) for c in wanted}
    spiral = np.zeros((41, 41), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    assert len(np.unique(images.labels(spiral))) == 2


def test_box_means_cost_the_same_and_mirror():
    draw = np.random.default_rng(2)
    grid = draw.random((9, 12))
    for reach in (0, 1, 3, 8, 20):
        p = np.pad(grid, reach, mode="reflect")
        wanted = np.array([[p[y : y + 2 * reach + 1, x : x + 2 * reach + 1].mean() for x in range(12)] for y in range(9)])
        assert np.allclose(images.box_mean(grid, reach), wanted)


def test_features_of_known_pairs():
    draw = np.random.default_rng(3)
    base = draw.integers(30, 90, (40, 40, 3)).astype(float)
    same = images.pair_features(base, base)
    assert same["colour_mean"] == same["edge_new"] == same["blob_n"] == 0 and same["edge_corr"] == pytest.approx(1)
    # Brighter all over: nothing changes once brightness is matched.
    assert images.pair_features(base, base * 1.5 + 10)["colour_mean"] < 1e-2
    built = base.copy()
    built[10:20, 12:24] = 220
    found = images.pair_features(base, built)
    # A few of its pixels were bright and grey before, so they did not become so.
    assert found["blob_n"] == 1 and 0.9 * 120 / 1600 < found["blob_max"] <= 120 / 1600 and found["blob_fill"] > 0.9
    assert found["bright_new"] == pytest.approx(120 / 1600, abs=0.01) and found["edge_new"] > 0
    flat = images.pair_features(np.zeros((5, 5, 3)), np.zeros((5, 5, 3)))
    assert flat["edge_corr"] == 1 and flat["blob_n"] == 0


def test_brightness_needs_enough_pixels():
    x = np.arange(200.0)
    assert images.brightness_fit(x, 2 * x + 3)[:2] == (2.0, 3.0)
    assert images.brightness_fit(x[:99], 2 * x[:99] + 3) == (1.0, 0.0, 99)
    assert images.brightness_fit(np.ones(200), x)[0] == 1.0
    assert images.brightness_fit(x, 5 * x)[0] == 2.0


def test_masks(spark):
    """A strip of one pixel goes, a hole of one is filled, a speck is dropped, and a square stays."""
    mask = np.zeros((20, 20), int)
    mask[2:9, 2:9] = 1
    mask[5, 5] = 0
    mask[12, 1:18] = 1
    mask[15:18, 14:17] = 1
    mask[17, 4] = 1
    rows = [(1, y, x, int(mask[y, x])) for y in range(20) for x in range(20)]
    frame = spark.createDataFrame(rows, "image int, y int, x int, v int")
    kept = {(r.y, r.x) for r in images.cleaned(frame, "image", "v", 10).where("v = 1").collect()}
    assert kept <= {(y, x) for y in range(2, 9) for x in range(2, 9)} and len(kept) >= 37
    assert (12, 9) not in kept and (17, 4) not in kept and (16, 15) not in kept
    closed = {(r.y, r.x) for r in images.closed(frame, "image", "v").where("v = 1").collect()}
    assert (5, 5) in closed
    assert images.cleaned(frame.where("false"), "image", "v", 10).collect() == []


def test_cover_by_colour(spark):
    wanted = {(20, 20, 22): "shadow", (20, 60, 100): "water", (60, 120, 50): "vegetation", (170, 130, 90): "soil", (200, 200, 205): "built"}
    rows = spark.createDataFrame(list(wanted), "r int, g int, b int").withColumn("c", images.cover(F.col("r"), F.col("g"), F.col("b")))
    assert {(r.r, r.g, r.b): r.c for r in rows.collect()} == {k: images.COVER[v] for k, v in wanted.items()}


def test_regions_in_order(spark):
    gap = np.zeros((30, 30))
    gap[3:9, 3:9], gap[15:27, 15:27], gap[2:5, 22:25] = 200, 100, 90
    rows = [(7, y, x, float(gap[y, x])) for y in range(30) for x in range(30)]
    found = images.ranked_regions(spark.createDataFrame(rows, "image int, y int, x int, gap double"), "image", "gap", reach=1, percentile=70, smallest=9, most=2).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2] and found[0].x0 >= 14 and found[1].x1 <= 10
    assert found[0].pixels * found[0].score >= found[1].pixels * found[1].score


def test_gate_is_kept_and_applied(spark, tmp_path):
    draw = random.Random(5)
    rows = [(k, k // 2 % 7, float(k % 2), (k % 2) + draw.gauss(0, 0.3), draw.gauss(0, 1)) for k in range(240)] + [(900, 1, None, 0.2, 0.1)]
    frame = spark.createDataFrame(rows, "id int, site int, label double, good double, noise double").withColumn("fold", samples.fold_of("site", 3, 5))
    gate, report = learning.fit_gate(frame, {"noise": ["noise"], "good": ["good", "noise"]}, {"logistic": learning.logistic}, "label", "fold", 3)
    assert gate.name == "logistic on good" and gate.features == ("good", "noise") and len(report) == 2
    best = max(report, key=lambda r: r["average_precision"])
    assert gate.threshold == best["threshold"] and best["recall"] >= 0.9
    table = frame.drop("fold").withColumn("score", F.lit("theirs")).drop("score")
    first = {r.id: (r.score, r.passed) for r in gate.apply(table).collect()}
    assert all(p == (s >= gate.threshold) for s, p in first.values()) and len(first) == 241
    gate.save(str(tmp_path / "gate"))
    gate.save(str(tmp_path / "gate"))
    again = learning.Gate.load(spark, str(tmp_path / "gate"))
    assert (again.name, again.features, again.threshold) == (gate.name, gate.features, gate.threshold)
    assert {r.id: (r.score, r.passed) for r in again.apply(table).collect()} == first


def test_nearest_and_clear(spark):
    draw = random.Random(6)
    old = [(draw.uniform(0, 50), draw.uniform(0, 50)) for _ in range(40)] + [(900.0, 900.0)]
    new = [(k, draw.uniform(-20, 70), draw.uniform(-20, 70)) for k in range(150)] + [(500, 400.0, 400.0)]
    points, occupied = spark.createDataFrame(new, "key int, x double, y double"), spark.createDataFrame(old, "x double, y double")
    gap = {k: min(math.hypot(x - a, y - b) for a, b in old) for k, x, y in new}
    found = {r.key: r.gap for r in placing.nearest_gap(points, occupied, "key", 0.5).collect()}
    assert set(found) == set(gap) and all(math.isclose(found[k], gap[k]) for k in gap)
    assert {r.key for r in placing.clear_of(points, occupied, "key", 3.0).collect()} == {k for k, g in gap.items() if g > 3}
    assert {r.gap for r in placing.nearest_gap(points, occupied.where("false"), "key", 0.5).collect()} == {None}
    assert placing.nearest_gap(points.where("false"), occupied, "key", 0.5).collect() == []


def test_top_up_without_any_occupied(spark):
    """The first site is the one nearest to the middle, the next are as far as can be."""
    grid = [("a", 10 * y + x, float(x), float(y)) for y in range(9) for x in range(9)]
    points, none = spark.createDataFrame(grid, "region string, key int, x double, y double"), spark.createDataFrame([], "x double, y double")
    asked = spark.createDataFrame([("a", 5), ("b", 2)], "region string, n int")
    found = {r.place: r.key for r in placing.top_up(points, none, asked, "region", "key", 1.0).collect()}
    assert found[1] == 44 and {found[k] for k in (2, 3, 4, 5)} == {0, 8, 80, 88}


def test_ranks_by_value(spark):
    draw = random.Random(7)
    rows = [(k, draw.choice("ab"), None if k % 50 == 0 else float(draw.randrange(40))) for k in range(600)]
    frame = spark.createDataFrame(rows, "key int, g string, v double")
    found = {(r.g, r["rank"]): r.key for r in samples.by_value(frame, ["g"], "v", "key").collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [found[g, k] for k in range(1, len(order) + 1)] == [r[0] for r in order]


def test_shares_are_given_out(spark):
    rows = [("a", 50.0, 100), ("b", 30.0, 4), ("c", 20.0, 100), ("d", 0.0, 100), ("e", 0.5, 100)]
    frame = spark.createDataFrame(rows, "name string, area double, most int")
    found = {r.name: r.given for r in samples.apportioned(frame, "name", "area", 40, least=1, capacity="most").collect()}
    assert sum(found.values()) == 40 and found["b"] == 4 and found["d"] == 1 and found["a"] > 2 * found["c"] - 3
    few = samples.apportioned(frame.where("name = 'b'"), "name", "area", 40, capacity="most").collect()
    assert [r.given for r in few] == [4]
    assert samples.apportioned(frame.where("false"), "name", "area", 40).collect() == []


def test_stale_renders(spark):
    work = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5), (5, None)], "k int, changed int")
    cache = spark.createDataFrame([(1, 6, 2), (2, 3, 2), (3, 9, 1), (3, 4, 2), (5, 1, 2)], "k int, made int, version int")
    assert {r.k: r.why for r in logs.stale(work, cache, "k", "changed", "made", "version", 2).collect()} == {2: "older", 3: "version", 4: "missing"}


def test_runs(spark):
    log = spark.createDataFrame([("x", "begin", 5), ("x", "did", 6), ("x", "did", 7), ("x", "end", 8), ("x", "did", 9), ("y", "begin", 2), ("y", "did", 3), ("z", "did", 1)], "run string, kind string, t int")
    found = [tuple(r) for r in logs.run_table(log, "run", "kind", "t", "begin", "end", "did").orderBy("run_id").collect()]
    assert found == [(1, "y", 2, None, 1), (2, "x", 5, 8, 2)]


# Pairs of Lab colours and their distances, as published with the formula.
PAIRS = [
    (50, 2.6772, -79.7751, 50, 0, -82.7485, 2.0425), (50, 3.1571, -77.2803, 50, 0, -82.7485, 2.8615), (50, 2.8361, -74.02, 50, 0, -82.7485, 3.4412), (50, -1.3802, -84.2814, 50, 0, -82.7485, 1.0),
    (50, 0, 0, 50, -1, 2, 2.3669), (50, 2.49, -0.001, 50, -2.49, 0.0009, 7.1792), (50, -0.001, 2.49, 50, 0.0009, -2.49, 4.8045), (50, 2.5, 0, 73, 25, -18, 27.1492), (50, 2.5, 0, 61, -5, 29, 22.8977),
    (50, 2.5, 0, 56, -27, -3, 31.903), (50, 2.5, 0, 58, 24, 15, 19.4535), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_colour_distances(spark):
    frame = spark.createDataFrame([tuple(map(float, p)) for p in PAIRS], "l double, a double, b double, m double, c double, d double, wanted double")
    sides = [tuple(F.col(x) for x in side) for side in ("lab", "mcd")]
    for r in frame.select(colour.ciede2000(*sides).alias("one"), colour.ciede2000(*sides[::-1]).alias("other"), "wanted").collect():
        assert r.one == pytest.approx(r.wanted, abs=1e-4) == pytest.approx(r.other, abs=1e-4)
    known = {(255, 255, 255): (100, 0, 0), (0, 0, 0): (0, 0, 0), (255, 0, 0): (53.24, 80.09, 67.20), (0, 0, 255): (32.30, 79.19, -107.86)}
    rows = spark.createDataFrame(list(known), "r int, g int, b int")
    for r in rows.select("*", *[c.alias(n) for n, c in zip("xyz", colour.lab(F.col("r"), F.col("g"), F.col("b")))]).collect():
        assert (r.x, r.y, r.z) == pytest.approx(known[r.r, r.g, r.b], abs=0.02)


def test_distance_in_steps_is_the_same_and_short(spark):
    draw = random.Random(8)
    rows = [tuple(float(x) for _ in range(2) for x in (draw.uniform(0, 100), draw.choice([0, draw.uniform(-90, 90)]), draw.choice([0, draw.uniform(-90, 90)]))) for _ in range(300)]
    frame = spark.createDataFrame(rows, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    one, other = (tuple(F.col(f"{c}{k}") for c in "lab") for k in (1, 2))
    both = colour.with_ciede2000(frame.withColumn("whole", colour.ciede2000(one, other)), one, other, "d")
    assert all(r.whole == r.d for r in both.collect())
    found = images.distinct(spark.createDataFrame([(1, k, 10.0 * (k * 7 % 10), 5.0 * (k % 3), -4.0 * (k % 4)) for k in range(10)] + [(2, 0, 1.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0)], "g int, y int, l double, a double, b double"), "g", "y", 4)
    # One expression of the distance made plans of many million characters.
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert sorted((r.g, r.place) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]


def test_images_in_partitions_of_bounded_size(spark, folder, monkeypatch):
    monkeypatch.setattr(images, "PIXELS", 500)
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    for name in ("box_blur", "cleaned_masks", "land_cover"):
        frame = registry.queries()[name](spark, folder)
        assert frame.rdd.getNumPartitions() == -(-n // 500), "no step deals the pixels to a fixed number of tasks"


def test_grids_and_blurs_keep_repeated_and_missing_pixels(spark):
    frame = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 0, 4.0), (1, 2, 1, 9.0), (None, 0, 0, 1.0), (2, 0, 1, None)], "image int, y int, x int, v double")
    found = sorted((r.image, r.y, r.x, r.v or 0.0, r.there) for r in images.whole_grids(images.in_place(frame, "image"), "image").collect())
    empty = [(1, y, x, 0.0, False) for y in range(3) for x in range(2) if (y, x) not in {(0, 0), (2, 1)}]
    assert found == sorted([(1, 0, 0, 2.0, True), (1, 0, 0, 4.0, True), (1, 2, 1, 9.0, True), *empty, (2, 0, 0, 0.0, False), (2, 0, 1, 0.0, True)])
    blurred = sorted((r.image, r.y, r.x, r.blurred) for r in rasters.blurred(frame, "image", "v").collect())
    assert blurred == [(1, 0, 0, 3.0), (1, 0, 0, 3.0), (1, 2, 1, 9.0), (2, 0, 1, None)]
