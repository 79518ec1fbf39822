"""Operators against known values and plain versions of themselves on small fixtures."""

import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from diptych.functions import geo, seasons, text
from diptych.operators import captions, learning, logs, pairing, rasters, samples, scorers, scoring, screening, vectors


def test_wilson_intervals(spark):
    rows = spark.createDataFrame([(137, 521), (9, 45), (0, 10), (10, 10), (0, 0)], "k int, n int")
    low, high = scoring.wilson(F.col("k"), F.col("n"))
    found = [tuple(None if v is None else round(100 * v) for v in r) for r in rows.select(low, high).collect()]
    assert found == [(23, 30), (11, 34), (0, 28), (72, 100), (None, None)]


def test_seasons(spark):
    days = spark.createDataFrame([(datetime.date(2020, 6, 30),), (datetime.date(2020, 7, 1),), (datetime.date(2021, 2, 28),)], "d date")
    start, end = seasons.season_bounds(seasons.cycle_year(F.col("d")), 10, 5)
    assert [tuple(r) for r in days.select(start, end).collect()] == [
        (datetime.date(2019, 10, 1), datetime.date(2020, 3, 1)), (datetime.date(2020, 10, 1), datetime.date(2021, 3, 1)), (datetime.date(2020, 10, 1), datetime.date(2021, 3, 1))]
    lists = spark.createDataFrame([("10,11,12,1",), ("1,3",), ("12,1",), ("13",), ("x",), ("5",)], "m string")
    assert [r[0] for r in lists.select(seasons.consecutive_months(F.col("m"))).collect()] == [True, False, True, False, False, True]


def test_projection_is_true_on_its_meridian_and_conformal_off_it(spark):
    a, e2 = 6378137.0, (2 - 1 / 298.257223563) / 298.257223563
    curve = lambda phi: a * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5
    steps = 20_000
    arc = sum(curve(math.radians(20) * (k + 0.5) / steps) for k in range(steps)) * math.radians(20) / steps
    d = 1e-5
    rows = spark.createDataFrame([(0, 81.0, 0.0), (1, 81.0, 20.0), (2, 78.0, 20.0), (3, 84.0, 20.0), (4, 78.0 + d, 20.0), (5, 78.0, 20.0 + d)], "k int, lon double, lat double")
    at = {r[0]: (r[1], r[2]) for r in rows.select("k", *geo.utm(F.col("lon"), F.col("lat"), 44)).collect()}
    assert at[0] == pytest.approx((500_000, 0), abs=1e-3)
    assert at[1] == pytest.approx((500_000, 0.9996 * arc), abs=1e-2)
    assert at[2][0] + at[3][0] == pytest.approx(1_000_000, abs=1e-3)
    east, north = ([(at[k][i] - at[2][i]) for i in (0, 1)] for k in (4, 5))
    phi = math.radians(20)
    along, across = a * math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2) * math.radians(d), curve(phi) * math.radians(d)
    assert math.hypot(*east) / along == pytest.approx(math.hypot(*north) / across, rel=1e-5)
    assert east[0] * north[0] + east[1] * north[1] == pytest.approx(0, abs=1e-4)


def test_folded_and_last_of_each(spark):
    log = spark.createDataFrame([(1, "start", 1), (1, "done", 2), (2, "start", 1), (2, "start", 3), (3, "start", 1), (3, "gone", 2)], "k int, kind string, t int")
    found = {tuple(r) for r in logs.folded(log, "k", "kind", ["t"], "start", "gone").collect()}
    assert found == {(1, "done", 1, 2), (2, "start", 2, 2)}
    assert {tuple(r) for r in logs.last_of_each(log, ["k"], ["t"]).collect()} == {(1, "done", 2), (2, "start", 3), (3, "gone", 2)}


def test_seeding_keeps_states(spark):
    old = spark.createDataFrame([(1, "a", "done"), (2, "b", "failed")], "k int, name string, status string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, name string")
    assert {tuple(r) for r in logs.seeded(old, new, "k", ["name"], "status", "pending").collect()} == {(1, "a", "done", False), (2, "B", "failed", False), (3, "C", "pending", True)}


def _greedy(boxes, share=0.1):
    kept, refused = [], set()
    for k, x0, y0, x1, y1 in boxes:
        area = (x1 - x0) * (y1 - y0)
        if any(max(0, min(x1, b[2]) - max(x0, b[0])) * max(0, min(y1, b[3]) - max(y0, b[1])) > share * area for b in kept):
            refused.add(k)
        else:
            kept.append((x0, y0, x1, y1))
    return refused


def test_greedy_overlaps(spark):
    rng = random.Random(4)
    boxes = [(k, x, y, x + rng.uniform(1, 3), y + rng.uniform(1, 3)) for k in range(200) for x, y in [(rng.uniform(0, 20), rng.uniform(0, 20))]]
    frame = spark.createDataFrame([(1, *b) for b in boxes], "block int, k int, x0 double, y0 double, x1 double, y1 double")
    assert {r.k for r in pairing.greedy_overlaps(frame, "block", "k", "k").collect()} == _greedy(boxes)


def test_greedy_overlaps_of_a_row_of_boxes_and_of_none(spark):
    row = [(k, 0.5 * k, 0.0, 0.5 * k + 1, 1.0) for k in range(9)]  # each over half of the next: every other one is kept
    frame = spark.createDataFrame([(1, *b) for b in row], "block int, k int, x0 double, y0 double, x1 double, y1 double")
    assert {r.k for r in pairing.greedy_overlaps(frame, "block", "k", "k").collect()} == {1, 3, 5, 7}
    assert pairing.greedy_overlaps(frame.limit(0), "block", "k", "k").collect() == []
    twins = frame.where("k = 0").unionByName(frame.where("k = 0").withColumn("k", F.lit(20))).unionByName(frame.where("k = 0").withColumn("block", F.lit(2)))
    assert [(r.block, r.k) for r in pairing.greedy_overlaps(twins, "block", "k", "k").collect()] == [(1, 20)]


def test_greedy_overlaps_of_many_copies(spark, monkeypatch):
    rng = random.Random(5)
    places = [(x, y, x + 2.0, y + 2.0) for x, y in ((rng.uniform(0, 8), rng.uniform(0, 8)) for _ in range(12))]
    boxes = [(k, *rng.choice(places)) for k in range(300)]
    frame = spark.createDataFrame([(1, *b) for b in boxes], "block int, k int, x0 double, y0 double, x1 double, y1 double")
    seen, made = [], pairing.overlaps
    monkeypatch.setattr(pairing, "overlaps", lambda *a: seen.append(made(*a)) or seen[-1])
    assert {r.k for r in pairing.greedy_overlaps(frame, "block", "k", "k").collect()} == _greedy(boxes)
    assert seen[0].count() <= 12 * 11 / 2, "copies make no pairs"


def test_diverse_pairs_one_by_one(spark):
    rng = random.Random(6)
    pairs = [(p, rng.randrange(8), rng.randrange(8), rng.randrange(60), rng.randrange(20)) for p in range(5) for _ in range(40)]
    wanted = set()
    for place in range(5):
        kept = []
        for r in sorted((r for r in pairs if r[0] == place), key=lambda r: (r[4], r[1], r[2], r[3])):
            if len(kept) < 3 and not any(r[1] == k[1] or r[2] == k[2] or abs(r[3] - k[3]) < 15 for k in kept):
                kept.append(r)
        wanted |= set(kept)
    frame = spark.createDataFrame(pairs, "place int, b int, a int, day int, score int")
    assert {tuple(r) for r in pairing.diverse(frame, "place", "b", "a", "day", ["score"]).collect()} == wanted


def _regions(grid, diagonal):
    todo, out = {p for p, v in grid.items() if v}, []
    while todo:
        stack, own = [todo.pop()], set()
        while stack:
            y, x = stack.pop()
            own.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy or dx) and (diagonal or not (dy and dx)) and (y + dy, x + dx) in todo:
                        todo.remove((y + dy, x + dx))
                        stack.append((y + dy, x + dx))
        ys, xs = zip(*own, strict=True)
        out.append((min(xs), min(ys), max(xs), max(ys), len(own)))
    return sorted(out)


@pytest.mark.parametrize("diagonal", [False, True])
def test_regions(spark, diagonal):
    rng = random.Random(2)
    grid = {(y, x): rng.random() < 0.45 for y in range(25) for x in range(31)}
    frame = spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in grid.items()], "image int, y int, x int, s double")
    found = sorted((r.x0, r.y0, r.x1, r.y1, r.pixels) for r in rasters.regions(frame, "image", "s", 0.5, diagonal=diagonal).collect())
    assert found == _regions(grid, diagonal)


def test_shift_of_a_moved_picture(spark):
    rng = random.Random(0)
    base = {(y, x): rng.random() for y in range(40) for x in range(40)}
    rows = [(1, y, x, base[y, x], base[(y - 3) % 40, (x - 2) % 40]) for y in range(40) for x in range(40)]
    r = rasters.shift(spark.createDataFrame(rows, "image int, y int, x int, a double, b double"), "image", "a", "b").first()
    assert (round(r.dy), round(r.dx)) == (3, 2)


def test_trimmed_line_ignores_changed_pixels(spark):
    rng = random.Random(1)
    rows = [(1, float(x), 1.2 * x + 7 + (90 if k % 4 == 0 else rng.gauss(0, 0.1))) for k, x in enumerate(rng.uniform(0, 100) for _ in range(400))]
    r = rasters.trimmed_line(spark.createDataFrame(rows, "image int, a double, b double"), "image", "a", "b", rounds=6).first()
    assert (r.gain, r.offset) == pytest.approx((1.2, 7), abs=0.2)


def test_screening_reasons_and_reconciling(spark):
    rows = spark.createDataFrame([(0.5, 0.1), (0.2, 0.9), (0.2, 0.1), (0.5, 0.9), (None, 0.9)], "a double, b double")
    found = [r[0] for r in rows.select(screening.first_failing([("a", F.col("a"), 0.4), ("b", F.col("b"), 0.5)])).collect()]
    assert found == ["a", "b", None, "a", "b"]
    said = spark.createDataFrame([("x {\"haze\": \"2.9\"} y",), ("none",), ("{\"haze\": true}",)], "t string")
    assert [r[0] for r in said.select(screening.whole_number(screening.json_in(F.col("t")), "$.haze")).collect()] == [2, None, None]


def test_metrics_of_captions(spark):
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a x c", "a b c d"), (3, "", "a"), (4, "q r", "s t")], "id int, hypothesis string, reference string")
    lcs = {r.id: r.f1 for r in captions.rouge_l(pairs).collect()}
    assert lcs == pytest.approx({1: 1.0, 2: 2 * (2 / 3) * (2 / 4) / (2 / 3 + 2 / 4), 3: 0.0, 4: 0.0})
    b = captions.bleu(pairs.where("id <= 2")).first()
    brevity = math.exp(1 - 9 / 8)
    assert b.bleu1 == pytest.approx(brevity * 7 / 8, abs=1e-6)
    assert b.bleu2 == pytest.approx(brevity * math.sqrt(7 / 8 * 4 / 6), abs=1e-6)
    assert {r.id: r.f1 for r in captions.overlap_f1(pairs).collect()} == pytest.approx({1: 1.0, 2: 4 / 7, 3: 0.0, 4: 0.0})
    one = captions.consensus(pairs.where("id = 1")).first()
    assert one.score == 0.0, "a lone pair has no rare gram"


def test_common_subsequences():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert captions.common_length(a, b) == table[-1][-1]


def test_text_functions(spark):
    rows = spark.createDataFrame([("  A__b  c! ",), ("",), ("x",)], "s string")
    assert [tuple(r) for r in rows.select(text.slug(F.col("s")), text.normal(F.col("s"))).collect()] == [("a_b_c", "a__b c!"), ("", ""), ("x", "x")]
    sizes = spark.createDataFrame([(5,), (2048,), (3 * 1024**2,)], "n long")
    assert [r[0] for r in sizes.select(text.human_bytes(F.col("n"))).collect()] == ["5 B", "2.0 KB", "3.0 MB"]


def test_splits_keep_groups_whole_and_shares(spark):
    frame = spark.range(1000).select((F.col("id") % 200).alias("site"))
    split = samples.split_by_group(frame, "site", 1, [("train", 0.8), ("val", 0.1), ("test", 0.1)])
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 160, "val": 20, "test": 20}
    assert split.count() == split.select("site").distinct().count()


def test_apportioned_shares(spark):
    groups = spark.createDataFrame([("a", 50.0, 100), ("b", 30.0, 5), ("c", 20.0, 100), ("d", 0.0, 100)], "name string, area double, room int")
    found = {r.name: r.given for r in samples.apportioned(groups, "name", "area", 60, least=1, capacity="room").collect()}
    assert sum(found.values()) == 60 and found["b"] == 5 and found["d"] == 1 and found["a"] > found["c"]


def test_average_precision_with_ties(spark):
    rows = [(True, 0.9), (False, 0.9), (True, 0.5), (False, 0.1)]
    r = scoring.average_precision(spark.createDataFrame(rows, "y boolean, s double"), F.col("y"), F.col("s")).first()
    assert r.average_precision == pytest.approx(0.5 * 1 / 2 + 0.5 * 2 / 3, abs=1e-6)


def test_nearest_in_blocks(spark):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    found = {(r["query"], r["place"]): r["found"] for r in vectors.nearest(frame, frame.where("id % 50 = 0"), "id", "v", 3, block=2).collect()}
    norm = {k: math.sqrt(sum(x * x for x in v)) for k, v in rows}
    for q, v in rows[::50]:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)) / norm[q] / norm[k], k) for k, w in rows if k != q))[:3]
        assert [found[q, p] for p in (1, 2, 3)] == [k for _, k in best]


class Upper(scorers.Scorer):
    def score(self, prompts):
        if len(prompts) > 2:
            raise scorers.TooLarge
        return [p.upper() for p in prompts]


def test_scorer_halves_batches(spark):
    frame = spark.createDataFrame([(k, f"p{k}") for k in range(11)], "id int, prompt string").coalesce(1)
    assert {r.id: r.answer for r in scorers.scored(frame, "prompt", Upper()).collect()} == {k: f"P{k}" for k in range(11)}


def test_a_learned_gate(spark):
    rng = random.Random(8)
    rows = [(k, k % 3, float(k % 5 == 0), (k % 5 == 0) + rng.gauss(0, 0.2)) for k in range(120)]
    frame = spark.createDataFrame(rows, "id int, fold int, label double, x double")
    scored = learning.out_of_fold(frame, learning.logistic(["x"], "label"), "fold", 3, ["id", "label"])
    assert scored.count() == 120
    assert scoring.average_precision(scored, F.col("label") == 1, F.col("score")).first().average_precision > 0.95


def test_retry_machine_over_batches(spark, tmp_path):
    from diptych.streaming import queues

    base = pd.Timestamp("2024-01-01")
    for part, rows in enumerate([[(1, "error"), (1, "error"), (2, "error")], [(1, "error"), (2, "view"), (1, "view")]]):
        frame = pd.DataFrame([(10 * part + k, base + pd.Timedelta(minutes=10 * part + k), u, kind, 1.0, "{}") for k, (u, kind) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        frame.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"part{part}.parquet")
    folder = tmp_path / "in"
    folder.mkdir()
    for f in tmp_path.glob("part*.parquet"):
        f.rename(folder / f.name)
    out = queues.finished(queues.retry_machine(queues.events(spark, str(folder), 1), "user_id"), ["key"])
    assert {r.key: (r.state, r.errors, r.n_events) for r in out.collect()} == {1: ("failed", 3, 4), 2: ("running", 0, 2)}


def test_later_splits_fill_quotas_up(spark):
    sites = spark.createDataFrame([("a", k) for k in range(40)] + [("b", k) for k in range(100, 110)] + [("c", 200)], "state string, site int")
    old = spark.createDataFrame([(0, "test"), (1, "test"), (2, "train"), (100, "val"), (101, "val")], "site int, split string")
    found = {r.site: r.split for r in samples.quota_split(sites, "state", "site", 5, earlier=old).collect()}
    assert len(found) == 51 and found[200] == "train"
    assert [found[k] for k in (0, 1, 2, 100, 101)] == ["test", "test", "train", "val", "val"]
    n = lambda keys, split: sum(found[k] == split for k in keys)
    assert (n(range(40), "test"), n(range(40), "val")) == (4, 4)
    assert (n(range(100, 110), "test"), n(range(100, 110), "val")) == (1, 2), "what was given stays, over the quota too"


def test_selections_keep_earlier_ones(spark):
    rows = spark.createDataFrame([(k, k < 10) for k in range(60)] + [(99, None)], "id int, changed boolean")
    old = spark.createDataFrame([(k,) for k in (3, 20, 21, 22, 99)], "id int")
    found = {r.id for r in samples.balanced(rows, "changed", "id", 1, earlier=old).collect()}
    assert len(found) == 20 and set(range(10)) <= found and {20, 21, 22} <= found and 99 not in found
    first = {r.id for r in samples.balanced(rows, "changed", "id", 1).collect()}
    again = {r.id for r in samples.balanced(rows, "changed", "id", 2, earlier=spark.createDataFrame([(k,) for k in first], "id int")).collect()}
    assert again == first


def test_sets_are_issued_once(spark):
    sites = spark.createDataFrame([(k,) for k in range(20)], "site int")
    old = spark.createDataFrame([("one", k) for k in range(15)], "set string, site int")
    found = [tuple(r) for r in samples.issued(sites, "site", old, "two", 9, 3).collect()]
    assert sorted(found) == [("two", k) for k in range(15, 20)]
    with pytest.raises(ValueError):
        samples.issued(sites, "site", old, "one", 2, 3)


def test_updates_and_requeues(spark):
    table = spark.createDataFrame([(1, "running"), (2, "done"), (3, None)], "k int, status string")
    changes = spark.createDataFrame([(1, "downloading", 5), (2, None, 6), (9, "done", 7)], "k int, status string, size int")
    new = logs.updated(table, changes, "k")
    assert {tuple(r) for r in new.collect()} == {(1, "downloading", 5), (2, "done", 6), (3, None, None)}
    again = logs.requeued(new, "status", {"running": "pending", "downloading": "queued"}).select("k", "status", "requeued")
    assert {tuple(r) for r in again.collect()} == {(1, "queued", True), (2, "done", False), (3, None, False)}
