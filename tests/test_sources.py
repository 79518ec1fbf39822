"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from diptych.sources import catalogue, readers, writers


def test_site_registry(spark, tmp_path):
    head = "key,name,state,category,lat,lon,size_km,season_months,max_cloud\n"
    (tmp_path / "a.csv").write_text(head + "s1,One,X,city,20.0,78.0,,,\ns2,Two,X,city,21.0,79.0,10,\"1,2\",0.0\n")
    rows = {r.key: r for r in readers.site_registry(spark, str(tmp_path / "a.csv")).collect()}
    assert (rows["s1"].size_km, rows["s1"].season_months, rows["s1"].max_cloud) == (5.0, "10,11,12,1,2", None)
    assert (rows["s2"].size_km, rows["s2"].season_months, rows["s2"].max_cloud) == (10.0, "1,2", 0.0)
    assert rows["s2"].bbox.north == pytest.approx(21 + 5 / 110.574, abs=1e-6)
    (tmp_path / "b.csv").write_text(head + "s1,One,X,c,1,2,,,\ns1,Two,X,c,1,2,,,\n")
    with pytest.raises(Exception, match="occurs twice"):
        readers.site_registry(spark, str(tmp_path / "b.csv")).collect()


def test_logs_that_are_cut_off(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": "a", "v": 1}\n\n{"id": "a", "v": 2}\n{"v": 3}\n{"id": "b", "v": 4}\n{"id": "c", "v"')
    rows = readers.latest_lines(spark, str(tmp_path / "log.jsonl"), "id string, v int", "id").collect()
    assert {(r.id, r.v) for r in rows} == {("a", 2), ("b", 4)}


def test_metadata_of_folders(spark, tmp_path):
    for k, name in enumerate(("p1", "p2")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(json.dumps({"patch": name, "stats": {"n": k}}, indent=1))
    rows = readers.nested_metadata(spark, [f"{tmp_path}/*/meta.json"], "patch string, stats struct<n:int>").collect()
    assert {(r.patch, r.stats.n, r.folder) for r in rows} == {("p1", 0, "p1"), ("p2", 1, "p2")}


def test_pairs_of_files(spark, tmp_path):
    for d in ("in", "x", "y"):
        (tmp_path / d).mkdir()
    for name in ("p2_before.png", "p2_after.png", "p10_before.png", "p10_after.png", "p3_before.png", "other.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    assert [r.n for r in readers.numbered_pairs(spark, str(tmp_path / "in")).collect()] == [2, 10]
    for name in ("10.png", "9.png"):
        (tmp_path / "x" / name).write_bytes(b"x")
        (tmp_path / "y" / name).write_bytes(b"x")
    assert [r.name for r in readers.matched_folders(spark, str(tmp_path / "x"), str(tmp_path / "y")).collect()] == ["9.png", "10.png"]
    (tmp_path / "x" / "11.png").write_bytes(b"x")
    with pytest.raises(Exception, match="no partner"):
        readers.matched_folders(spark, str(tmp_path / "x"), str(tmp_path / "y")).collect()


def test_annotations(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps({"images": [{"filepath": "f", "filename": "a.png", "split": "val", "changeflag": 1, "sentences": [{"raw": "one"}, {"raw": "two"}]}]}))
    rows = readers.annotations(spark, str(tmp_path / "set.json"))
    assert [(r.number, r.caption) for r in rows.orderBy("number").collect()] == [(0, "one"), (1, "two")]
    assert readers.by_split(rows)["val"].count() == 2


def test_grids_and_areas(spark):
    areas = spark.createDataFrame([("a", 0.0, 0.0, 0.35, 0.2)], "key string, west double, south double, east double, north double")
    tiles = readers.grid_tiles(areas, 0.1).collect()
    assert {(t.col, t.row) for t in tiles} == {(c, r) for c in range(3) for r in range(2)}
    ring = [(0.0, 0.0), (4000.0, 0.0), (4000.0, 3000.0), (0.0, 3000.0)]
    rings = spark.createDataFrame([("a", [{"x": x, "y": y} for x, y in ring]), ("b", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}])], "key string, points array<struct<x:double,y:double>>")
    assert [r[0] for r in rings.orderBy("key").select(readers.ring_area(F.col("points"))).collect()] == [12e6, 0.5]
    counts = {r.key: r["count"] for r in readers.candidate_points(rings).groupBy("key").count().collect()}
    assert 120 <= counts["a"] <= 180 and counts["b"] == 1


def test_catalogue(spark, tmp_path):
    pages = [{"items": [{"id": "i1", "tile": "43A", "datetime": "2020", "cloud": 30.0}, {"id": "i2", "tile": "44B", "datetime": "2021"}], "next": "page2.json"}, {"items": [{"id": "i3", "tile": "43A", "datetime": "2019", "cloud": 5.0}], "next": "page3.json"}, {"items": [], "next": "page1.json"}]
    for k, page in enumerate(pages, 1):
        (tmp_path / f"page{k}.json").write_text(json.dumps(page))
    assert [r.id for r in catalogue.search(spark, str(tmp_path)).collect()] == ["i3", "i1", "i2"]
    assert [r.id for r in catalogue.search(spark, str(tmp_path), most_cloud=50, tiles=["43", "44"]).collect()] == ["i3", "i1"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s1", "train", "accepted", None, [1]), (2, "s2", "val", "rejected", "haze", [2])], "id int, site string, split string, status string, reason string, k array<int>")
    writers.manifest(rows, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/manifest_csv", header=True).where("k = '[1]'").count() == 1
    writers.by_outcome(rows, f"{tmp_path}/routed")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/routed").select("id", "status", "reason").collect()} == {(1, "accepted", "none"), (2, "rejected", "haze")}
    assert writers.release(rows, f"{tmp_path}/release").count() == 2
    with pytest.raises(ValueError, match="more than one split"):
        writers.release(rows.withColumn("site", F.lit("s")), f"{tmp_path}/release2")
    rows.select("id", "site").write.parquet(f"{tmp_path}/table")
    changed = spark.createDataFrame([(2, "new"), (3, "s3")], "id int, site string")
    assert {tuple(r) for r in spark.read.parquet(writers.upsert(spark, f"{tmp_path}/table", changed, "id")).collect()} == {(1, "s1"), (2, "new"), (3, "s3")}
    assert "| id | site |" in writers.report("R", [("Rows", rows.select("id", "site"), 5)])


def test_boxes_asked_for(spark):
    asked = spark.createDataFrame([("a", None), ("b", "given")], "site string, bbox string")
    sites = spark.createDataFrame([("a", "own")], "key string, bbox string")
    assert {tuple(r) for r in readers.explicit_or_registered(asked, sites).collect()} == {("a", "own"), ("b", "given")}
    with pytest.raises(Exception, match="not known"):
        readers.explicit_or_registered(asked.where("site = 'a'"), sites.where("key = 'z'")).collect()
