"""Readers: registries, logs that may be cut off, nested metadata, and pairs of files found by name.

Every reader takes a path that Spark reads (any file system), gives an explicit schema, and raises from a job, not from a
look at the files by the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diptych.functions import geo
from diptych.operators.logs import last_of_each

SITES = "key string, name string, state string, category string, lat double, lon double, size_km string, season_months string, max_cloud double"


def asserted(frame: DataFrame, holds: Column, message: str) -> DataFrame:
    """The frame, whose reading fails with the message at a row for which the condition does not hold."""
    return frame.where(F.when(F.coalesce(holds, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def unique(frame: DataFrame, key: str) -> DataFrame:
    """The frame, whose reading fails if a key occurs twice; keys are counted by an aggregation and joined back."""
    counts = frame.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return asserted(frame.join(counts, key), F.col("__n") == 1, f"a {key} occurs twice").drop("__n")


def site_registry(spark: SparkSession, path: str, size_km: float = 5.0, months: str = "10,11,12,1,2") -> DataFrame:
    """Sites of a CSV file with header: typed, empty fields set to defaults, keys unique, with their bounding box."""
    rows = spark.read.schema(SITES).csv(path, header=True, enforceSchema=False)
    rows = rows.withColumn("size_km", F.coalesce(F.nullif(F.trim("size_km"), F.lit("")).cast("double"), F.lit(size_km)))
    rows = rows.withColumn("season_months", F.coalesce(F.nullif(F.trim("season_months"), F.lit("")), F.lit(months)))
    return unique(rows, "key").withColumn("bbox", geo.box_around(F.col("lon"), F.col("lat"), F.col("size_km")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sound_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records of a log that may end in a line cut off: blank and broken lines and records without a key are passed over."""
    kept = T.StructType.fromDDL(schema).add("__broken", T.StringType())
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__broken").json(path)
    return rows.where(F.col("__broken").isNull() & F.col(key).isNotNull()).drop("__broken")


def latest_lines(spark: SparkSession, path: str, schema: str, key: str, order: str | None = None) -> DataFrame:
    """The last record of each key: by a column of the log, or by file and place in the file where it has none."""
    rows = sound_lines(spark, path, schema, key)
    if order:
        return last_of_each(rows, [key], [order])
    placed = rows.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("__at"))
    return last_of_each(placed, [key], ["__at"]).drop("__at")


def nested_metadata(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """One record from each file, with the folder that it lies in."""
    rows = spark.read.schema(schema).option("multiLine", True).json(list(paths))
    return rows.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def named_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names and paths of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def numbered_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Files p<N>_before and p<N>_after, where both are there, by N."""
    files = named_files(spark, path).select("path", F.regexp_extract("name", r"^p(\d+)_(before|after)\.", 1).alias("n"), F.regexp_extract("name", r"^p(\d+)_(before|after)\.", 2).alias("side")).where("n <> ''")
    sides = [files.where(F.col("side") == s).select(F.col("n").cast("long").alias("n"), F.col("path").alias(s)) for s in ("before", "after")]
    return sides[0].join(sides[1], "n").orderBy("n")


def matched_folders(spark: SparkSession, before: str, after: str, pattern: str = "*") -> DataFrame:
    """Files of the same names in two folders, shorter names first; reading fails at a name that only one has."""
    sides = [named_files(spark, p, pattern).select("name", F.col("path").alias(s)) for s, p in (("before", before), ("after", after))]
    both = sides[0].join(sides[1], "name", "full_outer")
    return asserted(both, F.col("before").isNotNull() & F.col("after").isNotNull(), "a file has no partner").orderBy(F.length("name"), "name")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Captions of a nested set: image, split, flag, caption number and text, a row each."""
    schema = "images array<struct<filepath:string,filename:string,split:string,changeflag:int,sentences:array<struct<raw:string>>>>"
    images = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("images").alias("i")).select("i.*")
    return images.select("filepath", "filename", "split", "changeflag", F.posexplode("sentences").alias("number", "s")).select("filepath", "filename", "split", "changeflag", "number", F.col("s.raw").alias("caption"))


def by_split(rows: DataFrame, names: Sequence[str] = ("train", "val", "test")) -> Mapping[str, DataFrame]:
    return {name: rows.where(F.col("split") == name) for name in names}


def grid_tiles(areas: DataFrame, step: float) -> DataFrame:
    """Square tiles of each area (key, west, south, east, north), from its south-west; partial ones at the edges are left out."""
    count = lambda a, b: F.floor(F.round((F.col(b) - F.col(a)) / step, 9)).cast("int")
    rows = areas.withColumns({"nx": count("west", "east"), "ny": count("south", "north")}).where("nx > 0 and ny > 0")
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    west, south = F.col("west") + F.col("col") * step, F.col("south") + F.col("row") * step
    return cells.select("key", "col", "row", F.round(west, 9).alias("x0"), F.round(south, 9).alias("y0"), F.round(west + step, 9).alias("x1"), F.round(south + step, 9).alias("y1"))


def ring_area(points: Column) -> Column:
    """The area within a ring of points (x, y), by the shoelace formula."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    terms = F.zip_with(points, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2


def inside_ring(x: Column, y: Column, points: Column) -> Column:
    """As geo.in_ring, for rings that are data: crossings of a ray are counted over the ring's edges."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    crossed = F.zip_with(points, following, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), x < (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]) + a["x"]).otherwise(F.lit(False)))
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1


def candidate_points(areas: DataFrame, wanted: int = 150, least_step: float = 250.0) -> DataFrame:
    """Grid points inside each area (key, points) at a spacing that gives about ``wanted`` of them; the first corner if none falls inside."""
    low = lambda c: F.array_min(F.transform("points", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("points", lambda p: p[c]))
    rows = areas.select("key", "points", F.greatest(F.lit(least_step), F.sqrt(ring_area(F.col("points")) / wanted)).alias("step"), low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
    steps = lambda a, b: F.sequence(F.lit(0), F.greatest(F.floor((F.col(b) - F.col(a)) / F.col("step")).cast("int"), F.lit(0)))
    grid = rows.withColumn("i", F.explode(steps("x0", "x1"))).withColumn("j", F.explode(steps("y0", "y1")))
    grid = grid.select("key", "points", (F.col("x0") + (F.col("i") + 0.5) * F.col("step")).alias("x"), (F.col("y0") + (F.col("j") + 0.5) * F.col("step")).alias("y"))
    found = grid.where(inside_ring(F.col("x"), F.col("y"), F.col("points"))).select("key", "x", "y")
    missed = areas.join(found.select("key").distinct(), "key", "left_anti").select("key", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    return found.unionByName(missed)


def explicit_or_registered(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """The box that a request gives (bbox), or else its site's; reading fails at a request with neither."""
    found = asked.alias("a").join(registry.select("key", "bbox").alias("r"), F.col("a.site") == F.col("r.key"), "left")
    out = found.select("a.site", F.coalesce("a.bbox", "r.bbox").alias("bbox"))
    return asserted(out, F.col("bbox").isNotNull(), "a site is not known and no box is given")
