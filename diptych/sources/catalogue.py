"""A paged catalogue of scenes as a Spark data source: pages follow a next link until one is empty or all are read.

The pages are JSON files in a folder, as an offline copy of a search service answers: ``items`` (id, tile, datetime, cloud)
and ``next``, the name of the file with the page after.  Pages can only be found one after the other, so one task follows
the links; a search is split by tile prefixes, each a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, tile string, datetime string, cloud double, page int"


class _Search(InputPartition):
    def __init__(self, first: str, prefix: str):
        self.first, self.prefix = first, prefix


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.first = options["folder"], options.get("first", "page1.json")
        self.prefixes, self.most = options.get("tiles", "").split(","), int(options.get("max_pages", "100000"))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Search(self.first, p) for p in self.prefixes]

    def read(self, partition: _Search) -> Iterator[tuple]:
        name, n = partition.first, 0
        while name:
            n += 1
            if n > self.most:
                raise RuntimeError(f"the search has more than {self.most} pages")
            with open(f"{self.folder}/{name}", encoding="utf-8") as f:
                page = json.load(f)
            if not page.get("items"):
                return
            for item in page["items"]:
                if (item.get("tile") or "").startswith(partition.prefix):
                    yield item["id"], item.get("tile"), item.get("datetime"), item.get("cloud"), n
            name = page.get("next")


class Catalogue(DataSource):
    """Options: folder (one that all executors can open), first, tiles (comma-separated prefixes), max_pages."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def search(spark: SparkSession, folder: str, most_cloud: float | None = None, tiles: Sequence[str] = ("",)) -> DataFrame:
    """Scenes of the catalogue, clearest first (unknown cloud last), ties by time and id."""
    spark.dataSource.register(Catalogue)
    rows = spark.read.format("catalogue").option("folder", folder).option("tiles", ",".join(tiles)).load()
    if most_cloud is not None:
        rows = rows.where(F.coalesce("cloud", F.lit(100.0)) <= most_cloud)
    return rows.orderBy(F.coalesce("cloud", F.lit(100.0)), "datetime", "id")
