"""Writers: manifests, folders by outcome, released splits with their statistics, upserted tables, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(rows: DataFrame, folder: str) -> None:
    """The rows as JSON lines and as CSV, nested columns as JSON text in the latter."""
    rows.write.mode("overwrite").json(f"{folder}/manifest_json")
    nested = {n for n, k in rows.dtypes if k.startswith(("struct", "array", "map"))}
    rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns]).write.mode("overwrite").csv(f"{folder}/manifest_csv", header=True)


def by_outcome(rows: DataFrame, folder: str) -> None:
    """The rows in folders by status and reason ('none' where there is none), replaced folder by folder."""
    routed = rows.withColumn("reason", F.coalesce("reason", F.lit("none")))
    routed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", "reason").parquet(folder)


def release(rows: DataFrame, folder: str, site: str = "site") -> DataFrame:
    """The rows in a folder for each split, and their statistics; fails if a site is in two splits."""
    torn = rows.groupBy(site).agg(F.count_distinct("split").alias("n")).where("n > 1")
    if torn.limit(1).count():
        raise ValueError("a site is in more than one split")
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/data")
    stats = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(site).alias("n_sites"))
    stats.write.mode("overwrite").json(f"{folder}/stats")
    return stats


def upsert(spark: SparkSession, table: str, changes: DataFrame, key: str) -> str:
    """The table with changed and new rows in place, in a folder beside it whose name is returned; the old one stays until callers turn.

    Readers of the old folder are never in the way, and a failed write leaves it as it was.
    """
    old = spark.read.parquet(table)
    out = f"{table}-next"
    kept = old.join(changes.select(key).distinct(), key, "left_anti")
    kept.unionByName(changes.select(old.columns)).write.mode("overwrite").parquet(out)
    return out


def report(title: str, sections: Sequence[tuple[str, DataFrame, int]]) -> str:
    """A Markdown report of small tables; each is cut at its own number of rows, which is stated."""
    parts = [f"# {title}"]
    for name, rows, most in sections:
        found = rows.limit(most + 1).collect()
        lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found[:most]]
        parts.append(f"## {name}\n\n" + "\n".join(lines) + (f"\n\nThe first {most} rows." if len(found) > most else ""))
    return "\n\n".join(parts) + "\n"
