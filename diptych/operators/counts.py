"""Counting operators: enumerated counts, conditional counts, pivots, projections of work left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_of_all(frame: DataFrame, column: str, values: Sequence[str], name: str = "n") -> DataFrame:
    """A row for each of ``values``, in their order as ``place``, with how many rows have it; 0 where none has."""
    spark = frame.sparkSession
    listed = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, place int")
    counted = frame.where(F.col(column).isin(list(values))).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return listed.join(counted, column, "left").select("place", column, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def money(column: Column | str) -> Column:
    """A column of cents as an exact decimal, so that sums do not depend on their order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def summary(frame: DataFrame, by: Sequence[str], done: Column, amount: str) -> DataFrame:
    """For each group (null: '?'): rows, rows for which ``done`` holds, and the exact sum of an amount."""
    keys = [F.coalesce(F.col(c), F.lit("?")).alias(c) for c in by]
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("n_done"), F.sum(money(amount)).cast("double").alias("total"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def outcome_matrix(frame: DataFrame, by: str, column: str, values: Sequence[str]) -> DataFrame:
    """A row for each value of ``by``, a column of counts for each of ``values``; 0 where a pair does not occur."""
    return frame.groupBy(by).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def leaks(frame: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that are in more than one split, with how many."""
    return frame.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def most_common(frame: DataFrame, column: Column, k: int, name: str) -> DataFrame:
    """The k most frequent values, ties by value."""
    return frame.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(k)
