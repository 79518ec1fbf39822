"""Placing new sites among occupied ones: distances through cells, and greedy picks that stay far from what is there."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _cell(column: str, size: float) -> Column:
    return F.floor(F.col(column) / size).cast("long")


def _met(points: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """Each point with the others of its cell and the eight around it: an equal join, as a point is sent to nine cells."""
    near = [F.explode(F.sequence(_cell(c, size) - 1, _cell(c, size) + 1)) for c in ("x", "y")]
    sent = points.withColumn("__cx", near[0]).withColumn("__cy", near[1])
    at = others.select(F.col("x").alias("__ox"), F.col("y").alias("__oy"), _cell("x", size).alias("__cx"), _cell("y", size).alias("__cy")).where("__ox IS NOT NULL AND __oy IS NOT NULL")
    return sent.join(at, ["__cx", "__cy"]).withColumn("__gap", F.sqrt((F.col("x") - F.col("__ox")) ** 2 + (F.col("y") - F.col("__oy")) ** 2))


def clear_of(points: DataFrame, occupied: DataFrame, key: str, distance: float) -> DataFrame:
    """The points (key, x, y, ..) with no occupied one (x, y) within ``distance``: an anti-join through cells of that size."""
    taken = _met(points.select(key, "x", "y"), occupied, distance).where(F.col("__gap") <= distance)
    return points.join(taken.select(key).distinct(), key, "left_anti")


def nearest_gap(points: DataFrame, occupied: DataFrame, key: str, start: float) -> DataFrame:
    """key and gap, each point's distance to the nearest occupied one (null if there is none).

    Cells begin at ``start`` and double; a point is settled once one is found within a cell's size, which nothing outside of
    its nine cells can beat.  Only points far from all go on, to larger cells.
    """
    ends = occupied.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)]).first()
    bounds = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)]).first()
    left = points.select(key, "x", "y")
    if ends["min_x"] is None or bounds["min_x"] is None:
        return left.select(key, F.lit(None).cast("double").alias("gap"))
    spread = max(max(ends[f"max_{c}"], bounds[f"max_{c}"]) - min(ends[f"min_{c}"], bounds[f"min_{c}"]) for c in "xy")
    out, size = None, start
    while True:
        last = size > spread
        gaps = _met(left, occupied, size).groupBy(key).agg(F.min("__gap").alias("gap"))
        done = cut(gaps if last else gaps.where(F.col("gap") <= size))
        out = done if out is None else out.unionByName(done)
        left = cut(left.join(done.select(key), key, "left_anti"))
        if last or left.isEmpty():
            return out.unionByName(left.select(key, F.lit(None).cast("double").alias("gap")))
        size *= 2


def shares(regions: DataFrame, area: str, total: int, over: float = 0.0) -> DataFrame:
    """The regions of more than ``over`` with n, their share of ``total`` by area, rounded with halves to even."""
    large = regions.where(F.col(area) > over)
    whole = large.agg(F.sum(area).alias("__whole"))
    return large.join(F.broadcast(whole)).withColumn("n", F.bround(F.col(area) * total / F.col("__whole")).cast("int")).drop("__whole")  # one row


def _picked(x: np.ndarray, y: np.ndarray, gap: np.ndarray, n: int) -> list[int]:
    """Greedy picks, each the farthest from what is taken; without anything taken the first is nearest to the middle."""
    nearest = gap.copy()
    if np.isnan(nearest).all():
        nearest = np.full(len(x), np.inf)
        nearest[np.argmin((x - x.mean()) ** 2 + (y - y.mean()) ** 2)] = np.finfo(float).max
        nearest[np.isinf(nearest)] = 1e300
    picks: list[int] = []
    for _ in range(min(n, len(x))):
        picks.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.sqrt((x - x[picks[-1]]) ** 2 + (y - y[picks[-1]]) ** 2))
        nearest[picks] = -1
    return picks


def top_up(candidates: DataFrame, occupied: DataFrame, regions: DataFrame, region: str, key: str, start: float, clear: float = 0.0) -> DataFrame:
    """region, key, place: new sites of each region (a row each, with n), far from the occupied ones and from each other.

    Candidates (region, key, x, y) within ``clear`` of an occupied site are left out.  A region's candidates are a grid that
    is made for the sites it asks for, so they are picked from as one group; regions are picked side by side, so that two
    new sites on both sides of a border may be nearer to each other than to the rest.  Equal gaps go by the key.
    """
    free = clear_of(candidates, occupied, key, clear) if clear else candidates
    asked = free.join(regions.where("n > 0").select(region, "n"), region)
    rows = asked.join(nearest_gap(free, occupied, key, start), key).select(region, key, "x", "y", "gap", "n")
    kinds: Sequence[str] = [f"{c} {dict(candidates.dtypes)[c]}" for c in (region, key)]

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key).reset_index(drop=True)
        picks = _picked(group.x.to_numpy(float), group.y.to_numpy(float), group.gap.to_numpy(float), int(group.n[0]))
        return group.loc[picks, [region, key]].assign(place=range(1, len(picks) + 1))

    return rows.groupBy(region).applyInPandas(pick, f"{', '.join(kinds)}, place int")
