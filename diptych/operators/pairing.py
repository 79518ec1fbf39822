"""Pairing scenes of two seasons: a join on place and season gap, with the reasons of those refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def best_scenes(scenes: DataFrame, place: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first scenes of each place, as ``rank`` from 1; Spark keeps k of a place in each task before it shuffles."""
    ranked = scenes.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def season_pairs(before: DataFrame, after: DataFrame, place: Sequence[str], gap: str, most_gap: int, snow: str, most_snow: float) -> DataFrame:
    """All pairs of a before and an after scene of one place with their gaps, and ``outcome``: the first limit they break.

    Columns of the sides are prefixed before_ and after_.  Bound the scenes of a place first (best_scenes): pairs are as
    many as the product of the two sides.
    """
    a = before.select(*place, *[F.col(c).alias(f"before_{c}") for c in before.columns if c not in place])
    b = after.select(*place, *[F.col(c).alias(f"after_{c}") for c in after.columns if c not in place])
    pairs = a.join(b, list(place)).withColumn("gap_days", F.abs(F.col(f"before_{gap}") - F.col(f"after_{gap}")))
    snow_gap = F.abs(F.col(f"before_{snow}") - F.col(f"after_{snow}"))
    outcome = F.when(F.col("gap_days") > most_gap, "rejected_gap").when(snow_gap > most_snow, "rejected_snow").otherwise("paired")
    return pairs.withColumn("outcome", outcome)


def outcomes(pairs: DataFrame, place: Sequence[str]) -> DataFrame:
    """For each place how many pairs came to each outcome; a pair counts under the first limit that it breaks."""
    counted = [F.count_if(F.col("outcome") == x).alias(x) for x in ("paired", "rejected_gap", "rejected_snow")]
    return pairs.groupBy(*place).agg(*counted)


def diverse(pairs: DataFrame, place: str, before: str, after: str, day: str, order: Sequence[str], days: int = 15, most: int = 3) -> DataFrame:
    """The first pairs of each place, in order, that use no scene twice and whose before days lie ``days`` apart.

    Each choice depends on those before it, so a place's pairs are folded in order, as one array; best_scenes bounds them.
    """
    columns = list(dict.fromkeys([*order, before, after, place, day]))

    def clash(x: Column, y: Column) -> Column:
        return (x[before] == y[before]) | (x[after] == y[after]) | (F.abs(x[day] - y[day]) < days)

    def choose(kept: Column, x: Column) -> Column:
        free = (F.size(kept) < most) & ~F.exists(kept, lambda y: clash(x, y))
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    chosen = pairs.groupBy(place).agg(rows.alias("__rows")).select(F.explode(F.aggregate("__rows", F.slice("__rows", 1, 0), choose)).alias("__kept"))
    return chosen.select(*[F.col(f"__kept.{c}") for c in dict.fromkeys([place, before, after, day, *order])])


def overlaps(boxes: DataFrame, block: str, key: str, order: str, share: float) -> DataFrame:
    """Pairs of boxes of a block, earlier and later in order, that share over ``share`` of the later one's area.

    Boxes meet in the cells that they touch, of the size of a block's largest, and a pair counts in the first cell of both.
    """
    largest = boxes.groupBy(block).agg(F.greatest(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0")), F.lit(1e-12)).alias("__size"))
    at = boxes.join(largest, block).select(block, F.struct(order, key).alias("at"), F.col(key).alias("k"), "x0", "y0", "x1", "y1", "__size")
    span = lambda c: F.sequence(F.floor(F.col(f"{c}0") / F.col("__size")), F.floor(F.col(f"{c}1") / F.col("__size")))
    cells = at.withColumn("__x", F.explode(span("x"))).withColumn("__y", F.explode(span("y")))
    a, b = (cells.select(block, "__size", "__x", "__y", *[F.col(c).alias(f"{p}_{c}") for c in ("at", "k", "x0", "y0", "x1", "y1")]) for p in "ab")
    pairs = a.join(b, [block, "__size", "__x", "__y"]).where(F.col("a_at") < F.col("b_at"))
    pairs = pairs.where(F.col("__x") == F.floor(F.greatest("a_x0", "b_x0") / F.col("__size")))
    pairs = pairs.where(F.col("__y") == F.floor(F.greatest("a_y0", "b_y0") / F.col("__size")))
    wide, high = (F.greatest(F.lit(0.0), F.least(f"a_{c}1", f"b_{c}1") - F.greatest(f"a_{c}0", f"b_{c}0")) for c in "xy")
    area = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    return pairs.where(wide * high > share * area).select(block, F.col("a_k").alias("earlier"), F.col("b_k").alias("later"))


def greedy_overlaps(boxes: DataFrame, block: str, key: str, order: str, share: float = 0.1) -> DataFrame:
    """The boxes that overlap an earlier kept one of their block by more than ``share`` of their own area.

    Boxes have x0, y0, x1, y1 and a key that is unique in its block.  A box that was refused refuses none, so pairs are
    settled in rounds of joins: a box without an earlier one left is kept, what overlaps it is refused, and the pairs of both
    go.  In an order that has nothing to do with the places, the rounds are about the logarithm of the boxes; in the worst, a
    row of boxes each over the next, half of them.

    Of boxes that are equal in their block only the first enters these rounds: it is kept and refuses the others, or what refuses
    it refuses them as well.  So pairs grow with the different boxes that lie over each other, not with their copies.
    """
    place = [block, "x0", "y0", "x1", "y1"]
    copies = None
    if share < 1:
        # Boxes without an area or a place overlap nothing and are no one's copies.
        known = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
        firsts = cut(known.groupBy(*place).agg(F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("k"))).alias("__first"), F.count(F.lit(1)).alias("__n")))
        several = firsts.where("__n > 1").select(*place, F.col("__first.k").alias("__first"))
        copies = known.join(several, place).where(F.col(key) != F.col("__first")).select(block, F.col(key).alias("later"))
        boxes = firsts.select(*place, F.col("__first.k").alias(key), *([F.col("__first.o").alias(order)] if order != key else []))
    left, refused = cut(overlaps(boxes, block, key, order, share)), copies
    while not left.isEmpty():
        held = left.select(block, F.col("later").alias("earlier")).distinct()
        now = cut(left.join(held, [block, "earlier"], "left_anti").select(block, "later").distinct())
        refused = now if refused is None else refused.unionByName(now)
        left = left.join(now, [block, "later"], "left_anti").join(now.withColumnRenamed("later", "earlier"), [block, "earlier"], "left_anti")
        left = cut(left)
    if refused is None:
        return boxes.select(key, block).limit(0)
    return refused.select(F.col("later").alias(key), block)
