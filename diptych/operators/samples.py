"""Sampling and splitting, by ranks of a hash that any engine can compute, so that reruns and other engines agree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def draw(seed: int, key: Column | str) -> Column:
    """The place of a key in a seeded shuffle: the hex digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def ranked(frame: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def first_of_each(frame: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; tasks keep k of a group before the shuffle."""
    return ranked(frame, groups, order, "__rank").where(F.col("__rank") <= k).drop("__rank")


def by_value(frame: DataFrame, groups: Sequence[str], value: str, key: str, name: str = "rank", parts: int = 256) -> DataFrame:
    """A row's rank in its group by a number, the greatest first, then by key; nulls come last.

    Ranks are counted within ranges between quantiles of the number, and over the ranges' sizes, so no task orders a whole
    group unless one value fills it.
    """
    cuts = frame.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10_000).alias("__cuts"))
    part = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter(F.coalesce("__cuts", F.array()), lambda c: c <= F.col(value))))
    rows = frame.join(F.broadcast(cuts)).withColumn("__part", part).drop("__cuts")  # one row
    by = [*groups, "__part"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(*groups).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__before"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)])
    out = ranked(rows, by, [F.desc_nulls_last(value), F.col(key)], "__r").join(before, same)
    return out.select(*frame.columns, (F.col("__before") + F.col("__r")).alias(name))


def interleaved(frame: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """turn: the first of every group by ``value``, groups in order, then the second of every group, and so on."""
    return by_value(frame, [group], value, key, "turn")


def capped(frame: DataFrame, group: str, subgroup: str, order: Sequence[Column], most_sub: int, most: int) -> DataFrame:
    """At most ``most_sub`` rows of a subgroup, and of these at most ``most`` of a group."""
    some = first_of_each(frame, [group, subgroup], order, most_sub)
    return first_of_each(some, [group], [*order, F.col(subgroup)], most)


def split_by_group(frame: DataFrame, group: str, seed: int, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """Each group's split: groups in shuffled order are cut at the cumulated shares of their number.

    The order is cut into ranges of the digest's first three hexadecimal digits, whose sizes are summed up, so no task
    orders all groups.
    """
    groups = frame.select(group).distinct().withColumn("__draw", draw(seed, group)).withColumn("__part", F.substring("__draw", 1, 3))
    sizes = groups.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    placed = ranked(groups, ["__part"], [F.col("__draw"), F.col(group)], "__r").join(before, "__part")
    at = (F.col("__before") + F.col("__r") - 1) / F.col("__all")
    split, total = None, 0.0
    for name, share in shares[:-1]:
        total += share
        test = at < round(total, 9)
        split = F.when(test, name) if split is None else split.when(test, name)
    return placed.select(group, split.otherwise(shares[-1][0]).alias("split"))


def placed(frame: DataFrame, groups: Sequence[str], seed: int, key: str, first: Column | None = None, digits: int = 3) -> DataFrame:
    """place: a row's rank in a seeded shuffle of its group, after those for which ``first`` holds.

    Ranks are counted within ranges of the digest's first hexadecimal digits and over the ranges' sizes, so no task orders
    a whole group.
    """
    late = F.lit("1") if first is None else F.when(first, "0").otherwise("1")
    rows = frame.withColumn("__draw", F.concat(late, draw(seed, key))).withColumn("__part", F.substring("__draw", 1, digits + 1))
    by = [*groups, "__part"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__before"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)])
    out = ranked(rows, by, [F.col("__draw"), F.col(key)], "__r").join(before, same)
    return out.select(*frame.columns, (F.col("__before") + F.col("__r")).alias("place"))


def quota_split(frame: DataFrame, state: str, site: str, seed: int, share: float = 0.1, least: int = 3, earlier: DataFrame | None = None) -> DataFrame:
    """Split of each site by its state's quota: test first, then val, the rest train; states of fewer than ``least`` only train.

    The quota is a tenth of a state's sites, rounded, one at least.  Sites that ``earlier`` (a row a site, with split) has
    keep their split and count for the quota, so a state that grew only fills up.
    """
    sites = frame.select(state, site).distinct()
    kept = F.lit(None).cast("string") if earlier is None else F.col("__kept")
    if earlier is not None:
        sites = sites.join(earlier.select(site, F.col("split").alias("__kept")), site, "left")
    sites = sites.select(state, site, kept.alias("__kept"))
    has = [F.count_if(F.col("__kept") == name).alias(f"__{name}") for name in ("test", "val")]
    totals = sites.groupBy(state).agg(F.count(F.lit(1)).alias("__n"), *has)
    quota = F.when(F.col("__n") >= least, F.greatest(F.lit(1), F.bround(F.col("__n") * share, 0).cast("int"))).otherwise(0)
    test, val = (F.greatest(F.lit(0), quota - F.col(f"__{name}")) for name in ("test", "val"))
    split = F.when(F.col("place") <= test, "test").when(F.col("place") <= test + val, "val").otherwise("train")
    new = placed(sites.where("__kept IS NULL"), [state], seed, site).join(totals, state).select(state, site, split.alias("split"))
    return new.unionByName(sites.where("__kept IS NOT NULL").select(state, site, F.col("__kept").alias("split")))


def balanced(frame: DataFrame, flag: str, key: str, seed: int, share: float = 0.5, earlier: DataFrame | None = None) -> DataFrame:
    """All flagged rows and as many others as make the flagged ``share`` of the selection, or the reverse if others are few.

    Rows whose key ``earlier`` has, which were selected before, come first in their class.  A null flag is never selected.
    """
    rows = frame.where(F.col(flag).isNotNull()).withColumn("__early", F.lit(False))
    if earlier is not None:
        old = earlier.select(key).distinct().withColumn("__old", F.lit(True))
        rows = rows.join(old, key, "left").withColumn("__early", F.col("__old").isNotNull()).drop("__old")
    n = rows.agg(F.count_if(F.col(flag)).alias("__yes"), F.count_if(~F.col(flag)).alias("__no"))
    want_yes = F.least(F.col("__yes"), F.floor(F.col("__no") * (share / (1 - share))))
    want_no = F.least(F.col("__no"), F.floor(want_yes * ((1 - share) / share)))
    ordered = placed(rows, [flag], seed, key, F.col("__early")).join(F.broadcast(n))  # n is one row
    return ordered.where(F.col("place") <= F.when(F.col(flag), want_yes).otherwise(want_no)).select(*frame.columns)


def issued(sites: DataFrame, site: str, earlier: DataFrame, name: str, size: int, seed: int) -> DataFrame:
    """A new set of ``size`` sites (fewer if there are no more) that no earlier set has; a name that was given before raises.

    ``earlier`` has the sites of all sets so far, with ``set``, their names.
    """
    if not earlier.where(F.col("set") == name).isEmpty():
        raise ValueError(f"there is a set {name} already")
    free = sites.select(site).distinct().join(earlier.select(site), site, "left_anti")
    return free.orderBy(draw(seed, site), site).limit(size).select(F.lit(name).alias("set"), site)


def quotas_with_controls(frame: DataFrame, label: str, key: str, quotas: dict[str, int], donors: Sequence[str], controls: int, seed: int) -> DataFrame:
    """Up to so many rows of each label, and again ``controls`` of those drawn whose label is a donor's, as label control.

    Labels without a quota, null among them, are not drawn; keys are drawn by their digest.
    """
    quota = F.coalesce(*[F.when(F.col(label) == name, n) for name, n in quotas.items()])
    some = placed(frame.where(F.col(label).isin(list(quotas))), [label], seed, key)
    picked = some.where(F.col("place") <= quota).select(*frame.columns)
    again = picked.where(F.col(label).isin(list(donors))).orderBy(draw(seed + 1, key), key).limit(controls)
    return picked.withColumn("control", F.lit(False)).unionByName(again.withColumns({label: F.lit("control"), "control": F.lit(True)}))


def labelled_and_not(frame: DataFrame, labelled: str, key: str, size: int, controls: int, seed: int) -> DataFrame:
    """``size`` rows: ``controls`` of any kind, which may come twice, and of the others two thirds labelled if there are so many.

    A null in ``labelled`` (boolean) is not labelled.
    """
    real = size - controls
    rows = frame.withColumn(labelled, F.coalesce(labelled, F.lit(False)))
    ordered = lambda some, n, s: some.orderBy(draw(s, key), key).limit(n)
    yes = ordered(rows.where(labelled), real * 2 // 3, seed)
    no = ranked(ordered(rows.where(~F.col(labelled)), real, seed), [], [draw(seed, key), F.col(key)], "__rank")  # at most ``real`` rows
    no = no.join(F.broadcast(yes.agg(F.count(F.lit(1)).alias("__n"))), F.col("__rank") <= real - F.col("__n")).drop("__rank", "__n")
    again = ordered(rows, controls, seed + 1)
    return yes.unionByName(no).withColumn("control", F.lit(False)).unionByName(again.withColumn("control", F.lit(True)))


def label_queue(frame: DataFrame, pool: str, key: str, pools: Sequence[str], first: DataFrame, seed: int) -> DataFrame:
    """Rows of the pools in the order to label them: keys of ``first``, then pool by pool, each shuffled; with turn, the stage."""
    early = first.select(key).distinct().withColumn("__first", F.lit(True))
    stage = F.when(F.col("__first"), 0).otherwise(F.coalesce(*[F.when(F.col(pool) == name, k) for k, name in enumerate(pools, 1)]))
    queued = frame.join(early, key, "left").withColumn("turn", stage).drop("__first").where(F.col("turn").isNotNull())
    return queued.orderBy("turn", draw(seed, key), key)


def apportioned(groups: DataFrame, name: str, area: str, total: int, least: int = 0, capacity: str | None = None, most_rounds: int = 100) -> DataFrame:
    """Whole shares of ``total`` by area, ``least`` to each and none over its capacity, by largest remainders.

    A round gives each open group the whole part of its share of what is left, or, if all are under one, one each to the
    largest remainders; what capped groups can't take is shared again until all is given out or nobody can take more.
    """
    limit = F.col(capacity).cast("long") if capacity else F.lit(total).cast("long")
    now = groups.select(name, F.col(area).cast("double").alias("__area"), limit.alias("__limit")).withColumn("given", F.least(F.lit(least).cast("long"), F.col("__limit")))
    for _ in range(most_rounds):
        now = cut(now)
        open_ = (F.col("given") < F.col("__limit")) & (F.col("__area") > 0)
        sums = now.agg(F.coalesce(F.sum("given"), F.lit(0)).alias("given"), F.sum(F.when(open_, F.col("__area"))).alias("area")).first()
        rest = total - sums["given"]
        if rest <= 0 or not sums["area"]:
            break
        share = F.when(open_, F.lit(rest) * F.col("__area") / F.lit(sums["area"])).otherwise(0.0)
        whole = F.least(F.floor(share), F.col("__limit") - F.col("given"))
        shared = now.withColumn("__share", share).withColumn("__whole", whole)
        if shared.where("__whole > 0").isEmpty():
            # Under one each: at most ``rest`` groups get one, fewer than there are open ones.
            ones = shared.where(open_).orderBy(F.desc(F.col("__share") % 1), name).limit(rest).select(F.col(name).alias("__name"))
            shared = shared.join(ones, F.col(name).eqNullSafe(F.col("__name")), "left").withColumn("__whole", F.col("__name").isNotNull().cast("long"))
        now = shared.select(name, "__area", "__limit", (F.col("given") + F.col("__whole")).cast("long").alias("given"))
    return now.select(name, "given")


def fold_of(group: str, folds: int, seed: int) -> Column:
    """A group's fold, from its digest, so that a group is never in two."""
    return F.pmod(F.conv(F.substring(draw(seed, group), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def group_folds(frame: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """Each group with its fold."""
    return frame.select(group).distinct().withColumn("fold", fold_of(group, folds, seed))
