"""Keyed logs: last writes, work left to do, queues, claims, and tables kept by folding events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key, by aggregation, so that a key of many records is combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def left_to_do(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose key is not among those done."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def queue(jobs: DataFrame, status: str, statuses: Sequence[str], order: str, keys: DataFrame | None = None, key: str = "key", conditions: Sequence[Column] = (), most: int | None = None) -> DataFrame:
    """Jobs of the statuses that pass every condition and key list, in order; the limit comes last."""
    out = jobs.where(F.col(status).isin(list(statuses)))
    for c in conditions:
        out = out.where(c)
    if keys is not None:
        out = out.join(keys.select(key).distinct(), key, "left_semi")
    out = out.orderBy(order)
    return out if most is None else out.limit(most)


def first_claims(claims: DataFrame, item: str, owner: str, order: Sequence[str]) -> DataFrame:
    """Each claim with who owns the item: the first to claim it, ties by owner."""
    owners = claims.groupBy(item).agg(F.min_by(owner, F.struct(*order, owner)).alias("owned_by"))
    return claims.join(owners, item).withColumn("is_owner", F.col(owner) == F.col("owned_by"))


def seeded(old: DataFrame, new: DataFrame, key: str, described: Sequence[str], state: str, start: str) -> DataFrame:
    """The table after seeding: new keys begin in state ``start``; known ones keep it and take the new description."""
    a, b = old.alias("a"), new.alias("b")
    columns = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    columns += [F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in described]
    columns += [F.coalesce(F.col(f"a.{state}"), F.lit(start)).alias(state), F.col(f"a.{key}").isNull().alias("added")]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def folded(events: DataFrame, key: str, kind: str, time: Sequence[str], start: str, drop: str) -> DataFrame:
    """The state that each key's events leave: its last kind, how often it was started, and none if it was dropped after all else."""
    out = events.groupBy(key).agg(
        F.max_by(kind, F.struct(*time)).alias("state"),
        F.count_if(F.col(kind) == start).alias("attempts"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return out.where(F.col("state") != drop)


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the columns of ``changes`` (a row a key) put in: new columns are added, and nulls keep what there was.

    Changes of keys that the table lacks are left out.
    """
    new = [c for c in changes.columns if c != key]
    joined = table.alias("t").join(changes.alias("c"), key, "left")
    old = [F.coalesce(F.col(f"c.{c}"), F.col(f"t.{c}")).alias(c) if c in new else F.col(f"t.{c}") for c in table.columns if c != key]
    return joined.select(key, *old, *[F.col(f"c.{c}") for c in new if c not in table.columns])


def requeued(jobs: DataFrame, status: str, back: dict[str, str]) -> DataFrame:
    """Jobs as a restart takes them up: interrupted states go back to those they began from, with requeued."""
    at = F.col(status)
    again = F.coalesce(*[F.when(at == interrupted, start) for interrupted, start in back.items()], at)
    return jobs.withColumns({"requeued": F.coalesce(at.isin(list(back)), F.lit(False)), status: again})


def numbered(kept: DataFrame, order: Sequence[str], already: int, by: str | None = None) -> DataFrame:
    """Gap-free numbers that go on after ``already``, counted in two levels: within parts, and over the parts' sizes.

    ``by`` is a column that cuts the order into consecutive parts of bounded size; without it the whole is one part.
    """
    if by is None:
        return kept.withColumn("number", F.lit(already) + F.row_number().over(Window.orderBy(*order)))
    sizes = kept.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    ranked = kept.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.join(before, by).withColumn("number", F.lit(already) + F.col("__before") + F.col("__rank")).drop("__before", "__rank")


def within_budget(frame: DataFrame, cost: Column, order: Sequence[str], cap: float, by: str) -> DataFrame:
    """Rows in order for as long as what was spent before is under the cap, with spent (this row's cost included).

    Running sums are taken within parts (``by`` cuts the order into consecutive ones) and over the parts' sums.
    """
    rows = frame.withColumn("__cost", cost)
    sums = rows.groupBy(by).agg(F.sum("__cost").alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    run = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(before, by).withColumn("spent", F.col("__before") + F.sum("__cost").over(run))
    return rows.where(F.col("spent") - F.col("__cost") < cap).drop("__cost", "__before")


def stale(work: DataFrame, cache: DataFrame, key: str, changed: str, made: str, version: str, now: int | str) -> DataFrame:
    """Work that the cache (key, ``made``, ``version``) lacks, or has of another version or from before the work ``changed``.

    Adds why: missing, version or older.  A key that was cached several times counts with its last; one whose time of change
    is not known is taken as unchanged.
    """
    last = last_of_each(cache.select(key, made, version), [key], [made]).select(key, F.col(made).alias("__made"), F.col(version).alias("__version"))
    why = F.when(F.col("__made").isNull(), "missing").when(~F.col("__version").eqNullSafe(F.lit(now)), "version").when(F.col(changed) > F.col("__made"), "older")
    return work.join(last, key, "left").withColumn("why", why).where("why IS NOT NULL").drop("__made", "__version")


def run_table(log: DataFrame, key: str, kind: str, time: str, begins: str, ends: str, done: str, by: str | None = None) -> DataFrame:
    """A row for each run that the log tells of: run_id, from 1 in the order of their beginnings, its key, began, ended, processed.

    A run begins with its key's first record of kind ``begins``; its last of kind ``ends`` closes it, and records of kind
    ``done`` between are what it processed.  One that did not end has a null; records of runs that never began are left out.
    ``by`` names a column (of the beginning) that cuts the order into parts, as in ``numbered``.
    """
    began = log.where(F.col(kind) == begins).groupBy(key).agg(F.min(time).alias("began"))
    rest = log.where(F.col(kind).isin(ends, done)).join(began, key).where(F.col(time) >= F.col("began"))
    ended = rest.groupBy(key).agg(F.max(F.when(F.col(kind) == ends, F.col(time))).alias("ended"))
    counted = rest.join(ended, key).where((F.col(kind) == done) & (F.col("ended").isNull() | (F.col(time) <= F.col("ended")))).groupBy(key).agg(F.count(F.lit(1)).alias("processed"))
    runs = began.join(ended, key, "left").join(counted, key, "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    if by is not None:
        runs = runs.withColumn("__part", F.expr(by))
    out = numbered(runs, ["began", key], 0, by=None if by is None else "__part")
    return out.select(F.col("number").alias("run_id"), key, "began", "ended", "processed")
