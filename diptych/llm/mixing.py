"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule, linear between knots over training time 0..1.  A schedule's integral, scaled to the
source's target, is its cumulative token demand; inverting it at the tokens that come before a document gives the
document's training position.  Documents of all sources are then range-sorted by position.

Everything per document is a column expression.  Tokens before a document are a running sum within its source, in the order
of an md5 digest of doc_id and size.  It is built in two levels, so that one source may hold most rows: the first digits of
the digest deal a source into buckets of about ``BUCKET_ROWS`` rows, the buckets' sums are accumulated in a small table, and
documents are only ordered within a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpointed

#: Documents of a bucket, about; the number of buckets grows with the table.
BUCKET_ROWS = 20_000
#: Sources are put in order in one place, so a table of more is refused.
MOST_SOURCES = 5_000_000

#: (time, weight) knots by source class; a class is a source's weight.  Each averages 1 over time, so that the schedule
#: moves a source's tokens in time and the target fixes how many there are.
SCHEDULES: dict[int, tuple[tuple[float, float], ...]] = {
    1: ((0.0, 1.5), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}


def n_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009..U+000D; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """From source and source_size: weight, cum (targets before, by source order) and target of each source.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...  They share the sum of all sizes by weight, none over ``cap``
    times its own size; what is over is shared again among the others.  The fixed point has the form
    min(cap * size, level * weight): with the sources in the order of cap * size / weight, a source is full exactly when
    those before it are and the level that the rest would then get reaches its ratio, so the level comes from running sums.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    out = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("int"))
    limit = F.lit(float(cap)) * F.col("source_size")
    by_ratio = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    out = out.withColumn("__total", F.sum("source_size").over(everyone)).withColumn("__weights", F.sum("weight").over(everyone))
    out = out.withColumn("__full", F.coalesce(F.sum(limit).over(by_ratio), F.lit(0.0))).withColumn("__past", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    level = (F.col("__total") - F.col("__full")) / (F.col("__weights") - F.col("__past"))
    out = out.withColumn("__level", level).withColumn("__is_full", limit <= level * F.col("weight"))
    # The level of the first source that is not full holds for all after it.
    shared = F.min(F.when(~F.col("__is_full"), F.struct((limit / F.col("weight")).alias("r"), F.col("__level").alias("level")))).over(everyone)
    return out.select("source", "source_size", "weight", F.when(F.col("__is_full"), limit).otherwise(F.least(limit, shared["level"] * F.col("weight"))).cast("double").alias("target"))


def demand_share(schedule: Sequence[tuple[float, float]], time: float) -> float:
    """The share of a source's tokens that its schedule asks for up to ``time``."""
    areas = [0.0]
    for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
        areas.append(areas[-1] + (u - t) * (w + v) / 2)
    done = 0.0
    for k, ((t, w), (u, v)) in enumerate(zip(schedule, schedule[1:], strict=False)):
        if time >= t:
            x = min(time, u) - t
            done = areas[k] + w * x + (v - w) / (u - t) * x * x / 2
    return done / areas[-1]


def position(schedule: Sequence[tuple[float, float]], share: Column) -> Column:
    """The training time 0..1 at which the schedule has asked for ``share`` of its tokens: demand_share inverted.

    Within a piece the demand is a quadratic of time; its root is taken in the form that also holds for a level piece.
    """
    areas = [0.0]
    for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
        areas.append(areas[-1] + (u - t) * (w + v) / 2)
    out = F.lit(float(schedule[-1][0]))
    for k in range(len(schedule) - 2, -1, -1):
        (t, w), (u, v) = schedule[k], schedule[k + 1]
        rest = F.greatest(share * areas[-1] - areas[k], F.lit(0.0))
        slope = (v - w) / (u - t)
        root = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + 2 * slope * rest, F.lit(0.0)))
        out = F.when(share * areas[-1] <= areas[k + 1], t + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0))).otherwise(out)
    return out


def _digest(seed: int) -> Column:
    """The order of documents within their source: hexadecimal digits that SQL can make, too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))


def planned(documents: DataFrame, cap: float = 3.0, seed: int = 7, schedules: dict[int, tuple[tuple[float, float], ...]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The documents with size, source_size, target, taken, position, weight and before (words of the source's documents before it).

    A source's documents stand in the order of an md5 digest of seed, doc_id and size; the mix goes through them from the
    start, again if the target is over the source's size, and cuts the document at which the target is reached.  taken is
    the words it takes of a document, repeats counted, so a source's sum is its target rounded; position is the training
    time at which it first comes to the document (null if it takes nothing).  Null and empty texts have size 0 and are
    never taken; a null doc_id is digested as an empty one; repeated rows count each, and ties of the digest are of rows
    equal in id and size, which are alike.  Columns of the input (or ``keep`` of them) stay, but for those named as an added one.
    """
    schedules = schedules or SCHEDULES
    added = ("size", "source_size", "target", "taken", "position", "weight", "before")
    wanted = [c for c in (documents.columns if keep is None else keep) if c.lower() not in added]
    # What is needed goes under names of this function's own, so that none of the input's can clash.
    own = [F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(wanted)]
    docs = documents.select(*own, F.col("doc_id"), F.col("source").alias("of"), n_words(F.col("text")).alias("size")).withColumn("digest", _digest(seed))
    digits, rows = 1, documents.count()
    while rows > BUCKET_ROWS * 16**digits and digits < 12:
        digits += 1
    docs = docs.withColumn("bucket", F.substring("digest", 1, digits))
    if "text" not in wanted:
        docs = checkpointed(docs)
    sums = docs.groupBy("of", "bucket").agg(F.sum("size").alias("in_bucket"))
    sizes = sums.groupBy(F.col("of").alias("source")).agg(F.sum("in_bucket").alias("source_size"))
    if (n_sources := sizes.count()) > MOST_SOURCES:
        raise ValueError(f"{n_sources} sources; at most {MOST_SOURCES} can be put in order")
    totals = targets(sizes, cap).withColumnRenamed("source", "named")
    within = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("in_bucket").over(within), F.lit(0))).drop("in_bucket")
    starts = sums.join(totals, F.col("of").eqNullSafe(F.col("named"))).drop("named").withColumnRenamed("of", "named").withColumnRenamed("bucket", "named_bucket")
    joined = docs.join(starts, F.col("of").eqNullSafe(F.col("named")) & (F.col("bucket") == F.col("named_bucket")))
    run = Window.partitionBy("of", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn("before", F.col("bucket_start") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    goal = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    last = F.least(F.greatest(goal - full * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    out = out.withColumn("taken", (full * F.col("size") + last).cast("long"))
    share = F.when(F.col("target") > 0, F.col("before") / F.col("target")).otherwise(0.0)
    out = out.withColumn("position", F.when(F.col("taken") > 0, _by_class(schedules, share)))
    return out.select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(wanted)], *added)


def _by_class(schedules: dict[int, tuple[tuple[float, float], ...]], share: Column) -> Column:
    out = None
    for weight, schedule in schedules.items():
        here = F.col("weight") == weight
        out = F.when(here, position(schedule, share)) if out is None else out.when(here, position(schedule, share))
    return out.otherwise(share)


def mix(documents: DataFrame, cap: float = 3.0, seed: int = 7, schedules: dict[int, tuple[tuple[float, float], ...]] | None = None) -> DataFrame:
    """The training order: a row for each time that a document is taken, range-sorted by position.

    Columns: the documents' own, then repeat (0 for the first time), words_taken (less than the size only where the
    source's target is reached within the document) and position.  Columns of these names are replaced.
    """
    schedules = schedules or SCHEDULES
    names = [c for c in documents.columns if c.lower() not in {"repeat", "words_taken", "position"}]
    # The plan's own columns may have names of the input's, so the input's are renamed for it.
    renamed = documents.select(*[F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(names)], "doc_id", "source", "text")
    plan = planned(renamed, cap, seed, schedules, [f"kept_{k}" for k in range(len(names))])
    rows = plan.where("taken > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))))
    rows = rows.withColumn("words_taken", F.least(F.col("size"), F.col("taken") - F.col("repeat") * F.col("size")).cast("long"))
    share = (F.col("repeat") * F.col("source_size") + F.col("before")) / F.col("target")
    rows = rows.withColumn("position", _by_class(schedules, share))
    doc_id = f"kept_{names.index('doc_id')}"
    rows = rows.repartitionByRange("position", doc_id).sortWithinPartitions("position", doc_id, "repeat")
    return rows.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(names)], "repeat", "words_taken", "position")


def in_order(plan: DataFrame) -> DataFrame:
    """A plan's documents, range-sorted by the position at which the mix first comes to them; those it never takes come first."""
    return plan.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
