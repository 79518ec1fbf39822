"""Scores of decisions against labels: confusion counts, rule tables with Wilson intervals, thresholds, average precision."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k of n, nulls for none."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(centre - half, F.lit(0.0))), F.when(n > 0, F.least(centre + half, F.lit(1.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for a b of 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(frame: DataFrame, truth: Column, said: Column, excluded: Column, parsed: Column) -> DataFrame:
    """One row of counts and rates; rows that are excluded or not parsed are counted apart."""
    rows = frame.select(truth.alias("y"), said.alias("p"), excluded.alias("skip"), parsed.alias("ok"))
    used = ~F.col("skip") & F.col("ok")
    y, p = F.col("y"), F.col("p")
    c = rows.agg(
        F.count_if(used & y & p).alias("tp"), F.count_if(used & ~y & p).alias("fp"), F.count_if(used & ~y & ~p).alias("tn"), F.count_if(used & y & ~p).alias("fn"),
        F.count_if(F.col("skip")).alias("n_excluded"), F.count_if(~F.col("skip") & ~F.col("ok")).alias("n_unparsed"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rates = {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "false_reject": ratio(fp, fp + tn)}
    return c.select("*", *[F.round(v, 6).alias(k) for k, v in rates.items()])


def rules(frame: DataFrame, truth: Column, table: Mapping[str, Column]) -> DataFrame:
    """For each named rule the flagged rows, recall and precision with their intervals, and false alarms, in one pass."""
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(rule, F.lit(False)).alias("flag")) for name, rule in table.items()])
    counted = frame.select(truth.alias("y"), F.explode(pairs).alias("r")).groupBy("r.rule").agg(
        F.count_if(F.col("r.flag")).alias("flagged"), F.count_if(F.col("y")).alias("positive"), F.count_if(F.col("y") & F.col("r.flag")).alias("found"), F.count_if(~F.col("y") & F.col("r.flag")).alias("alarms"), F.count_if(~F.col("y")).alias("negative"),
    )
    out = [F.col("rule"), F.col("flagged"), F.col("found"), F.col("alarms")]
    for name, k, n in (("recall", "found", "positive"), ("precision", "found", "flagged"), ("alarm_rate", "alarms", "negative")):
        low, high = wilson(F.col(k), F.col(n))
        out += [F.round(ratio(F.col(k), F.col(n)), 6).alias(name), F.round(low, 6).alias(f"{name}_low"), F.round(high, 6).alias(f"{name}_high")]
    return counted.select(*out)


def _ordered_sums(scored: DataFrame, score: str, parts: int = 256) -> DataFrame:
    """Distinct scores with the positives and rows at or over each; sums within ranges of scores, and over the ranges.

    Ranges lie between quantiles of the distinct scores, so each has about as many whatever the scores are.
    """
    points = scored.groupBy(score).agg(F.count_if(F.col("y")).alias("pos"), F.count(F.lit(1)).alias("n"))
    cuts = points.agg(F.percentile_approx(score, [k / parts for k in range(1, parts)], 10_000).alias("__cuts"))
    points = points.join(F.broadcast(cuts)).withColumn("__part", F.size(F.filter("__cuts", lambda c: c <= F.col(score)))).drop("__cuts")  # one row
    sums = points.groupBy("__part").agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))
    after = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("p").over(after), F.lit(0)).alias("__p"), F.coalesce(F.sum("m").over(after), F.lit(0)).alias("__m"))
    run = Window.partitionBy("__part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.join(sums, "__part").select(score, "pos", (F.col("__p") + F.sum("pos").over(run)).alias("tp"), (F.col("__m") + F.sum("n").over(run)).alias("flagged"))


def average_precision(frame: DataFrame, truth: Column, score: Column) -> DataFrame:
    """The mean of the precision at each score, weighted by the positives that have it; equal scores are one step."""
    scored = frame.select(truth.alias("y"), score.alias("score"))
    points = _ordered_sums(scored, "score")
    total = F.sum("pos")
    return points.agg(F.round(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("flagged")), total), 6).alias("average_precision"), total.alias("positives"))


def recall_threshold(frame: DataFrame, truth: Column, score: Column, recall: float = 0.9) -> DataFrame:
    """The largest threshold that keeps all but floor((1 - recall) * positives) of the positives, what it keeps, and its recall."""
    scored = frame.select(truth.alias("y"), score.alias("score"))
    points = _ordered_sums(scored, "score")
    totals = points.agg(F.sum("pos").alias("positives"), F.max("flagged").alias("n"))
    wanted = F.col("positives") - F.floor(F.round(F.col("positives") * (1 - recall), 9))
    first = points.where("pos > 0").join(F.broadcast(totals)).where(F.col("tp") >= wanted)
    best = first.agg(F.max(F.struct("score", "tp", "flagged", "positives", "n")).alias("x")).select("x.*")
    return best.select(F.col("score").alias("threshold"), F.round(ratio(F.col("tp"), F.col("positives")), 6).alias("recall"), F.round(F.col("flagged") / F.col("n"), 6).alias("kept_share"))


def collapse(predictions: DataFrame, run: str, changed: Column, says_none: Column, caption: Column) -> DataFrame:
    """Whether a run's captions collapse: n, the share of changed pairs that are said not to differ, and distinct captions."""
    rows = predictions.select(run, changed.alias("changed"), says_none.alias("none"), F.md5(caption).alias("caption"))
    share = F.try_divide(F.count_if(F.col("changed") & F.col("none")), F.count_if("changed"))
    return rows.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("missed_share"), F.count_distinct("caption").alias("captions"))
