"""Vectors: cosines, nearest neighbours by blocks of queries, fused features, contrastive and cross-entropy losses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, 0 if one is null throughout."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def fused(a: Column, b: Column) -> Column:
    """Both vectors and the absolute differences between them, end to end."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)))


#: Pairs of blocks that even a small search is dealt into, about.
_UNITS = 64


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 1 << 17, batch: int = 1 << 17) -> DataFrame:
    """The k rows of highest cosine to each query, itself left out, the smaller key first among equal scores: exact.

    Queries and rows are dealt into a grid by hashes of their keys; each pair of a block of queries and one of rows is a task
    of its own, which multiplies them as matrices and keeps k rows for a query.  These are merged by query.  Rows are sent once
    for each block of queries and queries once for each block of rows, so both blocks are as large as a task holds (of 64
    numbers, 131,072 vectors take 70 MB); few queries still get tasks, as rows are dealt finer then.
    """
    n_all = vectors.count()
    n_queries = max(1, -(-queries.count() // block))
    n_rows = max(1, -(-n_all // batch), min(_UNITS // n_queries, -(-n_all // 4096)))
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n)).cast("int")
    asked = queries.select(F.col(key).alias("k"), F.col(vector).alias("v"), place(n_queries, 1).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("r"))
    given = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"), place(n_rows, 2).alias("r"))

    def unit(column: pd.Series) -> np.ndarray:
        out = np.stack(column.to_list()).astype(float)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    def best(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(asked) and len(given):
            rows, keys = unit(given["v"]), given["k"].to_numpy()
            step = max(1, (1 << 22) // len(given))
            for start in range(0, len(asked), step):
                part = asked.iloc[start : start + step]
                scores = np.round(unit(part["v"]) @ rows.T, 12)
                for one, own in zip(part["k"].to_numpy(), scores, strict=True):
                    least = np.partition(own, max(0, len(own) - k - 1))[max(0, len(own) - k - 1)]
                    at = np.flatnonzero((own >= least) & (keys != one))
                    at = at[np.lexsort((keys[at], -own[at]))[:k]]
                    found += [(int(one), int(keys[i]), float(own[i])) for i in at]
        return pd.DataFrame(found, columns=["query", "found", "score"])

    out = asked.groupBy("q", "r").cogroup(given.groupBy("q", "r")).applyInPandas(best, "query long, found long, score double")
    ranked = out.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found")))
    return ranked.where(F.col("place") <= k)


def contrastive_loss(pairs: DataFrame, batch: str, key: str, a: str, b: str, heat: float = 0.07) -> DataFrame:
    """For each batch the mean of both directions' cross entropy, a row's own pair against all others of its batch.

    All of a batch are compared with all; batches are of a fixed size, so this grows with the rows.
    """
    left = pairs.select(batch, F.col(key).alias("i"), F.col(a).alias("u"))
    right = pairs.select(batch, F.col(key).alias("j"), F.col(b).alias("v"))
    sims = left.join(right, batch).select(batch, "i", "j", (cosine(F.col("u"), F.col("v")) / heat).alias("s"))
    rows = sims.groupBy(batch, "i").agg(F.max("s").alias("m"), F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("own"), F.collect_list("s").alias("all"))
    columns = sims.groupBy(batch, F.col("j").alias("i")).agg(F.max("s").alias("m"), F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("own"), F.collect_list("s").alias("all"))
    total = F.log(F.aggregate(F.transform("all", lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda s, v: s + v)) + F.col("m")
    return rows.unionByName(columns).groupBy(batch).agg(F.avg(total - F.col("own")).alias("loss"))


def pooled(frame: DataFrame, group: str, vector: str, mask: Column) -> DataFrame:
    """The mean of each group's vectors for which the mask holds, by place."""
    places = frame.where(mask).select(group, F.posexplode(vector).alias("place", "x"))
    return places.groupBy(group, "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def cross_entropy(frame: DataFrame, scores: Column, target: Column, ignored: int = 0) -> DataFrame:
    """The mean of -log softmax(scores)[target] over the rows whose target is not the ignored one, and how many these are."""
    top = F.array_max(scores)
    total = F.log(F.aggregate(F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double"))), F.lit(0.0), lambda s, v: s + v)) + top.cast("double")
    loss = total - F.get(scores, target).cast("double")
    return frame.where(target != ignored).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


def distance_stats(pairs: DataFrame, group: str, a: str, b: str, far: float) -> DataFrame:
    """n, mean, least, most, p90 and the share over ``far`` of each group's cosine distances, which are kept to four places.

    Four places bound the counts that the exact percentile combines before its shuffle: 20,001 values a group.
    """
    rows = pairs.select(group, F.round(1 - cosine(F.col(a), F.col(b)), 4).alias("d"))
    return rows.groupBy(group).agg(
        F.count("d").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.min("d").alias("least"), F.max("d").alias("most"),
        F.round(F.percentile("d", 0.9), 6).alias("p90"), F.round(F.avg((F.col("d") > far).cast("double")), 6).alias("far_share"),
    )


def token_accuracy(frame: DataFrame, batch: Column, scores: Column, target: Column, ignored: int = 0) -> DataFrame:
    """The mean over batches of each one's share of targets that score highest (the first of equals), without ignored ones."""
    best = F.array_position(scores, F.array_max(scores)) - 1
    rows = frame.where(target != ignored).select(batch.alias("batch"), (best == target).cast("double").alias("hit"))
    batches = rows.groupBy("batch").agg(F.avg("hit").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return batches.agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("batches"), F.sum("n").alias("n"))
