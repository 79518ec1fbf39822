"""Kernels over pixel tables (image, y, x, band values), as aggregations where one will do and grouped arrays where not."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .images import brightness_fit, in_place
from .images import labels as connected


def changed_share(pixels: DataFrame, image: str, before: Column, after: Column, least: float = 40.0) -> DataFrame:
    """For each image the mean absolute difference, the share of pixels over ``least``, and whether it reaches a twentieth."""
    gap = F.abs(after - before)
    out = pixels.groupBy(image).agg(F.avg(gap).alias("mean_gap"), F.avg(F.when(gap > least, 1.0).otherwise(0.0)).alias("share"))
    return out.withColumn("changed", F.col("share") >= 0.05)


def stretch(pixels: DataFrame, image: str, values: list[str], low: float, high: float) -> DataFrame:
    """Values scaled to 0 .. 255 between two percentiles of all of an image's values together, zeros not counted."""
    long = pixels.select(image, F.explode(F.array(*values)).alias("v")).where("v > 0")
    ends = long.groupBy(image).agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("q"))
    scaled = [F.least(F.greatest((F.col(v) - F.col("q")[0]) * 255 / F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-9)), F.lit(0.0)), F.lit(255.0)).alias(v) for v in values]
    return pixels.join(ends, image).select(*[c for c in pixels.columns if c not in values], *scaled)


def fitted_line(pixels: DataFrame, image: str, x: str, y: str) -> DataFrame:
    """The least-squares line of y on x for each image, its gain held within a half and two."""
    out = pixels.groupBy(image).agg(F.regr_slope(y, x).alias("__s"), F.avg(x).alias("__x"), F.avg(y).alias("__y"), F.corr(x, y).alias("r"))
    gain = F.least(F.greatest(F.coalesce("__s", F.lit(1.0)), F.lit(0.5)), F.lit(2.0))
    return out.select(image, gain.alias("gain"), (F.col("__y") - gain * F.col("__x")).alias("offset"), "r")


def trimmed_line(pixels: DataFrame, image: str, x: str, y: str, rounds: int = 3, keep: float = 40.0, least: int = 100) -> DataFrame:
    """As fitted_line, fitted again to the pixels of the smallest residuals; an image of pixels is one group.

    An image of fewer than ``least`` pixels keeps the line y = x, and one whose smallest residuals are fewer the line before.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        gain, offset, used = brightness_fit(group[x].to_numpy(float), group[y].to_numpy(float), rounds, keep, least)
        return pd.DataFrame({image: [group[image].iloc[0]], "gain": [gain], "offset": [offset], "n_used": [used]})

    return pixels.select(image, x, y).groupBy(image).applyInPandas(fit, f"{image} {dict(pixels.dtypes)[image]}, gain double, offset double, n_used long")


def blurred(pixels: DataFrame, image: str, value: str, reach: int = 1, placed: bool = False) -> DataFrame:
    """Each pixel's mean over the box around it: a pixel is sent to the places whose box holds it, and those are summed.

    Places are summed where their image lies (``placed``: images are ``in_place`` already), and a place counts the pixels that
    are its own, so none is joined.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    rows = (pixels if placed else in_place(pixels, image)).where(F.col(image).isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull())
    sent = rows.withColumn("__dy", F.explode(steps)).withColumn("__dx", F.explode(steps))
    sent = sent.select(image, (F.col("y") + F.col("__dy")).alias("y"), (F.col("x") + F.col("__dx")).alias("x"), value, ((F.col("__dy") == 0) & (F.col("__dx") == 0)).cast("int").alias("__own"))
    sums = sent.groupBy(image, "y", "x").agg(F.avg(value).alias("blurred"), F.sum("__own").alias("__own")).where("__own > 0")
    return sums.withColumn("__own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__own")))).drop("__own")


def transitions(pixels: DataFrame, image: str, before: str, after: str, classes: int = 6) -> DataFrame:
    """For each image and pair of classes the code 1 + from * classes + to, its pixels, and their share in per cent."""
    counted = pixels.groupBy(image, before, after).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(image))
    return counted.select(image, (1 + F.col(before) * classes + F.col(after)).cast("int").alias("code"), "n", F.round(100 * F.col("n") / total, 4).alias("percent"))


def regions(pixels: DataFrame, image: str, score: str, least: float, smallest: int = 1, diagonal: bool = False) -> DataFrame:
    """Connected pixels over ``least``: their box, size and mean score, for regions of ``smallest`` pixels or more; an image is one group."""

    def find(group: pd.DataFrame) -> pd.DataFrame:
        y, x = group.y.to_numpy(), group.x.to_numpy()
        grid = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), -np.inf)
        grid[y - y.min(), x - x.min()] = group[score]
        found = connected(grid > least, diagonal)[y - y.min(), x - x.min()]
        found = group.assign(label=found)[found > 0].groupby("label").agg(x0=("x", "min"), y0=("y", "min"), x1=("x", "max"), y1=("y", "max"), pixels=("x", "size"), score=(score, "mean"))
        found = found[found.pixels >= smallest].reset_index(drop=True)
        return found.assign(**{image: group[image].iloc[0], "score": found.score.round(6)})[[image, "x0", "y0", "x1", "y1", "pixels", "score"]]

    kind = dict(pixels.dtypes)[image]
    return pixels.select(image, "y", "x", score).groupBy(image).applyInPandas(find, f"{image} {kind}, x0 long, y0 long, x1 long, y1 long, pixels long, score double")


def shift(pixels: DataFrame, image: str, before: str, after: str) -> DataFrame:
    """How far the second view of each image is moved, in pixels, by phase correlation of gradients with a parabolic peak."""

    def gradient(a: np.ndarray) -> np.ndarray:
        gy, gx = np.gradient(a)
        window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
        return np.hypot(gx, gy) * window

    def find(group: pd.DataFrame) -> pd.DataFrame:
        y, x = group.y.to_numpy() - group.y.min(), group.x.to_numpy() - group.x.min()
        views = []
        for c in (before, after):
            grid = np.zeros((y.max() + 1, x.max() + 1))
            grid[y, x] = group[c]
            views.append(grid)
        moved = [0.0, 0.0]
        if min(views[0].shape) >= 4:
            cross = np.fft.fft2(gradient(views[0])).conj() * np.fft.fft2(gradient(views[1]))
            peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
            at = np.unravel_index(int(peak.argmax()), peak.shape)
            for axis in (0, 1):
                n = peak.shape[axis]
                line = [peak[tuple((at[k] + d * (k == axis)) % peak.shape[k] for k in (0, 1))] for d in (-1, 0, 1)]
                bend = line[0] - 2 * line[1] + line[2]
                value = at[axis] + (0.5 * (line[0] - line[2]) / bend if bend else 0.0)
                moved[axis] = float(value - n if value > n / 2 else value)
        return pd.DataFrame({image: [group[image].iloc[0]], "dy": [round(moved[0], 6)], "dx": [round(moved[1], 6)]})

    return pixels.select(image, "y", "x", before, after).groupBy(image).applyInPandas(find, f"{image} {dict(pixels.dtypes)[image]}, dy double, dx double")
