"""A learned gate: named feature sets, models of pyspark.ml, scores of rows outside of the fold that a model saw."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scoring
from .lineage import cut


def balanced_weights(frame: DataFrame, label: str) -> DataFrame:
    """The rows with ``weight``, which makes both labels weigh as much together."""
    counts = frame.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    totals = frame.agg(F.count(F.lit(1)).alias("__all"))
    return frame.join(F.broadcast(counts), label).join(F.broadcast(totals)).withColumn("weight", F.col("__all") / (2 * F.col("__n"))).drop("__n", "__all")


def logistic(features: Sequence[str], label: str) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="__raw", handleInvalid="keep"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
        LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=25, regParam=0.01),
    ])


def boosted(features: Sequence[str], label: str, rounds: int = 200) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep"),
        GBTClassifier(featuresCol="__x", labelCol=label, weightCol="weight", maxDepth=3, stepSize=0.05, maxIter=rounds, seed=1),
    ])


def out_of_fold(frame: DataFrame, model: Pipeline, fold: str, folds: int, keep: Sequence[str]) -> DataFrame:
    """``keep`` and score of each row, by a model of the other folds; a fold whose others have one label only is left out.

    Models read their rows many times, so the frame is cut from how it was made; what is returned is cut as well.
    """
    label, out = model.getStages()[-1].getLabelCol(), None
    needed = dict.fromkeys([fold, label, *keep, *model.getStages()[0].getInputCols()])
    frame = cut(frame.select(*needed))
    for k in range(folds):
        seen, held = frame.where(F.col(fold) != k), frame.where(F.col(fold) == k)
        if seen.select(label).distinct().count() < 2:
            continue
        scored = model.fit(balanced_weights(seen, label)).transform(held).select(*keep, vector_to_array("probability")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no fold has both labels")
    return cut(out)


@dataclass(frozen=True)
class Gate:
    """A gate to keep: a model of all labelled rows, its features, and the score from which a row passes."""

    name: str
    features: tuple[str, ...]
    threshold: float
    model: PipelineModel

    def apply(self, frame: DataFrame) -> DataFrame:
        """The rows with score and passed; a null feature is one that the model reads as missing (NaN)."""
        known = frame.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"__f_{c}") for c in self.features])
        scored = self.model.transform(known.select(*frame.columns, *[F.col(f"__f_{c}") for c in self.features]))
        return scored.select(*[F.col(f"`{c}`") for c in frame.columns], vector_to_array("probability")[1].alias("score")).withColumn("passed", F.col("score") >= self.threshold)

    def save(self, path: str) -> None:
        """The model and what goes with it, in a folder that replaces any before it."""
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        row = [(self.name, list(self.features), self.threshold)]
        spark.createDataFrame(row, "name string, features array<string>, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{path}/gate")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Gate:
        row = spark.read.parquet(f"{path}/gate").first()
        return cls(row["name"], tuple(row["features"]), row["threshold"], PipelineModel.load(f"{path}/model"))


def fit_gate(frame: DataFrame, sets: Mapping[str, Sequence[str]], kinds: Mapping[str, Callable[[Sequence[str], str], Pipeline]], label: str, fold: str, folds: int, recall: float = 0.9) -> tuple[Gate, list[dict]]:
    """The gate of the feature set and kind of model that order held-out rows best, and a report of all of them.

    Rows of one fold are scored by models of the others.  The best is by average precision (the first of equals); its threshold
    is the one at which these held-out scores keep ``recall`` of the positive rows, and its model is fitted again to all rows.
    A row without a label takes no part; without a positive row that was held out the threshold is 0, and all rows pass.
    """
    # Features are renamed, so that a model's columns never meet those of a table that the gate is applied to.
    known = frame.where(F.col(label).isNotNull())
    every = sorted({c for columns in sets.values() for c in columns})
    rows = cut(known.select(fold, F.col(label).cast("double").alias("__label"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"__f_{c}") for c in every]))
    report, best = [], None
    for name, columns in sets.items():
        for kind, make in kinds.items():
            model = make([f"__f_{c}" for c in columns], "__label")
            scored = out_of_fold(rows, model, fold, folds, ["__label"])
            truth = F.col("__label") == 1
            order = scoring.average_precision(scored, truth, F.col("score")).first()
            at = scoring.recall_threshold(scored, truth, F.col("score"), recall).first()
            report.append({"features": name, "model": kind, "average_precision": order["average_precision"], "threshold": at["threshold"] if at["threshold"] is not None else 0.0, "recall": at["recall"], "kept_share": at["kept_share"]})
            if best is None or order["average_precision"] > best[0]:
                best = (order["average_precision"], f"{kind} on {name}", columns, report[-1]["threshold"], model)
    _, name, columns, threshold, model = best
    return Gate(name, tuple(columns), threshold, model.fit(balanced_weights(rows, "__label"))), report
