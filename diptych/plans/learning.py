"""The gate on documents: features of their text, the quality label, folds by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.functions import text
from diptych.operators import images, learning, samples, scoring
from diptych.operators.lineage import cut

from . import images as views
from .catalog import Tables, query

#: Feature sets by name.
FEATURES = {"size": ["n_tokens", "n_chars"], "all": ["n_tokens", "n_chars", "signs", "upper", "distinct_share"]}


def features(t: Tables) -> DataFrame:
    labelled = t.documents.join(t.labels.select("doc_id", (F.col("quality") == 0).cast("double").alias("label")), "doc_id")
    # Words are a step of their own, which the optimizer keeps apart, so a text is cut into words once.
    rows = labelled.select("doc_id", "source", "label", "n_chars", F.length("text").alias("length"), (F.length("text") - F.length(F.translate("text", "#*$%&|<>!", ""))).alias("signs"),
                           F.regexp_count("text", F.lit("[A-Z]")).alias("upper"), text.tokens(F.col("text")).alias("words"))
    rows = rows.withColumns({"n": F.size("words"), "distinct": F.size(F.array_distinct("words"))})
    rows = rows.select(
        "doc_id", "source", F.col("n").cast("double").alias("n_tokens"), F.col("n_chars").cast("double").alias("n_chars"), (F.col("signs") / F.greatest("n", F.lit(1))).alias("signs"),
        (F.col("upper") / F.greatest("length", F.lit(1))).alias("upper"), (F.col("distinct") / F.greatest("n", F.lit(1))).alias("distinct_share"), "label",
    )
    return rows.withColumn("fold", samples.fold_of("source", 3, 5))


def _judged(scored: DataFrame, name: str) -> DataFrame:
    truth = F.col("label") == 1
    precision = scoring.average_precision(scored, truth, F.col("score"))
    at = scoring.recall_threshold(scored, truth, F.col("score"))
    return precision.join(F.broadcast(at)).select(F.lit(name).alias("model"), "average_precision", "recall", "kept_share")


@query()
def gate_logistic(t: Tables) -> DataFrame:
    """Average precision of poor documents, and what a gate of nine tenths' recall keeps, for each feature set."""
    rows = cut(features(t))
    out = None
    for name, columns in FEATURES.items():
        scored = learning.out_of_fold(rows, learning.logistic(columns, "label"), "fold", 3, ["doc_id", "label"])
        part = _judged(scored, name)
        out = part if out is None else out.unionByName(part)
    return out


@query()
def gate_gbt(t: Tables) -> DataFrame:
    scored = learning.out_of_fold(features(t), learning.boosted(FEATURES["all"], "label"), "fold", 3, ["doc_id", "label"])
    return _judged(scored, "boosted")


def image_gate(t: Tables) -> tuple[learning.Gate, list[dict], DataFrame]:
    """A gate on what sets the views of an image apart; suppliers with a high balance stand for labelled changes."""
    found = images.gate_features(views.views(t), "image", views.BEFORE, views.AFTER)
    owner = t.supplier.select(F.col("s_suppkey").alias("image"), F.col("s_nationkey").alias("site"), (F.col("s_acctbal") > 4500).cast("double").alias("label"))
    rows = cut(found.join(owner, "image").withColumn("fold", samples.fold_of("site", 3, 5)))
    gate, report = learning.fit_gate(rows, images.FEATURE_SETS, {"logistic": learning.logistic}, "label", "fold", 3)
    return gate, report, rows


@query()
def gate_applied(t: Tables) -> DataFrame:
    """The best gate of the images' features, fitted to all labels and applied at its held-out threshold."""
    gate, _, rows = image_gate(t)
    return gate.apply(rows.select("image", "site", "label", *gate.features)).select("image", "site", "label", F.round("score", 6).alias("score"), "passed", F.lit(gate.name).alias("gate"))
