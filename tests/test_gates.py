"""Both gate queries on the smallest tables, with the models they are meant to have."""

import pytest

from diptych import registry
from diptych.operators import learning


@pytest.mark.parametrize(("name", "steps", "models"), [("gate_logistic", 25, {"size", "all"}), ("gate_gbt", 200, {"boosted"})])
def test_gate(spark, folder, monkeypatch, name, steps, models):
    seen, judge = [], learning.out_of_fold
    monkeypatch.setattr(learning, "out_of_fold", lambda rows, model, *rest: seen.append(model.getStages()[-1].getMaxIter()) or judge(rows, model, *rest))
    found = registry.queries()[name](spark, folder).collect()
    assert seen == [steps] * len(models)
    assert {r.model for r in found} == models
    assert all(0 < r.average_precision <= 1 and 0.9 <= r.recall <= 1 and 0 <= r.kept_share <= 1 for r in found)


def test_rows_of_a_gate_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(90).selectExpr("id", "CAST(id % 3 AS INT) AS fold", "CAST(id % 5 = 0 AS DOUBLE) AS label", "CAST(id % 7 AS DOUBLE) AS x")
    rows = rows.mapInPandas(make, rows.schema)
    scored = learning.out_of_fold(rows, learning.logistic(["x"], "label"), "fold", 3, ["id", "label"])
    assert scored.count() == 90 and scored.where("score > 0").count() == 90
    assert made.value == 90, "models and judges read what was made, and do not make it again"
