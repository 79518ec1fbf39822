"""A queue that stops after enough accepted rows or on a mark, outlives a failing step, and goes on where it stopped."""

import pytest
from pyspark.sql import functions as F

from diptych.streaming import queues

SCHEMA = "id long, kind string"
OUT = f"{SCHEMA}, accepted boolean"


@pytest.fixture
def files(spark, tmp_path):
    """Six files of ten rows, to be read one at a time, in order."""
    for k in range(6):
        rows = [(10 * k + i, "stop" if (k, i) == (4, 0) else "work") for i in range(10)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def even(batch):
    return batch.withColumn("accepted", F.col("id") % 2 == 0)


def test_stops_after_enough_and_goes_on(spark, files, tmp_path):
    first = queues.Queue(spark, str(tmp_path / "q"))
    assert first.run(stream(spark, files), even, most=12)
    assert first.accepted() == 15 and first.results(OUT).count() == 30
    # Another object, as after a restart; the count of before is in the log.
    again = queues.Queue(spark, str(tmp_path / "q"))
    assert again.run(stream(spark, files), even, most=12) and again.accepted() == 15
    assert not again.run(stream(spark, files), even)
    assert sorted(r.id for r in again.results(OUT).collect()) == list(range(60))
    assert not again.run(stream(spark, files), even) and again.results(OUT).count() == 60


def test_a_failing_step_does_not_end_it(spark, files, tmp_path):
    queue = queues.Queue(spark, str(tmp_path / "q"))

    def step(batch):
        if batch.where("id = 23").count():
            raise ValueError("no answer for 23")
        return even(batch)

    assert not queue.run(stream(spark, files), step)
    told = {(r.level, r.message, r.n) for r in queue.log().collect()}
    assert ("error", "no answer for 23", 10) in told and queue.accepted() == 25
    assert sorted(r.id for r in queue.failures(SCHEMA).collect()) == list(range(20, 30))
    assert queue.results(OUT).where("id between 20 and 29").count() == 0


def test_a_mark_stops_it_once(spark, files, tmp_path):
    queue = queues.Queue(spark, str(tmp_path / "q"))
    stop = F.col("kind") == "stop"
    assert queue.run(stream(spark, files), even, stop=stop)
    done = queue.results(OUT).count()
    assert done < 60 and queue.log().where("level = 'stop'").count() == 1
    assert not queue.run(stream(spark, files), even, stop=stop)
    assert queue.results(OUT).count() == 60


def test_nothing_there_yet(spark, tmp_path):
    queue = queues.Queue(spark, str(tmp_path / "q"))
    assert queue.accepted() == 0 and queue.log().collect() == [] and queue.results(OUT).collect() == []
