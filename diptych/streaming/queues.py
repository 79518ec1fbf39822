"""Streams of events: file sources, windowed counts, first and last records, and retry budgets kept as state."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from diptych.operators.logs import last_of_each

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the session names for checkpoints; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or os.path.join(tempfile.gettempdir(), 'diptych-streams')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """The events as a stream of Parquet files, a bounded number in a batch if asked for."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    only = f"{path[:-1]}[{path[-1]}]"  # a pattern, which may name a file where a plain path must be a folder, and which fits this name alone
    return reader.parquet(only).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, keys: Sequence[str] | None, mode: str = "update") -> DataFrame:
    """Runs the stream over all that is there, and returns what it wrote: the last row of each key, or all rows without keys.

    In complete mode a batch is the whole result and takes the place of the one before.  Else it is written under its number, in place of what an earlier try of it wrote, so a batch that is run again after a
    failure counts once.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        place = "all" if mode == "complete" else number
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={place}")

    started = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    started.awaitTermination()
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("__batch", T.IntegerType())])).parquet(f"{folder}/out")
    written = written.select(*schema.names, "__batch")
    return last_of_each(written, list(keys), ["__batch"]).drop("__batch") if keys else written.drop("__batch")


def tumbling(stream: DataFrame, length: str, late: str) -> DataFrame:
    """Counts and exact sums of each window and kind of event."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's events that are less than ``gap`` apart."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_only(stream: DataFrame, keys: Sequence[str], late: str) -> DataFrame:
    """Each key once, for as long as ``late`` lasts: a record that comes again is dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def retry_machine(stream: DataFrame, key: str, budget: int = 3) -> DataFrame:
    """The state that each key's events leave: errors in a row use up a budget, another event gives it back, a spent one is final.

    Rows of a batch are taken in time order; the state is two numbers a key and kept by Spark.
    """
    out = "key long, state string, errors int, n_events long"

    def advance(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows.event_type:
            n += 1
            if errors < budget:
                errors = errors + 1 if kind == "error" else 0
        state.update((errors, n))
        name = "failed" if errors >= budget else "retrying" if errors else "running"
        yield pd.DataFrame({"key": [keys[0]], "state": [name], "errors": [errors], "n_events": [n]})

    grouped = stream.select(key, "ts", "event_id", "event_type").groupBy(key)
    return grouped.applyInPandasWithState(advance, out, "errors int, n long", "update", GroupStateTimeout.NoTimeout)


_LOG = "batch int, level string, message string, n long"
_ENOUGH = "the queue stops here and goes on from this batch when it is run again"


class Queue:
    """A stream worked off in batches: results, failures and a log of levels, all in one shared folder.

    ``step`` makes of a batch its results, with a boolean ``accepted``.  A step that fails does not end the stream: the batch's
    rows are kept under failures and the log says why.  The stream stops before a batch once ``most`` rows were accepted, or
    rows that ``stop`` holds for have come; run again in the same folder, it goes on with that batch.  A batch that is tried
    again after a crash takes the place of its first try, so results and log have each batch once.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark)

    def _table(self, name: str, schema: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        none = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").select(none.columns) if there else none

    def log(self) -> DataFrame:
        """batch, level (info, error or stop), message and the number of rows that it is about."""
        return self._table("log", _LOG)

    def results(self, schema: str) -> DataFrame:
        return self._table("out", schema)

    def failures(self, schema: str) -> DataFrame:
        return self._table("failed", schema)

    def accepted(self) -> int:
        return self.log().where("level = 'info'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(self, stream: DataFrame, step: Callable[[DataFrame], DataFrame], most: int | None = None, stop: Column | None = None) -> bool:
        """Works off what there is; returns whether it was stopped before the end."""
        # A stop that was asked for in an earlier run has been obeyed by ending it.
        obeyed = self.log().where("level = 'stop'").count()

        def work(batch: DataFrame, number: int) -> None:
            if most is not None and self.accepted() >= most or self.log().where("level = 'stop'").count() > obeyed:
                raise RuntimeError(_ENOUGH)
            place, lines = f"batch={number}", []
            batch = batch.persist()
            try:
                step(batch).write.mode("overwrite").parquet(f"{self.folder}/out/{place}")
                done = self.spark.read.parquet(f"{self.folder}/out/{place}")
                lines.append((number, "info", "accepted", done.where("accepted").count()))
            except Exception as error:  # noqa: BLE001  whatever a step raises is told and does not end the stream
                # Nothing of a failed batch counts, so what it may have written is replaced by no rows.
                batch.limit(0).withColumn("accepted", F.lit(False)).write.mode("overwrite").parquet(f"{self.folder}/out/{place}")
                batch.write.mode("overwrite").parquet(f"{self.folder}/failed/{place}")
                lines.append((number, "error", str(error).splitlines()[0][:500], batch.count()))
            asked = batch.where(stop).count() if stop is not None else 0
            lines += [(number, "stop", "asked for", asked)] if asked else []
            self.spark.createDataFrame(lines, _LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/number={number}")
            batch.unpersist()

        started = stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()
        try:
            started.awaitTermination()
        except StreamingQueryException as error:
            if _ENOUGH not in str(error):
                raise
            return True
        return False
