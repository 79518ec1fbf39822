"""Small helpers shared by the operators: added columns from Arrow batches, hex digests, the checkpoint folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(frame: DataFrame, added: T.StructType, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """The frame's columns (or ``keep`` of them) and those that ``compute`` makes of each Arrow batch.

    A column of the frame that has the name of an added one (letter case aside) is replaced by it.
    """
    names = {x.lower() for x in added.names}
    kept = [f for f in frame.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    out_names = [f.name for f in kept] + added.names

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = compute(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [made[x] for x in added.names], names=out_names)

    return frame.mapInArrow(batches, T.StructType([T.StructField(f.name, f.dataType) for f in kept] + added.fields))


def hex_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, cut from its lineage through the shared folder that the session names.

    The folder is spark.checkpoint.dir of the session; where it is unset, a local session gets a local folder and any other
    is refused, as executors would not see each other's files.
    """
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "diptych-checkpoints"))
    return frame.checkpoint()
