"""Cutting what is read again in rounds from how it was made."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """The frame as files in spark.checkpoint.dir, which all executors share; only a local session may leave that unset."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "diptych-lineage"))
    return frame.checkpoint()
