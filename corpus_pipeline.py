"""A training corpus from raw documents: five stages, each an operator of diptych.llm at work on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents; the last returns them in training order, a row for each
time that a document is taken, with repeat, words_taken and position.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diptych.llm import decontaminate, jaccard, langid, lines, mixing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by compression; those that are rejected go.

    A null or empty text and one without a letter is rejected.  Equal texts are judged alike, so repeated rows stay or go
    together; a null lang or doc_id only keeps a row out of the sample that is learned from.  Without any labelled row all
    documents are rejected.
    """
    return langid.known_language(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has, within two edits (short lines: exactly).

    A document all of whose words were in such lines goes.  Null and empty texts stay as they are; a null doc_id comes last;
    rows of one doc_id stand in the order of their places alone.
    """
    renamed = docs.select([F.col(f"`{c}`").alias(f"__in_{c}" if c.lower() in lines.ADDED else c) for c in docs.columns])
    out = lines.dedup_lines(renamed, shortest=lines.SHORTEST_CHARS)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(f"`__in_{c}`").alias(c) if c.lower() in lines.ADDED else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by 0.8 of their 5-word shingles.

    Documents without words are in no group and stay; a null doc_id comes last; of equal rows one stays.
    """
    return jaccard.one_of_each(docs, percent=80, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item.

    Null and empty texts have no window and stay, as all do with an empty benchmark; equal texts are judged alike.
    """
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, by their sources' weights over time.

    A document is taken as often as its source's target asks for, so it may come again or not at all; one without words is
    never taken.  A null source is a source, the last one.  Repeated rows are taken each for itself.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix", mix),
]

#: SQL can't express compression, so it can't express the rows of run(); tests compare stages with brute force.
ORACLE_SQL = None


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a new local one only where the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="diptych-pipeline-")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is a table in the shared folder of spark.checkpoint.dir.

    A table is removed when the next one is written; the last, which the result reads, stays.
    """
    folder = f"{_shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
