"""Meeting places for hashes: documents are dealt into chunks of bounded size, and what chunks know of a hash meets in buckets.

Operators that compare every word window, shingle or segment of a corpus would shuffle several rows for each word.  Here
a chunk sends one row to each bucket, with the chunk's distinct hashes packed in it, and a bucket answers each chunk in
one row.  A hash that most documents have is sent once by a chunk, so it weighs as much as there are chunks at most.

Rows stay as long as the corpus grows: chunks and buckets are of fixed sizes up to about 100 GB, and beyond that both grow
with the square root of the corpus, so that a row holds ``ROW_BYTES`` or more on average and the number of rows is in
proportion to the corpus.  At 100 TB a chunk has about 230 MB of text, which is what a task then holds.  The text is shuffled
once, to its chunks, and every later pass reads that shuffle again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes in a chunk and packed bytes in a bucket, about and at least; packed bytes that a row has on average at least.
CHUNK_BYTES, BUCKET_BYTES, ROW_BYTES = 8 << 20, 4 << 20, 256

#: A column of the documents while they are dealt; not a name that tables have.
CHUNK = "__chunk_of_the_exchange"
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Sizes:
    chunks: int
    buckets: int


def planned_sizes(total: int, bytes_per_text_byte: float) -> Sizes:
    """Chunks and buckets for ``total`` bytes of text, of which that share is sent.

    Chunks times buckets is the most rows that are sent; with a chunk of c and a bucket of b bytes these hold
    b * c / total bytes each, which c * c / 2 >= ROW_BYTES * total and b >= c / 2 keep from shrinking.
    """
    chunk = max(CHUNK_BYTES, int((2 * total * ROW_BYTES) ** 0.5))
    bucket = max(BUCKET_BYTES, chunk // 2)
    return Sizes(int(total // chunk) + 1, int(total * bytes_per_text_byte // bucket) + 8)


def sizes(documents: DataFrame, bytes_per_text_byte: float) -> Sizes:
    """Chunks and buckets for the corpus, from the sum of its texts' lengths (one pass over that column)."""
    return planned_sizes(documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0, bytes_per_text_byte)


def chunked(documents: DataFrame, n: Sizes) -> DataFrame:
    """The documents with their chunk, by a hash of doc_id and text: one id with many texts, or none, fills no chunk alone."""
    return documents.withColumn(CHUNK, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n.chunks)).cast("int"))


def bucket_of(hashes: np.ndarray, n: Sizes) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(n.buckets)


def short(hashes: np.ndarray, n: Sizes) -> np.ndarray:
    """A hash as its bucket and its lower half: what is left of it when only the lower half is sent."""
    return (bucket_of(hashes, n) << np.uint64(32)) | (hashes & _LOW)


def dealt(n: Sizes, *parts: np.ndarray) -> list[tuple]:
    """Of sorted short hashes: for each bucket that the first part reaches, the bucket and the parts' lower halves, packed."""
    reached = np.unique(parts[0] >> np.uint64(32))
    lows = [np.searchsorted(x, reached << np.uint64(32)) for x in parts]
    highs = [np.searchsorted(x, (reached + np.uint64(1)) << np.uint64(32)) for x in parts]
    halves = [x.astype(np.uint32) for x in parts]
    return [(b, *(pack(x[lo[k] : hi[k]]) for x, lo, hi in zip(halves, lows, highs, strict=True))) for k, b in enumerate(reached.tolist())]


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpack(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in column]


def places(rows: list[int]) -> pa.Array:
    """Rows to take, of a type even if there are none."""
    return pa.array(rows, pa.int64())


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each run of equal ones starts, and where it ends."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.r_[starts[1:], len(keys)]


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def per_chunk(chunks: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return chunks.groupBy(CHUNK).applyInArrow(work, schema)


def per_bucket(sent: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(work, schema)


def answered(chunks: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """The chunks, each with the answers to it (none for many)."""
    return chunks.groupBy(CHUNK).cogroup(answers.groupBy("chunk")).applyInArrow(work, schema)
