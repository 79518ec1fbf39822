"""Benchmark decontamination: a broadcast hash set of the test items' word windows, probed by every window of the documents.

Words are runs of digits, lower-case ASCII letters and non-ASCII code points after A-Z are lowered.  An item's windows
are its runs of ``window`` words; an item of fewer words is one window.  Hashes only find hits: each is compared word by
word with the item's text before it counts.

The set is broadcast in blocks of at most ``block`` windows (a proven bound, whatever the benchmark's size).  A benchmark
within one block takes one scan; a larger one takes a scan for each block, whose hits are then merged by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_columns, hex_digest
from .words import ALNUM, Words, slices, words_of

#: Windows in a broadcast block: 12 bytes of arrays and about 200 of text each, some 100 MB at most.
BLOCK = 400_000

_ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_ranges", T.ArrayType(T.IntegerType())),
])


@dataclass
class Block:
    """Windows of one length group: sorted hashes, their words, and the items that have them."""

    size: int
    hashes: np.ndarray
    text: list[bytes]
    items: list[tuple[str, ...]]
    maybe: np.ndarray


def _joined(words: Words, i: int, n: int) -> bytes:
    return b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[i : i + n], words.ends[i : i + n], strict=True))


def benchmark_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """size, hash, words, item for each distinct window of each item; rows without a text or a word give none.

    A row without an id has windows, but no item: they hit words and are counted as no item.
    """
    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("item", T.StringType())])

    def make(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, j, data, offsets in slices(batch.column(1)):
                words = words_of(data, offsets, ALNUM, lower=True)
                for row in range(i, j):
                    a, b = words.first[row - i], words.first[row - i + 1]
                    n = min(window, int(b - a))
                    if n:
                        hashes = words.windows(n)[0]
                        out += {(n, int(hashes[k].view(np.int64)), _joined(words, k, n), ids[row]) for k in range(a, b - n + 1)}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.string()))], names=schema.names)

    return benchmark.where("text is not null").select(F.col("item_id").cast("string"), "text").mapInArrow(make, schema)


def _blocks(rows: list) -> list[Block]:
    out = []
    for size in sorted({r["size"] for r in rows}):
        mine = sorted((r for r in rows if r["size"] == size), key=lambda r: np.int64(r["hash"]).view(np.uint64))
        hashes = np.array([r["hash"] for r in mine], np.int64).view(np.uint64)
        maybe = np.zeros(1 << 20, bool)
        maybe[hashes >> np.uint64(44)] = True
        out.append(Block(size, hashes, [bytes(r["words"]) for r in mine], [tuple(r["items"]) for r in mine], maybe))
    return out


def _hits(words: Words, blocks: list[Block], keep_ranges: bool) -> tuple[np.ndarray, list[list[str]], list[list[int]]]:
    """Of each text: words inside an occurring window, the items with one, and the runs of such words as from, to, ..."""
    n_docs, n = len(words.first) - 1, len(words.hashes)
    edge = np.zeros(n + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(n_docs)]
    for block in blocks:
        hashes, whole = words.windows(block.size)
        at = np.flatnonzero(whole & block.maybe[hashes >> np.uint64(44)])
        if not len(at):
            continue
        lo, hi = np.searchsorted(block.hashes, hashes[at]), np.searchsorted(block.hashes, hashes[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        owner = np.searchsorted(words.first, at, "right") - 1
        for p, a, b, d in zip(at.tolist(), lo.tolist(), hi.tolist(), owner.tolist(), strict=True):
            text = _joined(words, p, block.size)
            for k in range(a, b):
                if block.text[k] == text:
                    items[d].update(block.items[k])
                    edge[p] += 1
                    edge[p + block.size] -= 1
    hit = np.cumsum(edge)[:n] > 0
    counts = np.add.reduceat(np.r_[hit, False].astype(np.int64), np.minimum(words.first[:-1], n)) if n_docs else np.zeros(0, np.int64)
    counts[words.counts() == 0] = 0
    ranges: list[list[int]] = [[] for _ in range(n_docs)]
    if keep_ranges:
        for d in np.flatnonzero(counts):
            a, b = words.first[d], words.first[d + 1]
            step = np.diff(np.r_[0, hit[a:b].astype(np.int8), 0])
            ranges[d] = np.flatnonzero(step).tolist()
    return counts, [sorted(x) for x in items], ranges


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """The documents with n_words, n_hit, items (those with an occurring window, sorted as strings) and hit_ranges.

    hit_ranges holds the runs of hit words as from, to, from, to, ... (word positions, the end outside).  A null text has
    no words and no hits; an empty benchmark hits nothing; repeated rows are judged alike.  Columns of the documents are
    kept (or ``keep`` of them); one with the name of an added column is replaced.
    """
    found = benchmark_windows(benchmark, window).groupBy("size", "hash", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    total = found.count()
    context = documents.sparkSession.sparkContext
    parts = [found] if total <= block else [found.where(F.pmod(F.xxhash64("hash"), F.lit(-(-total // (block // 2)))) == k) for k in range(-(-total // (block // 2)))]

    def scan(frame: DataFrame, part: DataFrame, columns: list[str] | None) -> DataFrame:
        held = context.broadcast(_blocks(part.collect()))

        def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            n_words, n_hit, items, ranges = [], [], [], []
            for _, _, data, offsets in slices(batch.column("text")):
                words = words_of(data, offsets, ALNUM, lower=True)
                counts, found_items, found_ranges = _hits(words, held.value, True)
                n_words.append(words.counts())
                n_hit.append(counts)
                items += found_items
                ranges += found_ranges
            both = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n_words, n_hit)]
            return {"n_words": both[0], "n_hit": both[1], "items": pa.array(items, pa.list_(pa.string())), "hit_ranges": pa.array(ranges, pa.list_(pa.int32()))}

        return add_columns(frame, _ADDED, compute, columns)

    first = scan(documents, parts[0], keep)
    if len(parts) == 1:
        return first
    key = documents.select("doc_id", "text").withColumn("__text_of_blocks", F.sha2("text", 256)).dropDuplicates(["doc_id", "__text_of_blocks"])
    hits = [scan(key, p, ["doc_id", "__text_of_blocks"]).where("n_hit > 0").select("doc_id", "__text_of_blocks", "items", "hit_ranges") for p in parts]
    merged = hits[0]
    for x in hits[1:]:
        merged = merged.unionByName(x)
    span = F.flatten(F.transform("__all_of_blocks", lambda r: F.flatten(F.transform(F.sequence(F.lit(0), (F.size(r) / 2).cast("int") - 1), lambda k: F.sequence(r[2 * k], r[2 * k + 1] - 1)))))
    merged = merged.groupBy("doc_id", "__text_of_blocks").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items_of_blocks"), F.collect_list("hit_ranges").alias("__all_of_blocks"))
    merged = merged.withColumn("__at_of_blocks", F.sort_array(F.array_distinct(span))).drop("__all_of_blocks")
    runs = F.flatten(F.filter(F.transform("__at_of_blocks", lambda p: F.concat(F.when(~F.array_contains("__at_of_blocks", p - 1), F.array(p)).otherwise(F.array().cast("array<int>")), F.when(~F.array_contains("__at_of_blocks", p + 1), F.array(p + 1)).otherwise(F.array().cast("array<int>")))), lambda x: F.size(x) > 0))
    merged = merged.select(F.col("doc_id").alias("__id_of_blocks"), "__text_of_blocks", "__items_of_blocks", F.size("__at_of_blocks").cast("long").alias("__n_of_blocks"), runs.alias("__runs_of_blocks"))
    with_text = scan(documents, parts[0], None if keep is None else [*keep, "doc_id", "text"]).withColumn("__t_of_blocks", F.sha2("text", 256))
    out = with_text.join(merged, F.col("doc_id").eqNullSafe(F.col("__id_of_blocks")) & (F.col("__t_of_blocks") == merged["__text_of_blocks"]), "left")
    out = out.withColumns({"n_hit": F.coalesce("__n_of_blocks", F.lit(0).cast("long")), "items": F.coalesce("__items_of_blocks", F.array().cast("array<string>")), "hit_ranges": F.coalesce("__runs_of_blocks", F.array().cast("array<int>"))})
    return out.select(first.columns)


def remove_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a window of the benchmark; their columns as they were."""
    names = {x.lower() for x in _ADDED.names}
    renamed = documents.select([F.col(f"`{c}`").alias(f"__in_{c}" if c.lower() in names else c) for c in documents.columns])
    kept = decontaminate(renamed, benchmark, **options).where("n_hit = 0")
    return kept.select([F.col(f"`__in_{c}`").alias(c) if c.lower() in names else F.col(f"`{c}`") for c in documents.columns])


def remove_spans(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with the bytes from the first to the last word of each hit run cut out of their text."""
    marked = decontaminate(documents, benchmark, **options)
    schema = T.StructType([T.StructField("text", T.StringType())])

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out, ranges, texts = [], batch.column("hit_ranges").to_pylist(), batch.column("text")
        for i, j, data, offsets in slices(texts):
            words = words_of(data, offsets, ALNUM, lower=True)
            raw = data[int(offsets[0]) : int(offsets[-1])]
            for row in range(i, j):
                first, end = int(offsets[row - i] - offsets[0]), int(offsets[row - i + 1] - offsets[0])
                at, pieces = first, []
                for a, b in zip(ranges[row][::2], ranges[row][1::2], strict=True):
                    k = words.first[row - i]
                    pieces.append(raw[at : words.starts[k + a]].tobytes())
                    at = int(words.ends[k + b - 1])
                out.append(b"".join([*pieces, raw[at:end].tobytes()]).decode() if texts[row].is_valid else None)
        return {"text": pa.array(out, pa.string())}

    return add_columns(marked, schema, compute).select([f"`{c}`" for c in marked.columns])


def digest(marked: DataFrame) -> DataFrame:
    """One row for each document, as the query op10 returns it."""
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


__all__ = ["BLOCK", "benchmark_windows", "decontaminate", "digest", "hex_digest", "remove_documents", "remove_spans"]
