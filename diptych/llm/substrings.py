"""Substring dedup by fixed-block anchors: passages of ``window`` words that an earlier document has are removed.

1. Every document is cut into non-overlapping blocks of ``window / 2`` words, its reference blocks.  A window of
   ``window`` words always holds a whole one, wherever it starts.
2. Every rolling window of that many words, at every word of every document, probes the blocks: chunks send the hashes
   to buckets, which answer with those that are a block of one place and occur at another.
3. Hits are extended: each window of ``window`` words around a hit is compared by its own 64-bit hash, and a bucket finds
   the smallest doc_id that has it.  Runs of such windows are the maximal exact repeats.  Hashes are keyed anew in each run.
4. A word is removed if a window over it starts in a document of smaller doc_id as well.  Windows are judged on the
   input, so the order of work does not matter.

A passage of many documents costs each chunk one entry, not each pair of documents one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .words import SPACED, Words, new_key, slices, words_of

_LAST = (1 << 63) - 1


def _live_windows(words: Words, live: np.ndarray, block: int, window: int, n: X.Sizes) -> tuple[np.ndarray, np.ndarray]:
    """The whole windows that hold a live block, and the windows' hashes."""
    small, _ = words.windows(block)
    hashes, whole = words.windows(window)
    hit = np.r_[0, np.cumsum(X.is_in(X.short(small, n), live))]
    k = len(hashes)
    reach = np.minimum(np.arange(k) + window - block + 1, k)
    return np.flatnonzero(whole & (hit[reach] > hit[:k])), hashes


def remove_repeats(documents: DataFrame, window: int = 50) -> DataFrame:
    """The documents with n_words, n_removed and kept (the words that stay, joined by one space).

    Words are runs of characters other than space and U+0009..U+000D, unchanged.  A null text has no words and an empty
    kept; a document of fewer than ``window`` words keeps them all; rows of the same doc_id do not remove each other's
    words; a null doc_id counts as larger than all others.  Input columns stay, but for those named as an added one.
    """
    block = window // 2
    added = {"n_words", "n_removed", "kept"}
    documents = documents.select([f"`{c}`" for c in documents.columns if c.lower() not in added])
    names = documents.columns
    n = X.sizes(documents.select("text"), 0.75)
    chunks, key = X.chunked(documents, n), new_key()

    def keys(table: pa.Table) -> np.ndarray:
        return table.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()

    def probe(table: pa.Table) -> pa.Table:
        every, anchors = [], []
        for _, _, data, offsets in slices(table.column("text")):
            words = words_of(data, offsets, SPACED, key=key)
            hashes, whole = words.windows(block)
            place = np.arange(len(hashes)) - words.first[words.owner()]
            every.append(X.short(hashes[whole], n))
            anchors.append(X.short(hashes[whole & (place % block == 0)], n))
        every, anchors = np.sort(np.concatenate(every)), np.unique(np.concatenate(anchors))
        starts, ends = X.runs(every)
        more, every = every[starts[ends - starts > 1]], every[starts]
        chunk = table.column(X.CHUNK)[0].as_py()
        out = [(b, chunk, *rest) for b, *rest in X.dealt(n, every, more, anchors)]
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(zip(("bucket", "chunk", "every", "more", "anchors"), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True))})

    def meet(table: pa.Table) -> pa.Table:
        every = X.unpack(table.column("every"), np.uint32)
        ordered = np.sort(np.concatenate(every))
        twice = np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *X.unpack(table.column("more"), np.uint32)])
        live = np.intersect1d(twice, np.concatenate(X.unpack(table.column("anchors"), np.uint32)))
        found = [x[X.is_in(x, live)] for x in every]
        keep = [i for i, x in enumerate(found) if len(x)]
        return pa.table({"chunk": table.column("chunk").take(X.places(keep)), "bucket": table.column("bucket").take(X.places(keep)), "hits": pa.array([X.pack(found[i]) for i in keep], pa.binary())})

    def extend(table: pa.Table, hits: pa.Table) -> pa.Table:
        found = [X.unpack(hits.column("hits"), np.uint32)[i].astype(np.uint64) | np.uint64(b << 32) for i, b in enumerate(hits.column("bucket").to_pylist())]
        live = np.sort(np.concatenate([np.zeros(0, np.uint64), *found]))
        all_keys, hashes, owners = keys(table) if table.num_rows else np.zeros(0, np.int64), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j, data, offsets in slices(table.column("text")) if len(live) else ():
            words = words_of(data, offsets, SPACED, key=key)
            at, h = _live_windows(words, live, block, window, n)
            hashes.append(h[at])
            owners.append(all_keys[i:j][words.owner()[at]])
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((owners, hashes, X.bucket_of(hashes, n)))
        hashes, owners = hashes[order], owners[order]
        starts, ends = X.runs(hashes)
        first, several = owners[starts], owners[ends - 1] > owners[starts]
        hashes = hashes[starts]
        buckets = X.bucket_of(hashes, n)
        chunk = table.column(X.CHUNK)[0].as_py() if table.num_rows else 0
        out = [(int(buckets[a]), chunk, *(X.pack(x[a:b]) for x in (hashes, first, several))) for a, b in zip(*X.runs(buckets), strict=True)]
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(zip(("bucket", "chunk", "hashes", "first", "several"), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True))})

    def earliest(table: pa.Table) -> pa.Table:
        hashes, first, several = (X.unpack(table.column(c), k) for c, k in (("hashes", np.uint64), ("first", np.int64), ("several", bool)))
        both, mine = np.concatenate(hashes), np.concatenate(first)
        order = np.lexsort((mine, both))
        starts, ends = X.runs(both[order])
        least = np.empty(len(both), np.int64)
        least[order] = np.repeat(mine[order][starts], ends - starts)
        at, out = 0, []
        for i, (h, f, s) in enumerate(zip(hashes, first, several, strict=True)):
            m = least[at : at + len(h)]
            at += len(h)
            if (told := (m < f) | s).any():
                out.append((i, X.pack(h[told]), X.pack(m[told])))
        return pa.table({"chunk": table.column("chunk").take(X.places([r[0] for r in out])), "hashes": pa.array([r[1] for r in out], pa.binary()), "least": pa.array([r[2] for r in out], pa.binary())})

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.zeros(0, np.uint64), *X.unpack(told.column("hashes"), np.uint64)])
        least = np.concatenate([np.zeros(0, np.int64), *X.unpack(told.column("least"), np.int64)])
        order = np.argsort(hashes)
        hashes, least = hashes[order], least[order]
        all_keys, n_words, n_removed, kept = keys(table), [], [], []
        for i, j, data, offsets in slices(table.column("text")):
            words = words_of(data, offsets, SPACED, key=key)
            h, whole = words.windows(window)
            at = np.flatnonzero(whole & X.is_in(h, hashes))
            at = at[all_keys[i:j][words.owner()[at]] > least[np.searchsorted(hashes, h[at])]]
            edge = np.zeros(len(h) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge)[: len(h)] > 0
            counts = words.counts()
            gone_before = np.r_[0, np.cumsum(gone)]
            removed = gone_before[words.first[1:]] - gone_before[words.first[:-1]]
            n_words.append(counts)
            n_removed.append(removed)
            base = int(offsets[0])
            for d in range(j - i):
                if removed[d]:
                    a = words.first[d]
                    stay = np.flatnonzero(~gone[a : words.first[d + 1]]) + a
                    kept.append(b" ".join([words.data[s:e].tobytes() for s, e in zip(words.starts[stay], words.ends[stay], strict=True)]))
                else:
                    kept.append(b" ".join(words.data[offsets[d] - base : offsets[d + 1] - base].tobytes().split()))
        made = {"n_words": pa.array(np.concatenate(n_words), pa.int64()), "n_removed": pa.array(np.concatenate(n_removed), pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())} if n_words else {}
        if not made:
            made = {"n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())}
        return pa.table({**{c: table.column(c) for c in names}, **made})

    met = X.per_bucket(X.per_chunk(chunks, probe, "bucket int, chunk int, every binary, more binary, anchors binary"), meet, "chunk int, bucket int, hits binary")
    sent = X.answered(chunks, met, extend, "bucket int, chunk int, hashes binary, first binary, several binary")
    told = X.per_bucket(sent, earliest, "chunk int, hashes binary, least binary")
    schema = T.StructType([*documents.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return X.answered(chunks, told, cut, schema)


def digest(marked: DataFrame) -> DataFrame:
    return marked.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
