"""How the sources of a language differ in their words, in exact integers, from two passes over the texts.

The first pass counts the documents of each (language, term), and the terms in enough of them are kept.  They are dealt
into shards of some thousands, and each shard is made a minimal perfect hash with its own terms stored.  Blocks of shards of
bounded size are broadcast; the second pass finds each word's slot, compares the stored term, and increments the slots of the
word's (language, source), a dense array for each group that a task meets.  Shares and divergences are then computed by
ranges of slots, and what ranges give is added up.

At scale: a task sends one row for each distinct term (first pass) or group and term (second), summed before they are
shuffled.  A corpus whose kept terms fill several blocks is read once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpointed
from .vocabulary import ENCODED_BYTES, LETTERS, Perfect, Slots, encoded, perfect, shard_of
from .words import slices

#: A term is kept if it is in so many documents of its language; so many ranks of terms are told.
LEAST_DOCUMENTS, MOST_RANKS = 3, 200
#: Shares are whole multiples of one in so many.
SCALE = 1_000_000_000
#: Terms and term bytes of a shard, about; of a block of shards, which is broadcast, at most (a shard at least).
SHARD_TERMS, SHARD_BYTES, BLOCK_TERMS, BLOCK_BYTES = 4096, 1 << 20, 2_000_000, 64 << 20
#: Slots that a task's groups have together before it sends its counts.
MOST_CELLS = 1 << 23
#: Sources times slots of a range, about.
RANGE_CELLS = 1 << 18

_SHARD = "lang string, shard int, n int, bytes long, seed int, sizes array<long>, bits binary, terms array<string>"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index("text")), ENCODED_BYTES):
        yield i, j, encoded(data, offsets, LETTERS)


def _coded(column: pa.Array) -> tuple[np.ndarray, list]:
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def kept_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang and term for each term in at least ``least`` documents of its language; lang has no nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, names = _coded(batch.column(0))
            names = pa.array(names, pa.string())
            for i, j, e in _texts(batch):
                n = max(1, len(e.terms))
                once = np.unique(e.owner() * n + e.codes)
                pair, docs = np.unique(langs[i:j][once // n] * n + once % n, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(pair // n)), e.terms.take(pa.array(pair % n)).cast(pa.string()), pa.array(docs, pa.int64())], names=["lang", "term", "docs"])

    counted = documents.select("lang", "text").mapInArrow(count, "lang string, term string, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")


def shards_of(kept: DataFrame) -> DataFrame:
    """The kept terms as shards: a row each, with its minimal perfect hash and its terms in the order of their slots."""
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("b"))
    shards = sizes.select("lang", F.ceil(F.greatest(F.col("n") / SHARD_TERMS, F.col("b") / SHARD_BYTES)).cast("int").alias("shards"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = shard_of(batch.column(1), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), batch.column(1)], names=["lang", "shard", "term"])

    def build(table: pa.Table) -> pa.Table:
        made = perfect(table.column("term").combine_chunks().cast(pa.large_string()))
        row = {"lang": table.column("lang")[0].as_py(), "shard": table.column("shard")[0].as_py(), "n": table.num_rows, "bytes": made.terms.nbytes + made.bits.nbytes, "seed": made.seed}
        kinds = (("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int32()), ("bytes", pa.int64()), ("seed", pa.int32()))
        whole = [pa.array([made.sizes], pa.list_(pa.int64())), pa.array([made.bits.tobytes()], pa.binary()), pa.array([made.terms.to_pylist()], pa.list_(pa.string()))]
        return pa.Table.from_arrays([pa.array([row[k]], kind) for k, kind in kinds] + whole, names=[k for k, _ in kinds] + ["sizes", "bits", "terms"])

    placed = kept.join(shards, "lang").select("lang", "term", "shards").mapInArrow(place, "lang string, shard int, term string")
    return placed.groupBy("lang", "shard").applyInArrow(build, _SHARD)


def _blocks(shards: DataFrame) -> list[list[tuple[str, int]]]:
    """The names of all shards in order, in blocks of bounded terms and bytes."""
    out, terms, size = [], BLOCK_TERMS, BLOCK_BYTES
    for r in sorted(shards.select("lang", "shard", "n", "bytes").collect()):
        if terms + r["n"] > BLOCK_TERMS or size + r["bytes"] > BLOCK_BYTES:
            out.append([])
            terms = size = 0
        out[-1].append((r["lang"], r["shard"]))
        terms, size = terms + r["n"], size + r["bytes"]
    return out


class _Block:
    """Slots of a block, and for each language its number of shards in all, its first one here, and where its slots lie."""

    def __init__(self, rows: list, totals: dict[str, int]):
        rows = sorted(rows, key=lambda r: (r["lang"], r["shard"]))
        self.slots = Slots([Perfect(r["seed"], list(r["sizes"]), np.frombuffer(r["bits"], np.uint8), pa.array(r["terms"], pa.large_string())) for r in rows])
        self.langs: dict[str, tuple[int, int, int, int]] = {}
        for k, r in enumerate(rows):
            total, low, at, n = self.langs.get(r["lang"], (totals[r["lang"]], r["shard"], k, 0))
            self.langs[r["lang"]] = (total, low, at, n + 1)

    def find(self, lang: str, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are kept ones of the language here, and their slots counted from its first."""
        total, low, at, n = self.langs[lang]
        shard = shard_of(terms, total) - low
        here = np.flatnonzero((shard >= 0) & (shard < n))
        slot = self.slots.find(shard[here] + at, terms.take(pa.array(here)))
        return here[slot >= 0], slot[slot >= 0] - self.slots.first[at]

    def size(self, lang: str) -> int:
        _, _, at, n = self.langs[lang]
        return int(self.slots.first[at + n] - self.slots.first[at])

    def named(self, lang: str, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shards of a language's slots, and the slots within them."""
        _, low, at, n = self.langs[lang]
        first = self.slots.first[at : at + n] - self.slots.first[at]
        shard = np.searchsorted(first, slot, "right") - 1
        return shard + low, slot - first[shard]


def recount(documents: DataFrame, shards: DataFrame) -> DataFrame:
    """lang, source, shard, slot and n: how often a group has each kept term that it has; lang and source have no nulls."""
    spark, out = documents.sparkSession, None
    totals = {r["lang"]: r["shards"] for r in shards.groupBy("lang").agg((F.max("shard") + 1).alias("shards")).collect()}
    for names in _blocks(shards):
        low, high = (F.struct(F.lit(lang).alias("lang"), F.lit(k).alias("shard")) for lang, k in (names[0], names[-1]))
        held = spark.sparkContext.broadcast(_Block(shards.where(F.struct("lang", "shard").between(low, high)).collect(), totals))

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block, cells, groups = held.value, 0, {}

            def sent() -> Iterator[pa.RecordBatch]:
                for (lang, source), array in groups.items():
                    slot = np.flatnonzero(array)
                    shard, local = block.named(lang, slot)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array([source] * len(slot), pa.string()), pa.array(shard, pa.int32()), pa.array(local, pa.int32()), pa.array(array[slot], pa.int64())], names=["lang", "source", "shard", "slot", "n"])
                groups.clear()

            for batch in batches:
                langs, lang_names = _coded(batch.column(0))
                sources, source_names = _coded(batch.column(1))
                for i, j, e in _texts(batch):
                    n, owner = max(1, len(e.terms)), e.owner()
                    group = langs[i:j][owner] * len(source_names) + sources[i:j][owner]
                    pair, times = np.unique(group * n + e.codes, return_counts=True)
                    of_lang = pair // n // max(1, len(source_names))
                    for k in np.unique(of_lang).tolist():
                        lang = lang_names[k]
                        if lang not in block.langs:
                            continue
                        mine = np.flatnonzero(of_lang == k)
                        code, where = np.unique(pair[mine] % n, return_inverse=True)
                        known, found = block.find(lang, e.terms.take(pa.array(code)))
                        slots = np.full(len(code), -1, np.int64)
                        slots[known] = found
                        slots, who, often = slots[where], pair[mine] // n % len(source_names), times[mine]
                        who, often, slots = who[slots >= 0], often[slots >= 0], slots[slots >= 0]
                        for s in np.unique(who).tolist():
                            key = (lang, source_names[s])
                            if key not in groups:
                                if cells + block.size(lang) > MOST_CELLS:
                                    yield from sent()
                                    cells = 0
                                groups[key] = np.zeros(block.size(lang), np.int64)
                                cells += block.size(lang)
                            # A slot comes once for a source here, so a plain addition counts it.
                            groups[key][slots[who == s]] += often[who == s]
            yield from sent()

        rows = documents.select("lang", "source", "text").mapInArrow(count, "lang string, source string, shard int, slot int, n long")
        part = checkpointed(rows.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")))
        held.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "lang string, source string, shard int, slot int, n long")


def scaled(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole) without a product over 64 bits: three decimal digits of SCALE at a time."""
    rest, out = counts + 1, 0
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _compared(table: pa.Table, groups: pa.Table, ranks: int) -> pa.Table:
    """Of a range of slots: for each two sources the sum of divergences, and each source's terms that may reach a rank."""
    names, codes = groups.column("source").to_pylist(), {}
    lang, kept = groups.column("lang")[0].as_py(), groups.column("kept")[0].as_py()
    codes = {s: k for k, s in enumerate(names)}
    totals = groups.column("total").to_numpy()
    found = table.column("source").combine_chunks().dictionary_encode()
    source = np.array([codes[s] for s in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy(zero_copy_only=False)]
    place = (table.column("shard").to_numpy().astype(np.int64) << 32) | table.column("slot").to_numpy()
    slots, column = np.unique(place, return_inverse=True)
    order = np.argsort(column, kind="stable")
    source, column, n = source[order], column[order], table.column("n").to_numpy()[order]
    sums, told = np.zeros((len(names), len(names)), np.int64), []
    wholes = (totals + kept)[:, None]
    width = max(1, RANGE_CELLS // len(names))
    for low in range(0, len(slots), width):
        high = min(low + width, len(slots))
        a, b = np.searchsorted(column, (low, high))
        counts = np.zeros((len(names), high - low), np.int64)
        counts[source[a:b], column[a:b] - low] = n[a:b]
        shares = scaled(counts, wholes)
        own = scaled(counts.sum(0), int(totals.sum()) + kept)
        for k in range(len(names)):
            gap = shares[k] - shares
            sums[k] += (gap * gap // shares).sum(1)
            at = np.flatnonzero((counts[k] > 0) & (shares[k] > own))
            value = (shares[k][at] - own[at]) ** 2 // own[at]
            if len(at) > ranks:
                stay = value >= np.partition(value, len(value) - ranks)[len(value) - ranks]
                at, value = at[stay], value[stay]
            told.append((np.full(len(at), k), slots[at + low], value))
    who, other = np.nonzero(~np.eye(len(names), dtype=bool))
    term_of, slot, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*told, strict=True) if told else ((), (), ())))
    every = pa.array(names, pa.string())
    absent = pa.nulls(len(who), pa.int32())
    return pa.table({
        "lang": pa.array([lang] * (len(who) + len(slot)), pa.string()), "source": pa.concat_arrays([every.take(pa.array(who)), every.take(pa.array(term_of))]),
        "item": pa.concat_arrays([every.take(pa.array(other)), pa.nulls(len(slot), pa.string())]), "shard": pa.concat_arrays([absent, pa.array(slot >> 32, pa.int32())]),
        "slot": pa.concat_arrays([absent, pa.array(slot & 0xFFFFFFFF, pa.int32())]), "value": pa.array(np.r_[sums[who, other], value], pa.int64()),
    })


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = MOST_RANKS) -> DataFrame:
    """lang, source, part, item, value and rank: how far a source's words are from each other source's of its language, and
    the terms that set it apart from the language.

    A null text, lang or source is read as an empty one, so null and empty ones are one group.  A term is a run of ASCII
    letters, A-Z lowered, and non-ASCII characters.  With V kept terms in a language, N of their occurrences in a group and
    count of one term there, its share is p = 1 + floor(SCALE * (count + 1) / (N + V)), and its divergence from a share q is
    floor((p - q) ** 2 / q).  Part ``pair`` has, for each other source, the sum over all kept terms (0 without any), part
    ``term`` each term that the group has, with a share above the language's, to rank ``ranks``.  Ranks go by value, the
    greatest first, then by item; repeated rows are documents of their own; an empty table has no rows.  All numbers are
    exact as long as a language has under 10**15 words.
    """
    documents = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    shards = checkpointed(shards_of(kept_terms(documents, least)))
    counts = recount(documents, shards)
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("kept"), (F.max("shard") + 1).alias("shards"))
    groups = documents.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = checkpointed(groups.join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "shards"))

    # A range has whole shards, as many as RANGE_CELLS holds for the language's sources.
    ranges = groups.where("kept > 0").groupBy("lang").agg(F.greatest(F.lit(1), F.floor(F.lit(RANGE_CELLS / SHARD_TERMS) / F.count(F.lit(1)))).cast("int").alias("width"))
    dealt = counts.join(ranges, "lang").withColumn("part", F.floor(F.col("shard") / F.col("width")).cast("int"))
    asked = groups.where("kept > 0").join(ranges, "lang").select("lang", "source", "total", "kept", F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / F.col("width")).cast("int"))).alias("part"))
    compare = lambda table, wanted: _compared(table, wanted, ranks)
    found = checkpointed(dealt.groupBy("lang", "part").cogroup(asked.groupBy("lang", "part")).applyInArrow(compare, "lang string, source string, item string, shard int, slot int, value long"))

    bare = groups.where("kept = 0").select("lang", "source")
    nothing = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = found.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(nothing).withColumn("part", F.lit("pair"))
    terms = shards.select("lang", "shard", F.posexplode("terms").alias("slot", "item"))
    tops = found.where("item is null").drop("item").join(terms, ["lang", "shard", "slot"]).select("lang", "source", "item", "value", F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pairs.unionByName(tops).withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
    return out.select("lang", "source", "part", "item", "value", "rank")
