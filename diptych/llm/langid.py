"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

A language's dictionary is raw text: a stretch of each document of a bounded sample of its labelled ones, at a place drawn by
a hash.  The whole text is lowered, all but letters become single spaces, and it is cut into blocks of a kilobyte; each block
is encoded by itself with each language's zstandard dictionary and the sizes are added up, so a text of any length is judged
by the dictionaries and not by its own repeats.  A filler behind each block keeps zstandard from storing short ones as they
are.  The margin is how much less the best language takes than the next, as a share; a document is rejected when it is
narrow or there is no letter.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_columns

#: Bounds of the sample: documents of a language, and bytes of its dictionary, to which each of them gives an equal part.
SAMPLE_DOCUMENTS, DICTIONARY_BYTES = 240, 1 << 16
#: Dictionaries are made as long as the shortest, so that none wins by its length; but not shorter than this.
EQUAL_FROM = 1 << 13
#: Bytes of text that are encoded at once.
BLOCK_BYTES = 1 << 10
#: A margin under this rejects.
MARGIN = 0.002

#: All but letters and the marks that belong to them, so that numerals such as ``²`` are no letters and vowel signs stay in words.
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
_FILLER = b"0" * 64

_ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def normal(text: str | None) -> bytes:
    """The text in lower case with single spaces for all but letters and marks; empty if it has no letter."""
    text = text or ""
    if not _LETTER.search(text):
        return b""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


def stretch(text: str | None, size: int, draw: int) -> bytes:
    """``size`` bytes of the normal text (all, if it has no more) from a place that the number ``draw`` fixes."""
    data = normal(text)
    at = draw % (len(data) - size + 1) if len(data) > size else 0
    return data[at : at + size]


@dataclass(frozen=True)
class Model:
    """Languages, the most frequent first (ties go to the first), with their dictionaries."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]

    def coders(self) -> list[zstandard.ZstdCompressor]:
        kind = {"compression_level": 3, "min_match": 3, "strategy": zstandard.STRATEGY_LAZY2, "window_log": 18, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        parameters = zstandard.ZstdCompressionParameters(**kind)
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters) for d in self.dictionaries]


def fit(documents: DataFrame, train: str = "true") -> Model:
    """The model of the documents that have a lang and a text and pass ``train`` (a SQL condition).

    Counts of languages cover all such documents; dictionaries are of the SAMPLE_DOCUMENTS of each language that come first
    by a hash of doc_id.  A language without a letter in them has no dictionary.
    """
    known = documents.where(F.expr(f"lang is not null and text is not null and doc_id is not null and ({train})")).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count().collect()
    first = Window.partitionBy("lang").orderBy("__hash", "doc_id")
    chosen = known.select("lang", "doc_id", F.xxhash64(F.lit(11), "doc_id").alias("__hash")).withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= SAMPLE_DOCUMENTS)
    chosen = chosen.select(F.col("lang").alias("__lang"), F.col("doc_id").alias("__id"))
    # The ids are as many as languages times a bound; only a table of very many languages is joined by a shuffle.
    chosen = F.broadcast(chosen) if len(counts) * SAMPLE_DOCUMENTS <= 500_000 else chosen
    rows = known.join(chosen, (known["doc_id"] == chosen["__id"]) & (known["lang"] == chosen["__lang"]), "left_semi").select("lang", "doc_id", F.xxhash64(F.lit(12), "doc_id").alias("draw"), "text")
    size = DICTIONARY_BYTES // SAMPLE_DOCUMENTS

    def take(batches):
        for batch in batches:
            drawn = [stretch(t, size, d) for t, d in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drawn, pa.binary())], names=["lang", "doc_id", "part"])

    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows.mapInArrow(take, "lang string, doc_id long, part binary").distinct().collect(), key=lambda r: (r["lang"], r["doc_id"], bytes(r["part"]))):
        if r["part"]:
            texts.setdefault(r["lang"], []).append(bytes(r["part"]))
    order = [r["lang"] for r in sorted(counts, key=lambda r: (-r["count"], r["lang"])) if r["lang"] in texts]
    whole = [b"".join(texts[lang])[:DICTIONARY_BYTES] for lang in order]
    equal = max(EQUAL_FROM, min(map(len, whole), default=0))
    return Model(tuple(order), tuple(d[:equal].ljust(8) for d in whole))


def predict(text: str | None, languages: tuple[str, ...], coders: list[zstandard.ZstdCompressor]) -> tuple[str, float, float]:
    """Language, score and margin; ``und``, 0 and 0 for a text without a letter or a model without languages."""
    data = normal(text)
    if not data or not languages:
        return "und", 0.0, 0.0
    sizes = [0] * len(coders)
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at : at + BLOCK_BYTES] + _FILLER
        for k, coder in enumerate(coders):
            sizes[k] += len(coder.compress(block))
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
    margin = (second - sizes[best]) / second
    return languages[best], 0.5 + 0.5 * margin / (margin + 0.02), margin


def identify(documents: DataFrame, model: Model, margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """The documents with lang_pred, score (0 to 1, from the margin) and rejected.

    A null text, an empty one and one without a letter get ``und``, 0 and are rejected; equal texts are judged alike.
    Columns of the input are kept (or ``keep`` of them), but for those with an added one's name.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        coders = held.value.coders()
        out = [predict(x.as_py(), held.value.languages, coders) for x in batch.column("text")]
        return {"lang_pred": pa.array([r[0] for r in out], pa.string()), "score": pa.array([r[1] for r in out], pa.float64()), "rejected": pa.array([r[0] == "und" or r[2] < margin for r in out], pa.bool_())}

    return add_columns(documents, _ADDED, compute, keep)


def known_language(documents: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    names = {x.lower() for x in _ADDED.names}
    renamed = documents.select([F.col(f"`{c}`").alias(f"__in_{c}" if c.lower() in names else c) for c in documents.columns])
    kept = identify(renamed, model, margin).where("not rejected")
    return kept.select([F.col(f"`__in_{c}`").alias(c) if c.lower() in names else F.col(f"`{c}`") for c in documents.columns])
