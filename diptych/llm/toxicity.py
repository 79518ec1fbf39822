"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lowers letters, takes off accents, maps look-alikes of other scripts to Latin letters, and digits and signs that
stand for letters inside words to those letters; everything but letters then separates words.  Such signs at a word's end may
as well be punctuation, so the word that they would make of it is told beside it, and counts if the lexicon has it.  The
lexicon is learned from
labelled documents: a word's weight is how much likelier toxic documents are to have it.  Phrases of a lexicon word and a
neighbour that only clean documents have are exceptions; a match of one takes the word's weight back.  What a document
collects, as it is and for its length, is turned into a probability by a logistic model of the same labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_columns, checkpointed

#: Bound of the fit: labelled documents that are learned from.
SAMPLE = 40_000
#: A lexicon word is in so many toxic documents at least and has so high a weight (in nats); an exception is in so many clean
#: documents and no toxic one.  These alone decide what is in the model.
LEAST_DOCUMENTS, LEAST_WEIGHT, LEAST_CLEAN = 4, 1.8, 3
#: A model of more entries than this is refused: the thresholds then don't fit the labels.
MOST_ENTRIES = 2_000_000

# Letters of other scripts, and signs, with the Latin letters they look like.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss", "ø": "o", "ł": "l", "đ": "d",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"}


def _table() -> dict[int, str]:
    out = {ord(k): v for k, v in _LOOKALIKES.items()}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if plain and plain.isascii() and code not in out:
            out[code] = plain
    out |= dict.fromkeys([0xAD, *range(0x300, 0x370), *range(0x200B, 0x2010), 0xFEFF], "")
    return out


_FOLD = _table()
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!|€+9]+(?=[^\W\d_])")
_START = re.compile(r"(?<![^\W_])[0134578@$!|€+9](?=[^\W\d_]{2})")
_END = re.compile(r"[0134578@$!|€+9]+(?![^\W_])")
_OTHER = re.compile(r"[\W\d_]+")
_SUBSTITUTES = _DIGITS | _SIGNS


#: Parts the text's words from those that signs at their ends would make.
_BESIDE = "\n"


def _substituted(text: str | None) -> str:
    text = (text or "").lower().translate(_FOLD)
    text = _INSIDE.sub(lambda m: "".join(_SUBSTITUTES[c] for c in m[0]), text)
    return _START.sub(lambda m: _SUBSTITUTES[m[0]], text)


def folded(text: str | None) -> str:
    """The text's words of letters, folded, each between single spaces."""
    return f" {_OTHER.sub(' ', _substituted(text)).strip()} "


def told(text: str | None) -> str:
    """The folded text, and behind _BESIDE, if any of its words has signs at its end, the words that these would make."""
    text = _substituted(text)
    beside = []
    for m in _END.finditer(text):
        start = m.start()
        while start and text[start - 1].isalpha():
            start -= 1
        if start < m.start():
            beside.append(text[start : m.start()] + "".join(_SUBSTITUTES[c] for c in m[0]))
    return f" {_OTHER.sub(' ', text).strip()} " + (f"{_BESIDE} {' '.join(beside)} " if beside else "")


@dataclass(frozen=True)
class Model:
    """Weights by word, exception phrases with the weight they take back, and the logistic model's coefficients."""

    words: dict[str, float]
    exceptions: dict[str, float]
    coefficients: tuple[float, ...]

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.words:
            return None
        out = ahocorasick.Automaton()
        for word, weight in self.words.items():
            out.add_word(f" {word} ", weight)
        for phrase, weight in self.exceptions.items():
            out.add_word(f" {phrase} ", -weight)
        out.make_automaton()
        return out


def features(text: str | None, automaton: ahocorasick.Automaton | None) -> tuple[float, float, float]:
    """Whether anything is matched, the sum of weights, and the sum for the text's length, both as logarithms."""
    return measures(told(text), automaton)


def measures(words: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float, float]:
    """The features of a text as ``told``."""
    total = max(0.0, sum(w for _, w in automaton.iter(words))) if automaton else 0.0
    return float(total > 0), math.log1p(total), math.log1p(100 * total / (words.partition(_BESIDE)[0].count(" ") + 20))


def probability(x: tuple[float, float, float], coefficients: tuple[float, ...]) -> float:
    z = coefficients[0] + sum(c * v for c, v in zip(coefficients[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Coefficients of a ridge logistic regression of y out of n, by Newton's steps; the first is the constant."""
    x = np.c_[np.ones(len(x)), x]
    out, penalty = np.zeros(x.shape[1]), np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        step = np.linalg.solve((x.T * (n * (p * (1 - p) + 1e-6))) @ x + penalty, x.T @ (y - n * p) - penalty @ out)
        out += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(out.tolist())


def fit(documents: DataFrame, labels: DataFrame, train: str = "true") -> Model:
    """The model of the labelled documents whose label row passes ``train`` (a SQL condition).

    At most about SAMPLE of them are used, by a hash of doc_id.  Words are counted once a document, by a Spark aggregation.
    """
    chosen = labels.where(F.expr(f"toxic is not null and doc_id is not null and ({train})")).select("doc_id", "toxic")
    total = chosen.count()
    if total > SAMPLE:
        chosen = chosen.where(F.xxhash64(F.lit(5), "doc_id").cast("double") < (2.0 * SAMPLE / total - 1) * 2.0**63)
    # The sample's ids are bounded, so they go to the documents.  The sample is folded once and kept, as it is read several times.
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))

    def fold(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"words": pa.array([told(x.as_py()) for x in batch.column("text")], pa.string())}

    known = checkpointed(add_columns(sample, T.StructType([T.StructField("words", T.StringType())]), fold, ["toxic"]))
    sides = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bad, good = sides.get(1, 0), sides.get(0, 0)
    if not bad + good:
        return Model({}, {}, (-3.0, 0.0, 0.0, 0.0))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    grams = known.select(F.explode(F.array_distinct(F.split(F.trim("words"), r"[ \n]+"))).alias("gram"), "toxic").where("gram <> ''")
    counts = grams.groupBy("gram").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    lexicon = counts.where(F.col("bad") >= LEAST_DOCUMENTS).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT).select("gram", "weight")
    words = _model_rows(lexicon)
    context = documents.sparkSession.sparkContext
    held = context.broadcast(words)

    def phrases(batches):
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = text.partition(_BESIDE)[0].split()
                found = set()
                for k, w in enumerate(tokens):
                    if w in held.value:
                        found |= {(" ".join(tokens[a : a + 2]), w) for a in (k - 1, k) if a >= 0 and len(tokens[a : a + 2]) == 2}
                out += ((p, w, toxic) for p, w in found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int32())], names=["phrase", "word", "toxic"])

    pairs = known.select("words", "toxic").mapInArrow(phrases, "phrase string, word string, toxic int").groupBy("phrase", "word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    # A phrase of two lexicon words takes back the greater weight.
    exceptions: dict[str, float] = {}
    for phrase, word in _model_rows(pairs.where((F.col("bad") == 0) & (F.col("good") >= LEAST_CLEAN)).select(F.struct("phrase", "word"), F.lit(0.0))):
        exceptions[phrase] = max(words[word], exceptions.get(phrase, 0.0))
    drawn = context.broadcast(Model(words, exceptions, (0.0, 0.0, 0.0, 0.0)))

    def measure(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        automaton = drawn.value.automaton()
        rows = [measures(x.as_py(), automaton) for x in batch.column("words")]
        return {f"x{k}": pa.array([r[k] for r in rows], pa.float64()) for k in range(3)}

    rows = add_columns(known, T.StructType([T.StructField(f"x{k}", T.DoubleType()) for k in range(3)]), measure, ["toxic"])
    # Documents with equal features are one row: most match nothing.
    counted = rows.groupBy("x0", "x1", "x2").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).orderBy("x0", "x1", "x2").collect()
    x, n = np.array([[r["x0"], r["x1"], r["x2"]] for r in counted]), np.array([float(r["n"]) for r in counted])
    return Model(words, exceptions, _logistic(x, np.array([float(r["bad"]) for r in counted]), n))


def _model_rows(rows: DataFrame) -> dict:
    """The first column's values with the second's; refused if there are more than a model may have."""
    found = rows.limit(MOST_ENTRIES + 1).collect()
    if len(found) > MOST_ENTRIES:
        raise ValueError(f"over {MOST_ENTRIES} entries pass the thresholds; raise LEAST_DOCUMENTS or LEAST_WEIGHT")
    return dict(sorted((r[0], float(r[1])) for r in found))


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 from 0.5 on).

    A null text scores as an empty one, which has no match; equal texts score alike.  Input columns are kept (or ``keep`` of
    them), but for those with an added one's name.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        automaton = held.value.automaton()
        scores = [probability(features(x.as_py(), automaton), held.value.coefficients) for x in batch.column("text")]
        return {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())}

    return add_columns(documents, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]), compute, keep)
