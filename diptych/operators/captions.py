"""Caption metrics over a table of pairs (id, hypothesis, reference): n-gram overlap within rows, and by joins and sums where captions are counted together."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.functions import text

from .lineage import cut

#: Characters of a chunk of rows that are counted together, on average, and words that are held at once.
CHUNK_CHARS, TOKENS = 4_000_000, 1 << 19
#: Characters of a chunk of texts that are weighed together, on average: the fewest, and the most up to a hundred gigabytes.
WEIGHED_LEAST, WEIGHED_MOST = 1 << 20, 1 << 22
#: Texts that are sent to a second chunk by broadcast of their ids; if there are more, by a shuffled join.
LENT = 1 << 18
#: Words, padding among them, of a chunk of captions that is encoded together, on average: the fewest and the most.
CODED_LEAST, CODED_MOST = 1 << 17, 1 << 23


def following(rows: DataFrame, group: str) -> DataFrame:
    """id and ``next``, the next larger id of the same group; the last of a group has none and is left out.

    Ids are ordered in parts of a thousand; only the parts' first ids are ordered for a group as a whole.
    """
    from pyspark.sql import Window

    parts = rows.select("id", group, F.floor(F.col("id") / 1000).alias("part"))
    firsts = parts.groupBy(group, "part").agg(F.min("id").alias("first"))
    after = firsts.select(group, "part", F.lead("first").over(Window.partitionBy(group).orderBy("part")).alias("after"))
    near = parts.withColumn("next", F.lead("id").over(Window.partitionBy(group, "part").orderBy("id")))
    return near.join(after, [group, "part"]).select("id", F.coalesce("next", "after").alias("next")).where("next is not null")


def _ranges(rows: DataFrame, n: int) -> list[float]:
    """Where about n ranges of ids end that have about as many rows each, wherever ids lie dense."""
    cuts = rows.approxQuantile("id", [k / n for k in range(1, n)], 1 / (8 * n)) if n > 1 else []
    return [-math.inf, *(sorted(set(cuts)) or [0.0]), math.inf]


def _placed(rows: DataFrame, group: str, steps: DataFrame, after: int, ranges: list[float]) -> DataFrame:
    """The rows (id, group, text) by part, the range of their ids, and own: true, or false for a row of a later part that is lent to
    this one, where an id ends within ``after`` steps (id, from) of it.

    A text is sent once to its part, and once to each that it is lent to.
    """
    from pyspark.ml.feature import Bucketizer

    part = lambda frame, **named: Bucketizer(splitsArray=[ranges] * len(named), inputCols=[*named], outputCols=[*named.values()]).transform(frame)
    earlier, reach = steps, steps
    for _ in range(after - 1):
        reach = reach.join(steps.select(F.col("id").alias("from"), F.col("from").alias("further")), "from").select("id", F.col("further").alias("from"))
        earlier = earlier.unionByName(reach)
    across = cut(part(earlier.withColumnRenamed("from", "since"), id="of", since="part").where("part <> of").select("id", "part").distinct())
    own = part(rows, id="part").select("id", group, "text", "part", F.lit(True).alias("own"))
    lent = rows.join(F.broadcast(across) if across.count() <= LENT else across, "id").select("id", group, "text", "part", F.lit(False).alias("own"))
    return own.unionByName(lent).withColumn("part", F.col("part").cast("long"))


def _steps(rows: DataFrame, group: str) -> DataFrame:
    """id and ``from``, the next smaller id of the same group, as files: they are read several times."""
    return cut(following(rows.select("id", group), group).select(F.col("next").alias("id"), F.col("id").alias("from")))


def _known(rows: DataFrame, group: str) -> tuple[DataFrame, int]:
    """The rows (id, group, text) that have an id, and the number of their characters."""
    rows = rows.where(F.col("id").isNotNull()).select("id", group, "text")
    return rows, rows.agg(F.sum(F.length("text"))).first()[0] or 0


def neighbours(rows: DataFrame, group: str, after: int, chars: int = CHUNK_CHARS) -> DataFrame:
    """id, text, chunk, and next1, next2, ...: the texts of the ``after`` next larger ids of the same group, or null.

    A text is sent once, to the chunk of its range of ids, and again only to the chunks before that end within ``after`` ids
    of it.  Ranges have ``chars`` characters on average.
    """
    from pyspark.sql import Window

    rows, total = _known(rows, group)
    placed = _placed(rows, group, _steps(rows, group), after, _ranges(rows, total // chars + 1))
    all_rows = placed.select("id", "text", "own", F.concat_ws(" ", "part", group).alias("chunk"))
    in_order = Window.partitionBy("chunk").orderBy("id")
    return all_rows.select("*", *[F.lead("text", k).over(in_order).alias(f"next{k}") for k in range(1, after + 1)]).where("own").drop("own")


def _slices(said: pa.Array, meant: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about TOKENS words on all sides, one row at least."""
    of_sequences = np.r_[0, np.cumsum(meant.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    at = np.r_[0, np.cumsum(meant.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    ends = np.cumsum(said.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + of_sequences[at[1:]]
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOKENS, "right")))
        yield i, j
        i = j


@dataclass
class Grams:
    """The n-grams of some rows, counted: for each row and gram how often the first side says it, and how often the others mean it
    (by place, from 0)."""

    row: np.ndarray
    counts: np.ndarray


def counted_grams(said: pa.Array, meant: pa.Array, most: int = 4) -> Iterator[tuple[int, Grams]]:
    """n and the n-grams of rows with words said (list) and meant (list of lists), counted exactly by sorting numbers.

    A pair of words is numbered among those of the rows; longer grams are numbers of pairs and words.
    """
    if not 1 <= most <= 4:
        raise ValueError("n-grams have one to four words")
    others = meant.flatten()
    per, length = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (meant, said))
    length = np.r_[length, others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)]
    row = np.r_[np.arange(len(said)), np.repeat(np.arange(len(said)), per)]
    side = np.r_[np.zeros(len(said), np.int64), 1 + np.arange(len(others)) - np.repeat(np.cumsum(per) - per, per)]
    coded = pa.concat_arrays([said.flatten(), others.flatten()]).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words, n_sides = max(1, len(coded.dictionary)), int(per.max(initial=0)) + 1
    row, side = np.repeat(row, length), np.repeat(side, length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(words))
    two = np.zeros(len(words), np.int64)
    for n in range(1, most + 1):
        at = np.flatnonzero(left >= n)
        if n == 1:
            key, top = words, n_words
        elif n == 2:
            pairs, two[at] = np.unique(words[at] * n_words + words[at + 1], return_inverse=True)
            key, top, n_pairs = two[at], max(1, len(pairs)), max(1, len(pairs))
        else:
            last, base = (words, n_words) if n == 3 else (two, n_pairs)
            key, top = two[at] * base + last[at + 2], n_pairs * base
        if len(said) * top * n_sides >= 1 << 63:
            raise ValueError("too many words in one row")
        packed = np.sort((row[at] * top + key) * n_sides + side[at])
        starts = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, np.int64)
        k, kind = np.diff(np.r_[starts, len(packed)]), packed[starts]
        groups = kind // n_sides
        first = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
        counts = np.zeros((int(first.sum()), n_sides), np.int64)
        counts[np.cumsum(first) - 1, kind % n_sides] = k
        groups = groups[first]
        yield n, Grams(groups // top, counts)


@dataclass
class Runs:
    """The n-grams of some texts, for one n: how often a text has a gram, by gram and within it by text, and the grams' 64-bit digests.

    Grams are numbered in the order of their words' hashes, so by what the texts say and not by the order they come in.
    """

    n: int
    gram: np.ndarray
    text: np.ndarray
    count: np.ndarray
    digests: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: their bytes as digits of one number to an odd base, mixed."""
    base = 0x9FB21C651E98DF25
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    ends, data = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1], np.frombuffer(data, np.uint8)
    out, i, powers, inverse = np.empty(len(words), np.uint64), 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    while i < len(words):
        # Words are hashed in slices, as differences of sums over all bytes before.
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 18), "right")) - 1)
        digits, at = data[ends[i] : ends[j]].astype(np.uint64) + np.uint64(1), ends[i : j + 1] - ends[i]
        if len(powers) < len(digits):
            powers, inverse = (np.multiply.accumulate(np.full(len(digits), x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(digits * powers[: len(digits)])]
        out[i:j] = (sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]]
        i = j
    return _mixed(out)


def _by_key(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising places in the order of their keys, and within a key as they were; and where a key is met first."""
    shift = int(at[-1]).bit_length() if len(at) else 0
    if int(key.max(initial=0)) < 1 << (63 - shift):
        # One number for key and place sorts faster than places by their keys.
        packed = np.sort(key << shift | at)
        key, at = packed >> shift, packed & ((1 << shift) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
    return at, np.r_[True, key[1:] != key[:-1]][: len(key)]


def _alike(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of digests in their order, equal ones as they were, and where in it one is met first."""
    shift = np.uint64(max(1, len(digests)).bit_length())
    packed = np.sort(digests >> shift << shift | np.arange(len(digests), dtype=np.uint64))
    at = (packed & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    met = digests[at]
    fresh, upper = met[1:] != met[:-1], packed >> shift
    if (fresh & (upper[1:] == upper[:-1])).any():
        # Digests that differ only in the bits where their places are.
        at = np.argsort(digests, kind="stable")
        met = digests[at]
        fresh = met[1:] != met[:-1]
    return at, np.r_[True, fresh][: len(at)]


def runs_of(words: pa.Array, length: np.ndarray, most: int = 4) -> Iterator[Runs]:
    """The n-grams of texts with so many words each, one text's words after the other's.

    A word is its place among the hashes of words, a pair of words its place among pairs; longer grams are numbers of pairs and words.
    """
    said = _hashes(words)
    in_order = _alike(said)
    code = np.empty(len(said), np.int32)
    code[in_order[0]] = np.cumsum(in_order[1], dtype=np.int32) - 1
    of_word = said[in_order[0][in_order[1]]]
    owner = np.repeat(np.arange(len(length), dtype=np.int32), length)
    left = np.repeat(np.cumsum(length).astype(np.int32), length) - np.arange(len(code), dtype=np.int32)
    pair, of_pair, factor = np.zeros(len(code), np.int32), np.zeros(0, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, most + 1):
        if n == 1:
            at, fresh = in_order
        else:
            at = np.flatnonzero(left >= n)
            first, last, base = {2: (code, code, len(of_word)), 3: (pair, code, len(of_word)), 4: (pair, pair, len(of_pair))}[n]
            at, fresh = _by_key(first[at].astype(np.int64) * base + last[at + min(n - 1, 2)], at)
        gram, text, one = np.cumsum(fresh, dtype=np.int32) - 1, owner[at], at[fresh]
        if n == 1:
            digests = of_word
        elif n == 2:
            pair[at] = gram
            digests = of_pair = _mixed(of_word[code[one]] * factor + of_word[code[one + 1]] + np.uint64(2))
        else:
            digests = _mixed(of_pair[pair[one]] * factor + (of_word[code[one + 2]] if n == 3 else of_pair[pair[one + 2]]) + np.uint64(n))
        starts = np.flatnonzero(fresh | np.r_[True, text[1:] != text[:-1]][: len(text)])
        yield Runs(n, gram[starts], text[starts], np.diff(np.r_[starts, len(at)]).astype(np.int32), digests)


def pair_counts(rows: DataFrame) -> DataFrame:
    """gram, n and df: the two-word sequences of rows (id, text), how often they occur, and in how many ids.

    Sequences are counted in slices of rows before any is shuffled.  Texts of one id are gathered first if there are such; a
    null id is none.
    """

    def count(batches):
        for batch in batches:
            texts = batch.column(1)
            nothing = pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.string()))
            for i, j in _slices(nothing, texts):
                known, part = batch.column(0).slice(i, j - i).is_valid().to_numpy(zero_copy_only=False), texts.slice(i, j - i)
                sequences = part.flatten()
                length = sequences.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.repeat(np.arange(j - i), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), length)
                coded = sequences.flatten().dictionary_encode()
                words, n_words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
                at = np.flatnonzero(np.repeat(np.cumsum(length), length) - np.arange(len(words)) >= 2)
                grams, where, n = np.unique(words[at] * n_words + words[np.minimum(at + 1, len(words) - 1)] if len(at) else at, return_inverse=True, return_counts=True)
                seen = known[row[at]]
                df = np.bincount(np.unique(where[seen] * (j - i) + row[at][seen]) // (j - i), minlength=len(grams))
                told = pc.binary_join_element_wise(coded.dictionary.take(pa.array(grams // n_words)), coded.dictionary.take(pa.array(grams % n_words)), " ")
                yield pa.RecordBatch.from_arrays([told, pa.array(n.astype(np.int64)), pa.array(df.astype(np.int64))], names=["gram", "n", "df"])

    again = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
    texts = rows.select("id", F.array("text").alias("texts"))
    if not again.isEmpty():
        gathered = rows.join(again, "id", "left_semi").groupBy("id").agg(F.collect_list("text").alias("texts"))
        texts = texts.join(again, "id", "left_anti").unionByName(gathered)
    counted = texts.select("id", F.transform("texts", text.tokens).alias("words")).mapInArrow(count, "gram string, n long, df long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def shared_grams(pairs: DataFrame, most: int = 4) -> DataFrame:
    """id, h and r (words of hypothesis and reference), and hit1, hit2, ...: n-grams that both have, as often as both do.

    A pair is counted where its row is, so texts are not shuffled.
    """
    sets = pairs.select(F.col("id").cast("long"), text.tokens(F.col("hypothesis")).alias("said"), F.array(text.tokens(F.col("reference"))).alias("meant"))
    return shared_with_any(sets, most)


def shared_with_any(sets: DataFrame, most: int = 4) -> DataFrame:
    """id, h, r, and hit1, hit2, ...: n-grams said as often as said and as the reference that has them most.

    ``sets`` has id, said (words) and meant (words of each reference); h is the words said, r those of the closest reference,
    the shorter of two.
    """

    def count(batches):
        for batch in batches:
            for i, j in _slices(batch.column(1), batch.column(2)):
                ids, said, meant = (c.slice(i, j - i) for c in batch.columns)
                h = said.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = meant.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.r_[0, np.cumsum(meant.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(int)
                r = [min(((abs(int(x) - int(n)), int(x)) for x in sizes[a:b]), default=(0, 0))[1] for n, a, b in zip(h, ends[:-1], ends[1:], strict=True)]
                hits = [np.bincount(g.row, np.minimum(g.counts[:, 0], g.counts[:, 1:].max(1, initial=0)), j - i).astype(np.int64) for _, g in counted_grams(said, meant, most)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(h), pa.array(r, pa.int64()), *map(pa.array, hits)], names=["id", "h", "r", *(f"hit{n}" for n in range(1, most + 1))])

    return sets.select("id", "said", "meant").mapInArrow(count, "id long, h long, r long, " + ", ".join(f"hit{n} long" for n in range(1, most + 1)))


def bleu(pairs: DataFrame) -> DataFrame:
    """Corpus BLEU-1 to BLEU-4: clipped matches over n-grams said, a geometric mean, and the brevity penalty.

    An order without a match counts 0, and so does every BLEU from it on.
    """
    said = [F.sum(F.greatest(F.col("h") - (n - 1), F.lit(0))).alias(f"of{n}") for n in range(1, 5)]
    one = shared_grams(pairs).agg(F.sum("h").alias("h"), F.sum("r").alias("r"), *[F.sum(f"hit{n}").alias(f"hit{n}") for n in range(1, 5)], *said)
    one = one.select("h", "r", *[F.when(F.col(f"of{n}") > 0, F.col(f"hit{n}") / F.col(f"of{n}")).alias(f"p{n}") for n in range(1, 5)])
    brevity = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    out = []
    for n in range(1, 5):
        logs = sum((F.log(F.col(f"p{k}")) for k in range(1, n + 1)), F.lit(0.0)) / n
        zero = F.least(*[F.coalesce(f"p{k}", F.lit(0.0)) for k in range(1, n + 1)], F.lit(1.0)) <= 0
        out.append(F.round(F.when(zero, 0.0).otherwise(brevity * F.exp(logs)), 6).alias(f"bleu{n}"))
    return one.select(*out)


def consensus(pairs: DataFrame) -> DataFrame:
    """id and ten times the mean, over n of 1 to 4, of the cosine between both sides' n-gram counts weighted by rarity.

    A gram's weight is ln((N + 1) / (df + 1)), with df the references that have it of N; a side without weight counts 0.
    Pairs of one ``chunk``, if they name one, are counted together.
    """
    pairs = pairs.select("*", *([] if "chunk" in pairs.columns else [_chunk_of("id").alias("chunk")]))
    sets = pairs.select("chunk", F.col("id").cast("long").alias("id"), text.tokens(F.col("hypothesis")).alias("said"), F.array(text.tokens(F.col("reference"))).alias("meant"))
    n_all, chars = pairs.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.length("hypothesis"), F.lit(0)) + F.coalesce(F.length("reference"), F.lit(0)))).first()
    return _cosines(sets, n_all, chars or 0, _whole_sets, unseen=True)


def _chunk_of(column: str):
    return F.floor(F.col(column) / 1000).cast("string")


def sets_of(said: DataFrame, references: DataFrame) -> DataFrame:
    """id, chunk, said and meant: the words of said (id, hypothesis) and of its references (id, place, reference) by place; ids without any go.

    The first of meant is the reference of place 0; it is null where there is none.
    """
    gathered = references.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("reference", F.lit("")).alias("reference")))).alias("x"))
    none = F.array().cast("array<array<string>>")
    first = F.when(F.col("x")[0]["place"] == 0, none).otherwise(F.array(F.lit(None).cast("array<string>")))
    meant = F.concat(first, F.transform("x", lambda e: text.tokens(e["reference"])))
    return said.join(gathered, "id").select(F.col("id").cast("long").alias("id"), _chunk_of("id").alias("chunk"), text.tokens(F.col("hypothesis")).alias("said"), meant.alias("meant"))


def bleu_of_several(said: DataFrame, references: DataFrame) -> DataFrame:
    """Corpus BLEU-1 to BLEU-4 of said (id, hypothesis) against several references (id, place, reference) of each id.

    A gram counts as often as the reference that has it most; lengths are those of the closest reference, the shorter of
    two; an order without a match is smoothed by method 4 of Chen and Cherry (as NLTK does), unless no word matches.
    """
    sets = sets_of(said, references)
    return bleu_of_sets(sets.withColumn("meant", F.filter("meant", lambda x: x.isNotNull())))


def bleu_of_sets(sets: DataFrame) -> DataFrame:
    """``bleu_of_several`` of id, said and meant, which has the words of each reference.  Grams are counted in their rows."""
    of = [F.sum(F.greatest(F.col("h") - (n - 1), F.lit(1))).alias(f"of{n}") for n in range(1, 5)]
    totals = shared_with_any(sets).agg(F.sum("h").alias("h"), F.sum("r").alias("r"), *[F.coalesce(F.sum(f"hit{n}"), F.lit(0)).alias(f"hit{n}") for n in range(1, 5)], *of)
    missed, logs, out = F.lit(0), F.lit(0.0), []
    brevity = F.when(F.col("h") > F.col("r"), 1.0).when(F.col("h") == 0, 0.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    for n in range(1, 5):
        none = F.col(f"hit{n}") == 0
        missed = missed + none.cast("int")
        p = F.when(~none, F.col(f"hit{n}") / F.col(f"of{n}")).when(F.col("h") > 1, F.log("h") / (5 * F.pow(F.lit(2.0), missed)) / F.col(f"of{n}"))
        logs = logs + F.coalesce(F.log(p), F.lit(0.0))
        out.append(F.round(F.when(F.col("hit1") == 0, 0.0).otherwise(brevity * F.exp(logs / n)), 6).alias(f"bleu{n}"))
    return totals.select(*out)


def consensus_of_several(said: DataFrame, references: DataFrame) -> DataFrame:
    """id and ten times the mean, over n of 1 to 4, of the cosine between said and the mean vector of its references.

    A vector has the share of a gram among its text's, times ln((N + 1) / (df + 1)), with df the first references (place
    0) of N that have it; grams that no first reference has are in no vector.
    """
    n_all, chars = references.agg(F.count_if(F.col("place") == 0), F.sum(F.length("reference"))).first()
    return consensus_of_sets(sets_of(said, references), n_all, chars or 0)


def consensus_of_sets(sets: DataFrame, n_all: int, chars: int) -> DataFrame:
    """``consensus_of_several`` of id, chunk, said and meant (words of each reference, the first of place 0), with N and about how many characters there are."""
    return _cosines(sets.select("chunk", "id", "said", "meant"), n_all, chars, _whole_sets, unseen=False)


def consensus_along(rows: DataFrame, group: str, after: int, backward: bool = False) -> DataFrame:
    """id and score of each text of rows (id, group, text) that has one after it, by the ``after`` next larger ids of its group.

    These are its references, the nearest the first, in ``consensus_of_several``; backward, it is the reference of the next one
    in ``consensus``.  Texts without a group are in no set.  A chunk, a range of ids, has each text once and counts it once,
    however many sets it is in.
    """
    if backward and after != 1:
        raise ValueError("backward there is one reference")
    rows, total = _known(rows.where(F.col(group).isNotNull()), group)
    steps = _steps(rows, group)
    chars = max(min(WEIGHED_MOST, max(WEIGHED_LEAST, total // 64)), math.isqrt(128 * total))
    placed = _placed(rows, group, steps, after, _ranges(rows, total // max(1, chars) + 1))
    texts = placed.select(F.col("part").alias("chunk"), F.col("id").cast("long").alias("id"), F.col(group).alias("group"), F.lower("text").alias("text"), "own")
    return _cosines(texts, steps.count(), total, lambda table: _in_a_row(table, after, backward), unseen=backward)


@dataclass
class Sets:
    """Texts of a chunk, as words one after the other and how many each has; how often each is a first reference; the ids of the
    chunk's sets, and their cosines, of a gram's runs and weights."""

    words: pa.Array
    length: np.ndarray
    firsts: np.ndarray
    ids: pa.Array
    cosines: Callable[[Runs, np.ndarray], np.ndarray]


def _cosine(dot: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    both = (aa > 0) & (bb > 0)
    out = np.zeros(len(dot))
    out[both] = dot[both] / (np.sqrt(aa[both]) * np.sqrt(bb[both]))
    return out


def _shares(runs: Runs, weights: np.ndarray, length: np.ndarray) -> np.ndarray:
    return runs.count * weights[runs.gram] / np.maximum(length - (runs.n - 1), 1)[runs.text]


def _whole_sets(table: pa.Table) -> Sets:
    """Sets whose rows have all their texts, as said and meant."""
    said, meant = (table.column(c).combine_chunks() for c in ("said", "meant"))
    others = meant.flatten()
    per, length = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (meant, said))
    length = np.r_[length, others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)]
    n = len(said)
    of = np.r_[np.arange(n), np.repeat(np.arange(n), per)]
    firsts = np.zeros(len(of), np.int64)
    firsts[n + (np.cumsum(per) - per)[per > 0]] = 1

    def cosines(runs: Runs, weights: np.ndarray) -> np.ndarray:
        shares, says = _shares(runs, weights, length), runs.text < n
        both, where = np.unique(runs.gram.astype(np.int64) * n + of[runs.text], return_inverse=True)
        a, b = np.bincount(where[says], shares[says], len(both)), np.bincount(where[~says], shares[~says], len(both))
        return _cosine(*(np.bincount(both % n, x, n) for x in (a * b, a * a, b * b)))

    return Sets(pa.concat_arrays([said.flatten(), others.flatten()]), length, firsts, table.column("id").combine_chunks(), cosines)


def _in_a_row(table: pa.Table, after: int, backward: bool) -> Sets:
    """Sets of an own text and those after it in its group.

    Texts are numbered by group and id, so those of a set differ by ``after`` at most, and its cosine is a sum of products of
    texts that lie so near: runs of one gram that are near each other.
    """
    group, ids = table.column("group").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), table.column("id").to_numpy()
    order = np.lexsort((ids, group))
    group = group[order]
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(table.column("text").combine_chunks().take(pa.array(order)).fill_null("")))
    words, length = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    # No words are one empty word.
    length[(length == 1) & (pc.list_element(lists, 0).to_numpy(zero_copy_only=False) == "")] = 0
    words = words.filter(pc.not_equal(words, "")) if len(words) > length.sum() else words
    n = len(order)
    has = [np.r_[group[k:] == group[:-k], np.zeros(min(k, n), bool)] for k in range(1, after + 1)]
    own = np.flatnonzero(table.column("own").to_numpy()[order] & has[0])
    there = [h[own] for h in has]

    def cosines(runs: Runs, weights: np.ndarray) -> np.ndarray:
        shares = _shares(runs, weights, length)
        square, near = np.bincount(runs.text, shares * shares, n + after), [np.zeros(n + after) for _ in has]
        for lag in range(1, after + 1):
            same = np.flatnonzero(runs.gram[lag:] == runs.gram[:-lag])
            apart = runs.text[same + lag] - runs.text[same]
            for far in range(lag, after + 1):
                here = same[apart == far]
                near[far - 1] += np.bincount(runs.text[here], shares[here] * shares[here + lag], n + after)
        dot, bb = np.zeros(len(own)), np.zeros(len(own))
        for k, known in enumerate(there, 1):
            dot += known * near[k - 1][own]
            bb += known * (square[own + k] + 2 * sum(near[k - j - 1][own + j] for j in range(1, k)))
        return _cosine(dot, square[own], bb)

    firsts = np.bincount(own + (not backward), minlength=n)
    return Sets(words, length, firsts, pa.array(ids[order][own]), cosines)


def _cosines(rows: DataFrame, n_all: int, chars: int, read: Callable[[pa.Table], Sets], unseen: bool) -> DataFrame:
    """id and score, by document frequencies of all sets; unless ``unseen``, grams that no first reference has weigh nothing.

    A chunk's texts are counted where they lie.  It sends its distinct grams' digests, of 64 bits, and how many of its first
    references have each, as a packed row to each bucket of digests; the bucket adds up and answers in the order of asking;
    the chunk then weighs its grams.  Neither grams nor rows of single grams are shuffled.  A bucket has about as
    many grams as a chunk of the largest size.
    """
    buckets = max(8, chars // max(WEIGHED_MOST, math.isqrt(128 * chars)) + 1)

    def dealt(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of digests by bucket, and how many each bucket has."""
        bucket = ((digests & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        return np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)

    def ask(table: pa.Table) -> pa.Table:
        sets, digests, first = read(table), [], []
        for runs in runs_of(sets.words, sets.length) if len(sets.ids) else ():
            digests.append(runs.digests)
            first.append(np.bincount(runs.gram, sets.firsts[runs.text], len(runs.digests)).astype(np.uint32))
        digests, first = np.concatenate([np.zeros(0, np.uint64), *digests]), np.concatenate([np.zeros(0, np.uint32), *first])
        order, each = dealt(digests)
        digests, first, ends = digests[order], first[order], np.cumsum(each)
        asked = np.flatnonzero(each)
        spans = list(zip((ends - each)[asked].tolist(), ends[asked].tolist(), strict=True))
        return pa.table({
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(asked), kind), "bucket": pa.array(asked, pa.int32()),
            "digests": pa.array([digests[a:b].tobytes() for a, b in spans], pa.binary()), "n": pa.array([first[a:b].tobytes() for a, b in spans], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("digests")]
        first = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("n")])
        at, fresh = _alike(np.concatenate(parts))
        starts = np.flatnonzero(fresh)
        df = np.empty(len(at), np.uint32)
        df[at] = np.repeat(np.add.reduceat(first[at], starts, dtype=np.uint32), np.diff(np.r_[starts, len(at)]))
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "df": pa.array([x.tobytes() for x in np.split(df, ends[:-1])], pa.binary())})

    def weigh(table: pa.Table, told: pa.Table) -> pa.Table:
        sets = read(table) if table.num_rows else None
        if not sets or not len(sets.ids):
            return pa.table({"id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        counted = list(runs_of(sets.words, sets.length))
        order, _ = dealt(np.concatenate([runs.digests for runs in counted]))
        answers = told.column("df").combine_chunks()
        df = np.empty(len(order), np.uint32)
        df[order] = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(answers[k].as_buffer(), np.uint32) for k in np.argsort(told.column("bucket").to_numpy()).tolist()]])
        score, at = np.zeros(len(sets.ids)), 0
        for runs in counted:
            of, at = df[at : at + len(runs.digests)], at + len(runs.digests)
            weights = np.log((n_all + 1) / (of + 1.0))
            score += sets.cosines(runs, weights if unseen else np.where(of > 0, weights, 0.0))
        return pa.table({"id": sets.ids, "score": pa.array(score * 10 / 4)})

    told_as = dict(rows.dtypes)["chunk"]
    kind = pa.string() if told_as == "string" else pa.int64()
    asked = rows.groupBy("chunk").applyInArrow(ask, f"chunk {told_as}, bucket int, digests binary, n binary")
    told = asked.groupBy("bucket").applyInArrow(answer, f"chunk {told_as}, bucket int, df binary")
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(weigh, "id long, score double")


def overlap_f1(pairs: DataFrame) -> DataFrame:
    """id and the F1 of the words that both sides have, counted as often as both do."""
    f1 = F.when(F.col("h") + F.col("r") > 0, 2 * F.col("hit1") / (F.col("h") + F.col("r"))).otherwise(0.0)
    return shared_grams(pairs, 1).select("id", f1.alias("f1"))


def common_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence: a row of the table as the bits of one number, where a 0 is a step up."""
    places: dict[str, int] = {}
    for k, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        if m := places.get(w):
            up = row & m
            row = ((row + up) | (row - up)) & full
    return len(b) - row.bit_count()


def rouge_l(pairs: DataFrame) -> DataFrame:
    """id, precision, recall and F1 of the longest common subsequence; with several references of an id, of the best one."""
    rows = rouge_of_sets(pairs.select("id", text.tokens(F.col("hypothesis")).alias("said"), F.array(text.tokens(F.col("reference"))).alias("meant")))
    return rows.groupBy("id").agg(F.max(F.struct("f1", "precision", "recall")).alias("x")).select("id", "x.precision", "x.recall", "x.f1")


def rouge_of_sets(sets: DataFrame) -> DataFrame:
    """``rouge_l`` of id, said and meant, which has the words of each reference, in the rows themselves."""

    def measure(batches):
        for batch in batches:
            for i, j in _slices(batch.column(1), batch.column(2)):
                ids, said, meant = (c.slice(i, j - i) for c in batch.columns)
                best = []
                for h, refs in zip(said.to_pylist(), meant.to_pylist(), strict=True):
                    found = []
                    for r in refs or []:
                        common = common_length(h or [], r or [])
                        p, q = common / len(h) if h else 0.0, common / len(r) if r else 0.0
                        found.append((2 * p * q / (p + q) if p + q > 0 else 0.0, p, q))
                    best.append(max(found, default=(0.0, 0.0, 0.0)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([x[k] for x in best], pa.float64()) for k in (1, 2, 0)]], names=["id", "precision", "recall", "f1"])

    kind = dict(sets.dtypes)["id"]
    return sets.select("id", "said", "meant").mapInArrow(measure, f"id {kind}, precision double, recall double, f1 double")


def _joined(captions: DataFrame, *columns) -> DataFrame:
    """The columns, n (words) and text: the words with spaces between, which is less to send than a list."""
    return captions.select(*columns, F.greatest(F.size("words"), F.lit(0)).alias("n"), F.array_join("words", " ").alias("text"))


def _split(n: pa.Array, joined: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of joined texts, one after the other, and how many each has."""
    lists, n = pc.split_pattern(joined, " "), n.to_numpy()
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    # No words are an empty text, which splits into one empty word.
    words = lists.flatten().filter(pa.array(np.repeat(n > 0, length))) if (n == 0).any() else lists.flatten()
    length[n == 0] = 0
    if (length != n).any():
        raise ValueError("a word has a space")
    return words, length


def vocabulary(captions: DataFrame, least: int = 2, first_id: int = 4) -> DataFrame:
    """Words that occur ``least`` times or more, with ids from ``first_id`` in the order of their first appearance.

    ``captions`` has id and words; ids 0 to 3 are kept for padding, start, end and unknown words.  Words are counted in slices of
    rows before any is shuffled, and have no spaces in them.  Those of captions without an id count, and come last if no other
    caption has them.
    """
    from pyspark.sql import Window

    def count(batches):
        for batch in batches:
            ends, i = np.cumsum(batch.column(1).to_numpy()), 0
            while i < len(ends):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 4 * TOKENS, "right")))
                ids, (words, length), i = batch.column(0).slice(i, j - i), _split(batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i)), j
                coded, of_row = words.dictionary_encode(), ids.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                # Rows in the order of their ids, those without one last.
                order = pc.array_sort_indices(of_row.dictionary).to_numpy()
                rank = np.r_[np.argsort(order), len(order)][of_row.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]
                top, place = int(length.max(initial=0)) + 1, np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
                first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
                np.minimum.at(first, codes, np.repeat(rank, length) * top + place)
                where = pa.array(np.r_[order, 0][first // top], mask=first // top == len(order))
                n = np.bincount(codes, minlength=len(first))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n, pa.int64()), of_row.dictionary.take(where), pa.array(first % top, pa.int64())], names=["word", "n", "id", "place"])

    counted = _joined(captions, "id").mapInArrow(count, f"word string, n long, id {dict(captions.dtypes)['id']}, place long")
    low, high = captions.agg(F.min("id"), F.max("id")).first()
    # One number for id and place: least numbers are found by hashing, least structs by sorting.  Ids too far apart need more digits.
    kind = "long" if (high or 0) - (low or 0) < 1 << 31 else "decimal(20,0)"
    first = (F.col("id") - F.lit(low or 0)).cast(kind) * F.lit(1 << 31).cast("long" if kind == "long" else "decimal(11,0)") + F.col("place")
    words = cut(counted.groupBy("word").agg(F.sum("n").alias("n"), F.min(first).alias("first")).where(F.col("n") >= least))
    words = words.withColumn("part", F.coalesce(F.floor(F.col("first") / (1000 << 31)).cast("long"), F.lit((1 << 63) - 1)))
    sizes = words.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = words.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("first", "word")))
    return ranked.join(before, "part").select("word", "n", (F.col("before") + F.col("r") + (first_id - 1)).cast("long").alias("word_id"))


def _coded(captions: DataFrame, words: DataFrame, batch: str, work, schema: str) -> DataFrame:
    """What ``work`` makes of each chunk of captions: a table of id, batch, n (words) and text (them, with spaces between), the ids of
    the chunk's words (word, word_id), and of each row the longest length of its batch.

    A chunk asks for each of its words once, so a common word is asked for as often as there are chunks, and the captions are
    shuffled once.  A batch may lie in any number of chunks.
    """
    from pyspark.sql import Window

    known = captions.where(F.col("id").isNotNull() & F.col(batch).isNotNull())
    sizes = cut(known.select("id", F.col(batch).alias("batch"), F.greatest(F.size("words"), F.lit(0)).cast("long").alias("n")))
    # Rows of one id are one caption.
    whole = sizes.select("id", "batch", (F.sum("n").over(Window.partitionBy("id")) + 2).alias("n"))
    longest = whole.groupBy("batch").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("k"))
    total = longest.agg(F.sum(F.col("longest") * F.col("k"))).first()[0] or 0
    chunks = total // min(CODED_MOST, max(CODED_LEAST, total // 64)) + 1
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")
    rows = _joined(known, chunk, "id", F.col(batch).alias("batch"))

    def ask(table: pa.Table) -> pa.Table:
        found = [pc.unique(pc.split_pattern(part, " ").flatten()) for part in table.column("text").chunks]
        asked = pc.unique(pa.chunked_array(found, pa.string()))
        return pa.table({"chunk": pa.array(np.full(len(asked), table.column("chunk")[0].as_py()), pa.int32()), "word": asked})

    def answer(table: pa.Table, told: pa.Table) -> pa.Table:
        of_word = told.column("word").is_valid()
        sizes = told.filter(pc.invert(of_word))
        at = pc.index_in(table.column("batch"), value_set=sizes.column("batch").combine_chunks()).to_numpy()
        return work(table, told.filter(of_word).select(["word", "n"]), sizes.column("n").to_numpy()[at])

    asked = rows.groupBy("chunk").applyInArrow(ask, "chunk int, word string")
    ids = asked.join(words.select("word", F.col("word_id").alias("n")), "word").select("chunk", "word", "n", F.lit(None).cast(dict(sizes.dtypes)["batch"]).alias("batch"))
    lengths = sizes.select(chunk, "batch").distinct().join(longest, "batch").select("chunk", F.lit(None).cast("string").alias("word"), F.col("longest").alias("n"), "batch")
    return rows.groupBy("chunk").cogroup(ids.unionByName(lengths).groupBy("chunk")).applyInArrow(answer, schema)


def _ids(table: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The word ids of the table's captions in order, unknown words 3, without start and end; and how many each has."""
    words, length = _split(table.column("n").combine_chunks(), table.column("text").combine_chunks())
    coded = words.dictionary_encode()
    at = pc.index_in(coded.dictionary, value_set=told.column("word").combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
    ids = np.r_[told.column("n").to_numpy(), 3].astype(np.int64)[at][coded.indices.to_numpy(zero_copy_only=False)]
    same = table.column("id").combine_chunks().dictionary_encode()
    if len(same.dictionary) == len(length):
        return ids, length
    # Rows of one id say its words by their places.
    owner = same.indices.to_numpy(zero_copy_only=False)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)
    ids = ids[np.lexsort((ids, place, np.repeat(owner, length)))]
    each = np.bincount(owner, length, len(same.dictionary)).astype(np.int64)
    starts = (np.cumsum(each) - each)[owner]
    length = each[owner]
    return ids[np.repeat(starts - np.cumsum(length) + length, length) + np.arange(length.sum())], length


def _lists(values: pa.Array, length: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int64)), values)


def _ended(ids: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Captions of ``length`` ids one after the other, each between start and end and followed by zeros up to its size."""
    out, first = np.zeros(int(size.sum()), np.int64), np.cumsum(size) - size
    out[first], out[first + length + 1] = 1, 2
    out[np.repeat(first + 1 - np.cumsum(length) + length, length) + np.arange(len(ids))] = ids
    return out


def batched(captions: DataFrame, words: DataFrame, batch: str) -> DataFrame:
    """id, ``batch`` (a column of the captions) and the whole caption's ids, padded with 0 to the longest of its batch.

    Words have no spaces in them.
    """

    def pad(table: pa.Table, told: pa.Table, longest: np.ndarray) -> pa.Table:
        ids, length = _ids(table, told)
        return pa.table({"id": table.column("id"), batch: table.column("batch"), "ids": _lists(pa.array(_ended(ids, length, longest)), longest).cast(pa.list_(pa.int64()))})

    kinds = dict(captions.dtypes)
    return _coded(captions, words, batch, pad, f"id {kinds['id']}, `{batch}` {kinds[batch]}, ids array<long>")


def round_trip(captions: DataFrame, words: DataFrame, batch: str) -> DataFrame:
    """id, ids as ``batched`` gives them, written with spaces between, and caption: what ``decoded`` reads from these ids.

    Captions are decoded where they are encoded, so padded ids are not shuffled.
    """

    def code(table: pa.Table, told: pa.Table, longest: np.ndarray) -> pa.Table:
        ids, length = _ids(table, told)
        whole = _ended(ids, length, length + 2)
        kinds, which = np.unique(whole, return_inverse=True)
        written = pc.binary_join(_lists(pa.array(kinds).cast(pa.string()).take(pa.array(which)), length + 2), " ")
        padded = pc.binary_join_element_wise(written, pc.binary_repeat(" 0", pa.array(longest - length - 2)), "")
        order = np.argsort(told.column("n").to_numpy(), kind="stable")
        numbers, said = told.column("n").to_numpy()[order], np.flatnonzero(whole > 3)
        spoken = told.column("word").combine_chunks().take(pa.array(order)).take(pa.array(np.searchsorted(numbers, whole[said])))
        each = np.bincount(np.repeat(np.arange(len(length)), length + 2)[said], minlength=len(length))
        return pa.table({"id": table.column("id"), "ids": padded.cast(pa.string()), "caption": pc.binary_join(_lists(spoken, each), " ").cast(pa.string())})

    return _coded(captions, words, batch, code, f"id {dict(captions.dtypes)['id']}, ids string, caption string")


def decoded(rows: DataFrame, words: DataFrame) -> DataFrame:
    """id and ``caption``: the words of ids, joined by spaces; padding, start, end and unknown words are skipped."""
    placed = rows.select("id", F.posexplode("ids").alias("place", "word_id")).where("word_id > 3").join(words.select("word", "word_id"), "word_id")
    found = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("x"))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce(F.array_join("x.word", " "), F.lit("")).alias("caption"))


def shifted(rows: DataFrame) -> DataFrame:
    """id, what a decoder is given (ids without the last) and what it is to say (ids without the first)."""
    n = F.size("ids") - 1
    return rows.select("id", F.slice("ids", F.lit(1), n).alias("given"), F.slice("ids", F.lit(2), n).alias("target"))
