"""A hidden Markov language model: Baum-Welch counts summed over all partitions, exact likelihoods by scaled forward steps.

A text is its words and an end.  A state draws a class of words, and the class a word by its add-one count in the training
texts: P(word | state) = P(class | state) * (count + 1) / size(class), where a class's size is the sum of these counts.  Words
that make up a share of one in HEAD of all training tokens, and are seen LEAST_OWN times, are classes of their own, so there
are at most HEAD of these however large the corpus is, and their letters together are bounded by HEAD times the mean length
of a word; rarer words share classes by their last three bytes, and with them, as one word of count 0, all unknown ones
that end so.  A text's likelihood is its add-one unigram likelihood times that of its classes relative to it, which is
what the forward steps compute.

At scale: texts are dealt into chunks of bounded size, and a chunk asks for the counts of its rarer words by a join on
the word, one row for each chunk and word.  Classes are stored, and each round of Baum-Welch reads them where they lie; a task
sends a row for each class that it met.  The model that is broadcast has HEAD + TAIL rows of STATES numbers at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .frames import checkpointed
from .vocabulary import ENCODED_BYTES, bytes_of, encoded
from .words import SPACED, mix, slices

#: Hidden states; rounds over the whole training corpus, and before these over disjoint parts of it, which together are the whole.
STATES, ROUNDS, PART_ROUNDS = 12, 3, 12
#: Documents of a part at least; a corpus that has not so many for each of PART_ROUNDS parts has fewer parts and goes through them again.
PART_DOCUMENTS = 500
#: What earlier parts' counts weigh when the next part's are added.
CARRIED = 0.5
#: A word with one in HEAD of all tokens, and LEAST_OWN of them, is a class of its own; others share TAIL classes.
HEAD, LEAST_OWN, TAIL = 1 << 18, 20, 1 << 13
#: Tokens of the unigram distribution that each state is given beforehand, for each class that it met, and transitions to each state.
PRIOR, PRIOR_STEPS = 1.0, 1.0
#: Texts side by side, and tokens of them held at once.
_LANES, _HELD = 1024, 1 << 19

#: The end's class and the first of the words; the end is written as the empty word, which no word is.
_END, _FIRST = 0, 1
_ADDED = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def kind_of(classes: int) -> type:
    return np.uint16 if classes <= 1 << 16 else np.uint32


@dataclass
class Vocabulary:
    """Training tokens and distinct ones, and the words with classes of their own with their counts, by class."""

    tokens: int
    distinct: int
    ends: int
    own: pa.Array
    counts: np.ndarray

    @property
    def classes(self) -> int:
        return _FIRST + len(self.own) + TAIL

    @property
    def kind(self) -> type:
        """How a class is written."""
        return kind_of(self.classes)

    def tail_class(self, words: pa.Array) -> np.ndarray:
        """The shared class of each word, by its last three bytes."""
        data, at = bytes_of(words)
        data = np.r_[np.zeros(3, np.uint8), data].astype(np.uint64)
        size, ends = np.diff(at), at[1:] + 3
        ending = np.minimum(size, 3).astype(np.uint64)
        for k in range(1, 4):
            ending = ending << np.uint64(8) | np.where(size >= k, data[ends - k], np.uint64(0))
        with np.errstate(over="ignore"):
            return _FIRST + len(self.own) + (mix(ending) % np.uint64(TAIL)).astype(np.int64)


@dataclass
class Model:
    """Shares of first states, of steps between states, and for each class how much likelier its words are in a state than by counts alone."""

    first: np.ndarray
    steps: np.ndarray
    ratios: np.ndarray


def counted(documents: DataFrame) -> DataFrame:
    """word and n for each distinct token of the texts; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(0), ENCODED_BYTES):
                e = encoded(data, offsets, SPACED)
                words, n = pa.concat_arrays([e.terms.cast(pa.string()), pa.array([""])]), np.r_[np.bincount(e.codes, minlength=len(e.terms)), j - i]
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    return documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    tokens, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))).first()
    own = counts.where((F.col("word") != "") & (F.col("n") >= LEAST_OWN) & (F.col("n") >= F.lit(tokens) / HEAD)).orderBy(F.desc("n"), "word").collect()
    return Vocabulary(tokens, distinct, ends, pa.array([r["word"] for r in own], pa.large_string()), np.array([r["n"] for r in own], np.int64))


def class_sizes(counts: DataFrame, known: Vocabulary) -> np.ndarray:
    """The sum of the add-one counts of each class; every shared class has an unknown word of count 0."""
    held = counts.sparkSession.sparkContext.broadcast(known)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).cast(pa.large_string())
            rare = np.flatnonzero(~pc.is_in(words, value_set=held.value.own).to_numpy(zero_copy_only=False))
            kind, where = np.unique(held.value.tail_class(words.take(pa.array(rare))), return_inverse=True)
            n = np.zeros(len(kind), np.int64)
            np.add.at(n, where, batch.column(1).to_numpy()[rare] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(n, pa.int64())], names=["class", "n"])

    rows = counts.where("word <> ''").select("word", "n").mapInArrow(total, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    out = np.ones(known.classes)
    out[_END] = known.ends + 1
    out[_FIRST : _FIRST + len(known.own)] = known.counts + 1
    for r in rows:
        out[r["class"]] += r["n"]
    return out


def as_classes(documents: DataFrame, counts: DataFrame, known: Vocabulary, keep: list[str]) -> DataFrame:
    """``keep`` of the documents' columns, n_tokens, n_known, base_score (log10) and __classes, those of the tokens in order, packed."""
    held = documents.sparkSession.sparkContext.broadcast(known)
    n = X.sizes(documents.select("text"), 0.5)
    chunks = X.chunked(documents.select(*[f"`{c}`" for c in keep], "text"), n)

    def ask(table: pa.Table) -> pa.Table:
        rare = []
        for _, _, data, offsets in slices(table.column("text"), ENCODED_BYTES):
            terms = encoded(data, offsets, SPACED).terms
            rare.append(terms.filter(pc.invert(pc.is_in(terms, value_set=held.value.own))))
        words = pc.unique(pa.chunked_array(rare, pa.large_string())).cast(pa.string())
        return pa.table({"chunk": pa.array(np.full(len(words), table.column(X.CHUNK)[0].as_py()), pa.int32()), "word": words})

    def encode(table: pa.Table, told: pa.Table) -> pa.Table:
        v = held.value
        rare, of_rare = told.column("word").combine_chunks().cast(pa.large_string()), told.column("n").to_numpy()
        classes, n_tokens, n_known, base = [], [], [], []
        for i, j, data, offsets in slices(table.column("text"), ENCODED_BYTES):
            e = encoded(data, offsets, SPACED)
            count, kind = np.zeros(len(e.terms), np.int64), v.tail_class(e.terms)
            for words, numbers in ((v.own, v.counts), (rare, of_rare)):
                found = pc.index_in(e.terms, value_set=words)
                has = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                at = found.take(pa.array(has)).to_numpy(zero_copy_only=False).astype(np.int64)
                count[has] = numbers[at]
                if words is v.own:
                    kind[has] = _FIRST + at
            owner, per = e.owner(), np.diff(e.first)
            part = lambda c: np.log10((c + 1) / (v.tokens + v.distinct + 1))
            base.append(np.bincount(owner, part(count)[e.codes], j - i) + part(v.ends))
            n_known.append(np.bincount(owner, (count > 0)[e.codes], j - i).astype(np.int64) + (v.ends > 0))
            n_tokens.append(per + 1)
            row = np.full(len(owner) + j - i, _END, v.kind)
            row[np.arange(len(owner)) + owner] = kind[e.codes]
            classes += np.split(row, np.cumsum(per + 1)[:-1])
        whole = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        packed = pa.array([c.tobytes() for c in classes], pa.binary())
        made = {"n_tokens": pa.array(whole(n_tokens, np.int64)), "n_known": pa.array(whole(n_known, np.int64)), "base_score": pa.array(whole(base, float)), "__classes": packed}
        return pa.table({**{c: table.column(c) for c in keep}, **made})

    asked = X.per_chunk(chunks, ask, "chunk int, word string")
    told = asked.join(counts, "word").select("chunk", "word", "n")
    fields = [documents.schema[c] for c in keep] + [T.StructField(c, k) for c, k in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("__classes", T.BinaryType()))]
    return X.answered(chunks, told, encode, T.StructType(fields))


class _Lanes:
    """Some sequences side by side, the longest first: tokens in order of time, those of one time in order of the lanes."""

    def __init__(self, values: np.ndarray, first: np.ndarray, length: np.ndarray):
        n = np.bincount(length, minlength=int(length[0]) + 1)
        self.start = np.r_[0, np.cumsum(len(length) - np.cumsum(n)[:-1])]
        lane = np.repeat(np.arange(len(length)), length)
        time = np.arange(len(lane)) - np.repeat(np.cumsum(length) - length, length)
        self.values = np.empty(len(lane), values.dtype)
        self.values[self.start[time] + lane] = values[np.repeat(first, length) + time]
        self.times = len(self.start) - 1

    def windows(self) -> list[tuple[int, int]]:
        """Runs of times with about _HELD tokens each, so that a text of any length is held in parts."""
        out, t = [], 0
        while t < self.times:
            u = max(t + 1, int(np.searchsorted(self.start, self.start[t] + _HELD, "right")) - 1)
            out.append((t, min(u, self.times)))
            t = out[-1][1]
        return out


def lanes(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, _Lanes]]:
    """The packed sequences of a column, none of them empty, in lanes of similar length, with their rows."""
    _, ends, data = column.cast(pa.large_binary()).buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
    values, length = np.frombuffer(data, kind), np.diff(ends)
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), _LANES):
        rows = order[k : k + _LANES]
        yield rows, _Lanes(values, ends[:-1][rows], length[rows])


def _turned(model: Model) -> Model:
    """The model with ratios by state and class, as the steps of many sequences side by side read them."""
    return Model(model.first, model.steps, np.ascontiguousarray(model.ratios.T))


def _forward(model: Model, at: _Lanes, window: tuple[int, int], now: np.ndarray | None, logs: np.ndarray, keep: bool):
    """Forward steps of a turned model through a window from the state shares ``now`` (by state and lane) before it; adds each lane's logarithms to ``logs``."""
    low, high = at.start[window[0]], at.start[window[1]]
    ratios = np.take(model.ratios, at.values[low:high], axis=1)
    shares, norms = (np.empty_like(ratios), np.empty(ratios.shape[1], ratios.dtype)) if keep else (None, None)
    onward = np.ascontiguousarray(model.steps.T)
    for t in range(*window):
        a, b = at.start[t] - low, at.start[t + 1] - low
        now = np.repeat(model.first[:, None], b - a, 1) if now is None else onward @ now[:, : b - a]
        now *= ratios[:, a:b]
        norm = now.sum(0)
        now /= norm
        logs[: b - a] += np.log(norm)
        if keep:
            shares[:, a:b], norms[a:b] = now, norm
    return now, ratios, shares, norms


def gains(column: pa.Array, model: Model) -> np.ndarray:
    """The log10 likelihood of each sequence of classes relative to that by counts alone."""
    out, turned = np.zeros(len(column)), _turned(model)
    for rows, at in lanes(column, kind_of(len(model.ratios))):
        now, logs = None, np.zeros(len(rows))
        for window in at.windows():
            now, *_ = _forward(turned, at, window, now, logs, False)
        out[rows] = logs / np.log(10)
    return out


@dataclass
class Expected:
    """Expected numbers of first states, of steps, and of classes by state; and the logarithm of the relative likelihood."""

    first: np.ndarray
    steps: np.ndarray
    classes: np.ndarray
    gain: float

    @staticmethod
    def none(classes: int, states: int) -> Expected:
        return Expected(np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), 0.0)

    def after(self, earlier: Expected, weight: float) -> Expected:
        """These numbers, and earlier ones with that weight."""
        return Expected(*[getattr(self, c) + weight * getattr(earlier, c) for c in ("first", "steps", "classes", "gain")])

    def add(self, column: pa.Array, model: Model) -> None:
        turned, classes = _turned(model), np.zeros(self.classes.shape[::-1])
        for rows, at in lanes(column, kind_of(len(model.ratios))):
            windows, entries, now, logs = at.windows(), [], None, np.zeros(len(rows))
            for window in windows[:-1]:
                entries.append(now)
                now, *_ = _forward(turned, at, window, now, logs, False)
            entries.append(now)
            message = None
            for k in range(len(windows) - 1, -1, -1):
                last = k == len(windows) - 1
                _, ratios, shares, norms = _forward(turned, at, windows[k], entries[k], logs if last else np.zeros(len(rows)), True)
                low = at.start[windows[k][0]]
                for t in range(windows[k][1] - 1, windows[k][0] - 1, -1):
                    a, b = at.start[t] - low, at.start[t + 1] - low
                    # Ends of sequences weigh 1; of the others, what the next step says.
                    after = np.ones((len(model.first), b - a), ratios.dtype)
                    if message is not None:
                        on = message.shape[1]
                        after[:, :on] = model.steps @ message
                        self.steps += shares[:, a : a + on] @ message.T
                    message = ratios[:, a:b] * after
                    message /= norms[a:b]
                    shares[:, a:b] *= after
                if windows[k][0] == 0:
                    self.first += shares[:, : at.start[1]].sum(1)
                values = at.values[low : at.start[windows[k][1]]]
                for s in range(len(model.first)):
                    classes[s] += np.bincount(values, shares[s], len(self.classes))
            self.gain += logs.sum()
        self.classes += classes.T


def expected(sequences: DataFrame, model: Model) -> Expected:
    """Baum-Welch counts of all sequences (__classes): each task's are summed up as rows by class.  Steps are in single precision."""
    held = sequences.sparkSession.sparkContext.broadcast(Model(*[x.astype(np.float32) for x in (model.first, model.steps, model.ratios)]))
    states, classes = len(model.first), len(model.ratios)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Expected.none(classes, states)
        for batch in batches:
            if batch.num_rows:
                out.add(batch.column(0), held.value)
        met = np.flatnonzero(out.classes.any(1))
        if len(met):
            rows = np.concatenate([out.classes[met], out.steps * model_steps(held.value), out.first[None], np.full((1, states), out.gain / states)])
            keys = np.r_[met, -1 - np.arange(states + 2)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(rows[:, k].astype(np.float32)) for k in range(states)]], names=["class", *[f"e{k}" for k in range(states)]])

    schema = "class int, " + ", ".join(f"e{k} float" for k in range(states))
    out = Expected.none(classes, states)
    for r in sequences.select("__classes").mapInArrow(add_up, schema).groupBy("class").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(states)]).collect():
        key, row = r[0], np.array(r[1:])
        if key >= 0:
            out.classes[key] = row
        elif key >= -states:
            out.steps[-1 - key] = row
        elif key == -1 - states:
            out.first = row
        else:
            out.gain = float(row.sum())
    return out


def model_steps(model: Model) -> np.ndarray:
    """Expected steps are gathered without the share of the step itself, which is the same for all of them."""
    return model.steps


def started(classes: int, states: int) -> Model:
    """Where the rounds start: states that last, and draw classes a little unlike each other."""
    draw = np.random.default_rng(13)
    steps = np.full((states, states), 0.3 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(steps, 0.7)
    return Model(np.full(states, 1 / states), steps, 0.5 + draw.random((classes, states)))


def learned(found: Expected, sizes: np.ndarray, whole: float) -> Model:
    """The model of expected counts, each with its prior; no ratio is 0, so every text has a likelihood.

    ``whole`` is what add-one counts are divided by when they are taken alone.  A state's prior is of the unigram distribution
    and weighs as much as the classes that the state met, so the more its words vary, the more is left for others.
    """
    first, steps, met = found.first + PRIOR_STEPS, found.steps + PRIOR_STEPS, found.classes
    prior = PRIOR * ((met > 0.5).sum(0) + 1)
    drawn = (met + prior * (sizes / sizes.sum())[:, None]) / (met.sum(0) + prior)
    return Model(first / first.sum(), steps / steps.sum(1, keepdims=True), drawn * (whole / sizes)[:, None])


def fit(sequences: DataFrame, sizes: np.ndarray, known: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """The model of the training sequences (__classes, __draw): rounds over parts of them, then over all.

    Each document is in one part, and each part in one round of the first ones (in several, if there are fewer parts than
    rounds); their counts are carried on, so the last rounds start from what the whole corpus says.  Without any documents,
    words are as likely as by counts alone.
    """
    if not known.tokens:
        return Model(np.ones(1), np.ones((1, 1)), np.ones((len(sizes), 1)))
    whole, model, carried = known.tokens + known.distinct + 1, started(len(sizes), states), None
    parts = max(1, min(PART_ROUNDS, known.ends // PART_DOCUMENTS))
    # A task sends a row for each class that it met, so a part has fewer tasks than the whole.
    tasks = max(8, sequences.rdd.getNumPartitions() // parts)
    for k in range(PART_ROUNDS):
        part = sequences.where(F.pmod("__draw", F.lit(parts)) == k % parts).coalesce(tasks) if parts > 1 else sequences
        found = expected(part, model)
        carried = found.after(carried, CARRIED) if carried and parts > 1 else found
        model = learned(carried, sizes, whole)
    for _ in range(rounds):
        model = learned(expected(sequences, model), sizes, whole)
    return model


def score(documents: DataFrame, train: str = "true", keep: list[str] | None = None, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """The documents (``keep`` of their columns) with n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the documents that pass ``train`` (a SQL condition; null does not pass).  Tokens are runs of
    characters other than space and U+0009..U+000D, A-Z lowered, and one end.  base_score is the log10 likelihood by add-one
    counts, score that of the hidden Markov model; a null or empty text is an end alone.  Equal texts score alike; repeated rows
    count each; an empty table has no rows, and without training documents every token is unknown and both scores are 0.
    A column with an added one's name is replaced.
    """
    keep = [c for c in documents.columns if (keep is None or c in keep) and c.lower() not in _ADDED and c != "text"]
    draw = F.xxhash64(F.lit(13), *[F.col(f"`{c}`") for c in ("doc_id", "text") if c in documents.columns])
    rows = documents.select(*[f"`{c}`" for c in keep], F.col("text"), F.coalesce(F.expr(train), F.lit(False)).alias("__train"), draw.alias("__draw"))
    counts = checkpointed(counted(rows.where("__train")))
    known = vocabulary(counts)
    sizes = class_sizes(counts, known)
    found = checkpointed(as_classes(rows, counts, known, [*keep, "__train", "__draw"]))
    model = found.sparkSession.sparkContext.broadcast(fit(found.where("__train"), sizes, known, states, rounds))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            gain = gains(column("__classes"), model.value) if batch.num_rows else np.zeros(0)
            made = [column("n_tokens"), column("n_known"), pa.array(np.full(len(gain), known.tokens), pa.int64()), column("base_score"), pa.array(column("base_score").to_numpy() + gain)]
            yield pa.RecordBatch.from_arrays([column(c) for c in keep] + made, names=[*keep, *_ADDED])

    fields = [documents.schema[c] for c in keep] + [T.StructField(c, T.LongType() if c in _ADDED[:3] else T.DoubleType()) for c in _ADDED]
    return found.mapInArrow(judge, T.StructType(fields))
