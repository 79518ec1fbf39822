"""Quality rules: a table of thresholds compiled into one projection, in DataFrame functions only.

Every measure is an expression over one document's text, so the operator adds no shuffle: a scan, a projection, and the
thresholds as one Boolean expression.  Words are runs of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Frequent short words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to in is that it for was with as be by this are or from at not "
    "der die das und in zu den von ist mit nicht ein eine auf des dem sich auch im es "
    "le la les de des et un une en que qui dans pour est pas sur par avec du au "
    "el la los las de y que en un una por con para del se es no lo al como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` (an expression over the measures) is under ``least`` or over ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The method's verdict.  A ratio over no words is 0.
RULES = (
    Rule("mean_word_chars", "word_chars / greatest(n_words, 1)", least=2.0, most=20.0),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", most=0.3),
    Rule("shouts_per_word", "n_shouts / greatest(n_words, 1)", most=0.3),
    Rule("dup_line_share", "n_dup_lines / greatest(n_lines, 1)", most=0.3),
    Rule("stop_word_share", "n_stop_words / greatest(n_words, 1)", least=0.01),
)

def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once however often the body names it.

    A column of its own would do as much in a projection, but a later filter on a measure would be pushed below it and
    there have the column's expression in place of every mention of it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(windows: Column, repeated: Column, few: int = 200) -> Column:
    """The places, ascending, of windows whose value is among the repeated ones.

    With few of these each window is looked up among them.  With many that costs too much: windows are sorted with their
    places, and those that have an equal neighbour are taken.
    """
    looked_up = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(repeated, F.get(windows, i)))
    pairs = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def neighbours(p: Column) -> Column:
        same = lambda x, i: x["h"].eqNullSafe(F.get(p, i - 1)["h"]) | x["h"].eqNullSafe(F.get(p, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(p, same), lambda x: x["p"]))

    return F.when(F.size(repeated) <= few, looked_up).otherwise(_let(pairs, neighbours))


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that occur twice or more.

    A text without a repeated window ends at the first test.  Else the values that repeat are neighbours in a sorted copy;
    each place that has one adds the words that it covers beyond the place before.
    """
    none = F.array().cast("array<bigint>")

    def windows_of(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))).otherwise(none)

    def covered(at: Column) -> Column:
        more = lambda n, i: n + F.when(i < F.size(at), F.least(F.lit(width), F.get(at, i) - F.get(at, i - 1))).otherwise(0)
        return F.lit(width) + F.aggregate(F.sequence(F.lit(1), F.size(at)), F.lit(0), more)

    def counted(w: Column) -> Column:
        repeated = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
        found = _let(F.sort_array(w), lambda s: _let(repeated(s), lambda r: _let(_places(w, r), covered)))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(found)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows_of(h), counted))


def measured(documents: DataFrame, width: int = 5) -> DataFrame:
    """The documents' doc_id with their measures; a null text measures 0 throughout.

    n_words; word_chars, the code points in words; n_symbols, the characters of ``#*$%&|<>``; n_lines, the lines with a
    word; n_dup_lines, those equal to an earlier line of the text; n_repeat_words, the words in ``width``-word windows
    that the text has twice or more; n_stop_words, words of the stop list in lower case; n_shouts, the characters ``!``
    and ``?``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w, width).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    without = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")
    step = documents.select(
        "doc_id", _let(_words(text), of_words).alias("__words"), _let(lines, of_lines).alias("__lines"),
        without(_SYMBOLS).alias("n_symbols"), without("!?").alias("n_shouts"), F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
    )
    return step.select("doc_id", "__words.n_words", "word_chars", "n_symbols", "__lines.n_dup_lines", "__words.n_repeat_words", "__lines.n_lines", "__words.n_stop_words", "n_shouts")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table fails; one expression over the measures."""
    out = F.lit(True)
    for rule in rules:
        value = F.expr(rule.measure)
        if rule.least is not None:
            out = out & (value >= rule.least)
        if rule.most is not None:
            out = out & (value <= rule.most)
    return out


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed (under 10 words, or over a fifth of them in repeated 5-word windows) and kept.

    Nulls and empty texts measure 0 and so fail; repeated rows are judged alike; other columns are not read.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured(documents).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
