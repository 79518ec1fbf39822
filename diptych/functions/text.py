"""Text as column expressions: normal forms, tokens, n-grams, slugs, sizes in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    """Lowered, with runs of white space made one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, each joined by spaces; none of a shorter array."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def slug(name: Column) -> Column:
    """Letters and digits, all else as an underscore; none at the ends, and each pair made one, once."""
    return F.replace(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]", "_"), F.lit("_")), F.lit("__"), F.lit("_"))


def human_bytes(n: Column) -> Column:
    """A number of bytes with a fitting unit, one decimal from kilobytes on."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def listed(words: Column) -> Column:
    """Words as English lists them: a, b and c."""
    n = F.size(words)
    first = F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, words[0]).otherwise(F.concat(first, F.lit(" and "), F.element_at(words, -1)))


def coded_captions(text: Column) -> Column:
    """``0:S|1:L:caption`` as an array of place, code and caption; an entry that is not so gives nulls."""
    part = lambda e: F.struct(
        F.nullif(F.regexp_extract(e, r"^(\d+):([A-Z])(?::(.*))?$", 1), F.lit("")).cast("int").alias("place"),
        F.nullif(F.regexp_extract(e, r"^(\d+):([A-Z])(?::(.*))?$", 2), F.lit("")).alias("code"),
        F.nullif(F.regexp_extract(e, r"^(\d+):([A-Z])(?::(.*))?$", 3), F.lit("")).alias("caption"),
    )
    return F.transform(F.split(text, r"\|"), part)
