"""Screening: ordered limits, verdicts on model answers, reconciled and human-first labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_failing(limits: Sequence[tuple[str, Column, float]]) -> Column:
    """The name of the first measure that is over its limit (strictly), null if none is."""
    return F.coalesce(*[F.when(measure > limit, F.lit(name)) for name, measure, limit in limits], F.lit(None).cast("string"))


def json_in(text: Column) -> Column:
    """What lies from the first opening to the last closing brace of a text, null if there is no such part."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def whole_number(json: Column, path: str) -> Column:
    """A number of a JSON text, cut to a whole one; null where it is missing or is no number."""
    return F.get_json_object(json, path).try_cast("double").cast("int")


def haze_verdict(hazes: Sequence[Column], clouds: Sequence[Column], reject_at: int = 2) -> Column:
    """unparsed if any rating is missing; reject if the worst haze reaches ``reject_at`` or the worst cloud 2; else keep."""
    missing = F.lit(False)
    for c in [*hazes, *clouds]:
        missing = missing | c.isNull()
    worst = lambda cs: F.array_max(F.array(*cs))
    return F.when(missing, "unparsed").when((worst(hazes) >= reject_at) | (worst(clouds) >= 2), "reject").otherwise("keep")


def closed_answer(text: Column, known: Sequence[str]) -> Column:
    """An answer, trimmed, lowered and without a final stop, if it is one of the known; else unparsed."""
    plain = F.trim(F.regexp_replace(F.lower(F.trim(text)), r"^\.+|\.+$", ""))
    return F.when(plain.isin(list(known)), plain).otherwise("unparsed")


def reconciled(first: Column, confidence: Column, second: Column, changed: Column, least: float = 0.9, least_changed: float = 0.02) -> Column:
    """A sure finding that a second model and the pixels confirm; one that is not is seasonal if the second says so."""
    sure = (first == "land_use") & (confidence >= least)
    confirmed = sure & (second == "land_use") & (changed >= least_changed)
    return F.when(confirmed, "land_use").when((first == "land_use") & (second == "seasonal"), "seasonal").when(first == "land_use", "none").otherwise(first)


def human_first(human: Column, machine: Column, mapped: Mapping[str, str]) -> Column:
    """The human label, or what the machine's stands for, or cant_tell."""
    table = F.create_map(*[F.lit(x) for pair in mapped.items() for x in pair])
    return F.coalesce(human, F.try_element_at(table, machine), F.lit("cant_tell"))


def transient(error: Column, marks: Sequence[str]) -> Column:
    """Whether an error's text, lowered, holds any of the marks."""
    low = F.lower(error)
    out = F.lit(False)
    for m in marks:
        out = out | low.contains(m)
    return F.coalesce(out, F.lit(False))


def wait_seconds(attempt: Column, first: float = 20.0, factor: float = 2.0) -> Column:
    """How long to wait before a try: growing by a factor from the first."""
    return F.lit(first) * F.pow(F.lit(factor), attempt)
