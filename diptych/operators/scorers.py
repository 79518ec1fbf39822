"""Models as pluggable scorers: what surrounds a model, its batches, retries and answers, without the model."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


class Scorer(ABC):
    """Scores batches of prompts; it is sent to the executors, so what it needs is opened in ``open``."""

    def open(self) -> None:
        """Called once in each task."""

    @abstractmethod
    def score(self, prompts: Sequence[str]) -> Sequence[str]:
        """An answer for each prompt."""


class TooLarge(Exception):
    """A batch did not fit; it is tried again in halves."""


def in_halves(scorer: Scorer, prompts: Sequence[str]) -> list[str]:
    try:
        return list(scorer.score(prompts))
    except TooLarge:
        if len(prompts) < 2:
            raise
        middle = len(prompts) // 2
        return in_halves(scorer, prompts[:middle]) + in_halves(scorer, prompts[middle:])


def scored(frame: DataFrame, prompt: str, scorer: Scorer, name: str = "answer", tries: int = 4, wait: float = 5.0) -> DataFrame:
    """The frame with each prompt's answer; a batch that fails is tried again after growing waits, and then fails its task."""
    columns = frame.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer.open()
        for batch in batches:
            for attempt in range(tries):
                try:
                    answers = in_halves(scorer, batch[prompt].tolist())
                    break
                except TooLarge:
                    raise
                except Exception:
                    if attempt + 1 == tries:
                        raise
                    time.sleep(wait * 2**attempt)
            yield batch.assign(**{name: answers})[[*columns, name]]

    return frame.mapInPandas(run, f"{', '.join(f'`{n}` {k}' for n, k in frame.dtypes)}, `{name}` string")


def decoded(frame: DataFrame, prompt: str, scorer: Scorer, end: str, longest: int, start: str | None = None) -> DataFrame:
    """The frame with ``tokens``, an array that the scorer makes token by token until it says ``end`` or has said ``longest``.

    The scorer is asked with the JSON of ``prompt`` and the ``tokens`` so far (``start`` before them, if given), and answers the
    next one.  Each round asks for the sequences that are still open alone, so batches shrink; what is done is kept apart.
    Neither ``start`` nor ``end`` is among the tokens; a null prompt has none; equal rows are asked for each by itself.
    """
    none = F.array().cast("array<string>")
    open_, done = cut(frame.withColumn("tokens", none)), []
    done.append(open_.where(F.col(prompt).isNull()))
    open_ = open_.where(F.col(prompt).isNotNull())
    for _ in range(longest):
        if open_.isEmpty():
            break
        said = F.col("tokens") if start is None else F.concat(F.array(F.lit(start)), F.col("tokens"))
        asked = open_.withColumn("__asked", F.to_json(F.struct(F.col(prompt).alias("prompt"), said.alias("tokens"))))
        told = cut(scored(asked, "__asked", scorer, "__next").drop("__asked"))
        closed = F.coalesce(F.col("__next") == end, F.lit(True))
        done.append(told.where(closed).drop("__next"))
        open_ = told.where(~closed).withColumn("tokens", F.concat("tokens", F.array("__next"))).drop("__next")
    return reduce(DataFrame.unionByName, [*done, open_])
