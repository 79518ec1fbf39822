"""The queries of the library's own operators, by name, and the SQL that says what they must return."""

from __future__ import annotations

from diptych.plans import captions, colours, geometry, images, joins, learning, logs, placing, rasters, samples, scoring, screening, status, streams, vectors  # noqa: F401
from diptych.plans.catalog import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
