"""Every registered query of the library against its SQL, or, without SQL, that it gives rows."""

import pytest

from diptych import registry
from tests.compare import rows, sql_rows

SLOW = {"gate_logistic", "gate_gbt"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, folder, name):
    found = registry.queries()[name](spark, folder).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(found) or name == "bbox_overlap_greedy", "the smallest boxes may not overlap"
        return
    wanted = sql_rows(folder, sql)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_names_are_registered_once():
    assert set(registry.oracle_sql()) <= set(registry.queries())
