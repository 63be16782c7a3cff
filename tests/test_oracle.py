"""Every registered query of the volume operators against its SQL, at the smallest scale."""

import compare
import pytest

from voxquarry.plans import catalog

SF = f"{compare.TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, name):
    assert compare.difference(spark, catalog.QUERIES[name], catalog.ORACLE[name], SF) == ""


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
