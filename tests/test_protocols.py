"""Queries over one protocol each against their SQL."""

import pytest

from compare import difference, views
from tidewire.plans import protocols


@pytest.mark.parametrize("name", sorted(protocols.ORACLE))
def test_sql(spark, data, name):
    assert difference(protocols.QUERIES[name](spark, data), views(data), protocols.ORACLE[name]) == ""


def test_every_query_has_sql():
    assert set(protocols.QUERIES) == set(protocols.ORACLE)
