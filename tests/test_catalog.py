"""Every registered query of the core against its SQL, over whole tables."""

import pytest
from conftest import SMALL
from oracle import assert_same, connect, rows_of

from aula.plans import catalog


@pytest.fixture(scope="module", params=[SMALL])
def where(request):
    return request.param, connect(request.param)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"p5_found", "p5_periods"}))
def test_query(spark, where, name):
    d, con = where
    df = catalog.QUERIES[name](spark, d)
    if name in catalog.SQL:
        assert_same(df, con, catalog.SQL[name])
    else:
        rows_of(df)
