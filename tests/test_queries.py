import os

import pytest

from kinweave.plans import catalog
from oracle import DATA, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    agree(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    assert catalog.entry(spark, DATA).columns == ["record_id", "group_id", "n_records"]
