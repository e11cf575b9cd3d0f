import os

import pytest

from kinweave.llm import catalog
from oracle import DATA, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    agree(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_columns(spark):
    want = {"p1_found": ["record_id_1", "record_id_2"], "p2_found": ["row_id_1", "row_id_2"], "p5_found": ["row_id_1", "row_id_2"], "p10_found": ["doc_id"], "p8_ids": ["doc_id", "ids"]}
    for name, cols in want.items():
        df = catalog.queries()[name](spark, DATA)
        assert df.columns == cols
        if name != "p8_ids":
            assert df.count() == df.distinct().count() > 0
