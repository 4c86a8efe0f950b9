"""Every registered query on the small tables: it runs, and results fit plain counts."""

import os

import pytest

from veridelta.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, name):
    rows = Q.QUERIES[name](spark, SF).collect()
    n = {"op1_warc": "pages", "op8_nn_descent": None, "op7_licences": None, "op3_mixture": None}.get(name, "documents")
    if n:
        assert len(rows) == Q.table(spark, SF, n).count()
    assert rows
