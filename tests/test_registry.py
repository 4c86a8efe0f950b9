import os

import duckdb
import pytest

from veridelta.plans import registry as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, bool | str):
        return str(v)
    return f"{round(float(v), 5):g}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_query_against_sql(spark, db, name):
    got = R.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in R.ORACLES:
        assert rows
        return
    want = db.execute(R.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_entry_imports_without_llm():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['veridelta.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'similarity_summary' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
