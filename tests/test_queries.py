"""Every registered query with SQL against DuckDB on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from tessella.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: "null" if x is None or x != x else round(float(x), 6) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x)
    return sorted(map(str, ([cell(x) for x in r] for r in frame.itertuples(index=False))))


@pytest.fixture(scope="module")
def results(spark, request):
    """Each chosen query's result, several at a time."""
    chosen = [i.callspec.params["name"] for i in request.session.items if i.fspath == request.fspath and hasattr(i, "callspec")]
    found = registry.queries()
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(lambda n=n: found[n](spark, SF).toPandas()) for n in chosen}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(results, duck, name):
    got = results[name].result()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and len(a) > 0
    assert a == b
