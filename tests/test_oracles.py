"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from lagloom.plans import registry


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in data), key=lambda r: [(x is not None, str(x)) for x in r])


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a is None and b is None or str(a).replace("+00:00", "") == str(b).replace("+00:00", "")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.fixture(scope="module")
def results(request, spark, sf_dir):
    """Columns and rows of the queries chosen, four of them running at a time while earlier ones are compared."""

    def run(name):
        got = registry.QUERIES[name](spark, sf_dir)
        return got.columns, [tuple(r) for r in got.collect()]

    names = [i.callspec.params["name"] for i in request.session.items if i.function is test_query_equals_sql]
    with ThreadPoolExecutor(4) as pool:
        waiting = {n: pool.submit(run, n) for n in names}
        yield waiting
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(results, duck, name):
    got, data = results.pop(name).result()
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got)
    g, w = rows(got, data), rows(columns, want.fetchall())
    assert len(g) == len(w)
    key = lambda r: [x if not isinstance(x, float) else None for x in r]
    g, w = sorted(g, key=lambda r: str(key(r)) + str(r)), sorted(w, key=lambda r: str(key(r)) + str(r))
    assert all(same(x, y) for a, b in zip(g, w, strict=True) for x, y in zip(a, b, strict=True)), [(a, b) for a, b in zip(g, w, strict=True) if not all(map(same, a, b))][:3]
