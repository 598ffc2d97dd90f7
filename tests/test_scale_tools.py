"""Selection and scans against numpy, with bounds so small that every step runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.functions import scan, select


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    parts = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 3, 2000).astype(float), "heavy": np.exp(8 * rng.normal(size=1500)), "one": np.array([2.5]), "same": np.full(900, -1.0)}
    rows = [(k, float(x)) for k, v in parts.items() for x in v] + [("none", None), ("normal", None)]
    return parts, spark.createDataFrame(rows, "k string, v double").repartition(6)


@pytest.mark.parametrize("small", [50, 20_000])
def test_quantiles_by_key(values, small):
    parts, df = values
    probabilities = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.k: r.q for r in select.exact_quantiles(df, F.col("v"), probabilities, "k", small=small).collect()}
    assert got.pop("none") is None and set(got) == set(parts)
    for k, q in got.items():
        np.testing.assert_allclose(q, np.quantile(parts[k], probabilities), rtol=1e-12)


def test_quantiles_of_all(spark, values):
    parts, df = values
    whole = np.concatenate(list(parts.values()))
    np.testing.assert_allclose(select.exact_quantiles(df, F.col("v"), [0.1, 0.9], small=100).first().q, np.quantile(whole, [0.1, 0.9]), rtol=1e-12)
    assert select.exact_quantiles(df.limit(0), F.col("v"), [0.5]).first().q is None


def test_numbers_and_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 50 == 0 else k % 3, int(x), k) for k, x in enumerate(rng.permutation(1000))]
    df = spark.createDataFrame(rows, "g int, x int, id int").repartition(5)
    want = {}
    for g in (None, 0, 1, 2):
        own, total = sorted((x, i) for h, x, i in rows if h == g), 0
        for place, (x, i) in enumerate(own):
            total += x
            want[i] = (place, len(own), total)
    got = scan.numbered(df, ["x"], "g", n="n").join(scan.running_sum(df, F.col("x"), ["x"], "g").select("id", "total"), "id")
    assert {r.id: (r.place, r.n, r.total) for r in got.collect()} == want
    all_ = scan.numbered(df, [F.desc("x")]).collect()
    assert all(r.place == 999 - r.x for r in all_)
