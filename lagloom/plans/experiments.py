"""Monte-Carlo studies and model comparisons: a grid of cells as rows, solved cell by cell or panel by panel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions import panel as P
from lagloom.functions import synth
from lagloom.operators import align as A
from lagloom.operators import cluster as C
from lagloom.operators import estimate as E
from lagloom.operators import evaluate as V
from lagloom.operators import trade as T

RUNS = "n int, k int, sigma double, repeat int, cost double, error double, p_error double, iterations int"


def planted_moments(x: np.ndarray, p: np.ndarray, sigma: float) -> E.Moments:
    """The moments that infinitely many observations would have."""
    n = x.shape[1]
    h = np.fft.fft(x, axis=1)
    m = E.Moments(0.0, np.zeros(n), np.zeros((n, n), complex), sigma)
    mean = float(p @ x.mean(1))
    b = np.einsum("k,ka,kb,kab->ab", p, h, h.conj(), h[:, m.at])
    return E.Moments(mean, p @ np.abs(h) ** 2 + n * sigma**2, b + n * n * sigma**2 * mean * m.bias, sigma)


def recovery_grid(spark: SparkSession, ns: list[int], ks: list[int], sigmas: list[float], repeats: int, free_p: bool = True) -> DataFrame:
    """One row for each cell and repeat: cost and error of the signals recovered from planted moments, a task each."""
    cells = [(n, k, s, r) for n in ns for k in ks for s in sigmas for r in range(repeats)]
    grid = spark.createDataFrame(cells, "n int, k int, sigma double, repeat int").repartition(min(len(cells), 64), "n", "k", "sigma", "repeat")

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, k, s, r in zip(df.n, df.k, df.sigma, df.repeat, strict=True):
            rng = np.random.default_rng([int(n), int(k), int(r)])
            x, p = rng.standard_normal((k, n)), np.array(synth.proportions(int(k), int(r))) if free_p else np.full(k, 1 / k)
            moments = planted_moments(x, p, s)
            got = min((E.match_moments(moments, int(k), seed, free_p) for seed in range(3)), key=lambda g: g["cost"])
            order, aligned = A.align_signals(np.array(got["x"]), x)
            error = np.linalg.norm(aligned - x) / np.linalg.norm(x)
            out.append((n, k, s, r, got["cost"], error, 0.5 * np.abs(np.array(got["p"])[order] - p).sum(), got["iterations"]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")])

    return grid.groupBy("n", "k", "sigma", "repeat").applyInPandas(solve, RUNS)


def planted_panel(spark: SparkSession, k: int, sigma: float, series: int = 60, n: int = 50, max_shift: int = 2, seed: int = 0):
    """(panel, truth, signals) of a study: returns with planted classes and shifts."""
    signal = synth.signals(spark, k, n, "gaussian", seed)
    counts = [series // k + (c < series % k) for c in range(k)]
    panel, truth = synth.observations(signal, counts, n, max_shift, sigma, True, seed=seed)
    return panel, truth, signal


def compare_models(spark: SparkSession, ks: list[int], sigmas: list[float], max_lag: int = 5, series: int = 60, n: int = 50) -> DataFrame:
    """(k, sigma, round, model, metric, value): lags from pairs, from synchronised classes and from estimated signals,
    against the planted ones."""
    out = None
    for k in ks:
        for sigma in sigmas:
            panel, truth, _ = planted_panel(spark, k, sigma, series, n)
            z = P.zscored(panel)
            pairs = A.lag_pairs(z, max_lag)
            # classes by clustering, matched with the true ones
            found = C.spectral_clusters(C.nonnegative(pairs), [k]).select("series", "cls")
            names = C.matched_classes(found, truth.select("series", "cls"))
            labels = found.join(F.broadcast(names), F.col("cls") == F.col("a")).select("series", F.col("b").alias("cls"))
            true = A.matrix_from_vector(truth.select("series", "cls", F.col("shift").alias("lag")))
            by_pair = A.within_class(pairs, labels).select("i", "j", "lag")
            ranks = A.svd_lags(A.within_class(pairs, labels), "cls")
            synced = A.matrix_from_vector(ranks.select("cls", "series", "lag")).select("i", "j", "lag")
            signals = E.class_signals(z, labels, n, sigma)
            own = C.nearest_signal(z, signals, n)
            homo = A.matrix_from_vector(own.select("series", "cls", "lag"), n).select("i", "j", "lag")
            for model, lags in (("pairwise", by_pair), ("sync", synced), ("spc-homo", homo)):
                e = V.whole_errors(V.pair_errors(lags, true)).select(
                    F.lit(k).alias("k"), F.lit(float(sigma)).alias("sigma"), F.lit(0).alias("round"), F.lit(model).alias("model"),
                    F.expr("stack(3, 'accuracy', accuracy, 'rel_error', rel_error, 'sign_error', sign_error)").alias("metric", "value"),
                )
                out = e if out is None else out.unionByName(e)
    return out


def planted_strategy(spark: SparkSession, k: int, sigma: float, series: int = 60, n: int = 100, max_shift: int = 2) -> DataFrame:
    """(t, pnl): the lag-group strategy on a planted panel with its true lags, classes weighed by size."""
    panel, truth, _ = planted_panel(spark, k, sigma, series, n, max_shift)
    groups = T.tradable_groups(truth.select("series", "cls", F.col("shift").alias("lag")), series, k, max_shift)
    size = groups.groupBy("cls").agg(F.max("n_cls").alias("n_cls"))
    return T.class_weighted_pnl(T.group_pnl(T.group_returns(panel, groups, "cls"), "cls").join(size, "cls"))
