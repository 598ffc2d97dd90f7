"""Clusters of series: spectral clustering, assignment to signals, comparing clusterings, smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.operators.align import DIGITS, assignment, lags_to_reference
from lagloom.operators.edges import spectral_classes


def negative_share(pairs: DataFrame) -> DataFrame:
    """(share) of negative entries in the whole affinity matrix, its diagonal of zeros included."""
    n = pairs.select(F.explode(F.array("i", "j")).alias("s")).agg(F.count_distinct("s").alias("n"))
    return pairs.agg((2 * F.count_if(F.col("score") < 0)).alias("neg")).join(F.broadcast(n)).select((F.col("neg") / (F.col("n") * F.col("n"))).alias("share"))


def nonnegative(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.greatest("score", F.lit(0.0)))


def residual_affinity(residuals: DataFrame, delta: float = 1.0) -> DataFrame:
    return residuals.select("i", "j", F.exp(-(F.col("residual") ** 2) / (2 * delta**2)).alias("score"))


def kmeans(x: np.ndarray, k: int, seed: int = 0, starts: int = 10) -> np.ndarray:
    rng, best, low = np.random.default_rng(seed), np.zeros(len(x), int), np.inf
    for _ in range(starts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            far = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            pick = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))
            centres = np.vstack([centres, x[pick]])
        for _ in range(200):
            d = ((x[:, None] - centres[None]) ** 2).sum(-1)
            own = d.argmin(1)
            new = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        if (cost := d.min(1).sum()) < low:
            best, low = own, cost
    return best


def spectral_labels(affinity: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Classes from the leading eigenvectors of the normalised affinity, by k-means on rows of unit length."""
    if k == 1 or len(affinity) <= k:
        return np.arange(len(affinity)) % max(k, 1)
    d = affinity.sum(1)
    root = 1 / np.sqrt(np.where(d > 0, d, 1))
    _, vectors = np.linalg.eigh(root[:, None] * affinity * root[None, :])
    x = root[:, None] * vectors[:, -k:]
    return kmeans(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), k, seed)


def spectral_clusters(pairs: DataFrame, ks: list[int], key: str | None = None) -> DataFrame:
    """([key,] k, series, cls) for each k and each window (key): eigenvectors and k-means on the table of pairs, all windows
    and numbers of classes in the same jobs; no task holds the matrix of a window. spectral_labels is the dense form."""
    base = pairs if key else pairs.withColumn("_all", F.lit(0))
    out = spectral_classes(base, ks, [key or "_all"])
    return out if key else out.drop("_all")


def nearest_signal(panel: DataFrame, signals: DataFrame, n: int, max_lag: int | None = None) -> DataFrame:
    """(series, cls, lag, score): the signal (cls, t, v) with the largest score at its best lag; the least cls of equals."""
    m = max_lag or n // 2
    each = lags_to_reference(panel, signals, list(range(-m, m)), n)
    best = each.groupBy("series").agg(F.max_by(F.struct("cls", "lag", "score"), F.struct(F.round("score", DIGITS), -F.col("cls"))).alias("b"))
    return best.select("series", "b.cls", "b.lag", "b.score")


def relabelled(labels: DataFrame) -> DataFrame:
    """Class names as numbers from 0 without gaps, in their order."""
    names = labels.select("cls").distinct().select("cls", (F.dense_rank().over(Window.orderBy("cls")) - 1).alias("new"))
    return labels.join(F.broadcast(names), "cls").select("series", F.col("new").alias("cls"))


def contingency(one: DataFrame, two: DataFrame) -> DataFrame:
    """(a, b, n): how many series are in class a of one clustering and class b of the other."""
    return one.select("series", F.col("cls").alias("a")).join(two.select("series", F.col("cls").alias("b")), "series").groupBy("a", "b").agg(F.count("*").alias("n"))


def jaccard(table: DataFrame) -> DataFrame:
    """(a, b, n, iou) from a contingency table."""
    na, nb = Window.partitionBy("a"), Window.partitionBy("b")
    return table.select("a", "b", "n", (F.col("n") / (F.sum("n").over(na) + F.sum("n").over(nb) - F.col("n"))).alias("iou"))


def matched_classes(one: DataFrame, two: DataFrame) -> DataFrame:
    """(a, b): classes of one matched with classes of two at the largest total Jaccard index; classes are few."""
    rows = jaccard(contingency(one, two)).collect()
    a, b = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    iou = np.zeros((len(a), len(b)))
    for r in rows:
        iou[a.index(r.a), b.index(r.b)] = r.iou
    pick = assignment(-iou)
    return one.sparkSession.createDataFrame([(x, b[k]) for x, k in zip(a, pick, strict=True) if k >= 0], "a int, b int")


def adjusted_rand(one: DataFrame, two: DataFrame) -> DataFrame:
    """(ari): the adjusted Rand index of two clusterings."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    t = contingency(one, two)
    cells = t.agg(pairs("n").alias("x"), F.sum("n").alias("n"))
    rows = t.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n").alias("ra"))
    cols = t.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n").alias("rb"))
    all_ = cells.join(F.broadcast(rows)).join(F.broadcast(cols))
    expected = F.col("ra") * F.col("rb") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("ra") + F.col("rb")) / 2
    return all_.select(F.when(top == expected, F.lit(1.0)).otherwise((F.col("x") - expected) / (top - expected)).alias("ari"))


def mixing(labels: DataFrame, k: int) -> DataFrame:
    """(cls, p): the share of each of classes 0..k-1, empty ones included."""
    total = labels.agg(F.count("*").alias("all"))
    counts = labels.groupBy("cls").agg(F.count("*").alias("n"))
    every = labels.sparkSession.range(k).select(F.col("id").cast("int").alias("cls"))
    return every.join(counts, "cls", "left").join(F.broadcast(total)).select("cls", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("p"))


def smooth(panel: DataFrame, sigma: float, scales: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0, 8.0)) -> DataFrame:
    """(series, t, v): Gaussian-process means with a squared-exponential kernel; of the scales the likeliest is taken."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("t")
        t, y = df.t.to_numpy(float), df.v.to_numpy(float)
        best, top = y, -np.inf
        for scale in scales:
            k = np.exp(-((t[:, None] - t[None]) ** 2) / (2 * scale**2))
            c = np.linalg.cholesky(k + 5 * sigma**2 * np.eye(len(t)) + 1e-9 * np.eye(len(t)))
            a = np.linalg.solve(c.T, np.linalg.solve(c, y))
            fit = -0.5 * y @ a - np.log(np.diag(c)).sum()
            if fit > top:
                best, top = k @ a, fit
        return pd.DataFrame({"series": df.series, "t": df.t, "v": best})

    return panel.select("series", "t", "v").groupBy("series").applyInPandas(run, panel.select("series", "t", "v").schema)
