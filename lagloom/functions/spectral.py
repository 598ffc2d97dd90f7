"""Spectra and shift-invariant features of panels, in long form.

Spark has no complex type: spectra are (series, f, re, im), bispectra (f1, f2, re, im). Sums over series are plain
aggregations; `invariants` takes them from arrays in one pass, as partial sums that Spark adds up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.scan import numbered, running_sum


def arrays(panel: DataFrame, *keys: str) -> DataFrame:
    """(keys..., series, x): each series as an array in order of time."""
    packed = panel.groupBy(*keys, "series").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"))
    return packed.select(*keys, "series", F.col("p.v").alias("x"))


def _complex_rows(arrays_: DataFrame, place: str) -> DataFrame:
    """Rows of (keys..., re, im) with arrays spread over their places."""
    keys = [c for c in arrays_.columns if c not in ("re", "im")]
    rows = arrays_.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias(place, "z"))
    return rows.select(*keys, place, "z.re", "z.im")


def dft(panel: DataFrame) -> DataFrame:
    """(series, f, re, im): the discrete Fourier transform of each series, as an array."""
    kind = panel.schema["series"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            z = [np.fft.fft(np.asarray(x, float)) for x in df.x]
            yield pd.DataFrame({"series": df.series, "re": [x.real for x in z], "im": [x.imag for x in z]})

    return _complex_rows(arrays(panel).select("series", "x").mapInPandas(run, f"series {kind}, re array<double>, im array<double>"), "f")


def inverse_dft(spectrum: DataFrame) -> DataFrame:
    """(series, t, v): the real part of the inverse transform."""
    n = spectrum.groupBy("series").agg(F.max("f").alias("last"))
    rows = spectrum.join(n, "series").select("series", "f", "re", "im", (F.col("last") + 1).alias("n"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("t"))
    angle = 2 * np.pi * F.pmod(F.col("f") * F.col("t"), F.col("n")) / F.col("n")
    return rows.groupBy("series", "t").agg((F.sum(F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)) / F.max("n")).alias("v"))


def power(spectrum: DataFrame) -> DataFrame:
    return spectrum.select("series", "f", (F.col("re") ** 2 + F.col("im") ** 2).alias("p"))


def circulant(panel: DataFrame) -> DataFrame:
    """(series, a, b, v): row a is the series shifted by a, so the entry is v at (b - a) modulo the length."""
    n = panel.groupBy("series").agg((F.max("t") + 1).alias("n"))
    rows = panel.join(n, "series").select("series", "t", "v", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
    return rows.select("series", "a", F.pmod(F.col("a") + F.col("t"), F.col("n")).cast("int").alias("b"), "v")


def circulant_adjoint(entries: DataFrame, n: int) -> DataFrame:
    """(series, t, v): sums over the wrapped diagonals of matrices (series, a, b, v)."""
    return entries.groupBy("series", F.pmod(F.col("b") - F.col("a"), F.lit(n)).cast("int").alias("t")).agg(F.sum("v").alias("v"))


def bispectrum(spectrum: DataFrame) -> DataFrame:
    """(series, f1, f2, re, im) of x[f1] conj(x[f2]) x[f2 - f1]: a series' spectrum is one array, a frequency's row one more."""
    kind = spectrum.schema["series"].dataType.simpleString()
    whole = spectrum.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("f", "re", "im"))).alias("z")).select("series", "z.re", "z.im")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for series, re, im in zip(df.series, df.re, df.im, strict=True):
                x = np.asarray(re) + 1j * np.asarray(im)
                rows = [x[f] * np.conj(x) * np.roll(x, f) for f in range(len(x))]
                yield pd.DataFrame({"series": series, "f1": np.arange(len(x), dtype=np.int32), "re": [r.real for r in rows], "im": [r.imag for r in rows]})

    return _complex_rows(whole.mapInPandas(run, f"series {kind}, f1 int, re array<double>, im array<double>"), "f2")


def invariants(obs: DataFrame, n: int, weight: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mean), (f, p), (f1, f2, re, im) averaged over series (series, x[, weight]): each batch of arrays adds its sums,
    so what is shuffled does not grow with the number of series in a batch. Weights are made to sum to one."""
    a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if not len(df):
                continue
            x, w = np.array(df.x.to_list(), float), df.w.to_numpy(float)
            h = np.fft.fft(x, axis=1)
            bis = np.einsum("s,sa,sb,sab->ab", w, h, h.conj(), h[:, (b - a) % n], optimize=True)
            rows = [("w", 0, 0, w.sum(), 0.0), ("mean", 0, 0, (w * x.mean(axis=1)).sum(), 0.0)]
            rows += [("power", f, 0, p, 0.0) for f, p in enumerate(w @ np.abs(h) ** 2)]
            rows += [("bispectrum", i, j, z.real, z.imag) for (i, j), z in np.ndenumerate(bis)]
            yield pd.DataFrame(rows, columns=["kind", "f1", "f2", "re", "im"])

    w = F.col(weight) if weight else F.lit(1.0)
    parts = obs.select("x", w.cast("double").alias("w")).mapInPandas(sums, "kind string, f1 int, f2 int, re double, im double")
    total = parts.groupBy("kind", "f1", "f2").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    whole = total.where("kind = 'w'").select(F.col("re").alias("w"))
    share = total.join(F.broadcast(whole)).select("kind", "f1", "f2", (F.col("re") / F.col("w")).alias("re"), (F.col("im") / F.col("w")).alias("im"))
    return (
        share.where("kind = 'mean'").select(F.col("re").alias("mean")),
        share.where("kind = 'power'").select(F.col("f1").alias("f"), F.col("re").alias("p")),
        share.where("kind = 'bispectrum'").select("f1", "f2", "re", "im"),
    )


def invariants_by_class(obs: DataFrame, n: int) -> DataFrame:
    """(cls, kind, f1, f2, re, im) of series (cls, series, x): for every class the mean, the power spectrum (f1) and the
    bispectrum (f1, f2), averaged over its series. One pass for all classes: a batch adds up each class that is in it."""
    a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    f1, f2 = a.ravel(), b.ravel()
    kinds = np.array(["n", "mean"] + ["power"] * n + ["bispectrum"] * (n * n))
    at1, at2 = np.concatenate([[0, 0], np.arange(n), f1]).astype(np.int32), np.concatenate([[0, 0], np.zeros(n), f2]).astype(np.int32)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for c, own in df.groupby("cls"):
                x = np.array(own.x.to_list(), float)
                h = np.fft.fft(x, axis=1)
                bis = np.einsum("sa,sb,sab->ab", h, h.conj(), h[:, (b - a) % n], optimize=True).ravel()
                re = np.concatenate([[len(x), x.mean(axis=1).sum()], (np.abs(h) ** 2).sum(axis=0), bis.real])
                yield pd.DataFrame({"cls": c, "kind": kinds, "f1": at1, "f2": at2, "re": re, "im": np.concatenate([np.zeros(n + 2), bis.imag])})

    kind = obs.schema["cls"].dataType.simpleString()
    parts = obs.select("cls", "x").mapInPandas(sums, f"cls {kind}, kind string, f1 int, f2 int, re double, im double")
    total = parts.groupBy("cls", "kind", "f1", "f2").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    size = total.where("kind = 'n'").select("cls", F.col("re").alias("n"))
    return total.where("kind <> 'n'").join(size, "cls").select("cls", "kind", "f1", "f2", (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))


def debiased(mean: DataFrame, power_: DataFrame, n: int, sigma2: float) -> DataFrame:
    """(f, p): the power spectrum of centred data without the share of noise; at frequency 0 nothing is left."""
    p = F.when(F.col("f") == 0, F.col("p") - (n * F.col("mean")) ** 2).otherwise(F.col("p"))
    return power_.join(F.broadcast(mean)).select("f", F.greatest(F.lit(0.0), p - n * sigma2).alias("p"))


def noise_level(panel: DataFrame) -> DataFrame:
    """(sigma): the deviation over series of the sum of a series, by the root of its length."""
    sums = panel.groupBy("series").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return sums.agg((F.stddev_samp("s") / F.sqrt(F.max("n"))).alias("sigma"))


def bias_pattern(spark, n: int) -> DataFrame:
    """(f1, f2, bias): how often white noise meets itself in the bispectrum."""
    grid = spark.range(n).select(F.col("id").cast("int").alias("f1"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("f2"))
    one = lambda c: c.cast("int")
    return grid.withColumn("bias", one(F.col("f1") == F.col("f2")) + one(F.col("f1") == 0) + one(F.col("f2") == 0))


def convergence(features: DataFrame) -> DataFrame:
    """(n, error) of running means of features (copy, f, p) against the mean of all: how averages settle."""
    run = numbered(running_sum(features, F.col("p"), ["copy"], "f"), ["copy"], "f").withColumn("m", F.col("total") / (F.col("place") + 1))
    last = features.groupBy("f").agg(F.avg("p").alias("all"))
    return run.join(last, "f").groupBy((F.col("copy") + 1).alias("n")).agg(F.sqrt(F.sum((F.col("m") - F.col("all")) ** 2)).alias("error"))


def phases_from_bispectrum(b: np.ndarray, rounds: int = 500, starts: int = 6, seed: int = 0) -> np.ndarray:
    """Unit phases z of a real signal (z[-f] = conj z[f], z[0] = 1) that make z* (B o circ(z)) z largest: power steps
    from several starts; phases are known up to a linear one, a shift of the signal."""
    n = len(b)
    at = (np.arange(n)[None, :] - np.arange(n)[:, None]) % n
    unit = np.where(np.abs(b) > 0, b / np.maximum(np.abs(b), 1e-300), 0)
    rng, best, top = np.random.default_rng(seed), None, -np.inf

    def real(z: np.ndarray) -> np.ndarray:
        z = (z + np.conj(z[-np.arange(n) % n])) / 2
        z = np.where(np.abs(z) > 1e-12, z / np.maximum(np.abs(z), 1e-300), 1)
        z[0] = 1 if b[0, 0].real >= 0 else -1
        return z

    def value(z: np.ndarray) -> float:
        return float(np.real(np.sum(np.conj(b) * (z[:, None] * np.conj(z)[None, :] * z[at]))))

    for _ in range(starts):
        z = real(np.exp(2j * np.pi * rng.random(n)))
        for _ in range(rounds):
            new = real((unit * np.conj(z[at])) @ z + 0.5 * z)
            if np.abs(new - z).max() < 1e-10:
                break
            z = new
        flips = [z] if n % 2 else [z, np.where(np.arange(n) == n // 2, -z, z)]
        for z in flips:
            if (v := value(z)) > top:
                best, top = z, v
    return best


def complex_phases_from_bispectrum(b: np.ndarray, first: np.ndarray | None = None, rounds: int = 2000, starts: int = 20, seed: int = 0) -> np.ndarray:
    """Unit phases z of a complex signal that make Re z* (B o conj circ(z)) z largest, from the guess first (its phases;
    no zeros) or from several random starts. Unlike those of a real signal they have no symmetry and z[0] is free. They
    are known up to a shift of the signal; B may carry weights. Steps go along the whole gradient, as the form is not
    Hermitian in z."""
    n = len(b)
    if b.shape != (n, n):
        raise ValueError("the bispectrum must be square")
    if first is not None and (np.shape(first) != (n,) or np.any(np.abs(first) == 0)):
        raise ValueError("the guess must hold one phase a frequency, none of them zero")
    at = (np.arange(n)[None, :] - np.arange(n)[:, None]) % n
    inertia = np.abs(b).sum() / (2 * n)
    rng, best, top = np.random.default_rng(seed), None, -np.inf
    for _ in range(1 if first is not None else starts):
        z = first / np.abs(first) if first is not None else np.exp(2j * np.pi * rng.random(n))
        for _ in range(rounds):
            m = b * np.conj(z[at])
            new = 2 * m @ z + m.conj().T @ z + inertia * z
            new = np.where(np.abs(new) > 1e-300, new / np.maximum(np.abs(new), 1e-300), z)
            moved, z = np.abs(new - z).max(), new
            if moved < 1e-12:
                break
        if (v := float(np.real(np.conj(z) @ (b * np.conj(z[at])) @ z))) > top:
            best, top = z, v
    return best


def signal_from_invariants(mean: float, power_: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A real signal, up to a shift, with the mean, power spectrum and bispectrum given."""
    h = np.sqrt(np.maximum(power_, 0)) * phases_from_bispectrum(b)
    h[0] = mean * len(power_)
    return np.fft.ifft(h).real


def estimate_from_invariants(obs: DataFrame, n: int, sigma: float) -> np.ndarray:
    """The invariant-features estimate of the one signal behind shifted noisy copies (series, x). What comes to the
    driver is one mean, n powers and n by n products, whatever the number of copies."""
    mean = obs.select(F.avg(F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / n)).first()[0]
    centred = obs.select("series", F.transform("x", lambda v: v - mean).alias("x"))
    _, p, b = invariants(centred, n)
    power_ = np.zeros(n)
    for r in p.collect():
        power_[r.f] = max(0.0, r.p - n * sigma**2)
    bis = np.zeros((n, n), complex)
    for r in b.collect():
        bis[r.f1, r.f2] = complex(r.re, r.im)
    return signal_from_invariants(mean, power_, bis)
