"""Synthetic signals and observations with planted shifts and classes; everything follows from a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.functions.scan import numbered


def uniform(seed: int, *cols) -> Column:
    """A number in (0, 1) that depends on the seed and the row's columns only, not on partitions or their order."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *cols) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, *cols))) * F.cos(2 * math.pi * uniform(seed + 1, *cols))


def signals(spark: SparkSession, k: int, n: int, kind: str = "gaussian", seed: int = 0, panel: DataFrame | None = None) -> DataFrame:
    """(cls, t, v): k signals of length n: gaussian, sine (cls + 1 periods), chirp (no period), or k series of a panel."""
    if kind == "panel":
        names = panel.select("series").distinct().orderBy("series").limit(k)
        names = names.select("series", (F.row_number().over(Window.orderBy("series")) - 1).alias("cls"))
        return panel.where(F.col("t") < n).join(F.broadcast(names), "series").select("cls", "t", "v")
    grid = spark.range(k).select(F.col("id").cast("int").alias("cls"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))
    x = F.col("t") / n
    v = {
        "gaussian": normal(seed, "cls", "t"),
        "sine": F.sin(2 * math.pi * (F.col("cls") + 1) * x),
        "chirp": F.sin(2 * math.pi * (F.col("cls") + 1) * x * x + x),
    }[kind]
    return grid.withColumn("v", v.cast("double"))


def proportions(k: int, seed: int = 0) -> list[float]:
    """k shares of 0.8 / k or more before they are made to sum to one."""
    import random

    rng = random.Random(seed)
    raw = [max(0.8 / k, rng.random()) for _ in range(k)]
    return [x / sum(raw) for x in raw]


def observations(
    signal: DataFrame, counts: list[int], n: int, max_shift: int, sigma: float, cyclic: bool = True, pad: str = "noise", noise: str = "gaussian", seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(series, t, v) and (series, cls, shift): counts[c] copies of signal c, each shifted by 0..max(1, max_shift) (or
    anywhere in the signal if max_shift is -1), wrapped or with a head of zeros or noise, plus noise of deviation sigma."""
    total = sum(counts)
    spark = signal.sparkSession
    ends = [sum(counts[: c + 1]) for c in range(len(counts))]
    place = F.col("id")
    cls = F.coalesce(*[F.when(place < e, F.lit(c)) for c, e in enumerate(ends)])
    most = n if max_shift < 0 else max(1, max_shift) + 1
    # a permutation of 0..total-1 mixes the classes
    mixed = numbered(spark.range(total), [F.xxhash64(F.lit(seed), "id"), "id"], place="series")
    truth = mixed.select("series", cls.cast("int").alias("cls"), F.floor(uniform(seed + 2, "series") * most).cast("int").alias("shift"))
    moved = truth.join(F.broadcast(signal), "cls").withColumn("to", F.col("t") + F.col("shift"))
    if cyclic or max_shift < 0:
        clean = moved.select("series", F.pmod("to", F.lit(n)).cast("int").alias("t"), "v")
    else:
        grid = truth.select("series", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))
        inside = moved.where(F.col("to") < n).select("series", F.col("to").alias("t"), "v")
        head = normal(seed + 4, "series", "t") if pad == "noise" else F.lit(0.0)
        clean = grid.join(inside, ["series", "t"], "left").select("series", "t", F.coalesce("v", head).alias("v"))
    e = normal(seed + 6, "series", "t") if noise == "gaussian" else (uniform(seed + 6, "series", "t") - 0.5) * math.sqrt(12)
    return clean.withColumn("v", F.col("v") + sigma * e), truth


def split_in_time(panel: DataFrame, share: float, n: int) -> DataFrame:
    """The panel with split = train for the first floor(share n) times, test after."""
    return panel.withColumn("split", F.when(F.col("t") < math.floor(share * n), "train").otherwise("test"))


def sampled(rows: DataFrame, weights: list[float], seed: int = 0) -> DataFrame:
    """rows (id) with cls drawn from weights: the first whose running share reaches the row's number."""
    total, run, at = sum(weights), 0.0, []
    for c, w in enumerate(weights):
        run += w / total
        at.append(F.when(F.col("_u") <= run, F.lit(c)))
    return rows.withColumn("_u", uniform(seed, "id")).withColumn("cls", F.coalesce(*at, F.lit(len(weights) - 1))).drop("_u")


def simulated_bundle(spark: SparkSession, n: int, copies: int, sigma: float, seed: int = 0) -> dict[str, DataFrame]:
    """A signal, its shifted and noisy copies, and their spectra: everything a study starts from."""
    from lagloom.functions import spectral

    signal = signals(spark, 1, n, seed=seed)
    shifted, truth = observations(signal, [copies], n, -1, 0.0, seed=seed)
    noisy, _ = observations(signal, [copies], n, -1, sigma, seed=seed)
    spectrum = spectral.dft(noisy)
    return {"signal": signal, "truth": truth, "shifted": shifted, "noisy": noisy, "dft": spectrum, "power": spectral.power(spectrum), "bispectrum": spectral.bispectrum(spectrum)}
