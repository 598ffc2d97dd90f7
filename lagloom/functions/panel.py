"""Cleaning, scaling and resampling of panels (series, t, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.scan import numbered
from lagloom.functions.select import exact_quantiles


def by_series():
    return Window.partitionBy("series")


def in_order():
    return Window.partitionBy("series").orderBy("t")


def null_share(panel: DataFrame) -> DataFrame:
    n = F.count_if(F.col("v").isNull())
    return panel.agg(n.alias("n_null"), (n / F.count("*")).alias("share"))


def filled(panel: DataFrame) -> DataFrame:
    return panel.withColumn("v", F.coalesce("v", F.lit(0.0)))


def zero_share(window) -> Column:
    return F.avg((F.col("v") == 0).cast("int")).over(window)


def without_sparse_series(panel: DataFrame, most: float = 0.5) -> DataFrame:
    """Series whose share of zeros is `most` or less."""
    return panel.withColumn("_z", zero_share(by_series())).where(F.col("_z") <= most).drop("_z")


def without_sparse_times(panel: DataFrame, most: float = 0.1) -> DataFrame:
    """Times at which the share of zeros is `most` or less, numbered densely again."""
    sums = panel.groupBy("t").agg(F.avg((F.col("v") == 0).cast("int")).alias("z")).where(F.col("z") <= most)
    dense = numbered(sums, ["t"], place="dense")
    return panel.join(dense, "t").select("series", F.col("dense").cast(panel.schema["t"].dataType).alias("t"), "v")


def without_extreme_series(panel: DataFrame, bound: float = 1.0, most: float = 0.1) -> DataFrame:
    """Series with values of `bound` or more at a share of `most` of times or less."""
    return panel.withColumn("_x", F.avg((F.col("v") >= bound).cast("int")).over(by_series())).where(F.col("_x") <= most).drop("_x")


def clipped(panel: DataFrame, bound: float = 0.15) -> DataFrame:
    return panel.withColumn("v", F.least(F.greatest("v", F.lit(-bound)), F.lit(bound)))


def winsorized(panel: DataFrame, low: float = 0.05, high: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """Values clipped to exact percentiles (of the groups of `by`)."""
    cuts = exact_quantiles(panel, F.col("v"), [low, high], *by).withColumnRenamed("q", "_q")
    joined = panel.join(F.broadcast(cuts)) if not by else panel.join(cuts, list(by))
    return joined.withColumn("v", F.least(F.greatest("v", F.col("_q")[0]), F.col("_q")[1])).drop("_q")


def excess(panel: DataFrame, benchmark) -> DataFrame:
    """Values less those of the benchmark series, which leaves."""
    ref = panel.where(F.col("series") == F.lit(benchmark)).select("t", F.col("v").alias("_b"))
    return panel.where(F.col("series") != F.lit(benchmark)).join(ref, "t").select("series", "t", (F.col("v") - F.col("_b")).alias("v"))


def zscored(panel: DataFrame, sample: bool = False) -> DataFrame:
    """(v - mean) / deviation of each series; the deviation of the whole (or of a sample). Constant series get null."""
    sd = F.stddev_samp("v") if sample else F.stddev_pop("v")
    return panel.withColumn("v", F.try_divide(F.col("v") - F.avg("v").over(by_series()), sd.over(by_series())))


def scaled(panel: DataFrame) -> DataFrame:
    return panel.withColumn("v", F.try_divide(F.col("v"), F.stddev_pop("v").over(by_series())))


def mid_price(book: DataFrame) -> DataFrame:
    return book.withColumn("v", (F.col("ask_price1") + F.col("bid_price1")) / 2)


def right_edge(time: Column, width: float, start: float) -> Column:
    """The right edge of the bin (edge - width, edge] that holds a time."""
    return start + F.ceil((time - start) / width) * width


def downsampled(ticks: DataFrame, width: float, start: float = 34200.0, end: float = 57600.0, how: str = "max", *keys: str) -> DataFrame:
    """(keys..., time, v): bins closed on the right and named by that edge, with their largest or last value."""
    inside = ticks.where((F.col("time") > start) & (F.col("time") <= end))
    value = F.max("v") if how == "max" else F.max_by("v", F.struct("time", "row_id"))
    return inside.groupBy(*keys, right_edge(F.col("time"), width, start).alias("time")).agg(value.alias("v"))


def log_returns(panel: DataFrame) -> DataFrame:
    """ln v - ln of the value before; null where either is not positive."""
    log = F.when(F.col("v") > 0, F.ln("v"))
    return panel.withColumn("v", log - F.lag(log).over(in_order()))


def returns(panel: DataFrame) -> DataFrame:
    """Log returns from the second time on, renumbered from 0, with 0 where there is none."""
    return filled(log_returns(panel)).where("t > 0").withColumn("t", F.col("t") - 1)


RETURNS_SQL = """
rets AS (
  SELECT series, t - 1 AS t, coalesce(r, 0.0) AS v FROM (
    SELECT series, t, (CASE WHEN v > 0 THEN ln(v) END) - lag(CASE WHEN v > 0 THEN ln(v) END) OVER (PARTITION BY series ORDER BY t) AS r FROM months) WHERE t > 0)
"""

ZSCORE_SQL = """
z AS (SELECT series, t, (v - avg(v) OVER (PARTITION BY series)) / nullif(stddev_pop(v) OVER (PARTITION BY series), 0) AS v FROM rets)
"""


def clock(seconds: Column, day: Column) -> Column:
    """Seconds after midnight as a timestamp of a day."""
    return F.timestamp_micros((F.unix_micros(day.cast("timestamp")) + F.round(seconds * 1e6)).cast("long"))


def hourly_piece(ts: Column, first: int = 10, pieces: int = 5) -> Column:
    """Number of the hour of trading a timestamp is in; null outside the pieces."""
    k = F.hour(ts) - first
    return F.when((k >= 0) & (k < pieces), k)


def rolling(panel: DataFrame, n: int = 50) -> DataFrame:
    """(series, t, mean, sd) of the last n values, null until there are n."""
    w = in_order().rowsBetween(1 - n, 0)
    enough = F.count("v").over(w) == n
    return panel.select("series", "t", F.when(enough, F.avg("v").over(w)).alias("mean"), F.when(enough, F.stddev_samp("v").over(w)).alias("sd"))


def first_of_year(days: DataFrame) -> DataFrame:
    return days.groupBy(F.year("date").alias("year")).agg(F.min("t").alias("first_t"))


def interpolated(panel: DataFrame, at: DataFrame) -> DataFrame:
    """(series, x, v) at positions x between times: linear between neighbours, the end values beyond the ends."""
    span = panel.groupBy("series").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    spot = span.join(F.broadcast(at)).withColumn("y", F.least(F.greatest("x", F.col("lo").cast("double")), F.col("hi").cast("double")))
    spot = spot.select("series", "x", "y", F.floor("y").cast("int").alias("t"))
    ahead = panel.withColumn("after", F.lead("v").over(in_order()))
    value = F.col("v") + F.when(F.col("y") > F.col("t"), (F.col("y") - F.col("t")) * (F.col("after") - F.col("v"))).otherwise(0.0)
    return spot.join(ahead, ["series", "t"]).select("series", "x", value.alias("v"))


def longest_zero_run(panel: DataFrame) -> DataFrame:
    """(series, run): the longest stretch of zeros of each series."""
    island = F.col("t") - F.row_number().over(Window.partitionBy("series").orderBy("t"))
    zeros = panel.where("v = 0").withColumn("_i", island).groupBy("series", "_i").agg(F.count("*").alias("n")).groupBy("series").agg(F.max("n").alias("n"))
    return panel.select("series").distinct().join(zeros, "series", "left").select("series", F.coalesce("n", F.lit(0)).cast("long").alias("run"))


def stacked(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(series, t, names...): two panels side by side."""
    return left.select("series", "t", F.col("v").alias(names[0])).join(right.select("series", "t", F.col("v").alias(names[1])), ["series", "t"], "full")
