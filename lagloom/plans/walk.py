"""Walk-forward schedules: windows as rows, in-sample fits and out-of-sample days by joins on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.operators.align import lag_pairs, row_mean_lags
from lagloom.sources.storage import stored_table


def windows(spark: SparkSession, first: int, last: int, length: int = 50, step: int = 10) -> DataFrame:
    """(start, end) for start in first, first + step, ... before last; end is start + length."""
    return spark.range(first, last, step).select(F.col("id").cast("int").alias("start"), (F.col("id") + length).cast("int").alias("end"))


def in_windows(panel: DataFrame, schedule: DataFrame, ahead: int = 0) -> DataFrame:
    """Rows of a panel in every window they belong to; with ahead, in the days after it instead. Windows overlap, so each
    time is given the windows that hold it: an equi-join on t, the schedule being few rows."""
    lo, hi = ("start", F.col("end")) if not ahead else ("end", F.col("end") + ahead)
    times = schedule.select("start", "end", F.explode(F.sequence(F.col(lo), hi - 1)).alias("t"))
    return panel.join(times, "t")


def trade_ahead(panel: DataFrame, schedule: DataFrame, weights: DataFrame, days: int = 10) -> DataFrame:
    """(start, t, pnl): weights (start, series, w) of a window traded in the days after it."""
    return in_windows(panel, schedule, days).join(weights, ["start", "series"]).groupBy("start", "t").agg(F.sum(F.col("w") * F.col("v")).alias("pnl"))


def concatenated(pnl: DataFrame) -> DataFrame:
    """(t, pnl) over windows (start, t, pnl); of windows that overlap the latest counts."""
    return pnl.groupBy("t").agg(F.max_by("pnl", "start").alias("pnl"))


def best_series_out_of_sample(panel: DataFrame, length: int, step: int, days: int = 10) -> DataFrame:
    """(start, t, series, pnl): the series with the best mean of a window, in the days after it."""
    schedule = whole_schedule(panel, length, step)
    means = in_windows(panel, schedule).groupBy("start", "series").agg(F.avg("v").alias("m"))
    best = means.groupBy("start").agg(F.max_by("series", F.struct(F.round("m", 9), -F.col("series"))).alias("series"))
    return in_windows(panel, schedule, days).join(best, ["start", "series"]).select("start", "t", "series", F.col("v").alias("pnl"))


def whole_schedule(panel: DataFrame, length: int, step: int) -> DataFrame:
    """Windows from the first time on, as long as a whole one fits before the last."""
    last = panel.agg(F.max("t")).first()[0] + 1
    return windows(panel.sparkSession, 0, max(0, last - length) + 1, length, step)


def walk_lag_pairs(panel: DataFrame, schedule: DataFrame, max_lag: int, within: list[int] | None = None) -> DataFrame:
    """(start, i, j, lag, score[, m]): the lag matrix of every window, all in one job. Series are standardised within each
    window; one that is constant there has no lags in it."""
    w = Window.partitionBy("start", "series")
    z = F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w))
    inside = in_windows(panel, schedule).select("start", "series", (F.col("t") - F.col("start")).alias("t"), z.alias("v"))
    return lag_pairs(inside.where("v IS NOT NULL"), max_lag, key="start", within=within)


def leaders_and_followers(lags: DataFrame, *keys: str) -> DataFrame:
    """(keys..., series, leads): the first half by lag lead, the others follow; equal lags go by series."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy("lag", "series"))
    return lags.select(*keys, "series", (2 * place <= F.count("*").over(w)).alias("leads"))


def follow_the_leaders(panel: DataFrame, schedule: DataFrame, halves: DataFrame, days: int, *keys: str) -> DataFrame:
    """(start, end, keys..., t, pnl): followers' mean return, held in the direction of the leaders' mean one time before;
    over each window and the days after it."""
    times = schedule.select("start", "end", F.explode(F.sequence("start", F.col("end") + days - 1)).alias("t"))
    rows = panel.join(times, "t").join(halves, ["start", "series"]).groupBy("start", "end", *keys, "t")
    means = rows.agg(F.avg(F.when(F.col("leads"), F.col("v"))).alias("lead"), F.avg(F.when(~F.col("leads"), F.col("v"))).alias("follow"))
    before = means.select("start", *keys, (F.col("t") + 1).alias("t"), F.col("lead").alias("signal"))
    return means.join(before, ["start", *keys, "t"]).select("start", "end", *keys, "t", (F.signum(F.round("signal", 12)) * F.col("follow")).alias("pnl"))


def walk_forward_backtest(panel: DataFrame, length: int, step: int, max_lags: list[int], days: int) -> DataFrame:
    """(start, t, m, pnl): for every window the range of lags m whose strategy earned most in it, traded in the days after
    it: lag matrix, lag vector, leaders and followers, all windows and ranges in one plan."""
    schedule = whole_schedule(panel, length, step)
    pairs = stored_table(walk_lag_pairs(panel, schedule, max(max_lags), max_lags), "walk-pairs")
    vectors = stored_table(row_mean_lags(pairs, "start", "m"), "walk-lags")
    pnl = stored_table(follow_the_leaders(panel, schedule, leaders_and_followers(vectors, "start", "m"), days, "m"), "walk-pnl")
    inside = pnl.where("t < end").groupBy("start", "m").agg(F.avg("pnl").alias("score"))
    best = inside.groupBy("start").agg(F.max_by("m", F.struct(F.round("score", 9), -F.col("m"))).alias("m"))
    return pnl.where("t >= end").join(best, ["start", "m"]).select("start", "t", "m", "pnl")
