"""The strategy on lag groups of classes, for all cells of a grid in one plan.

A cell is a window and further keys (a number of classes, a model); cells are rows (start, keys..., series, cls, lag). Each
cell is traded in a period (start, begin, end): the window itself to score it, or the days after it. Nothing in a period is
known before its day: volatilities come from the days before begin, signals from days before the one that is traded, and as
many days before begin are looked at as the widest lag and the watched days need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.select import exact_quantiles
from lagloom.operators.trade import group_weights, received_signals, rolling_sum
from lagloom.sources.storage import stored_table


def periods(schedule: DataFrame, ahead: int = 0) -> DataFrame:
    """(start, begin, end): the windows themselves, or so many days after each."""
    if ahead:
        return schedule.select("start", F.col("end").alias("begin"), (F.col("end") + ahead).alias("end"))
    return schedule.select("start", F.col("start").alias("begin"), "end")


def tradable_cells(cells: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """(keys..., cls, lag, first, last, n_cls) of the lag groups that are traded: of classes of more than a fifth of an even
    share of the cell's series, groups of a tenth of the class over the lags or more, two at least in a class; first and
    last are the least and largest lag among them."""
    sizes = cells.groupBy(*keys, "cls").agg(F.count("*").alias("n_cls"))
    totals = sizes.groupBy(*keys).agg(F.sum("n_cls").alias("n_all"), F.count("*").alias("n_classes"))
    large = sizes.join(totals, keys).where(F.col("n_cls") > F.floor(0.2 * F.col("n_all") / F.col("n_classes"))).select(*keys, "cls", "n_cls")
    groups = cells.groupBy(*keys, "cls", "lag").agg(F.count("*").alias("n_lag")).join(large, [*keys, "cls"])
    groups = groups.where(F.col("n_lag") >= 0.1 * F.floor(F.col("n_cls") / max_lag + 1))
    ends = groups.groupBy(*keys, "cls").agg(F.min("lag").alias("first"), F.max("lag").alias("last"), F.count("*").alias("groups")).where("groups > 1")
    return groups.join(ends, [*keys, "cls"]).select(*keys, "cls", "lag", "first", "last", "n_cls")


def volatility_weights(panel: DataFrame, cells: DataFrame, period: DataFrame, keys: list[str], days: int = 20) -> DataFrame:
    """(keys..., cls, series, lag, weight): 1 over the deviation of the days before a period, clipped to the 5th and 95th
    percentiles of its class. A series without a deviation there has no weight and is left out."""
    before = F.sequence(F.greatest(F.col("begin") - days, F.lit(0)), F.col("begin") - 1)
    times = period.where("begin > 0").select("start", F.explode(before).alias("t"))
    raw = panel.join(times, "t").groupBy("start", "series").agg(F.try_divide(F.lit(1.0), F.stddev_samp("v")).alias("raw"))
    each = stored_table(cells.join(raw.where("raw IS NOT NULL"), ["start", "series"]).select(*keys, "cls", "series", "lag", "raw"), "volatilities")
    cuts = exact_quantiles(each, F.col("raw"), [0.05, 0.95], *keys, "cls")
    clip = F.least(F.greatest("raw", F.get("q", F.lit(0))), F.get("q", F.lit(1)))
    return each.join(cuts, [*keys, "cls"]).select(*keys, "cls", "series", "lag", clip.alias("weight"))


def cell_trades(
    panel: DataFrame, cells: DataFrame, period: DataFrame, keys: list[str], max_lag: int, watch: int = 1, hold: int = 1, days: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(keys..., series, t, w) and (keys..., t, pnl) of every cell that trades, for each day of its period. A lag group earns
    the weighted sum of its series, weights adding up to one in it; groups are traded on the signals they receive, classes
    count by their size, and the weights of all classes are scaled to a total size of one a day (none where nothing trades).
    keys begin with start. pnl is the mean of the classes' profits, by size."""
    by = [*keys, "cls"]
    groups = tradable_cells(cells, keys, max_lag)
    weighed = volatility_weights(panel, cells, period, keys, days).join(groups, [*by, "lag"])
    inside = F.sum("weight").over(Window.partitionBy(*by, "lag"))
    members = weighed.select(*by, "series", (F.col("lag") - F.col("first")).alias("lag"), (F.col("last") - F.col("first")).alias("width"), "n_cls", (F.col("weight") / inside).alias("weight"))
    members = stored_table(members, "members")
    look_back = F.least(F.col("width") + watch, F.col("begin"))
    times = members.select(*by, "width").distinct().join(period, "start")
    times = times.select(*by, "begin", F.explode(F.sequence(F.col("begin") - look_back, F.col("end") - 1)).alias("t"))
    earned = panel.join(members, "series").join(times, [*by, "t"]).groupBy(*by, "lag", "t").agg(F.sum(F.col("weight") * F.col("v")).alias("v"), F.first("begin").alias("begin"), F.first("n_cls").alias("n_cls"))
    earned = earned.withColumn("signal", rolling_sum(F.col("v"), watch, *by, "lag")).withColumn("r", rolling_sum(F.col("v"), hold, *by, "lag"))
    earned = stored_table(earned, "group-days")
    signals = received_signals(earned.select(*by, "lag", "t", F.col("signal").alias("v")), *by)
    traded = stored_table(earned.where("t >= begin").select(*by, "lag", "t", "r", "n_cls").join(group_weights(signals, *by), [*by, "lag", "t"]), "group-trades")
    profit = traded.groupBy(*by, "t", "n_cls").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("pnl"))
    pnl = profit.groupBy(*keys, "t").agg((F.sum(F.col("pnl") * F.col("n_cls")) / F.sum("n_cls")).alias("pnl"))
    raw = members.drop("width", "n_cls").join(traded.select(*by, "lag", "t", "w", "n_cls"), [*by, "lag"]).withColumn("raw", F.col("weight") * F.col("w") * F.col("n_cls"))
    total = F.sum(F.abs("raw")).over(Window.partitionBy(*keys, "t"))
    weights = raw.select(*keys, "series", "t", F.coalesce(F.try_divide("raw", total), F.lit(0.0)).alias("w"))
    return weights, pnl


def hedged_weights(weights: DataFrame, benchmark, keys: list[str]) -> DataFrame:
    """Weights with the benchmark sold for the net exposure of each cell and day; its return then belongs to the profit."""
    net = weights.groupBy(*keys, "t").agg((-F.sum("w")).alias("w")).select(*keys, F.lit(benchmark).alias("series"), "t", "w")
    return weights.unionByName(net).groupBy(*keys, "series", "t").agg(F.sum("w").alias("w"))


def best_cells(cells: DataFrame, weights: DataFrame, pnl: DataFrame, of: list[str], *parameters: str) -> DataFrame:
    """(of..., parameters..., score): for each value of `of` the parameters of the cell with the largest sum of profits; a
    cell without any position has the score minus infinity; of equals the least parameters."""
    keys = [*of, *parameters]
    held = weights.where("w <> 0").select(*keys).distinct().withColumn("held", F.lit(True))
    scores = cells.select(*keys).distinct().join(pnl.groupBy(*keys).agg(F.sum("pnl").alias("sum")), keys, "left").join(held, keys, "left")
    scores = scores.withColumn("score", F.when(F.col("held"), F.col("sum")).otherwise(F.lit(float("-inf"))))
    order = F.struct((-F.round("score", 9)).alias("s"), *parameters)
    return scores.groupBy(*of).agg(F.min_by(F.struct(*parameters, "score"), order).alias("b")).select(*of, "b.*")


def grid_backtest(panel: DataFrame, schedule: DataFrame, cells: DataFrame, model: str, parameters: list[str], max_lag: int, ahead: int, **how) -> DataFrame:
    """(start, model, parameters..., t, pnl): in every window each model's best parameters, by what they earned in it, traded
    in the days ahead; all windows, models and parameters are rows of one plan. Where the best cell has no position in the
    days ahead its profit is 0 or absent."""
    keys = ["start", model, *parameters]
    weights, pnl = cell_trades(panel, cells, periods(schedule), keys, max_lag, **how)
    best = stored_table(best_cells(cells, weights, pnl, ["start", model], *parameters), "best-cells")
    chosen = stored_table(cells.join(best.select(*keys), keys, "left_semi"), "chosen")
    return cell_trades(panel, chosen, periods(schedule, ahead), keys, max_lag, **how)[1]
