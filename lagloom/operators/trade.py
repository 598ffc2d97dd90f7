"""Trading on leads and lags: returns of groups, signals, weights, profit and its statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.scan import numbered, running_sum
from lagloom.functions.select import exact_quantiles
from lagloom.sources.storage import stored_table


def in_order():
    return Window.partitionBy("series").orderBy("t")


def sign(c) -> Column:
    return F.signum(c).cast("int")


def cumulative(panel: DataFrame, kind: str = "simple", *keys: str) -> DataFrame:
    """Running sums of simple returns, running products of gross ones, or running growth of log returns; without keys the
    sums run over the whole panel, range by range."""
    if not keys:
        value = F.ln("v") if kind == "percentage" else F.col("v")
        summed = running_sum(panel, value, ["t"], total="cumulative")
        return summed if kind == "simple" else summed.withColumn("cumulative", F.exp("cumulative"))
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    v = {"simple": F.sum("v").over(w), "log": F.exp(F.sum("v").over(w)), "percentage": F.exp(F.sum(F.ln("v")).over(w))}[kind]
    return panel.withColumn("cumulative", v)


def sharpe(v: Column) -> Column:
    """Mean over deviation, for 252 days."""
    return F.try_divide(F.avg(v), F.stddev_pop(v)) * math.sqrt(252)


def average_rank(c: str, keys: list[str]) -> Column:
    """Ranks from 1; equal values share the mean of their ranks."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys..., rho, n)."""
    ranks = df.select(*keys, average_rank(x, list(keys)).alias("rx"), average_rank(y, list(keys)).alias("ry"))
    return ranks.groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def student_tail(t: float, df: int) -> float:
    """P(|T| > t): the regularised incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def with_p_value(correlations: DataFrame) -> DataFrame:
    """(..., rho, n, p): two-sided p-values of rank correlations, by Student's t."""

    @F.pandas_udf("double")
    def p(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or m < 3 or r != r else 0.0 if abs(r) >= 1 else student_tail(abs(r) * math.sqrt((m - 2) / (1 - r * r)), int(m) - 2) for r, m in zip(rho, n, strict=True)], dtype="float64")

    return correlations.withColumn("p", p("rho", "n"))


def hit_ratio(ret: Column, signal: Column) -> Column:
    return F.avg(F.when(signal != 0, (F.signum(ret) == F.signum(signal)).cast("int")))


def long_ratio(signal: Column) -> Column:
    return F.avg(F.when(signal != 0, (signal > 0).cast("int")))


def statistics(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., mean, sr, hit_ratio, long_ratio, r2, total) of (keys..., signal, ret, pnl)."""
    return df.groupBy(*keys).agg(
        F.avg("pnl").alias("mean"), sharpe(F.col("pnl")).alias("sr"), hit_ratio(F.col("ret"), F.col("signal")).alias("hit_ratio"),
        long_ratio(F.col("signal")).alias("long_ratio"), F.regr_r2("ret", "signal").alias("r2"), F.sum("pnl").alias("total"),
    )


def group_returns(panel: DataFrame, groups: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """(keys..., lag, t, v, n): mean (or weighted sum) of returns of the series of a group (keys..., lag, series[, weight])."""
    v = F.sum(F.col("v") * F.col(weight)) if weight else F.avg("v")
    return panel.join(groups, "series").groupBy(*keys, "lag", "t").agg(v.alias("v"), F.count("*").alias("n"))


def rolling_sum(v: Column, n: int, *keys: str, by: str = "t") -> Column:
    """Sums of the last n values; null until there are n."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(1 - n, 0)
    return F.when(F.count(v).over(w) == n, F.sum(v).over(w))


def two_group_pnl(lead: DataFrame, follow: DataFrame, lag: int, watch: int = 1, hold: int = 1) -> DataFrame:
    """(t, signal, ret, pnl) of followers (t, v: mean return) on leaders (t, v: summed return): the sign of what leaders
    made in the watch days that end lag + hold - 1 days before, times what followers made in the last hold days."""
    watched = lead.select("t", rolling_sum(F.col("v"), watch).alias("s"))
    held = follow.select("t", rolling_sum(F.col("v"), hold).alias("ret"))
    moved = watched.select((F.col("t") + (lag + hold - 1)).alias("t"), sign("s").alias("signal"))
    return held.join(moved, "t", "left").select("t", "signal", "ret", (F.col("signal") * F.col("ret")).alias("pnl"))


def pair_pnl(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys..., l1, l2, t, signal, ret, pnl) of all pairs of lag groups l1 < l2 of (keys..., lag, t, v): the later group
    is traded on the sign of the earlier one's return l2 - l1 days before."""
    a = groups.select(*keys, F.col("lag").alias("l1"), F.col("t").alias("t1"), F.col("v").alias("lead"))
    later = groups.select(*keys, F.col("lag").alias("l2"), "t", F.col("v").alias("ret"))
    # lags are few: each later group asks for every lag before it, so the join is on equal keys
    asks = later.where("l2 > 0").withColumn("l1", F.explode(F.sequence(F.lit(0), F.col("l2") - 1))).withColumn("t1", F.col("t") - (F.col("l2") - F.col("l1")))
    both = asks.join(a, [*keys, "l1", "t1"])
    return both.select(*keys, "l1", "l2", "t", sign("lead").alias("signal"), "ret", (sign("lead") * F.col("ret")).alias("pnl"))


def averaged(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., t, pnl): the mean over pairs that trade on a day."""
    return pairs.groupBy(*keys, "t").agg(F.avg("pnl").alias("pnl"))


def received_signals(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys..., lag, t, signal): for each group and day, the signs of all earlier groups' signals as many days before as
    they are ahead, added; 0 for the first group and for days before the lag."""
    a = groups.select(*keys, F.col("lag").alias("la"), F.col("t").alias("ta"), F.col("v").alias("s"))
    b = groups.select(*keys, "lag", "t")
    asks = b.where("lag > 0").withColumn("la", F.explode(F.sequence(F.lit(0), F.col("lag") - 1))).withColumn("ta", F.col("t") - (F.col("lag") - F.col("la")))
    sums = asks.join(a, [*keys, "la", "ta"]).groupBy(*keys, "lag", "t").agg(F.sum(sign("s")).alias("s"))
    return b.join(sums, [*keys, "lag", "t"], "left").select(*keys, "lag", "t", F.when(F.col("t") >= F.col("lag"), F.coalesce("s", F.lit(0))).otherwise(0).cast("int").alias("signal"))


def group_weights(signals: DataFrame, *keys: str) -> DataFrame:
    """(keys..., lag, t, w): signals of a day divided by the sum of their sizes; all 0 stays 0."""
    total = F.sum(F.abs("signal")).over(Window.partitionBy(*keys, "t"))
    return signals.withColumn("w", F.coalesce(F.try_divide(F.col("signal"), total), F.lit(0.0))).select(*keys, "lag", "t", "w")


def group_trades(groups: DataFrame, *keys: str, watch: int = 1, hold: int = 1) -> DataFrame:
    """(keys..., t, pnl, w, lead) of trading lag groups (keys..., lag, t, v) on the groups before them: profit, net exposure
    and what the first group made; days without a held return have no exposure."""
    rolled = groups.withColumn("s", rolling_sum(F.col("v"), watch, *keys, "lag")).withColumn("r", rolling_sum(F.col("v"), hold, *keys, "lag"))
    w = group_weights(received_signals(rolled.select(*keys, "lag", "t", F.col("s").alias("v")), *keys), *keys)
    net, first = F.when(F.col("r").isNotNull(), F.col("w")), F.when(F.col("lag") == 0, F.col("r"))
    return rolled.join(w, [*keys, "lag", "t"]).groupBy(*keys, "t").agg(F.sum(F.col("w") * F.col("r")).alias("pnl"), F.sum(net).alias("w"), F.max(first).alias("lead"))


def group_pnl(groups: DataFrame, *keys: str, watch: int = 1, hold: int = 1) -> DataFrame:
    """(keys..., t, pnl) of trading lag groups (keys..., lag, t, v) on the groups before them."""
    return group_trades(groups, *keys, watch=watch, hold=hold).select(*keys, "t", "pnl")


def inverse_volatility(panel: DataFrame, start: int, days: int = 20, measure: str = "sd") -> DataFrame:
    """(series, weight): 1 over the volatility of the days before start, clipped to its 5th and 95th percentiles."""
    v = {"sd": F.stddev_samp("v"), "variance": F.var_samp("v"), "square": F.avg(F.col("v") ** 2)}[measure]
    past = panel.where((F.col("t") >= start - days) & (F.col("t") < start)).groupBy("series").agg(F.try_divide(F.lit(1.0), v).alias("w"))
    cut = exact_quantiles(past, F.col("w"), [0.05, 0.95])
    return past.join(F.broadcast(cut)).select("series", F.least(F.greatest("w", F.col("q")[0]), F.col("q")[1]).alias("weight"))


def asset_weights(groups: DataFrame, group_w: DataFrame, *keys: str) -> DataFrame:
    """(keys..., series, t, w): group weights spread over their series by weight and scaled to a total size of 1 a day."""
    raw = groups.join(group_w, [*keys, "lag"]).withColumn("raw", F.col("weight") * F.col("w"))
    total = F.sum(F.abs("raw")).over(Window.partitionBy("t"))
    return raw.select(*keys, "series", "t", F.coalesce(F.try_divide(F.col("raw"), total), F.lit(0.0)).alias("w"))


def portfolio_pnl(weights: DataFrame, panel: DataFrame, *keys: str) -> DataFrame:
    return weights.join(panel, ["series", "t"]).groupBy(*keys, "t").agg(F.sum(F.col("w") * F.col("v")).alias("pnl"))


def turnover(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """(t, turnover): what is traded a day, next to the weights that the day before drifted into."""
    held = weights.join(panel, ["series", "t"], "left").fillna(0.0, ["v"])
    day = held.groupBy("t").agg(F.sum(F.col("w") * F.col("v")).alias("r"))
    drift = held.join(day, "t").withColumn("d", F.col("w") * (1 + F.col("v")) / (1 + F.col("r")))
    prev = F.lag("d").over(in_order())
    return drift.withColumn("trade", F.abs(F.col("w") - prev)).where(F.col("trade").isNotNull()).groupBy("t").agg(F.sum("trade").alias("turnover"))


def simple_turnover(weights: DataFrame) -> DataFrame:
    """(turnover): the mean over series of mean daily changes of weights."""
    change = weights.withColumn("c", F.abs(F.col("w") - F.lag("w").over(in_order())))
    return change.agg(F.avg("c").alias("turnover"))


def hedged(weights: DataFrame, benchmark) -> DataFrame:
    """Weights with the benchmark sold for the net exposure of each day."""
    net = weights.groupBy("t").agg((-F.sum("w")).alias("w")).select(F.lit(benchmark).alias("series"), "t", "w")
    return weights.select("series", "t", "w").unionByName(net)


def return_types(pnl: DataFrame, exposure: DataFrame, market: DataFrame, leader: DataFrame) -> DataFrame:
    """(t, raw, mkt_excess, lead_excess, lead_raw, lead_mkt_excess) of daily profit (t, pnl), its net exposure (t, w),
    market returns (t, v) and leader returns (t, v)."""
    all_ = pnl.join(exposure, "t").join(market.select("t", F.col("v").alias("m")), "t").join(leader.select("t", F.col("v").alias("l")), "t")
    return all_.select(
        "t", F.col("pnl").alias("raw"), (F.col("pnl") - F.col("w") * F.col("m")).alias("mkt_excess"), (F.col("pnl") - F.col("w") * F.col("l")).alias("lead_excess"),
        F.col("l").alias("lead_raw"), (F.col("l") - F.col("m")).alias("lead_mkt_excess"),
    )


def tradable_groups(lags: DataFrame, n: int, k: int, max_lag: int) -> DataFrame:
    """(cls, lag, series, n_cls) of classes large enough (over 0.2 n / k) and of lag groups large enough (a tenth of the class
    over the lags or more), at least two in a class; lags start from 0."""
    size = lags.withColumn("n_cls", F.count("*").over(Window.partitionBy("cls"))).where(F.col("n_cls") > math.floor(0.2 * n / k))
    size = size.withColumn("n_lag", F.count("*").over(Window.partitionBy("cls", "lag")))
    size = size.where(F.col("n_lag") >= 0.1 * F.floor(F.col("n_cls") / max_lag + 1))
    w = Window.partitionBy("cls")
    size = size.withColumn("n_groups", F.size(F.collect_set("lag").over(w))).where("n_groups >= 2")
    return size.select("cls", (F.col("lag") - F.min("lag").over(w)).alias("lag"), "series", "n_cls")


def class_weighted_pnl(pnl: DataFrame) -> DataFrame:
    """(t, pnl) of classes (cls, t, pnl, n_cls), weighed by their size."""
    return pnl.groupBy("t").agg((F.sum(F.col("pnl") * F.col("n_cls")) / F.sum("n_cls")).alias("pnl"))


def class_strategy(panel: DataFrame, held: DataFrame, market: DataFrame, watch: int = 1, hold: int = 1) -> DataFrame:
    """(t, raw, mkt_excess, lead_excess, lead_raw, lead_mkt_excess): the lag groups of every class (held: cls, lag, series,
    n_cls, as of tradable_groups) traded on the groups before them, plain and less exposure to the market (t, v) or to
    the leaders; days of a class count by its size. A class has no day where its leaders or the market made no return."""
    sizes = held.select("cls", "n_cls").distinct()
    rolled = market.select("t", rolling_sum(F.col("v"), hold).alias("v"))
    days = group_trades(group_returns(panel, held.select("cls", "lag", "series"), "cls"), "cls", watch=watch, hold=hold)
    days = days.where("lead IS NOT NULL").join(rolled.where("v IS NOT NULL"), "t").join(sizes, "cls")
    kinds = {
        "raw": F.col("pnl"), "mkt_excess": F.col("pnl") - F.col("w") * F.col("v"), "lead_excess": F.col("pnl") - F.col("w") * F.col("lead"),
        "lead_raw": F.col("lead"), "lead_mkt_excess": F.col("lead") - F.col("v"),
    }
    return days.groupBy("t").agg(*[(F.sum(x * F.col("n_cls")) / F.sum("n_cls")).alias(name) for name, x in kinds.items()])


def ranked_strategy(panel: DataFrame, pairs: DataFrame, share: float = 0.2, lag: int = 1) -> DataFrame:
    """(t, signal, ret, pnl): series ranked by the mean sign of their lags (ties by name); the first share leads, the
    last follows; followers' mean return is traded on the sign of leaders' mean return `lag` days before."""
    score = pairs.groupBy(F.col("i").alias("series")).agg(F.avg(F.signum("lag")).alias("s"))
    n = Window.orderBy("s", "series")
    place = score.select("series", F.row_number().over(n).alias("r")).join(F.broadcast(score.agg(F.count("*").alias("n"))))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    lead, follow = place.where(F.col("r") <= cut), place.where(F.col("r") > F.col("n") - cut)
    mean = lambda s: panel.join(s.select("series"), "series", "left_semi").groupBy("t").agg(F.avg("v").alias("v"))
    return two_group_pnl(mean(lead), mean(follow), lag).where("signal IS NOT NULL")


def plain_strategy(panel: DataFrame, pairs: DataFrame, ranks: DataFrame | None = None, share: float = 0.2, watch: int = 1, hold: int = 1, benchmark=None) -> DataFrame:
    """(t, signal, no, mkt, lead): profit of the last share of series, traded on what the first share made in the `watch` days
    before t, and the same less the benchmark's or the leaders' return, by the signal. Series are ranked by the means of their
    rows of the lag matrix, or by `ranks` (series, rank) of any kind; equal ones by series. Followers are held for `hold`
    days from so many days after t as leaders are ahead of them on average, less one. pairs hold both orders; without a
    benchmark mkt is null. Days at the end of the panel hold what is left of it."""
    score = ranks or pairs.groupBy(F.col("i").alias("series")).agg(F.sum("lag").alias("rank"))
    place = stored_table(numbered(score, [F.round("rank", 9), "series"], n="n"), "places").withColumn("cut", F.floor(F.col("n") * share))
    lead, follow = place.where(F.col("place") < F.col("cut")).select("series"), place.where(F.col("place") >= F.col("n") - F.col("cut")).select("series")
    towards = lambda s: pairs.join(s.withColumnRenamed("series", "j"), "j", "left_semi").agg(F.avg("lag").alias("m"))
    means = towards(lead).withColumnRenamed("m", "a").join(F.broadcast(towards(follow)))
    ahead = means.select(F.greatest(F.lit(0), F.rint(F.coalesce(F.col("a") - F.col("m"), F.lit(0.0))) - 1).cast("int")).first()[0]
    mean = lambda s: panel.join(s, "series", "left_semi").groupBy("t").agg(F.avg("v").alias("v"))
    # a day counts on each day that looks at it
    seen = lambda rows, first, last, name: rows.select(F.explode(F.sequence(F.col("t") + first, F.col("t") + last)).alias("t"), "v").groupBy("t").agg(F.sum("v").alias(name))
    leaders = stored_table(mean(lead), "leaders")
    days = leaders.agg(F.max("t")).first()[0]
    out = seen(leaders, 1, watch, "watched").where((F.col("t") >= watch) & (F.col("t") + hold <= (days or 0)))
    out = out.join(seen(mean(follow), 1 - ahead - hold, -ahead, "held"), "t", "left").join(leaders.withColumnRenamed("v", "l"), "t", "left")
    if benchmark is None:
        out = out.withColumn("m", F.lit(None).cast("double"))
    else:
        out = out.join(seen(panel.where(F.col("series") == F.lit(benchmark)).select("t", "v"), 1 - hold, 0, "m"), "t", "left")
    alpha = F.col("signal") * F.coalesce("held", F.lit(0.0))
    out = out.withColumn("signal", sign(F.round("watched", 12)))
    return out.select("t", "signal", alpha.alias("no"), (alpha - F.col("signal") * F.col("m")).alias("mkt"), (alpha - F.col("signal") * F.col("l")).alias("lead"))


def asset_strategy(panel: DataFrame, pairs: DataFrame, share: float = 0.2) -> DataFrame:
    """(t, pnl): the last share of series by mean sign of lags, each on the signs of what every other series that leads it
    made its lag before; weights are winsorised a day and scaled to size 1. pairs hold both orders, lag > 0: i follows."""
    score = pairs.groupBy(F.col("i").alias("series")).agg(F.avg(F.signum("lag")).alias("s"))
    place = numbered(score, [F.desc("s"), "series"], n="n").select("series", F.coalesce(F.try_divide("place", F.col("n") - 1), F.lit(0.0)).alias("r")).where(F.col("r") < share)
    leads = pairs.where("lag > 0").join(place.select(F.col("series").alias("i")), "i")
    past = panel.select(F.col("series").alias("j"), F.col("t").alias("tj"), F.col("v").alias("vj"))
    raw = leads.join(past, "j").withColumn("t", F.col("tj") + F.col("lag")).groupBy(F.col("i").alias("series"), "t").agg(F.sum("vj").alias("raw"))
    w = raw.join(exact_quantiles(raw, F.col("raw"), [0.05, 0.95], "t"), "t").withColumn("w", F.least(F.greatest("raw", F.col("q")[0]), F.col("q")[1]))
    w = w.withColumn("w", F.coalesce(F.try_divide("w", F.sum(F.abs("w")).over(Window.partitionBy("t"))), F.lit(0.0)))
    return portfolio_pnl(w.select("series", "t", "w"), panel)


def best_parameters(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys..., k, sigma, score): the parameters with the largest in-sample score; of equals the least k, then sigma."""
    return scores.groupBy(*keys).agg(F.max_by(F.struct("k", "sigma", "score"), F.struct("score", -F.col("k"), -F.col("sigma"))).alias("b")).select(*keys, "b.k", "b.sigma", "b.score")


def yearly_sharpe(pnl: DataFrame, *keys: str) -> DataFrame:
    """(keys..., year, sr) of (keys..., date, pnl)."""
    return pnl.groupBy(*keys, F.year("date").alias("year")).agg(sharpe(F.col("pnl")).alias("sr"))


def rolled_up(pnl: DataFrame) -> DataFrame:
    """(model, cls, total): profit by class, model and in all."""
    return pnl.rollup("model", "cls").agg(F.sum("pnl").alias("total"))
