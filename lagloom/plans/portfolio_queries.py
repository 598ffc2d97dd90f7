"""The strategy of all classes over windows of nation months: cells of two models by one to three classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.operators import align as A
from lagloom.operators import cluster as C
from lagloom.operators import portfolio as P
from lagloom.plans.panel_queries import nation_returns, rounded
from lagloom.plans.registry import query
from lagloom.plans.trade_queries import WALK_LAGS
from lagloom.plans.walk import walk_lag_pairs, whole_schedule
from lagloom.sources.storage import stored_table

KEYS = ["start", "model", "k"]

#: Classes are the series' numbers modulo k. Model `mean`: lags are means of rows of the window's lag matrix within the
#: class; model `first`: lags to the class's least series.
CELLS_SQL = f"""{WALK_LAGS}, kk AS (SELECT unnest([1, 2, 3]) AS k), wm AS (SELECT start, i, j, lag FROM wb WHERE m = 3 UNION ALL SELECT start, j, i, -lag FROM wb WHERE m = 3),
own AS (SELECT start, k, (i % k)::INT AS cls, i, j, lag FROM wm, kk WHERE i % k = j % k),
sm AS (SELECT start, k, cls, i AS series, sum(lag) AS s FROM own GROUP BY ALL),
gcells AS (
  SELECT start, 'mean' AS model, k, series, cls, round_even((s - min(s) OVER p) / count(*) OVER p, 0)::INT AS lag FROM sm WINDOW p AS (PARTITION BY start, k, cls)
  UNION ALL
  SELECT start, 'first', k, series, cls, (CASE WHEN series = least_s THEN 0 ELSE (SELECT any_value(lag) FROM own o WHERE o.start = x.start AND o.k = x.k AND o.i = x.series AND o.j = least_s) END)::INT
  FROM (SELECT *, min(series) OVER (PARTITION BY start, k, cls) AS least_s FROM sm) x)"""


def trades_sql(name: str, cells: str, begin: str, end: str) -> str:
    """Tables {name}_w (weights) and {name}_p (profit) of cells traded in a period of each window."""
    n, by = name, "start, model, k, cls"
    return f"""
{n}_per AS (SELECT start, {begin} AS b, {end} AS e FROM w),
{n}_size AS (SELECT {by}, count(*) AS nc FROM {cells} GROUP BY ALL), {n}_all AS (SELECT start, model, k, sum(nc) AS n, count(*) AS kc FROM {n}_size GROUP BY ALL),
{n}_lag AS (SELECT {by}, lag, count(*) AS nl FROM {cells} GROUP BY ALL),
{n}_g AS (SELECT {by}, lag, nc FROM {n}_lag JOIN {n}_size USING ({by}) JOIN {n}_all USING (start, model, k) WHERE nc > floor(0.2 * n / kc) AND nl >= 0.1 * floor(nc / 3 + 1)),
{n}_t AS (SELECT *, min(lag) OVER c AS lo, max(lag) OVER c AS hi FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS ng FROM {n}_g) WHERE ng > 1 WINDOW c AS (PARTITION BY {by})),
{n}_v AS (SELECT start, series, 1 / nullif(stddev_samp(v), 0) AS raw FROM {n}_per JOIN rets ON t >= b - 20 AND t < b GROUP BY 1, 2),
{n}_r AS (SELECT {by}, series, lag, raw FROM {cells} JOIN {n}_v USING (start, series) WHERE raw IS NOT NULL),
{n}_q AS (SELECT {by}, quantile_cont(raw, 0.05) AS q0, quantile_cont(raw, 0.95) AS q1 FROM {n}_r GROUP BY ALL),
{n}_m AS (SELECT {by}, series, lag - lo AS lag, hi - lo AS width, nc, x / sum(x) OVER (PARTITION BY {by}, lag) AS weight
  FROM (SELECT *, least(greatest(raw, q0), q1) AS x FROM {n}_r JOIN {n}_q USING ({by}) JOIN {n}_t USING ({by}, lag))),
{n}_d AS (SELECT {by}, lag, t, any_value(b) AS b, any_value(nc) AS nc, sum(weight * v) AS v FROM {n}_m JOIN {n}_per USING (start) JOIN rets USING (series) WHERE t >= b - least(width + 1, b) AND t < e GROUP BY ALL),
{n}_s AS (SELECT x.start, x.model, x.k, x.cls, x.lag, x.t, x.v, x.nc, coalesce(sum(sign(y.v)), 0) AS s FROM {n}_d x LEFT JOIN {n}_d y
  ON y.start = x.start AND y.model = x.model AND y.k = x.k AND y.cls = x.cls AND y.lag < x.lag AND y.t = x.t - (x.lag - y.lag) AND x.t >= x.lag WHERE x.t >= x.b GROUP BY ALL),
{n}_gw AS (SELECT *, coalesce(s / nullif(sum(abs(s)) OVER (PARTITION BY {by}, t), 0), 0) AS gw FROM {n}_s),
{n}_p AS (SELECT start, model, k, t, sum(p * nc) / sum(nc) AS pnl FROM (SELECT {by}, t, nc, sum(gw * v) AS p FROM {n}_gw GROUP BY ALL) GROUP BY ALL),
{n}_a AS (SELECT {by}, m.series, g.t, weight * gw * g.nc AS raw FROM {n}_m m JOIN {n}_gw g USING ({by}, lag)),
{n}_w AS (SELECT start, model, k, series, t, coalesce(raw / nullif(sum(abs(raw)) OVER (PARTITION BY start, model, k, t), 0), 0) AS w FROM {n}_a)"""


IN_SQL = f"{CELLS_SQL}, {trades_sql('ins', 'gcells', 'start', 'stop')}"
BEST_SQL = f"""{IN_SQL}, sc AS (SELECT c.start, c.model, c.k, CASE WHEN h.k IS NULL THEN '-inf'::DOUBLE ELSE s END AS score FROM (SELECT DISTINCT start, model, k FROM gcells) c
  LEFT JOIN (SELECT start, model, k, sum(pnl) AS s FROM ins_p GROUP BY ALL) USING (start, model, k) LEFT JOIN (SELECT DISTINCT start, model, k FROM ins_w WHERE w <> 0) h USING (start, model, k)),
bc AS (SELECT start, model, k, score FROM (SELECT *, row_number() OVER (PARTITION BY start, model ORDER BY round(score, 9) DESC, k) AS r FROM sc) WHERE r = 1)"""
OUT_SQL = f"{BEST_SQL}, chosen AS (SELECT gcells.* FROM gcells JOIN bc USING (start, model, k)), {trades_sql('oos', 'chosen', 'stop', 'stop + 10')}"


def cells(spark, d):
    """The panel, its windows, and the cells (start, model, k, series, cls, lag)."""
    r = stored_table(nation_returns(spark, d), "returns")
    schedule = whole_schedule(r, 30, 10)
    pairs = stored_table(walk_lag_pairs(r, schedule, 3), "walk-pairs").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    own = pairs.where(F.col("i") % F.col("k") == F.col("j") % F.col("k")).withColumn("cls", (F.col("i") % F.col("k")).cast("int"))
    means = A.row_mean_lags(own.select("start", "k", "cls", "i", "j", "lag"), "start", "k", "cls")
    least = A.mirrored(own.select("start", "k", "cls", "i", "j", "lag")).groupBy("start", "k", "cls", F.col("i").alias("series")).agg(F.min_by(F.struct("j", "lag"), "j").alias("x"))
    firsts = least.select("start", "k", "cls", "series", F.when(F.col("x.j") < F.col("series"), F.col("x.lag")).otherwise(0).alias("lag"))
    both = means.withColumn("model", F.lit("mean")).unionByName(firsts.withColumn("model", F.lit("first")))
    return r, schedule, stored_table(both.select("start", "model", "k", "series", "cls", "lag"), "cells")


@query("cell_weights", f"{IN_SQL} SELECT start, model, k, series::BIGINT AS series, t, round(w, 6) + 0.0 AS w FROM ins_w")
def _(spark, d):
    r, schedule, c = cells(spark, d)
    weights = P.cell_trades(r, c, P.periods(schedule), KEYS, 3)[0]
    return rounded(weights.withColumn("series", F.col("series").cast("long")), "w")


@query("best_cells", f"{BEST_SQL} SELECT start, model, k, round(score, 6) + 0.0 AS score FROM bc")
def _(spark, d):
    r, schedule, c = cells(spark, d)
    weights, pnl = P.cell_trades(r, c, P.periods(schedule), KEYS, 3)
    return rounded(P.best_cells(c, weights, stored_table(pnl, "pnl"), ["start", "model"], "k"), "score")


@query("grid_backtest", f"{OUT_SQL} SELECT start, model, k, t, round(pnl, 6) + 0.0 AS pnl FROM oos_p")
def _(spark, d):
    r, schedule, c = cells(spark, d)
    return rounded(P.grid_backtest(r, schedule, c, "model", ["k"], 3, 10), "pnl")


@query("walk_forward_clusters")
def _(spark, d):
    """(start, k, series, cls): the spectral classes of every window's affinities, for one to three classes."""
    r = nation_returns(spark, d)
    pairs = C.nonnegative(stored_table(walk_lag_pairs(r, whole_schedule(r, 30, 10), 3), "walk-pairs"))
    return C.spectral_clusters(pairs, [1, 2, 3], "start")
