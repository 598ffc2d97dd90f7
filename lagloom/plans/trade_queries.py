"""Queries of trading operators, on the monthly returns of nations: classes are regions of three by number, lag groups the
number of a nation in its class modulo four."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.operators import trade as T
from lagloom.plans.align_queries import L, nation_pairs
from lagloom.plans.panel_queries import R, nation_returns, rounded
from lagloom.plans.registry import query
from lagloom.sources import panels as src
from lagloom.sources.storage import stored_table

G = f"""{R}, groups AS (SELECT DISTINCT series, (series % 3)::INT AS cls, ((series // 3) % 4)::INT AS lag FROM rets),
gr AS (SELECT cls, lag, t, avg(v) AS v, count(*) AS n FROM rets JOIN groups USING (series) GROUP BY 1, 2, 3)"""


def groups(panel):
    return panel.select("series").distinct().select("series", (F.col("series") % 3).cast("int").alias("cls"), F.pmod(F.floor(F.col("series") / 3), F.lit(4)).cast("int").alias("lag"))


def group_rows(spark, d):
    r = nation_returns(spark, d)
    return r, T.group_returns(r, groups(r), "cls")


@query("cumulative_returns", f"""{R} SELECT series, t, round(sum(v) OVER w, 6) + 0.0 AS simple, round(exp(sum(v) OVER w), 6) AS log, round(exp(sum(ln(exp(v))) OVER w), 6) AS percentage
FROM rets WINDOW w AS (PARTITION BY series ORDER BY t)""")
def _(spark, d):
    r = nation_returns(spark, d)
    gross = r.withColumn("v", F.exp("v"))
    a, b, c = (T.cumulative(x, k, "series").select("series", "t", F.col("cumulative").alias(k)) for x, k in ((r, "simple"), (r, "log"), (gross, "percentage")))
    return rounded(a.join(b, ["series", "t"]).join(c, ["series", "t"]), "simple", "log", "percentage")


@query("sharpe_ratio", f"{R} SELECT series, round(avg(v) / nullif(stddev_pop(v), 0) * sqrt(252), 6) + 0.0 AS sr FROM rets GROUP BY 1")
def _(spark, d):
    return rounded(nation_returns(spark, d).groupBy("series").agg(T.sharpe(F.col("v")).alias("sr")), "sr")


@query("spearman", f"""{R}, p AS (SELECT a.series, a.v AS x, b.v AS y FROM rets a JOIN rets b ON b.series = 0 AND a.t = b.t WHERE a.series > 0),
k AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2 AS ry FROM p)
SELECT series, round(corr(rx, ry), 6) + 0.0 AS rho, count(*) AS n FROM k GROUP BY 1""")
def _(spark, d):
    r = nation_returns(spark, d)
    both = r.where("series > 0").select("series", "t", F.col("v").alias("x")).join(r.where("series = 0").select("t", F.col("v").alias("y")), "t")
    return rounded(T.spearman(both, "x", "y", "series"), "rho")


@query("spearman_p_value")
def _(spark, d):
    r = nation_returns(spark, d)
    both = r.where("series > 0").select("series", "t", F.col("v").alias("x")).join(r.where("series = 0").select("t", F.col("v").alias("y")), "t")
    return T.with_p_value(T.spearman(both, "x", "y", "series"))


SIG = f"{R}, s AS (SELECT a.series, a.t, sign(b.v)::INT AS signal, a.v AS ret, sign(b.v)::INT * a.v AS pnl FROM rets a JOIN rets b ON b.series = 0 AND b.t = a.t - 1 WHERE a.series > 0)"


def signals(spark, d):
    r = nation_returns(spark, d)
    lead = r.where("series = 0").select((F.col("t") + 1).alias("t"), T.sign("v").alias("signal"))
    return r.where("series > 0").join(lead, "t").select("series", "t", "signal", F.col("v").alias("ret"), (F.col("signal") * F.col("v")).alias("pnl"))


@query("hit_ratio", f"{SIG} SELECT series, round(avg((sign(ret) = signal)::INT) FILTER (WHERE signal <> 0), 9) AS hit_ratio FROM s GROUP BY 1")
def _(spark, d):
    return rounded(signals(spark, d).groupBy("series").agg(T.hit_ratio(F.col("ret"), F.col("signal")).alias("hit_ratio")), "hit_ratio", digits=9)


@query("long_ratio", f"{SIG} SELECT series, round(avg((signal > 0)::INT) FILTER (WHERE signal <> 0), 9) AS long_ratio FROM s GROUP BY 1")
def _(spark, d):
    return rounded(signals(spark, d).groupBy("series").agg(T.long_ratio(F.col("signal")).alias("long_ratio")), "long_ratio", digits=9)


@query("regression_r2", f"{SIG} SELECT series, round(regr_r2(ret, signal), 6) AS r2 FROM s GROUP BY 1")
def _(spark, d):
    return rounded(signals(spark, d).groupBy("series").agg(F.regr_r2("ret", "signal").alias("r2")), "r2")


@query("financial_statistics", f"""{SIG} SELECT series, round(avg(pnl), 6) + 0.0 AS mean, round(avg(pnl) / nullif(stddev_pop(pnl), 0) * sqrt(252), 6) + 0.0 AS sr,
round(avg((sign(ret) = signal)::INT) FILTER (WHERE signal <> 0), 6) AS hit_ratio, round(avg((signal > 0)::INT) FILTER (WHERE signal <> 0), 6) AS long_ratio, round(regr_r2(ret, signal), 6) AS r2, round(sum(pnl), 6) + 0.0 AS total FROM s GROUP BY 1""")
def _(spark, d):
    return rounded(T.statistics(signals(spark, d), "series"), "mean", "sr", "hit_ratio", "long_ratio", "r2", "total")


@query("group_returns", f"{G} SELECT lag, t, round(avg(v), 6) + 0.0 AS v FROM gr GROUP BY 1, 2")
def _(spark, d):
    _, g = group_rows(spark, d)
    return rounded(g.groupBy("lag", "t").agg(F.avg("v").alias("v")), "v")


TWO = f"""{R}, l AS (SELECT t, sum(v) AS v FROM rets WHERE series < 8 GROUP BY 1), f AS (SELECT t, avg(v) AS v FROM rets WHERE series >= 16 GROUP BY 1)"""


def two(spark, d):
    r = nation_returns(spark, d)
    return r.where("series < 8").groupBy("t").agg(F.sum("v").alias("v")), r.where("series >= 16").groupBy("t").agg(F.avg("v").alias("v"))


@query("two_group_pnl", f"{TWO} SELECT f.t, sign(l.v)::INT AS signal, round(f.v, 6) + 0.0 AS ret, round(sign(l.v) * f.v, 6) + 0.0 AS pnl FROM f LEFT JOIN l ON l.t = f.t - 2")
def _(spark, d):
    return rounded(T.two_group_pnl(*two(spark, d), lag=2), "ret", "pnl")


@query("two_group_pnl_windows", f"""{TWO}, s AS (SELECT t, CASE WHEN count(*) OVER w = 3 THEN sum(v) OVER w END AS s FROM l WINDOW w AS (ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
h AS (SELECT t, CASE WHEN count(*) OVER w = 2 THEN sum(v) OVER w END AS r FROM f WINDOW w AS (ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT h.t, sign(s.s)::INT AS signal, round(r, 6) + 0.0 AS ret, round(sign(s.s) * r, 6) + 0.0 AS pnl FROM h LEFT JOIN s ON s.t = h.t - 3""")
def _(spark, d):
    return rounded(T.two_group_pnl(*two(spark, d), lag=2, watch=3, hold=2), "ret", "pnl")


@query("weighted_two_group_pnl", f"""{R}, l AS (SELECT t, sum(v * (series + 1)) / 36 AS v FROM rets WHERE series < 8 GROUP BY 1), f AS (SELECT t, sum(v * series) / 180 AS v FROM rets WHERE series >= 16 GROUP BY 1)
SELECT f.t, sign(l.v)::INT AS signal, round(f.v, 6) + 0.0 AS ret, round(sign(l.v) * f.v, 6) + 0.0 AS pnl FROM f LEFT JOIN l ON l.t = f.t - 1""")
def _(spark, d):
    r = nation_returns(spark, d)
    names = r.select("series").distinct()
    lead = names.where("series < 8").select("series", F.lit(0).alias("lag"), ((F.col("series") + 1) / 36).alias("weight"))
    follow = names.where("series >= 16").select("series", F.lit(1).alias("lag"), (F.col("series") / 180).alias("weight"))
    return rounded(T.two_group_pnl(T.group_returns(r, lead, weight="weight"), T.group_returns(r, follow, weight="weight"), lag=1), "ret", "pnl")


PAIRS = f"{G}, pp AS (SELECT b.cls, a.lag AS l1, b.lag AS l2, b.t, sign(a.v)::INT AS signal, b.v AS ret, sign(a.v) * b.v AS pnl FROM gr a JOIN gr b ON a.cls = b.cls AND a.lag < b.lag AND a.t = b.t - (b.lag - a.lag))"


@query("lag_pair_pnl", f"{PAIRS} SELECT cls, l1, l2, t, signal, round(ret, 6) + 0.0 AS ret, round(pnl, 6) + 0.0 AS pnl FROM pp")
def _(spark, d):
    return rounded(T.pair_pnl(group_rows(spark, d)[1], "cls"), "ret", "pnl")


@query("class_average_pnl", f"{PAIRS} SELECT cls, t, round(avg(pnl), 6) + 0.0 AS pnl FROM pp GROUP BY 1, 2")
def _(spark, d):
    return rounded(T.averaged(T.pair_pnl(group_rows(spark, d)[1], "cls"), "cls"), "pnl")


@query("group_performance", f"{PAIRS} SELECT l1, l2, round(avg(pnl), 6) + 0.0 AS mean, round(avg(pnl) / nullif(stddev_pop(pnl), 0) * sqrt(252), 6) + 0.0 AS sr FROM pp GROUP BY 1, 2")
def _(spark, d):
    return rounded(T.statistics(T.pair_pnl(group_rows(spark, d)[1], "cls"), "l1", "l2").select("l1", "l2", "mean", "sr"), "mean", "sr")


@query("rolling_sum", f"{R} SELECT series, t, round(CASE WHEN count(*) OVER w = 4 THEN sum(v) OVER w END, 6) + 0.0 AS v FROM rets WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return rounded(nation_returns(spark, d).withColumn("v", T.rolling_sum(F.col("v"), 4, "series")), "v")


VOL = "vol AS (SELECT series, 1 / nullif(stddev_samp(v), 0) AS w FROM rets WHERE t >= 30 AND t < 50 GROUP BY 1), iv AS (SELECT series, least(greatest(w, (SELECT quantile_cont(w, 0.05) FROM vol)), (SELECT quantile_cont(w, 0.95) FROM vol)) AS weight FROM vol)"


@query("volatility", f"{R} SELECT series, round(stddev_samp(v), 6) AS sd, round(var_samp(v), 6) AS variance, round(avg(v * v), 6) AS square FROM rets WHERE t > (SELECT max(t) FROM rets) - 20 GROUP BY 1")
def _(spark, d):
    r = nation_returns(spark, d)
    past = r.where(F.col("t") > r.agg(F.max("t")).first()[0] - 20)
    return rounded(past.groupBy("series").agg(F.stddev_samp("v").alias("sd"), F.var_samp("v").alias("variance"), F.avg(F.col("v") * F.col("v")).alias("square")), "sd", "variance", "square")


@query("inverse_volatility_weights", f"{R}, {VOL} SELECT series, round(weight, 6) AS weight FROM iv")
def _(spark, d):
    return rounded(T.inverse_volatility(nation_returns(spark, d), 50), "weight")


REC = f"""{G}, rec AS (SELECT b.cls, b.lag, b.t, coalesce(sum(sign(a.v)), 0)::INT AS s FROM gr b LEFT JOIN gr a ON a.cls = b.cls AND a.lag < b.lag AND a.t = b.t - (b.lag - a.lag) AND b.t >= b.lag GROUP BY 1, 2, 3),
gw AS (SELECT cls, lag, t, coalesce(s / nullif(sum(abs(s)) OVER (PARTITION BY cls, t), 0), 0) AS w FROM rec)"""


@query("received_signals", f"{REC} SELECT cls, lag, t, s AS signal FROM rec")
def _(spark, d):
    return T.received_signals(group_rows(spark, d)[1], "cls")


@query("group_weights", f"{REC} SELECT cls, lag, t, round(w, 9) + 0.0 AS w FROM gw")
def _(spark, d):
    return rounded(T.group_weights(T.received_signals(group_rows(spark, d)[1], "cls"), "cls"), "w", digits=9)


GP = f"{REC}, gp AS (SELECT cls, t, sum(w * v) AS pnl FROM gw JOIN gr USING (cls, lag, t) GROUP BY 1, 2)"


@query("lag_group_pnl", f"{GP} SELECT cls, t, round(pnl, 6) + 0.0 AS pnl FROM gp")
def _(spark, d):
    return rounded(T.group_pnl(group_rows(spark, d)[1], "cls"), "pnl")


@query("class_weighted_pnl", f"{GP}, n AS (SELECT cls, count(*) AS n FROM groups GROUP BY 1) SELECT t, round(sum(pnl * n) / sum(n), 6) + 0.0 AS pnl FROM gp JOIN n USING (cls) GROUP BY 1")
def _(spark, d):
    r, g = group_rows(spark, d)
    n = groups(r).groupBy("cls").agg(F.count("*").alias("n_cls"))
    return rounded(T.class_weighted_pnl(T.group_pnl(g, "cls").join(n, "cls")), "pnl")


AW = f"""{REC}, {VOL}, raw AS (SELECT groups.cls, series, t, weight * w AS raw FROM groups JOIN iv USING (series) JOIN gw USING (cls, lag)),
aw AS (SELECT cls, series, t, coalesce(raw / nullif(sum(abs(raw)) OVER (PARTITION BY t), 0), 0) AS w FROM raw)"""


def asset_w(spark, d):
    r, g = group_rows(spark, d)
    held = groups(r).join(T.inverse_volatility(r, 50), "series")
    return r, T.asset_weights(held, T.group_weights(T.received_signals(g, "cls"), "cls"), "cls")


@query("asset_weights", f"{AW} SELECT series, t, round(w, 6) + 0.0 AS w FROM aw")
def _(spark, d):
    return rounded(asset_w(spark, d)[1].select("series", "t", "w"), "w")


@query("portfolio_pnl", f"{AW} SELECT t, round(sum(w * v), 6) + 0.0 AS pnl FROM aw JOIN rets USING (series, t) GROUP BY 1")
def _(spark, d):
    r, w = asset_w(spark, d)
    return rounded(T.portfolio_pnl(w, r), "pnl")


@query("turnover_with_drift", f"""{AW}, dayr AS (SELECT t, sum(w * v) AS r FROM aw JOIN rets USING (series, t) GROUP BY 1),
dr AS (SELECT series, t, w, w * (1 + v) / (1 + r) AS d FROM aw JOIN rets USING (series, t) JOIN dayr USING (t)), tr AS (SELECT t, abs(w - lag(d) OVER (PARTITION BY series ORDER BY t)) AS x FROM dr)
SELECT t, round(sum(x), 6) AS turnover FROM tr WHERE x IS NOT NULL GROUP BY 1""")
def _(spark, d):
    r, w = asset_w(spark, d)
    return rounded(T.turnover(w.select("series", "t", "w"), r), "turnover")


@query("turnover_simple", f"{AW}, c AS (SELECT abs(w - lag(w) OVER (PARTITION BY series ORDER BY t)) AS c FROM aw) SELECT round(avg(c), 6) AS turnover FROM c")
def _(spark, d):
    return rounded(T.simple_turnover(asset_w(spark, d)[1]), "turnover")


@query("market_hedge", f"{AW} SELECT series, t, round(w, 6) + 0.0 AS w FROM aw UNION ALL SELECT -1, t, round(-sum(w), 6) + 0.0 FROM aw GROUP BY t")
def _(spark, d):
    return rounded(T.hedged(asset_w(spark, d)[1], -1), "w")


@query("return_types", f"""{AW}, p AS (SELECT t, sum(w * v) AS pnl, sum(w) AS w FROM aw JOIN rets USING (series, t) GROUP BY 1), m AS (SELECT t, avg(v) AS m FROM rets GROUP BY 1), l AS (SELECT t, avg(v) AS l FROM rets JOIN groups USING (series) WHERE lag = 0 GROUP BY 1)
SELECT t, round(pnl, 6) + 0.0 AS raw, round(pnl - w * m, 6) + 0.0 AS mkt_excess, round(pnl - w * l, 6) + 0.0 AS lead_excess, round(l, 6) + 0.0 AS lead_raw, round(l - m, 6) + 0.0 AS lead_mkt_excess FROM p JOIN m USING (t) JOIN l USING (t)""")
def _(spark, d):
    r, w = asset_w(spark, d)
    lead = r.join(groups(r).where("lag = 0").select("series"), "series", "left_semi")
    mean = lambda x: x.groupBy("t").agg(F.avg("v").alias("v"))
    out = T.return_types(T.portfolio_pnl(w, r), w.groupBy("t").agg(F.sum("w").alias("w")), mean(r), mean(lead))
    return rounded(out, "raw", "mkt_excess", "lead_excess", "lead_raw", "lead_mkt_excess")


@query("tradable_groups", f"""{G}, c AS (SELECT *, count(*) OVER (PARTITION BY cls) AS nc, count(*) OVER (PARTITION BY cls, lag) AS nl FROM groups), k AS (SELECT * FROM c WHERE nc > floor(0.2 * 25 / 3) AND nl >= 0.1 * floor(nc / 4 + 1)),
g2 AS (SELECT cls FROM k GROUP BY 1 HAVING count(DISTINCT lag) >= 2) SELECT cls, (lag - min(lag) OVER (PARTITION BY cls))::INT AS lag, series, nc AS n_cls FROM k WHERE cls IN (SELECT cls FROM g2)""")
def _(spark, d):
    return T.tradable_groups(groups(nation_returns(spark, d)), 25, 3, 4)


@query("class_strategy", f"""{REC}, p AS (SELECT cls, t, sum(w * v) AS pnl, sum(w) AS w FROM gr JOIN gw USING (cls, lag, t) GROUP BY 1, 2), m AS (SELECT t, avg(v) AS m FROM rets GROUP BY 1),
l AS (SELECT cls, t, v AS l FROM gr WHERE lag = 0), n AS (SELECT cls, count(*) AS n FROM groups GROUP BY 1)
SELECT t, round(sum(pnl * n) / sum(n), 6) + 0.0 AS raw, round(sum((pnl - w * m) * n) / sum(n), 6) + 0.0 AS mkt_excess, round(sum((pnl - w * l) * n) / sum(n), 6) + 0.0 AS lead_excess,
round(sum(l * n) / sum(n), 6) + 0.0 AS lead_raw, round(sum((l - m) * n) / sum(n), 6) + 0.0 AS lead_mkt_excess FROM p JOIN l USING (cls, t) JOIN m USING (t) JOIN n USING (cls) GROUP BY 1""")
def _(spark, d):
    r = nation_returns(spark, d)
    out = T.class_strategy(r, T.tradable_groups(groups(r), 25, 3, 4), r.groupBy("t").agg(F.avg("v").alias("v")))
    return rounded(out, "raw", "mkt_excess", "lead_excess", "lead_raw", "lead_mkt_excess")


RANK = f"""{L}, sc AS (SELECT i AS series, avg(sign(lag)) AS s FROM mirror GROUP BY 1), pl AS (SELECT series, row_number() OVER (ORDER BY s, series) AS r, count(*) OVER () AS n FROM sc),
le AS (SELECT t, avg(v) AS v FROM rets WHERE series IN (SELECT series FROM pl WHERE r <= greatest(1, floor(n * 0.2))) GROUP BY 1), fo AS (SELECT t, avg(v) AS v FROM rets WHERE series IN (SELECT series FROM pl WHERE r > n - greatest(1, floor(n * 0.2))) GROUP BY 1)"""


@query("ranked_strategy", f"{RANK} SELECT fo.t, sign(le.v)::INT AS signal, round(fo.v, 6) + 0.0 AS ret, round(sign(le.v) * fo.v, 6) + 0.0 AS pnl FROM fo JOIN le ON le.t = fo.t - 1")
def _(spark, d):
    from lagloom.operators.align import mirrored

    return rounded(T.ranked_strategy(nation_returns(spark, d), mirrored(nation_pairs(spark, d))), "ret", "pnl")


PLAIN = f"""{L}, sc AS (SELECT i AS series, sum(lag) AS s FROM mirror GROUP BY 1), pl AS (SELECT series, row_number() OVER (ORDER BY s, series) - 1 AS r, floor(count(*) OVER () * 0.2) AS cut, count(*) OVER () AS n FROM sc),
ah AS (SELECT greatest(0, round_even((SELECT avg(lag) FROM mirror JOIN pl ON pl.series = j WHERE r < cut) - (SELECT avg(lag) FROM mirror JOIN pl ON pl.series = j WHERE r >= n - cut), 0) - 1)::INT AS ahead),
le AS (SELECT t, avg(v) AS v FROM rets WHERE series IN (SELECT series FROM pl WHERE r < cut) GROUP BY 1), fo AS (SELECT t, avg(v) AS v FROM rets WHERE series IN (SELECT series FROM pl WHERE r >= n - cut) GROUP BY 1),
dy AS (SELECT i::INT AS t FROM (SELECT unnest(range(2, (SELECT max(t) FROM le)::INT - 1)) AS i)),
st AS (SELECT t, (SELECT sign(round(sum(v), 12))::INT FROM le WHERE le.t >= dy.t - 2 AND le.t < dy.t) AS signal, coalesce((SELECT sum(v) FROM fo, ah WHERE fo.t >= dy.t + ahead AND fo.t < dy.t + ahead + 2), 0) AS held,
  (SELECT sum(v) FROM rets r WHERE r.series = 0 AND r.t >= dy.t AND r.t < dy.t + 2) AS m, (SELECT v FROM le WHERE le.t = dy.t) AS l FROM dy)"""


@query("plain_strategy", f"{PLAIN} SELECT t, signal, round(signal * held, 6) + 0.0 AS no, round(signal * held - signal * m, 6) + 0.0 AS mkt, round(signal * held - signal * l, 6) + 0.0 AS lead FROM st")
def _(spark, d):
    from lagloom.operators.align import mirrored

    out = T.plain_strategy(nation_returns(spark, d), mirrored(stored_table(nation_pairs(spark, d), "pairs")), watch=2, hold=2, benchmark=0)
    return rounded(out, "no", "mkt", "lead")


@query("asset_strategy", f"""{L}, sc AS (SELECT i AS series, avg(sign(lag)) AS s FROM mirror GROUP BY 1), pl AS (SELECT series, percent_rank() OVER (ORDER BY s DESC, series) AS r FROM sc),
raw AS (SELECT b.i AS series, p.t + b.lag AS t, sum(p.v) AS raw FROM mirror b JOIN pl ON pl.series = b.i AND pl.r < 0.2 JOIN rets p ON p.series = b.j WHERE b.lag > 0 GROUP BY 1, 2),
q AS (SELECT t, quantile_cont(raw, 0.05) AS lo, quantile_cont(raw, 0.95) AS hi FROM raw GROUP BY 1), c AS (SELECT series, t, least(greatest(raw, lo), hi) AS w FROM raw JOIN q USING (t)),
w AS (SELECT series, t, coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY t), 0), 0) AS w FROM c) SELECT t::INT AS t, round(sum(w * v), 6) + 0.0 AS pnl FROM w JOIN rets USING (series, t) GROUP BY 1""")
def _(spark, d):
    from lagloom.operators.align import mirrored

    return rounded(T.asset_strategy(nation_returns(spark, d), mirrored(nation_pairs(spark, d))), "pnl")


GRID = "SELECT (l_linenumber % 3 + 1)::INT AS k, round(l_discount, 2) AS sigma, l_returnflag AS model, round(sum(l_quantity * (0.05 - l_discount)), 4) AS score FROM lineitem GROUP BY ALL"


def grid(spark, d):
    return rounded(src.table(spark, d, "lineitem").groupBy(((F.col("l_linenumber") % 3) + 1).cast("int").alias("k"), F.round("l_discount", 2).alias("sigma"), F.col("l_returnflag").alias("model")).agg(
        F.sum(F.col("l_quantity") * (0.05 - F.col("l_discount"))).alias("score")), "score", digits=4)


@query("grid_search", f"WITH g AS ({GRID}) SELECT model, k, sigma, score FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, k, sigma) AS r FROM g) WHERE r = 1")
def _(spark, d):
    return T.best_parameters(grid(spark, d), "model")


@query("yearly_sharpe", "WITH p AS (SELECT l_returnflag AS model, l_shipdate::DATE AS date, sum(0.05 - l_discount) AS pnl FROM lineitem GROUP BY 1, 2) SELECT model, year(date)::INT AS year, round(avg(pnl) / nullif(stddev_pop(pnl), 0) * sqrt(252), 6) + 0.0 AS sr FROM p GROUP BY 1, 2")
def _(spark, d):
    p = src.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.to_date("l_shipdate").alias("date")).agg(F.sum(0.05 - F.col("l_discount")).alias("pnl"))
    return rounded(T.yearly_sharpe(p, "model"), "sr")


@query("pnl_rollup", "SELECT l_returnflag AS model, (l_linenumber % 3)::INT AS cls, round(sum(l_quantity * l_discount), 4) AS total FROM lineitem GROUP BY ROLLUP (model, cls)")
def _(spark, d):
    p = src.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_linenumber") % 3).cast("int").alias("cls"), (F.col("l_quantity") * F.col("l_discount")).alias("pnl"))
    return rounded(T.rolled_up(p), "total", digits=4)


WALK = f"{R}, w AS (SELECT i::INT AS start, (i + 30)::INT AS stop FROM (SELECT unnest(range(0, (SELECT greatest(0, max(t) + 1 - 30) + 1 FROM rets)::INT, 10)) AS i))"


@query("walk_forward_windows", f"{WALK} SELECT start, stop AS \"end\", series, count(*) AS n, round(avg(v), 6) + 0.0 AS mean FROM w JOIN rets ON t >= start AND t < stop GROUP BY 1, 2, 3")
def _(spark, d):
    from lagloom.plans.walk import in_windows, whole_schedule

    r = nation_returns(spark, d)
    r = in_windows(r, whole_schedule(r, 30, 10))
    return rounded(r.groupBy("start", "end", "series").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean")


@query("out_of_sample_pnl", f"""{WALK}, ins AS (SELECT start, stop, series, avg(v) AS m FROM w JOIN rets ON t >= start AND t < stop GROUP BY 1, 2, 3),
b AS (SELECT start, stop, arg_max(series, (round(m, 9), -series)) AS series FROM ins GROUP BY 1, 2) SELECT start, t, series, round(v, 6) + 0.0 AS pnl FROM b JOIN rets USING (series) WHERE t >= stop AND t < stop + 10""")
def _(spark, d):
    from lagloom.plans.walk import best_series_out_of_sample

    return rounded(best_series_out_of_sample(nation_returns(spark, d), 30, 10), "pnl")


WALK_LAGS = f"""{WALK}, wz AS (SELECT start, series, t - start AS t, (v - avg(v) OVER p) / nullif(stddev_pop(v) OVER p, 0) AS v FROM w JOIN rets ON t >= start AND t < stop WINDOW p AS (PARTITION BY start, series)),
wl AS (SELECT a.start, a.series AS i, b.series AS j, m, l AS lag, sum(a.v * b.v) AS score FROM wz b CROSS JOIN (SELECT unnest([1, 2, 3]) AS m) CROSS JOIN (SELECT unnest(range(-3, 3)) AS l)
  JOIN wz a ON a.start = b.start AND a.t = ((b.t + l) % 30 + 30) % 30 AND a.series < b.series WHERE l >= -m AND l < m AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL),
wb AS (SELECT start, m, i, j, lag, score FROM (SELECT *, row_number() OVER (PARTITION BY start, m, i, j ORDER BY round(score, 9) DESC, lag) AS r FROM wl) WHERE r = 1)"""


@query("walk_forward_lag_matrices", f"{WALK_LAGS} SELECT start, i::BIGINT AS i, j::BIGINT AS j, lag::INT AS lag, round(score, 6) + 0.0 AS score FROM wb WHERE m = 3")
def _(spark, d):
    from lagloom.plans.walk import walk_lag_pairs, whole_schedule

    r = nation_returns(spark, d)
    return rounded(walk_lag_pairs(r, whole_schedule(r, 30, 10), 3), "score")


BACKTEST = f"""{WALK_LAGS}, wm AS (SELECT start, m, i, j, lag FROM wb UNION ALL SELECT start, m, j, i, -lag FROM wb),
ws AS (SELECT start, m, i AS series, sum(lag) AS s FROM wm GROUP BY ALL),
wv AS (SELECT start, m, series, round_even((s - min(s) OVER p) / count(*) OVER p, 0) AS lag FROM ws WINDOW p AS (PARTITION BY start, m)),
halves AS (SELECT start, m, series, 2 * row_number() OVER (PARTITION BY start, m ORDER BY lag, series) <= count(*) OVER (PARTITION BY start, m) AS leads FROM wv),
means AS (SELECT start, stop, m, t, avg(v) FILTER (WHERE leads) AS lead, avg(v) FILTER (WHERE NOT leads) AS follow FROM w JOIN rets ON t >= start AND t < stop + 10 JOIN halves USING (start, series) GROUP BY ALL),
pnl AS (SELECT a.start, a.stop, a.m, a.t, sign(round(b.lead, 12)) * a.follow AS pnl FROM means a JOIN means b ON a.start = b.start AND a.m = b.m AND a.t = b.t + 1),
best AS (SELECT start, m FROM (SELECT start, m, row_number() OVER (PARTITION BY start ORDER BY round(avg(pnl), 9) DESC, m) AS r FROM pnl WHERE t < stop GROUP BY 1, 2) WHERE r = 1),
ahead AS (SELECT start, t, m, pnl FROM pnl JOIN best USING (start, m) WHERE t >= stop)"""


@query("walk_forward_backtest", f"{BACKTEST} SELECT start, t, m, round(pnl, 6) + 0.0 AS pnl FROM ahead")
def _(spark, d):
    from lagloom.plans.walk import walk_forward_backtest

    return rounded(walk_forward_backtest(nation_returns(spark, d), 30, 10, [1, 2, 3], 10), "pnl")


@query("walk_forward_pnl", f"{BACKTEST} SELECT t, round(arg_max(pnl, start), 6) + 0.0 AS pnl FROM ahead GROUP BY 1")
def _(spark, d):
    from lagloom.plans.walk import concatenated, walk_forward_backtest

    return rounded(concatenated(walk_forward_backtest(nation_returns(spark, d), 30, 10, [1, 2, 3], 10)), "pnl")


@query("sliding_window_moments", """WITH w AS (SELECT event_type AS series, value AS v, unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day', time_bucket(INTERVAL '1 day', ts) - INTERVAL '2 days']) AS start FROM events)
SELECT start, start + INTERVAL '3 days' AS "end", series, count(v) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) AS sd FROM w GROUP BY ALL""")
def _(spark, d):
    from lagloom.streaming.windows import sliding_moments

    ticks = src.table(spark, d, "events").select(F.col("event_type").alias("series"), "ts", F.col("value").alias("v"))
    return rounded(sliding_moments(ticks, "3 days", "1 day"), "mean", "sd")
