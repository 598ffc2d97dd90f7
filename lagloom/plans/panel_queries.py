"""Queries of cleaning, resampling and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions import panel as P
from lagloom.functions import spectral as S
from lagloom.plans.registry import query
from lagloom.sources import panels as src
from lagloom.sources.panels import EMBED_SQL, NATION_SQL, QUOTES_SQL, USER_SQL
from lagloom.functions.panel import RETURNS_SQL, ZSCORE_SQL


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Floats summed in another order differ in their last bits; 0.0 is added to have no negative zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in cols})


def nation_returns(spark, d):
    return P.returns(src.nation_months(spark, d))


N = f"WITH {NATION_SQL}"
R = f"WITH {NATION_SQL}, {RETURNS_SQL}"
Z = f"{R}, {ZSCORE_SQL}"
U = f"WITH {USER_SQL}"
E = f"WITH {EMBED_SQL}"
Q = f"WITH {QUOTES_SQL}"
UF = f"{U}, filled AS (SELECT series, t, coalesce(v, 0.0) AS v FROM days)"


@query("panel_nation_months", f"{N} SELECT series, t, round(v, 4) AS v FROM months")
def _(spark, d):
    return rounded(src.nation_months(spark, d), "v", digits=4)


@query("null_share", f"{U} SELECT count(*) FILTER (WHERE v IS NULL) AS n_null, count(*) FILTER (WHERE v IS NULL) / count(*) AS share FROM days")
def _(spark, d):
    return P.null_share(src.user_days(spark, d))


@query("fill_nulls", f"{U} SELECT series, t, round(coalesce(v, 0.0), 6) AS v FROM days")
def _(spark, d):
    return rounded(P.filled(src.user_days(spark, d)), "v")


@query("drop_sparse_series", f"{UF} SELECT series, t, round(v, 6) AS v FROM filled WHERE series IN (SELECT series FROM filled GROUP BY series HAVING avg((v = 0)::INT) <= 0.05)")
def _(spark, d):
    return rounded(P.without_sparse_series(P.filled(src.user_days(spark, d)), 0.05), "v")


@query("drop_sparse_times", f"""{UF}, kept AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS dense FROM filled GROUP BY t HAVING avg((v = 0)::INT) <= 0.1)
SELECT series, dense::INT AS t, round(v, 6) AS v FROM filled JOIN kept USING (t)""")
def _(spark, d):
    return rounded(P.without_sparse_times(P.filled(src.user_days(spark, d))), "v")


@query("drop_extreme_series", f"{R} SELECT series, t, round(v, 6) AS v FROM rets WHERE series IN (SELECT series FROM rets GROUP BY series HAVING avg((v >= 1)::INT) <= 0.1)")
def _(spark, d):
    return rounded(P.without_extreme_series(nation_returns(spark, d)), "v")


@query("clip_returns", f"{R} SELECT series, t, round(least(greatest(v, -0.15), 0.15), 6) AS v FROM rets")
def _(spark, d):
    return rounded(P.clipped(nation_returns(spark, d)), "v")


@query("winsorize", f"""{R}, q AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM rets)
SELECT series, t, round(least(greatest(v, lo), hi), 6) + 0.0 AS v FROM rets, q""")
def _(spark, d):
    return rounded(P.winsorized(nation_returns(spark, d)), "v")


@query("benchmark_excess", f"{R} SELECT a.series, a.t, round(a.v - b.v, 6) + 0.0 AS v FROM rets a JOIN rets b ON a.t = b.t AND b.series = 0 WHERE a.series <> 0")
def _(spark, d):
    return rounded(P.excess(nation_returns(spark, d), 0), "v")


@query("zscore", f"{Z} SELECT series, t, round(v, 6) + 0.0 AS v FROM z")
def _(spark, d):
    return rounded(P.zscored(nation_returns(spark, d)), "v")


@query("zscore_sample", f"{R} SELECT series, t, round((v - avg(v) OVER (PARTITION BY series)) / stddev_samp(v) OVER (PARTITION BY series), 6) + 0.0 AS v FROM rets")
def _(spark, d):
    return rounded(P.zscored(nation_returns(spark, d), sample=True), "v")


@query("scale_only", f"{R} SELECT series, t, round(v / stddev_pop(v) OVER (PARTITION BY series), 6) + 0.0 AS v FROM rets")
def _(spark, d):
    return rounded(P.scaled(nation_returns(spark, d)), "v")


@query("mid_price", "SELECT s_nationkey AS series, round((max(s_acctbal) + min(s_acctbal)) / 2, 6) AS v FROM supplier GROUP BY 1")
def _(spark, d):
    book = src.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("series")).agg(F.max("s_acctbal").alias("ask_price1"), F.min("s_acctbal").alias("bid_price1"))
    return rounded(P.mid_price(book).select("series", "v"), "v")


DOWN = "SELECT series, strftime(day, '%Y-%m-%d') AS day, 34200 + ceil((time - 34200) / 3600) * 3600 AS time, round({v}, 6) AS v FROM quotes WHERE time > 34200 AND time <= 57600 GROUP BY ALL"


@query("downsample_max", f"{Q} {DOWN.format(v='max(v)')}")
def _(spark, d):
    q = src.quotes(spark, d).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return rounded(P.downsampled(q, 3600.0, 34200.0, 57600.0, "max", "series", "day"), "v")


@query("downsample_last", f"{Q} {DOWN.format(v='arg_max(v, (time, row_id))')}")
def _(spark, d):
    q = src.quotes(spark, d).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return rounded(P.downsampled(q, 3600.0, 34200.0, 57600.0, "last", "series", "day"), "v")


@query("log_returns", f"{N} SELECT series, t, round((CASE WHEN v > 0 THEN ln(v) END) - lag(CASE WHEN v > 0 THEN ln(v) END) OVER (PARTITION BY series ORDER BY t), 6) + 0.0 AS v FROM months")
def _(spark, d):
    return rounded(P.log_returns(src.nation_months(spark, d)), "v")


@query("clock_time", f"{Q} SELECT row_id, epoch_us(day + to_microseconds((time * 1000000)::BIGINT)) AS micros FROM quotes")
def _(spark, d):
    q = src.quotes(spark, d)
    return q.select("row_id", F.unix_micros(P.clock(F.col("time"), F.col("day"))).alias("micros"))


@query("hourly_pieces", "SELECT event_type, hour(ts)::INT - 10 AS piece, count(*) AS n FROM events WHERE hour(ts) BETWEEN 10 AND 14 GROUP BY 1, 2")
def _(spark, d):
    e = src.table(spark, d, "events").withColumn("piece", P.hourly_piece(F.col("ts")))
    return e.where("piece IS NOT NULL").groupBy("event_type", "piece").agg(F.count("*").alias("n"))


@query("rolling_moments", f"""{R} SELECT series, t, round(CASE WHEN count(v) OVER w = 12 THEN avg(v) OVER w END, 6) + 0.0 AS mean, round(CASE WHEN count(v) OVER w = 12 THEN stddev_samp(v) OVER w END, 6) AS sd
FROM rets WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return rounded(P.rolling(nation_returns(spark, d), 12), "mean", "sd")


@query("first_of_year", "WITH days AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM days) SELECT year(date)::INT AS year, min(t)::INT AS first_t FROM n GROUP BY 1")
def _(spark, d):
    days = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return P.first_of_year(days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("t")))


@query("interpolate", f"""{N}, spots AS (SELECT unnest([-1.0, 0.25, 3.5, 10.0, 1000.0]) AS x), span AS (SELECT series, min(t) AS lo, max(t) AS hi FROM months GROUP BY 1),
spot AS (SELECT series, x, least(greatest(x, lo), hi) AS y FROM span, spots)
SELECT a.series, a.x::DOUBLE AS x, round(m.v + CASE WHEN y > floor(y) THEN (y - floor(y)) * (n.v - m.v) ELSE 0 END, 4) AS v
FROM spot a JOIN months m ON m.series = a.series AND m.t = floor(y) LEFT JOIN months n ON n.series = a.series AND n.t = floor(y) + 1""")
def _(spark, d):
    spots = spark.createDataFrame([(x,) for x in (-1.0, 0.25, 3.5, 10.0, 1000.0)], "x double")
    return rounded(P.interpolated(src.nation_months(spark, d), spots), "v", digits=4)


@query("longest_zero_run", f"""{UF}, g AS (SELECT series, t - row_number() OVER (PARTITION BY series ORDER BY t) AS g FROM filled WHERE v = 0), r AS (SELECT series, count(*) AS n FROM g GROUP BY series, g)
SELECT s.series, coalesce(max(n), 0) AS run FROM (SELECT DISTINCT series FROM filled) s LEFT JOIN r USING (series) GROUP BY 1""")
def _(spark, d):
    return P.longest_zero_run(P.filled(src.user_days(spark, d)))


@query("stack_stats", f"""{R}, a AS (SELECT series, t, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s, count(*) OVER w AS n FROM rets WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT series, t, round(m, 6) + 0.0 AS rolling_mean, round(s, 6) AS rolling_sd FROM a WHERE n = 12""")
def _(spark, d):
    r = P.rolling(nation_returns(spark, d), 12).where("mean IS NOT NULL")
    both = P.stacked(r.select("series", "t", F.col("mean").alias("v")), r.select("series", "t", F.col("sd").alias("v")), ("rolling_mean", "rolling_sd"))
    return rounded(both, "rolling_mean", "rolling_sd")


@query("melt_wide", "SELECT l_returnflag AS series, k AS t, make_date(2000, 1, k + 1)::VARCHAR AS date, round(v, 4) AS v FROM (SELECT l_returnflag, unnest([0, 1, 2]) AS k, unnest([sum(l_quantity), sum(l_discount), sum(l_tax)]) AS v FROM lineitem GROUP BY 1)")
def _(spark, d):
    wide = src.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("ticker")).agg(
        F.sum("l_quantity").alias("X20000101"), F.sum("l_discount").alias("X20000102"), F.sum("l_tax").alias("X20000103")
    )
    return rounded(src.melted(wide, "ticker").withColumn("date", F.col("date").cast("string")), "v", digits=4)


# spectra: on the returns of nations (79 months)
DFT_SQL = """
len AS (SELECT count(DISTINCT t)::INT AS n FROM rets),
spec AS (
  SELECT series, f, sum(v * cos(2 * pi() * ((f * t) % n) / n)) AS re, sum(-v * sin(2 * pi() * ((f * t) % n) / n)) AS im
  FROM rets, len, (SELECT unnest(range(0, (SELECT n FROM len)))::INT AS f) GROUP BY 1, 2)
"""
D = f"{R}, {DFT_SQL}"


@query("dft", f"{D} SELECT series, f, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM spec")
def _(spark, d):
    return rounded(S.dft(nation_returns(spark, d)), "re", "im")


@query("power_spectrum", f"{D} SELECT series, f, round(re * re + im * im, 6) AS p FROM spec")
def _(spark, d):
    return rounded(S.power(S.dft(nation_returns(spark, d))), "p")


@query("inverse_dft", f"{R} SELECT series, t, round(v, 6) + 0.0 AS v FROM rets")
def _(spark, d):
    return rounded(S.inverse_dft(S.dft(nation_returns(spark, d))), "v")


@query("circulant", f"{R}, len AS (SELECT max(t) + 1 AS n FROM rets) SELECT series, a, ((a + t) % n)::INT AS b, round(v, 6) AS v FROM rets, len, (SELECT unnest(range(0, (SELECT n FROM len)))::INT AS a)")
def _(spark, d):
    return rounded(S.circulant(nation_returns(spark, d)), "v")


@query("circulant_adjoint", f"{R} SELECT series, t, round((SELECT max(t) + 1 FROM rets) * v, 6) AS v FROM rets")
def _(spark, d):
    r = nation_returns(spark, d)
    return rounded(S.circulant_adjoint(S.circulant(r), r.agg(F.max("t")).first()[0] + 1), "v")


BISPECTRUM = f"""{D}, bis AS (SELECT a.series, a.f AS f1, b.f AS f2,
  (a.re * b.re + a.im * b.im) * c.re - (a.im * b.re - a.re * b.im) * c.im AS re, (a.re * b.re + a.im * b.im) * c.im + (a.im * b.re - a.re * b.im) * c.re AS im
  FROM spec a CROSS JOIN len JOIN spec b ON a.series = b.series JOIN spec c ON c.series = a.series AND c.f = ((b.f - a.f) % n + n) % n)"""


@query("bispectrum", f"{BISPECTRUM} SELECT series, f1, f2, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM bis")
def _(spark, d):
    return rounded(S.bispectrum(S.dft(nation_returns(spark, d))), "re", "im")


@query("invariant_mean", f"{R} SELECT round(avg(v), 9) + 0.0 AS mean FROM rets")
def _(spark, d):
    obs = S.arrays(nation_returns(spark, d))
    n = obs.select(F.size("x")).first()[0]
    return rounded(S.invariants(obs, n)[0], "mean", digits=9)


@query("invariant_power", f"{D} SELECT f, round(avg(re * re + im * im), 6) AS p FROM spec GROUP BY 1")
def _(spark, d):
    obs = S.arrays(nation_returns(spark, d))
    n = obs.select(F.size("x")).first()[0]
    return rounded(S.invariants(obs, n)[1], "p")


@query("invariant_bispectrum", f"{BISPECTRUM} SELECT f1, f2, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM bis GROUP BY 1, 2")
def _(spark, d):
    obs = S.arrays(nation_returns(spark, d))
    n = obs.select(F.size("x")).first()[0]
    return rounded(S.invariants(obs, n)[2], "re", "im")


@query("class_invariant_power", f"{D} SELECT (series % 3)::INT AS cls, f, round(avg(re * re + im * im), 6) AS p FROM spec GROUP BY 1, 2")
def _(spark, d):
    """The power spectra of three classes, from the moments of all of them in one pass."""
    obs = S.arrays(nation_returns(spark, d)).withColumn("cls", (F.col("series") % 3).cast("int"))
    n = obs.select(F.size("x")).first()[0]
    return rounded(S.invariants_by_class(obs, n).where("kind = 'power'").select("cls", F.col("f1").alias("f"), F.col("re").alias("p")), "p")


@query("class_invariant_bispectrum", f"{BISPECTRUM} SELECT (series % 3)::INT AS cls, f1, f2, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM bis GROUP BY 1, 2, 3")
def _(spark, d):
    obs = S.arrays(nation_returns(spark, d)).withColumn("cls", (F.col("series") % 3).cast("int"))
    n = obs.select(F.size("x")).first()[0]
    return rounded(S.invariants_by_class(obs, n).where("kind = 'bispectrum'").select("cls", "f1", "f2", "re", "im"), "re", "im")


@query("invariant_power_weighted", f"{D} SELECT f, round(sum((series + 1) * (re * re + im * im)) / sum(series + 1), 6) AS p FROM spec GROUP BY 1")
def _(spark, d):
    obs = S.arrays(nation_returns(spark, d)).withColumn("weight", F.col("series") + 1)
    n = obs.select(F.size("x")).first()[0]
    return rounded(S.invariants(obs, n, "weight")[1], "p")


@query("invariant_power_debiased", f"{D}, m AS (SELECT avg(v) AS m FROM rets) SELECT f, round(greatest(0, avg(re * re + im * im) - CASE WHEN f = 0 THEN (n * m) ** 2 ELSE 0 END - n * 0.01), 6) AS p FROM spec, len, m GROUP BY f, n, m")
def _(spark, d):
    obs = S.arrays(nation_returns(spark, d))
    n = obs.select(F.size("x")).first()[0]
    mean, p, _ = S.invariants(obs, n)
    return rounded(S.debiased(mean, p, n, 0.01), "p")


@query("noise_level", f"{R}, s AS (SELECT series, sum(v) AS s, count(*) AS n FROM rets GROUP BY 1) SELECT round(stddev_samp(s) / sqrt(max(n)), 9) AS sigma FROM s")
def _(spark, d):
    return rounded(S.noise_level(nation_returns(spark, d)), "sigma", digits=9)


@query("bias_pattern", "SELECT a.i::INT AS f1, b.i::INT AS f2, ((a.i = b.i)::INT + (a.i = 0)::INT + (b.i = 0)::INT)::INT AS bias FROM (SELECT unnest(range(0, 9)) AS i) a, (SELECT unnest(range(0, 9)) AS i) b")
def _(spark, d):
    return S.bias_pattern(spark, 9)


@query("invariant_convergence", f"""{D}, r AS (SELECT series, f, avg(re * re + im * im) OVER (PARTITION BY f ORDER BY series) AS m, avg(re * re + im * im) OVER (PARTITION BY f) AS a FROM spec)
SELECT (series + 1)::INT AS n, round(sqrt(sum((m - a) ** 2)), 6) AS error FROM r GROUP BY 1""")
def _(spark, d):
    p = S.power(S.dft(nation_returns(spark, d)))
    return rounded(S.convergence(p.select(F.col("series").alias("copy"), "f", "p")).withColumn("n", F.col("n").cast("int")), "error")
