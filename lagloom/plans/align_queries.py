"""Queries of alignment, clustering and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.functions import panel as P
from lagloom.operators import align as A
from lagloom.operators import cluster as C
from lagloom.operators import evaluate as V
from lagloom.plans.panel_queries import E, Z, nation_returns, rounded
from lagloom.plans.registry import query
from lagloom.sources import panels as src
from lagloom.sources.storage import stored_table

M = 3  # lags looked at on monthly series

LAGS_SQL = """
len AS (SELECT count(DISTINCT t)::INT AS n FROM z),
scores AS (
  SELECT a.series AS i, b.series AS j, l AS lag, sum(a.v * b.v) AS score
  FROM z b CROSS JOIN (SELECT unnest(range(-3, 3)) AS l) CROSS JOIN len JOIN z a ON a.t = ((b.t + l) % n + n) % n AND a.series < b.series GROUP BY 1, 2, 3),
best AS (SELECT i, j, lag, score FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY round(score, 9) DESC, lag) AS r FROM scores) WHERE r = 1),
mirror AS (SELECT i, j, lag, score FROM best UNION ALL SELECT j, i, -lag, score FROM best)
"""
L = f"{Z}, {LAGS_SQL}"
VECTOR_SQL = """
sums AS (SELECT i AS series, sum(lag)::DOUBLE AS s, (SELECT count(DISTINCT series) FROM z) AS n FROM mirror GROUP BY 1),
vector AS (SELECT series, round_even((s - min(s) OVER ()) / n, 0)::INT AS lag FROM sums)
"""
W = f"{L}, {VECTOR_SQL}"


def nation_z(spark, d):
    return P.zscored(nation_returns(spark, d))


def nation_pairs(spark, d):
    return A.lag_pairs(nation_z(spark, d), M)


def length(panel):
    return panel.agg(F.max("t")).first()[0] + 1


@query("lag_matrix_circular", f"{L} SELECT i::BIGINT AS i, j::BIGINT AS j, lag::INT AS lag, round(score, 6) + 0.0 AS score FROM best")
def _(spark, d):
    return rounded(nation_pairs(spark, d), "score")


@query("lag_matrix_linear", f"""{Z}, scores AS (
  SELECT a.series AS i, b.series AS j, l AS lag, sum(a.v * b.v) AS score FROM z a CROSS JOIN (SELECT unnest(range(-3, 4)) AS l) JOIN z b ON b.t = a.t + l AND a.series < b.series GROUP BY 1, 2, 3)
SELECT i::BIGINT AS i, j::BIGINT AS j, lag::INT AS lag, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY round(score, 9) DESC, lag) AS r FROM scores) WHERE r = 1""")
def _(spark, d):
    return rounded(A.lag_pairs(nation_z(spark, d), M, circular=False), "score")


def vector_lags_sql(m: int) -> str:
    """The lags of all pairs of vectors, scores by products of turned lists."""
    return f"""{E}, z AS (SELECT series, t, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM vecs WINDOW w AS (PARTITION BY series)),
x AS (SELECT series, list(v ORDER BY t) AS x FROM z GROUP BY 1),
turned AS (SELECT series, l AS lag, x[((l % len(x) + len(x)) % len(x)) + 1:] || x[:(l % len(x) + len(x)) % len(x)] AS x FROM x, (SELECT unnest(range(-{m}, {m})) AS l)),
scores AS (SELECT a.series AS i, b.series AS j, a.lag, list_dot_product(a.x, b.x) AS score FROM turned a JOIN x b ON a.series < b.series)
SELECT i, j, lag::INT AS lag, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY round(score, 9) DESC, lag) AS r FROM scores) WHERE r = 1"""


@query("lag_matrix_embeddings", vector_lags_sql(M))
def _(spark, d):
    return rounded(A.array_lag_pairs(src.embedding_arrays(spark, d), M, raw=True), "score")


@query("lag_matrix_all_embeddings", vector_lags_sql(5))
def _(spark, d):
    """Every pair of all vectors over ten lags: the heavy one."""
    return rounded(A.array_lag_pairs(src.embedding_arrays(spark, d), 5, raw=True), "score")


@query("circular_alignment", f"""{Z}, len AS (SELECT count(DISTINCT t)::INT AS n FROM z), ref AS (SELECT t, v FROM z WHERE series = 0),
s AS (SELECT a.series, l AS lag, sum(a.v * r.v) AS score, sum(a.v * r.v) / any_value(n) AS corr FROM ref r CROSS JOIN (SELECT unnest(range(-3, 3)) AS l) CROSS JOIN len JOIN z a ON a.t = ((r.t + l) % n + n) % n GROUP BY 1, 2)
SELECT series, lag::INT AS lag, round(score, 6) + 0.0 AS score, round(corr, 6) + 0.0 AS corr FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(score, 9) DESC, lag) AS r FROM s) WHERE r = 1""")
def _(spark, d):
    z = nation_z(spark, d)
    n = length(z)
    ref = z.where("series = 0").select(F.lit(0).alias("cls"), "t", "v")
    lags = A.lags_to_reference(z, ref, list(range(-M, M)), n)
    return rounded(lags.select("series", "lag", "score", (F.col("score") / n).alias("corr")), "score", "corr")


@query("alignment_residual", f"""{L}, x AS (SELECT i, j, lag FROM best)
SELECT x.i::BIGINT AS i, x.j::BIGINT AS j, round(sqrt(sum((a.v - b.v) ** 2)) / sqrt(sum(a.v ** 2)) / sqrt(sum(b.v ** 2)), 9) AS residual
FROM x JOIN z b ON b.series = x.j CROSS JOIN len JOIN z a ON a.series = x.i AND a.t = ((b.t + x.lag) % n + n) % n GROUP BY 1, 2""")
def _(spark, d):
    z = nation_z(spark, d)
    return rounded(A.residual(z, A.lag_pairs(z, M), length(z)), "residual", digits=9)


@query("circular_rolling_sum", f"""{W}, h AS (SELECT ((lag % 12) + 12) % 12 AS t, count(*) AS v FROM vector GROUP BY 1), g AS (SELECT i::INT AS t, coalesce(v, 0) AS v FROM (SELECT unnest(range(0, 12)) AS i) LEFT JOIN h ON h.t = i)
SELECT a.t, sum(b.v)::BIGINT AS total FROM g a JOIN g b ON (b.t - a.t + 12) % 12 < 4 GROUP BY 1""")
def _(spark, d):
    lags = A.row_mean_lags(nation_pairs(spark, d))
    hist = spark.range(12).select(F.col("id").cast("int").alias("t")).join(lags.groupBy(F.pmod("lag", F.lit(12)).alias("t")).agg(F.count("*").alias("v")), "t", "left").fillna(0)
    return A.circular_sums(hist, 4, 12)


@query("last_argmax", f"{Z} SELECT series, arg_max(t, (round(v, 6), t))::INT AS t FROM z GROUP BY 1")
def _(spark, d):
    return A.last_argmax(rounded(nation_z(spark, d), "v"), "series")


@query("smallest_lag_cover", f"""{W}, u AS (SELECT DISTINCT ((lag % 24) + 24) % 24 AS l FROM vector), g AS (SELECT l, coalesce(lead(l) OVER (ORDER BY l), min(l) OVER () + 24) - l - 1 AS gap FROM u)
SELECT (24 - max(gap))::BIGINT AS cover FROM g""")
def _(spark, d):
    return A.smallest_cover(A.row_mean_lags(nation_pairs(spark, d)), 24)


@query("lag_vector_row_mean", f"{W} SELECT series::BIGINT AS series, lag FROM vector")
def _(spark, d):
    return A.row_mean_lags(nation_pairs(spark, d))


@query("lag_matrix_from_vector", f"{W} SELECT a.series::BIGINT AS i, b.series::BIGINT AS j, (a.lag - b.lag)::INT AS lag FROM vector a JOIN vector b ON a.series < b.series")
def _(spark, d):
    return A.matrix_from_vector(A.row_mean_lags(nation_pairs(spark, d)))


@query("lag_matrix_within_class", f"{L} SELECT i::BIGINT AS i, j::BIGINT AS j, lag::INT AS lag, (i % 3)::INT AS cls FROM best WHERE i % 3 = j % 3")
def _(spark, d):
    z = nation_z(spark, d)
    labels = z.select("series").distinct().withColumn("cls", (F.col("series") % 3).cast("int"))
    return A.within_class(A.lag_pairs(z, M), labels).select("i", "j", "lag", "cls")


@query("lags_within_class_from_vector", f"{W} SELECT (a.series % 3)::INT AS cls, a.series::BIGINT AS i, b.series::BIGINT AS j, (a.lag - b.lag)::INT AS lag FROM vector a JOIN vector b ON a.series < b.series AND a.series % 3 = b.series % 3")
def _(spark, d):
    return A.matrix_from_vector(A.row_mean_lags(nation_pairs(spark, d)).withColumn("cls", (F.col("series") % 3).cast("int")))


@query("lag_ranking_svd")
def _(spark, d):
    return A.svd_lags(nation_pairs(spark, d).withColumn("cls", F.lit(0)), "cls")


@query("shift_by_lag", f"""{W}, len AS (SELECT count(DISTINCT t)::INT AS n FROM z) SELECT g.series, g.t, round(coalesce(m.v, 0.0), 6) + 0.0 AS v
FROM z g JOIN vector USING (series) LEFT JOIN z m ON m.series = g.series AND m.t + vector.lag = g.t""".replace(", len AS (SELECT count(DISTINCT t)::INT AS n FROM z) SELECT g", " SELECT g"))
def _(spark, d):
    z = nation_z(spark, d)
    return rounded(A.shifted(z, A.row_mean_lags(A.lag_pairs(z, M)), length(z), False), "v")


@query("synchronised_mean", f"{W} SELECT g.t, round(sum(coalesce(m.v, 0.0)) / count(*), 6) + 0.0 AS v FROM z g JOIN vector USING (series) LEFT JOIN z m ON m.series = g.series AND m.t - vector.lag = g.t GROUP BY 1")
def _(spark, d):
    z = nation_z(spark, d)
    return rounded(A.synchronised(z, A.row_mean_lags(A.lag_pairs(z, M)), length(z)), "v")


ALIGNED_SQL = """len AS (SELECT count(DISTINCT t)::INT AS n FROM z), ref AS (SELECT t, v FROM z WHERE series = 0),
s AS (SELECT a.series, l AS lag, sum(a.v * r.v) AS score FROM ref r CROSS JOIN (SELECT unnest(range(-3, 3)) AS l) CROSS JOIN len JOIN z a ON a.t = ((r.t + l) % n + n) % n GROUP BY 1, 2),
b AS (SELECT series, lag FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(score, 9) DESC, lag) AS r FROM s) WHERE r = 1),
al AS (SELECT ((z.t - lag) % n + n) % n AS t, avg(v) AS v FROM z JOIN b USING (series) CROSS JOIN len GROUP BY 1)"""


def _aligned_mean(spark, d):
    z = nation_z(spark, d)
    n = length(z)
    lags = A.lags_to_reference(z, z.where("series = 0").select(F.lit(0).alias("cls"), "t", "v"), list(range(-M, M)), n)
    return z, A.aligned(z, lags, n).groupBy("t").agg(F.avg("v").alias("v"))


@query("aligned_average", f"{Z}, {ALIGNED_SQL} SELECT t::INT AS t, round(v, 6) + 0.0 AS v FROM al")
def _(spark, d):
    return rounded(_aligned_mean(spark, d)[1], "v")


@query("relative_error", f"{Z}, {ALIGNED_SQL} SELECT round(sqrt(sum((ref.v - al.v) ** 2)) / sqrt(sum(ref.v ** 2)), 9) AS error FROM ref JOIN al USING (t)")
def _(spark, d):
    z, mean = _aligned_mean(spark, d)
    return rounded(A.relative_error(z.where("series = 0").select("t", "v"), mean), "error", digits=9)


@query("constrained_lags", f"""{Z}, len AS (SELECT count(DISTINCT t)::INT AS n FROM z), ref AS (SELECT t, v FROM z WHERE series = 0),
s AS (SELECT a.series, l AS lag, sum(a.v * r.v) AS score FROM ref r CROSS JOIN len CROSS JOIN (SELECT unnest(range(0, (SELECT n FROM len))) AS l) JOIN z a ON a.t = (r.t + l) % n GROUP BY 1, 2),
first AS (SELECT series, lag FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(score, 9) DESC, lag) AS r FROM s) WHERE r = 1),
g AS (SELECT DISTINCT lag AS l FROM first), cover AS (SELECT n - max(gap) AS cover FROM (SELECT coalesce(lead(l) OVER (ORDER BY l), min(l) OVER () + n) - l - 1 AS gap, n FROM g, len) GROUP BY n),
dense AS (SELECT l AS start, count(*) FILTER (WHERE (lag - l + n) % n <= 5) AS total FROM first, len, (SELECT unnest(range(0, (SELECT n FROM len))) AS l) GROUP BY 1),
best AS (SELECT start FROM dense ORDER BY total DESC, start LIMIT 1),
off AS (SELECT series, lag, (lag - start + n) % n AS o FROM first, best, len),
again AS (SELECT series, o FROM (SELECT s.series, (s.lag - start + n) % n AS o, row_number() OVER (PARTITION BY s.series ORDER BY round(score, 9) DESC, s.lag) AS r FROM s, best, len WHERE (s.lag - start + n) % n < 5) WHERE r = 1)
SELECT off.series, (CASE WHEN cover <= 6 THEN off.lag WHEN off.o <= 5 THEN off.o ELSE again.o END)::INT AS lag FROM off JOIN again USING (series) CROSS JOIN cover""")
def _(spark, d):
    z = nation_z(spark, d)
    return A.constrained_lags(z, z.where("series = 0").select(F.lit(0).alias("cls"), "t", "v"), 5, length(z))


@query("class_constrained_lags", f"""{Z}, len AS (SELECT count(DISTINCT t)::INT AS n FROM z), lb AS (SELECT DISTINCT series, (series % 3)::INT AS cls FROM z), ref AS (SELECT series::INT AS cls, t, v FROM z WHERE series < 3),
s AS (SELECT a.series, r.cls, l AS lag, sum(a.v * r.v) AS score FROM ref r CROSS JOIN len CROSS JOIN (SELECT unnest(range(0, (SELECT n FROM len))) AS l) JOIN lb ON lb.cls = r.cls JOIN z a ON a.series = lb.series AND a.t = (r.t + l) % n GROUP BY 1, 2, 3),
first AS (SELECT cls, series, lag FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(score, 9) DESC, lag) AS r FROM s) WHERE r = 1),
g AS (SELECT DISTINCT cls, lag AS l FROM first), cover AS (SELECT cls, n - max(gap) AS cover FROM (SELECT cls, coalesce(lead(l) OVER (PARTITION BY cls ORDER BY l), min(l) OVER (PARTITION BY cls) + n) - l - 1 AS gap, n FROM g, len) GROUP BY cls, n),
dense AS (SELECT cls, l AS start, count(*) FILTER (WHERE (lag - l + n) % n <= 5) AS total FROM first, len, (SELECT unnest(range(0, (SELECT n FROM len))) AS l) GROUP BY 1, 2),
best AS (SELECT cls, start FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY total DESC, start) AS r FROM dense) WHERE r = 1),
off AS (SELECT cls, series, lag, (lag - start + n) % n AS o FROM first JOIN best USING (cls) CROSS JOIN len),
again AS (SELECT series, o FROM (SELECT s.series, (s.lag - start + n) % n AS o, row_number() OVER (PARTITION BY s.series ORDER BY round(score, 9) DESC, s.lag) AS r FROM s JOIN best USING (cls) CROSS JOIN len WHERE (s.lag - start + n) % n < 5) WHERE r = 1)
SELECT cls, off.series, (CASE WHEN cover <= 6 THEN off.lag WHEN off.o <= 5 THEN off.o ELSE again.o END)::INT AS lag FROM off JOIN again USING (series) JOIN cover USING (cls)""")
def _(spark, d):
    z = nation_z(spark, d)
    labels = z.select("series").distinct().withColumn("cls", (F.col("series") % 3).cast("int"))
    return A.class_constrained_lags(z, labels, z.where("series < 3").select(F.col("series").cast("int").alias("cls"), "t", "v"), 5, length(z))


@query("class_synchronised_signals", f"""{L}, ow AS (SELECT (i % 3)::INT AS cls, i AS series, sum(lag) AS s FROM mirror WHERE i % 3 = j % 3 GROUP BY 1, 2),
vc AS (SELECT cls, series, round_even((s - min(s) OVER p) / count(*) OVER p, 0)::INT AS lag FROM ow WINDOW p AS (PARTITION BY cls))
SELECT vc.cls, g.t, round(sum(coalesce(m.v, 0.0)) / count(*), 6) + 0.0 AS v FROM z g JOIN vc USING (series) LEFT JOIN z m ON m.series = g.series AND m.t - vc.lag = g.t GROUP BY 1, 2""")
def _(spark, d):
    """The mean of every class's series, each moved back by its lag within the class."""
    z = nation_z(spark, d)
    labels = z.select("series").distinct().withColumn("cls", (F.col("series") % 3).cast("int"))
    lags = A.row_mean_lags(A.within_class(A.lag_pairs(z, M), labels), "cls")
    return rounded(A.synchronised(z, lags, length(z), "cls"), "v")


# clustering: classes of embeddings by the nearest of three reference vectors
NEAR_SQL = """
z AS (SELECT series, t, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v, cls AS label FROM vecs WINDOW w AS (PARTITION BY series)),
refs AS (SELECT series AS cls, t, v FROM z WHERE series < 3),
ns AS (SELECT a.series, r.cls, l AS lag, sum(a.v * r.v) AS score FROM refs r CROSS JOIN (SELECT unnest(range(-2, 2)) AS l) JOIN z a ON a.t = ((r.t + l) % 64 + 64) % 64 GROUP BY 1, 2, 3),
nb AS (SELECT series, cls, lag, score FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(score, 9) DESC, cls, lag) AS r FROM ns) WHERE r = 1),
truth AS (SELECT DISTINCT series, label % 3 AS cls FROM z)
"""
K = f"{E}, {NEAR_SQL}"


def nearest(spark, d):
    z = P.zscored(src.embedding_series(spark, d))
    return C.nearest_signal(z, z.where("series < 3").select(F.col("series").cast("int").alias("cls"), "t", "v"), 64, 2)


def truth(spark, d):
    return src.table(spark, d, "embeddings").select(F.col("vec_id").alias("series"), (F.col("label") % 3).cast("int").alias("cls"))


@query("nearest_signal", f"{K} SELECT series, cls::INT AS cls, lag::INT AS lag, round(score, 6) AS score FROM nb")
def _(spark, d):
    return rounded(nearest(spark, d), "score")


@query("negative_affinity_share", f"{L} SELECT count(*) FILTER (WHERE score < 0) / (SELECT count(DISTINCT series) ** 2 FROM z) AS share FROM mirror")
def _(spark, d):
    return C.negative_share(nation_pairs(spark, d))


@query("nonnegative_affinity", f"{L} SELECT i::BIGINT AS i, j::BIGINT AS j, round(greatest(score, 0), 6) AS score FROM best")
def _(spark, d):
    return rounded(C.nonnegative(nation_pairs(spark, d)).select("i", "j", "score"), "score")


@query("relabel_classes", f"{K} SELECT series, (dense_rank() OVER (ORDER BY cls) - 1)::INT AS cls FROM (SELECT series, cls * 10 + 5 AS cls FROM nb)")
def _(spark, d):
    return C.relabelled(nearest(spark, d).select("series", (F.col("cls") * 10 + 5).alias("cls")))


@query("contingency_jaccard", f"""{K}, c AS (SELECT a.cls AS a, b.cls AS b, count(*) AS n FROM nb a JOIN truth b USING (series) GROUP BY 1, 2)
SELECT a::INT AS a, b::INT AS b, n, round(n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n), 9) AS iou FROM c""")
def _(spark, d):
    return rounded(C.jaccard(C.contingency(nearest(spark, d), truth(spark, d))), "iou", digits=9)


@query("match_classes", f"""{K}, c AS (SELECT a.cls AS a, b.cls AS b, count(*) AS n FROM nb a JOIN truth b USING (series) GROUP BY 1, 2),
iou AS (SELECT a, b, n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n) AS u FROM c),
p AS (SELECT x.b AS b0, y.b AS b1, w.b AS b2, x.u + y.u + w.u AS total FROM iou x JOIN iou y ON x.a = 0 AND y.a = 1 AND x.b <> y.b JOIN iou w ON w.a = 2 AND w.b NOT IN (x.b, y.b)),
top AS (SELECT b0, b1, b2 FROM p ORDER BY total DESC LIMIT 1) SELECT unnest([0, 1, 2])::INT AS a, unnest([b0, b1, b2])::INT AS b FROM top""")
def _(spark, d):
    return C.matched_classes(nearest(spark, d), truth(spark, d))


@query("adjusted_rand_index", f"""{K}, c AS (SELECT a.cls AS a, b.cls AS b, count(*) AS n FROM nb a JOIN truth b USING (series) GROUP BY 1, 2),
x AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS n FROM c), ra AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((x - ra.r * rb.r / (n * (n - 1) / 2)) / ((ra.r + rb.r) / 2 - ra.r * rb.r / (n * (n - 1) / 2)), 9) + 0.0 AS ari FROM x, ra, rb""")
def _(spark, d):
    return rounded(C.adjusted_rand(nearest(spark, d), truth(spark, d)), "ari", digits=9)


@query("mixing_probabilities", f"{K} SELECT k::INT AS cls, coalesce(n, 0) / (SELECT count(*) FROM nb) AS p FROM (SELECT unnest(range(0, 4)) AS k) LEFT JOIN (SELECT cls, count(*) AS n FROM nb GROUP BY 1) ON cls = k")
def _(spark, d):
    return C.mixing(nearest(spark, d), 4)


@query("spectral_clustering")
def _(spark, d):
    return C.spectral_clusters(C.nonnegative(nation_pairs(spark, d)), [1, 2, 3])


@query("gaussian_process_smoothing")
def _(spark, d):
    return C.smooth(nation_z(spark, d), 0.5)


@query("residual_affinity", f"""{L}, x AS (SELECT i, j, lag FROM best),
r AS (SELECT x.i, x.j, sqrt(sum((a.v - b.v) ** 2)) / sqrt(sum(a.v ** 2)) / sqrt(sum(b.v ** 2)) AS e FROM x JOIN z b ON b.series = x.j CROSS JOIN len JOIN z a ON a.series = x.i AND a.t = ((b.t + x.lag) % n + n) % n GROUP BY 1, 2)
SELECT i::BIGINT AS i, j::BIGINT AS j, round(exp(-e * e / 2), 9) AS score FROM r""")
def _(spark, d):
    z = nation_z(spark, d)
    return rounded(C.residual_affinity(A.residual(z, A.lag_pairs(z, M), length(z))), "score", digits=9)


# evaluation: lags found against those of the lag vector; only pairs within a class are looked for, so the others count as not found
EV = f"""{W}, t AS (SELECT a.series AS i, b.series AS j, a.lag - b.lag AS true_lag FROM vector a JOIN vector b ON a.series < b.series),
er AS (SELECT t.i, t.j, (t.i % 3)::INT AS cls, true_lag, lag, abs(lag - true_lag) AS error FROM t LEFT JOIN (SELECT * FROM best WHERE i % 3 = j % 3) b USING (i, j))"""


def errors(spark, d):
    pairs = nation_pairs(spark, d)
    true = A.matrix_from_vector(A.row_mean_lags(pairs))
    labels = nation_z(spark, d).select("series").distinct().withColumn("cls", (F.col("series") % 3).cast("int"))
    return V.pair_errors(A.within_class(pairs, labels).drop("cls"), true).withColumn("cls", (F.col("i") % 3).cast("int"))


@query("lag_errors", f"{EV} SELECT i::BIGINT AS i, j::BIGINT AS j, error::INT AS error FROM er")
def _(spark, d):
    return errors(spark, d).select("i", "j", "error")


@query("lag_accuracy", f"{EV} SELECT 100.0::DOUBLE * count(*) FILTER (WHERE error < 1e-5) / count(*) AS accuracy FROM er")
def _(spark, d):
    return V.accuracy(errors(spark, d))


@query("lag_errors_by_class", f"{EV} SELECT cls, sum(error)::BIGINT AS sum_error, sum(abs(sign(lag) - sign(true_lag)))::BIGINT AS sign_error, 100.0::DOUBLE * count(*) FILTER (WHERE error < 1e-5) / count(*) AS accuracy, count(*) AS n FROM er GROUP BY 1")
def _(spark, d):
    return V.class_errors(errors(spark, d), "cls")


@query("lag_errors_overall", f"""{EV} SELECT sum(error)::DOUBLE / count(error) AS rel_error, sum(coalesce(abs(sign(lag) - sign(true_lag)), 2))::DOUBLE / count(*) AS sign_error,
100.0::DOUBLE * count(*) FILTER (WHERE error < 1e-5) / count(*) AS accuracy, array_to_string(list_transform(quantile_cont(error::DOUBLE, [{', '.join(str(k / 20) for k in range(21))}]), lambda x: printf('%.4f', x)), ',') AS quantiles FROM er""")
def _(spark, d):
    whole = V.whole_errors(errors(spark, d))
    return whole.withColumn("quantiles", F.array_join(F.transform("quantiles", lambda x: F.format_string("%.4f", x)), ","))


@query("class_weighted_errors", f"""{W}, tl AS (SELECT series, (series % 3)::INT AS cls, (CASE WHEN series % 5 = 0 THEN (series // 5) % 3 ELSE series % 3 END)::INT AS tc FROM vector),
tp AS (SELECT a.series AS i, b.series AS j, a.lag - b.lag AS true_lag, x.cls AS ci, y.cls AS cj, x.tc FROM vector a JOIN vector b ON a.series < b.series JOIN tl x ON x.series = a.series JOIN tl y ON y.series = b.series WHERE x.tc = y.tc),
mt AS (SELECT ci AS cls, abs(lag - true_lag)::DOUBLE AS error, abs(sign(lag) - sign(true_lag)) AS sg FROM tp JOIN best USING (i, j) WHERE ci = cj AND ci = tc),
ca AS (SELECT cls, 100.0::DOUBLE * count(*) FILTER (WHERE error < 1e-5) / count(*) AS acc FROM mt GROUP BY 1), nr AS (SELECT cls, count(*) AS right_ FROM tl WHERE cls = tc GROUP BY 1),
al AS (SELECT error FROM mt UNION ALL SELECT 3.0 FROM (SELECT unnest(range((SELECT count(*) FROM tp) - (SELECT count(*) FROM mt)))))
SELECT (SELECT avg(error) FROM al) AS rel_error, ((SELECT sum(sg) FROM mt) + 2 * ((SELECT count(*) FROM tp) - (SELECT count(*) FROM mt)))::DOUBLE / (SELECT count(*) FROM tp) AS sign_error,
(SELECT sum(acc * right_) FROM ca JOIN nr USING (cls)) / (SELECT count(*) FROM tl) AS accuracy,
(SELECT array_to_string(list_transform(quantile_cont(error, [{', '.join(str(k / 20) for k in range(21))}]), lambda x: printf('%.4f', x)), ',') FROM al) AS quantiles""")
def _(spark, d):
    """Errors of lags in classes that differ from the true ones for every fifth series, three for a pair that is missed."""
    pairs = stored_table(nation_pairs(spark, d), "pairs")
    lags = stored_table(A.row_mean_lags(pairs), "lags")
    cls = (F.col("series") % 3).cast("int")
    true = lags.select("series", F.when(F.col("series") % 5 == 0, F.floor(F.col("series") / 5) % 3).otherwise(cls).cast("int").alias("cls"))
    whole = V.class_weighted_errors(pairs, A.matrix_from_vector(lags), lags.select("series", cls.alias("cls")), true, 3.0)
    return whole.withColumn("quantiles", F.array_join(F.transform("quantiles", lambda x: F.format_string("%.4f", x)), ","))


@query("error_median", f"{EV} SELECT quantile_cont(error::DOUBLE, 0.5) AS error FROM er")
def _(spark, d):
    return V.quantile(V.whole_errors(errors(spark, d)), 0.5)


@query("mean_over_rounds", """SELECT (l_linenumber % 3)::INT AS k, round(l_discount, 2) AS sigma, l_returnflag AS model, l_linestatus AS metric, round(avg(nullif(l_quantity, 1)), 6) AS value FROM lineitem GROUP BY ALL""")
def _(spark, d):
    m = src.table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 3).cast("int").alias("k"), F.round("l_discount", 2).alias("sigma"), F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("metric"), F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("value"),
    )
    return rounded(V.mean_over_rounds(m), "value")


@query("total_variation", f"{K}, p AS (SELECT cls, count(*) / (SELECT count(*) FROM nb) AS p FROM nb GROUP BY 1), q AS (SELECT cls, count(*) / (SELECT count(*) FROM truth) AS q FROM truth GROUP BY 1) SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS tv FROM p FULL JOIN q USING (cls)")
def _(spark, d):
    return rounded(V.total_variation(C.mixing(nearest(spark, d), 3), C.mixing(truth(spark, d), 3)), "tv", digits=9)
