"""How good recovered lags, classes and signals are. Pairs without a lag are absent, not zero."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.select import exact_quantiles
from lagloom.sources.storage import stored_table

#: The percentiles 0, 5, ..., 100.
PERCENTILES = [k / 20 for k in range(21)]


def pair_errors(found: DataFrame, true: DataFrame) -> DataFrame:
    """(i, j, error, lag, true_lag) of the true pairs; error is null where nothing was found."""
    t = true.select("i", "j", F.col("lag").alias("true_lag"))
    return t.join(found.select("i", "j", "lag"), ["i", "j"], "left").withColumn("error", F.abs(F.col("lag") - F.col("true_lag")))


def accuracy(errors: DataFrame, *keys: str) -> DataFrame:
    """(keys..., accuracy): percent of pairs with the right lag; pairs without one are wrong."""
    return errors.groupBy(*keys).agg((100.0 * F.count_if(F.col("error") < 1e-5) / F.count("*")).alias("accuracy"))


def class_errors(errors: DataFrame, *keys: str) -> DataFrame:
    """(keys..., sum_error, sign_error, accuracy, n) over the pairs i < j of a class."""
    return errors.where("i < j").groupBy(*keys).agg(
        F.sum("error").cast("long").alias("sum_error"),
        F.sum(F.abs(F.signum("lag") - F.signum("true_lag"))).cast("long").alias("sign_error"),
        (100.0 * F.count_if(F.col("error") < 1e-5) / F.count("*")).alias("accuracy"),
        F.count("*").alias("n"),
    )


def whole_errors(errors: DataFrame) -> DataFrame:
    """(rel_error, sign_error, accuracy, quantiles): errors over pairs found, two sign errors for each pair missed over
    all pairs, right ones in percent, and the percentiles 0, 5, ..., 100 of the errors."""
    means = errors.agg(
        (F.sum("error") / F.count("error")).alias("rel_error"),
        (F.sum(F.coalesce(F.abs(F.signum("lag") - F.signum("true_lag")), F.lit(2.0))) / F.count("*")).alias("sign_error"),
        (100.0 * F.count_if(F.col("error") < 1e-5) / F.count("*")).alias("accuracy"),
    )
    return means.join(F.broadcast(exact_quantiles(errors, F.col("error"), PERCENTILES).withColumnRenamed("q", "quantiles")))


def class_weighted_errors(found: DataFrame, true: DataFrame, labels: DataFrame, true_labels: DataFrame, penalty: float = 0.0) -> DataFrame:
    """(rel_error, sign_error, accuracy, quantiles) of lags (i, j, lag), i < j, against true ones. Pairs count that share a
    class (series, cls) and a true class of the same name. accuracy is the percentage of right lags in each class, weighed
    by the class's share of series that are in it rightly; pairs of one true class that were not found count two sign errors
    each, and, if there is a penalty, that error each."""
    own = labels.join(true_labels.withColumnRenamed("cls", "true_cls"), "series").select("series", "cls", "true_cls")
    side = lambda s: own.select(F.col("series").alias(s), F.col("cls").alias(f"c{s}"), F.col("true_cls").alias(f"t{s}"))
    pairs = true.where("i < j").select("i", "j", F.col("lag").alias("true_lag")).join(side("i"), "i").join(side("j"), "j").where("ti = tj")
    pairs = stored_table(pairs, "true-pairs")
    met = pairs.where("ci = cj AND ci = ti").join(found.where("i < j").select("i", "j", "lag"), ["i", "j"])
    met = met.select(F.col("ci").alias("cls"), F.abs(F.col("lag") - F.col("true_lag")).cast("double").alias("error"), F.abs(F.signum("lag") - F.signum("true_lag")).alias("sign"))
    met = stored_table(met, "errors")
    right = own.where("cls = true_cls").groupBy("cls").agg(F.count("*").alias("right"))
    classes = met.groupBy("cls").agg((100.0 * F.count_if(F.col("error") < 1e-5) / F.count("*")).alias("accuracy")).join(right, "cls")
    accuracy_ = classes.agg(F.sum(F.col("accuracy") * F.col("right")).alias("accuracy")).join(F.broadcast(own.agg(F.count("*").alias("all"))))
    sums = met.agg(F.coalesce(F.sum("error"), F.lit(0.0)).alias("errors"), F.coalesce(F.sum("sign"), F.lit(0.0)).alias("signs"), F.count("*").alias("n"))
    whole = sums.join(F.broadcast(pairs.agg(F.count("*").alias("n_all")))).join(F.broadcast(accuracy_))
    missed, errors = F.col("n_all") - F.col("n"), met.select("error")
    if penalty > 0:
        counts = whole.select(missed.alias("m")).where("m > 0")
        errors = errors.union(counts.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).select(F.lit(float(penalty)).alias("error")))
        mean = F.try_divide(F.col("errors") + missed * penalty, F.col("n_all"))
    else:
        mean = F.try_divide(F.col("errors"), F.col("n"))
    out = whole.select(mean.alias("rel_error"), F.try_divide(F.col("signs") + 2 * missed, F.col("n_all")).alias("sign_error"), (F.coalesce("accuracy", F.lit(0.0)) / F.col("all")).alias("accuracy"))
    return out.join(F.broadcast(exact_quantiles(errors, F.col("error"), PERCENTILES).withColumnRenamed("q", "quantiles")))


def quantile(evals: DataFrame, q: float) -> DataFrame:
    return evals.select(F.col("quantiles")[round(q / 0.05)].alias("error"))


def mean_over_rounds(metrics: DataFrame) -> DataFrame:
    """(k, sigma, model, metric, value): means over rounds; missing values do not count."""
    return metrics.groupBy("k", "sigma", "model", "metric").agg(F.avg("value").alias("value"))


def total_variation(p: DataFrame, q: DataFrame) -> DataFrame:
    """(tv): half the sum of differences of two mixings (cls, p)."""
    both = p.join(q.select("cls", F.col("p").alias("q")), "cls", "full")
    return both.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tv"))


def recovery_rates(runs: DataFrame, tolerance: float = 1e-16) -> DataFrame:
    """(keys, optimal_share, worst_error, mean_error, median_error) of repeated solves (n, k, cost, error)."""
    good = F.col("cost") <= tolerance
    return runs.groupBy("n", "k").agg(
        F.avg(good.cast("int")).alias("optimal_share"), F.max(F.when(good, F.col("error"))).alias("worst_error"),
        F.avg("error").alias("mean_error"), F.percentile("error", F.lit(0.5)).alias("median_error"),
    )


def projection(basis: np.ndarray) -> np.ndarray:
    """The projection onto the columns of a basis; for orthonormal columns this is basis @ basis.T."""
    return basis @ np.linalg.solve(basis.T @ basis, basis.T)
