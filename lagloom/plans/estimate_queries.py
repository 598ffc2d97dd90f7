"""Queries of generators and latent-signal estimators: nothing of this has an SQL form, so tests plant the truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lagloom.functions import panel as P
from lagloom.functions import spectral as S
from lagloom.functions import synth
from lagloom.operators import estimate as E
from lagloom.operators import evaluate as V
from lagloom.plans import experiments as X
from lagloom.plans.panel_queries import R, nation_returns, rounded
from lagloom.plans.registry import query
from lagloom.sources import panels as src

LENGTH = 15


def frame(spark, x: np.ndarray):
    rows = [(c, t, float(v)) for (c, t), v in np.ndenumerate(np.atleast_2d(x))]
    return spark.createDataFrame(rows, "cls int, t int, v double")


@query("planted_observations")
def _(spark, d):
    panel, truth, _ = X.planted_panel(spark, 3, 0.5)
    return panel.join(truth, "series")


@query("signal_families")
def _(spark, d):
    kinds = [synth.signals(spark, 2, 50, k).select(F.lit(k).alias("kind"), "cls", "t", "v") for k in ("gaussian", "sine", "chirp")]
    kinds.append(synth.signals(spark, 2, 50, "panel", panel=nation_returns(spark, d)).select(F.lit("panel").alias("kind"), "cls", "t", "v"))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


@query("train_test_split", f"{R} SELECT series, t, round(v, 9) + 0.0 AS v, CASE WHEN t < floor(0.5 * ((SELECT max(t) FROM rets) + 1)) THEN 'train' ELSE 'test' END AS split FROM rets")
def _(spark, d):
    r = nation_returns(spark, d)
    return rounded(synth.split_in_time(r, 0.5, r.agg(F.max("t")).first()[0] + 1), "v", digits=9)


@query("discrete_sample")
def _(spark, d):
    return synth.sampled(spark.range(1000), [0.5, 0.3, 0.2])


@query("simulated_bundle_power")
def _(spark, d):
    return synth.simulated_bundle(spark, 12, 30, 0.1)["power"]


@query("latent_signal_k2")
def _(spark, d):
    panel, _, _ = X.planted_panel(spark, 2, 0.1, 400, LENGTH, -1)
    return E.signals_of(E.best_starts(E.estimate(panel, LENGTH, 0.1, [2])))


@query("latent_signal_fixed_shares")
def _(spark, d):
    panel, _, _ = X.planted_panel(spark, 2, 0.1, 400, LENGTH, -1)
    return E.signals_of(E.best_starts(E.estimate(panel, LENGTH, 0.1, [1, 2], free_p=False)))


@query("latent_signal_nations")
def _(spark, d):
    """The signals behind the standardised quarterly returns of nations, for one to three classes."""
    quarters = nation_returns(spark, d).groupBy("series", F.floor(F.col("t") / 3).cast("int").alias("t")).agg(F.sum("v").alias("v"))
    z = P.zscored(quarters)
    return E.signals_of(E.best_starts(E.estimate(z, z.agg(F.max("t")).first()[0] + 1, 1.0, [1, 2, 3], starts=2)))


@query("em_homogeneous")
def _(spark, d):
    panel, _, _ = X.planted_panel(spark, 1, 0.3, 300, LENGTH, -1)
    return frame(spark, E.expectation_maximisation(panel, 1, LENGTH, 0.3)[0])


@query("em_two_classes")
def _(spark, d):
    panel, _, _ = X.planted_panel(spark, 2, 0.3, 400, LENGTH, -1)
    return frame(spark, E.expectation_maximisation(panel, 2, LENGTH, 0.3)[0])


@query("invariant_features_signal")
def _(spark, d):
    panel, _, _ = X.planted_panel(spark, 1, 0.1, 300, LENGTH, -1)
    return frame(spark, S.estimate_from_invariants(S.arrays(panel), LENGTH, 0.1))


@query("em_embeddings")
def _(spark, d):
    """Two hidden signals of all embeddings, moved circularly, by expectation maximisation until they move by less than 0.05."""
    return frame(spark, E.expectation_maximisation(P.zscored(src.embedding_series(spark, d)), 2, 64, 1.0, tolerance=0.025)[0])


@query("embedding_class_signals")
def _(spark, d):
    """One signal for each label of the embeddings, from the moments of its vectors."""
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    labels = table.select(F.col("vec_id").alias("series"), F.col("label").cast("int").alias("cls"))
    return E.class_signals(src.embedding_series(spark, d), labels, 64, 0.1)


@query("class_signals_from_moments")
def _(spark, d):
    panel, truth, _ = X.planted_panel(spark, 2, 0.1, 200, LENGTH, 2)
    return E.class_signals(panel, truth.select("series", "cls"), LENGTH, 0.1)


@query("model_comparison")
def _(spark, d):
    return V.mean_over_rounds(X.compare_models(spark, [2], [0.1], series=30, n=30))


@query("planted_strategy")
def _(spark, d):
    return X.planted_strategy(spark, 2, 0.5)


@query("recovery_experiment")
def _(spark, d):
    return V.recovery_rates(X.recovery_grid(spark, [8, 12], [1, 2], [0.0], 3), 1e-12)


@query("recovery_experiment_noise")
def _(spark, d):
    return X.recovery_grid(spark, [10], [2], [0.1, 1.0], 3, free_p=False)
