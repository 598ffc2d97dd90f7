"""Known answers and planted truths."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagloom.functions import panel as P
from lagloom.functions import spectral as S
from lagloom.functions import synth
from lagloom.operators import align as A
from lagloom.operators import cluster as C
from lagloom.operators import estimate as E
from lagloom.operators import evaluate as V
from lagloom.operators import trade as T
from lagloom.plans import experiments as X
from lagloom.plans import registry, walk
from lagloom.sources import panels as src
from lagloom.sources.storage import stored_table
from lagloom.streaming.windows import sliding_moments


def long(spark, x):
    return spark.createDataFrame([(s, t, float(v)) for (s, t), v in np.ndenumerate(np.atleast_2d(x))], "series long, t int, v double")


@given(st.integers(2, 7), st.integers(0, 10_000))
@settings(max_examples=30, deadline=None)
def test_assignment_is_cheapest(n, seed):
    from itertools import permutations

    cost = np.random.default_rng(seed).random((n, n))
    pick = A.assignment(cost)
    assert sorted(pick) == list(range(n))
    assert cost[np.arange(n), pick].sum() == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def test_assignment_of_a_magic_square():
    magic = np.array([[17, 24, 1, 8, 15], [23, 5, 7, 14, 16], [4, 6, 13, 20, 22], [10, 12, 19, 21, 3], [11, 18, 25, 2, 9]])
    pick = A.assignment(magic.astype(float))
    assert (pick + 1).tolist() == [3, 2, 1, 5, 4] and magic[np.arange(5), pick].sum() == 15
    wide = A.assignment(np.array([[5.0, 1.0, np.inf], [1.0, 5.0, 9.0]]))
    assert wide.tolist() == [1, 0] and A.assignment(np.array([[5.0], [1.0]])).tolist() == [-1, 0]


@given(st.integers(3, 9), st.integers(0, 10_000))
@settings(max_examples=30, deadline=None)
def test_svd_ranking_keeps_the_order_of_lags(n, seed):
    lags = np.random.default_rng(seed).integers(0, 5, n).astype(float)
    r = A.svd_ranking(lags[:, None] - lags[None, :])
    differ = lags[:, None] != lags[None, :]
    agree = np.sign(np.round(r[:, None] - r[None, :], 6)) == np.sign(lags[:, None] - lags[None, :])
    assert not differ.any() or agree[differ].mean() >= 0.9


def test_svd_ranking_of_two_lags_is_exact():
    lags = np.array([0.0, 0, 0, 3, 3, 3])
    r = A.svd_ranking(lags[:, None] - lags[None, :])
    assert np.allclose(r - r.min(), lags, atol=1e-5) and not A.svd_ranking(np.zeros((3, 3))).any()


@pytest.mark.parametrize("block", [2, 256])
def test_planted_shifts_are_found(spark, block):
    x = np.random.default_rng(0).standard_normal(40)
    shifts = [0, 2, 1, 3, 0]
    panel = long(spark, np.stack([np.roll(x, s) for s in shifts]))
    got = {(r.i, r.j): r.lag for r in A.lag_pairs(panel, 5, block=block).collect()}
    assert got == {(i, j): shifts[i] - shifts[j] for i in range(5) for j in range(i + 1, 5)}
    vector = {r.series: r.lag for r in A.row_mean_lags(A.lag_pairs(panel, 5)).collect()}
    assert [vector[k] for k in range(5)] == shifts
    ref = panel.where("series = 0").select(F.lit(0).alias("cls"), "t", "v")
    kept = {r.series: r.lag for r in A.constrained_lags(panel, ref, 3, 40).collect()}
    assert [kept[k] for k in range(5)] == shifts


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_all_pairs_meet_once_and_no_block_is_sent_for_each_other(spark, block):
    x = np.random.default_rng(2).standard_normal((13, 20))
    best = {(i, j): A.pair_scores(x[i : i + 1], x[j : j + 1], 3)[0][0, 0] for i in range(13) for j in range(i + 1, 13)}
    panel = long(spark, x)
    found = A.lag_pairs(panel, 3, block=block)
    rows = found.collect()
    assert len(rows) == len(best) and {(r.i, r.j): r.lag for r in rows} == best
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Generate" not in plan
    keyed = panel.withColumn("start", F.explode(F.array(F.lit(4), F.lit(9)))).withColumn("v", F.when(F.col("start") == 9, -F.col("v")).otherwise(F.col("v")))
    rows = A.lag_pairs(keyed, 3, block=block, key="start", within=[2, 3]).collect()
    assert len(rows) == 4 * len(best)
    assert {(r.start, r.i, r.j): r.lag for r in rows if r.m == 3} == {(s, *p): lag for s in (4, 9) for p, lag in best.items()}


@pytest.mark.parametrize("name", ["lag_matrix_embeddings", "lag_matrix_all_embeddings"])
def test_vectors_are_sent_once_and_whole(spark, sf_dir, monkeypatch, name):
    plans = []
    monkeypatch.setattr(A, "stored_table", lambda df, to: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored_table(df, to))[1])
    registry.QUERIES[name](spark, sf_dir)
    (blocks,) = plans
    assert blocks.count("Exchange hashpartitioning") == 1 and "Generate" not in blocks


@pytest.mark.parametrize("block", [3, 256])
def test_vectors_as_arrays_have_the_lags_of_their_panel(spark, tmp_path, block):
    x = np.random.default_rng(4).standard_normal((11, 16)).astype("float32")
    x[3] = 0.1  # constant
    rows = [(k, [float(v) for v in x[k]]) for k in range(11)] + [(11, None), (12, [])]
    rows[5][1][2] = None
    twice = [(k, e) for k in range(4) for e in (rows[k][1], rows[k + 4][1])]  # two rows an id
    for part, vectors in (("once", rows), ("twice", twice)):
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/{part}/embeddings.parquet")
        panel = P.zscored(src.embedding_series(spark, f"{tmp_path}/{part}"))
        want = {(r.i, r.j): r for r in A.lag_pairs(panel, 3, block=block).collect()}
        got = A.array_lag_pairs(src.embedding_arrays(spark, f"{tmp_path}/{part}"), 3, block=block, raw=True).collect()
        assert len(got) == len(want) == (55 if part == "once" else 6)
        assert all(r.lag == want[r.i, r.j].lag for r in got)
        np.testing.assert_allclose([r.score for r in got], [want[r.i, r.j].score for r in got], atol=1e-12)
        assert any(np.isnan(r.score) for r in got) and not all(np.isnan(r.score) for r in got)


def test_linear_lags_have_the_other_sign(spark):
    x = np.random.default_rng(1).standard_normal(30)
    late = np.concatenate([np.zeros(2), x[:-2]])
    assert A.lag_pairs(long(spark, np.stack([x, late])), 4, circular=False).first().lag == 2
    assert A.lag_pairs(long(spark, np.stack([x, late])), 4).first().lag == -2


def test_synchronised_mean_counts_zeros(spark):
    panel = long(spark, np.array([[1.0, 2.0, 3.0], [9.0, 1.0, 2.0]]))
    lags = spark.createDataFrame([(0, 0), (1, 1)], "series long, lag int")
    assert [r.v for r in A.synchronised(panel, lags, 3).orderBy("t").collect()] == [1.0, 2.0, 1.5]


def test_relabelling_and_rand(spark):
    one = spark.createDataFrame([(k, k % 3) for k in range(30)], "series long, cls int")
    two = spark.createDataFrame([(k, (k + 1) % 3) for k in range(30)], "series long, cls int")
    assert C.adjusted_rand(one, two).first().ari == 1.0
    assert {(r.a, r.b) for r in C.matched_classes(one, two).collect()} == {(0, 1), (1, 2), (2, 0)}


def test_spectral_clusters_find_blocks(spark):
    pairs = [(i, j, 0, 1.0 if i % 2 == j % 2 else 0.05) for i in range(12) for j in range(i + 1, 12)]
    got = {r.series: r.cls for r in C.spectral_clusters(spark.createDataFrame(pairs, A.PAIRS), [2]).collect()}
    assert len({got[k] for k in range(0, 12, 2)}) == 1 and got[0] != got[1]


def test_spectra_agree(spark):
    x = np.random.default_rng(2).standard_normal((3, 8))
    spec = {(r.series, r.f): complex(r.re, r.im) for r in S.dft(long(spark, x)).collect()}
    h = np.fft.fft(x, axis=1)
    assert all(abs(spec[s, f] - h[s, f]) < 1e-9 for s in range(3) for f in range(8))
    mean, power, bis = S.invariants(S.arrays(long(spark, x)), 8)
    assert mean.first()[0] == pytest.approx(x.mean())
    assert {r.f: r.p for r in power.collect()} == pytest.approx(dict(enumerate((np.abs(h) ** 2).mean(0))))
    b = {(r.f1, r.f2): complex(r.re, r.im) for r in bis.collect()}
    want = np.array([[np.mean([h[s, i] * np.conj(h[s, j]) * h[s, (j - i) % 8] for s in range(3)]) for j in range(8)] for i in range(8)])
    assert max(abs(b[i, j] - want[i, j]) for i in range(8) for j in range(8)) < 1e-9


def up_to_shift(a, b):
    return min(np.linalg.norm(np.roll(a, s) - b) for s in range(len(a))) / np.linalg.norm(b)


@pytest.mark.parametrize("n", [11, 12])
def test_signal_from_exact_invariants(n):
    x = np.random.default_rng(n).standard_normal(n)
    m = X.planted_moments(x[None], np.ones(1), 0.0)
    assert up_to_shift(S.signal_from_invariants(m.mean, m.power, m.bispectrum), x) < 1e-5


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    m = X.planted_moments(rng.standard_normal((2, 7)), np.array([0.3, 0.7]), 0.5)
    x, p, e = rng.standard_normal((2, 7)), np.array([0.4, 0.6]), 1e-6
    _, gx, gp = m.cost(x, p)
    d = rng.standard_normal((2, 7))
    assert (m.cost(x + e * d, p)[0] - m.cost(x - e * d, p)[0]) / (2 * e) == pytest.approx((gx * d).sum(), rel=1e-5)
    q = np.array([1.0, 0.0])
    assert (m.cost(x, p + e * q)[0] - m.cost(x, p - e * q)[0]) / (2 * e) == pytest.approx(gp @ q, rel=1e-5)


def test_moment_matching_recovers_signals():
    x, p = np.random.default_rng(4).standard_normal((2, 12)), np.array([0.35, 0.65])
    got = min((E.match_moments(X.planted_moments(x, p, 0.3), 2, s) for s in range(3)), key=lambda g: g["cost"])
    order, aligned = A.align_signals(np.array(got["x"]), x)
    assert np.linalg.norm(aligned - x) / np.linalg.norm(x) < 1e-4 and np.abs(np.array(got["p"])[order] - p).max() < 1e-4


def test_estimators_on_observations(spark):
    panel, truth, signal = X.planted_panel(spark, 1, 0.1, 300, 13, -1)
    x = np.array([r.v for r in signal.orderBy("t").collect()])
    best = E.best_starts(E.estimate(panel, 13, 0.1, [1], 2)).first()
    assert up_to_shift(np.array(best.x[0]), x) < 0.1
    assert up_to_shift(E.expectation_maximisation(panel, 1, 13, 0.1, 30)[0][0], x) < 0.1
    assert up_to_shift(S.estimate_from_invariants(S.arrays(panel), 13, 0.1), x) < 0.15
    assert truth.count() == 300


def test_planted_study_is_solved_without_noise(spark):
    rows = {(r.model, r.metric): r.value for r in X.compare_models(spark, [1], [0.01], series=12, n=30).collect()}
    assert rows["pairwise", "accuracy"] == 100 and rows["sync", "accuracy"] == 100 and rows["spc-homo", "accuracy"] == 100


def test_generators_do_not_depend_on_partitions(spark):
    a = synth.signals(spark, 2, 20, seed=1).orderBy("cls", "t").collect()
    b = synth.signals(spark, 2, 20, seed=1).repartition(7).orderBy("cls", "t").collect()
    assert a == b
    _, truth = synth.observations(synth.signals(spark, 2, 20), [5, 3], 20, 4, 0.1)
    assert sorted(r["count"] for r in truth.groupBy("cls").count().collect()) == [3, 5] and truth.agg(F.max("shift")).first()[0] <= 4
    zero, _ = synth.observations(synth.signals(spark, 1, 20), [4], 20, 4, 0.0, cyclic=False, pad="zero")
    assert zero.count() == 80
    assert sum(synth.proportions(4, 1)) == pytest.approx(1)


def test_missing_pairs_count_as_wrong(spark):
    true = spark.createDataFrame([(0, 1, 1), (0, 2, -1), (1, 2, 0)], "i long, j long, lag int")
    found = spark.createDataFrame([(0, 1, 1), (0, 2, 1)], "i long, j long, lag int")
    e = V.pair_errors(found, true)
    whole = V.whole_errors(e).first()
    assert whole.accuracy == pytest.approx(100 / 3) and whole.rel_error == 1.0 and whole.sign_error == pytest.approx(4 / 3)
    assert np.allclose(V.projection(np.array([[1.0], [1.0]])), 0.5)


def test_student_tail():
    assert T.student_tail(2.0, 10) == pytest.approx(0.0733880348, rel=1e-6)
    assert T.student_tail(0.0, 5) == 1.0 and T.student_tail(1.0, 1) == pytest.approx(0.5)


def test_two_groups(spark):
    lead = spark.createDataFrame([(t, float((-1) ** t)) for t in range(6)], "t int, v double")
    follow = spark.createDataFrame([(t, 1.0) for t in range(6)], "t int, v double")
    got = {r.t: r.pnl for r in T.two_group_pnl(lead, follow, 1).collect()}
    assert got == {0: None, 1: 1.0, 2: -1.0, 3: 1.0, 4: -1.0, 5: 1.0}


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ticker,X20000103,X20000104\nA,0.1,\nB,0.2,0.3\n")
    got = {(r.series, r.t): r.v for r in src.read_returns(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {("A", 0): 0.1, ("A", 1): None, ("B", 0): 0.2, ("B", 1): 0.3}
    assert src.read_returns(spark, str(tmp_path / "r.csv"), drop_incomplete=True).count() == 2
    (tmp_path / "m.csv").write_text("34200.5,1,11,100,5000,1\n34201.5,1,12,50,5010,-1\n")
    (tmp_path / "b.csv").write_text("5020,1,5000,2\n5030,1,5010,2\n")
    book = P.mid_price(src.read_order_book(spark, str(tmp_path / "m.csv"), str(tmp_path / "b.csv"))).orderBy("row_id").collect()
    assert [(r.row_id, r.time, r.v) for r in book] == [(0, 34200.5, 5010.0), (1, 34201.5, 5020.0)]
    panel = long(spark, np.eye(3))
    src.write_table(panel, str(tmp_path / "t"), "series")
    assert src.read_table(spark, str(tmp_path / "t"), 1, 2).count() == 3
    src.write_returns(panel, str(tmp_path / "out"))


def test_walk_forward(spark):
    panel = long(spark, np.arange(30.0)[None])
    w = walk.windows(spark, 0, 20, 5, 10)
    assert [(r.start, r.end) for r in w.orderBy("start").collect()] == [(0, 5), (10, 15)]
    assert walk.in_windows(panel, w).count() == 10 and walk.in_windows(panel, w, 3).count() == 6
    weights = spark.createDataFrame([(0, 0, 1.0), (10, 0, -1.0)], "start int, series long, w double")
    assert {r.t: r.pnl for r in walk.concatenated(walk.trade_ahead(panel, w, weights, 3)).collect()} == {5: 5.0, 6: 6.0, 7: 7.0, 15: -15.0, 16: -16.0, 17: -17.0}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 2).alias("series"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("v"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sliding_moments(stream, "2 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.start, r.series, r.n, r.mean) for r in df.collect())
    assert key(spark.table("moments")) == key(sliding_moments(rows, "2 days", "1 day"))


def test_smoothing_and_interpolation(spark):
    t = np.arange(20)
    noisy = np.sin(t / 3) + 0.2 * np.random.default_rng(0).standard_normal(20)
    got = np.array([r.v for r in C.smooth(long(spark, noisy), 0.2).orderBy("t").collect()])
    assert np.linalg.norm(got - np.sin(t / 3)) < np.linalg.norm(noisy - np.sin(t / 3))
    at = spark.createDataFrame([(0.5,), (-3.0,), (99.0,)], "x double")
    spots = {r.x: r.v for r in P.interpolated(long(spark, np.array([1.0, 2.0, 4.0])), at).collect()}
    assert spots == {0.5: 1.5, -3.0: 1.0, 99.0: 4.0} and not math.isnan(spots[0.5])


def test_complex_phases_from_a_bispectrum():
    for n, seed in ((5, 0), (8, 1), (11, 2)):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=n) + 1j * rng.normal(size=n)
        y = np.fft.fft(x)
        f = np.arange(n)
        b = y[:, None] * np.conj(y)[None, :] * y[(f[None, :] - f[:, None]) % n]
        found = np.fft.ifft(np.abs(y) * S.complex_phases_from_bispectrum(b))
        error = min(np.linalg.norm(np.roll(found, k) - x) for k in range(n)) / np.linalg.norm(x)
        assert error < 1e-6
        z = S.complex_phases_from_bispectrum(b, first=y * np.exp(0.05j * rng.normal(size=n)))
        assert np.allclose(z, y / np.abs(y), atol=1e-6)
    with pytest.raises(ValueError):
        S.complex_phases_from_bispectrum(np.ones((3, 3)), first=np.array([1, 0, 1]))


def test_parameters_runs_and_layouts(spark, tmp_path):
    from datetime import datetime

    src.write_parameters(spark, f"{tmp_path}/params", k=[1, 2], sigma=0.5, note='a "b"\\c')
    assert src.read_parameters(spark, f"{tmp_path}/params") == {"k": [1, 2], "sigma": 0.5, "note": 'a "b"\\c'}
    x = long(spark, np.arange(6).reshape(3, 2))
    early, late = datetime(2020, 1, 2, 3, 4, 5), datetime(2021, 1, 1)
    for when, more in ((late, 10), (early, 0), (early, 1)):
        src.write_run(x.withColumn("v", F.col("v") + more), f"{tmp_path}/runs", when)
    total = lambda df: df.agg(F.sum("v")).first()[0]
    assert total(src.read_run(spark, f"{tmp_path}/runs")) == 15 + 60
    assert total(src.read_run(spark, f"{tmp_path}/runs", early)) == 15 + 6
    both = x.withColumn("sigma", F.lit(0.5)).union(x.withColumn("sigma", F.lit(1.5)).withColumn("v", -F.col("v")))
    src.write_table(both, f"{tmp_path}/signals", "sigma")
    cut = src.read_signals(spark, f"{tmp_path}/signals", first=2, sigma=1.5)
    assert sorted((r.series, r.t, r.v) for r in cut.collect()) == [(0, 0, 0.0), (0, 1, -1.0), (1, 0, -2.0), (1, 1, -3.0)]


def test_moments_of_all_classes_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    x, cls = rng.standard_normal((30, 8)), rng.integers(0, 3, 30)
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cls)], "series long, cls int")
    got = {(r.cls, r.kind, r.f1, r.f2): complex(r.re, r.im) for r in S.invariants_by_class(S.arrays(long(spark, x)).join(labels, "series"), 8).collect()}
    assert len(got) == 3 * (1 + 8 + 64)
    for c in range(3):
        h = np.fft.fft(x[cls == c], axis=1)
        assert np.isclose(got[c, "mean", 0, 0], x[cls == c].mean())
        for a in range(8):
            assert np.isclose(got[c, "power", a, 0], (np.abs(h[:, a]) ** 2).mean())
            for b in range(8):
                assert np.isclose(got[c, "bispectrum", a, b], (h[:, a] * h[:, b].conj() * h[:, (b - a) % 8]).mean())


def test_signals_of_all_classes_are_found_in_one_pass(spark):
    rng = np.random.default_rng(12)
    truth = rng.standard_normal((3, 12))
    x = np.stack([np.roll(truth[k % 3], int(rng.integers(12))) for k in range(30)])
    labels = spark.createDataFrame([(k, k % 3) for k in range(30)], "series long, cls int")
    got = E.class_signals(long(spark, x), labels, 12, 0.0, starts=4).toPandas().pivot(index="cls", columns="t", values="v").to_numpy()
    for c in range(3):
        assert min(np.abs(np.roll(got[c], s) - truth[c]).max() for s in range(12)) < 1e-3


def test_scores_by_spectra_equal_those_by_products():
    rng = np.random.default_rng(13)
    a, b = rng.standard_normal((5, 64)), rng.standard_normal(64)
    want = np.array([[np.roll(x, -d) @ b for d in range(64)] for x in a])
    assert np.allclose(A.circular_scores(a, b), want)


def test_expectation_maximisation_never_gets_worse(spark, monkeypatch):
    rng = np.random.default_rng(14)
    truth = rng.standard_normal((2, 16))
    x = np.stack([np.roll(truth[k % 2], int(rng.integers(16))) + 0.4 * rng.standard_normal(16) for k in range(400)])
    fits: list[float] = []
    signals, shares, rounds = E.expectation_maximisation(long(spark, x), 2, 16, 0.4, seed=3, fits=fits)
    assert rounds == len(fits) < 10_000 and all(b >= a - 1e-8 * abs(a) for a, b in zip(fits, fits[1:], strict=False))
    order, found = A.align_signals(signals, truth)
    assert np.linalg.norm(found - truth) / np.linalg.norm(truth) < 0.15 and np.allclose(shares, 0.5, atol=0.1)
    monkeypatch.setattr(E, "FULL", 100)  # batch rounds first
    started: list[float] = []
    again = E.expectation_maximisation(long(spark, x), 2, 16, 0.4, seed=3, batch_rounds=60, fits=started)
    assert again[2] <= rounds and started[-1] >= fits[-1] - 1e-6 * abs(fits[-1])
    # a strong prior holds the signals where it says
    prior = (np.zeros((2, 16)), 1e9 * np.eye(32))
    assert np.abs(E.expectation_maximisation(long(spark, x), 2, 16, 0.4, prior=prior)[0]).max() < 1e-3


def test_wide_returns_can_be_read_again(spark, tmp_path):
    wide = spark.createDataFrame([("a", 0.5, None), ("b", -1.0, 2.0)], "ticker string, X20200102 double, X20200103 double")
    panel = src.melted(wide, "ticker")
    src.write_wide_returns(panel, str(tmp_path / "wide"))
    again = src.read_returns(spark, str(tmp_path / "wide"))
    assert sorted(map(str, again.collect())) == sorted(map(str, panel.collect()))
