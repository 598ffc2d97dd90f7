"""Latent signals behind shifted noisy copies: moment matching and expectation maximisation.

Spark reduces all observations to their invariant moments (a mean, n powers, n by n bispectrum), whatever their number;
the small non-convex problem that is left is solved by a trust-region method in numpy, one task for each start."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.spectral import arrays, invariants, invariants_by_class
from lagloom.sources.storage import stored_table


class Moments:
    """Mean, power spectrum and bispectrum of observations, and the noise that is in them."""

    def __init__(self, mean: float, power: np.ndarray, bispectrum: np.ndarray, sigma: float):
        self.mean, self.power, self.bispectrum, self.sigma = mean, power, bispectrum, sigma
        n = len(power)
        a = np.arange(n)
        self.at = (a[None, :] - a[:, None]) % n  # f2 - f1
        self.bias = (a[:, None] == a[None, :]).astype(float) + (a[:, None] == 0) + (a[None, :] == 0)

    @classmethod
    def of(cls, mean: DataFrame, power: DataFrame, bispectrum: DataFrame, n: int, sigma: float) -> Moments:
        p, b = np.zeros(n), np.zeros((n, n), complex)
        for r in power.collect():
            p[r.f] = r.p
        for r in bispectrum.collect():
            b[r.f1, r.f2] = complex(r.re, r.im)
        return cls(mean.first()[0], p, b, sigma)

    def cost(self, x: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted squared distance of the moments of signals x (k by n) mixed by p to these, with its gradients."""
        n, s2 = x.shape[1], self.sigma**2
        scale = 3 + s2 * s2
        c1, c2, c3 = n * n * scale / 2, scale / (2 * n * (2 + s2)), scale / (2 * n * n * (3 + s2 * s2))
        h = np.fft.fft(x, axis=1)
        hb = h[:, self.at]
        mean = p @ x.mean(axis=1)
        b = np.einsum("ka,kb,kab->kab", h, h.conj(), hb)
        r1 = mean - self.mean
        r2 = p @ np.abs(h) ** 2 + n * s2 - self.power
        r3 = np.tensordot(p, b, 1) + n * n * s2 * mean * self.bias - self.bispectrum
        f = c1 * r1**2 + c2 * (r2**2).sum() + c3 * (np.abs(r3) ** 2).sum()
        # by the moments, then through the transform back to the signals
        bias = 2 * c3 * n * n * s2 * np.real((self.bias * r3.conj()).sum())
        g_mean = 2 * c1 * r1 + bias
        gh = 2 * c2 * 2 * r2[None] * h
        rc = 2 * c3 * r3
        ga = np.einsum("ab,kb,kab->ka", rc, h, hb.conj())
        gb = np.einsum("ab,ka,kab->kb", rc.conj(), h, hb)
        gc = np.zeros_like(h)
        full = np.einsum("ab,ka,kb->kab", rc, h.conj(), h)
        for k in range(len(x)):
            np.add.at(gc[k], self.at, full[k])
        gh = gh + ga + gb + gc
        gx = p[:, None] * (g_mean / n + np.real(np.fft.ifft(gh, axis=1)) * n)
        gp = g_mean * x.mean(axis=1) + 2 * c2 * (np.abs(h) ** 2 @ r2) + 2 * c3 * np.real(np.einsum("kab,ab->k", b, r3.conj()))
        return float(f), gx, gp


def trust_region(
    fun: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, retract=None, project=None, max_iter: int = 200, grad_tol: float = 1e-7, radius: float = 1.0
) -> tuple[np.ndarray, float, int, str]:
    """(point, cost, iterations, why it stopped): a Riemannian trust-region method with truncated conjugate gradients;
    Hessian-vector products are finite differences of gradients. retract(x, v) moves along the manifold, project(x, g)
    turns a gradient of the surrounding space into a tangent one."""
    retract = retract or (lambda x, v: x + v)
    project = project or (lambda x, g: g)
    top = 8 * radius
    f, g = fun(x)
    g = project(x, g)
    for it in range(1, max_iter + 1):
        size = np.linalg.norm(g)
        if size < grad_tol:
            return x, f, it - 1, "gradient"

        def product(v: np.ndarray, x=x, g=g) -> np.ndarray:
            norm = np.linalg.norm(v)
            if norm == 0:
                return v
            h = 2**-14 / norm
            y = retract(x, h * v)
            return project(x, (project(y, fun(y)[1]) - g) / h)

        # truncated conjugate gradients on the quadratic model
        step, hs, r, d = np.zeros_like(x), np.zeros_like(x), g.copy(), -g
        rr, stop = r @ r, size * min(0.1, size)
        for _ in range(len(x)):
            hd = product(d)
            curve = d @ hd
            alpha = rr / curve if curve > 0 else np.inf
            if curve <= 0 or np.linalg.norm(step + alpha * d) >= radius:
                a, b, c = d @ d, 2 * step @ d, step @ step - radius**2
                tau = (-b + np.sqrt(max(0.0, b * b - 4 * a * c))) / (2 * a)
                step, hs = step + tau * d, hs + tau * hd
                break
            step, hs, r = step + alpha * d, hs + alpha * hd, r + alpha * hd
            new = r @ r
            if np.sqrt(new) <= stop:
                break
            d, rr = project(x, -r + new / rr * d), new
        model = -(g @ step + 0.5 * step @ hs)
        y = retract(x, step)
        fy, gy = fun(y)
        slack = 1e3 * np.finfo(float).eps * max(1.0, abs(f))
        rho = (f - fy + slack) / (model + slack)
        if not np.isfinite(fy) or rho < 0.25:
            radius /= 4
        elif rho > 0.75 and np.linalg.norm(step) > 0.99 * radius:
            radius = min(2 * radius, top)
        if np.isfinite(fy) and rho > 0.1 and model >= 0:
            x, f, g = y, fy, project(y, gy)
        if radius < 1e-14:
            return x, f, it, "radius"
    return x, f, max_iter, "iterations"


def match_moments(moments: Moments, k: int, seed: int = 0, free_p: bool = True, p: np.ndarray | None = None, max_iter: int = 200) -> dict:
    """One start of moment matching: k signals and, if free, their shares. Shares are p = exp(q) / sum exp(q), so they stay
    inside the simplex."""
    n, rng = len(moments.power), np.random.default_rng(seed)
    p0 = np.full(k, 1 / k) if p is None else np.asarray(p, float)
    start = rng.standard_normal((k, n)) * np.sqrt(max(moments.power.mean() / n - moments.sigma**2, 1e-6))

    def split(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not free_p:
            return z.reshape(k, n), p0
        q = z[k * n :]
        e = np.exp(q - q.max())
        return z[: k * n].reshape(k, n), e / e.sum()

    def fun(z: np.ndarray) -> tuple[float, np.ndarray]:
        x, share = split(z)
        f, gx, gp = moments.cost(x, share)
        tail = share * (gp - share @ gp) if free_p else np.zeros(0)
        return f, np.concatenate([gx.ravel(), tail])

    z = np.concatenate([start.ravel(), np.log(p0) if free_p else np.zeros(0)])
    z, f, it, why = trust_region(fun, z, max_iter=max_iter, radius=max(1.0, np.linalg.norm(z) / 4))
    x, share = split(z)
    return {"x": x.tolist(), "p": share.tolist(), "cost": f, "iterations": it, "stop": why}


SOLVED = "k int, start int, cost double, iterations int, stop string, p array<double>, x array<array<double>>"


def estimate(panel: DataFrame, n: int, sigma: float, ks: list[int], starts: int = 3, free_p: bool = True) -> DataFrame:
    """(k, start, cost, iterations, stop, p, x): moment matching from several starts for each k, a task each."""
    spark = panel.sparkSession
    moments = spark.sparkContext.broadcast(Moments.of(*invariants(arrays(panel), n), n, sigma))
    grid = spark.createDataFrame([(k, s) for k in ks for s in range(starts)], "k int, start int").repartition(len(ks) * starts, "k", "start")

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        rows = [{"k": k, "start": s} | match_moments(moments.value, k, s, free_p) for k, s in zip(df.k, df.start, strict=True)]
        return pd.DataFrame(rows)

    return grid.groupBy("k", "start").applyInPandas(solve, SOLVED)


def best_starts(solved: DataFrame) -> DataFrame:
    """The cheapest start of each k."""
    return solved.groupBy("k").agg(F.min_by(F.struct("start", "cost", "p", "x"), F.struct("cost", "start")).alias("b")).select("k", "b.*")


def signals_of(solved: DataFrame) -> DataFrame:
    """(k, cls, t, v) of estimates."""
    each = solved.select("k", F.posexplode("x").alias("cls", "s"))
    return each.select("k", "cls", F.posexplode("s").alias("t", "v"))


def class_signals(panel: DataFrame, labels: DataFrame, n: int, sigma: float, starts: int = 2) -> DataFrame:
    """(cls, t, v): one signal for each class, from the moments of its series. All classes' moments are added up in one pass
    and each start of each class is solved in a task of its own, whatever the number of classes."""
    obs = arrays(panel).join(labels.select("series", "cls"), "series")
    moments = stored_table(invariants_by_class(obs, n), "moments").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    kind = labels.schema["cls"].dataType.simpleString()

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        power, bis = np.zeros(n), np.zeros((n, n), complex)
        p, b = df[df.kind == "power"], df[df.kind == "bispectrum"]
        power[p.f1], bis[b.f1, b.f2] = p.re, b.re + 1j * b.im
        found = match_moments(Moments(float(df.re[df.kind == "mean"].iloc[0]), power, bis, sigma), 1, int(df.start.iloc[0]), False)
        return pd.DataFrame({"cls": [df.cls.iloc[0]], "start": [df.start.iloc[0]], "cost": [found["cost"]], "x": [found["x"][0]]})

    solved = moments.groupBy("cls", "start").applyInPandas(solve, f"cls {kind}, start int, cost double, x array<double>")
    best = solved.groupBy("cls").agg(F.min_by("x", F.struct("cost", "start")).alias("x"))
    return best.select("cls", F.posexplode("x").alias("t", "v"))


#: Observations of the sample for batch rounds at most, of a batch, and batch rounds; panels of fewer than FULL have none.
SAMPLE, BATCH, BATCH_ROUNDS, FULL = 20_000, 1_000, 3_000, 3_000


def em_sums(x: np.ndarray, signals: np.ndarray, shares: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Of observations (rows of x): sums of their copies moved back, by class, weighed by how likely each shift and class is;
    the weights of the classes; and the log-likelihood, but for what depends on neither signals nor shares."""
    n = signals.shape[1]
    hx, hs = np.fft.rfft(x, axis=1), np.fft.rfft(signals, axis=1)
    score = np.fft.irfft(hx[:, None, :] * hs.conj()[None], n=n, axis=2)  # [m, k, s] = sum over t of x[t + s] signal[t]
    log = (score - 0.5 * (signals**2).sum(1)[None, :, None]) / sigma**2 + np.log(np.maximum(shares, 1e-300))[None, :, None]
    top = log.max(axis=(1, 2), keepdims=True)
    w = np.exp(log - top)
    total = w.sum(axis=(1, 2), keepdims=True)
    w /= total
    back = np.fft.irfft(hx[:, None, :] * np.fft.rfft(w, axis=2).conj(), n=n, axis=2).sum(0)
    return back, w.sum(axis=(0, 2)), float((np.log(total) + top).sum())


def em_update(back: np.ndarray, mass: np.ndarray, signals: np.ndarray, sigma: float, prior: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The signals that fit the sums best: their means, or under a Gaussian prior (mean k by n, precision kn by kn) the
    solution of one linear system."""
    if prior is None:
        return np.where(mass[:, None] > 1e-12, back / np.maximum(mass[:, None], 1e-12), signals)
    mean, precision = prior
    left = precision + np.diag(np.repeat(mass, signals.shape[1]) / sigma**2)
    return np.linalg.solve(left, (back / sigma**2).ravel() + precision @ mean.ravel()).reshape(signals.shape)


def em_step(obs: DataFrame, signals: np.ndarray, shares: np.ndarray, sigma: float, prior=None) -> tuple[np.ndarray, np.ndarray, float]:
    """One round of expectation maximisation over all observations (x array): (signals, shares, log-likelihood of what went
    in). Each partition adds its sums; k by n sums and k weights come back, whatever the number of observations."""
    k, n = signals.shape

    def sums(batches):
        for df in batches:
            if len(df):
                back, mass, fit = em_sums(np.array(df.x.to_list(), float), signals, shares, sigma)
                yield pd.DataFrame({"cls": np.append(np.repeat(np.arange(k), n + 1), -1), "t": np.append(np.tile(np.arange(n + 1), k), 0), "s": np.append(np.column_stack([back, mass]).ravel(), fit)})

    rows = obs.select("x").mapInPandas(sums, "cls int, t int, s double").groupBy("cls", "t").agg(F.sum("s").alias("s")).collect()
    table, fit = np.zeros((k, n + 1)), 0.0
    for r in rows:
        if r.cls < 0:
            fit = r.s
        else:
            table[r.cls, r.t] = r.s
    return em_update(table[:, :n], table[:, n], signals, sigma, prior), table[:, n] / max(table[:, n].sum(), 1e-300), fit


def em_batches(obs: DataFrame, total: int, signals: np.ndarray, shares: np.ndarray, sigma: float, prior, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounds over small batches to start with: a sample of at most SAMPLE observations, by hash, goes to one task, which
    draws BATCH of them for each round. What full rounds converge to is decided by all observations."""
    share = min(1.0, SAMPLE / total)
    sample = obs.where(F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(SAMPLE)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        x, rng, now, p = np.array(df.x.to_list(), float), np.random.default_rng(seed), signals, shares
        for _ in range(rounds):
            back, mass, _ = em_sums(x[rng.integers(len(x), size=BATCH)], now, p, sigma)
            now, p = em_update(back, mass, now, sigma, prior), mass / mass.sum()
        return pd.DataFrame({"x": [now.ravel()], "p": [p]})

    done = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "x array<double>, p array<double>").first()
    return (np.array(done.x).reshape(signals.shape), np.array(done.p)) if done else (signals, shares)


def moved_up_to_shift(old: np.ndarray, new: np.ndarray) -> float:
    """The distance of signals (rows), each to its nearest circular shift."""
    score = np.fft.irfft(np.fft.rfft(old, axis=1) * np.fft.rfft(new, axis=1).conj(), n=old.shape[1], axis=1).max(axis=1)
    return float(np.sqrt(np.maximum((old**2).sum(1) + (new**2).sum(1) - 2 * score, 0).sum()))


def expectation_maximisation(
    panel: DataFrame, k: int, n: int, sigma: float, rounds: int = 10_000, tolerance: float = 1e-5, seed: int = 0,
    prior: tuple[np.ndarray, np.ndarray] | None = None, batch_rounds: int = BATCH_ROUNDS, fits: list[float] | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(signals, shares, rounds): EM over shifts and classes. Large panels start with batch rounds on a sample; then all
    observations count in every round, until the signals, up to circular shifts, move by less than the tolerance (relative
    to their size for one class, times k for more) or `rounds` are over. fits gets the log-likelihood of every full round."""
    obs = stored_table(arrays(panel).select("x"), "observations")
    signals, shares = np.random.default_rng(seed).standard_normal((k, n)), np.full(k, 1 / k)
    total = obs.count()
    if total >= FULL and batch_rounds:
        signals, shares = em_batches(obs, total, signals, shares, sigma, prior, batch_rounds, seed)
    for r in range(1, rounds + 1):
        new, shares, fit = em_step(obs, signals, shares, sigma, prior)
        if fits is not None:
            fits.append(fit)
        moved = moved_up_to_shift(signals, new) / (max(np.linalg.norm(signals), 1e-300) if k == 1 else k)
        signals = new
        if moved < tolerance:
            return signals, shares, r
    return signals, shares, rounds
