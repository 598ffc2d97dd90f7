"""Eigenvectors of matrices stored as edges, k-means and rankings on them: no task holds a matrix.

A matrix is rows (keys..., i, j, w), a symmetric one with both orders of each pair, one matrix for each value of the keys;
a block of vectors is rows (keys..., node, x0, x1, ...). A product is a join of edges with vectors on j and sums by i, a
Gram matrix of the columns is one aggregation by keys, and only such Gram matrices (a dozen columns, whatever the number of
nodes) are solved in Python, one row for each key. Rounds end in stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.select import exact_quantiles
from lagloom.sources.storage import stored_table

def under_own_names(run: Callable[[DataFrame, list[str]], DataFrame], table: DataFrame, keys: list[str]) -> DataFrame:
    """run(table, keys) with keys that clash with no other column, which get their names back."""
    inside = [f"_key{c}" for c in range(len(keys))]
    done = run(table.withColumnsRenamed(dict(zip(keys, inside, strict=True))), inside)
    return done.withColumnsRenamed(dict(zip(inside, keys, strict=True)))


Product = Callable[[DataFrame, list[str]], DataFrame]
#: Products in a round, rounds at most, and the relative residual at which a round is the last (rounding leaves 1e-8).
STEPS, ROUNDS, TOLERANCE = 4, 8, 1e-7


def product(edges: DataFrame, vectors: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys..., node, columns...): the matrix times each column; nodes without edges get 0."""
    x = vectors.select(*keys, F.col("node").alias("j"), *columns)
    sums = edges.join(x, [*keys, "j"]).groupBy(*keys, F.col("i").alias("node")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])
    return vectors.select(*keys, "node").join(sums, [*keys, "node"], "left").fillna(0.0, columns)


def _ritz(keys: list[str], width: int):
    """Of a Gram matrix of the blocks v, A v, A A v, ...: the coefficients of the leading vectors of A in the span of all
    but the last block, their values, and their largest residual."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for _, r in df.iterrows():
                m = (STEPS + 1) * width
                gram = np.zeros((m, m))
                gram[np.triu_indices(m)] = r.gram
                gram = gram + gram.T - np.diag(np.diag(gram))
                n = STEPS * width
                scale = 1 / np.sqrt(np.maximum(np.diag(gram)[:n], 1e-300))
                values, basis = np.linalg.eigh(scale[:, None] * gram[:n, :n] * scale[None, :])
                good = values > 1e-11 * max(values[-1], 1e-300)
                basis = scale[:, None] * basis[:, good] / np.sqrt(values[good])[None, :]  # orthonormal in the Gram's sense
                moved = gram[:n, width:]  # the basis against A times it: each block's image is the next block
                small = basis.T @ moved @ basis
                theta, u = np.linalg.eigh((small + small.T) / 2)
                pick = np.argsort(-theta)[:width]
                c = np.zeros((n, width))
                c[:, : len(pick)] = basis @ u[:, pick]
                lead = np.zeros(width)
                lead[: len(pick)] = theta[pick]
                image = np.zeros((m, width))  # A c - theta c, in terms of all blocks
                image[width:] += c
                image[:n] -= c * lead[None, :]
                error = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", image, gram, image), 0))
                rows.append((*[r[k] for k in keys], c.ravel().tolist(), lead.tolist(), (error / max(abs(lead).max(), 1e-300)).tolist()))
            yield pd.DataFrame(rows, columns=[*keys, "c", "theta", "error"])

    return solve


def leading_vectors(nodes: DataFrame, multiply: Product, k: int, keys: list[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(keys..., node, x0, ..., theta): orthonormal eigenvectors of the k largest eigenvalues of a symmetric matrix, by
    restarted block Krylov rounds; theta is the array of eigenvalues. nodes: (keys..., node); multiply takes vectors and the
    names of their columns. A spare column beside the k speeds up the rounds. Stops when the residuals of all k are small in
    all matrices, or after so many rounds, when what is left is within the noise of nearly equal eigenvalues."""
    width = k + 1
    first = [f"x{c}" for c in range(width)]
    start = [((F.pmod(F.xxhash64(F.lit(c), *[F.col(x).cast("string") for x in keys], F.col("node").cast("string")), F.lit(1 << 20)) / float(1 << 19)) - 1.0).alias(x) for c, x in enumerate(first)]
    block = stored_table(nodes.select(*keys, "node", *start), "block")
    kinds = ", ".join(f"{x} {nodes.schema[x].dataType.simpleString()}" for x in keys)
    for _ in range(rounds):
        all_, last = block, first
        for s in range(1, STEPS + 1):
            names = [f"y{s}_{c}" for c in range(width)]
            image = multiply(all_.select(*keys, "node", *last), last)
            all_ = stored_table(all_.drop("theta").join(image.select(*keys, "node", *[F.col(a).alias(b) for a, b in zip(last, names, strict=True)]), [*keys, "node"]), "krylov")
            last = names
        columns = [c for c in all_.columns if c not in (*keys, "node")]
        cells = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
        gram = all_.groupBy(*keys).agg(F.array(*cells).alias("gram"))
        solved = stored_table(gram.mapInPandas(_ritz(keys, width), f"{kinds}, c array<double>, theta array<double>, error array<double>"), "ritz")
        used = columns[: STEPS * width]
        turned = [reduce(lambda a, b: a + b, [F.col(x) * F.get("c", F.lit(r * width + c)) for r, x in enumerate(used)]).alias(f"x{c}") for c in range(width)]
        block = stored_table(all_.join(solved, keys).select(*keys, "node", *turned, "theta"), "block")
        worst = solved.agg(F.max(F.array_max(F.slice("error", 1, k)))).first()[0]
        if worst is None or worst < tolerance:
            break
    return block.select(*keys, "node", *first[:k], F.slice("theta", 1, k).alias("theta"))


def kmeans(points: DataFrame, columns: list[str], keys: list[str], k: str, starts: int = 5, rounds: int = 100) -> DataFrame:
    """(keys..., node, cls): for every value of the keys the points (keys..., node, columns...) in column k many classes, by
    the best of several k-means runs, all runs of all keys in the same jobs. Each run draws its centres one by one, points
    by their squared distance to the nearest centre so far, with random numbers that follow from run and node."""
    keyed = [*keys, "start"]
    runs = stored_table(points.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))), "points")
    place = F.struct(*[F.col(c) for c in columns])
    away = lambda p, q: reduce(lambda a, b: a + b, [(p[c] - q[c]) ** 2 for c in columns])
    uniform = lambda s: (F.pmod(F.xxhash64(F.lit(s), "start", F.col("node").cast("string")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    largest = points.agg(F.max(k)).first()[0] or 1
    centres = runs.groupBy(*keyed).agg(F.max(k).alias("want"), F.array(F.max_by(place, uniform(0))).alias("centres"))
    for s in range(1, largest):
        centres = stored_table(centres, "centres")
        far = F.array_min(F.transform("centres", lambda q: away(place, q)))
        # the least of exponential times at rates of `far` falls on a point with a chance in proportion to it
        drawn = runs.join(centres, keyed).where(F.col("want") > s).groupBy(*keyed).agg(F.max_by(place, F.when(far > 0, F.log(uniform(s)) / far).otherwise(F.lit(float("-inf")))).alias("more"))
        centres = centres.join(drawn, keyed, "left").select(*keyed, "want", F.when(F.col("more").isNull(), F.col("centres")).otherwise(F.concat("centres", F.array("more"))).alias("centres"))
    distances = F.transform("centres", lambda q: away(place, q))
    before = None
    for _ in range(rounds):
        centres = stored_table(centres, "centres")
        own = runs.join(centres, keyed).withColumn("d", distances).withColumn("cls", (F.array_position("d", F.array_min("d")) - 1).cast("int"))
        own = stored_table(own.select(*keyed, "node", "cls", F.array_min("d").alias("d"), *columns), "assigned")
        cost = own.agg(F.sum(F.round("d", 12))).first()[0]
        if before is not None and (cost is None or before - cost <= 1e-10 * abs(before)):
            break
        before = cost
        means = own.groupBy(*keyed, "cls").agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("mean"))
        moved = means.groupBy(*keyed).agg(F.map_from_entries(F.collect_list(F.struct("cls", "mean"))).alias("means"))  # k a run
        centres = centres.join(moved, keyed).withColumn("centres", F.transform("centres", lambda q, i: F.coalesce(F.col("means")[i], q))).drop("means")
    costs = own.groupBy(*keyed).agg(F.sum("d").alias("cost"))
    best = costs.groupBy(*keys).agg(F.min_by("start", F.struct(F.round("cost", 9), "start")).alias("start"))
    return own.join(best, keyed, "left_semi").select(*keys, "node", "cls")


def named_by_first(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Classes of (keys..., node, cls) numbered 0, 1, ... by their least nodes."""
    firsts = labels.groupBy(*keys, "cls").agg(F.min("node").alias("first"))
    names = firsts.select(*keys, "cls", (F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).cast("int").alias("name"))  # k rows a key
    return labels.join(names, [*keys, "cls"]).select(*keys, "node", F.col("name").alias("cls"))


def spectral_classes(pairs: DataFrame, ks: list[int], keys: list[str]) -> DataFrame:
    """(keys..., k, series, cls) for each k: k-means on the unit rows of the leading eigenvectors of the affinity (keys...,
    i, j, score), normalised by its row sums. Classes are numbered by their least series; k or fewer series are a class each."""
    return under_own_names(lambda p, own: _spectral_classes(p, ks, own), pairs, keys)


def _spectral_classes(pairs: DataFrame, ks: list[int], keys: list[str]) -> DataFrame:
    both = pairs.select(*keys, "i", "j", "score").union(pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "score"))
    degree = both.groupBy(*keys, F.col("i").alias("node")).agg(F.sum("score").alias("d"))
    root = F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(F.lit(1.0))
    nodes = stored_table(degree.select(*keys, "node", root.alias("root")), "nodes")
    end = lambda c: nodes.select(*keys, F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    scaled = both.where("score <> 0").join(end("i"), [*keys, "i"]).join(end("j"), [*keys, "j"])
    edges = stored_table(scaled.select(*keys, "i", "j", (F.col("score") * F.col("root_i") * F.col("root_j")).alias("w")), "edges")
    most = max(ks)

    def multiply(vectors: DataFrame, columns: list[str]) -> DataFrame:
        """The normalised affinity and the identity: its eigenvalues are not negative, in the same order."""
        image = product(edges, vectors, columns, keys)
        same = vectors.select(*keys, "node", *[F.col(c).alias(f"own_{c}") for c in columns])
        return image.join(same, [*keys, "node"]).select(*keys, "node", *[(F.col(c) + F.col(f"own_{c}")).alias(c) for c in columns])

    # one vector decides nothing: k = 1 is one class
    vectors = leading_vectors(nodes.select(*keys, "node"), multiply, most, keys) if most > 1 else nodes.select(*keys, "node", F.lit(1.0).alias("x0"))
    columns = [f"x{c}" for c in range(most)]
    sizes = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    each = vectors.select(*keys, "node", *columns).join(sizes, keys).withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(ks)])))
    used = {c: F.when(F.col("k") > r, F.col(c)).otherwise(F.lit(0.0)) for r, c in enumerate(columns)}
    each = each.select(*keys, "k", "node", "n", *[v.alias(c) for c, v in used.items()])
    norm = F.greatest(F.sqrt(reduce(lambda a, b: a + b, [F.col(c) ** 2 for c in columns])), F.lit(1e-12))
    unit = each.select(*keys, "k", "node", "n", *[(F.col(c) / norm).alias(c) for c in columns])
    alone = unit.where((F.col("k") > 1) & (F.col("n") <= F.col("k"))).select(*keys, "k", "node", F.row_number().over(Window.partitionBy(*keys, "k").orderBy("node")).alias("cls"))
    one = unit.where("k = 1").select(*keys, "k", "node", F.lit(0).alias("cls"))
    many = unit.where((F.col("k") > 1) & (F.col("n") > F.col("k"))).drop("n")
    labels = one.union(alone)
    if most > 1:
        clustered = kmeans(many.withColumn("_k", F.col("k")), columns, [*keys, "k"], "_k")
        labels = labels.union(clustered.select(*keys, "k", "node", "cls"))
    return named_by_first(labels, [*keys, "k"]).select(*keys, "k", F.col("node").alias("series"), "cls")


def skew_ranking(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., series, rank, lag): spectral ranking and synchronisation of lag matrices (keys..., i, j, lag), i < j.

    With D the row sums of |H|, the plane of the two leading singular vectors of D^1/2 H D^1/2 is that of the two leading
    eigenvectors of minus its square. In it, the direction across the image of the ones vector orders the series; the sign is
    the one with fewer upsets (pairs ordered otherwise than their lag says), the scale the median of lag over difference (if
    that is 0, the ratio of their sums). Ranks are centred; a matrix of zeros gives zeros."""
    return under_own_names(_skew_ranking, pairs, keys)


def _skew_ranking(pairs: DataFrame, keys: list[str]) -> DataFrame:
    both = pairs.select(*keys, "i", "j", F.col("lag").cast("double").alias("h")).union(pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("lag")).cast("double").alias("h")))
    both = stored_table(both, "lags")
    nodes = stored_table(both.groupBy(*keys, F.col("i").alias("node")).agg(F.sqrt(F.sum(F.abs("h"))).alias("d")), "nodes")
    end = lambda c: nodes.select(*keys, F.col("node").alias(c), F.col("d").alias(f"d_{c}"))
    edges = both.where("h <> 0").join(end("i"), [*keys, "i"]).join(end("j"), [*keys, "j"])
    edges = stored_table(edges.select(*keys, "i", "j", (F.col("h") * F.col("d_i") * F.col("d_j")).alias("w")), "edges")

    def multiply(vectors: DataFrame, columns: list[str]) -> DataFrame:
        twice = product(edges, stored_table(product(edges, vectors, columns, keys), "half"), columns, keys)
        return twice.select(*keys, "node", *[(-F.col(c)).alias(c) for c in columns])

    plane = leading_vectors(nodes.select(*keys, "node"), multiply, 2, keys).join(nodes, [*keys, "node"])
    ones = plane.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(c) * F.col("d")), F.sqrt(F.sum(F.col("d") ** 2))).alias(f"o{c}") for c in ("x0", "x1")])
    pi = plane.join(ones, keys).select(*keys, "node", (F.col("d") * (F.col("x1") * F.col("ox0") - F.col("x0") * F.col("ox1"))).alias("pi"))
    pi = stored_table(pi, "ranks")
    side = lambda c: pi.select(*keys, F.col("node").alias(c), F.col("pi").alias(f"pi_{c}"))
    met = both.join(side("i"), [*keys, "i"]).join(side("j"), [*keys, "j"]).withColumn("s", F.col("pi_i") - F.col("pi_j"))
    met = stored_table(met.select(*keys, "i", "j", "h", "s"), "differences")
    upset = lambda s: F.sum(F.abs(F.signum(s) - F.signum("h")))
    signs = met.groupBy(*keys).agg(F.when(upset(-F.col("s")) < upset(F.col("s")), -1.0).otherwise(1.0).alias("sign"), F.sum(F.abs("h")).alias("h_sum"), F.sum(F.abs("s")).alias("s_sum"))
    # pairs without a lag are zeros of the matrix: a ratio of 0 each
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    absent = met.groupBy(*keys).agg(F.count("*").alias("held")).join(n, keys).where(F.col("n") * (F.col("n") - 1) > F.col("held"))
    zeros = absent.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") * (F.col("n") - 1) - F.col("held")))).select(*keys, F.lit(0.0).alias("ratio"))
    ratios = met.join(signs, keys).select(*keys, (F.col("h") / (F.col("s") * F.col("sign") + 1e-9)).alias("ratio"))
    median = exact_quantiles(ratios.union(zeros), F.col("ratio"), [0.5], *keys).select(*keys, F.get("q", F.lit(0)).alias("median"))
    scale = F.when(F.col("median") == 0, F.coalesce(F.try_divide("h_sum", "s_sum"), F.lit(0.0))).otherwise(F.col("median"))
    scaled = pi.join(signs, keys).join(median, keys).select(*keys, "node", F.when(F.col("h_sum") > 0, F.col("pi") * F.col("sign") * scale).otherwise(F.lit(0.0)).alias("r"))
    centre = scaled.groupBy(*keys).agg(F.avg("r").alias("mean"), F.min("r").alias("least"))
    lag: Column = F.rint(F.col("r") - F.col("least")).cast("int")
    return scaled.join(centre, keys).select(*keys, F.col("node").alias("series"), (F.col("r") - F.col("mean")).alias("rank"), lag.alias("lag"))
