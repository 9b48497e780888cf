"""What the clusters look like: mean and medoid profiles, density, projection, automatic names."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.functions.intervals import is_finite
from fleetspectra.operators.cluster import Medoids
from fleetspectra.operators.distance import Fleet
from fleetspectra.operators.grid import Axis, GridSpec
from fleetspectra.sources.tables import materialize


def cluster_profile(labelled: DataFrame, grid: GridSpec | Axis) -> DataFrame:
    """Mean probability per bin: ``cluster, bin, bin_center, mean_p`` from ``cluster, probs``."""
    return (
        labelled.select("cluster", F.posexplode("probs").alias("bin", "p"))
        .groupBy("cluster", "bin")
        .agg(F.avg("p").alias("mean_p"))
        .select("cluster", "bin", grid.center_of("bin").alias("bin_center"), "mean_p")
    )


def medoid_profile(dists: DataFrame, vins: Sequence[str], grid: GridSpec | Axis) -> DataFrame:
    """The spectra of the medoids: ``cluster, vin, bin, bin_center, p``."""
    order = F.array(*[F.lit(v) for v in vins])
    return (
        dists.where(F.col("vin").isin(list(vins)))
        .select(
            (F.array_position(order, F.col("vin")) - 1).cast("int").alias("cluster"),
            "vin",
            F.posexplode("probs").alias("bin", "p"),
        )
        .select("cluster", "vin", "bin", grid.center_of("bin").alias("bin_center"), "p")
    )


def cluster_density(labelled: DataFrame, binned: DataFrame, grid: GridSpec | Axis) -> DataFrame:
    """Density of a signal per cluster, weighted by mass: ``cluster, bin, bin_center, density,
    cumulative``.

    ``labelled`` gives ``vin, cluster``; ``binned`` gives ``vin, bin, mass``.
    """
    per_bin = (
        binned.join(labelled.select("vin", "cluster"), "vin")
        .groupBy("cluster", "bin")
        .agg(F.sum("mass").alias("mass"))
    )
    whole = W.partitionBy("cluster")
    running = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("mass").over(whole)
    return per_bin.select(
        "cluster",
        "bin",
        grid.center_of("bin").alias("bin_center"),
        (F.col("mass") / total / F.lit(grid.step)).alias("density"),
        (F.sum("mass").over(running) / total).alias("cumulative"),
    )


def density_quantiles(density: DataFrame, shares: Sequence[float]) -> DataFrame:
    """First bin center at which each cluster's cumulative share reaches the stated shares."""
    return density.groupBy("cluster").agg(
        *[
            F.min(F.when(F.col("cumulative") >= s - 1e-12, F.col("bin_center"))).alias(
                f"q{round(100 * s)}"
            )
            for s in shares
        ]
    )


# Size of a quantile sketch; its rank error is about 1.7 per cent with 99 per cent confidence.
SKETCH_K = 200


def signal_sketches(samples: DataFrame, labelled: DataFrame, signal: str = "signal") -> DataFrame:
    """A quantile sketch of raw samples per cluster: ``cluster, sketch``.

    ``samples`` gives ``vin`` and the signal, ``labelled`` gives ``vin, cluster``. Nulls and NaN are left out.
    Sketches are bounded in size whatever the number of samples, and made per task before they are shuffled.
    """
    rows = samples.where(is_finite(signal)).join(labelled.select("vin", "cluster"), "vin")
    return rows.groupBy("cluster").agg(
        F.kll_sketch_agg_double(F.col(signal).cast("double"), F.lit(SKETCH_K)).alias("sketch")
    )


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of one cluster, of batches or parts, as one: ``cluster, sketch``."""
    return sketches.groupBy("cluster").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``cluster, n_samples`` and a column ``q25``, ... per share."""
    return sketches.select(
        "cluster",
        F.kll_sketch_get_n_double("sketch").alias("n_samples"),
        *[
            F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias(f"q{round(100 * s)}")
            for s in shares
        ],
    )


def mean_centers(labelled: DataFrame, grid: GridSpec | Axis) -> DataFrame:
    """Mean of the signal per cluster, and its rank from low to high."""
    mean = F.aggregate(
        F.zip_with("probs", grid.centers_column(), lambda p, c: p * c),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    per_cluster = labelled.groupBy("cluster").agg(F.avg(mean).alias("mean_center"))
    # One row per cluster, a handful in all.
    order = W.orderBy(F.round("mean_center", 9), "cluster")
    return per_cluster.withColumn("rank", F.row_number().over(order) - 1)


# Names from the lowest to the highest mean signal.
NAMES_BY_RANK = {
    "velocity": ("Low", "Medium", "High"),
    "weight": ("Low", "High"),
    "gradient": ("Flat", "Hilly"),
}


def auto_labels(labelled: DataFrame, grid: GridSpec | Axis, names: Sequence[str]) -> DataFrame:
    """Name clusters by their mean signal: ``cluster, mean_center, rank, label``.

    Names are spread over the ranks, the first for the lowest and the last for the highest mean, so
    that several clusters share a name when there are more of them than names.
    """
    ranked = mean_centers(labelled, grid)
    n = F.count("*").over(W.partitionBy())
    share = F.try_divide(F.col("rank") * F.lit(len(names) - 1), n - 1)
    place = F.floor(F.coalesce(share, F.lit(0.0)) + 0.5).cast("int")
    return ranked.withColumn("label", F.get(F.array(*[F.lit(n) for n in names]), place))


def label_names(auto: DataFrame) -> dict[int, str]:
    """The automatic map as a dictionary for ``apply_labels``."""
    return {r["cluster"]: r["label"] for r in auto.collect()}


# Distributions of more bins are projected without a matrix of bins by bins on the driver.
DENSE_BINS = 1024
# Directions carried beside the wanted ones, and the rounds after which an unsettled projection is an error.
SPARE = 8
PCA_ROUNDS = 60
_SETTLED = 1e-11


def pca_sparse(cells: DataFrame, n: int = 2) -> tuple[DataFrame, list[float]]:
    """The same as ``pca_coordinates`` from rows ``vin, place, p``, on any number of places.

    Subspace iteration with ``n + SPARE`` directions: a round multiplies the centered shares with the
    directions and their transpose with the outcome, two joins with sums that combine before the shuffle.
    The driver holds sums of directions by directions, never a place or a vehicle. Directions start from a
    hash of their place, so reruns agree. Raises if the variances along the wanted directions still move.
    """
    r = n + SPARE
    q, z = [f"q{j}" for j in range(r)], [f"z{j}" for j in range(r)]
    cells = materialize(
        cells.select("vin", "place", F.col("p").cast("double").alias("p")).where("p != 0"), "pca-cells"
    )
    size = cells.agg(F.count_distinct("vin").alias("n"), F.sum(F.col("p") * F.col("p")).alias("s")).first()
    if not size["n"]:
        raise ValueError("no vehicles to project")
    means = cells.groupBy("place").agg((F.sum("p") / size["n"]).alias("m"))
    spread = (F.lit(1.0) / F.lit(float(2**63))).cast("double")
    basis = materialize(
        means.select("place", "m", *[(F.xxhash64("place", F.lit(j)) * spread).alias(c) for j, c in enumerate(q)]),
        "pca-basis",
    )

    def products(rows: DataFrame, names: Sequence[str]) -> np.ndarray:
        pairs = [(i, j) for i in range(r) for j in range(i, r)]
        found = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_{i}_{j}") for i, j in pairs]).first()
        out = np.zeros((r, r))
        for i, j in pairs:
            out[i, j] = out[j, i] = found[f"_{i}_{j}"]
        return out

    def turned(names: Sequence[str], matrix: np.ndarray, to: Sequence[str]) -> list[Column]:
        return [
            sum((F.col(c) * F.lit(float(matrix[i, j])) for i, c in enumerate(names)), F.lit(0.0)).alias(t)
            for j, t in enumerate(to)
        ]

    def scores(basis: DataFrame) -> DataFrame:
        shift = basis.agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in q]).first()
        sums = cells.join(basis, "place").groupBy("vin")
        return sums.agg(*[(F.sum(F.col("p") * F.col(a)) - F.lit(shift[a])).alias(b) for a, b in zip(q, z)])

    before = None
    for _ in range(PCA_ROUNDS):
        # The scores add up to zero, so means drop out of the way back.
        back = cells.join(scores(basis), "vin").groupBy("place")
        rows = back.agg(*[F.sum(F.col("p") * F.col(c)).alias(c) for c in z]).join(means, "place")
        rows = materialize(rows, "pca-round")
        values, vectors = np.linalg.eigh(products(rows, z))
        values, vectors = values[::-1], vectors[:, ::-1]
        # Directions without variance are kept as zeros.
        real = values > max(values[0], 0.0) * 1e-24
        unit = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
        basis = materialize(rows.select("place", "m", *turned(z, unit, q)), "pca-basis")
        now = np.sqrt(np.maximum(values[:n], 0.0))
        if before is not None and np.all(np.abs(now - before) <= _SETTLED * max(now[0], 1e-300)):
            break
        before = now
    else:
        raise RuntimeError(f"the projection still moves after {PCA_ROUNDS} rounds")
    last = materialize(scores(basis), "pca-scores")
    values, vectors = np.linalg.eigh(products(last, z))
    lead = vectors[:, ::-1][:, :n]
    names = [f"pc{i + 1}" for i in range(n)]
    loadings = basis.select(*turned(q, lead, names))
    ends = loadings.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("a", F.max), ("b", F.min))]).first()
    signs = [1.0 if abs(ends[f"a_{c}"]) >= abs(ends[f"b_{c}"]) else -1.0 for c in names]
    squares = means.agg(F.sum(F.col("m") * F.col("m"))).first()[0]
    total = size["s"] - size["n"] * squares
    shares = [float(v / total) if total > 0 else 0.0 for v in values[::-1][:n]]
    return last.select("vin", *turned(z, lead * np.array(signs), names)), shares


def pca_coordinates(dists: DataFrame, n: int = 2) -> tuple[DataFrame, list[float]]:
    """Centered principal coordinates ``vin, pc1 ... pcn`` and the share of variance of each.

    The sign is fixed so that the loading of largest magnitude is positive. Beyond ``DENSE_BINS`` bins
    ``pca_sparse`` finds the same.
    """
    bins = dists.select(F.size("probs").alias("b")).first()
    if bins is not None and bins["b"] > DENSE_BINS:
        return pca_sparse(dists.select("vin", F.posexplode("probs").alias("place", "p")), n)
    vectors = dists.select("vin", array_to_vector("probs").alias("v"))
    scaler = StandardScaler(inputCol="v", outputCol="centered", withMean=True, withStd=False)
    centered = scaler.fit(vectors).transform(vectors)
    model = PCA(k=n, inputCol="centered", outputCol="pc").fit(centered)
    loadings = model.pc.toArray()
    signs = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in loadings.T]
    scores = model.transform(centered).select("vin", vector_to_array("pc").alias("pc"))
    coordinates = scores.select(
        "vin",
        *[(F.get("pc", F.lit(i)) * F.lit(signs[i])).alias(f"pc{i + 1}") for i in range(n)],
    )
    return coordinates, [float(v) for v in model.explainedVariance.toArray()]


def pca_by_k(
    coordinates: DataFrame, fleet: Fleet, outcomes: dict[int, Medoids]
) -> DataFrame:
    """Scatter data ``k, vin, pc1, pc2, cluster`` for every k of a sweep, by one join."""
    labels = F.array(
        *[
            F.struct(F.lit(k).alias("k"), m.label().alias("cluster"))
            for k, m in outcomes.items()
        ]
    )
    rows = fleet.frame.select("vin", labels.alias("labels")).join(coordinates, "vin")
    return rows.select("vin", "pc1", "pc2", F.inline("labels")).select(
        "k", "vin", "pc1", "pc2", "cluster"
    )
