"""The three flows: cluster one signal, combine the signals, report KPIs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.functions.arrays import differences, double_array
from fleetspectra.operators.cluster import Medoids, best_k, kmedoids, k_sweep
from fleetspectra.operators.distance import Fleet, write_fleet
from fleetspectra.operators.fleet import SIGNALS, apply_labels, join_subpopulations
from fleetspectra.operators.grid import GRADIENT_GRID, WEIGHT_GRID, WIDE_GRID, Axis, GridSpec
from fleetspectra.operators.profile import NAMES_BY_RANK, auto_labels, label_names
from fleetspectra.operators.spectra import remove_outliers, to_distributions, with_centers
from fleetspectra.sources.tables import materialize

# Three velocity and two gradient clusters; weight takes the best silhouette.
CLUSTER_COUNTS = {"velocity": 3, "weight": None, "gradient": 2}


@dataclass(frozen=True)
class ClusteredSignal:
    signal: str
    grid: GridSpec | Axis
    dists: DataFrame
    fleet: Fleet
    medoids: Medoids
    scores: DataFrame | None

    @property
    def clusters(self) -> DataFrame:
        """``vin, sales_group, cluster_wasserstein``."""
        return self.medoids.labels(self.fleet).withColumnRenamed("cluster", "cluster_wasserstein")

    def labelled(self) -> DataFrame:
        """``vin, sales_group, probs, cluster``, from the written fleet."""
        cdf = F.col("point")
        if isinstance(self.grid, Axis):
            cdf = F.zip_with(cdf, double_array(self.grid.widths), lambda x, w: x / w)
        return self.fleet.frame.select(
            "vin",
            "sales_group",
            differences(cdf).alias("probs"),
            self.medoids.label().alias("cluster"),
        )


def signal_grid(cleaned: DataFrame, signal: str) -> GridSpec | Axis:
    """The fixed grid of weight and gradient, or the velocity grid reaching the fleet's maximum.

    Of a velocity grid beyond ``WIDE_GRID`` bins only the occupied ones are kept, as an axis.
    """
    if signal == "weight":
        return WEIGHT_GRID
    if signal == "gradient":
        return GRADIENT_GRID
    centers = with_centers(cleaned)
    grid = GridSpec.from_data(centers, 0.5, 1.0)
    return grid if grid.n <= WIDE_GRID else Axis.from_data(centers, grid)


def grid_fleet(dists: DataFrame, grid: GridSpec | Axis) -> Fleet:
    """Write distributions on a grid, or on an axis with each share weighted by the width it holds for."""
    if not isinstance(grid, Axis):
        return write_fleet(dists)
    wide = F.zip_with("cdf", double_array(grid.widths), lambda x, w: x * w)
    return write_fleet(dists.withColumn("cdf", wide), grid.widths)


def signal_distributions(
    spectra: DataFrame, outliers: DataFrame, signal: str
) -> tuple[DataFrame, GridSpec | Axis]:
    cleaned = remove_outliers(spectra, outliers)
    if signal == "velocity":
        # Read for the grid, its axis and the distributions, but made once.
        cleaned = materialize(cleaned, "cleaned")
    grid = signal_grid(cleaned, signal)
    return to_distributions(cleaned, grid), grid


def cluster_signal(
    spectra: DataFrame,
    outliers: DataFrame,
    signal: str,
    k: int | None | str = "default",
) -> ClusteredSignal:
    """Cluster one signal. ``k=None`` sweeps 2 to 6 and takes the best silhouette."""
    if k == "default":
        k = CLUSTER_COUNTS[signal]
    dists, grid = signal_distributions(spectra, outliers, signal)
    fleet = grid_fleet(dists, grid)
    if k is None:
        outcomes, scores = k_sweep(fleet)
        return ClusteredSignal(
            signal, grid, dists, fleet, outcomes[best_k(scores).first()["k"]], scores
        )
    return ClusteredSignal(signal, grid, dists, fleet, kmedoids(fleet, k), None)


def label_signal(clustered: ClusteredSignal, names: dict[int, str] | None = None) -> DataFrame:
    """Clusters with text: by stated names, or named by rank of their mean."""
    if names is None:
        names = label_names(
            auto_labels(clustered.labelled(), clustered.grid, NAMES_BY_RANK[clustered.signal])
        )
    return apply_labels(clustered.clusters, clustered.signal, names)


def combine(labelled: dict[str, DataFrame], stats: DataFrame | None = None) -> DataFrame:
    """Sub-population table of the three labelled signals."""
    return join_subpopulations(*[labelled[s] for s in SIGNALS], stats)


def joint_distributions(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Several signals as one vector: ``vin, sales_group, cdf`` and constant ``scales``.

    Each part is a distribution frame and the weight of its distance; the distance of two joint vectors
    is the weighted sum of their distances per signal. Vehicles missing from a part are left out.
    """
    out = None
    for name, (dists, weight) in parts.items():
        scaled = F.transform("cdf", lambda v: v * F.lit(float(weight)))
        side = dists.select("vin", "sales_group", scaled.alias(name))
        out = side if out is None else out.join(side, ["vin", "sales_group"])
    return out.select("vin", "sales_group", F.concat(*parts).alias("cdf"))
