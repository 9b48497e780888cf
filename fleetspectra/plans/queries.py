"""The registered queries: ``name -> callable(spark, folder)``, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspectra.functions.arrays import double_array, w1_probs, w1_sparse
from fleetspectra.functions.intervals import interval_text
from fleetspectra.operators import cluster, distance, fleet, nearest, profile, spectra
from fleetspectra.operators.grid import (
    GRADIENT_GRID,
    WEIGHT_GRID,
    GridSpec,
    center_bounds,
    grid_table,
)
from fleetspectra.plans import flows
from fleetspectra.sources import tables, usage
from fleetspectra.streaming.spectrum import spectrum_of_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SIGNALS = fleet.SIGNALS
GROUPS = tuple(range(1, 16))
SELECTED_GROUPS = (5, 8, 1)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def raw(spark, folder, signal="weight"):
    return usage.spectra(spark, folder, signal)


def cleaned(spark, folder, signal="weight"):
    return spectra.remove_outliers(raw(spark, folder, signal), usage.outliers(spark, folder))


def distributions(spark, folder, signal="weight") -> tuple[DataFrame, GridSpec]:
    return flows.signal_distributions(
        raw(spark, folder, signal), usage.outliers(spark, folder), signal
    )


def written(spark, folder, signal="weight") -> distance.Fleet:
    return distance.write_fleet(distributions(spark, folder, signal)[0])


# Clusters per signal in the reports: three by two by two sub-populations.
REPORT_K = {"velocity": 3, "weight": 2, "gradient": 2}


def _report(spark, folder) -> str:
    """Where the reports on a folder keep what they share; other files in the folder give another place."""
    sources = [f"{folder}/{t}.parquet" for t in ("lineitem", "orders", "customer")]
    return f"{tables.shared_folder(spark)}/report-{tables.fingerprint(spark, *sources)}"


def report_usage(spark, folder) -> DataFrame:
    """Usage rows of all vehicles, joined once for the three signals and the statistics."""
    return tables.kept(spark, f"{_report(spark, folder)}/usage", lambda: usage.usage(spark, folder))


def report_spectra(spark, folder, signal) -> DataFrame:
    """Cleaned spectra from the shared usage rows."""
    rows = usage.spectra_of(report_usage(spark, folder), signal)
    return spectra.remove_outliers(rows, usage.outliers(spark, folder))


def clusters(spark, folder, signal) -> DataFrame:
    """``vin, sales_group, probs, cluster_wasserstein`` by k-medoids.

    Reports share one clustering as long as the tables' files stay the same.
    """
    where = f"{_report(spark, folder)}/clusters-{signal}"
    if not tables.exists(spark, f"{where}/_SUCCESS"):
        rows = usage.spectra_of(report_usage(spark, folder), signal)
        found = flows.cluster_signal(rows, usage.outliers(spark, folder), signal, REPORT_K[signal])
        with found.fleet:
            named = found.labelled().withColumnRenamed("cluster", "cluster_wasserstein")
            named.write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def codes(spark, folder, signal="velocity") -> DataFrame:
    return clusters(spark, folder, signal).select("vin", "sales_group", "cluster_wasserstein")


def labelled_codes(spark, folder) -> dict[str, DataFrame]:
    """Labels of the three signals, whose clusterings run side by side: each alone leaves cores idle."""
    report_usage(spark, folder)
    with ThreadPoolExecutor(len(SIGNALS)) as pool:
        list(pool.map(lambda s: clusters(spark, folder, s), SIGNALS))
    return {s: fleet.apply_labels(codes(spark, folder, s), s) for s in SIGNALS}


def subpopulation(spark, folder) -> DataFrame:
    return flows.combine(labelled_codes(spark, folder), usage.stats_of(report_usage(spark, folder)))


# Cleaning and checks


@query
def stage_counts(spark, folder):
    """Vehicles in the raw spectra, the outlier list and the cleaned spectra."""
    data = raw(spark, folder, "velocity")
    bad = usage.outliers(spark, folder)
    return spectra.stage_counts(
        {"raw": data, "outliers": bad, "cleaned": spectra.remove_outliers(data, bad)}
    )


@query
def fleet_audit(spark, folder):
    """Counts, zero rows, dropped mass and group conflicts of a run, from one pass over each table."""
    data = spectra.audit(
        raw(spark, folder, "weight"), usage.outliers(spark, folder), WEIGHT_GRID
    )
    return rounded(data, 6, "dropped_share")


@query
def outlier_anti_join(spark, folder):
    return cleaned(spark, folder, "velocity")


@query
def sales_group_unique_check(spark, folder):
    """Suppliers seen as vehicles, each serving customers of several sales groups."""
    lines = usage.table(spark, folder, "lineitem")
    orders = usage.table(spark, folder, "orders")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        usage.vin_of("S", "l_suppkey").alias("vin"),
        (F.col("o_custkey") % 15 + 1).cast("int").alias("sales_group"),
    )
    return spectra.group_conflicts(rows)


@query
def zero_mass_vehicles(spark, folder):
    """Orders seen as vehicles, many of which have no item on the weight grid."""
    return spectra.zero_mass(usage.spectra(spark, folder, "weight", "O"), WEIGHT_GRID)


@query
def dropped_mass(spark, folder):
    out = None
    for signal, grid in (("weight", WEIGHT_GRID), ("gradient", GRADIENT_GRID)):
        row = spectra.dropped_mass(raw(spark, folder, signal), grid).select(
            F.lit(signal).alias("signal"), "total", "kept", "dropped_share"
        )
        out = row if out is None else out.unionByName(row)
    return rounded(out, 6, "dropped_share")


# Grids and distributions


@query
def interval_centers(spark, folder):
    return spectra.with_centers(raw(spark, folder, "weight"))


@query
def center_bounds_by_signal(spark, folder):
    out = None
    for signal in SIGNALS:
        centers = spectra.with_centers(cleaned(spark, folder, signal))
        row = center_bounds(centers).select(F.lit(signal).alias("signal"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _occupied(spark, folder, signal):
    """Every bin of the grid with the fleet's mass in it."""
    data = cleaned(spark, folder, signal)
    grid = flows.signal_grid(data, signal)
    mass = spectra.binned(data, grid).groupBy("bin").agg(F.sum("mass").alias("mass"))
    joined = grid_table(spark, grid).join(mass, "bin", "left")
    return joined.select("bin", "bin_center", F.coalesce("mass", F.lit(0.0)).alias("mass"))


@query
def grid_velocity(spark, folder):
    return _occupied(spark, folder, "velocity")


@query
def grid_weight(spark, folder):
    return _occupied(spark, folder, "weight")


@query
def grid_gradient(spark, folder):
    return _occupied(spark, folder, "gradient")


@query
def spectra_probs_long(spark, folder):
    rows = spectra.long_form(*distributions(spark, folder, "velocity"))
    return rounded(rows.select("vin", "bin_center", "p"), 6, "p")


@query
def spectra_cdf_long(spark, folder):
    rows = spectra.long_form(*distributions(spark, folder, "weight"))
    return rounded(rows.select("vin", "bin_center", "cdf"), 6, "cdf")


@query
def spectra_running_share(spark, folder):
    """Window form over occupied bins, with the gap to the next one."""
    rows = spectra.cdf_by_window(cleaned(spark, folder, "gradient"), GRADIENT_GRID)
    return rounded(rows, 6, "p", "cdf")


@query
def spectra_pivot_wide(spark, folder):
    return spectra.pivot_wide(cleaned(spark, folder, "gradient"), GRADIENT_GRID)


# Distances


def _stated(dists: DataFrame) -> DataFrame:
    """Every twentieth vehicle."""
    return dists.where(F.substring("vin", 2, 20).cast("bigint") % 20 == 0).select("vin")


def _vehicles(spark, folder) -> DataFrame:
    return tables.materialize(distributions(spark, folder, "weight")[0], "vehicles")


def _stated_rows(dists, nearest=None, digits=None) -> DataFrame:
    """Every twentieth vehicle against the whole fleet."""
    return distance.matrix_rows(dists, _stated(dists), WEIGHT_GRID.step, nearest=nearest, digits=digits)


@query
def w1_pairs(spark, folder):
    """Rows of the distance matrix of stated vehicles."""
    return _stated_rows(_vehicles(spark, folder), digits=4)


@query
def w1_pairs_sparse(spark, folder):
    """The same over prices by the cent: each vehicle's own intervals, on a line of millions of bins."""
    cents = usage.usage(spark, folder).select(
        "vin",
        "sales_group",
        interval_text(F.round(F.col("l_extendedprice") * 100).cast("bigint"), 1).alias("x1_interval"),
        F.lit(1.0).alias("count"),
    )
    own = spectra.remove_outliers(cents, usage.outliers(spark, folder))
    cells = tables.materialize(spectra.sparse_distributions(own), "sparse")
    # Many distances lie exactly between two rounded values; the nudge settles them all upwards.
    return distance.matrix_rows(
        cells, _stated(cells), 1.0, lambda a, b, _: w1_sparse(a, b), value="cells", sparse=True, digits=2, nudge=1e-7
    )


@query
def w1_nearest(spark, folder):
    rows = _stated_rows(_vehicles(spark, folder), nearest=5)
    return rounded(distance.nearest_vehicles(rows, 5), 4, "distance")


@query
def w1_diagnostics(spark, folder):
    dists = _vehicles(spark, folder)
    between = _stated_rows(dists.join(_stated(dists), "vin", "left_semi"))
    out = distance.matrix_diagnostics(_stated_rows(dists), between)
    return rounded(out, 4, "max_diagonal", "min_distance", "max_distance")


@query
def nearest_all(spark, folder):
    """The five nearest others of every vehicle."""
    with written(spark, folder, "weight") as data:
        rows = tables.materialize(nearest.nearest_neighbours(data, 5), "nearest")
    scaled = F.col("distance") * WEIGHT_GRID.step
    return rounded(rows.withColumn("distance", scaled), 4, "distance")


@query
def w1_leading_matrix(spark, folder):
    dists, _ = distributions(spark, folder, "weight")
    return rounded(distance.leading_matrix(dists, WEIGHT_GRID.step), 4, "distance")


@query
def w1_to_reference(spark, folder):
    """Distance of every vehicle to the fleet's mean distribution and to an even one."""
    dists, grid = distributions(spark, folder, "weight")
    rows = dists.select(F.posexplode("cdf").alias("bin", "x")).groupBy("bin").agg(F.avg("x"))
    mean = [r[1] for r in rows.orderBy("bin").collect()]
    refs = {"mean": mean, "even": [(i + 1) / grid.n for i in range(grid.n)]}
    return rounded(distance.distance_to(dists, refs, grid.step), 4, "distance")


@query
def w1_from_probabilities(spark, folder):
    """Distance of every vehicle to an even distribution, from probabilities and bin centers."""
    dists, grid = distributions(spark, folder, "gradient")
    even = double_array([1 / grid.n] * grid.n)
    d = w1_probs(F.col("probs"), even, grid.centers)
    return dists.select("vin", F.round(d, 6).alias("distance"))


@query
def fleet_total_distance(spark, folder):
    totals = distance.fleet_totals(written(spark, folder, "weight"))
    return totals.select("vin", F.round(F.col("total") * WEIGHT_GRID.step, 2).alias("total"))


@query
def fleet_total_distance_sliced(spark, folder):
    """The same over hundreds of slices."""
    dists, _ = distributions(spark, folder, "weight")
    totals = distance.fleet_totals(distance.write_fleet(dists, slice_rows=500))
    return totals.select("vin", F.round(F.col("total") * WEIGHT_GRID.step, 2).alias("total"))


@query
def central_vehicles(spark, folder):
    top = cluster.central_vehicles(written(spark, folder, "weight"), 10)
    rows = spark.createDataFrame(top, "vin string, mean_distance double")
    return rounded(rows, 6, "mean_distance")


# Clustering


@query
def kmedoids_k2(spark, folder):
    data = written(spark, folder, "gradient")
    return cluster.kmedoids(data, 2).labels(data)


@query
def kmedoids_k3(spark, folder):
    data = written(spark, folder, "weight")
    return cluster.kmedoids(data, 3).labels(data)


# Reach of the smoothing that makes dense shapes of a few dozen counts.
SMOOTH = 12


def dense_distributions(spark, folder) -> DataFrame:
    """Weight spectra spread over neighbouring bins by falling weights: dense and concentrated."""
    rows = spectra.binned(cleaned(spark, folder, "weight"), WEIGHT_GRID)
    weights = [float(SMOOTH + 1 - abs(o)) for o in range(-SMOOTH, SMOOTH + 1)]
    return spectra.smoothed_distributions(rows, WEIGHT_GRID, weights)


@query
def kmedoids_dense_k3(spark, folder):
    data = distance.write_fleet(dense_distributions(spark, folder))
    return cluster.kmedoids(data, 3).labels(data)


@query
def kmedoids_labels_velocity(spark, folder):
    """The flagship: velocity spectra to ``vin, sales_group, cluster_wasserstein``."""
    found = flows.cluster_signal(
        raw(spark, folder, "velocity"), usage.outliers(spark, folder), "velocity"
    )
    return found.clusters


STRAY = 1_000_000_000


def stray_spectra(spark, folder) -> DataFrame:
    """Velocity spectra in which one vehicle has an interval far out."""
    data = tables.materialize(raw(spark, folder, "velocity"), "spectra")
    first = data.join(usage.outliers(spark, folder), "vin", "left_anti").agg(F.min("vin").alias("vin"))
    far = data.join(first, "vin").groupBy("vin", "sales_group").agg(F.lit(1.0).alias("count"))
    text = interval_text(F.lit(STRAY), 1)
    return data.unionByName(far.withColumn("x1_interval", text))


@query
def kmedoids_velocity_stray(spark, folder):
    """Velocity clusters of a fleet whose grid would have a thousand million bins."""
    found = flows.cluster_signal(
        stray_spectra(spark, folder), usage.outliers(spark, folder), "velocity"
    )
    return found.clusters


@query
def medoid_profile(spark, folder):
    dists, grid = distributions(spark, folder, "weight")
    data = distance.write_fleet(dists)
    medoids = cluster.kmedoids(data, 3)
    return rounded(profile.medoid_profile(dists, medoids.vins, grid), 6, "p")


@query
def silhouette_k3(spark, folder):
    data = written(spark, folder, "weight")
    medoids = cluster.kmedoids(data, 3)
    return rounded(cluster.silhouette(data, medoids.label(), 3), 6, "silhouette")


@query
def silhouette_by_cluster(spark, folder):
    data = written(spark, folder, "weight")
    medoids = cluster.kmedoids(data, 3)
    return rounded(cluster.silhouette(data, medoids.label(), 3, "cluster"), 6, "silhouette")


@query
def silhouette_by_vehicle(spark, folder):
    data = written(spark, folder, "weight")
    medoids = cluster.kmedoids(data, 3)
    return rounded(cluster.silhouette(data, medoids.label(), 3, "vehicle"), 6, "silhouette")


@query
def k_sweep(spark, folder):
    _, scores = cluster.k_sweep(written(spark, folder, "weight"))
    return rounded(scores, 6, "silhouette")


@query
def best_k(spark, folder):
    _, scores = cluster.k_sweep(written(spark, folder, "weight"))
    return rounded(cluster.best_k(scores), 6, "silhouette")


@query
def soft_membership(spark, folder):
    data = written(spark, folder, "gradient")
    return rounded(cluster.soft_membership(data, cluster.kmedoids(data, 2)), 6, "weight")


@query
def multi_signal_k2(spark, folder):
    """Weight and gradient in one clustering, the gradient counting double."""
    weight, _ = distributions(spark, folder, "weight")
    gradient, _ = distributions(spark, folder, "gradient")
    joint = flows.joint_distributions({"weight": (weight, 1.0), "gradient": (gradient, 2.0)})
    scales = [1.0] * WEIGHT_GRID.n + [2.0] * GRADIENT_GRID.n
    data = distance.write_fleet(joint, scales)
    return cluster.kmedoids(data, 2).labels(data)


# Reports on clusters


@query
def cluster_sizes(spark, folder):
    return fleet.cluster_sizes(codes(spark, folder))


@query
def cluster_sales_group_crosstab(spark, folder):
    return fleet.crosstab(codes(spark, folder), GROUPS)


@query
def cluster_share_all(spark, folder):
    return fleet.cluster_share(codes(spark, folder), codes=range(3))


@query
def cluster_share_selected(spark, folder):
    rows = codes(spark, folder, "weight")
    share = fleet.cluster_share(rows, range(2), SELECTED_GROUPS, digits=0)
    return share.orderBy("position", "cluster")


@query
def sales_groups_sorted(spark, folder):
    return fleet.sorted_groups(codes(spark, folder))


@query
def cluster_profile_mean(spark, folder):
    rows = clusters(spark, folder, "weight").withColumnRenamed("cluster_wasserstein", "cluster")
    return rounded(profile.cluster_profile(rows, WEIGHT_GRID), 6, "mean_p")


@query
def cluster_density(spark, folder):
    rows = codes(spark, folder, "weight").withColumnRenamed(
        "cluster_wasserstein", "cluster"
    )
    mass = spectra.binned(report_spectra(spark, folder, "weight"), WEIGHT_GRID)
    out = profile.cluster_density(rows, mass, WEIGHT_GRID)
    return out.select(
        "cluster",
        "bin",
        "bin_center",
        F.round(F.col("density") * 1000, 6).alias("density_per_thousand"),
        F.round("cumulative", 6).alias("cumulative"),
    )


@query
def density_quantiles(spark, folder):
    rows = codes(spark, folder, "gradient").withColumnRenamed(
        "cluster_wasserstein", "cluster"
    )
    mass = spectra.binned(report_spectra(spark, folder, "gradient"), GRADIENT_GRID)
    return profile.density_quantiles(
        profile.cluster_density(rows, mass, GRADIENT_GRID), (0.25, 0.5, 0.75)
    )


@query
def signal_quantiles(spark, folder):
    """Quantiles of raw samples per weight cluster, from sketches that are made apart and merged."""
    samples = usage.raw_samples(usage.table(spark, folder, "events"))
    rows = codes(spark, folder, "weight").withColumnRenamed("cluster_wasserstein", "cluster")
    halves = [samples.where(F.pmod(F.xxhash64("signal"), F.lit(2)) == i) for i in range(2)]
    first, second = (profile.signal_sketches(h, rows) for h in halves)
    return profile.sketch_quantiles(
        profile.merged_sketches(first.unionByName(second)), (0.25, 0.5, 0.75)
    )


@query
def auto_labels(spark, folder):
    rows = clusters(spark, folder, "velocity").withColumnRenamed("cluster_wasserstein", "cluster")
    grid = flows.signal_grid(report_spectra(spark, folder, "velocity"), "velocity")
    names = profile.NAMES_BY_RANK["velocity"]
    return rounded(profile.auto_labels(rows, grid, names), 6, "mean_center")


@query
def auto_labels_k4(spark, folder):
    """Four clusters for two names: the lower half is flat, the upper half hilly."""
    found = flows.cluster_signal(
        raw(spark, folder, "gradient"), usage.outliers(spark, folder), "gradient", 4
    )
    names = profile.NAMES_BY_RANK["gradient"]
    return rounded(profile.auto_labels(found.labelled(), GRADIENT_GRID, names), 6, "mean_center")


@query
def weight_labels_of_best_k(spark, folder):
    """The whole flow of one signal: sweep, best silhouette, names by mean weight."""
    found = flows.cluster_signal(
        raw(spark, folder, "weight"), usage.outliers(spark, folder), "weight", None
    )
    return flows.label_signal(found)


@query
def pca_2d(spark, folder):
    dists, _ = distributions(spark, folder, "velocity")
    coordinates, shares = profile.pca_coordinates(tables.materialize(dists, "dists"))
    return coordinates.select(
        "vin",
        # Adding zero leaves one kind of zero.
        (F.round("pc1", 4) + 0.0).alias("pc1"),
        (F.round("pc2", 4) + 0.0).alias("pc2"),
        F.lit(round(shares[0], 5)).alias("pc1_share"),
        F.lit(round(shares[1], 5)).alias("pc2_share"),
    )


@query
def pca_by_k(spark, folder):
    dists, _ = distributions(spark, folder, "gradient")
    dists = tables.materialize(dists, "dists")
    data = distance.write_fleet(dists)
    coordinates, _ = profile.pca_coordinates(dists)
    rows = profile.pca_by_k(coordinates, data, cluster.kmedoids_sweep(data, range(2, 7)))
    return rows.withColumns({c: F.round(c, 4) + 0.0 for c in ("pc1", "pc2")})


# Sub-populations


@query
def label_map(spark, folder):
    """Every cluster code in use with its texts and vehicle count."""
    out = None
    for signal in SIGNALS:
        sizes = fleet.cluster_sizes(codes(spark, folder, signal)).select(
            F.lit(signal).alias("signal"),
            F.col("cluster_wasserstein").alias("cluster"),
            "n_vehicles",
        )
        out = sizes if out is None else out.unionByName(sizes)
    return fleet.label_map(spark).join(out, ["signal", "cluster"])


@query
def unmapped_codes(spark, folder):
    """Codes left without text by a label map that is too short."""
    rows = fleet.apply_labels(codes(spark, folder), "velocity", {0: "Medium", 1: "High"})
    return fleet.unmapped(rows, "velocity")


def _written_stats(spark, folder) -> str:
    path = f"{tables.shared_folder(spark)}/stats-{uuid.uuid4().hex}"
    tables.save(usage.vehicle_stats(spark, folder), path, partition_by=["sales_group"])
    return path


@query
def stats_union(spark, folder):
    """Fifteen statistics tables, one per sales group, tagged and united by name."""
    pattern = _written_stats(spark, folder) + "/sales_group={}"
    stats = tables.load_numbered(spark, pattern, GROUPS)
    columns = ["vin", "sales_group", "mileage_km", *fleet.KPIS]
    return rounded(stats.select(*columns), 4, *fleet.KPIS)


@query
def stats_of_one_group(spark, folder):
    """A filter above the union reads one of the fifteen tables."""
    pattern = _written_stats(spark, folder) + "/sales_group={}"
    stats = fleet.of_group(tables.load_numbered(spark, pattern, GROUPS), 7)
    return stats.select("vin", "sales_group", "mileage_km")


@query
def subpopulation_join(spark, folder):
    return flows.combine(labelled_codes(spark, folder))


@query
def vehicles_per_sales_group(spark, folder):
    return fleet.vehicles_per_group(flows.combine(labelled_codes(spark, folder)))


@query
def subpopulation_stats(spark, folder):
    return rounded(subpopulation(spark, folder), 4, *fleet.KPIS)


@query
def subpopulation_bucketed(spark, folder):
    """The four tables saved in buckets by vin, and joined where they lie."""
    parts = {**labelled_codes(spark, folder), "stats": usage.stats_of(report_usage(spark, folder))}
    saved = {}
    for name, rows in parts.items():
        table = f"{name}_{uuid.uuid4().hex}"
        saved[name] = tables.save_bucketed(rows, table, f"{tables.shared_folder(spark)}/{table}")
    return rounded(flows.combine(saved, saved["stats"]), 4, *fleet.KPIS)


@query
def subpopulation_saved(spark, folder):
    """Written, overwritten from itself, and read back."""
    path = f"{tables.shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    tables.save(flows.combine(labelled_codes(spark, folder)), path)
    tables.save(fleet.of_group(tables.load(spark, path), 3), path, reads_target=True)
    return tables.load(spark, path)


@query
def subpopulation_preview(spark, folder):
    return tables.preview(flows.combine(labelled_codes(spark, folder)), 10, "vin")


@query
def kpi_crosstab_one_group(spark, folder):
    out = fleet.kpi_crosstab(subpopulation(spark, folder), 1)
    return rounded(out, 4, *fleet.KPIS.values())


@query
def kpi_crosstab_all_groups(spark, folder):
    kpis = {**fleet.KPIS, "mileage_km": "avg_mileage"}
    return rounded(fleet.kpi_crosstab(subpopulation(spark, folder), kpis=kpis), 4, *kpis.values())


@query
def kpi_matrix_vehicles(spark, folder):
    """Vehicles and all four KPIs, a matrix each."""
    table = tables.materialize(fleet.kpi_crosstab(subpopulation(spark, folder)), "kpi")
    out = None
    for metric in ("n_vehicles", *fleet.KPIS.values()):
        matrix = fleet.kpi_matrix(table.withColumn(metric, F.col(metric).cast("double")), metric)
        cells = [c for c in matrix.columns if c not in ("sales_group", "velocity")]
        matrix = rounded(matrix, 4, *cells).withColumn("metric", F.lit(metric))
        out = matrix if out is None else out.unionByName(matrix)
    return out


@query
def kpi_display(spark, folder):
    return fleet.kpi_text(fleet.kpi_crosstab(subpopulation(spark, folder), 1))


@query
def config_fit(spark, folder):
    """Sales groups built for a demand of 0, 1 or 2 against the demand of their vehicles."""
    rows = flows.combine(labelled_codes(spark, folder))
    groups = spark.range(1, len(GROUPS) + 1).select(F.col("id").cast("int").alias("sales_group"))
    expected = groups.withColumn("expected_rank", F.col("sales_group") % 3)
    return fleet.configuration_fit(rows, expected)


# Exploring the fleet


@query
def rebin(spark, folder):
    coarse, grid = spectra.rebin(cleaned(spark, folder, "weight"), WEIGHT_GRID, 4)
    return coarse.select("vin", "sales_group", "x1_interval", "count")


@query
def fleet_sample(spark, folder):
    return spectra.sample_fleet(cleaned(spark, folder, "velocity"), 1, 4)


@query
def region_filter(spark, folder):
    dimension = usage.vehicle_dimension(spark, folder)
    rows = spectra.filter_by_dimension(
        cleaned(spark, folder, "velocity"), dimension, region="EUROPE", customer_segment="BUILDING"
    )
    return rows.groupBy("vin").agg(F.sum("count").alias("total"))


@query
def spectrum_build(spark, folder):
    return spectra.build_spectrum(usage.raw_samples(usage.table(spark, folder, "events")), 10.0)


@query
def spectrum_build_stream(spark, folder):
    return spectrum_of_files(spark, folder, usage.raw_samples, 10.0, "events.parquet")


@query
def spectrum_distributions(spark, folder):
    """Raw samples to spectra to distributions."""
    built = spectra.build_spectrum(usage.raw_samples(usage.table(spark, folder, "events")), 10.0)
    built = tables.materialize(built, "spectrum")
    grid = GridSpec.from_data(spectra.with_centers(built), 5.0, 10.0)
    rows = spectra.long_form(spectra.to_distributions(built, grid), grid)
    return rounded(rows.select("vin", "bin", "p", "cdf"), 6, "p", "cdf")
