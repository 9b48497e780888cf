import numpy as np
import pytest
from brute import distances, kmedoids, silhouettes
from pyspark.sql import functions as F

from fleetspectra.operators import cluster as cl
from fleetspectra.operators import distance as di


def fleet_frame(spark, cdfs):
    rows = [(f"V{i:05d}", i % 3 + 1, [float(v) for v in row]) for i, row in enumerate(cdfs)]
    return spark.createDataFrame(rows, "vin string, sales_group int, cdf array<double>").repartition(5)


def random_cdfs(n, bins, seed, atoms=True):
    rng = np.random.default_rng(seed)
    mass = rng.integers(0, 6, size=(n, bins)) if atoms else rng.random((n, bins))
    mass = mass + (mass.sum(axis=1, keepdims=True) == 0)
    return np.cumsum(mass, axis=1) / mass.sum(axis=1, keepdims=True)


def planted_cdfs():
    """Three triangular shapes around bins 5, 20 and 35 of 38, 20 vehicles each."""
    out = []
    for peak in (5, 20, 35):
        for j in range(20):
            jitter = [1 + (13 * j + 7 * b) % 20 / 20 + j / 100 for b in range(38)]
            mass = [max(0.0, 4 - abs(b - peak)) * jitter[b] for b in range(38)]
            out.append(np.cumsum(mass) / sum(mass))
    return np.array(out)


@pytest.mark.parametrize("slice_rows", [500_000, 37])
def test_totals_match_brute_force(spark, slice_rows):
    cdfs = random_cdfs(120, 9, 1)
    # A third of the fleet are copies of one vehicle.
    cdfs[40:80] = cdfs[40]
    fleet = di.write_fleet(fleet_frame(spark, cdfs), slice_rows=slice_rows)
    frame, n_slices = fleet.sliced
    assert fleet.n == 120 and (n_slices > 1) == (slice_rows == 37)
    if n_slices > 1:
        sizes = frame.select(F.explode("slice").alias("s")).groupBy("s").count().collect()
        assert len(sizes) > 10 and max(r["count"] for r in sizes) < 4 * slice_rows
    got = {r["vin"]: r["total"] for r in di.fleet_totals(fleet).collect()}
    want = distances(cdfs).sum(axis=1)
    assert np.allclose([got[f"V{i:05d}"] for i in range(120)], want, rtol=1e-12, atol=1e-9)
    label = (F.abs(F.hash("vin")) % 3).cast("int")
    codes = {r["vin"]: r["c"] for r in fleet.frame.select("vin", label.alias("c")).collect()}
    by_cluster = di.cluster_totals(fleet, {"c": (label, 3)}).collect()
    d = distances(cdfs)
    own = np.array([codes[f"V{i:05d}"] for i in range(120)])
    for row in by_cluster:
        i = int(row["vin"][1:])
        assert np.allclose(row["c_totals"], [d[i, own == q].sum() for q in range(3)], atol=1e-9)


@pytest.mark.parametrize("slice_rows", [500_000, 60])
@pytest.mark.parametrize("seed", [3, 4])
def test_kmedoids_matches_brute_force(spark, seed, slice_rows):
    cdfs = random_cdfs(150, 8, seed)
    cdfs[30:60] = cdfs[31]
    fleet = di.write_fleet(fleet_frame(spark, cdfs), slice_rows=slice_rows)
    ks = [2, 3, 5]
    got = cl.kmedoids_sweep(fleet, ks)
    for k in ks:
        labels, medoids, n_rounds = kmedoids(distances(cdfs), k)
        assert [int(v[1:]) for v in got[k].vins] == medoids
        rows = {r["vin"]: r["cluster"] for r in got[k].labels(fleet).collect()}
        assert [rows[f"V{i:05d}"] for i in range(150)] == list(labels)
        assert got[k].rounds == n_rounds and got[k].converged


def test_central_vehicles(spark):
    cdfs = random_cdfs(90, 7, 21)
    middle = int(distances(cdfs).sum(axis=1).argmin())
    # Four copies of the most central vehicle, one of them first by vin.
    cdfs[[0, 50, 70]] = cdfs[middle]
    mean = np.round(distances(cdfs).mean(axis=1), 9)
    want = np.lexsort((np.arange(90), mean))[:6]
    fleet = di.write_fleet(fleet_frame(spark, cdfs), slice_rows=50)
    got = cl.central_vehicles(fleet, 6)
    assert [int(v[1:]) for v, _ in got] == list(want)
    assert np.allclose([c for _, c in got], mean[want], atol=2e-9)


def _round_parts(fleet, frame, medoids, points):
    labelled = cl._labelled(frame, medoids, points)
    values = cl._values(fleet, labelled)
    summary = cl._summary(values)
    n = sum(map(len, medoids.values()))
    return labelled, values, summary, cl._bounded(fleet, values, summary, n)


def test_bounds_hold_and_exact_costs_are_exact(spark):
    cdfs = random_cdfs(90, 7, 8)
    cdfs[40:60] = cdfs[41]
    fleet = di.write_fleet(fleet_frame(spark, cdfs))
    points = {f"V{i:05d}": list(map(float, cdfs[i])) for i in (0, 1)}
    with cl._celled(fleet) as frame:
        labelled, values, summary, bounded = _round_parts(fleet, frame, {2: ["V00000", "V00001"]}, points)
        codes = {r["vin"]: r["codes"][0] for r in labelled.collect()}
        own = np.array([codes[f"V{i:05d}"] for i in range(90)])
        d = distances(cdfs)
        for row in bounded.collect():
            i = int(row["vin"][1:])
            exact = d[i, own == own[i]].mean()
            assert row["low"] - 1e-9 <= exact <= row["high"] + 1e-9
        costs = cl._exact(fleet, values, summary, bounded.select("vin", "q"), 2).collect()
        assert len(costs) == 90
        for row in costs:
            i = int(row["vin"][1:])
            assert abs(row["cost"] - d[i, own == own[i]].mean()) < 2e-9


def planted(n, noise, seed=0):
    """Three dense shapes; each vehicle a shifted and noisy copy of one."""
    rng = np.random.default_rng(seed)
    bins = np.arange(38)
    center = np.array([8.0, 19.0, 29.0])[np.arange(n) % 3] + rng.normal(0, 0.3, n)
    p = np.exp(-0.5 * ((bins - center[:, None]) / 3.0) ** 2) * (1 + noise * rng.random((n, 38)))
    return np.cumsum(p / p.sum(axis=1, keepdims=True), axis=1)


def test_dense_concentrated_clusters(spark):
    cdfs = planted(300, 0.2)
    fleet = di.write_fleet(fleet_frame(spark, cdfs))
    labels, medoids, _ = kmedoids(distances(cdfs), 3)
    got = cl.kmedoids(fleet, 3)
    assert [int(v[1:]) for v in got.vins] == medoids
    rows = {r["vin"]: r["cluster"] for r in got.labels(fleet).collect()}
    assert [rows[f"V{i:05d}"] for i in range(300)] == list(labels)


def test_work_per_vehicle_does_not_grow(spark):
    """Survivors of the bounds stay few, and a survivor sorts a like share of the fleet at every size."""
    sizes = (300, 1000, 3000, 10000)
    survivors, share = [], []
    for n in sizes:
        cdfs = planted(n, 0.2)
        fleet = di.write_fleet(fleet_frame(spark, cdfs))
        points = {f"V{i:05d}": list(map(float, cdfs[i])) for i in range(3)}
        with cl._celled(fleet) as frame:
            _, values, summary, bounded = _round_parts(fleet, frame, {3: list(points)}, points)
            best = bounded.groupBy("q").agg(F.min("high").alias("best"))
            near = bounded.join(best, "q").where("low <= best").select("vin", "q")
            asked = values.join(near, ["vin", "q"], "left_semi").select("cell").distinct()
            sorted_rows = values.join(asked, "cell", "left_semi").count()
            survivors.append(near.count())
            share.append(sorted_rows / n / survivors[-1])
            widest = summary.agg(F.max(F.when(F.col("hi") > F.col("lo"), F.col("m")))).first()[0]
            # A cell holds a share of its bin, not of the fleet: the largest sort stays a small part.
            assert widest < n / 5
    # A cluster starts with one survivor at least; more of them must not come with the fleet.
    assert max(survivors) <= 3 * 4, survivors
    slope = np.polyfit(np.log(sizes), np.log(share), 1)[0]
    assert slope <= 0.05, (share, slope)


def test_cuts_are_the_same_on_any_number_of_tasks(spark):
    cdfs = planted(200, 0.2)
    found = []
    for parts in (1, 7):
        fleet = di.write_fleet(fleet_frame(spark, cdfs).repartition(parts))
        with cl._celled(fleet) as frame:
            found.append({r["vin"]: r["cells"] for r in frame.select("vin", "cells").collect()})
    assert found[0] == found[1]


def test_silhouette_matches_brute_force(spark):
    cdfs = random_cdfs(80, 6, 5)
    cdfs[79] = [1.0] * 6
    fleet = di.write_fleet(fleet_frame(spark, cdfs), slice_rows=50)
    # The last vehicle is alone in its cluster.
    label = F.when(F.col("vin") == "V00079", 2).otherwise(F.substring("vin", 6, 1).cast("int") % 2)
    labels = np.array([2 if i == 79 else i % 10 % 2 for i in range(80)])
    want = silhouettes(distances(cdfs), labels)
    rows = cl.silhouette(fleet, label, 3, "vehicle").collect()
    assert np.allclose([r["silhouette"] for r in sorted(rows)], want, atol=1e-9)
    assert all(-1 <= r["silhouette"] <= 1 for r in rows)
    mean = cl.silhouette(fleet, label, 3).first()["silhouette"]
    assert mean == pytest.approx(want.mean(), abs=1e-9)
    for row in cl.silhouette(fleet, label, 3, "cluster").collect():
        assert row["silhouette"] == pytest.approx(want[labels == row["cluster"]].mean(), abs=1e-9)
        assert row["n_vehicles"] == (labels == row["cluster"]).sum()
    assert cl.silhouette(fleet, F.lit(0), 2).first()["silhouette"] is None


def test_planted_clusters_are_found(spark):
    cdfs = planted_cdfs()
    fleet = di.write_fleet(fleet_frame(spark, cdfs))
    outcomes, scores = cl.k_sweep(fleet)
    assert cl.choose_k(scores) == 3 and cl.choose_k(scores, "fixed", 2) == 2
    rows = {r["vin"]: r["cluster"] for r in outcomes[3].labels(fleet).collect()}
    groups = [{rows[f"V{i:05d}"] for i in range(g, g + 20)} for g in (0, 20, 40)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    by_k = {r["k"]: r["silhouette"] for r in scores.collect()}
    for k in range(2, 7):
        labels, _, _ = kmedoids(distances(cdfs), k)
        assert by_k[k] == pytest.approx(silhouettes(distances(cdfs), labels).mean(), abs=1e-9)


def test_identical_vehicles(spark):
    cdfs = np.array([[0.5, 1.0]] * 5 + [[0.0, 1.0]])
    fleet = di.write_fleet(fleet_frame(spark, cdfs))
    found = cl.kmedoids(fleet, 2)
    assert found.vins == ("V00000", "V00001") and found.converged
    rows = {r["cluster"] for r in found.labels(fleet).collect()}
    assert rows == {0}


def test_labels_do_not_depend_on_partitioning(spark):
    cdfs = random_cdfs(100, 7, 11, atoms=False)
    df = fleet_frame(spark, cdfs)
    a = cl.kmedoids(di.write_fleet(df.coalesce(1)), 3)
    b = cl.kmedoids(di.write_fleet(df.repartition(11).orderBy(F.rand(3)), slice_rows=40), 3)
    assert a == b


def test_unequal_scales(spark):
    cdfs = np.hstack([random_cdfs(60, 5, 2), 3 * random_cdfs(60, 4, 6)])
    scales = [1.0] * 5 + [3.0] * 4
    fleet = di.write_fleet(fleet_frame(spark, cdfs), scales)
    labels, medoids, _ = kmedoids(distances(cdfs), 3)
    assert [int(v[1:]) for v in cl.kmedoids(fleet, 3).vins] == medoids


def vins(spark, names):
    return spark.createDataFrame([(n,) for n in names], "vin string")


@pytest.mark.parametrize("block_bytes", [di.BLOCK_BYTES, 0])
def test_stated_rows_of_the_matrix(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(di, "BLOCK_VEHICLES", 2)
    cdfs = random_cdfs(30, 6, 9)
    df = fleet_frame(spark, cdfs)
    stated = [f"V{i:05d}" for i in (3, 7, 11, 29)]
    named = vins(spark, [*stated, "unknown", stated[0], None])
    rows = di.matrix_rows(df, named, 2.0, block_bytes=block_bytes)
    d = distances(cdfs, 2.0)
    got = {(r["vin_i"], r["vin_j"]): r["distance"] for r in rows.collect()}
    assert len(got) == 4 * 30
    assert all(np.isclose(v, d[int(i[1:]), int(j[1:])]) for (i, j), v in got.items())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Cartesian", "NestedLoop", "Python"))
    assert di.matrix_rows(df, vins(spark, []), 2.0, block_bytes=block_bytes).collect() == []
    near = di.nearest_vehicles(rows, 3, parts=4).collect()
    for i in (3, 7, 11, 29):
        want = [j for j in np.argsort(d[i], kind="stable") if j != i][:3]
        found = sorted((r["rank"], int(r["vin_j"][1:])) for r in near if r["vin_i"] == f"V{i:05d}")
        assert [j for _, j in found] == want
    report = di.matrix_diagnostics(rows).first()
    assert (report["n_stated"], report["n_rows"], report["n_asymmetric"], report["n_negative"]) == (4, 120, 0, 0)
    assert report["max_diagonal"] == 0 and report["max_distance"] <= d.max()


def test_a_broken_distance_is_reported(spark):
    df = fleet_frame(spark, random_cdfs(12, 6, 9))
    stated = [f"V{i:05d}" for i in range(4)]

    def lopsided(a, b, step):
        first = F.get(a, F.lit(0)) - 2 * F.get(b, F.lit(0))
        return first * step

    report = di.matrix_diagnostics(di.matrix_rows(df, vins(spark, stated), 1.0, lopsided)).first()
    assert report["n_asymmetric"] == 12 and report["max_diagonal"] != 0 and report["n_negative"] > 0


def test_a_fleet_leaves_no_files(spark):
    from fleetspectra.sources import tables

    with di.write_fleet(fleet_frame(spark, random_cdfs(30, 6, 9)), slice_rows=20) as fleet:
        assert di.fleet_totals(fleet).count() == 30
        paths = list(fleet.paths)
        assert len(paths) >= 2 and all(tables.exists(spark, p) for p in paths)
    assert not any(tables.exists(spark, p) for p in paths)


def test_missing_values_are_refused(spark):
    df = spark.createDataFrame([("A", 1, [0.5, None])], "vin string, sales_group int, cdf array<double>")
    with pytest.raises(Exception, match="missing values"):
        di.write_fleet(df)


def test_soft_membership(spark):
    cdfs = random_cdfs(40, 6, 12)
    fleet = di.write_fleet(fleet_frame(spark, cdfs))
    found = cl.kmedoids(fleet, 3)
    rows = cl.soft_membership(fleet, found).collect()
    totals = {}
    for r in rows:
        totals[r["vin"]] = totals.get(r["vin"], 0) + r["weight"]
    assert len(rows) == 120 and all(abs(t - 1) < 1e-12 for t in totals.values())
    sure = {r["vin"]: r["cluster"] for r in rows if r["weight"] == 1.0}
    assert all(sure[v] == q for q, v in enumerate(found.vins))


def test_bad_arguments(spark):
    fleet = di.write_fleet(fleet_frame(spark, random_cdfs(4, 3, 1)))
    with pytest.raises(ValueError):
        cl.kmedoids(fleet, 5)
    with pytest.raises(ValueError):
        cl.kmedoids(fleet, 0)
    with pytest.raises(ValueError):
        cl.choose_k(None, "fixed")
    many = di.write_fleet(fleet_frame(spark, random_cdfs(60, 6, 1)))
    with pytest.raises(cl.NotConverged):
        cl.kmedoids(many, 3, max_iter=1)
    stopped = cl.kmedoids_sweep(many, [3], max_iter=1, must_converge=False)[3]
    assert stopped.rounds == 1 and not stopped.converged


def test_plans_stay_in_the_jvm_without_cartesian_products(spark):
    fleet = di.write_fleet(fleet_frame(spark, random_cdfs(50, 5, 1)), slice_rows=20)
    points = {v: p for v, p in fleet.frame.select("vin", "point").limit(2).collect()}
    label = F.lit(0)
    with cl._celled(fleet) as frame:
        bounded = _round_parts(fleet, frame, {2: list(points)}, points)[3]
    for df in (
        bounded,
        di.fleet_totals(fleet),
        cl.silhouette_vehicles(fleet, {"a": (F.pmod(F.hash("vin"), F.lit(2)), 2)}),
        di.distance_to(fleet.frame.withColumnRenamed("point", "cdf"), points, 1.0),
        fleet.frame.select(label),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("EvalPython", "Cartesian", "NestedLoop"))
