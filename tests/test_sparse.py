"""Fleets on a line without bounds: axes of occupied bins, sparse distances, nearest vehicles."""

import numpy as np
import pytest
from brute import distances, kmedoids
from pyspark.sql import functions as F

from fleetspectra.functions.arrays import block_sums, w1_sparse
from fleetspectra.operators import cluster as cl
from fleetspectra.operators import distance as di
from fleetspectra.operators import nearest
from fleetspectra.operators import spectra as sp
from fleetspectra.operators.grid import WIDE_GRID, Axis, GridSpec, grid_table
from fleetspectra.plans import flows
from test_cluster import fleet_frame, planted, random_cdfs

SPECTRUM = "vin string, sales_group int, x1_interval string, count double"
FAR = 1_000_000_000


def line_rows(n=60, seed=3):
    """Vehicles on intervals of width one; the first has one far out."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for lo in rng.choice(60, 12, replace=False):
            at = int(lo) // 3 + 20 * (i % 3)
            rows.append((f"V{i:05d}", i % 3 + 1, f"[{at}, {at + 1})", float(rng.integers(1, 6))))
    return rows + [("V00000", 1, f"[{FAR}, {FAR + 1})", 2.0)]


def on_the_line(rows):
    """Cumulative shares times the way to the next occupied edge: L1 distances are W1."""
    mass = {}
    for vin, _, text, count in rows:
        lo = int(text[1:].split(",")[0])
        mass.setdefault(vin, {}).setdefault(lo, 0.0)
        mass[vin][lo] += count
    edges = sorted({lo for m in mass.values() for lo in m})
    widths = np.diff([*edges, edges[-1] + 1])
    p = np.array([[mass[v].get(e, 0.0) for e in edges] for v in sorted(mass)])
    shares = np.cumsum(p, axis=1) / p.sum(axis=1, keepdims=True)
    return shares * widths, edges


def spectrum(spark, rows):
    return spark.createDataFrame(rows, SPECTRUM)


def outliers(spark):
    return spark.createDataFrame([], "vin string")


def test_a_stray_interval_changes_no_method(spark):
    rows = line_rows()
    found = flows.cluster_signal(spectrum(spark, rows), outliers(spark), "velocity", 3)
    points, edges = on_the_line(rows)
    assert isinstance(found.grid, Axis) and found.grid.grid.n == FAR + 1
    assert list(found.grid.places) == edges and found.grid.centers[-1] == FAR + 0.5
    labels, medoids, _ = kmedoids(distances(points), 3)
    assert [int(v[1:]) for v in found.medoids.vins] == medoids
    got = {r["vin"]: r["cluster_wasserstein"] for r in found.clusters.collect()}
    assert [got[f"V{i:05d}"] for i in range(60)] == list(labels)
    for row in found.labelled().collect():
        assert np.isclose(sum(row["probs"]), 1) and min(row["probs"]) > -1e-9
    totals = {r["vin"]: r["total"] for r in di.fleet_totals(found.fleet).collect()}
    want = distances(points).sum(axis=1)
    assert all(np.isclose(totals[f"V{i:05d}"], want[i], rtol=1e-9) for i in range(60))


def test_the_plan_does_not_know_how_far_the_line_reaches(spark):
    plans = []
    for far in (10**6, 10**9):
        rows = line_rows(9)[:-1] + [("V00000", 1, f"[{far}, {far + 1})", 2.0)]
        dists, _ = flows.signal_distributions(spectrum(spark, rows), outliers(spark), "velocity")
        plans.append(len(dists._jdf.queryExecution().optimizedPlan().toString()))
        assert dists.select(F.max(F.size("cdf"))).first()[0] < 100
    assert abs(plans[0] - plans[1]) < 100


def test_an_axis_gives_the_distances_of_its_grid(spark):
    rows = line_rows()[:-1]
    data = spectrum(spark, rows)
    centers = sp.with_centers(data)
    grid = GridSpec.from_data(centers, 0.5, 1.0)
    axis = Axis.from_data(centers, grid)
    assert grid.n <= WIDE_GRID and axis.n <= grid.n
    sums = []
    for g in (grid, axis):
        with flows.grid_fleet(sp.to_distributions(data, g), g) as fleet:
            sums.append({r["vin"]: round(r["total"], 6) for r in di.fleet_totals(fleet).collect()})
    assert sums[0] == sums[1]
    wide = {r["bin"]: r["bin_center"] for r in grid_table(spark, axis).collect()}
    assert [wide[i] for i in range(axis.n)] == axis.centers


def test_a_long_grid_is_a_distributed_table(spark):
    grid = GridSpec(0.5, 1.0, 5_000_000)
    last = grid_table(spark, grid).agg(F.count("*").alias("n"), F.max("bin_center").alias("top")).first()
    assert (last["n"], last["top"]) == (5_000_000, 4_999_999.5)


def test_sparse_distances_match_the_dense_ones(spark):
    rows = line_rows(20)
    cells = sp.sparse_distributions(spectrum(spark, rows))
    assert cells.select(F.max(F.size("cells"))).first()[0] <= 21
    one = cells.where("vin = 'V00000'").first()["cells"]
    assert one[-1]["center"] == FAR + 0.5 and one[-1]["cdf"] == 1.0
    rows_of = di.matrix_rows(
        cells, cells.select("vin"), 1.0, lambda a, b, _: w1_sparse(a, b), value="cells"
    )
    d = distances(on_the_line(rows)[0])
    got = {(r["vin_i"], r["vin_j"]): r["distance"] for r in rows_of.collect()}
    assert len(got) == 400
    assert all(np.isclose(v, d[int(i[1:]), int(j[1:])], rtol=1e-9) for (i, j), v in got.items())


def test_sparse_distributions_of_odd_rows(spark):
    rows = [
        ("A", 1, "[0, 1)", 2.0), ("A", 1, "[0, 1)", 2.0), ("A", 1, "x", 9.0), ("A", 1, "[4, 5)", None),
        (None, 1, "[0, 1)", 1.0), ("B", 2, "[3, 4)", 0.0), ("C", 3, "[2, 3)", float("nan")), ("C", 3, "[8, 9)", 1.0),
    ]
    got = {r["vin"]: [(c["center"], c["p"]) for c in r["cells"]] for r in sp.sparse_distributions(spectrum(spark, rows)).collect()}
    assert got == {"A": [(0.5, 1.0), (4.5, 0.0)], "C": [(2.5, 0.0), (8.5, 1.0)]}
    twice = spectrum(spark, [("A", 1, "[0, 1)", 2.0), ("A", 2, "[1, 2)", 2.0)])
    with pytest.raises(Exception, match="several sales groups"):
        sp.sparse_distributions(twice).collect()


@pytest.mark.parametrize("blocks", [1, 3, 7, 38])
def test_block_sums_bound_distances_from_below(spark, blocks):
    cdfs = random_cdfs(40, 38, 5)
    got = fleet_frame(spark, cdfs).select("vin", block_sums(F.col("cdf"), 38, blocks).alias("s")).collect()
    coarse = distances([r["s"] for r in sorted(got)])
    fine = distances(cdfs)
    assert (coarse <= fine + 1e-9).all()
    assert blocks < 38 or np.allclose(coarse, fine)


def check_nearest(spark, cdfs, n):
    fleet = di.write_fleet(fleet_frame(spark, cdfs))
    got = {}
    for r in nearest.nearest_neighbours(fleet, n).collect():
        got.setdefault(int(r["vin"][1:]), []).append((r["rank"], int(r["neighbour"][1:]), r["distance"]))
    d = np.round(distances(cdfs), 9)
    assert len(got) == len(cdfs)
    for i, found in got.items():
        want = [j for j in np.argsort(d[i], kind="stable") if j != i][:n]
        assert [j for _, j, _ in sorted(found)] == want
        assert np.allclose([v for _, _, v in sorted(found)], d[i][want])


@pytest.mark.parametrize("cell_rows", [nearest.CELL_ROWS, 5])
def test_nearest_vehicles_match_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(nearest, "CELL_ROWS", cell_rows)
    cdfs = np.vstack([planted(150, 0.2), random_cdfs(60, 38, 2)])
    # Copies: a third of the fleet is one vehicle, and some shapes stand twice.
    cdfs[100:170] = cdfs[100]
    cdfs[5:10] = cdfs[15:20]
    check_nearest(spark, cdfs, 4)


def test_nearest_of_small_fleets(spark):
    check_nearest(spark, random_cdfs(3, 5, 1), 5)
    check_nearest(spark, np.ones((6, 2)), 2)
    check_nearest(spark, random_cdfs(40, 1, 1), 2)
    empty = di.write_fleet(fleet_frame(spark, random_cdfs(3, 5, 1)).where("false"))
    assert nearest.nearest_neighbours(empty, 2).collect() == []


def test_pairs_measured_grow_slower_than_the_fleet(spark):
    per_vehicle = []
    for n in (400, 4000):
        fleet = di.write_fleet(fleet_frame(spark, planted(n, 0.2)))
        classes = nearest.materialize(nearest._classes(fleet, 4), "classes")
        per_vehicle.append(nearest.candidate_pairs(classes, 4).count() / n)
    assert per_vehicle[1] <= 5 * per_vehicle[0], per_vehicle
