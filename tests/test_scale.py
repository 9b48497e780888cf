"""Work and files that must grow with the fleet and no faster."""

import numpy as np
import pytest
from brute import distances
from pyspark.sql import functions as F

from fleetspectra.functions.arrays import w1_sparse
from fleetspectra.operators import cluster as cl
from fleetspectra.operators import distance as di
from fleetspectra.operators import nearest as ne
from fleetspectra.operators import spectra as sp
from fleetspectra.operators.grid import GridSpec
from fleetspectra.sources import tables
from fleetspectra.sources import usage as us
from test_cluster import fleet_frame, random_cdfs


def test_small_slices_make_no_more_tasks_or_files(spark):
    cdfs = random_cdfs(400, 9, 2)
    cdfs[100:250] = cdfs[100]
    fleet = di.write_fleet(fleet_frame(spark, cdfs), slice_rows=5)
    frame, n_slices = fleet.sliced
    assert n_slices == 720 and len(frame.inputFiles()) <= 2 * fleet.n_tasks
    sizes = frame.select(F.explode("slice").alias("s")).groupBy("s").count()
    assert sizes.count() >= 720 and sizes.agg(F.max("count")).first()[0] <= 5
    got = {r["vin"]: r["total"] for r in di.fleet_totals(fleet).collect()}
    assert np.allclose([got[f"V{i:05d}"] for i in range(400)], distances(cdfs).sum(axis=1), rtol=1e-12)


def test_rounds_take_no_vehicle_apart(spark, monkeypatch):
    """Tables serve a usual grid; rows per value are for wider grids, and for more survivors, alike in outcome."""
    fleet = di.write_fleet(fleet_frame(spark, random_cdfs(150, 8, 3)))
    with monkeypatch.context() as m:
        m.setattr(cl, "_values", None)
        few = cl.kmedoids(fleet, 3)
    for name, value in (("TABLE_ROWS", 0), ("DIRECT", 0)):
        with monkeypatch.context() as m:
            m.setattr(cl, name, value)
            assert cl.kmedoids(fleet, 3) == few


def test_totals_are_looked_up_or_sorted_alike(spark, monkeypatch):
    fleet = di.write_fleet(fleet_frame(spark, random_cdfs(80, 6, 5)))
    label = F.pmod(F.hash("vin"), F.lit(3))
    with monkeypatch.context() as m:
        m.setattr(cl, "cluster_totals", None)
        a = sorted(cl.silhouette(fleet, label, 3, "vehicle").collect())
    with monkeypatch.context() as m:
        m.setattr(di, "VALUE_TABLE", 0)
        b = sorted(cl.silhouette(fleet, label, 3, "vehicle").collect())
    assert np.allclose([r["silhouette"] for r in a], [r["silhouette"] for r in b], atol=1e-9)


def test_blocks_keep_the_nearest_and_few_more(spark, monkeypatch):
    cdfs = random_cdfs(300, 7, 6)
    cdfs[20:60] = cdfs[20]
    df = fleet_frame(spark, cdfs).repartition(1)
    stated = df.where("vin in ('V00003', 'V00030')").select("vin")
    whole = di.matrix_rows(df, stated, 1.0)
    cut = di.matrix_rows(df, stated, 1.0, nearest=5)
    assert whole.count() == 600 and cut.count() <= 2 * 6
    assert sorted(di.nearest_vehicles(cut, 5).collect()) == sorted(di.nearest_vehicles(whole, 5).collect())


def test_sparse_blocks_match_merged_lists(spark):
    rng = np.random.default_rng(7)
    rows = [
        (f"V{i:05d}", 1, f"[{lo}, {lo + 1})", float(rng.integers(1, 4)))
        for i in range(40)
        for lo in rng.choice(10**7 if i % 2 else 9, size=1 + i % 8, replace=False).tolist()
    ]
    df = spark.createDataFrame(rows, "vin string, sales_group int, x1_interval string, count double")
    cells = sp.sparse_distributions(df)
    sides = []
    for sparse in (True, False):
        found = di.matrix_rows(
            cells, cells.select("vin"), 1.0, lambda a, b, _: w1_sparse(a, b), value="cells", sparse=sparse
        )
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("MapInArrow" in plan) == sparse
        sides.append({(r["vin_i"], r["vin_j"]): r["distance"] for r in found.collect()})
    assert len(sides[0]) == 1600 and sides[0].keys() == sides[1].keys()
    assert all(abs(v - sides[1][k]) < 1e-7 for k, v in sides[0].items())


def test_nearest_classes_are_few_per_group(spark, monkeypatch):
    """No pair but the nearest of a group leaves its task, also where most distances are tied."""
    rng = np.random.default_rng(8)
    cdfs = np.cumsum(rng.multinomial(3, np.ones(12) / 12, size=600) / 3, axis=1)
    fleet = di.write_fleet(fleet_frame(spark, cdfs))
    classes = ne.materialize(ne._classes(fleet, 4), "classes")
    assert ne.candidate_pairs(classes, 4).count() == 5 * classes.count()
    monkeypatch.setattr(ne, "CELL_ROWS", 100)
    want = np.round(distances(cdfs), 9)
    got = {}
    for r in ne.nearest_neighbours(fleet, 4).collect():
        got.setdefault(int(r["vin"][1:]), {})[r["rank"]] = (int(r["neighbour"][1:]), r["distance"])
    for i in range(600):
        near = [j for j in np.argsort(want[i], kind="stable") if j != i][:4]
        assert [got[i][k][0] for k in range(1, 5)] == near
        assert np.allclose([got[i][k][1] for k in range(1, 5)], want[i][near])


def test_smoothing_takes_no_vehicle_apart(spark):
    """Spread masses are those of a row per bin and weight, without such rows."""
    grid, weights = GridSpec(0.5, 1.0, 6), [1.0, 2.0, 1.0]
    mass = {"V1": {0: 3.0, 4: 1.0}, "V2": {5: 2.0}, "V3": {2: 0.0}}
    rows = [(v, b, m, 7, 7) for v, bins in mass.items() for b, m in bins.items()]
    binned = spark.createDataFrame(rows, "vin string, bin int, mass double, sg_low int, sg_high int")
    out = sp.smoothed_distributions(binned, grid, weights)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    found = {r["vin"]: r for r in out.collect()}
    assert found.keys() == {"V1", "V2"} and found["V1"]["sales_group"] == 7
    assert found["V1"]["probs"] == [6 / 13, 3 / 13, 0.0, 1 / 13, 2 / 13, 1 / 13]
    assert found["V2"]["probs"] == [0, 0, 0, 0, 2 / 6, 4 / 6] and found["V2"]["cdf"][-1] == 1.0
    clash = binned.union(spark.createDataFrame([("V1", 1, 1.0, 8, 8)], binned.schema))
    with pytest.raises(Exception, match="several sales groups for vin V1"):
        sp.smoothed_distributions(clash, grid, weights).collect()


def test_vins_are_made_per_interval(spark):
    """Usage rows are grouped by number; long numbers, which share a cut vin, are grouped by vin."""
    keys = [(5, 2.5), (5, 2.0), (None, 1.0), (123456789, 1.0), (123456784, 1.0)]
    lines = spark.createDataFrame(keys, "key long, l_quantity double").select(
        "key",
        F.when(F.col("key") < 10**8, F.raise_error(F.lit("made per line"))).otherwise(us.vin_of("V", "key")).alias("vin"),
        F.lit(1).alias("sales_group"), "l_quantity"
    )
    out = us.spectra_of(lines, "velocity")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("V00000005", 1, "[2, 3)", 2.0), (None, 1, "[1, 2)", 1.0), ("V12345678", 1, "[1, 2)", 2.0)], key=str
    )


def test_distances_are_rounded_in_blocks_as_by_spark(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.random(3000) * 10.0 ** rng.integers(-6, 12, 3000), np.arange(400) / 256 / 3.90625, np.arange(400) / 256])
    values = np.concatenate([values, -values, [1.00005, 2.67545, 0.00005, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", F.round("v", 4).alias("r"))
    rows = df.collect()
    assert (di._rounded(np.array([r["v"] for r in rows]), 4) == np.array([r["r"] for r in rows])).all()
    fleet = fleet_frame(spark, random_cdfs(50, 9, 2)).repartition(1)
    cut = di.matrix_rows(fleet, fleet.limit(20).select("vin"), 1000.0, digits=4)
    whole = di.matrix_rows(fleet, fleet.limit(20).select("vin"), 1000.0, block_bytes=0, digits=4)
    assert "MapInArrow" in cut._jdf.queryExecution().executedPlan().toString()
    assert "round" not in cut._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert sorted(cut.collect()) == sorted(whole.collect()) and cut.count() == 1000


def test_vehicles_of_equal_shares_meet_as_blocks(spark, monkeypatch):
    """Blocks follow the numbers of shares, not the stated vehicles; other shares go by cells and agree."""
    rng = np.random.default_rng(9)
    rows = [
        (f"V{i:05d}", 1, f"[{lo}, {lo + 1})", float(rng.random()) if i >= 56 else float(1 + (lo + i) % 2) * (1 + i % 3))
        for i in range(60)
        for lo in rng.choice(10**7 if i % 2 else 9, size=3, replace=False).tolist()
    ]
    df = spark.createDataFrame(rows, "vin string, sales_group int, x1_interval string, count double")
    cells = tables.materialize(sp.sparse_distributions(df).repartition(1), "sparse")
    metric = lambda a, b, _: w1_sparse(a, b)
    whole = di.matrix_rows(cells, cells.select("vin"), 1.0, metric, value="cells")
    got = di.matrix_rows(cells, cells.select("vin"), 1.0, metric, value="cells", sparse=True, digits=2, nudge=1e-7)
    want = {(r["vin_i"], r["vin_j"]): r["distance"] for r in whole.collect()}
    found = {(r["vin_i"], r["vin_j"]): r["distance"] for r in got.collect()}
    assert found.keys() == want.keys() and len(found) == 3600
    assert all(abs(found[k] - want[k]) <= 0.005 + 1e-6 for k in want)
    assert "round(" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(di, "_unfolded", lambda blocks: blocks)
    alike = cells.where("vin < 'V00056'").repartition(1)
    stated = alike.where("vin < 'V00050'").select("vin", "cells").withColumnRenamed("cells", "v")
    blocks = di._sparse_rows(alike.select("vin", F.col("cells").alias("v")), stated.withColumnRenamed("vin", "vin_i"))
    # Three intervals of one or two counts: three to six shares.
    assert blocks.count() <= 4 * 4


def test_diagnostics_gather_no_pairs_on_the_driver(spark):
    """Rows among stated vehicles meet their other direction by a shuffle, whatever their source's size says."""
    df = tables.materialize(fleet_frame(spark, random_cdfs(40, 6, 5)), "vehicles")
    stated = df.where("vin < 'V00012'").select("vin")
    rows = di.matrix_rows(df, stated, 1.0)
    between = di.matrix_rows(df.join(stated, "vin", "left_semi"), stated, 1.0)
    found, alone = di.matrix_diagnostics(rows, between), di.matrix_diagnostics(rows)
    assert found.collect() == alone.collect()
    assert (found.first()["n_stated"], found.first()["n_rows"], found.first()["n_asymmetric"]) == (12, 480, 0)
    broken = between.withColumn("distance", F.col("distance") + F.when(F.col("vin_i") < F.col("vin_j"), 1.0).otherwise(0.0))
    assert di.matrix_diagnostics(rows, broken).first()["n_asymmetric"] == 12 * 11
    for report in (found, alone):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [vin_i" in plan
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "vin_i" in x]


def test_nearest_of_many_stated_are_searched(spark, monkeypatch):
    """Beyond a number of pairs groups of neighbours are searched, with the same nearest, copies and ties included."""
    rng = np.random.default_rng(8)
    cdfs = np.cumsum(rng.multinomial(4, np.ones(12) / 12, size=500) / 4, axis=1)
    cdfs[100:200] = cdfs[100]
    df = tables.materialize(fleet_frame(spark, cdfs), "vehicles")
    stated = df.where("cast(substring(vin, 2, 9) as int) % 7 = 0").select("vin")
    want = sorted(di.nearest_vehicles(di.matrix_rows(df, stated, 1000.0), 5).collect())
    monkeypatch.setattr(di, "SEARCH_PAIRS", 100)
    for cell_rows in (ne.CELL_ROWS, 60):
        monkeypatch.setattr(ne, "CELL_ROWS", cell_rows)
        rows = di.matrix_rows(df, stated, 1000.0, nearest=5, block_bytes=0)
        assert rows.count() <= 6 * stated.count()
        assert sorted(di.nearest_vehicles(rows, 5).collect()) == want
