import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspectra.operators import fleet as fl
from fleetspectra.operators import profile as pr
from fleetspectra.operators.grid import GridSpec
from fleetspectra.plans import flows
from fleetspectra.sources import tables
from fleetspectra.streaming.spectrum import read_spectrum, start_spectrum_stream

CODES = "vin string, sales_group int, cluster_wasserstein int"


def clusters(spark, *rows):
    return spark.createDataFrame(list(rows), CODES)


def test_labels_and_unmapped(spark):
    df = clusters(spark, ("A", 1, 0), ("B", 1, 1), ("C", 1, 2), ("D", 1, 7))
    rows = fl.apply_labels(df, "velocity")
    got = {r["vin"]: r["cluster_velocity_text"] for r in rows.collect()}
    assert got == {"A": "Medium", "B": "High", "C": "Low", "D": None}
    assert [tuple(r) for r in fl.unmapped(rows, "velocity").collect()] == [(7, 1)]
    empty = fl.apply_labels(df, "weight", {})
    assert {r["cluster_weight_text"] for r in empty.collect()} == {None}
    assert fl.label_map(spark).count() == 7


def subpop(spark):
    """All 12 cells of group 1 but (Low, Flat, Low), with a NaN and a NULL KPI in one cell."""
    rows = []
    for v in fl.CELL_ORDER["velocity"]:
        for g in fl.CELL_ORDER["gradient"]:
            for w in fl.CELL_ORDER["weight"]:
                if (v, g, w) != ("Low", "Flat", "Low"):
                    rows.append((f"{v}{g}{w}", 1, v, g, w, 10.0, 20.0, 1.0, 30.0))
    rows.append(("extra1", 1, "High", "Hilly", "High", float("nan"), 40.0, 3.0, 30.0))
    rows.append(("extra2", 1, "High", "Hilly", "High", None, 60.0, 5.0, 30.0))
    rows.append(("other", 2, None, "Hilly", "High", 1.0, 1.0, 1.0, 1.0))
    return spark.createDataFrame(
        rows,
        "vin string, sales_group int, cluster_velocity_text string, cluster_gradient_text string, "
        "cluster_weight_text string, vehicle_speed_avg_driving_kmh double, gc_weight_avg_kg double, "
        "stddev_road_gradient double, fuel_cons_driving_l_per_100km double",
    )


def test_kpi_crosstab(spark):
    rows = fl.kpi_crosstab(subpop(spark), 1).collect()
    cells = {(r["velocity"], r["gradient"], r["weight"]): r for r in rows}
    assert len(rows) == len(cells) == 12
    empty = cells["Low", "Flat", "Low"]
    assert empty["n_vehicles"] == 0 and empty["avg_speed"] is None
    full = cells["High", "Hilly", "High"]
    assert (full["n_vehicles"], full["avg_speed"], full["avg_weight"]) == (3, 10.0, 40.0)
    every = fl.kpi_crosstab(subpop(spark))
    rows = every.collect()
    assert len(rows) == 25 and sum(r["n_vehicles"] for r in rows) == subpop(spark).count()
    assert [r["sales_group"] for r in rows if r["velocity"] is None] != []
    absent = fl.kpi_crosstab(subpop(spark), 9).collect()
    assert len(absent) == 12 and {r["n_vehicles"] for r in absent} == {0}
    matrix = {r["velocity"]: r for r in fl.kpi_matrix(fl.kpi_crosstab(subpop(spark), 1), "n_vehicles").collect()}
    assert matrix["High"]["Hilly_High"] == 3 and matrix["Low"]["Flat_Low"] == 0
    text = {(r["velocity"], r["cell"]): r for r in fl.kpi_text(fl.kpi_crosstab(subpop(spark), 1)).collect()}
    assert text["High", "Hilly Road\nHigh Weight"]["avg_weight_text"] == "40.0"
    assert text["Low", "Flat Road\nLow Weight"]["avg_weight_masked"]
    assert text["Low", "Flat Road\nLow Weight"]["avg_weight_text"] is None


def test_shares_and_crosstab(spark):
    df = clusters(spark, ("A", 5, 0), ("B", 5, 0), ("C", 5, 2), ("D", 1, 1), ("E", 3, 1))
    rows = {(r["sales_group"], r["cluster"]): r for r in fl.cluster_share(df, range(3)).collect()}
    assert len(rows) == 9 and rows[5, 1]["n_vehicles"] == 0
    assert (rows[5, 0]["percent"], rows[5, 0]["percent_text"]) == (66.7, "66.7%")
    some = fl.cluster_share(df, range(3), (5, 8, 1), digits=0).orderBy("position", "cluster").collect()
    assert [r["sales_group"] for r in some] == [5, 5, 5, 1, 1, 1]
    assert some[0]["percent_text"] == "67%" and some[3]["position"] == 3
    table = {r["cluster_wasserstein"]: r for r in fl.crosstab(df, (1, 3, 5)).collect()}
    assert table[0]["sg_5"] == 2 and table[1]["sg_5"] == 0 and table[1]["sg_3"] == 1
    assert [r[0] for r in fl.sorted_groups(df).collect()] == [1, 3, 5]
    assert {tuple(r) for r in fl.cluster_sizes(df).collect()} == {(0, 2), (1, 2), (2, 1)}


def test_joins_keep_vehicles_of_all_signals(spark):
    parts = {
        "velocity": clusters(spark, ("A", 1, 0), ("B", 1, 1)),
        "weight": clusters(spark, ("A", 1, 0), ("B", 2, 1)),
        "gradient": clusters(spark, ("A", 1, 1), ("B", 1, 0)),
    }
    joined = flows.combine({s: fl.apply_labels(d, s) for s, d in parts.items()})
    assert [r["vin"] for r in joined.collect()] == ["A"]
    assert fl.vehicles_per_group(joined).first()["num_vins"] == 1


def test_union_is_strict_by_name(spark):
    a = spark.createDataFrame([("A", 1.0)], "vin string, x double")
    b = spark.createDataFrame([(2.0, "B", 99)], "x double, vin string, sales_group int")
    rows = fl.union_stats({1: a, 2: b}).collect()
    assert {(r["vin"], r["x"], r["sales_group"]) for r in rows} == {("A", 1.0, 1), ("B", 2.0, 2)}
    with pytest.raises(Exception):
        fl.union_stats({1: a, 2: b.drop("x")}).collect()
    assert fl.union_stats({1: a, 2: b.drop("x")}, allow_missing=True).count() == 2


def test_configuration_fit(spark):
    expected = spark.createDataFrame([(1, 1)], "sales_group int, expected_rank int")
    row = fl.configuration_fit(subpop(spark), expected).first()
    assert row["n_vehicles"] == 13
    assert row["over_percent"] + row["under_percent"] + row["match_percent"] == pytest.approx(100, abs=0.2)


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.random((60, 6)) @ rng.random((6, 6))
    rows = [(f"V{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vin string, probs array<double>")
    coordinates, shares = pr.pca_coordinates(df)
    centered = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centered, full_matrices=False)
    vt = np.array([v * np.sign(v[np.abs(v).argmax()]) for v in vt[:2]])
    got = np.array([[r["pc1"], r["pc2"]] for r in coordinates.orderBy("vin").collect()])
    assert np.allclose(got, centered @ vt.T, atol=1e-9)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:2])


def test_automatic_names(spark):
    grid = GridSpec(0.5, 1.0, 3)
    rows = [("A", [1.0, 0.0, 0.0], 2), ("B", [0.0, 1.0, 0.0], 0), ("C", [0.0, 0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vin string, probs array<double>, cluster int")
    auto = pr.auto_labels(df, grid, pr.NAMES_BY_RANK["velocity"])
    assert pr.label_names(auto) == {2: "Low", 0: "Medium", 1: "High"}
    short = pr.auto_labels(df, grid, ("Low", "High"))
    assert pr.label_names(short) == {2: "Low", 0: "High", 1: "High"}
    one = pr.auto_labels(df.where("cluster = 1"), grid, ("Low", "High"))
    assert pr.label_names(one) == {1: "Low"}


def test_save_and_load(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", 1), ("B", 2)], "vin string, sales_group int")
    tables.save(df, path, partition_by=["sales_group"])
    tables.save(tables.load(spark, path).where("sales_group = 1"), path, reads_target=True)
    assert [r["vin"] for r in tables.load(spark, path).collect()] == ["A"]
    tables.save(df, "saved_vehicles")
    assert tables.load(spark, "saved_vehicles").count() == 2
    spark.sql("DROP TABLE saved_vehicles")
    assert tables.preview(df, 1, "vin").collect()[0]["vin"] == "A"


def test_filter_on_group_reads_one_branch(spark, tmp_path):
    for n in (1, 2, 3):
        tables.save(spark.createDataFrame([(f"V{n}",)], "vin string"), str(tmp_path / f"sg{n}"))
    stats = tables.load_numbered(spark, str(tmp_path) + "/sg{}", (1, 2, 3))
    one = fl.of_group(stats, 2)
    assert [tuple(r) for r in one.collect()] == [("V2", 2)]
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_shared_folder_is_kept_per_application(spark):
    folder = tables.shared_folder(spark)
    assert folder.endswith(spark.sparkContext.applicationId)
    df = tables.materialize(spark.range(5), "five")
    assert df.count() == 5 and df.inputFiles()[0].removeprefix("file://").startswith(folder)


def test_stream_over_several_batches(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        rows = [("A", 5.0 + i), ("B", 25.0)]
        spark.createDataFrame(rows, "vin string, signal double").coalesce(1).write.mode(
            "append"
        ).parquet(source)
    stream = (
        spark.readStream.schema("vin string, signal double")
        .option("maxFilesPerTrigger", 1)
        .parquet(source)
    )
    start_spectrum_stream(stream, target, str(tmp_path / "progress"), 10.0).awaitTermination()
    rows = {(r["vin"], r["x1_interval"]): r["count"] for r in read_spectrum(spark, target).collect()}
    assert rows == {("A", "[0, 10)"): 3.0, ("B", "[20, 30)"): 3.0}
    assert spark.read.parquet(target).select("batch").distinct().count() == 3


def test_shared_folder_can_be_cleared(spark):
    old = tables.materialize(spark.range(3), "old").inputFiles()[0]
    tables.clear_shared_folder(spark)
    with pytest.raises(Exception):
        spark.read.parquet(old)
    assert tables.materialize(spark.range(4), "new").count() == 4
