import pytest
from pyspark.sql import functions as F

from fleetspectra.functions.arrays import w1_probs, double_array
from fleetspectra.functions.intervals import bin_center, interval_text
from fleetspectra.operators import spectra as sp
from fleetspectra.operators.grid import GRADIENT_GRID, WEIGHT_GRID, GridSpec, center_bounds

SCHEMA = "vin string, sales_group int, x1_interval string, count double"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_bin_center(spark):
    texts = ["(0, 1]", "[12000, 13000)", " ( -1.5 , 0 ] ", "abc", None, "5", "1,2,3", "[1e3, 2e3)", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(bin_center("t")).collect()]
    assert got == [0.5, 12500.0, -0.75, None, None, None, None, 1500.0, None]


def test_bin_center_strict(spark):
    good = spark.createDataFrame([("(0, 1]",), (None,)], "t string")
    assert [r[0] for r in good.select(bin_center("t", strict=True)).collect()] == [0.5, None]
    bad = spark.createDataFrame([("abc",)], "t string")
    with pytest.raises(Exception, match="not an interval: abc"):
        bad.select(bin_center("t", strict=True)).collect()


def test_interval_text_round_trip(spark):
    df = spark.createDataFrame([(0.5,), (-3.0,), (12000.0,)], "lo double")
    text = interval_text(F.col("lo"), 2.0)
    rows = df.select("lo", text.alias("t"), bin_center(text).alias("c")).collect()
    assert [r["t"] for r in rows] == ["[0.5, 2.5)", "[-3, -1)", "[12000, 12002)"]
    assert all(r["c"] == r["lo"] + 1 for r in rows)


def test_grids(spark):
    assert WEIGHT_GRID.centers[0] == 12500 and WEIGHT_GRID.centers[-1] == 49500
    assert GRADIENT_GRID.centers == [i + 0.5 for i in range(10)]
    df = spark.createDataFrame(
        [(50.5,), (float("nan"),), (float("inf"),), (None,), (1.5,)], "bin_center double"
    )
    assert GridSpec.from_data(df, 0.5, 1.0) == GridSpec(0.5, 1.0, 51)
    assert GridSpec.from_data(df, 0.5, 1.0, cap=100) == GridSpec(0.5, 1.0, 101)
    assert GridSpec.from_data(df, 40.5, 1.0) == GridSpec(40.5, 1.0, 11)
    assert tuple(center_bounds(df).first()) == (1.5, 50.5)
    with pytest.raises(ValueError):
        GridSpec.from_data(df.where("false"), 0.5, 1.0)


@pytest.mark.parametrize("tolerance", [0.0, 0.01])
def test_grid_positions(spark, tolerance):
    grid = GridSpec(0.5, 1.0, 3)
    values = [0.5, 2.5, 3.5, -0.5, 1.0, 1.505, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r[0] or 0 for r in df.select(grid.position_of("c", tolerance)).collect()]
    assert got == [1, 3, 0, 0, 0, 2 if tolerance else 0, 0, 0, 0]


def test_distributions(spark):
    grid = GridSpec(0.5, 1.0, 5)
    df = frame(
        spark,
        ("A", 1, "[1, 2)", 2.0), ("A", 1, "[1, 2)", 3.0), ("A", 1, "[3, 4)", 5.0),
        ("A", 1, "[7, 8)", 90.0), ("A", 1, "[0, 1)", None), ("A", 1, "[2, 3)", float("nan")),
        ("B", 2, "[9, 10)", 4.0), (None, 3, "[1, 2)", 1.0), ("C", 3, "[4, 5)", 1.0),
        ("D", 3, "[0, 1)", 0.0),
    )
    rows = {r["vin"]: r for r in sp.to_distributions(df, grid).collect()}
    assert set(rows) == {"A", "C"}
    assert rows["A"]["probs"] == [0, 0.5, 0, 0.5, 0] and rows["A"]["cdf"] == [0, 0.5, 0.5, 1, 1]
    assert rows["C"]["probs"] == [0, 0, 0, 0, 1] and rows["C"]["cdf"] == [0, 0, 0, 0, 1]
    assert rows["A"]["sales_group"] == 1
    gone = {r["vin"]: r["total"] for r in sp.zero_mass(df, grid).collect()}
    assert gone == {"B": 4.0, "D": 0.0}
    lost = sp.dropped_mass(df, grid).first()
    assert (lost["total"], lost["kept"]) == (105.0, 11.0)
    wide = {r["vin"]: r.asDict() for r in sp.pivot_wide(df, grid).collect()}
    assert wide["A"] == {"vin": "A", "b0": 0.0, "b1": 5.0, "b2": 0.0, "b3": 5.0, "b4": 0.0}
    window = {(r["vin"], r["bin"]): r["cdf"] for r in sp.cdf_by_window(df, grid).collect()}
    for vin, row in rows.items():
        assert all(window.get((vin, b), row["cdf"][b]) == row["cdf"][b] for b in range(5))


def test_scaling_counts_changes_nothing(spark):
    grid = GridSpec(0.5, 1.0, 4)
    base = [("A", 1, "[0, 1)", 1.0), ("A", 1, "[2, 3)", 2.0)]
    scaled = [(v, g, t, 7 * c) for v, g, t, c in base]
    a = sp.to_distributions(frame(spark, *base), grid).first()
    assert a == sp.to_distributions(frame(spark, *scaled), grid).first()


def test_outliers_and_counts(spark):
    df = frame(spark, ("A", 1, "[0, 1)", 1.0), ("B", 1, "[0, 1)", 1.0), (None, 1, "[0, 1)", 1.0))
    bad = spark.createDataFrame([("B",), ("B",)], "vin string")
    kept = sp.remove_outliers(df, bad)
    assert [r["vin"] for r in kept.collect()] == ["A"]
    counts = {r[0]: r[1] for r in sp.stage_counts({"raw": df, "kept": kept}).collect()}
    assert counts == {"raw": 2, "kept": 1}


def test_two_sales_groups(spark):
    df = frame(spark, ("A", 1, "[0, 1)", 1.0), ("A", 2, "[1, 2)", 1.0), ("B", 1, "[0, 1)", 1.0))
    grid = GridSpec(0.5, 1.0, 2)
    assert [tuple(r) for r in sp.group_conflicts(df).collect()] == [("A", 2)]
    with pytest.raises(Exception, match="several sales groups for vin A"):
        sp.to_distributions(df, grid).collect()
    loose = sp.to_distributions(df, grid, check_groups=False)
    assert {r["vin"]: r["sales_group"] for r in loose.collect()} == {"A": 1, "B": 1}


def test_required_columns(spark):
    with pytest.raises(ValueError, match="x1_interval, count"):
        sp.to_distributions(spark.createDataFrame([("A", 1)], "vin string, sales_group int"), WEIGHT_GRID)


def test_w1_from_probabilities_on_38_wide_bins(spark):
    a, b = [0.0] * 38, [0.0] * 38
    a[0], b[3] = 1.0, 1.0
    d = w1_probs(double_array(a), double_array(b), WEIGHT_GRID.centers)
    assert spark.range(1).select(d).first()[0] == 3000.0


def test_rebin_keeps_mass(spark):
    grid = GridSpec(0.5, 1.0, 5)
    df = frame(spark, ("A", 1, "[0, 1)", 1.0), ("A", 1, "[1, 2)", 2.0), ("A", 1, "[4, 5)", 4.0))
    coarse, new = sp.rebin(df, grid, 2)
    assert new == GridSpec(1.0, 2.0, 3)
    assert {(r["x1_interval"], r["count"]) for r in coarse.collect()} == {("[0, 2)", 3.0), ("[4, 6)", 4.0)}
    assert sp.to_distributions(coarse, new).first()["probs"] == [3 / 7, 0.0, 4 / 7]


def test_sample_keeps_whole_vehicles(spark):
    df = frame(spark, *[(f"V{i % 50}", 1, f"[{i}, {i + 1})", 1.0) for i in range(500)])
    part = sp.sample_fleet(df, 1, 3)
    rows = part.groupBy("vin").count().collect()
    assert 0 < len(rows) < 50 and all(r["count"] == 10 for r in rows)
    assert sp.sample_fleet(df, 3, 3).count() == 500


def test_build_spectrum_weighted(spark):
    df = spark.createDataFrame(
        [("A", 12.0, 2.0), ("A", 19.9, 3.0), ("A", -0.1, 1.0), ("A", None, 9.0), (None, 1.0, 1.0)],
        "vin string, signal double, km double",
    )
    rows = sp.build_spectrum(df, 10.0, weight=F.col("km")).collect()
    assert {(r["x1_interval"], r["count"]) for r in rows} == {("[10, 20)", 5.0), ("[-10, 0)", 1.0)}


def test_missing_columns_are_named(spark):
    short = spark.createDataFrame([("A", 1)], "vin string, sales_group int")
    with pytest.raises(ValueError, match="x1_interval, count"):
        sp.binned(short, GRADIENT_GRID)


def test_a_long_grid_is_looked_up_by_arithmetic(spark):
    grid = GridSpec(0.5, 1.0, 2_000_000_000)
    df = spark.createDataFrame([(0.5,), (1e9 + 0.5,), (7.25,), (-0.5,), (2e9 + 0.5,)], "c double")
    got = [r[0] for r in df.select(grid.position_of("c")).collect()]
    assert got == [1, 1_000_000_001, None, None, None]


def test_distributions_are_hashed_once(spark):
    rows = spark.createDataFrame([("A", 1, "(1, 2]", 1.0)], "vin string, sales_group int, x1_interval string, count double")
    plan = sp.to_distributions(rows, GRADIENT_GRID)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
