from collections import Counter

from pyspark.sql import functions as F

from fleetspectra.operators import fleet as fl
from fleetspectra.plans import flows

# Per signal: first lower edge, step, and the peak bin of each kind of vehicle.
SHAPES = {
    "velocity": (0, 1, (15, 40, 75)),
    "weight": (12000, 1000, (8, 28)),
    "gradient": (0, 1, (2, 7)),
}
KINDS = {"velocity": ("Low", "Medium", "High"), "weight": ("Low", "High"), "gradient": ("Flat", "Hilly")}


def kind_of(i: int, signal: str) -> int:
    return {"velocity": i % 3, "weight": i // 3 % 2, "gradient": i // 6 % 2}[signal]


def spectrum(spark, signal, n=60):
    first, step, peaks = SHAPES[signal]
    rows = []
    for i in range(n):
        peak = peaks[kind_of(i, signal)]
        for b in range(peak - 2, peak + 3):
            lo = first + b * step
            count = (3.0 - abs(b - peak)) * (1 + (13 * i + 7 * b) % 20 / 20 + i / 100)
            rows.append((f"V{i:04d}", i % 2 + 1, f"[{lo}, {lo + step})", count))
    rows.append(("V9999", 1, f"[{first}, {first + step})", 1.0))
    return spark.createDataFrame(rows, "vin string, sales_group int, x1_interval string, count double")


def test_three_signals_to_kpis(spark):
    outliers = spark.createDataFrame([("V9999",)], "vin string")
    labelled = {}
    for signal in fl.SIGNALS:
        found = flows.cluster_signal(spectrum(spark, signal), outliers, signal)
        assert found.medoids.converged and found.medoids.k == len(KINDS[signal])
        assert (found.scores is None) == (signal != "weight")
        assert found.clusters.columns == ["vin", "sales_group", "cluster_wasserstein"]
        labelled[signal] = flows.label_signal(found)
        texts = {r["vin"]: r[f"cluster_{signal}_text"] for r in labelled[signal].collect()}
        assert texts == {f"V{i:04d}": KINDS[signal][kind_of(i, signal)] for i in range(60)}
    stats = spark.createDataFrame(
        [(f"V{i:04d}", i % 2 + 1, 1.0 * i, 2.0 * i, 3.0, 4.0) for i in range(60)],
        "vin string, sales_group int, vehicle_speed_avg_driving_kmh double, gc_weight_avg_kg double, "
        "stddev_road_gradient double, fuel_cons_driving_l_per_100km double",
    )
    table = flows.combine(labelled, stats)
    rows = fl.kpi_crosstab(table).collect()
    assert len(rows) == 24
    want = Counter(
        (i % 2 + 1, *(KINDS[s][kind_of(i, s)] for s in ("velocity", "gradient", "weight")))
        for i in range(60)
    )
    got = {(r["sales_group"], r["velocity"], r["gradient"], r["weight"]): r["n_vehicles"] for r in rows}
    assert all(got[key] == want[key] for key in got) and sum(got.values()) == 60


def test_joint_distributions_add_up(spark):
    outliers = spark.createDataFrame([], "vin string")
    parts = {
        s: flows.signal_distributions(spectrum(spark, s), outliers, s)[0]
        for s in ("weight", "gradient")
    }
    joint = flows.joint_distributions({"weight": (parts["weight"], 1.0), "gradient": (parts["gradient"], 2.0)})
    row = joint.where(F.col("vin") == "V0000").first()
    assert len(row["cdf"]) == 48 and row["cdf"][37] == 1.0 and row["cdf"][-1] == 2.0


def test_given_names_win(spark):
    outliers = spark.createDataFrame([("V9999",)], "vin string")
    codes = flows.cluster_signal(spectrum(spark, "weight"), outliers, "weight", 2).clusters
    named = fl.apply_labels(codes, "weight", {0: "Heavy", 1: "Light"})
    assert {r[0] for r in named.select("cluster_weight_text").distinct().collect()} == {"Heavy", "Light"}
