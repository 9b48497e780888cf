"""What is kept between runs: shared folders, report tables, buckets, compacted streams, sketches."""

import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspectra.operators import fleet as fl
from fleetspectra.operators import profile as pr
from fleetspectra.operators import spectra as sp
from fleetspectra.operators.grid import WEIGHT_GRID, GridSpec
from fleetspectra.plans import queries
from fleetspectra.sources import tables
from fleetspectra.streaming import spectrum as st

DATA = "/root/testdata/sf0.001"
SPECTRUM = "vin string, sales_group int, x1_interval string, count double"


def test_a_local_warehouse_is_refused_on_a_cluster(spark):
    def context(master):
        return SimpleNamespace(master=master, _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc)

    for master in ("local", "local[4]", "local[*]"):
        tables.require_shared(context(master), "file:/tmp/warehouse")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.require_shared(context(master), "file:/tmp/warehouse")


def test_reports_follow_their_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("lineitem", "orders"):
        os.symlink(f"{DATA}/{name}.parquet", f"{folder}/{name}.parquet")
    customers = spark.read.parquet(f"{DATA}/customer.parquet")

    def write(rows):
        rows.write.mode("overwrite").parquet(f"{folder}/customer.parquet")

    write(customers.withColumn("c_acctbal", F.lit(1.0)))
    before = {r["vin"] for r in queries.codes(spark, folder, "gradient").collect()}
    again = {r["vin"] for r in queries.codes(spark, folder, "gradient").collect()}
    write(customers.withColumn("c_acctbal", F.col("c_custkey") % 2 - F.lit(0.5)))
    after = {r["vin"] for r in queries.codes(spark, folder, "gradient").collect()}
    assert before == again and after < before
    assert after == {v for v in before if int(v[1:]) % 2}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(300).select(
        F.concat(F.lit("V"), "id").alias("vin"), (F.col("id") % 3).cast("int").alias("sales_group")
    )
    signals = {}
    for name in (*fl.SIGNALS, "stats"):
        own = rows.withColumn(f"of_{name}", F.lit(name)).repartition(5)
        signals[name] = tables.save_bucketed(own, f"bucketed_{name}", f"{tmp_path}/{name}", buckets=4)
        assert len([f for f in os.listdir(tmp_path / name) if f.endswith(".parquet")]) == 4
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = fl.join_subpopulations(*[signals[s] for s in (*fl.SIGNALS, "stats")])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") >= 3 and "Exchange" not in plan
        assert joined.count() == 300
        grouped = joined.groupBy("vin").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in grouped
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_an_audit_reads_each_table_once(spark, tmp_path):
    rows = [
        ("A", 1, "[12000, 13000)", 2.0), ("A", 1, "[0, 1000)", 1.0), ("B", 1, "[0, 1000)", 4.0),
        ("C", 1, "[13000, 14000)", 1.0), ("C", 2, "[13000, 14000)", 1.0), ("D", 1, "[13000, 14000)", None),
        ("E", 1, "[13000, 14000)", 8.0), (None, 1, "[13000, 14000)", 5.0),
    ]
    spark.createDataFrame(rows, SPECTRUM).write.parquet(f"{tmp_path}/spectra")
    listed = spark.createDataFrame([("E",), ("E",), ("X",), (None,)], "vin string")
    data = spark.read.parquet(f"{tmp_path}/spectra")
    row = sp.audit(data, listed, WEIGHT_GRID)
    got = row.first().asDict()
    assert got == {
        "n_raw": 5, "n_outliers": 2, "n_cleaned": 4, "n_zero_mass": 2, "n_group_conflicts": 1,
        "total": 9.0, "kept": 4.0, "dropped_share": 5.0 / 9.0,
    }
    assert row._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    clean = sp.remove_outliers(data, listed)
    assert got["n_zero_mass"] == sp.zero_mass(clean, WEIGHT_GRID).count()
    assert got["dropped_share"] == sp.dropped_mass(clean, WEIGHT_GRID).first()["dropped_share"]
    assert sp.audit(data.where("false"), listed, WEIGHT_GRID).first()["n_raw"] == 0


def write_batch(spark, target, number, rows):
    built = sp.build_spectrum(spark.createDataFrame(rows, "vin string, sales_group int, signal double"), 1.0)
    built.write.mode("overwrite").parquet(f"{target}/batch={number}")


def counts(spark, target):
    rows = st.read_spectrum(spark, target).collect()
    return {(r["vin"], r["x1_interval"]): r["count"] for r in rows}


def test_compaction_keeps_the_spectrum(spark, tmp_path):
    target = str(tmp_path / "rows")
    assert st.compact(spark, target) == -1
    write_batch(spark, target, 0, [("A", 1, 0.5), ("B", 1, 1.5)])
    write_batch(spark, target, 1, [("A", 1, 0.5), ("C", 1, 2.5)])
    want = counts(spark, target)
    assert want == {("A", "[0, 1)"): 2.0, ("B", "[1, 2)"): 1.0, ("C", "[2, 3)"): 1.0}
    assert st.compact(spark, target) == 1 and counts(spark, target) == want
    assert tables.children(spark, target) == ["base=1"]
    # A part that came back, and a base that was not finished, change nothing.
    write_batch(spark, target, 1, [("A", 1, 0.5), ("C", 1, 2.5)])
    os.makedirs(f"{target}/base=7")
    assert counts(spark, target) == want
    write_batch(spark, target, 2, [("B", 1, 1.5)])
    want[("B", "[1, 2)")] = 2.0
    assert counts(spark, target) == want and st.compact(spark, target) == 2
    assert counts(spark, target) == want
    assert [n for n in tables.children(spark, target) if n.startswith("b") and n != "base=7"] == ["base=2"]


def test_a_stream_goes_on_after_compaction(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def feed(*rows):
        spark.createDataFrame(rows, "vin string, signal double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("vin string, signal double").parquet(source)
        st.start_spectrum_stream(stream, target, progress, 10.0).awaitTermination()

    feed(("A", 5.0), ("B", 25.0))
    assert st.compact(spark, target) == 0
    feed(("A", 6.0))
    assert counts(spark, target) == {("A", "[0, 10)"): 2.0, ("B", "[20, 30)"): 1.0}
    assert tables.children(spark, target) == ["base=0", "batch=1"]


def test_only_changed_vehicles_are_made_anew(spark, tmp_path):
    target, grid = str(tmp_path / "rows"), GridSpec(0.5, 1.0, 4)
    write_batch(spark, target, 0, [("A", 1, 0.5), ("B", 1, 1.5), ("C", 1, 2.5)])
    st.compact(spark, target)
    known = tables.materialize(sp.to_distributions(st.read_spectrum(spark, target), grid), "known")
    assert st.changed_vehicles(spark, target, 0).count() == 0
    write_batch(spark, target, 1, [("B", 1, 3.5), ("D", 2, 0.5)])
    assert {r["vin"] for r in st.changed_vehicles(spark, target, 0).collect()} == {"B", "D"}
    fresh = st.refreshed_distributions(spark, target, known, 0, grid)
    whole = sp.to_distributions(st.read_spectrum(spark, target), grid)
    assert sorted(map(repr, fresh.collect())) == sorted(map(repr, whole.collect()))
    st.compact(spark, target)
    # The batches since then are gone into a base, so every vehicle may have changed.
    assert st.changed_vehicles(spark, target, 0).count() == 4


def test_sketched_quantiles_keep_their_rank(spark):
    rng = np.random.default_rng(1)
    values = rng.exponential(50, 60_000)
    rows = [(f"V{i % 90}", float(v)) for i, v in enumerate(values)] + [("V1", None), ("V2", float("nan"))]
    samples = spark.createDataFrame(rows, "vin string, signal double").repartition(9)
    labelled = spark.createDataFrame([(f"V{i}", i % 3) for i in range(90)], "vin string, cluster int")
    parts = [pr.signal_sketches(samples.where(F.pmod(F.hash("signal"), F.lit(4)) == i), labelled) for i in range(4)]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    for r in pr.sketch_quantiles(pr.merged_sketches(both), shares).collect():
        own = np.sort(values[np.arange(len(values)) % 90 % 3 == r["cluster"]])
        assert r["n_samples"] == len(own)
        for s in shares:
            rank = np.searchsorted(own, r[f"q{round(100 * s)}"]) / len(own)
            assert abs(rank - s) <= 0.025
