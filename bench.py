"""Time the headline steps; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores (default 8). The
clustering steps start from written distributions, as the published and scratch numbers do; the last
two are whole queries from the raw tables.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fleetspectra.operators import cluster, distance
from fleetspectra.plans.queries import QUERIES, dense_distributions, distributions


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def run(spark, folder: str) -> dict[str, float]:
    times: dict[str, float] = {}

    def timed(name, fn):
        start = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    timed("cdf_build", lambda: drain(distributions(spark, folder, "weight")[0]))
    dists = distributions(spark, folder, "weight")[0]
    fleet = timed("write_fleet", lambda: distance.write_fleet(dists))
    timed("fleet_total_distance", lambda: drain(distance.fleet_totals(fleet)))
    timed("kmedoids_k2", lambda: drain(cluster.kmedoids(fleet, 2).labels(fleet)))
    three = timed("kmedoids_k3", lambda: cluster.kmedoids(fleet, 3))
    timed("silhouette_k3", lambda: cluster.silhouette(fleet, three.label(), 3).collect())
    dense = distance.write_fleet(dense_distributions(spark, folder))
    timed("kmedoids_dense_k3", lambda: drain(cluster.kmedoids(dense, 3).labels(dense)))
    timed("k_sweep", lambda: cluster.k_sweep(fleet)[1].collect())
    for name in ("kmedoids_labels_velocity", "kpi_crosstab_all_groups"):
        timed(name, lambda: drain(QUERIES[name](spark, folder)))
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetspectra-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up and first compilation in the JVM are not what is measured.
    with distance.write_fleet(distributions(spark, folder, "gradient")[0]) as warm:
        cluster.k_sweep(warm, (2, 3))[1].collect()
    times = run(spark, folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
