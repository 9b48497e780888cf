"""Vehicle usage derived from order tables: the inputs of the registered queries and the benchmark.

A vehicle is a customer (or, for the full distance matrix, a supplier; for the zero-mass report, an
order). Quantity stands for velocity, price for weight and discount for gradient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspectra.functions.intervals import interval_text

# Lower edge of a line's interval and interval width, per signal.
_EDGES = {
    "velocity": (lambda: F.floor("l_quantity"), 1),
    "weight": (lambda: F.floor(F.col("l_extendedprice") / 1000) * 1000, 1000),
    "gradient": (lambda: F.round(F.col("l_discount") * 100).cast("bigint"), 1),
}
_KEYS = {"V": "o_custkey", "S": "l_suppkey", "O": "l_orderkey"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vin_of(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.lpad(F.col(key).cast("string"), 8, "0"))


def usage(spark: SparkSession, folder: str, entity: str = "V") -> DataFrame:
    """One row per line item with its vehicle. Only customers need the join with orders."""
    lines = table(spark, folder, "lineitem")
    if entity == "V":
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
        lines = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    key = _KEYS[entity]
    return lines.select(
        F.col(key).alias("key"),
        vin_of(entity, key).alias("vin"),
        (F.col(key) % 15 + 1).cast("int").alias("sales_group"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )


def spectra(spark: SparkSession, folder: str, signal: str, entity: str = "V") -> DataFrame:
    """``vin, sales_group, x1_interval, count`` of a signal."""
    return spectra_of(usage(spark, folder, entity), signal, entity)


def spectra_of(lines: DataFrame, signal: str, entity: str = "V") -> DataFrame:
    """The same from usage rows, grouped by number: a vin is made per interval of a vehicle, not per line."""
    edge, width = _EDGES[signal]
    # Longer numbers share vins, as these are cut; they are grouped by vin.
    number = F.when(F.col("key").between(0, 99_999_999), F.col("key"))
    text = F.when(number.isNull(), F.col("vin"))
    vin = F.coalesce("text", vin_of(entity, "number"))
    return (
        lines.groupBy(number.alias("number"), text.alias("text"), "sales_group", edge().cast("bigint").alias("lo"))
        .agg(F.count("*").cast("double").alias("count"))
        .select(vin.alias("vin"), "sales_group", interval_text(F.col("lo"), width).alias("x1_interval"), "count")
    )


def outliers(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    return customers.where(F.col("c_acctbal") < 0).select(vin_of("V", "c_custkey").alias("vin"))


def vehicle_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats_of(usage(spark, folder))


def stats_of(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy("vin", "sales_group")
        .agg(
            F.avg("l_quantity").alias("vehicle_speed_avg_driving_kmh"),
            F.avg("l_extendedprice").alias("gc_weight_avg_kg"),
            F.stddev_samp(F.col("l_discount") * 100).alias("stddev_road_gradient"),
            (F.avg(F.col("l_tax") * 100) + 25).alias("fuel_cons_driving_l_per_100km"),
            F.sum("l_quantity").alias("mileage_km"),
        )
    )


def vehicle_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Customer segment, country and region of each vehicle; nations and regions are tiny lookups."""
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    return (
        customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"])
        .join(regions, nations["n_regionkey"] == regions["r_regionkey"])
        .select(
            vin_of("V", "c_custkey").alias("vin"),
            F.col("c_mktsegment").alias("customer_segment"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
        )
    )


def raw_samples(events: DataFrame) -> DataFrame:
    """Events as raw signal samples ``vin, sales_group, signal``."""
    return events.select(
        vin_of("V", "user_id").alias("vin"),
        (F.col("user_id") % 15 + 1).cast("int").alias("sales_group"),
        F.col("value").alias("signal"),
    )
