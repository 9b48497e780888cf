"""Sub-populations of the fleet: labels, joins, shares and KPI cross-tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNALS = ("velocity", "weight", "gradient")

# Cluster code to text, as (label, display label).
LABELS = {
    "velocity": {0: ("Medium", "Medium"), 1: ("High", "High"), 2: ("Low", "Low")},
    "weight": {0: ("High", "High Weight"), 1: ("Low", "Low Weight")},
    "gradient": {0: ("Hilly", "Hilly Road"), 1: ("Flat", "Flat Road")},
}
# Order of rows and columns in the KPI cross-table.
CELL_ORDER = {
    "velocity": ("High", "Medium", "Low"),
    "gradient": ("Hilly", "Flat"),
    "weight": ("High", "Low"),
}
# Statistics column to KPI column.
KPIS = {
    "vehicle_speed_avg_driving_kmh": "avg_speed",
    "gc_weight_avg_kg": "avg_weight",
    "stddev_road_gradient": "avg_gradient_std",
    "fuel_cons_driving_l_per_100km": "avg_fuel",
}


def label_map(spark: SparkSession, labels: dict = LABELS) -> DataFrame:
    """The label map as rows ``signal, cluster, label, display_label``."""
    rows = [
        (signal, code, label, display)
        for signal, codes in labels.items()
        for code, (label, display) in codes.items()
    ]
    return spark.createDataFrame(
        rows, "signal string, cluster int, label string, display_label string"
    )


def label_text(code: Column, names: dict[int, str]) -> Column:
    """Text for a cluster code; NULL for a code without a name."""
    out = F
    for number, name in names.items():
        out = out.when(code == number, F.lit(name))
    return out if names else F.lit(None).cast("string")


def apply_labels(clusters: DataFrame, signal: str, names: dict[int, str] | None = None) -> DataFrame:
    """Rename the cluster column for its signal and add the label text."""
    if names is None:
        names = {code: label for code, (label, _) in LABELS[signal].items()}
    renamed = clusters.withColumnRenamed("cluster_wasserstein", f"cluster_wasserstein_{signal}")
    code = F.col(f"cluster_wasserstein_{signal}")
    return renamed.withColumn(f"cluster_{signal}_text", label_text(code, names))


def unmapped(labelled: DataFrame, signal: str) -> DataFrame:
    """Cluster codes that got no label, with their vehicle counts."""
    return (
        labelled.where(F.col(f"cluster_{signal}_text").isNull())
        .groupBy(F.col(f"cluster_wasserstein_{signal}").alias("cluster"))
        .agg(F.count("vin").alias("n_vehicles"))
    )


def union_stats(tables: dict[int, DataFrame], allow_missing: bool = False) -> DataFrame:
    """Statistics tables tagged with their sales group and united by column name."""
    tagged = [df.withColumn("sales_group", F.lit(n)) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), tagged)


def join_subpopulations(
    velocity: DataFrame, weight: DataFrame, gradient: DataFrame, stats: DataFrame | None = None
) -> DataFrame:
    """Labelled cluster tables of the three signals joined per vehicle, optionally with statistics.

    A vehicle absent from any table is left out. The joins are on the vin, by which the tables are
    hashed already; sales groups are compared.
    """
    out = velocity
    # Said so that the optimizer does not make the group a second join key: tables that are dealt by vin
    # alone would be shuffled for it.
    same_group = F.array_contains(F.array("_group"), F.col("sales_group"))
    for side in (weight, gradient, *([] if stats is None else [stats])):
        other = side.withColumnRenamed("sales_group", "_group")
        out = out.join(other, "vin").where(same_group).drop("_group")
    return out


def vehicles_per_group(df: DataFrame) -> DataFrame:
    return df.groupBy("sales_group").agg(F.count("vin").alias("num_vins"))


def of_group(df: DataFrame, sales_group: int) -> DataFrame:
    return df.where(F.col("sales_group") == F.lit(sales_group))


def kpi_crosstab(
    subpop: DataFrame, sales_group: int | None = None, kpis: dict[str, str] = KPIS
) -> DataFrame:
    """Vehicle count and KPI means per sub-population: 12 rows for each sales group.

    Vehicles that lack a label text stand in one more row of their sales group, with NULL for all three
    signals, so that the counts add up to the joined fleet. An empty cell has count 0 and NULL means. NULL and NaN statistics are left out of a mean. The fleet
    is read and aggregated once; the empty cells are filled in from each group's short list of cells.
    """
    rows = subpop if sales_group is None else of_group(subpop, sales_group)
    texts = {s: F.col(f"cluster_{s}_text") for s in CELL_ORDER}
    named = reduce(
        lambda a, b: a & b, [texts[s].isin(*CELL_ORDER[s]) & texts[s].isNotNull() for s in CELL_ORDER]
    )
    signals = {s: F.when(named, t).alias(s) for s, t in texts.items()}
    cells = rows.groupBy("sales_group", *signals.values()).agg(
        F.count("*").alias("n_vehicles"),
        *[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(a) for c, a in kpis.items()],
    )
    found = F.collect_list(F.struct(*signals, "n_vehicles", *kpis.values())).alias("found")
    if sales_group is None:
        groups = cells.groupBy("sales_group").agg(found)
    else:
        groups = cells.agg(found).withColumn("sales_group", F.lit(sales_group))
    whole = F.array(
        *[
            F.struct(*[F.lit(n).alias(s) for s, n in zip(CELL_ORDER, names)])
            for names in product(*CELL_ORDER.values())
        ]
    )
    rest = F.filter("found", lambda c: c["velocity"].isNull())
    unnamed = F.transform(rest, lambda c: F.struct(*[c[s].alias(s) for s in CELL_ORDER]))
    groups = groups.withColumn("place", F.explode(F.concat(whole, unnamed))).select(
        "sales_group", "found", "place.*"
    )

    def in_cell(cell: Column) -> Column:
        return reduce(lambda a, b: a & b, [cell[s].eqNullSafe(F.col(s)) for s in CELL_ORDER])

    hit = groups.withColumn("hit", F.get(F.filter("found", in_cell), F.lit(0)))
    return hit.select(
        "sales_group",
        *CELL_ORDER,
        F.coalesce("hit.n_vehicles", F.lit(0).cast("bigint")).alias("n_vehicles"),
        *[F.col(f"hit.{a}").alias(a) for a in kpis.values()],
    )


def decimal_text(value: Column, digits: int) -> Column:
    """A number as text with a fixed number of decimals; NULL stays NULL."""
    text = F.format_string(f"%.{digits}f", F.round(value, digits))
    return F.when(value.isNotNull(), text)


def display_cell(gradient: Column, weight: Column) -> Column:
    """Heading of a cross-table column: gradient over weight, in display text."""

    def shown(col: Column, signal: str) -> Column:
        return F.coalesce(
            *[F.when(col == label, F.lit(text)) for label, text in LABELS[signal].values()]
        )

    return F.concat_ws("\n", shown(gradient, "gradient"), shown(weight, "weight"))


def kpi_matrix(crosstab: DataFrame, metric: str) -> DataFrame:
    """One metric of the cross-table pivoted to a row per velocity and a column per cell."""
    names = [f"{g}_{w}" for g in CELL_ORDER["gradient"] for w in CELL_ORDER["weight"]]
    return (
        crosstab.withColumn("cell", F.concat_ws("_", "gradient", "weight"))
        .groupBy("sales_group", "velocity")
        .pivot("cell", names)
        .agg(F.first(metric))
    )


def kpi_text(crosstab: DataFrame, kpis: dict[str, str] = KPIS) -> DataFrame:
    """KPIs as one-decimal text with a mask for empty ones."""
    return crosstab.select(
        "sales_group",
        "velocity",
        display_cell(F.col("gradient"), F.col("weight")).alias("cell"),
        *[decimal_text(F.col(a), 1).alias(f"{a}_text") for a in kpis.values()],
        *[F.isnull(a).alias(f"{a}_masked") for a in kpis.values()],
    )


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_wasserstein").agg(F.count("*").alias("n_vehicles"))


def crosstab(clusters: DataFrame, groups: Sequence[int]) -> DataFrame:
    """Vehicles per cluster (rows) and sales group (columns ``sg_1`` ...), absent pairs 0."""
    tagged = clusters.withColumn("sg", F.concat(F.lit("sg_"), F.col("sales_group")))
    return (
        tagged.groupBy("cluster_wasserstein")
        .pivot("sg", [f"sg_{g}" for g in groups])
        .agg(F.count("vin"))
        .na.fill(0)
    )


def sorted_groups(clusters: DataFrame) -> DataFrame:
    return clusters.select("sales_group").distinct().orderBy("sales_group")


def cluster_share(
    clusters: DataFrame, codes: Iterable[int], groups: Sequence[int] | None = None, digits: int = 1
) -> DataFrame:
    """Count and percent of every cluster code inside each sales group, absent codes 0.

    With ``groups`` only those, numbered by ``position`` in the stated order.
    """
    codes = list(codes)
    counted = clusters
    if groups is not None:
        counted = counted.where(F.col("sales_group").isin(list(groups)))
    per_group = counted.groupBy("sales_group").agg(
        *[F.count_if(F.col("cluster_wasserstein") == c).alias(f"n_{c}") for c in codes]
    )
    total = reduce(lambda a, b: a + b, [F.col(f"n_{c}") for c in codes])
    rows = F.array(
        *[F.struct(F.lit(c).alias("cluster"), F.col(f"n_{c}").alias("n_vehicles")) for c in codes]
    )
    out = per_group.select("sales_group", total.alias("total"), F.inline(rows))
    share = F.round(F.try_divide(100.0 * F.col("n_vehicles"), F.col("total")), digits)
    out = out.select(
        "sales_group",
        "cluster",
        "n_vehicles",
        share.alias("percent"),
        F.concat(decimal_text(share, digits), F.lit("%")).alias("percent_text"),
    )
    if groups is None:
        return out
    order = F.array(*[F.lit(g) for g in groups])
    return out.withColumn("position", F.array_position(order, F.col("sales_group")).cast("int"))


def configuration_fit(subpop: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of vehicles over-, under- or well-dimensioned, per sales group.

    ``expected`` gives each sales group the demand rank it is built for. A vehicle's own demand is
    the number of its heavy and hilly labels.
    """
    demand = (
        F.when(F.col("cluster_weight_text") == "High", 1).otherwise(0)
        + F.when(F.col("cluster_gradient_text") == "Hilly", 1).otherwise(0)
    )
    fit = (
        F.when(F.col("expected_rank") > F.col("demand"), "over")
        .when(F.col("expected_rank") < F.col("demand"), "under")
        .otherwise("match")
    )
    # At most three rows per sales group meet the expectations.
    counted = subpop.groupBy("sales_group", demand.alias("demand")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return (
        counted.join(expected.select("sales_group", "expected_rank"), "sales_group")
        .groupBy("sales_group")
        .agg(
            total.alias("n_vehicles"),
            *[
                F.round(
                    100.0 * F.coalesce(F.sum(F.when(fit == name, F.col("n"))), F.lit(0)) / total, 1
                ).alias(f"{name}_percent")
                for name in ("over", "under", "match")
            ],
        )
    )
