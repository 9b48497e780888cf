"""From spectra (one row per vehicle and interval) to distributions (one row per vehicle)."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.functions.intervals import bin_center, interval_text, is_finite
from fleetspectra.operators.grid import Axis, GridSpec

# Task functions travel whole, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

SPECTRUM_COLUMNS = ("vin", "sales_group", "x1_interval", "count")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Return ``df`` unchanged, or raise ``ValueError`` naming the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def remove_outliers(spectra: DataFrame, outliers: DataFrame) -> DataFrame:
    """Rows whose vin is neither NULL nor in the outlier list."""
    listed = outliers.select("vin")
    return spectra.where(F.col("vin").isNotNull()).join(listed, "vin", "left_anti")


def with_centers(spectra: DataFrame, strict: bool = False) -> DataFrame:
    return spectra.withColumn("bin_center", bin_center("x1_interval", strict))


def _mass() -> Column:
    return F.when(is_finite("count"), F.col("count"))


def binned(spectra: DataFrame, grid: GridSpec | Axis, tolerance: float = 0.0) -> DataFrame:
    """Summed count per (vin, bin), on-grid bins only: ``vin, bin, mass, sg_low, sg_high``."""
    require_columns(spectra, *SPECTRUM_COLUMNS)
    if isinstance(grid, Axis):
        return grid.number(binned(spectra, grid.grid, tolerance))
    return (
        spectra.where(F.col("vin").isNotNull())
        .select(
            "vin",
            "sales_group",
            grid.position_of(bin_center("x1_interval"), tolerance).alias("position"),
            _mass().alias("mass"),
        )
        .where(F.col("position") > 0)
        # The input has a row per (vin, bin) already, so nothing is lost by hashing it by vin alone; all
        # groupings and windows per vehicle then stay where they are.
        .repartition("vin")
        .groupBy("vin", (F.col("position") - 1).alias("bin"))
        .agg(
            F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass"),
            F.min("sales_group").alias("sg_low"),
            F.max("sales_group").alias("sg_high"),
        )
    )


def to_distributions(
    spectra: DataFrame, grid: GridSpec | Axis, tolerance: float = 0.0, check_groups: bool = True
) -> DataFrame:
    """One row per vehicle with mass on the grid: ``vin, sales_group, probs, cdf``.

    A vehicle found in two sales groups raises at run time unless ``check_groups`` is off, in which
    case its lowest group is kept. A group here is one vehicle and holds at most ``grid.n`` rows.
    """
    cells = (
        _running_shares(binned(spectra, grid, tolerance), grid.n)
        .groupBy("vin")
        .agg(
            _one_group(check_groups).alias("sales_group"),
            F.sort_array(F.collect_list(F.struct("bin", "p", "cdf", "reach"))).alias("cells"),
        )
    )
    # Zeros before the first occupied bin, then each bin followed by its gap: zeros or a plateau.
    lead_in = F.array(F.array_repeat(F.lit(0.0), F.get("cells", F.lit(0))["bin"]))
    masses = F.transform(
        "cells",
        lambda c: F.concat(F.array(c["p"]), F.array_repeat(F.lit(0.0), c["reach"] - 1)),
    )
    levels = F.transform("cells", lambda c: F.array_repeat(c["cdf"], c["reach"]))
    return cells.select(
        "vin",
        "sales_group",
        F.flatten(F.concat(lead_in, masses)).alias("probs"),
        F.flatten(F.concat(lead_in, levels)).alias("cdf"),
    )


def smoothed_distributions(rows: DataFrame, grid: GridSpec, weights: Sequence[float]) -> DataFrame:
    """``to_distributions`` of ``binned`` rows whose masses are spread over the bins around them by ``weights``.

    Of an odd number of weights the middle one stays in the bin; what leaves the grid is lost. A vehicle stays one
    row, spread by NumPy with others, and is not taken apart into a row per bin and weight.
    """
    cells = rows.groupBy("vin").agg(
        F.min("sg_low").alias("low"), F.max("sg_low").alias("high"), F.collect_list(F.struct("bin", "mass")).alias("cells")
    )
    clash = F.raise_error(F.concat(F.lit("several sales groups for vin "), F.col("vin")))
    group = F.when(F.col("low") < F.col("high"), clash.cast("int")).otherwise(F.col("low"))
    reach, n_bins = len(weights) // 2, grid.n
    # Mass in bin i adds a row of this to the vehicle's bins.
    band = np.zeros((n_bins, n_bins))
    for o, w in zip(range(-reach, reach + 1), weights):
        band += np.diag(np.full(max(0, n_bins - abs(o)), float(w)), o) if abs(o) < n_bins else 0.0

    def lists(values: np.ndarray) -> pa.ListArray:
        offsets = np.arange(0, values.size + 1, n_bins, dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("cells")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            flat = column.flatten()
            bins, own = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("bin", "mass"))
            mass = np.bincount(owner * n_bins + bins.astype(np.int64), own, minlength=batch.num_rows * n_bins)
            mass = mass.reshape(-1, n_bins) @ band
            running = mass.cumsum(axis=1)
            kept = np.flatnonzero(running[:, -1] > 0)
            mass, running = mass[kept], running[kept]
            # The last value of the running sum is the total, so the last share is 1.
            total = running[:, -1:]
            yield pa.RecordBatch.from_pydict(
                {
                    "vin": batch.column("vin").take(pa.array(kept)),
                    "sales_group": batch.column("sales_group").take(pa.array(kept)),
                    "probs": lists(mass / total),
                    "cdf": lists(running / total),
                }
            )

    plain = cells.select("vin", group.alias("sales_group"), "cells")
    return plain.mapInArrow(run, "vin string, sales_group int, probs array<double>, cdf array<double>")


def _one_group(check: bool) -> Column:
    low, high = F.min("sg_low"), F.max("sg_high")
    if not check:
        return low
    clash = F.raise_error(F.concat(F.lit("several sales groups for vin "), F.col("vin")))
    return F.when(low < high, clash.cast("int")).otherwise(low)


def sparse_distributions(spectra: DataFrame, check_groups: bool = True) -> DataFrame:
    """Distributions without any grid: ``vin, sales_group, cells`` of vehicles with mass.

    ``cells`` are the occupied centers, ascending, with each one's share and the share up to it: structs
    ``center, p, cdf``. Their number is that of a vehicle's own intervals, wherever these lie.
    """
    require_columns(spectra, *SPECTRUM_COLUMNS)
    center = bin_center("x1_interval")
    rows = (
        spectra.where(F.col("vin").isNotNull())
        .select("vin", "sales_group", center.alias("center"), _mass().alias("mass"))
        .where(is_finite("center"))
        .repartition("vin")
        .groupBy("vin", "center")
        .agg(
            F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass"),
            F.min("sales_group").alias("sg_low"),
            F.max("sales_group").alias("sg_high"),
        )
    )
    ordered = W.partitionBy("vin").orderBy("center")
    running = F.sum("mass").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("mass").over(W.partitionBy("vin"))
    shares = rows.select("*", total.alias("total"), running.alias("running")).where("total > 0")
    # Whole at the last center, whatever the order of summing made of it: gaps may be wide.
    last = F.lead("center").over(ordered).isNull()
    shares = shares.withColumn("cdf", F.when(last, 1.0).otherwise(F.col("running") / F.col("total")))
    cell = F.struct("center", (F.col("mass") / F.col("total")).alias("p"), "cdf")
    return shares.groupBy("vin").agg(
        _one_group(check_groups).alias("sales_group"), F.sort_array(F.collect_list(cell)).alias("cells")
    )


def _running_shares(rows: DataFrame, n: int) -> DataFrame:
    """Add ``p``, ``cdf`` and ``reach`` (bins up to the next occupied one, or the end).

    The windows and the later grouping by vin share one hash distribution.
    """
    ordered = W.partitionBy("vin").orderBy("bin")
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.select(
            "*",
            F.sum("mass").over(W.partitionBy("vin")).alias("total"),
            F.sum("mass").over(running).alias("running"),
            F.lead("bin").over(ordered).isNull().alias("last"),
            (F.coalesce(F.lead("bin").over(ordered), F.lit(n)) - F.col("bin")).alias("reach"),
        )
        .where(F.col("total") > 0)
        .withColumn("p", F.col("mass") / F.col("total"))
        # Whole at the last bin, whatever the order of summing made of it: widths may be large.
        .withColumn("cdf", F.when(F.col("last"), 1.0).otherwise(F.col("running") / F.col("total")))
    )


def long_form(dists: DataFrame, grid: GridSpec | Axis) -> DataFrame:
    """Dense rows ``vin, bin, bin_center, p, cdf``."""
    return dists.select(
        "vin", F.posexplode(F.arrays_zip("probs", "cdf")).alias("bin", "pc")
    ).select(
        "vin",
        "bin",
        grid.center_of("bin").alias("bin_center"),
        F.col("pc.probs").alias("p"),
        F.col("pc.cdf").alias("cdf"),
    )


def cdf_by_window(spectra: DataFrame, grid: GridSpec) -> DataFrame:
    """Running share over a vehicle's occupied bins: ``vin, bin, p, cdf, gap``.

    ``gap`` is the way to the next occupied bin, and one step after the last.
    """
    rows = _running_shares(binned(spectra, grid), grid.n)
    ordered = W.partitionBy("vin").orderBy("bin")
    step = F.coalesce(F.lead("bin").over(ordered) - F.col("bin"), F.lit(1))
    return rows.select("vin", "bin", "p", "cdf", (step * F.lit(grid.step)).alias("gap"))


def pivot_wide(spectra: DataFrame, grid: GridSpec) -> DataFrame:
    """One column of summed counts per grid bin, ``b0 ... b{n-1}``, absent = 0."""
    rows = binned(spectra, grid).select("vin", F.concat(F.lit("b"), "bin").alias("name"), "mass")
    names = [f"b{i}" for i in range(grid.n)]
    return rows.groupBy("vin").pivot("name", names).sum("mass").na.fill(0.0)


def zero_mass(spectra: DataFrame, grid: GridSpec) -> DataFrame:
    """Vehicles without any mass on the grid: ``vin, total`` with the total over all bins."""
    on_grid = F.when(grid.position_of(bin_center("x1_interval")) > 0, _mass())
    return (
        spectra.where(F.col("vin").isNotNull())
        .groupBy("vin")
        .agg(
            F.coalesce(F.sum(_mass()), F.lit(0.0)).alias("total"),
            F.coalesce(F.sum(on_grid), F.lit(0.0)).alias("kept"),
        )
        .where(F.col("kept") <= 0)
        .select("vin", "total")
    )


def dropped_mass(spectra: DataFrame, grid: GridSpec) -> DataFrame:
    """One row: total count, count kept on the grid, and the share lost by truncation."""
    on_grid = F.when(grid.position_of(bin_center("x1_interval")) > 0, _mass())
    return (
        spectra.where(F.col("vin").isNotNull())
        .agg(F.sum(_mass()).alias("total"), F.coalesce(F.sum(on_grid), F.lit(0.0)).alias("kept"))
        .withColumn("dropped_share", F.try_divide(F.col("total") - F.col("kept"), F.col("total")))
    )


def group_conflicts(spectra: DataFrame) -> DataFrame:
    """Vehicles listed under more than one sales group."""
    return (
        spectra.where(F.col("vin").isNotNull())
        .groupBy("vin")
        .agg(F.count_distinct("sales_group").alias("n_groups"))
        .where(F.col("n_groups") > 1)
    )


def audit(spectra: DataFrame, outliers: DataFrame, grid: GridSpec | Axis) -> DataFrame:
    """One row on a run: ``n_raw, n_outliers, n_cleaned, n_zero_mass, n_group_conflicts, total, kept,
    dropped_share``.

    Vehicles in the spectra, in the outlier list and left after it; of those left, vehicles without mass on
    the grid or with several sales groups, their count in all and on the grid, and the share lost. Each
    table is read once and grouped by vin once; distinct counts need no expansion, as rows are vehicles then.
    """
    whole = grid.grid if isinstance(grid, Axis) else grid
    on_grid = F.when(whole.position_of(bin_center("x1_interval")) > 0, _mass())
    vehicles = (
        spectra.where(F.col("vin").isNotNull())
        .groupBy("vin")
        .agg(
            F.coalesce(F.sum(_mass()), F.lit(0.0)).alias("total"),
            F.coalesce(F.sum(on_grid), F.lit(0.0)).alias("kept"),
            (F.min("sales_group") < F.max("sales_group")).alias("conflict"),
        )
    )
    listed = outliers.select("vin").where(F.col("vin").isNotNull()).distinct().withColumn("listed", F.lit(True))
    # Rows here are whole vehicles, so all counts follow from one pass over them.
    seen = F.col("total").isNotNull()
    clean = seen & F.col("listed").isNull()
    row = vehicles.join(listed, "vin", "full").agg(
        F.count_if(seen).alias("n_raw"),
        F.count("listed").alias("n_outliers"),
        F.count_if(clean).alias("n_cleaned"),
        F.count_if(clean & (F.col("kept") <= 0)).alias("n_zero_mass"),
        F.count_if(clean & F.col("conflict")).alias("n_group_conflicts"),
        F.sum(F.when(clean, F.col("total"))).alias("total"),
        F.sum(F.when(clean, F.col("kept"))).alias("kept"),
    )
    return row.withColumn("dropped_share", F.try_divide(F.col("total") - F.col("kept"), F.col("total")))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Distinct vehicles per named stage, as rows ``stage, n_vehicles``."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count_distinct("vin").alias("n_vehicles")).select(
            F.lit(name).alias("stage"), "n_vehicles"
        )
        out = row if out is None else out.unionByName(row)
    return out


def rebin(spectra: DataFrame, grid: GridSpec, factor: int) -> tuple[DataFrame, GridSpec]:
    """Merge every ``factor`` neighbouring bins. Gives the coarser long spectrum and its grid."""
    coarse = GridSpec(
        grid.first + grid.step * (factor - 1) / 2,
        grid.step * factor,
        -(-grid.n // factor),
    )
    rows = (
        binned(spectra, grid)
        .groupBy("vin", F.floor(F.col("bin") / factor).cast("int").alias("bin"))
        .agg(F.sum("mass").alias("count"), F.min("sg_low").alias("sales_group"))
    )
    text = interval_text(coarse.center_of("bin") - coarse.step / 2, coarse.step)
    return rows.select("vin", "sales_group", text.alias("x1_interval"), "count"), coarse


def sample_fleet(df: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """A repeatable share of the vehicles, with all rows of each: decided by a hash of the vin."""
    bucket = F.conv(F.substring(F.md5("vin"), 1, 8), 16, 10).cast("bigint") % denominator
    return df.where(bucket < numerator)


def filter_by_dimension(df: DataFrame, dimension: DataFrame, **wanted: str) -> DataFrame:
    """Vehicles whose dimension row has the stated values, e.g. ``region="EUROPE"``."""
    dim = dimension
    for name, value in wanted.items():
        dim = dim.where(F.col(name) == F.lit(value))
    return df.join(dim.select("vin"), "vin", "left_semi")


def build_spectrum(
    samples: DataFrame, step: float, signal: str = "signal", weight: Column | None = None
) -> DataFrame:
    """Raw samples ``vin, [sales_group], signal`` to the long spectrum."""
    keys = [c for c in ("vin", "sales_group") if c in samples.columns]
    amount = F.lit(1.0) if weight is None else weight
    lo = F.floor(F.col(signal) / F.lit(step)) * F.lit(step)
    text = interval_text(lo, step)
    return (
        samples.where(F.col("vin").isNotNull() & is_finite(signal))
        .groupBy(*keys, text.alias("x1_interval"))
        .agg(F.sum(amount).alias("count"))
    )
