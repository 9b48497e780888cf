"""Build spectra from a stream.

Spectra add up, so no state is kept: every micro-batch appends its own partial spectrum, and a reader
sums the partials. A batch writes into a folder named by its number, so a batch replayed after a failure
overwrites its own output and nothing is counted twice.

``compact`` folds the batches written so far into one base, named by the last batch in it. A base counts once
it is whole; only then do its parts go. Readers take the newest whole base and the batches after it, and
a batch that is replayed after it went into a base is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetspectra.operators.grid import Axis, GridSpec
from fleetspectra.operators.spectra import build_spectrum, to_distributions
from fleetspectra.sources.tables import children, discard, exists, shared_folder


def start_spectrum_stream(
    samples: DataFrame, target: str, checkpoint: str, step: float, signal: str = "signal"
) -> StreamingQuery:
    """Write partial spectra of a streaming frame ``vin, signal`` until its source is drained."""

    def write_partial(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= _parts(spark, target)[0]:
            return
        part = build_spectrum(batch, step, signal)
        part.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        samples.writeStream.foreachBatch(write_partial)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _parts(spark: SparkSession, target: str) -> tuple[int, list[int]]:
    """The last batch of the newest whole base (-1 without one), and the batches after it."""
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for name in children(spark, target):
        kind, _, number = name.partition("=")
        if kind in found and exists(spark, f"{target}/{name}/_SUCCESS"):
            found[kind].append(int(number))
    base = max(found["base"], default=-1)
    return base, sorted(b for b in found["batch"] if b > base)


def _summed(rows: DataFrame) -> DataFrame:
    keys = [c for c in ("vin", "sales_group", "x1_interval") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.sum("count").alias("count"))


def read_spectrum(spark: SparkSession, target: str) -> DataFrame:
    """The spectrum as of the batches written so far."""
    base, later = _parts(spark, target)
    paths = [f"{target}/base={base}"] if base >= 0 else []
    return _summed(spark.read.parquet(*paths, *[f"{target}/batch={b}" for b in later]))


def compact(spark: SparkSession, target: str) -> int:
    """Fold all batches so far into one base; returns the last batch in it, or -1 if there is none.

    May be repeated after a failure at any point: a base without its mark of success is written again, and
    parts that a whole base holds are read by no one.
    """
    base, later = _parts(spark, target)
    if later:
        base_new = later[-1]
        whole = read_spectrum(spark, target)
        whole.write.mode("overwrite").parquet(f"{target}/base={base_new}")
        base = base_new
    for name in children(spark, target):
        kind, _, number = name.partition("=")
        stale = (kind == "base" and int(number) < base) or (kind == "batch" and int(number) <= base)
        if stale:
            discard(spark, f"{target}/{name}")
    return base


def changed_vehicles(spark: SparkSession, target: str, since: int) -> DataFrame:
    """``vin`` of the vehicles in batches after ``since``; all of them if a base has gone beyond it."""
    base, later = _parts(spark, target)
    if since < base:
        return read_spectrum(spark, target).select("vin").distinct()
    paths = [f"{target}/batch={b}" for b in later if b > since]
    if not paths:
        return read_spectrum(spark, target).select("vin").where(F.lit(False))
    return spark.read.parquet(*paths).select("vin").distinct()


def refreshed_distributions(
    spark: SparkSession, target: str, known: DataFrame, since: int, grid: GridSpec | Axis
) -> DataFrame:
    """``known`` distributions as of batch ``since``, with those of vehicles that changed made anew.

    All others are passed on as they are; the new ones come from the rows of changed vehicles alone.
    """
    changed = changed_vehicles(spark, target, since)
    rows = read_spectrum(spark, target).join(changed, "vin", "left_semi")
    fresh = to_distributions(rows, grid)
    return known.join(changed, "vin", "left_anti").unionByName(fresh.select(*known.columns))


def spectrum_of_files(
    spark: SparkSession,
    folder: str,
    to_samples: Callable[[DataFrame], DataFrame],
    step: float,
    pattern: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """Drain a folder's parquet files through the stream; ``to_samples`` gives ``vin, signal``."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = start_spectrum_stream(to_samples(stream), f"{base}/rows", f"{base}/progress", step)
    query.awaitTermination()
    return read_spectrum(spark, f"{base}/rows")
