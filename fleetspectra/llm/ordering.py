"""Positions of rows inside their keys, without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.llm.common import attach
from fleetspectra.sources.tables import materialize

# ``monotonically_increasing_id`` holds the partition above this many bits, the row's number below.
ROW_BITS = 33
# A table of (key, chunk) spans with at most this many rows is broadcast.
SPAN_ROWS = 20_000


def chunked(rows: DataFrame, key: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """``rows`` with ``chunk`` and ``at``, written to the shared folder.

    Rows are range-sorted by key, order and, last, a number of their own, so that also a key or a row that
    makes up a third of the table is cut. Chunks rise along the sort; ``at`` numbers a chunk's rows. Written
    out, as range bounds may differ when recomputed. ``rows`` should be narrow and cheap to read twice.
    """
    cut = F.shiftrightunsigned("_at", ROW_BITS).cast("int")
    ordered = [F.col(o) if isinstance(o, str) else o for o in order]
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    sort = [F.col(key), *ordered, F.col("_tie")]
    placed = numbered.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return materialize(
        placed.drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("chunk", cut)
        .withColumn("at", F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("_at"),
        name,
    )


def spans(chunks: DataFrame, key: str) -> DataFrame:
    """``key, chunk, first, offset, n``: where a key's rows begin in a chunk, its rows before, and in all."""
    counts = chunks.groupBy(key, "chunk").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    # A window holds a row per chunk that a key reaches into.
    whole = W.partitionBy(key)
    before = whole.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        key,
        "chunk",
        "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.sum("rows").over(whole).alias("n"),
    )


def with_positions(chunks: DataFrame, key: str, spans: DataFrame, n_spans: int) -> DataFrame:
    """``chunks`` with ``pos`` (from 0 inside the key) and what else ``spans`` has."""
    return (
        attach(chunks, spans, [key, "chunk"], n_spans, SPAN_ROWS)
        .withColumn("pos", F.col("at") - F.col("first") + F.col("offset"))
        .drop("chunk", "at", "first", "offset")
    )


def numbered(rows: DataFrame, key: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """``rows`` with ``pos`` and ``n``: the place inside the key, in the given order, and the key's rows."""
    chunks = chunked(rows, key, order, name)
    reach = materialize(spans(chunks, key), f"{name}-spans")
    return with_positions(chunks, key, reach, reach.count())
