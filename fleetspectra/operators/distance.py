"""Wasserstein distances between vehicles, and exact totals without an n x n matrix.

On a grid of constant step the distance of two vehicles is the L1 distance of their cumulative
distributions, so a total over many vehicles splits by bin. For one bin, a value x and N members with
sum T, of which ``le`` values with sum ``s`` sort before or at x:

    sum |x - x_j| = x * (2 * le - N) + T - 2 * s

Members equal to x change nothing wherever they are sorted, so any order among ties will do. That lets
the sorted values be cut into slices of any size: a slice needs only counts and sums of the slices
before it, and no task ever holds more than one slice.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.functions.arrays import TIE_DECIMALS, double_array, w1
from fleetspectra.sources.tables import discard, read_back, write_aside

# Task functions travel whole, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

# A slice of sorted values aims at this many rows.
SLICE_ROWS = 500_000
# A task over whole vehicles aims at this many values.
TASK_VALUES = 4_000_000
# Tables with at most this many narrow rows are broadcast; larger ones are left to the optimizer.
BROADCAST_ROWS = 400_000


@dataclass(frozen=True)
class Fleet:
    """Distributions written to the shared folder.

    ``frame`` has ``vin, sales_group, point array<double>``. ``scales`` holds the largest value a point
    can have in each bin: 1 for a plain cumulative distribution.
    """

    frame: DataFrame
    n: int
    scales: tuple[float, ...]
    slice_rows: int = SLICE_ROWS
    paths: list[str] = field(default_factory=list, compare=False)

    def close(self) -> None:
        """Delete the fleet's files; nothing read from it can be evaluated afterwards."""
        while self.paths:
            discard(self.frame.sparkSession, self.paths.pop())

    def __enter__(self) -> Fleet:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def n_bins(self) -> int:
        return len(self.scales)

    @property
    def n_tasks(self) -> int:
        """Tasks for a pass over the fleet: enough for the data, and for the cores."""
        by_data = -(-self.n * self.n_bins // TASK_VALUES)
        return max(by_data, self.frame.sparkSession.sparkContext.defaultParallelism)

    @cached_property
    def sliced(self) -> tuple[DataFrame, int]:
        """``frame`` with ``slice array<bigint>``, and the number of slices; sorted on first use.

        All (bin, value) pairs are cut into evenly filled slices. The range sort includes the vin, so
        one value shared by a third of the fleet is still split. The slice number is fixed by writing
        it out, as range bounds may differ when recomputed. A task sorts a range of ``SLICE_ROWS`` values
        or so and cuts it into as many slices as are asked for, so small slices make no more tasks or files.
        A single slice holds everything and needs no sort.
        """
        n_values = self.n * self.n_bins
        n_slices = -(-n_values // self.slice_rows)
        if n_slices <= 1:
            return self.frame.withColumn("slice", F.array_repeat(F.lit(0).cast("bigint"), self.n_bins)), 1
        n_ranges = min(n_slices, max(-(-n_values // SLICE_ROWS), self.n_tasks))
        # Task number in the upper bits, row number in the lower ones.
        place, low = F.monotonically_increasing_id(), (1 << 33) - 1
        in_range = F.floor(place.bitwiseAND(F.lit(low)) / F.lit(self.slice_rows))
        number = F.shiftright(place, 33) * F.lit(n_slices) + in_range
        sorted_values = (
            self.frame.select("vin", F.posexplode("point").alias("bin", "x"))
            .repartitionByRange(n_ranges, "bin", "x", "vin")
            .sortWithinPartitions("bin", "x", "vin")
            .select("vin", "bin", number.alias("slice"))
        )
        # One exchange serves both the regrouping and the join.
        n_tasks = max(n_ranges, self.n_tasks)
        tags = (
            sorted_values.repartition(n_tasks, "vin")
            .groupBy("vin")
            .agg(F.sort_array(F.collect_list(F.struct("bin", "slice"))).alias("tags"))
            .select("vin", F.col("tags.slice").alias("slice"))
        )
        rows = self.frame.repartition(n_tasks, "vin").join(tags, "vin")
        self.paths.append(write_aside(rows, "sliced"))
        return read_back(rows.sparkSession, self.paths[-1], rows.schema), n_slices


def write_fleet(
    dists: DataFrame, scales: Sequence[float] | None = None, slice_rows: int = SLICE_ROWS
) -> Fleet:
    """Write ``vin, sales_group, cdf`` out for the many passes to come.

    With ``scales`` the cumulative column is taken as already scaled.
    """
    whole = F.col("cdf").isNotNull() & ~F.exists("cdf", lambda v: v.isNull())
    point = F.when(whole, F.col("cdf")).otherwise(
        F.raise_error(F.concat(F.lit("missing values in the distribution of "), F.col("vin")))
    )
    rows = dists.select("vin", "sales_group", point.cast("array<double>").alias("point"))
    path = write_aside(rows, "fleet")
    frame = read_back(rows.sparkSession, path, rows.schema)
    n = frame.count()
    if scales is None:
        width = frame.select(F.size("point").alias("b")).first()
        scales = [1.0] * (width["b"] if width else 1)
    return Fleet(frame, n, tuple(float(s) for s in scales), slice_rows, [path])


def cluster_totals(fleet: Fleet, labels: dict[str, tuple[Column, int]]) -> DataFrame:
    """Exact sum of distances from every vehicle to every cluster, in bin units.

    ``labels`` maps a run name to a label column on ``fleet.frame`` and its number of clusters; many
    runs share one shuffle. The result has ``vin`` and one array ``{run}_totals`` per run, by cluster.
    """
    runs = list(labels)
    frame, n_slices = fleet.sliced
    tagged = frame.select(
        "vin", "point", "slice", *[labels[r][0].cast("int").alias(r) for r in runs]
    )
    values = tagged.select(
        "vin", *runs, F.posexplode(F.arrays_zip("point", "slice")).alias("bin", "v")
    ).select("vin", *runs, "bin", F.col("v.point").alias("x"), F.col("v.slice").alias("slice"))

    members = [(r, q) for r in runs for q in range(labels[r][1])]
    names = [f"{r}_{q}" for r, q in members]

    def is_member(run: str, q: int) -> Column:
        return F.col(run) == q

    per_slice = values.groupBy("bin", "slice").agg(
        *[F.count(F.when(is_member(r, q), 1)).alias(f"c_{r}_{q}") for r, q in members],
        *[
            F.coalesce(F.sum(F.when(is_member(r, q), F.col("x"))), F.lit(0.0)).alias(f"s_{r}_{q}")
            for r, q in members
        ],
    )
    whole = W.partitionBy("bin")
    before = whole.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)

    def prior(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    # The part of the formula that is the same for a whole slice: slope and constant.
    offsets = per_slice.select(
        "bin",
        "slice",
        *[(2 * prior(f"c_{m}") - F.sum(f"c_{m}").over(whole)).alias(f"k_{m}") for m in names],
        *[(F.sum(f"s_{m}").over(whole) - 2 * prior(f"s_{m}")).alias(f"t_{m}") for m in names],
    )
    if (n_slices + fleet.n_bins) * len(names) <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)

    running = (
        W.partitionBy("bin", "slice").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ranked = values.select(
        "vin",
        "bin",
        "slice",
        "x",
        *[F.count(F.when(is_member(r, q), 1)).over(running).alias(f"n_{r}_{q}") for r, q in members],
        *[
            F.coalesce(F.sum(F.when(is_member(r, q), F.col("x"))).over(running), F.lit(0.0)).alias(
                f"u_{r}_{q}"
            )
            for r, q in members
        ],
    )
    parts = ranked.join(offsets, ["bin", "slice"])
    summed = parts.groupBy("vin").agg(
        *[
            F.sum(
                F.col("x") * (2 * F.col(f"n_{m}") + F.col(f"k_{m}"))
                + F.col(f"t_{m}")
                - 2 * F.col(f"u_{m}")
            ).alias(m)
            for m in names
        ]
    )
    return summed.select(
        "vin",
        *[
            F.array(*[F.col(f"{r}_{q}") for q in range(labels[r][1])]).alias(f"{r}_totals")
            for r in runs
        ],
    )


# Numbers, of distinct values by clusters, up to which totals are looked up in every task.
VALUE_TABLE = 4_000_000
# Values that a task holds as one NumPy block.
BLOCK_VALUES = 500_000


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def looked_up_totals(fleet: Fleet, rows: DataFrame, runs: dict[str, int]) -> DataFrame | None:
    """``cluster_totals`` of ``rows`` (``vin, point`` and an int column per run) without sorting the fleet.

    Spectra made of counts hold few different shares. Members are counted by distinct (bin, value), and
    every vehicle looks its totals up there. None if the counts are too many for a table in each task.
    """
    widths = list(runs.values())
    n_members = sum(widths)
    starts = np.cumsum([0, *widths])
    names = [f"c{i}" for i in range(n_members)]
    limit = VALUE_TABLE // n_members
    # Different values of a part of the fleet: more there are more in all.
    some = rows.select("vin", "point").limit(20_000).select(F.posexplode("point"))
    if some.distinct().count() > limit:
        return None

    def count(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("point"), n)
            codes = [batch.column(r).to_numpy(zero_copy_only=False) for r in runs]
            for b in range(x.shape[1]):
                values, at = np.unique(x[:, b], return_inverse=True)
                counts = [
                    np.bincount(at * k + q, minlength=len(values) * k).reshape(-1, k)
                    for q, k in zip(codes, widths)
                ]
                table = np.concatenate(counts, axis=1)
                columns = {c: table[:, i] for i, c in enumerate(names)}
                yield pa.RecordBatch.from_pydict({"bin": np.full(len(values), b, np.int32), "x": values, **columns})

    schema = "bin int, x double, " + ", ".join(f"{c} long" for c in names)
    counted = (
        rows.mapInArrow(count, schema)
        .groupBy("bin", "x")
        .agg(*[F.sum(c).alias(c) for c in names])
        .persist()
    )
    try:
        if counted.count() > limit:
            return None
        found = counted.toArrow()
    finally:
        counted.unpersist()
    bins, values = (found.column(c).to_numpy() for c in ("bin", "x"))
    members = np.stack([found.column(c).to_numpy() for c in names], axis=1)
    order = np.lexsort((values, bins))
    bins, values, members = bins[order], values[order], members[order]
    tables = []
    for b in range(fleet.n_bins):
        own = bins == b
        v, m = values[own], members[own].astype(float)
        sums = m * v[:, None]
        tables.append((v, 2 * np.cumsum(m, axis=0) - m.sum(axis=0), sums.sum(axis=0) - 2 * np.cumsum(sums, axis=0)))

    def look_up(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("point"), n)
            totals = np.zeros((n, n_members))
            for b, (v, slope, const) in enumerate(tables):
                at = np.searchsorted(v, x[:, b])
                totals += x[:, b, None] * slope[at] + const[at]
            columns = {"vin": batch.column("vin")}
            for r, a, k in zip(runs, starts, widths):
                offsets = np.arange(0, (n + 1) * k, k, dtype=np.int32)
                columns[f"{r}_totals"] = pa.ListArray.from_arrays(offsets, np.ascontiguousarray(totals[:, a : a + k]).ravel())
            yield pa.RecordBatch.from_pydict(columns)

    out = "vin string, " + ", ".join(f"{r}_totals array<double>" for r in runs)
    return rows.select("vin", "point").mapInArrow(look_up, out)


def fleet_totals(fleet: Fleet) -> DataFrame:
    """Exact sum of distances from each vehicle to the whole fleet: ``vin, total`` in bin units."""
    totals = cluster_totals(fleet, {"all": (F.lit(0), 1)})
    return totals.select("vin", F.get("all_totals", F.lit(0)).alias("total"))


def distance_to(
    dists: DataFrame, refs: dict[str, Sequence[float]], step: float, point: str = "cdf"
) -> DataFrame:
    """Map-only distances to a few stated reference distributions: ``vin, ref, distance``."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("ref"),
                w1(F.col(point), double_array(values), step).alias("distance"),
            )
            for name, values in refs.items()
        ]
    )
    return dists.select("vin", F.inline(pairs))


# Stated vehicles of one block, on average.
BLOCK_VEHICLES = 64
# Stated vectors of up to so many bytes go to every task; beyond, blocks are dealt to parts of the fleet.
BLOCK_BYTES = 64_000_000


def matrix_rows(
    dists: DataFrame,
    stated: DataFrame,
    step: float,
    metric: Callable = w1,
    value: str = "cdf",
    block_bytes: int = BLOCK_BYTES,
    nearest: int | None = None,
    sparse: bool = False,
    digits: int | None = None,
    nudge: float = 0.0,
) -> DataFrame:
    """Rows of the distance matrix for a table of stated vehicles: ``vin_i`` (stated), ``vin_j, distance``.

    ``stated`` has ``vin``; names that are not in the fleet give no rows. Their vectors are put together in
    blocks, and every vehicle of the fleet meets each block once, list x fleet rows in all. While all blocks
    are small by measure they go to every task and the fleet stays where it is; beyond, the fleet is cut into
    parts, and each part meets each block in a shuffle. Dense and sparse vectors that are few enough for every
    task meet the fleet as NumPy blocks. With ``nearest`` a block may leave out rows that are not among so many
    nearest others of a stated vehicle: enough for ``nearest_vehicles``; of many pairs only these are looked for,
    as ``nearest_neighbours`` does. ``sparse`` says that values are cells
    and the metric is ``w1_sparse``. ``digits`` rounds the distances, with ``nudge`` added, as ``round`` does, in the
    blocks where these are NumPy.
    """
    wanted = stated.select(F.col("vin").alias("vin_i")).where("vin_i is not null").distinct()
    rows = dists.select(F.col("vin").alias("vin_i"), F.col(value).alias("v")).join(wanted, "vin_i")
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("s")).first()
    n_blocks = max(1, -(-sizes["n"] // BLOCK_VEHICLES))
    # Three doubles an element at most (a dense vector has one, cells by NumPy two) and the names.
    measured = (8 if metric is w1 else 16 if sparse else 24) * sizes["s"] + 64 * sizes["n"]
    side = dists.select(F.col("vin"), F.col(value).alias("v"))
    # Few bytes make much work here, so the number of tasks follows the list and the cores.
    n_tasks = max(4 * dists.sparkSession.sparkContext.defaultParallelism, sizes["n"] // TASK_STATED)
    if metric is w1 and nearest is not None and sizes["n"] * dists.count() > SEARCH_PAIRS:
        # Not at the top, as that module builds on this one.
        from fleetspectra.operators.nearest import nearest_of_stated

        return nearest_of_stated(side, wanted, nearest, sizes["s"] // sizes["n"], step)
    if metric is w1 and not nudge and measured <= block_bytes:
        if nearest is None:
            side = side.repartition(n_tasks, "vin")
        return _dense_rows(side, rows, step, nearest, digits)
    if sparse and measured <= block_bytes:
        # Vehicles of equally many cells mostly have equal shares.
        return _sparse_rows(side.repartitionByRange(n_tasks, F.size("v"), "vin"), rows, digits, nudge)
    if digits is not None:
        exact = matrix_rows(dists, stated, step, metric, value, block_bytes, nearest, sparse)
        return exact.withColumn("distance", F.round(F.col("distance") + F.lit(nudge), digits))
    n_parts = 1 if measured <= block_bytes else 4 * dists.sparkSession.sparkContext.defaultParallelism
    blocks = (
        rows.groupBy(F.pmod(F.xxhash64("vin_i"), F.lit(n_blocks)).alias("block"))
        .agg(F.collect_list(F.struct("vin_i", "v")).alias("vehicles"))
        .select("vehicles", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    )
    part = F.pmod(F.xxhash64("vin"), F.lit(n_parts)).cast("int")
    side = F.broadcast(blocks) if n_parts == 1 else blocks
    pairs = F.transform(
        "vehicles",
        lambda b: F.struct(
            b["vin_i"].alias("vin_i"), metric(b["v"], F.col("own"), step).alias("distance")
        ),
    )
    fleet = dists.select(F.col("vin").alias("vin_j"), F.col(value).alias("own"), part.alias("part"))
    return fleet.join(side, "part").select("vin_j", F.inline(pairs)).select("vin_i", "vin_j", "distance")


# Stated vehicles and vehicles of the fleet that meet as one NumPy block.
STATED_BLOCK, FLEET_BLOCK = 64, 2048
PAIR_COLUMNS = 512
# Stated vehicles per task of a pass over the fleet.
TASK_STATED = 256
# Pairs up to which the nearest are found by measuring all; beyond, groups of neighbours are searched.
SEARCH_PAIRS = 2_000_000_000


def _pairwise(left: np.ndarray, right: np.ndarray, step: float, digits: int | None = None) -> np.ndarray:
    """``w1`` of all pairs of columns, bins added in order as ``w1`` does, rounded to ``digits``."""
    total = np.empty((left.shape[1], right.shape[1]))
    # Pieces that stay in a core's cache through all bins.
    for c in range(0, right.shape[1], PAIR_COLUMNS):
        piece = np.zeros((left.shape[1], min(PAIR_COLUMNS, right.shape[1] - c)))
        part = np.empty_like(piece)
        for a, b in zip(left, right[:, c : c + PAIR_COLUMNS]):
            np.subtract(a[:, None], b, out=part)
            piece += np.abs(part, out=part)
        np.multiply(piece, step, out=piece)
        total[:, c : c + PAIR_COLUMNS] = piece if digits is None else _rounded(piece, digits)
    return total


def _lowest(distances: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``n`` lowest entries of each row; the first columns win a tie."""
    rounded = np.floor(distances * 10.0**TIE_DECIMALS + 0.5)
    kth = np.partition(rounded, n - 1, axis=1)[:, n - 1]
    i, j = np.nonzero(rounded <= kth[:, None])
    order = np.lexsort((j, rounded[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < n], j[rank < n]


def _rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Values rounded half up in decimals, as ``round`` does; those near a tie go by their decimal text."""
    scale = 10.0**digits
    scaled = np.abs(values) * scale
    whole = np.floor(scaled + 0.5)
    out = np.copysign(whole / scale, values)
    # Beyond 2**52 there is nothing to round, and the quotient need not be the value.
    small = scaled < 2.0**52
    if not small.all():
        out = np.where(small, out, values)
    scaled -= whole
    tie = np.abs(scaled, out=scaled) >= 0.5 - 1e-6 - 1e-15 * scale * np.abs(values)
    for i in np.flatnonzero(tie & small):
        exact = Decimal(repr(float(values.flat[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
        out.flat[i] = float(exact)
    return out


def _dense_rows(
    fleet: DataFrame, rows: DataFrame, step: float, nearest: int | None, digits: int | None = None
) -> DataFrame:
    """``matrix_rows`` of stated vectors (``vin_i, v``) that are few enough for every task."""
    found = rows.toArrow()
    if not found.num_rows:
        return fleet.sparkSession.createDataFrame([], "vin_i string, vin_j string, distance double")
    names = found.column("vin_i").combine_chunks()
    stated = np.ascontiguousarray(_matrix(found.column("v").combine_chunks(), found.num_rows).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vins = batch.column("vin")
            # By vin, so that the lowest ones win ties.
            order = vins.to_numpy(zero_copy_only=False).argsort() if nearest else np.arange(batch.num_rows)
            x = _matrix(batch.column("v"), batch.num_rows)
            width = FLEET_BLOCK if nearest else PAIR_COLUMNS
            for first in range(0, len(order), width):
                mine = order[first : first + width]
                own, points = vins.take(pa.array(mine)), np.ascontiguousarray(x[mine].T)
                for a in range(0, stated.shape[1], STATED_BLOCK):
                    d = _pairwise(stated[:, a : a + STATED_BLOCK], points, step, None if nearest else digits)
                    if not nearest:
                        yield _folded(names.slice(a, len(d)), own, d)
                        continue
                    # The vehicle itself may be among them.
                    if nearest + 1 < len(mine):
                        i, j = _lowest(d, nearest + 1)
                    else:
                        i, j = (v.ravel() for v in np.indices(d.shape))
                    yield pa.RecordBatch.from_pydict(
                        {"vin_i": names.take(pa.array(i + a)), "vin_j": own.take(pa.array(j)), "distance": d[i, j]}
                    )

    if nearest:
        return fleet.mapInArrow(run, "vin_i string, vin_j string, distance double")
    return _unfolded(fleet.mapInArrow(run, _FOLDED))


# A block of distances leaves Python as one row: names once, and the numbers of each stated vehicle as a list.
_FOLDED = "vins array<string>, stated array<struct<vin_i: string, d: array<double>>>"


def _folded(names: pa.Array, others: pa.Array, distances: np.ndarray) -> pa.RecordBatch:
    """One row of ``_FOLDED`` with the distances of ``names`` by ``others``."""

    def lists(values: pa.Array, n: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (len(values) // max(1, n)), values)

    rows = lists(pa.array(np.ascontiguousarray(distances).ravel()), len(names))
    stated = pa.StructArray.from_arrays([names, rows], ["vin_i", "d"])
    return pa.RecordBatch.from_arrays([lists(others, 1), lists(stated, 1)], ["vins", "stated"])


def _unfolded(blocks: DataFrame) -> DataFrame:
    """``vin_i, vin_j, distance`` of blocks: a row per number, made where it is used."""
    lists = blocks.select("vins", F.explode("stated").alias("s"))
    numbers = lists.select("vins", F.col("s.vin_i").alias("vin_i"), F.posexplode("s.d").alias("at", "distance"))
    return numbers.select("vin_i", F.get("vins", "at").alias("vin_j"), "distance")


# Cells of the fleet that meet a stated vehicle at once.
CELL_BLOCK = 100_000
# Equal shares that a vehicle is taken apart into, at most, and multiples of its least share tried for one of them.
UNITS, LEAST_SHARES = 256, 8
# Pairs measured as one block.
UNIT_PAIRS = 32_768


def _cells_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First cell of each vehicle and the end, centers and cumulative shares of a column of cells."""
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = column.flatten()
    center, cdf = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("center", "cdf"))
    return starts, center, cdf


def _by_units(starts: np.ndarray, center: np.ndarray, cdf: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """Vehicles whose shares are all multiples of one n-th, by n, and the others.

    Of each n up to ``UNITS``: n, the rows, and their centers in n equal shares as an array by share and row.
    """
    begin, sizes = starts[:-1], np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    share = np.diff(cdf, prepend=0.0)
    share[begin] = cdf[begin]
    least = np.minimum.reduceat(np.where(share > 0, share, np.inf), begin)
    units, counts = np.zeros(len(sizes), np.int64), np.zeros(len(cdf), np.int64)
    for q in range(LEAST_SHARES, 0, -1):
        n = np.minimum(np.rint(q / least), UNITS + 1)
        upto = cdf * n[owner]
        whole = np.rint(upto)
        count = np.diff(whole, prepend=0.0)
        count[begin] = whole[begin]
        off = np.maximum.reduceat(np.where(count < 0, np.inf, np.abs(upto - whole)), begin)
        # The fewest shares win, so the least multiple comes last.
        good = (off <= 1e-12) & (n <= UNITS) & (whole[starts[1:] - 1] == n)
        units[good] = n[good].astype(np.int64)
        counts = np.where(good[owner], count, counts).astype(np.int64)
    out, spread = [], np.repeat(center, counts)
    ends = np.cumsum(units)
    for n in np.unique(units[units > 0]):
        rows = np.flatnonzero(units == n)
        out.append((int(n), rows, np.ascontiguousarray(spread[(ends[rows] - n) + np.arange(n)[:, None]])))
    return out, np.flatnonzero(units == 0)


def _merged(m: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where m and n equal shares of a whole are cut together: each piece's m-th, n-th, and length in (m n)-ths."""
    cuts = np.union1d(np.arange(m + 1) * n, np.arange(n + 1) * m)
    return cuts[:-1] // n, cuts[:-1] // m, np.diff(cuts).astype(float)


def _sparse_rows(fleet: DataFrame, rows: DataFrame, digits: int | None = None, nudge: float = 0.0) -> DataFrame:
    """``matrix_rows`` of stated cells (``vin_i, v``) that are few enough for every task, by ``w1_sparse``.

    The distance is the mean way between two vehicles' centers share by share, from the lowest up. Vehicles made of
    m and of n equal shares are cut at the same places, whoever they are, so all of them meet as NumPy blocks.

    Others meet one by one. With G(x) the integral of a stated vehicle's cumulative shares F up to x, the part of the
    distance along a gap from p to q, where the other vehicle stays at y and F reaches y at t within the gap, is
    y * (2t - p - q) + G(p) + G(q) - 2 G(t).
    """
    plain = F.transform("v", lambda c: F.struct(c["center"].alias("center"), c["cdf"].alias("cdf")))
    found = rows.select("vin_i", plain.alias("v")).toArrow()
    if not found.num_rows:
        return fleet.sparkSession.createDataFrame([], "vin_i string, vin_j string, distance double")
    names = found.column("vin_i").combine_chunks()
    starts, centers, cdfs = _cells_of(found.column("v").combine_chunks(), found.num_rows)
    shared, single = _by_units(starts, centers, cdfs)
    shared = [(m, names.take(pa.array(at)), x) for m, at, x in shared]

    def cells(i: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        return names.slice(i, 1), centers[starts[i] : starts[i + 1]], cdfs[starts[i] : starts[i + 1]]

    def to_block(
        c: np.ndarray, f: np.ndarray, first: np.ndarray, last: np.ndarray, p: np.ndarray, y: np.ndarray
    ) -> np.ndarray:
        area = np.concatenate([[0.0], np.cumsum(f[:-1] * np.diff(c))])
        at = np.searchsorted(c, p, side="right") - 1
        before = at < 0
        at[before] = 0
        g = np.where(before, 0.0, area[at] + f[at] * (p - c[at]))
        # Gaps to the next cell of the same vehicle; the last cell of each has none.
        q, gq = np.append(p[1:], 0.0), np.append(g[1:], 0.0)
        level = np.minimum(np.searchsorted(f, y, side="left"), len(c) - 1)
        t, gt = c[level], area[level]
        low, high = t <= p, t >= q
        t, gt = np.where(low, p, np.where(high, q, t)), np.where(low, g, np.where(high, gq, gt))
        part = y * ((t - p) + (t - q)) + (g - gt) + (gq - gt)
        part[last] = 0.0
        total = np.add.reduceat(part, first)
        # Before the first cell the other stays at 0, behind the last one at 1.
        rest = (c[-1] - p[last]) - (area[-1] - g[last])
        return total + g[first] + np.where(p[last] >= c[-1], 0.0, rest)

    def finished(distances: np.ndarray) -> np.ndarray:
        return distances if digits is None else _rounded(distances + nudge, digits)

    def one_by_one(some: np.ndarray, vins: pa.Array, sizes: np.ndarray, x: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(sizes)
        step = max(1, CELL_BLOCK * len(sizes) // max(1, len(x)))
        for a in range(0, len(sizes), step):
            last = ends[a : a + step]
            low, own = ends[a] - sizes[a], vins.slice(a, len(last))
            first, last, high = last - sizes[a : a + step] - low, last - 1 - low, last[-1]
            for name, c, f in map(cells, some):
                yield _folded(name, own, finished(to_block(c, f, first, last, x[low:high], level[low:high])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vins = batch.column("vin")
            begin, p, y = _cells_of(batch.column("v"), batch.num_rows)
            sizes = np.diff(begin)
            alike, others = _by_units(begin, p, y)
            for n, at, points in alike:
                own = vins.take(pa.array(at))
                for m, stated, x in shared:
                    of_stated, of_own, length = _merged(m, n)
                    left, right = x[of_stated] * length[:, None], points[of_own] * length[:, None]
                    for b in range(0, len(at), PAIR_COLUMNS):
                        there, near = own.slice(b, PAIR_COLUMNS), right[:, b : b + PAIR_COLUMNS]
                        step = max(1, UNIT_PAIRS // near.shape[1])
                        for a in range(0, len(stated), step):
                            d = _pairwise(left[:, a : a + step], near, 1.0)
                            np.divide(d, m * n, out=d)
                            yield _folded(stated.slice(a, step), there, finished(d))
            every = np.arange(batch.num_rows)
            # Vehicles of the fleet that are no equal shares meet all stated ones by cells.
            for some, which in ((single, np.setdiff1d(every, others)), (np.arange(len(names)), others)):
                if not len(some):
                    continue
                owned = np.isin(np.repeat(every, sizes), which)
                yield from one_by_one(some, vins.take(pa.array(which)), sizes[which], p[owned], y[owned])

    return _unfolded(fleet.select("vin", plain.alias("v")).mapInArrow(run, _FOLDED))


def nearest_vehicles(rows: DataFrame, n: int, parts: int = 64) -> DataFrame:
    """The ``n`` nearest others of each stated vehicle: ``vin_i, rank, vin_j, distance``.

    Each part of the fleet names its own ``n`` first, so no task holds a whole row of the matrix.
    """
    others = rows.where("vin_i != vin_j").select(
        "vin_i", F.round("distance", TIE_DECIMALS).alias("distance"), "vin_j"
    )
    part = F.pmod(F.xxhash64("vin_j"), F.lit(parts))
    order = [F.col("distance"), F.col("vin_j")]
    some = (
        others.withColumn("part", part)
        .withColumn("r", F.row_number().over(W.partitionBy("vin_i", "part").orderBy(*order)))
        .where(F.col("r") <= n)
    )
    return (
        some.withColumn("rank", F.row_number().over(W.partitionBy("vin_i").orderBy(*order)))
        .where(F.col("rank") <= n)
        .select("vin_i", "rank", "vin_j", "distance")
    )


def matrix_diagnostics(rows: DataFrame, between: DataFrame | None = None) -> DataFrame:
    """One row of invariants over stated rows of the matrix, each computed from what is there.

    ``n_asymmetric`` compares the two directions of every pair of stated vehicles, which were computed
    apart; ``max_diagonal`` is the largest distance of a vehicle to itself. ``between`` are the rows among stated
    vehicles, where the caller can make them without the others; else they are looked for.
    """
    on_diagonal = F.col("vin_i") == F.col("vin_j")
    distance = F.col("distance")
    if between is None:
        # Only stated vehicles have rows of their own, so only pairs of two of them have another direction.
        between = rows.join(rows.where(on_diagonal).select("vin_j"), "vin_j", "left_semi")
    # Half of the rows meet the other half, swapped, so each row is shuffled once. They look small to the optimizer, as
    # their source is, so it is told not to gather them on the driver for a broadcast.
    there = between.where("vin_i <= vin_j").select("vin_i", "vin_j", "distance")
    back = between.where("vin_i >= vin_j").select(
        F.col("vin_j").alias("vin_i"), F.col("vin_i").alias("vin_j"), distance.alias("back")
    )
    apart = F.abs(distance - F.col("back")) > 1e-6
    both = there.hint("merge").join(back, ["vin_i", "vin_j"]).agg(
        # One for either direction; a vehicle and itself have only one.
        (F.count_if(apart) + F.count_if(apart & ~on_diagonal)).alias("n_asymmetric")
    )
    whole = rows.agg(
        F.count_if(on_diagonal).alias("n_stated"),
        F.count("*").alias("n_rows"),
        F.max(F.when(on_diagonal, distance)).alias("max_diagonal"),
        F.min(F.when(~on_diagonal, distance)).alias("min_distance"),
        F.max(F.when(~on_diagonal, distance)).alias("max_distance"),
        F.count_if(distance < 0).alias("n_negative"),
    )
    # Two tables of one row each.
    return whole.withColumn("one", F.lit(1)).join(both.withColumn("one", F.lit(1)), "one").drop("one")


def leading_matrix(dists: DataFrame, step: float, size: int = 5) -> DataFrame:
    """The first ``size`` x ``size`` entries of the matrix in vin order, both triangles."""
    head = dists.select("vin", "cdf").orderBy("vin").limit(size)
    refs = {row["vin"]: row["cdf"] for row in head.collect()}
    return distance_to(head, refs, step).select(
        F.col("vin").alias("vin_i"), F.col("ref").alias("vin_j"), "distance"
    )
