"""k-medoids, silhouette and the choice of k, exact and without a distance matrix.

One path serves all fleets. Cells are fitted once to the fleet's own values, so that each holds a like
share of them, however concentrated they are. A round labels the fleet against constant medoids, sums
each cluster by (bin, cell), and bounds every member's in-cluster cost from these sums. Members whose
bounds overlap the best one are survivors. Their exact costs follow from the same sums once the members
that share a cell with a survivor's value are sorted inside that cell; with one survivor per cluster there
is nothing to sort. All k of a sweep share every job.

Up to ``TABLE_ROWS`` cells of all clusters, a task works on whole vehicles as NumPy rows: it labels them, adds
them up by cell, and looks the bounds up in tables of the cells, so a vehicle is never taken apart into a
row per value. Up to ``DIRECT`` survivors are then measured against all members the same way. Wider grids and
more survivors go by joins and sorted cells; both ways are exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.functions.arrays import (
    TIE_DECIMALS,
    distances_to,
    double_array,
    double_matrix,
    nearest,
)
from fleetspectra.functions.intervals import let
from fleetspectra.operators.distance import Fleet, cluster_totals, looked_up_totals
from fleetspectra.sources.tables import materialize

# Task functions travel whole, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

# Rows of the cluster summary (clusters x bins x cells) up to which it is broadcast.
SUMMARY_ROWS = 250_000
# A bin's cells: so many parts of like mass, each cut into so many of like width.
PARTS = 16
SUBCELLS = 15
# Vehicles whose values set the cuts between cells.
CUT_VEHICLES = 5000
# Slack on bounds: ties by rounding plus float noise.
_SLACK = 2 * 10.0**-TIE_DECIMALS


# Cells of all clusters up to which their sums are tables on the driver and in every task.
TABLE_ROWS = 1_000_000
# Survivors of a round that are measured against all members.
DIRECT = 1024
# Values that a task holds as one NumPy block.
BLOCK_VALUES = 500_000


class NotConverged(RuntimeError):
    """Medoids still moved in the last allowed round."""


@dataclass(frozen=True)
class Medoids:
    """The outcome of k-medoids for one k; labels are positions in ``vins``."""

    k: int
    vins: tuple[str, ...]
    points: tuple[tuple[float, ...], ...]
    rounds: int
    converged: bool

    def label(self, point: str = "point") -> Column:
        return nearest(F.col(point), self.points)

    def labels(self, fleet: Fleet) -> DataFrame:
        """``vin, sales_group, cluster``: map-only over the fleet."""
        return fleet.frame.select("vin", "sales_group", self.label().alias("cluster"))


def central_vehicles(fleet: Fleet, n: int) -> list[tuple[str, float]]:
    """The ``n`` vehicles with the least mean distance to the fleet, in bin units, best first.

    The lowest vin wins a tie.
    """
    with _celled(fleet) as frame:
        return _central(fleet, frame, n, _ranges(fleet, frame, 1))


def kmedoids(fleet: Fleet, k: int, max_iter: int = 300) -> Medoids:
    """Alternating k-medoids for one k."""
    return kmedoids_sweep(fleet, [k], max_iter)[k]


def kmedoids_sweep(
    fleet: Fleet, ks: Iterable[int], max_iter: int = 300, must_converge: bool = True
) -> dict[int, Medoids]:
    """Alternating k-medoids for several k at once: every job serves all k still moving.

    Start: the k most central vehicles. Round: label by nearest medoid, the lowest position winning a
    tie; each medoid moves to the member of least in-cluster cost when that is strictly better, the
    lowest vin winning a tie. Stop when no medoid moves. An empty cluster keeps its medoid. Raises
    ``NotConverged`` after ``max_iter`` rounds, unless an unfinished outcome is asked for.
    """
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("k must be at least 1")
    if fleet.n < ks[-1]:
        raise ValueError(f"{fleet.n} vehicles cannot form {ks[-1]} clusters")
    with _celled(fleet) as frame:
        ranges = _ranges(fleet, frame, sum(ks))
        start = [vin for vin, _ in _central(fleet, frame, ks[-1], ranges)]
        points = _points_of(frame, start)
        state = {k: start[:k] for k in ks}
        done: dict[int, Medoids] = {}
        rounds = 0
        while len(done) < len(ks) and rounds < max_iter:
            rounds += 1
            moving = {k: state[k] for k in ks if k not in done}
            moved = _update(fleet, frame, moving, points, ranges)
            for k, vins in moved.items():
                if vins == state[k]:
                    done[k] = _outcome(k, vins, points, rounds, True)
                state[k] = vins
        for k in ks:
            if k not in done:
                if must_converge:
                    raise NotConverged(f"k = {k} still moves after {max_iter} rounds")
                done[k] = _outcome(k, state[k], points, rounds, False)
        return {k: done[k] for k in ks}


def _outcome(k, vins, points, rounds, converged) -> Medoids:
    return Medoids(k, tuple(vins), tuple(tuple(points[v]) for v in vins), rounds, converged)


def _points_of(frame: DataFrame, vins: Sequence[str]) -> dict[str, list[float]]:
    """Vectors of a short, stated list of vehicles."""
    rows = frame.where(F.col("vin").isin(list(vins))).select("vin", "point").collect()
    return {r["vin"]: r["point"] for r in rows}


@contextmanager
def _celled(fleet: Fleet) -> Iterator[DataFrame]:
    """``vin, point, cells, sig``, hashed by vin and cached while in use.

    Hashed once, so that no round has to bring a vehicle's bins together again. ``sig`` stands for the
    distribution: copies of one share it (96 bits of two unrelated hashes).
    """
    frame = (
        fleet.frame.select("vin", "point", _cells(fleet).alias("cells"))
        .withColumn("sig", F.struct(F.xxhash64("point").alias("a"), F.hash("point").alias("b")))
        .repartition(fleet.n_tasks, "vin")
        .persist()
    )
    try:
        yield frame
    finally:
        frame.unpersist()


def _width() -> int:
    return PARTS * (SUBCELLS + 1) + 2


def _cells(fleet: Fleet) -> Column:
    """Cell numbers of a vehicle's values, by cut points of each bin's values in the whole fleet.

    Lowest and highest values have cells of their own, as many vehicles share them (0 and 1).
    """
    shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    x = F.col("x")
    # Ends come from the whole fleet. Cuts only steer the work, so the vehicles of lowest hash are enough for
    # them; their exact percentiles are the same in every run and on every number of tasks.
    some = fleet.frame.orderBy(F.xxhash64("vin"), "vin").limit(CUT_VEHICLES)
    cuts = some.select(F.posexplode("point").alias("bin", "x")).groupBy("bin")
    ends = fleet.frame.select(F.posexplode("point").alias("bin", "x")).groupBy("bin")
    rows = (
        ends.agg(F.min(x).alias("low"), F.max(x).alias("high"))
        .join(cuts.agg(F.percentile(x, shares).alias("cuts")), "bin")
        .orderBy("bin")
        .collect()
    )
    edges = [[r["low"], *r["cuts"], r["high"]] for r in rows]

    def inner(x: Column, cuts: Column, part: Column) -> Column:
        low, high = F.get(cuts, part), F.get(cuts, part + 1)
        inside = F.ceil(F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)) * SUBCELLS)
        return part * (SUBCELLS + 1) + F.least(F.greatest(inside, F.lit(0)), F.lit(SUBCELLS)) + 1

    def cell(x: Column, cuts: Column) -> Column:
        # The lowest edge lies below x here, so the edges below it are one more than the cuts.
        part = F.aggregate(cuts, F.lit(-1), lambda n, v: n + (v < x).cast("int"))
        number = let(part, lambda p: inner(x, cuts, p))
        top = F.get(cuts, F.lit(PARTS))
        bottom = F.get(cuts, F.lit(0))
        return F.when(x >= top, _width() - 1).when(x <= bottom, 0).otherwise(number).cast("int")

    return F.zip_with("point", double_matrix(edges), cell)


def _labelled(
    frame: DataFrame, medoids: dict[int, list[str]], points: dict[str, list[float]]
) -> DataFrame:
    """The frame with ``codes``: per run the vehicle's cluster, numbered over all runs."""
    first = 0
    codes = []
    for vins in medoids.values():
        codes.append(nearest(F.col("point"), [points[v] for v in vins]) + F.lit(first))
        first += len(vins)
    return frame.withColumn("codes", F.array(*codes))


def _values(fleet: Fleet, labelled: DataFrame) -> DataFrame:
    """``vin, q, sig, x, cell``: one row per vehicle, run and bin; cells numbered over all clusters."""
    place = (F.col("q") * fleet.n_bins + F.col("bin")).cast("bigint") * _width() + F.col("v.cells")
    return (
        labelled.select("vin", "sig", "point", "cells", F.explode("codes").alias("q"))
        .select("vin", "sig", "q", F.posexplode(F.arrays_zip("point", "cells")).alias("bin", "v"))
        .select("vin", "q", "sig", F.col("v.point").alias("x"), place.alias("cell"))
    )


def _summary(values: DataFrame) -> DataFrame:
    """Per cell: its own count, sum and range, and counts and sums below it and in its cluster's bin."""
    cells = values.groupBy("cell").agg(
        F.count("*").alias("m"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    # A window holds the cells of one cluster and bin.
    whole = W.partitionBy(F.floor(F.col("cell") / _width()))
    below = whole.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return cells.select(
        "*",
        F.sum("m").over(whole).alias("size"),
        F.sum("s").over(whole).alias("sum"),
        F.coalesce(F.sum("m").over(below), F.lit(0)).alias("m_below"),
        F.coalesce(F.sum("s").over(below), F.lit(0.0)).alias("s_below"),
    )


def _small(fleet: Fleet, n_clusters: int, cells: DataFrame) -> DataFrame:
    """Broadcast what has a row per cell at most, unless the cells themselves are many."""
    few = n_clusters * fleet.n_bins * _width() <= SUMMARY_ROWS
    return F.broadcast(cells) if few else cells


def _bounded(fleet: Fleet, values: DataFrame, summary: DataFrame, n_clusters: int) -> DataFrame:
    """Bounds on every member's mean distance to its own cluster: ``vin, q, sig, low, high``.

    Members in other cells count exactly through sums. Those in the same cell count at least as much
    as if they all sat at their mean, and at most as the chord over the cell. Both are linear in the
    value but for one absolute term.
    """
    m, s, lo, hi, size = (F.col(c) for c in ("m", "s", "lo", "hi", "size"))
    span = hi - lo
    chord = (m * (hi + lo) - 2 * s) / span
    lines = summary.select(
        "cell",
        ((2 * F.col("m_below") + m - size) / size).alias("slope"),
        ((F.col("sum") - s - 2 * F.col("s_below")) / size).alias("const"),
        F.when(span > 0, m / size).otherwise(0.0).alias("pull"),
        F.when(span > 0, s / size).otherwise(0.0).alias("pivot"),
        F.when(span > 0, chord / size).otherwise(0.0).alias("chord_slope"),
        F.when(span > 0, (s - m * lo - lo * chord) / size).otherwise(0.0).alias("chord_const"),
    )
    x = F.col("x")
    outside = x * F.col("slope") + F.col("const")
    inside_low = F.abs(F.col("pull") * x - F.col("pivot"))
    inside_high = x * F.col("chord_slope") + F.col("chord_const")
    return (
        values.join(_small(fleet, n_clusters, lines), "cell")
        .groupBy("vin", "q", "sig")
        .agg(
            F.sum(outside + inside_low).alias("low"), F.sum(outside + inside_high).alias("high")
        )
    )


def _exact(
    fleet: Fleet,
    values: DataFrame,
    summary: DataFrame,
    survivors: DataFrame,
    n_clusters: int,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """Exact mean distance of each survivor (``vin, q``) to its cluster: ``vin, q, cost``, rounded.

    With the ``labelled`` rows behind ``values``, only survivors are taken apart into values again.

    A survivor's value needs count and sum of the members at or below it. Below its cell they are in the
    summary; inside they come from sorting the cell, where survivors are laid between the members. Order
    among equal values does not matter.
    """
    own = values
    if labelled is not None:
        own = _values(fleet, labelled.join(survivors.select("vin").distinct(), "vin", "left_semi"))
    asked = own.join(survivors.select("vin", "q"), ["vin", "q"], "left_semi")
    mixed = F.col("hi") > F.col("lo")
    wide = summary.where(mixed).select("cell")
    contested = asked.select("cell").distinct().join(wide, "cell", "left_semi")
    members = values.join(_small(fleet, n_clusters, contested), "cell", "left_semi").select(
        "cell", "x", F.lit(1).alias("w"), F.lit(None).cast("string").alias("vin"), F.lit(None).cast("int").alias("q")
    )
    points = asked.select("cell", "x", F.lit(0).alias("w"), "vin", F.col("q").cast("int").alias("q"))
    upto = W.partitionBy("cell").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        members.unionByName(points)
        .select(
            "*", F.sum("w").over(upto).alias("le"), F.sum(F.col("w") * F.col("x")).over(upto).alias("sum_le")
        )
        .where("w = 0")
    )
    # In a cell of one value all its members may stand at or below it.
    le = F.when(mixed, F.col("le")).otherwise(F.col("m"))
    sum_le = F.when(mixed, F.col("sum_le")).otherwise(F.col("s"))
    part = F.col("x") * (2 * (F.col("m_below") + le) - F.col("size")) + (
        F.col("sum") - 2 * (F.col("s_below") + sum_le)
    )
    return (
        placed.join(_small(fleet, n_clusters, summary), "cell")
        .groupBy("vin", "q")
        .agg(F.round(F.sum(part / F.col("size")), TIE_DECIMALS).alias("cost"))
    )


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, points and places in the (bin, cell) table of runs of a batch's vehicles."""
    n = batch.num_rows
    if not n:
        return
    x = batch.column("point").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    at = batch.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    at = at + np.arange(x.shape[1], dtype=np.int64) * _width()
    step = max(1, BLOCK_VALUES // x.shape[1])
    for first in range(0, n, step):
        yield first, x[first : first + step], at[first : first + step]


def _clusters(x: np.ndarray, refs: list[np.ndarray]) -> list[np.ndarray]:
    """Per run the cluster of every row, numbered over all runs; as ``_labelled`` does it."""
    out, first = [], 0
    for points in refs:
        d = np.stack([np.abs(x - p).sum(axis=1) for p in points])
        out.append(np.floor(d * 10.0**TIE_DECIMALS + 0.5).argmin(axis=0) + first)
        first += len(points)
    return out


def _refs(medoids: dict[int, list[str]], points: dict[str, list[float]]) -> list[np.ndarray]:
    return [np.array([points[v] for v in vins]) for vins in medoids.values()]


def _table(rows: DataFrame, size: int) -> list[np.ndarray]:
    """Rows ``at`` and values, one per cell at most, as arrays over all cells; absent ones are 0."""
    found = rows.toArrow()
    at = found.column("at").to_numpy()
    out = []
    for name in rows.columns[1:]:
        values = np.zeros(size)
        values[at] = found.column(name).to_numpy()
        out.append(values)
    return out


def _ranges(fleet: Fleet, frame: DataFrame, n_clusters: int) -> list[np.ndarray] | None:
    """Lowest and highest value of each (bin, cell) in the fleet; None if the tables were too large."""
    size = fleet.n_bins * _width()
    if n_clusters * size > TABLE_ROWS:
        return None

    def run(batches):
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        for batch in batches:
            for _, x, at in _blocks(batch):
                np.minimum.at(low, at.ravel(), x.ravel())
                np.maximum.at(high, at.ravel(), x.ravel())
        at = np.flatnonzero(low <= high)
        yield pa.RecordBatch.from_pydict({"at": at, "lo": low[at], "hi": high[at]})

    rows = frame.select("point", "cells").mapInArrow(run, "at long, lo double, hi double")
    return _table(rows.groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), size)


def _sums(fleet: Fleet, frame: DataFrame, refs: list[np.ndarray]) -> list[np.ndarray]:
    """Members and their sum per (cluster, bin, cell)."""
    per_cluster = fleet.n_bins * _width()
    size = sum(map(len, refs)) * per_cluster

    def run(batches):
        count, total = np.zeros(size), np.zeros(size)
        for batch in batches:
            for _, x, at in _blocks(batch):
                for codes in _clusters(x, refs):
                    place = (at + codes[:, None] * per_cluster).ravel()
                    first, end = codes.min() * per_cluster, (codes.max() + 1) * per_cluster
                    count[first:end] += np.bincount(place - first, minlength=end - first)
                    total[first:end] += np.bincount(place - first, x.ravel(), minlength=end - first)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"at": at, "m": count[at], "s": total[at]})

    rows = frame.select("point", "cells").mapInArrow(run, "at long, m double, s double")
    return _table(rows.groupBy("at").agg(F.sum("m").alias("m"), F.sum("s").alias("s")), size)


def _lines(fleet: Fleet, sums: list[np.ndarray], ranges: list[np.ndarray]) -> list[np.ndarray]:
    """Per (cluster, bin, cell) the factors of ``_bounded``, and the members of each cluster."""
    m, s = (v.reshape(-1, fleet.n_bins, _width()) for v in sums)
    lo, hi = (v.reshape(1, fleet.n_bins, _width()) for v in ranges)
    size = np.maximum(m.sum(axis=2, keepdims=True), 1.0)
    m_below, s_below = np.cumsum(m, axis=2) - m, np.cumsum(s, axis=2) - s
    wide = hi > lo
    span = np.where(wide, hi - lo, 1.0)
    chord = (m * (hi + lo) - 2 * s) / span
    lines = (
        (2 * m_below + m - size) / size,
        (s.sum(axis=2, keepdims=True) - s - 2 * s_below) / size,
        np.where(wide, m / size, 0.0),
        np.where(wide, s / size, 0.0),
        np.where(wide, chord / size, 0.0),
        np.where(wide, (s - m * lo - lo * chord) / size, 0.0),
    )
    return [v.ravel() for v in lines]


def _near(
    fleet: Fleet, frame: DataFrame, refs: list[np.ndarray], lines: list[np.ndarray], n: int
) -> DataFrame:
    """``vin, q, sig, low, high`` of members that may be among the ``n`` best of their cluster.

    A task leaves out whom its own members rule out; the caller compares the rest.
    """
    per_cluster = fleet.n_bins * _width()
    n_clusters = sum(map(len, refs))

    def run(batches):
        slope, const, pull, pivot, chord_slope, chord_const = lines
        best = [np.empty(0) for _ in range(n_clusters)]
        for batch in batches:
            vins, a, b = (batch.column(c) for c in ("vin", "a", "b"))
            for first, x, at in _blocks(batch):
                for codes in _clusters(x, refs):
                    place = at + codes[:, None] * per_cluster
                    outside = x * slope[place] + const[place]
                    low = (outside + np.abs(pull[place] * x - pivot[place])).sum(axis=1)
                    high = (outside + x * chord_slope[place] + chord_const[place]).sum(axis=1)
                    reach = np.full(n_clusters, np.inf)
                    for q in np.unique(codes):
                        best[q] = np.sort(np.concatenate([best[q], high[codes == q]]))[:n]
                        if len(best[q]) == n:
                            reach[q] = best[q][-1] + _SLACK + 1e-12 * abs(best[q][-1])
                    kept = np.flatnonzero(low <= reach[codes])
                    rows = pa.array(kept + first)
                    sig = pa.StructArray.from_arrays([a.take(rows), b.take(rows)], ["a", "b"])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "vin": vins.take(rows),
                            "q": pa.array(codes[kept].astype(np.int32)),
                            "sig": sig,
                            "low": low[kept],
                            "high": high[kept],
                        }
                    )

    schema = "vin string, q int, sig struct<a: bigint, b: int>, low double, high double"
    return frame.select("vin", "point", "cells", "sig.a", "sig.b").mapInArrow(run, schema)


def _direct(
    frame: DataFrame, refs: list[np.ndarray], asked: list[tuple[int, Sequence[float]]]
) -> list[float]:
    """Mean distance of each asked (cluster, point) to the members of the cluster, rounded."""
    by_cluster: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, (q, point) in enumerate(asked):
        by_cluster.setdefault(q, []).append((i, np.array(point)))

    def run(batches):
        totals, counts = np.zeros(len(asked)), np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            for _, x, _ in _blocks(batch):
                for codes in _clusters(x, refs):
                    for q in np.unique(codes):
                        members = x[codes == q] if q in by_cluster else None
                        for i, point in by_cluster.get(q, ()):
                            totals[i] += np.abs(members - point).sum()
                            counts[i] += len(members)
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(asked)), "total": totals, "n": counts})

    rows = frame.select("point", "cells").mapInArrow(run, "i long, total double, n long")
    cost = F.round(F.sum("total") / F.sum("n"), TIE_DECIMALS)
    found = dict(rows.groupBy("i").agg(cost.alias("cost")).collect())
    return [found[i] for i in range(len(asked))]


def _costs(
    fleet: Fleet,
    frame: DataFrame,
    medoids: dict[int, list[str]] | None,
    points: dict[str, list[float]],
    refs: list[np.ndarray],
    survivors: DataFrame,
    n: int,
) -> DataFrame:
    """``vin, q, cost`` of ``n`` survivors (``vin, q``): measured if they are few, else by sorted cells."""
    if n <= DIRECT:
        rows = survivors.select("vin", "q").collect()
        vectors = _points_of(frame, [r["vin"] for r in rows])
        costs = _direct(frame, refs, [(r["q"], vectors[r["vin"]]) for r in rows])
        table = [(r["vin"], r["q"], c) for r, c in zip(rows, costs)]
        return frame.sparkSession.createDataFrame(table, "vin string, q int, cost double")
    if medoids is None:
        labelled = frame.withColumn("codes", F.array(F.lit(0)))
    else:
        labelled = _labelled(frame, medoids, points)
    values = _values(fleet, labelled)
    return _exact(fleet, values, _summary(values), survivors, sum(map(len, refs)), labelled)


def _central(
    fleet: Fleet, frame: DataFrame, n: int, ranges: list[np.ndarray] | None
) -> list[tuple[str, float]]:
    """The most central vehicles: bounds first, exact costs for those that may be among them."""
    # One cluster, whatever its medoid.
    refs = [np.zeros((1, fleet.n_bins))]
    if ranges is not None:
        lines = _lines(fleet, _sums(fleet, frame, refs), ranges)
        bounded = _near(fleet, frame, refs, lines, n).persist()
    else:
        labelled = frame.withColumn("codes", F.array(F.lit(0)))
        values = _values(fleet, labelled)
        summary = _summary(values).persist()
        bounded = _bounded(fleet, values, summary, 1).persist()
    try:
        reach = bounded.orderBy("high").limit(n).agg(F.max("high")).first()[0]
        near = bounded.where(F.col("low") <= reach + _SLACK + 1e-12 * reach)
        # One vehicle stands for all of its distribution.
        kinds = near.groupBy("q", "sig").agg(F.min("vin").alias("vin"))
        if ranges is not None:
            costs = _costs(fleet, frame, None, {}, refs, kinds, kinds.count())
        else:
            costs = _exact(fleet, values, summary, kinds, 1, labelled)
        costs = costs.join(kinds, ["vin", "q"]).select("sig", "cost")
        best = near.select("vin", "sig").join(costs, "sig").orderBy("cost", "vin").limit(n)
        return [(r["vin"], r["cost"]) for r in best.select("vin", "cost").collect()]
    finally:
        bounded.unpersist()
        if ranges is None:
            summary.unpersist()


def _update(
    fleet: Fleet,
    frame: DataFrame,
    medoids: dict[int, list[str]],
    points: dict[str, list[float]],
    ranges: list[np.ndarray] | None = None,
) -> dict[int, list[str]]:
    """One round for all given runs. Vectors of new medoids are added to ``points``."""
    current = [v for vins in medoids.values() for v in vins]
    n_clusters = len(current)
    held = []
    try:
        if ranges is not None:
            refs = _refs(medoids, points)
            lines = _lines(fleet, _sums(fleet, frame, refs), ranges)
            bounded = _near(fleet, frame, refs, lines, 1).persist()
        else:
            # Labels are made once a round; everything below reads them.
            labelled = _labelled(frame, medoids, points).persist()
            values = _values(fleet, labelled)
            summary = _summary(values).persist()
            bounded = _bounded(fleet, values, summary, n_clusters).persist()
            held += [labelled, summary]
        held.append(bounded)
        best_high = bounded.groupBy("q").agg(F.min("high").alias("best"))
        slack = F.lit(_SLACK) + F.lit(1e-12) * F.abs("best")
        mine = F.get(F.array(*[F.lit(v) for v in current]), F.col("q"))
        # Copies of one distribution have one cost. The lowest vin stands for them, unless one of them
        # is the medoid already. There is a row of best bounds per cluster.
        candidates = (
            bounded.join(F.broadcast(best_high), "q")
            .where(F.col("low") <= F.col("best") + slack)
            .groupBy("q", "sig")
            .agg(F.min("vin").alias("low_vin"), F.max(F.col("vin") == mine).alias("stays"))
            .select("q", F.when(F.col("stays"), mine).otherwise(F.col("low_vin")).alias("vin"))
        ).persist()
        held.append(candidates)
        found = candidates.groupBy("q").agg(F.min("vin").alias("vin"), F.count("*").alias("n")).collect()
        chosen = {r["q"]: r["vin"] for r in found if r["n"] == 1}
        open_ = {r["q"]: r["n"] for r in found if r["n"] > 1}
        if open_:
            rivals = candidates.where(F.col("q").isin(list(open_)))
            rank = F.struct("cost", (F.col("vin") != mine).alias("other"), "vin")
            if ranges is not None:
                costs = _costs(fleet, frame, medoids, points, refs, rivals, sum(open_.values()))
            else:
                costs = _exact(fleet, values, summary, rivals, n_clusters, labelled)
            rows = costs.groupBy("q").agg(F.min(rank).alias("rank")).collect()
            chosen.update({r["q"]: r["rank"]["vin"] for r in rows})
    finally:
        for rows in reversed(held):
            rows.unpersist()
    new = [chosen.get(q, vin) for q, vin in enumerate(current)]
    missing = [v for v in new if v not in points]
    if missing:
        points.update(_points_of(frame, missing))
    out, first = {}, 0
    for k, vins in medoids.items():
        out[k] = new[first : first + len(vins)]
        first += len(vins)
    return out


def silhouette_vehicles(fleet: Fleet, runs: dict[str, tuple[Column, int]]) -> DataFrame:
    """Silhouette of every vehicle for each run: ``vin`` and, per run, ``{run}``, ``{run}_score``.

    A run is a label column on ``fleet.frame`` with its number of clusters. The score is 0 for the
    only member of a cluster and where all distances are 0, and NULL unless at least two clusters
    have members and not every vehicle stands alone.
    """
    # Labels are made once; counts, totals and scores read them.
    coded = materialize(
        fleet.frame.select("vin", "point", *[c.cast("int").alias(r) for r, (c, _) in runs.items()]), "coded"
    )
    counts = coded.agg(
        *[
            F.count_if(F.col(r) == q).alias(f"{r}_{q}")
            for r, (_, k) in runs.items()
            for q in range(k)
        ]
    ).first()
    totals = looked_up_totals(fleet, coded, {r: k for r, (_, k) in runs.items()})
    if totals is None:
        totals = cluster_totals(fleet, runs)
    labels = coded.select("vin", *runs)
    scores = []
    for r, (_, k) in runs.items():
        sizes = [counts[f"{r}_{q}"] for q in range(k)]
        filled = sum(1 for s in sizes if s)
        if not 2 <= filled <= fleet.n - 1:
            scores.append(F.lit(None).cast("double").alias(f"{r}_score"))
            continue
        own = F.col(r)
        sums = F.col(f"{r}_totals")
        others = [
            F.when(own != q, F.get(sums, F.lit(q)) / sizes[q]) for q in range(k) if sizes[q]
        ]
        near = F.least(*others)
        size = F.get(double_array(sizes), own)
        # Totals of equal members can come out as tiny negative noise.
        inner = F.greatest(F.get(sums, own), F.lit(0.0)) / (size - 1)
        top = F.greatest(inner, near)
        score = F.when((size > 1) & (top > 10.0**-TIE_DECIMALS), F.try_divide(near - inner, top))
        scores.append(F.coalesce(score, F.lit(0.0)).alias(f"{r}_score"))
    return labels.join(totals, "vin").select("vin", *runs, *scores)


def silhouette(
    fleet: Fleet, label: Column, k: int, level: str = "overall"
) -> DataFrame:
    """Silhouette at ``level`` overall (one row), cluster or vehicle."""
    rows = silhouette_vehicles(fleet, {"cluster": (label, k)}).withColumnRenamed(
        "cluster_score", "silhouette"
    )
    if level == "vehicle":
        return rows
    if level == "cluster":
        return rows.groupBy("cluster").agg(
            F.count("*").alias("n_vehicles"), F.avg("silhouette").alias("silhouette")
        )
    if level == "overall":
        return rows.agg(F.avg("silhouette").alias("silhouette"))
    raise ValueError(f"unknown level {level!r}")


def score_sweep(fleet: Fleet, outcomes: dict[int, Medoids]) -> DataFrame:
    """Mean silhouette of each k, all from one sorted pass: ``k, silhouette``."""
    runs = {f"k{k}": (m.label(), k) for k, m in outcomes.items()}
    means = silhouette_vehicles(fleet, runs).agg(
        *[F.avg(f"{r}_score").alias(r) for r in runs]
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("silhouette"))
            for k in outcomes
        ]
    )
    return means.select(F.inline(rows))


def k_sweep(
    fleet: Fleet, ks: Iterable[int] = range(2, 7), max_iter: int = 300
) -> tuple[dict[int, Medoids], DataFrame]:
    """k-medoids for each k and the table ``k, silhouette``."""
    outcomes = kmedoids_sweep(fleet, ks, max_iter)
    return outcomes, score_sweep(fleet, outcomes)


def best_k(scores: DataFrame) -> DataFrame:
    """The row of highest silhouette; the smallest k wins a tie."""
    order = [F.round("silhouette", TIE_DECIMALS).desc_nulls_last(), F.col("k")]
    return scores.orderBy(*order).limit(1)


def choose_k(scores: DataFrame, policy: str = "best", k: int | None = None) -> int:
    """``fixed`` gives ``k`` itself, ``best`` the k of highest silhouette."""
    if policy == "fixed":
        if k is None:
            raise ValueError("the fixed policy needs k")
        return k
    if policy == "best":
        return best_k(scores).first()["k"]
    raise ValueError(f"unknown policy {policy!r}")


def soft_membership(fleet: Fleet, medoids: Medoids) -> DataFrame:
    """Weights by inverse distance to the medoids: ``vin, cluster, weight``, summing to 1.

    A vehicle that coincides with medoids belongs to them alone, in equal parts.
    """
    d = distances_to(F.col("point"), medoids.points)
    rows = fleet.frame.select("vin", d.alias("d"))
    hits = F.size(F.filter("d", lambda v: v <= 0))
    raw = F.when(
        hits > 0, F.transform("d", lambda v: F.when(v <= 0, 1.0).otherwise(0.0))
    ).otherwise(F.transform("d", lambda v: F.try_divide(F.lit(1.0), v)))
    rows = rows.select("vin", raw.alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda acc, v: acc + v)
    return rows.select(
        "vin", F.posexplode(F.transform("raw", lambda v: v / total)).alias("cluster", "weight")
    )
