"""Arithmetic on ``array<double>`` columns with built-in higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetspectra.functions.intervals import let

# Distances are compared in bin units, rounded to this many decimals, so that float noise cannot
# decide an argmin. Ties are then broken by stated rules.
TIE_DECIMALS = 9


def double_array(values: Sequence[float]) -> Column:
    """A constant ``array<double>`` that Catalyst folds to one literal, whatever its length."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def double_matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A constant ``array<array<double>>``."""
    return F.array(*[double_array(r) for r in rows])


def array_total(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, v: acc + v)


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two equally long arrays."""
    return array_total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def w1(cdf_a: Column, cdf_b: Column, step: float = 1.0) -> Column:
    """Exact 1-D Wasserstein distance of two distributions on one grid of constant step.

    Both arguments are cumulative distributions. The width after the last bin does not matter, as
    both end at 1.
    """
    return l1(cdf_a, cdf_b) * F.lit(float(step))


def w1_probs(probs_a: Column, probs_b: Column, centers: Sequence[float]) -> Column:
    """The same distance from two probability arrays on any ordered grid of bin centers: one pass."""
    widths = [b - a for a, b in zip(centers, centers[1:])] + [1.0]
    steps = F.zip_with(
        F.zip_with(probs_a, probs_b, lambda x, y: x - y),
        double_array(widths),
        lambda d, w: F.struct(d.alias("d"), w.alias("w")),
    )
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("total"))

    def add(state: Column, v: Column) -> Column:
        gap = state["gap"] + v["d"]
        return F.struct(gap.alias("gap"), (state["total"] + F.abs(gap) * v["w"]).alias("total"))

    return F.aggregate(steps, start, add, lambda state: state["total"])


def w1_sparse(cells_a: Column, cells_b: Column) -> Column:
    """The same distance from two ascending arrays of structs with ``center`` and ``cdf``, on no grid.

    The two lists are merged; between two neighbouring centers the difference of the cumulative shares counts
    by the gap. The work depends on how many centers the two have, not on how far these reach.
    """

    def of_side(cells: Column, side: int) -> Column:
        return F.transform(
            cells, lambda c: F.struct(c["center"].alias("at"), F.lit(side).alias("side"), c["cdf"].alias("cdf"))
        )

    merged = F.sort_array(F.concat(of_side(cells_a, 0), of_side(cells_b, 1)))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("at"), zero.alias("a"), zero.alias("b"), zero.alias("total"))

    def add(state: Column, v: Column) -> Column:
        more = F.abs(state["a"] - state["b"]) * (v["at"] - state["at"])
        return F.struct(
            v["at"].alias("at"),
            F.when(v["side"] == 0, v["cdf"]).otherwise(state["a"]).alias("a"),
            F.when(v["side"] == 1, v["cdf"]).otherwise(state["b"]).alias("b"),
            (state["total"] + more).alias("total"),
        )

    return F.aggregate(merged, start, add, lambda state: state["total"])


def block_sums(point: Column, n_bins: int, blocks: int) -> Column:
    """A point's sums over ``blocks`` runs of neighbouring bins.

    The L1 distance of two points' block sums never exceeds the distance of the points: a coarser view of
    the same axis bounds the fine one from below.
    """
    cuts = [n_bins * i // blocks for i in range(blocks + 1)]
    return F.array(
        *[array_total(F.slice(point, a + 1, b - a)) for a, b in zip(cuts, cuts[1:])]
    )


def differences(col: Column | str) -> Column:
    """What each element adds to the one before: the inverse of prefix sums."""
    before = F.concat(F.array(F.lit(0.0)), F.slice(col, F.lit(1), F.size(col) - 1))
    return F.zip_with(col, before, lambda a, b: a - b)


def distances_to(point: Column, refs: Sequence[Sequence[float]]) -> Column:
    """Array of L1 distances from ``point`` to each constant reference, rounded for comparing."""
    return F.transform(double_matrix(refs), lambda r: F.round(l1(point, r), TIE_DECIMALS))


def nearest(point: Column, refs: Sequence[Sequence[float]]) -> Column:
    """Position (from 0) of the nearest constant reference; the lowest position wins a tie."""
    position = let(distances_to(point, refs), lambda d: F.array_position(d, F.array_min(d)))
    # Never NULL; saying so keeps the optimizer from adding a filter that labels every row again.
    return F.coalesce((position - 1).cast("int"), F.lit(0))
