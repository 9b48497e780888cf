"""Common ordered bin grids, and the occupied part of long ones."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.functions.arrays import double_array
from fleetspectra.functions.intervals import is_finite, let

# A grid from data with more bins than this is replaced by the axis of its occupied bins.
WIDE_GRID = 4096
# Axes of at most so many places are broadcast.
AXIS_ROWS = 400_000


@dataclass(frozen=True)
class GridSpec:
    """``n`` bin centers ``first, first + step, ...``."""

    first: float
    step: float
    n: int

    def __post_init__(self):
        if self.n < 1 or self.step <= 0:
            raise ValueError(f"a grid needs at least one bin and a positive step: {self}")

    @classmethod
    def between(cls, start: float, stop: float, step: float) -> GridSpec:
        """Centers from ``start`` up to, and without, ``stop``."""
        return cls(float(start), float(step), math.ceil((stop - start) / step))

    @classmethod
    def from_data(
        cls, centers: DataFrame, start: float, step: float, cap: float | None = None
    ) -> GridSpec:
        """A grid reaching the largest finite ``bin_center`` of the fleet, or a stated cap.

        One stray interval far out makes a very long grid; ``Axis`` holds what is occupied of it.
        """
        top = cap
        if top is None:
            top = center_bounds(centers).first()["max_center"]
        if top is None:
            raise ValueError("no finite bin center to build a grid from")
        return cls.between(start, top + step, step)

    @property
    def number_type(self) -> str:
        """Type of bin numbers."""
        return "int" if self.n < 2**31 - 1 else "bigint"

    @property
    def centers(self) -> list[float]:
        return [self.first + i * self.step for i in range(self.n)]

    def centers_column(self) -> Column:
        """The centers as a constant array column."""
        return F.transform(
            F.sequence(F.lit(0), F.lit(self.n - 1)),
            lambda i: F.lit(self.first) + i * F.lit(self.step),
        )

    def center_of(self, index: Column | str) -> Column:
        i = F.col(index) if isinstance(index, str) else index
        return F.lit(self.first) + i * F.lit(self.step)

    def position_of(self, center: Column | str, tolerance: float = 0.0) -> Column:
        """Position of a center on the grid, counted from 1; NULL when it is not on it.

        By arithmetic, in the same time for a grid of any length.
        """
        c = F.col(center) if isinstance(center, str) else center

        def checked(value: Column, i: Column) -> Column:
            off = F.abs(value - self.center_of(i))
            on_grid = i.between(0, self.n - 1) & (off <= F.lit(float(tolerance)))
            return F.when(on_grid, i.cast(self.number_type) + 1)

        return let(
            c,
            lambda v: let(
                F.rint((v - F.lit(self.first)) / F.lit(self.step)), lambda i: checked(v, i)
            ),
        )


@dataclass(frozen=True)
class Axis:
    """The occupied bins of a grid, each reaching to the next one.

    Between two neighbouring places of the axis no vehicle's cumulative share changes, so distances on the
    axis, with its ``widths``, are those on the whole grid, however far the grid reaches. Bins are numbered
    along the axis.
    """

    grid: GridSpec
    places: tuple[int, ...]

    @classmethod
    def from_data(cls, centers: DataFrame, grid: GridSpec) -> Axis:
        """The bins of ``grid`` that rows with a ``bin_center`` fall into: one number each on the driver."""
        place = grid.position_of("bin_center") - 1
        found = centers.select(place.alias("place")).where("place is not null").distinct().collect()
        if not found:
            raise ValueError("no finite bin center on the grid to build an axis from")
        return cls(grid, tuple(sorted(r["place"] for r in found)))

    @property
    def n(self) -> int:
        return len(self.places)

    @property
    def step(self) -> float:
        return self.grid.step

    @cached_property
    def widths(self) -> tuple[float, ...]:
        """Steps from each place to the next, and one after the last."""
        return tuple(float(b - a) for a, b in zip(self.places, (*self.places[1:], self.places[-1] + 1)))

    @cached_property
    def centers(self) -> list[float]:
        return [self.grid.first + i * self.grid.step for i in self.places]

    def centers_column(self) -> Column:
        return double_array(self.centers)

    def center_of(self, index: Column | str) -> Column:
        return F.get(self.centers_column(), F.col(index) if isinstance(index, str) else index)

    def number(self, rows: DataFrame) -> DataFrame:
        """Rows with ``bin`` of the grid, renumbered along the axis; bins that it lacks are left out."""
        spark = rows.sparkSession
        kind = self.grid.number_type
        table = spark.createDataFrame(list(enumerate(self.places)), f"along int, bin {kind}")
        side = F.broadcast(table) if self.n <= AXIS_ROWS else table
        return rows.join(side, "bin").withColumn("bin", F.col("along")).drop("along")


# The weight grid has 38 bins of 1000 kg from 12500, the gradient grid 10 bins from 0.5.
WEIGHT_GRID = GridSpec(12500.0, 1000.0, 38)
GRADIENT_GRID = GridSpec(0.5, 1.0, 10)


def center_bounds(centers: DataFrame) -> DataFrame:
    """Global minimum and maximum of the finite bin centers."""
    c = F.when(is_finite("bin_center"), F.col("bin_center"))
    return centers.agg(F.min(c).alias("min_center"), F.max(c).alias("max_center"))


def grid_table(spark, grid: GridSpec | Axis) -> DataFrame:
    """The grid, of any length, as rows ``bin, bin_center``."""
    kind = "int" if isinstance(grid, Axis) else grid.number_type
    rows = spark.range(grid.n).select(F.col("id").cast(kind).alias("bin"))
    return rows.withColumn("bin_center", grid.center_of("bin"))
