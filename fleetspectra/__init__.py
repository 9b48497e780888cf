"""Segment a fleet by how each vehicle's usage is distributed, as native Spark DataFrame jobs."""

from fleetspectra.operators.grid import GRADIENT_GRID, WEIGHT_GRID, GridSpec

__all__ = ["GridSpec", "WEIGHT_GRID", "GRADIENT_GRID"]
