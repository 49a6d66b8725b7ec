"""Distances, orderings and predicates of points as column expressions.

A point is an array column or a list of scalar columns. Arithmetic is in double, summed in axis order, so that every
strategy and every engine that sums alike gives the same number; precision="float" keeps float products and sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared(x: Column) -> Column:
    return x * x


def squared_distance(a: Column, b: Column, precision: str = "double") -> Column:
    """Squared Euclidean distance of two array columns, any number of axes, within one fold."""
    diff = F.zip_with(a, b, lambda x, y: x.cast(precision) - y.cast(precision))
    return F.aggregate(diff, F.lit(0.0).cast(precision), lambda s, x: s + x * x)


def squared_distance_columns(a: Sequence[Column], b: Sequence[Column], precision: str = "double") -> Column:
    """The same for scalar columns, unrolled into generated code; for few axes."""
    total = None
    for x, y in zip(a, b, strict=True):
        d = x.cast(precision) - y.cast(precision)
        total = d * d if total is None else total + d * d
    return total


def plane_distance(query: Column, point: Column, axis: Column | int) -> Column:
    """Squared gap between a query and the splitting plane through a point (0-based axis)."""
    at = (F.lit(axis) if isinstance(axis, int) else axis).cast("int") + 1
    d = F.element_at(query, at).cast("double") - F.element_at(point, at).cast("double")
    return d * d


def box_distance(query: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Squared distance of a query to a box: a lower bound for every point in it."""
    total = F.lit(0.0)
    for q, lo, hi in zip(query, low, high, strict=True):
        d = F.greatest(lo - q, F.lit(0.0), q - hi)
        total = total + d * d
    return total


def super_key(coords: Column, axis: int, dims: int) -> list[Column]:
    """Coordinates from an axis on, cyclically: the total order of the axis."""
    return [coords[(axis + k) % dims] for k in range(dims)]


def super_key_less(a: Column, b: Column, axis: Column, dims: int) -> Column:
    """Whether point a precedes b in the order of an axis that may differ row by row."""
    turn = lambda c: F.concat(F.slice(c, axis + 1, dims), F.slice(c, F.lit(1), axis))
    return turn(a) < turn(b)


def within_ball(dist2: Column, radius: float) -> Column:
    """Open ball."""
    return dist2 < F.lit(float(radius) * float(radius))


def within_box(a: Column, b: Column, cut: float) -> Column:
    """Closed box: no axis differs by more than cut."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d <= F.lit(float(cut)))
