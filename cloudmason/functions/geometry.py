"""Column expressions for boxes and points. A box of prefix p has the columns p_min_x .. p_max_z; no prefix: min_x .. max_z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyz"


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}_{name}" if prefix else name)


def axis_gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Empty space between two intervals, 0 where they meet."""
    return F.greatest(lo_b - hi_a, lo_a - hi_b, F.lit(0.0))


def gaps(a: str, b: str) -> list[Column]:
    return [axis_gap(_c(a, f"min_{x}"), _c(a, f"max_{x}"), _c(b, f"min_{x}"), _c(b, f"max_{x}")) for x in AXES]


def norm(*parts: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def bounds_gap(a: str, b: str) -> Column:
    return norm(*gaps(a, b))


def centroid_distance(a: str, b: str) -> Column:
    return norm(*(_c(a, f"c{x}") - _c(b, f"c{x}") for x in AXES))


def vertical_gap(a: str, b: str) -> Column:
    """Vertical empty space between two boxes; never negative."""
    return gaps(a, b)[2]


def penetration_gap(upper: str, lower: str) -> Column:
    """Bottom of the upper box minus top of the lower one; negative where they overlap."""
    return _c(upper, "min_z") - _c(lower, "max_z")


def xy_area(p: str = "") -> Column:
    return F.greatest(_c(p, "max_x") - _c(p, "min_x"), F.lit(0.0)) * F.greatest(_c(p, "max_y") - _c(p, "min_y"), F.lit(0.0))


def xy_overlap_ratio(a: str, b: str) -> Column:
    """Intersection over the smaller footprint, 0 where that is empty."""
    shared = [F.greatest(F.lit(0.0), F.least(_c(a, f"max_{x}"), _c(b, f"max_{x}")) - F.greatest(_c(a, f"min_{x}"), _c(b, f"min_{x}"))) for x in "xy"]
    smaller = F.least(xy_area(a), xy_area(b))
    return F.when(smaller > 0, shared[0] * shared[1] / smaller).otherwise(0.0)


def boxes_meet(a: str, b: str) -> Column:
    """Boxes overlap or touch on every axis."""
    meet = F.lit(True)
    for x in AXES:
        meet &= (_c(a, f"max_{x}") >= _c(b, f"min_{x}")) & (_c(b, f"max_{x}") >= _c(a, f"min_{x}"))
    return meet


def box_centre(axis: str, p: str = "") -> Column:
    return (_c(p, f"min_{axis}") + _c(p, f"max_{axis}")) / 2


def box_size(axis: str, p: str = "") -> Column:
    return _c(p, f"max_{axis}") - _c(p, f"min_{axis}")


def volume(p: str = "") -> Column:
    return box_size("x", p) * box_size("y", p) * box_size("z", p)
