"""Planar geometry as Column expressions: distance, interpolation, boxes, GeoJSON."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Envelope(NamedTuple):
    """Axis-parallel box with ordered corners; build it with :func:`envelope`."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float


def envelope(x1: float, y1: float, x2: float, y2: float) -> Envelope:
    """Box from two opposite corners given in any order."""
    return Envelope(min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2))


def envelope_columns(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """The same for columns; yields xmin, ymin, xmax, ymax."""
    return [
        F.least(x1, x2).alias("xmin"),
        F.least(y1, y2).alias("ymin"),
        F.greatest(x1, x2).alias("xmax"),
        F.greatest(y1, y2).alias("ymax"),
    ]


def round_to(value: Column, digits: int) -> Column:
    """Value to so many decimals in plain double arithmetic.

    Spark's own ``round`` goes through a decimal object per value, which is far slower.
    """
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def boxes_overlap(box: Envelope) -> Column:
    """Edge-inclusive overlap of the row's extent columns with ``box``.

    Plain comparisons on plain columns, so the predicate reaches Parquet statistics.
    """
    return (
        (F.col("xmin") <= F.lit(box.xmax))
        & (F.col("xmax") >= F.lit(box.xmin))
        & (F.col("ymin") <= F.lit(box.ymax))
        & (F.col("ymax") >= F.lit(box.ymin))
    )


def segment_meets_box(
    x1: Column, y1: Column, x2: Column, y2: Column,
    xmin: Column, ymin: Column, xmax: Column, ymax: Column,
) -> Column:
    """True when the closed segment shares a point with the closed box.

    Parametric clipping: the segment is inside the x slab for one interval of its
    parameter and inside the y slab for another; it meets the box when both and
    [0, 1] have a common value. A zero extent gives NULL bounds, which
    ``greatest``/``least`` skip, and is checked by plain comparison instead.
    """
    dx, dy = x2 - x1, y2 - y1
    ax, bx = F.try_divide(xmin - x1, dx), F.try_divide(xmax - x1, dx)
    ay, by = F.try_divide(ymin - y1, dy), F.try_divide(ymax - y1, dy)
    enter = F.greatest(F.lit(0.0), F.least(ax, bx), F.least(ay, by))
    leave = F.least(F.lit(1.0), F.greatest(ax, bx), F.greatest(ay, by))
    return (
        (enter <= leave)
        & ((dx != 0) | x1.between(xmin, xmax))
        & ((dy != 0) | y1.between(ymin, ymax))
    )


def interpolate(before: Column, after: Column, at: Column) -> Column:
    """Linear position of ``struct<t,x,y>`` pair at time ``at``, as the same struct."""
    share = F.try_divide(seconds_between(before["t"], at), seconds_between(before["t"], after["t"]))
    return F.struct(
        at.alias("t"),
        (before["x"] + (after["x"] - before["x"]) * share).alias("x"),
        (before["y"] + (after["y"] - before["y"]) * share).alias("y"),
    )


def geojson_shape(points: Column, discrete: bool | Column = False) -> Column:
    """GeoJSON text of an ordered ``array<struct<x,y>>`` without consecutive repeats."""
    coords = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    flag = discrete if isinstance(discrete, Column) else F.lit(discrete)
    line_type = F.when(flag, F.lit("MultiPoint")).otherwise(F.lit("LineString"))
    line = F.to_json(F.struct(line_type.alias("type"), coords.alias("coordinates")))
    point = F.to_json(
        F.struct(F.lit("Point").alias("type"), F.try_element_at(coords, F.lit(1)).alias("coordinates"))
    )
    return F.when(F.size(points) == 0, F.lit(None)).when(F.size(points) == 1, point).otherwise(line)
