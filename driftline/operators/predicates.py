"""Filters on extents and on paths."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import Envelope, boxes_overlap, planar_distance, segment_meets_box
from driftline.functions.text import KNOTS_TO_KMH, MS_TO_KMH
from driftline.operators.sequence import neighbours, with_chunk
from driftline.operators.temporal import KEY, POSITION, speed_agreement, trip_length

Time = datetime | str

# Limits of the outlier rules.
MAX_TRIP_METRES = 1_500_000.0
MAX_SPEED_GAP_KMH = 100.0


def bbox_overlap(extents: DataFrame, box: Envelope) -> DataFrame:
    """Extents that share a point with the box, edges included."""
    return extents.filter(boxes_overlap(box))


def time_overlap(extents: DataFrame, start: Time | None, end: Time | None) -> DataFrame:
    """Lifespans that meet the closed interval; an open end (``None``) sets no limit."""
    out = extents
    if end is not None:
        out = out.filter(F.col("tmin") <= F.lit(end).cast("timestamp"))
    if start is not None:
        out = out.filter(F.col("tmax") >= F.lit(start).cast("timestamp"))
    return out


def instant_overlap(extents: DataFrame, at: Time) -> DataFrame:
    """Lifespans that hold the instant."""
    return time_overlap(extents, at, at)


def _hit(box: Envelope) -> Column:
    """The segment from the row to its next instant meets the box; the last is a point."""
    x, y = F.col("x"), F.col("y")
    return segment_meets_box(
        x, y, F.coalesce("next.x", x), F.coalesce("next.y", y),
        F.lit(box.xmin), F.lit(box.ymin), F.lit(box.xmax), F.lit(box.ymax),
    )


def ever_intersects(
    instants: DataFrame,
    box: Envelope,
    key: Sequence[str] = KEY,
    extents: DataFrame | None = None,
    **chunking,
) -> DataFrame:
    """Keys of the paths that meet the box at some time.

    With ``extents`` at hand, paths whose extent misses the box are left out before
    the exchange.
    """
    points = with_chunk(instants, [*key, "t", "x", "y"])
    if extents is not None:
        points = points.join(bbox_overlap(extents, box).select(*key), list(key), "left_semi")
    rows = neighbours(points, key, POSITION, **chunking)
    return rows.filter(_hit(box)).select(*key).distinct()


def visits_both(
    instants: DataFrame, first: Envelope, second: Envelope, key: Sequence[str] = KEY, **chunking
) -> DataFrame:
    """Paths that meet both boxes, with their length in km; one pass for all three."""
    rows = neighbours(with_chunk(instants, [*key, "t", "x", "y"]), key, POSITION, **chunking)
    step = planar_distance(F.col("x"), F.col("y"), F.col("next.x"), F.col("next.y"))
    return (
        rows.groupBy(*key)
        .agg(
            F.bool_or(_hit(first)).alias("in_first"),
            F.bool_or(_hit(second)).alias("in_second"),
            (F.coalesce(F.sum(step), F.lit(0.0)) / 1000).alias("length_km"),
        )
        .filter("in_first and in_second")
        .select(*key, "length_km")
    )


def length_filter(
    instants: DataFrame, key: Sequence[str] = KEY, max_length: float = MAX_TRIP_METRES, **chunking
) -> DataFrame:
    """Lengths of the paths that moved and are not implausibly long."""
    return trip_length(instants, key, **chunking).filter(
        (F.col("length") > 0) & (F.col("length") < max_length)
    )


def speed_consistency(
    instants: DataFrame,
    reported: str = "sog",
    key: Sequence[str] = KEY,
    max_gap: float = MAX_SPEED_GAP_KMH,
    **chunking,
) -> DataFrame:
    """Paths whose reported mean speed (knots) agrees with the travelled one (m/s).

    Adds ``gap_kmh`` and ``length``. A path without a travelled speed is dropped.
    """
    gap = F.abs(F.col("twavg_reported") * KNOTS_TO_KMH - F.col("twavg_speed") * MS_TO_KMH)
    return (
        speed_agreement(instants, reported, key, **chunking)
        .select(*key, "length", gap.alias("gap_kmh"))
        .filter(F.col("gap_kmh") <= max_gap)
    )
