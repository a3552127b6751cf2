"""Port traffic: ships in a port area, speeding, stops, and the part within an interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import Envelope
from driftline.operators import temporal
from driftline.operators.predicates import bbox_overlap, ever_intersects

# Fixed value: speed limit in the port, m/s (10 knots).
SPEED_LIMIT = 5.14


def port_traffic(
    instants: DataFrame, port: Envelope, start: str, end: str, limit: float = SPEED_LIMIT
) -> DataFrame:
    """Per trajectory whose extent meets the port: entry, speeding, stops, cut size."""
    extents = temporal.extent(instants)
    near = bbox_overlap(extents, port).select("geom_id")
    paths = instants.select("geom_id", "t", "x", "y").join(near, "geom_id", "left_semi")
    speeds = temporal.speed_states(paths).groupBy("geom_id").agg(
        F.max("speed").alias("max_speed"),
        F.coalesce(F.bool_or(F.col("speed") > limit), F.lit(False)).alias("violates"),
        F.count_if(F.col("status") == "STOPPED").alias("n_stopped"),
    )
    entered = ever_intersects(paths, port).withColumn("entered", F.lit(True))
    inside = temporal.subtrajectory(paths, start, end).groupBy("geom_id").agg(F.count("*").alias("n_cut"))
    return (
        near.join(entered, "geom_id", "left")
        .join(speeds, "geom_id", "left")
        .join(inside, "geom_id", "left")
        .select(
            "geom_id",
            F.coalesce("entered", F.lit(False)).alias("entered"),
            F.coalesce("violates", F.lit(False)).alias("violates"),
            F.coalesce("n_stopped", F.lit(0)).alias("n_stopped"),
            F.coalesce("n_cut", F.lit(0)).alias("n_cut"),
            "max_speed",
        )
    )
