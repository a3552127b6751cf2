"""Readers of ship documents written as one large JSON array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHIP = """
    mmsi long, trajectory string, sog string, cog string, heading string,
    properties struct<Name: string, IMO: string, ShipType: string, Destination: string>
"""


def read_ship_array(spark: SparkSession, path: str) -> DataFrame:
    """Ships of top-level JSON arrays; one file is one task, so convert big ones once."""
    return spark.read.schema(SHIP).option("multiLine", True).json(path)


def read_ship_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ships of JSON lines, as this library writes them; splittable."""
    return spark.read.schema(SHIP).json(path)


def ships_from(ships: DataFrame, start: int = 0, at: int | None = None) -> DataFrame:
    """Ships from a position in ``mmsi`` order, or the one at a position.

    Position replaces the place in the file. It is a key range: the bound is found by a
    top-k over the keys, so no numbering of all rows is needed.
    """
    if at is not None:
        start = at
    if start <= 0:
        rest = ships
    else:
        skipped = ships.select("mmsi").orderBy("mmsi").limit(start).agg(F.max("mmsi").alias("_m"), F.count("*").alias("_n"))
        rest = (
            ships.withColumns({"_m": skipped.select("_m").scalar(), "_n": skipped.select("_n").scalar()})
            .filter((F.col("mmsi") > F.col("_m")) & (F.col("_n") == start))
            .drop("_m", "_n")
        )
    return rest if at is None else rest.orderBy("mmsi").limit(1)
