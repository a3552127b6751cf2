"""From raw position reports to ship trips: the two cleaning profiles end to end."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import Envelope, envelope
from driftline.operators import reports as R
from driftline.operators.predicates import MAX_TRIP_METRES, ever_intersects, speed_consistency
from driftline.operators.sequence import assign_chunks
from driftline.session import cut_lineage
from driftline.sources.export import ship_documents

# Fixed value: the ferry belt in EPSG:25832, corners as published.
FERRY_BELT = envelope(640730, 6058230, 654100, 6042487)


class AisDay(NamedTuple):
    positions: DataFrame
    checked: DataFrame
    trips: DataFrame
    documents: DataFrame


def clean_positions(raw: DataFrame) -> DataFrame:
    """Cleaned, projected and de-duplicated reports of the first profile."""
    inside = R.domain_filter(R.clean_placeholders(raw))
    return R.dedup_reports(R.to_utm32(inside))


def plausible_ships(positions: DataFrame, max_length: float = MAX_TRIP_METRES, **chunking) -> DataFrame:
    """Ships whose trip moved, is not too long, and agrees with the reported speed."""
    agreeing = speed_consistency(positions, key=["mmsi"], **chunking)
    return agreeing.filter((F.col("length") > 0) & (F.col("length") < max_length))


def ais_day(
    raw: DataFrame,
    belt: Envelope | None = FERRY_BELT,
    keep: bool = True,
    max_length: float = MAX_TRIP_METRES,
    **chunking,
) -> AisDay:
    """First profile. ``keep`` writes the clean positions to the checkpoint folder once.

    They feed the checks, the belt test and the assembly; without that each of them
    would read and de-duplicate the reports again. Chunks of large ships are assigned
    once for all three.
    """
    positions = assign_chunks(clean_positions(raw), ["mmsi"], **chunking)
    if keep:
        positions = cut_lineage(positions)
    checked = plausible_ships(positions, max_length)
    ships = checked.select("mmsi")
    if belt is not None:
        plausible = positions.join(ships, "mmsi", "left_semi")
        ships = ever_intersects(plausible, belt, key=["mmsi"])
    trips = R.assemble_trips(positions.join(ships, "mmsi", "left_semi"))
    return AisDay(positions, checked, trips, ship_documents(trips))


def profile_trips(raw: DataFrame, keep: bool = True) -> DataFrame:
    """Second profile: geographic coordinates, no outlier rules, first known attributes."""
    unique = R.dedup_reports(raw)
    clean = R.clean_profile(unique).withColumns({"x": F.col("lon"), "y": F.col("lat")})
    if keep:
        clean = cut_lineage(clean)
    return R.assemble_trips(clean, attributes=R.first_attributes(clean))
