"""Cleaning, de-duplication and assembly of position reports.

Reports have ``mmsi, t, lat, lon, sog, cog, heading`` and static text columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.projection import lonlat_from_utm32, utm32_from_lonlat
from driftline.operators.sequence import CHUNK, assign_chunks, known_neighbours, pack, with_chunk
from driftline.operators.temporal import is_turn

# Texts that stand for "not known", by column.
PLACEHOLDERS = {
    "navigational_status": ("Unknown value", "Undefined"),
    "imo": ("Unknown",),
    "ship_type": ("Undefined",),
    "cargo_type": ("Undefined",),
    "type_of_position_fixing_device": ("Undefined",),
    "destination": ("Unknown", "Undefined"),
    "name": ("Unknown",),
    "callsign": ("Unknown",),
}
# Valid area in degrees and valid speed over ground.
LAT_RANGE = (40.18, 84.73)
LON_RANGE = (-16.1, 32.88)
SOG_RANGE = (0.0, 1022.0)

STATIC_COLUMNS = (
    "name", "imo", "ship_type", "cargo_type", "destination", "callsign",
    "navigational_status", "type_of_mobile", "length", "width", "draught",
)
FIRST_COLUMNS = ("name", "imo", "ship_type", "destination")


def clean_placeholders(reports: DataFrame) -> DataFrame:
    present = {c: v for c, v in PLACEHOLDERS.items() if c in reports.columns}
    return reports.withColumns(
        {c: F.when(F.col(c).isin(*texts), F.lit(None)).otherwise(F.col(c)) for c, texts in present.items()}
    )


def _in_area() -> Column:
    return F.col("lat").between(*LAT_RANGE) & F.col("lon").between(*LON_RANGE)


def domain_filter(reports: DataFrame) -> DataFrame:
    """Reports inside the area with speed and course known."""
    return reports.filter(_in_area() & F.col("sog").isNotNull() & F.col("cog").isNotNull())


def coerce_numeric(reports: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to number; what is no number becomes NULL."""
    return reports.withColumns({c: F.col(c).try_cast("double") for c in columns})


def default_name(reports: DataFrame, column: str = "name", default: str = "No Name") -> DataFrame:
    """Empty text becomes ``default``; NULL stays NULL."""
    return reports.withColumn(column, F.when(F.col(column) == "", F.lit(default)).otherwise(F.col(column)))


def clean_profile(reports: DataFrame) -> DataFrame:
    """Second cleaning profile: stricter on motion, keeps rows without destination."""
    numbers = coerce_numeric(reports, ("lat", "lon", "sog", "cog", "heading"))
    return default_name(
        numbers.filter(
            (F.col("mmsi") != 0)
            & _in_area()
            & F.col("sog").between(*SOG_RANGE)
            & F.col("cog").isNotNull()
            & F.col("heading").isNotNull()
            & ~F.col("destination").eqNullSafe("Undefined")
        )
    )


def to_utm32(reports: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``x, y`` in EPSG:25832."""
    x, y = utm32_from_lonlat(F.col(lon), F.col(lat))
    return reports.withColumns({"x": x, "y": y})


def to_wgs84(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``lon, lat`` in EPSG:4326."""
    lon, lat = lonlat_from_utm32(F.col(x), F.col(y))
    return points.withColumns({"lon": lon, "lat": lat})


def dedup_reports(reports: DataFrame, key: Sequence[str] = ("mmsi", "t")) -> DataFrame:
    """One report per key: the least by all other columns, NULL first.

    A minimum has partial results before the exchange, so a report that comes very
    often is thinned out in each task; a rank over the copies would gather them.
    """
    rest = [c for c in reports.columns if c not in key]
    picked = reports.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in reports.columns])


def static_attributes(reports: DataFrame, columns: Sequence[str] = STATIC_COLUMNS) -> DataFrame:
    """Least known value of each static column per ship."""
    return reports.groupBy("mmsi").agg(*[F.min(c).alias(c) for c in columns if c in reports.columns])


def first_attributes(reports: DataFrame, columns: Sequence[str] = FIRST_COLUMNS) -> DataFrame:
    """Earliest known value of each static column per ship."""
    known = {c: F.when(F.col(c).isNotNull(), F.struct("t", F.col(c).alias("v"))) for c in columns}
    return reports.groupBy("mmsi").agg(*[F.min(s)["v"].alias(c) for c, s in known.items()])


def report_counts(reports: DataFrame) -> DataFrame:
    """Reports and distinct times per ship; the distinct is spread over (ship, time)."""
    per_time = reports.groupBy("mmsi", "t").agg(F.count("*").alias("_n"))
    return per_time.groupBy("mmsi").agg(F.sum("_n").alias("n_reports"), F.count("t").alias("n_times"))


def assemble_trips(
    reports: DataFrame,
    numbers: Sequence[str] = ("sog", "cog", "heading"),
    attributes: DataFrame | None = None,
    **chunking,
) -> DataFrame:
    """One row per ship: normalised path, number sequences, static attributes.

    Each number is a sequence of its own, over the reports on which it is known. Path and
    numbers share one window over the reports, and arrays and attributes are built where
    the window leaves the rows, so all reports move once.

    A very large ship has one row per ``part``, in time order; every part carries the
    attributes, and each sequence begins with its last value before (``joined``).
    """
    columns = [c for c in STATIC_COLUMNS if c in reports.columns] if attributes is None else []
    rows = with_chunk(reports, ["mmsi", "t", "x", "y", *[c for c in (*numbers, *columns) if c not in ("x", "y")]])
    sequences = {"trip": ("x", "y")} | {n: (n,) for n in numbers}
    beside = known_neighbours(rows, ["mmsi"], sequences, **chunking)

    def shown(name: str, fields: Sequence[str], value: Column) -> Column:
        known = F.lit(True)
        for f in fields:
            known = known & F.col(f).isNotNull()
        return F.when(known & is_turn(fields, "Linear", f"prev_{name}", f"next_{name}"), value)

    arrays = {"trip": shown("trip", ("x", "y"), F.struct("t", "x", "y"))}
    arrays |= {n: shown(n, (n,), F.struct("t", F.col(n).cast("double").alias("v"))) for n in numbers}
    least = [F.min(c).alias(c) for c in columns]
    packed = pack(beside, ["mmsi"], arrays, least)
    if attributes is not None:
        return packed.join(attributes, "mmsi", "left")
    if not columns:
        return packed
    # The slices of a very large ship know their own least values only.
    whole = beside.filter(F.col(CHUNK).isNotNull()).groupBy(F.col("mmsi").alias("_mmsi")).agg(*[F.min(c).alias(f"_{c}") for c in columns])
    return packed.join(whole, F.col("mmsi") == F.col("_mmsi"), "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in packed.columns]
    )
