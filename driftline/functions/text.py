"""Scalar text, time and unit helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations and unit factors of the data model.
PROPERTY_TYPES = ("TBoolean", "TText", "TInteger", "TReal", "TImage")
INTERPOLATIONS = ("Discrete", "Step", "Linear", "Regression")
ITEM_TYPE = "movingfeature"
KNOTS_TO_KMH = 1.852
MS_TO_KMH = 3.6
MS_TO_KNOTS = 1.94384
DEFAULT_SRID = 4326


def slug(title: Column) -> Column:
    """Identifier of a collection: lower case with underscores for spaces."""
    return F.replace(F.lower(title), F.lit(" "), F.lit("_"))


def srid_of(crs_properties: Column) -> Column:
    """First run of digits in the CRS description; WGS 84 where there is none or it is no integer."""
    digits = F.nullif(F.regexp_extract(crs_properties, r"(\d+)", 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(DEFAULT_SRID))


def length_unit(srid: Column) -> Column:
    return F.when(srid == DEFAULT_SRID, F.lit("degree")).otherwise(F.lit("meters"))


def speed_unit(srid: Column) -> Column:
    return F.when(srid == DEFAULT_SRID, F.lit("degree/s")).otherwise(F.lit("m/s"))


def parse_time(text: Column) -> Column:
    """Timestamp from ISO text with ``T`` or space and ``Z``, ``+00`` or no zone.

    Text without a zone is read in the session zone, which is UTC. Bad text is NULL.
    """
    return text.try_cast("timestamp")


def iso_time(t: Column) -> Column:
    """ISO text in UTC with microseconds."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def speed_status(speed: Column) -> Column:
    """Status labels of the port-traffic case."""
    return (
        F.when(speed == 0, F.lit("STOPPED"))
        .when(speed < 1, F.lit("docking"))
        .otherwise(F.lit("Moving"))
    )
