"""Readers of AIS position reports in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.schemas import AIS_REPORT

DAY_FIRST = "dd/MM/yyyy HH:mm:ss"
CORRUPT = "_corrupt"

# File headings of the pruned profile and their short names.
PROFILE_COLUMNS = {
    "# Timestamp": "t",
    "MMSI": "mmsi",
    "Latitude": "lat",
    "Longitude": "lon",
    "SOG": "sog",
    "COG": "cog",
    "Heading": "heading",
    "Name": "name",
    "Ship type": "ship_type",
    "Destination": "destination",
    "IMO": "imo",
}


def read_ais_csv(spark: SparkSession, path: str, keep_bad_rows: bool = False) -> DataFrame:
    """All 26 columns by position, day-first times.

    A bad row fails the read, also where only good columns are used: pruning would skip
    the check of the others. With ``keep_bad_rows`` it arrives with its raw text in
    ``_corrupt`` instead.
    """
    reader = spark.read.option("header", True).option("timestampFormat", DAY_FIRST).option("enforceSchema", True).option("columnPruning", False)
    if keep_bad_rows:
        return (
            reader.schema(f"{AIS_REPORT}, {CORRUPT} string")
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(path)
        )
    return reader.schema(AIS_REPORT).option("mode", "FAILFAST").csv(path)


def read_ais_profile(spark: SparkSession, path: str) -> DataFrame:
    """Eleven columns by name, as text but for the parsed time.

    Column types come from the heading line, so only wanted columns are parsed.
    """
    raw = spark.read.option("header", True).csv(path)
    picked = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in PROFILE_COLUMNS.items()])
    return picked.withColumn("t", F.to_timestamp("t", DAY_FIRST))


def lower_names(reports: DataFrame) -> DataFrame:
    """Snake-case names of the 26 columns, as the operators use them."""
    renames = {
        f.name: "".join("_" + c.lower() if c.isupper() and i and not f.name[i - 1].isupper() else c.lower()
                        for i, c in enumerate(f.name))
        for f in T.StructType.fromDDL(AIS_REPORT).fields
    }
    return reports.withColumnsRenamed(renames)
