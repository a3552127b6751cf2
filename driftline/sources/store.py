"""Storage of the tables as partitioned Parquet with fixed schemas."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.schemas import TABLES

# Layout: directory by collection where the table has one, rows of a file close together.
# Trajectories follow a curve through space and time.
CLUSTERING = {
    "geometries": ("_curve",),
    "instants": ("geom_id", "t"),
    "features": ("created_at", "feature_id"),
    "properties": ("feature_id", "property_name"),
    "temporal_values": ("property_id",),
    "collections": ("id",),
}


#: Bits of each axis of the curve.
CURVE_BITS = 16


def interleaved(axes: list[Column]) -> Column:
    """One number from whole numbers below ``2 ** CURVE_BITS``: their bits in turn, so that near rows have near numbers."""
    spread: Column = F.lit(0).cast("long")
    for bit in range(CURVE_BITS):
        for k, axis in enumerate(axes):
            spread = spread.bitwiseOR(F.shiftleft(F.shiftright(axis, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(axes) + k))
    return spread


def curve_place(rows: DataFrame) -> Column:
    """Place of a trajectory's centre on a curve through x, y and time.

    Each axis is scaled to what lies between its outermost half percents, so a few absurd
    values do not squeeze all others into one cell.
    """
    centres = {
        "x": (F.col("xmin") + F.col("xmax")) / 2, "y": (F.col("ymin") + F.col("ymax")) / 2,
        "t": (F.unix_micros("tmin") + F.unix_micros("tmax")) / 2,
    }
    ends = rows.agg(*[F.percentile_approx(c, [0.005, 0.995]).alias(n) for n, c in centres.items()]).first()
    top = 2**CURVE_BITS - 1
    axes = []
    for name, centre in centres.items():
        low, high = ends[name] or (0.0, 1.0)
        share = (centre - F.lit(float(low))) / F.lit(float(high - low) or 1.0)
        axes.append(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * top, F.lit(0.0)).cast("long"))
    return interleaved(axes)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the table in order and type; those not in ``df`` are NULL."""
    fields = T.StructType.fromDDL(TABLES[name]).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def _within(file: str, folder: str) -> bool:
    """Whether a file of a scan lies below a folder, however both name the local file system."""
    def plain(path: str) -> str:
        return re.sub("/+", "/", unquote(path).removeprefix("file:"))

    return plain(file).startswith(plain(folder).rstrip("/") + "/")


def write_table(df: DataFrame, name: str, root: str, mode: str = "overwrite", files: int | None = None) -> None:
    """Write a snapshot under ``root``; raises where an overwrite would destroy what the frame is read from.

    Rows are range-partitioned on the clustering columns, which splits a collection or
    trajectory of any size over many files and keeps Parquet statistics narrow.
    """
    target = f"{root}/{name}"
    if mode == "overwrite" and any(_within(f, target) for f in df.inputFiles()):
        raise ValueError(f"{name} is read from {target}: write the snapshot to another folder")
    rows = conform(df, name)
    by = [c for c in ("collection_id",) if c in rows.columns]
    order = [*by, *CLUSTERING[name]]
    placed = rows.withColumn("_curve", curve_place(rows)) if "_curve" in order else rows
    spread = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    writer = spread.sortWithinPartitions(*order).drop("_curve").write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(target)


def read_table(spark: SparkSession, name: str, root: str) -> DataFrame:
    return conform(spark.read.schema(TABLES[name]).parquet(f"{root}/{name}"), name)


def write_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        write_table(df, name, root, mode)


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, name, root) for name in TABLES}
