"""Time-varying properties: listing, values, continuity of appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.features import outer_by_parts
from driftline.operators.sequence import collect_parts


def typed_value(value: Column, property_type: Column) -> dict[str, Column]:
    """Typed readings of a raw value; the one that fits its type is set, bad text is NULL."""
    return {
        "as_boolean": F.when(property_type == "TBoolean", value.try_cast("boolean")),
        "as_integer": F.when(property_type == "TInteger", value.try_cast("long")),
        "as_real": F.when(property_type == "TReal", value.try_cast("double")),
        "as_text": F.when(property_type.isin("TText", "TImage"), value),
    }


def property_list(properties: DataFrame, max_items: int | None = None) -> DataFrame:
    """Property descriptions of each feature as an array in name order; long lists in parts along it."""
    item = F.struct(
        F.col("property_name").alias("name"), F.col("property_type").alias("type"), "form", "description"
    )
    return collect_parts(
        properties, ["feature_id"], [F.sort_array(F.collect_list(item)).alias("properties")],
        "property_name", max_items,
    )


def property_batches(properties: DataFrame, values: DataFrame) -> DataFrame:
    """Every property with each of its value batches, or once with NULLs."""
    batches = values.select(
        "property_id", "value_id", "datetimes", "values", "interpolation",
        F.try_element_at("datetimes", F.lit(1)).alias("first_time"),
    )
    return outer_by_parts(properties, batches, ["property_id"])


def property_values(properties: DataFrame, values: DataFrame, max_items: int | None = None) -> DataFrame:
    """Properties with their batches nested in order of first time; large ones in parts along it."""
    item = F.struct("first_time", F.col("value_id").alias("id"), "datetimes", "values", "interpolation")
    nested = collect_parts(
        values.withColumn("first_time", F.try_element_at("datetimes", F.lit(1))),
        ["property_id"], [F.sort_array(F.collect_list(item)).alias("batches")],
        ["first_time", "value_id"], max_items,
    )
    return properties.join(nested, "property_id", "left")


def property_readings(properties: DataFrame, values: DataFrame) -> DataFrame:
    """Long form: one row per property and time, with typed values."""
    pairs = values.select("property_id", F.inline(F.arrays_zip(F.col("datetimes").alias("t"), F.col("values").alias("raw"))))
    joined = pairs.join(properties.select("property_id", "feature_id", "property_name", "property_type"), "property_id")
    return joined.withColumns(typed_value(F.col("raw"), F.col("property_type")))


def last_value_time(values: DataFrame) -> DataFrame:
    """Latest stored time per property; an empty batch counts for nothing."""
    return values.groupBy("property_id").agg(
        F.max(F.try_element_at("datetimes", F.lit(-1))).alias("last_time")
    )


def continuity_check(batches: DataFrame, values: DataFrame) -> DataFrame:
    """Add ``last_time`` and ``continuous``: the batch starts after all stored values."""
    first = F.try_element_at("datetimes", F.lit(1))
    return batches.join(last_value_time(values), "property_id", "left").withColumn(
        "continuous", F.col("last_time").isNull() | (F.col("last_time") < first)
    )


def property_conflicts(incoming: DataFrame, properties: DataFrame) -> DataFrame:
    """Incoming properties whose name the feature already has."""
    return incoming.join(properties.select("feature_id", "property_name"), ["feature_id", "property_name"], "left_semi")
