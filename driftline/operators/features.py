"""Joins, nesting and paging of moving features and their trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.sequence import collect_parts

FEATURE = "feature_id"
GEOMETRY = "geom_id"


def outer_by_parts(parents: DataFrame, children: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left outer join as inner join plus the parents without child.

    A parent may have a third of all children. A left outer join cannot split such a
    right side; the inner join can, and the anti join needs the distinct keys only.
    """
    on = list(on)
    lonely = parents.join(children.select(*on).distinct(), on, "left_anti")
    return parents.join(children, on).unionByName(lonely, allowMissingColumns=True)


def features_with_geometry(features: DataFrame, geometries: DataFrame) -> DataFrame:
    """Every feature with each of its trajectories, or once with NULLs."""
    return outer_by_parts(features, geometries.drop("collection_id"), [FEATURE])


def geometry_in_collection(
    geometries: DataFrame, features: DataFrame, collections: DataFrame | None = None
) -> DataFrame:
    """Trajectories with the collection of their feature, in the given collections."""
    members = features.select(FEATURE, "collection_id")
    if collections is not None:
        members = members.join(collections.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
    return geometries.drop("collection_id").join(members, FEATURE)


def check_requests(
    requests: DataFrame,
    collections: DataFrame,
    features: DataFrame,
    geometries: DataFrame | None = None,
    properties: DataFrame | None = None,
) -> DataFrame:
    """Add ``missing``: the first thing a request names that is not there, else NULL.

    Checks run in the order collection, feature in that collection, then trajectory of
    the feature or property of the feature. The lists have unique keys, so a request
    is never multiplied, and the request side stays splittable when it is skewed.
    """
    out = requests

    def known(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
        return df.select(*keys).distinct().withColumn(flag, F.lit(True))

    checks = [(known(collections.select(F.col("id").alias("collection_id")), ["collection_id"], "_c"), ["collection_id"], "_c", "collection")]
    checks.append((known(features, ["collection_id", FEATURE], "_f"), ["collection_id", FEATURE], "_f", "feature"))
    if geometries is not None:
        checks.append((known(geometries, [FEATURE, GEOMETRY], "_g"), [FEATURE, GEOMETRY], "_g", "geometry"))
    if properties is not None:
        checks.append((known(properties, [FEATURE, "property_name"], "_p"), [FEATURE, "property_name"], "_p", "property"))
    missing: Column = F.lit(None).cast("string")
    for listed, keys, flag, label in checks:
        out = out.join(listed, keys, "left")
    for _, _, flag, label in reversed(checks):
        missing = F.when(F.col(flag).isNull(), F.lit(label)).otherwise(missing)
    return out.select(*requests.columns, missing.alias("missing"))


def requests_valid(requests: DataFrame, *tables: DataFrame, **more: DataFrame) -> DataFrame:
    return check_requests(requests, *tables, **more).filter(F.col("missing").isNull()).drop("missing")


def requests_missing(requests: DataFrame, *tables: DataFrame, **more: DataFrame) -> DataFrame:
    return check_requests(requests, *tables, **more).filter(F.col("missing").isNotNull())


def features_nested(
    features: DataFrame,
    geometries: DataFrame,
    item: Sequence[str] = (GEOMETRY, "geometry_type", "interpolation"),
    max_items: int | None = None,
) -> DataFrame:
    """One row per feature with its trajectories as an array in ``geom_id`` order.

    The array is built before the join, with partial results. Features without
    trajectory have an empty array. Very large features come in parts, in that order.
    """
    arrays = collect_parts(
        geometries, [FEATURE], [F.sort_array(F.collect_list(F.struct(*item))).alias("geometries")],
        GEOMETRY, max_items,
    )
    empty = F.array().cast(arrays.schema["geometries"].dataType)
    return features.join(arrays, FEATURE, "left").withColumns(
        {
            "geometries": F.coalesce("geometries", empty),
            "part_no": F.coalesce("part_no", F.lit(0)),
            "first_item": F.coalesce("first_item", F.lit(0)),
        }
    )


def lookup_features(requests: DataFrame, features: DataFrame, geometries: DataFrame, **nesting) -> DataFrame:
    """The requested ``(collection_id, feature_id)`` features, nested."""
    wanted = features.join(requests.select("collection_id", FEATURE), ["collection_id", FEATURE], "left_semi")
    theirs = geometries.join(wanted.select(FEATURE), FEATURE, "left_semi")
    return features_nested(wanted, theirs, **nesting)


def feature_page(
    features: DataFrame,
    limit: int | None = 10,
    after: tuple | None = None,
) -> DataFrame:
    """One page in ``(created_at, feature_id)`` order; ``after`` is the last key of the page before.

    Spark runs order and limit together as a top-k with per-task heaps. Without a limit all rows
    after the key are the page, in no order.
    """
    rows = features
    if after is not None:
        at, ident = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rows = rows.filter(
            (F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col(FEATURE) > ident))
        )
    return rows if limit is None else rows.orderBy("created_at", FEATURE).limit(limit)


def page_counts(features: DataFrame, geometries: DataFrame, limit: int | None) -> DataFrame:
    """``number_matched`` features, ``joined_rows`` of feature x trajectory, ``number_returned``.

    Plain aggregates: a count over an unpartitioned window would gather all rows.
    """
    per_feature = geometries.groupBy(FEATURE).agg(F.count("*").alias("_n"))
    return (
        features.join(per_feature, FEATURE, "left")
        .agg(
            F.count(FEATURE).alias("number_matched"),
            F.sum(F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))).alias("joined_rows"),
        )
        .withColumn("number_returned", F.least("number_matched", F.lit(limit).cast("long")) if limit is not None else F.col("number_matched"))
    )


def collection_list(collections: DataFrame) -> DataFrame:
    """Newest first, names as in the interchange document; the extent is always NULL."""
    return collections.orderBy(F.desc("created_at"), "id").select(
        "id", "title", "description",
        F.col("item_type").alias("itemType"),
        F.col("update_frequency").alias("updateFrequency"),
        F.lit(None).cast("string").alias("extent"),
    )


def describe_table(df: DataFrame) -> DataFrame:
    """Column names, types and positions of a table."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string")
