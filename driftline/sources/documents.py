"""Moving-feature JSON documents: reading features, trajectories and property blocks.

A document is parsed by Spark's JSON functions; good rows and rejects are separate
outputs of one set of expressions, and one bad document never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import parse_time, srid_of
from driftline.operators.temporal import extent
from driftline.schemas import FEATURE_DOCUMENT, PROPERTY_MEMBER, TRAJECTORY_DOCUMENT

BLOCK = "map<string,string>"
BAD_PATH = "Invalid 'temporalGeometry'"


def decode_trajectory(text: Column) -> Column:
    """Parsed trajectory of an MF-JSON object given as JSON text."""
    return F.from_json(text, TRAJECTORY_DOCUMENT)


def trajectory_instants(trajectory: Column) -> Column:
    """``array<struct<t,x,y>>`` from the parallel lists of a parsed trajectory."""
    pairs = F.arrays_zip(trajectory["datetimes"].alias("d"), trajectory["coordinates"].alias("c"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            parse_time(p["d"]).alias("t"),
            F.try_element_at(p["c"], F.lit(1)).alias("x"),
            F.try_element_at(p["c"], F.lit(2)).alias("y"),
        ),
    )


def decode_mfjson(docs: DataFrame, column: str = "trajectory", keep: tuple[str, ...] = ("geom_id",)) -> DataFrame:
    """Long form of MF-JSON texts: ``keep`` columns, interpolation and ``t, x, y``.

    Where ``docs`` has a true ``joined``, the first instant is one of the slice before.
    """
    joined = F.col("joined") if "joined" in docs.columns else F.lit(False)
    parsed = docs.select(*keep, decode_trajectory(F.col(column)).alias("_tg"), joined.alias("_joined"))
    points = trajectory_instants(F.col("_tg"))
    own = F.when(F.col("_joined"), F.slice(points, F.lit(2), F.size(points))).otherwise(points)
    return parsed.select(*keep, F.coalesce("_tg.interpolation", F.lit("Linear")).alias("interpolation"), F.inline(own))


def _bad_path(member: Column) -> Column:
    """Whether a feature has a path that cannot be stored whole: no JSON, lists missing or of unlike
    length, a time or place that cannot be read, or a time twice. A feature may have no path.
    """
    given = F.get_json_object(member, "$.temporalGeometry")
    return given.isNotNull() & bad_trajectory(given)


def bad_trajectory(text: Column) -> Column:
    """Whether MF-JSON text names no path that can be stored whole."""
    path = decode_trajectory(text)
    times, places = F.transform(path["datetimes"], parse_time), path["coordinates"]
    fits = (
        (F.size(times) == F.size(places))
        & ~F.exists(times, lambda t: t.isNull())
        & ~F.exists(places, lambda p: p.isNull() | F.try_element_at(p, F.lit(1)).isNull() | F.try_element_at(p, F.lit(2)).isNull())
        & (F.size(F.array_distinct(times)) == F.size(times))
    )
    return ~F.coalesce(times.isNotNull() & places.isNotNull() & fits, F.lit(False))


def split_documents(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per feature text (``member``), or one with the ``error`` of the document."""
    text = F.col(body)
    kind = F.get_json_object(text, "$.type")
    listed = F.get_json_object(text, "$.features")
    members = F.when(F.ltrim(listed).startswith("["), F.from_json(listed, "array<string>"))
    error = (
        F.when(kind.isNull() | (kind == ""), F.lit("Missing mandatory 'type'"))
        .when(~kind.isin("Feature", "FeatureCollection"), F.lit("Invalid 'type'"))
        .when((kind == "FeatureCollection") & members.isNull(), F.lit("FeatureCollection missing 'features' array"))
    )
    rows = F.when(error.isNotNull(), F.array(F.lit(None).cast("string"))).when(kind == "Feature", F.array(text)).otherwise(members)
    split = docs.withColumns({"error": error, "member": F.explode(rows)})
    bad_member = F.col("error").isNull() & ~F.get_json_object("member", "$.type").eqNullSafe("Feature")
    bad_path = F.col("error").isNull() & _bad_path(F.col("member"))
    return split.withColumn(
        "error",
        F.when(bad_member, F.lit("Invalid feature type")).when(bad_path, F.lit(BAD_PATH)).otherwise(F.col("error")),
    )


def rejected_documents(docs: DataFrame, body: str = "body") -> DataFrame:
    return split_documents(docs, body).filter(F.col("error").isNotNull())


def parsed_features(docs: DataFrame, body: str = "body") -> DataFrame:
    """Good features with their parsed parts; other columns of ``docs`` are kept.

    A missing id is the SHA-256 of the feature's text: unlike a random one it is the
    same in every output and on every retry.
    """
    good = split_documents(docs, body).filter(F.col("error").isNull()).drop("error")
    f = F.from_json("member", FEATURE_DOCUMENT)
    rows = good.withColumn("_f", f).withColumn("_tg", decode_trajectory(F.col("_f.temporalGeometry")))
    return rows.select(
        *[c for c in docs.columns if c != body],
        F.coalesce("_f.id", F.sha2("member", 256)).alias("feature_id"),
        F.coalesce("_f.properties", F.lit("{}")).alias("properties"),
        F.get_json_object("member", "$.crs").alias("crs"),
        F.col("_f.trs").alias("trs"),
        srid_of(F.col("_f.crs.properties")).alias("srid"),
        F.col("_f.bbox").alias("bbox"),
        F.transform("_f.time", parse_time).alias("time"),
        F.col("_f.temporalProperties").alias("temporal_properties"),
        F.coalesce("_tg.type", F.lit("MovingPoint")).alias("geometry_type"),
        F.coalesce("_tg.interpolation", F.lit("Linear")).alias("interpolation"),
        F.col("_tg.base").alias("base"),
        trajectory_instants(F.col("_tg")).alias("instants"),
    )


def feature_instants(parsed: DataFrame) -> DataFrame:
    """Long form of the parsed features' trajectories, one trajectory per feature."""
    return parsed.select("feature_id", F.xxhash64("feature_id").alias("geom_id"), F.inline("instants"))


def feature_rows(parsed: DataFrame) -> DataFrame:
    """Feature rows with the supplied box and lifespan, or those of the trajectory."""
    box, time, points = F.col("bbox"), F.col("time"), F.col("instants")
    given_box, given_time = F.size(F.coalesce(box, F.array().cast("array<double>"))) == 4, F.size(F.coalesce(time, F.array().cast("array<timestamp>"))) == 2

    def least(field: str) -> Column:
        return F.array_min(F.transform(points, lambda p: p[field]))

    def greatest(field: str) -> Column:
        return F.array_max(F.transform(points, lambda p: p[field]))

    def pick(given: Column, array: Column, position: int, computed: Column) -> Column:
        return F.when(given, F.try_element_at(array, F.lit(position))).otherwise(computed)

    return parsed.select(
        *[c for c in parsed.columns if c not in ("bbox", "time", "instants", "temporal_properties", "base", "geometry_type", "interpolation")],
        pick(given_box, box, 1, least("x")).alias("xmin"),
        pick(given_box, box, 2, least("y")).alias("ymin"),
        pick(given_box, box, 3, greatest("x")).alias("xmax"),
        pick(given_box, box, 4, greatest("y")).alias("ymax"),
        pick(given_time, time, 1, least("t")).alias("tmin"),
        pick(given_time, time, 2, greatest("t")).alias("tmax"),
    )


def geometry_rows(parsed: DataFrame) -> DataFrame:
    """Trajectory rows of the parsed features with the extent of their instants."""
    with_path = parsed.filter(F.size("instants") > 0)
    boxes = extent(feature_instants(with_path), ["geom_id"])
    return with_path.select(
        F.xxhash64("feature_id").alias("geom_id"), "feature_id", "geometry_type", "srid", "interpolation", "base"
    ).join(boxes, "geom_id")


def inline_properties(parsed: DataFrame) -> DataFrame:
    """Property rows from the ``temporalProperties`` blocks: one per feature, block and name.

    A block shares one list of times among its named members.
    """
    blocks = parsed.select(
        "feature_id", F.posexplode(F.from_json("temporal_properties", f"array<{BLOCK}>")).alias("block", "_b")
    )
    shared = F.transform(F.from_json(F.col("_b")["datetimes"], "array<string>"), parse_time)
    members = blocks.select(
        "feature_id", "block", shared.alias("datetimes"),
        F.explode(F.map_filter("_b", lambda name, _: name != "datetimes")).alias("property_name", "_m"),
    ).withColumn("_m", F.from_json("_m", PROPERTY_MEMBER))
    return members.select(
        "feature_id", "block", "property_name",
        F.col("_m.type").alias("property_type"),
        F.col("_m.form").alias("form"),
        F.col("_m.description").alias("description"),
        "datetimes",
        F.col("_m.values").alias("values"),
        F.coalesce("_m.interpolation", F.lit("Linear")).alias("interpolation"),
    )
