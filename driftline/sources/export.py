"""Interchange documents as columns: MF-JSON, features, collections, curves, ships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import iso_time
from driftline.operators.sequence import assign_chunks, collect_parts, pack, with_chunk
from driftline.operators.temporal import KEY, KIND, kind_of, pack_instants

KEEP_NULLS = {"ignoreNullFields": "false"}

# Link relations and the media type of the interchange standard.
GEOMETRY_REL = "http://www.opengis.net/def/rel/ogc/1.0/temporal-geometry"
PROPERTIES_REL = "http://www.opengis.net/def/rel/ogc/1.0/temporal-properties"
MEDIA_TYPE = "application/json"


def link(href: Column, rel: str) -> Column:
    return F.struct(href.alias("href"), F.lit(rel).alias("rel"), F.lit(MEDIA_TYPE).alias("type"))


def mfjson_point(instants: Column, interpolation: Column | str = "Linear", joined: Column | None = None) -> Column:
    """MF-JSON struct of ordered ``array<struct<t,x,y>>``.

    With ``joined`` there is a member ``lower_inc``: false where the first instant belongs
    to the slice before, else NULL.
    """
    kind = F.lit(interpolation) if isinstance(interpolation, str) else interpolation
    bound = [] if joined is None else [F.when(joined, F.lit(False)).alias("lower_inc")]
    return F.struct(
        F.lit("MovingPoint").alias("type"),
        F.transform(instants, lambda p: iso_time(p["t"])).alias("datetimes"),
        F.transform(instants, lambda p: F.array(p["x"], p["y"])).alias("coordinates"),
        kind.alias("interpolation"),
        *bound,
    )


def mfjson_float(pairs: Column, interpolation: str = "Linear") -> Column:
    """MF-JSON struct of ordered ``array<struct<t,v>>``; NULL when there is none."""
    return F.when(
        F.size(pairs) > 0,
        F.struct(
            F.lit("MovingFloat").alias("type"),
            F.transform(pairs, lambda p: iso_time(p["t"])).alias("datetimes"),
            F.transform(pairs, lambda p: p["v"]).alias("values"),
            F.lit(interpolation).alias("interpolation"),
        ),
    )


def encode_mfjson(instants: DataFrame, key: Sequence[str] = KEY, interpolation: str | None = None, **chunking) -> DataFrame:
    """One MF-JSON text per trajectory; one per slice of time for very long ones, joined as in ``pack_instants``.

    ``interpolation`` overrides that of the rows.
    """
    packed = pack_instants(instants, key, **chunking)
    kind = F.lit(interpolation) if interpolation else kind_of(packed)
    text = F.to_json(mfjson_point(F.col("instants"), kind, F.col("joined.instants")))
    return packed.select(*key, "part", F.col("joined.instants").alias("joined"), text.alias("trajectory"))


def ship_documents(trips: DataFrame) -> DataFrame:
    """``mmsi, part, joined, document``: one JSON text per assembled ship (and part)."""
    document = F.struct(
        "mmsi",
        mfjson_point(F.col("trip")).alias("trajectory"),
        *[mfjson_float(F.col(n)).alias(n) for n in ("sog", "cog", "heading")],
        F.struct(
            F.col("name").alias("Name"), F.col("imo").alias("IMO"),
            F.col("ship_type").alias("ShipType"), F.col("destination").alias("Destination"),
        ).alias("properties"),
    )
    return trips.select("mmsi", "part", "joined", F.to_json(document, KEEP_NULLS).alias("document"))


def write_ship_documents(documents: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines in ``mmsi`` order over the files, written in parallel."""
    ordered = documents.repartitionByRange("mmsi", "part").sortWithinPartitions("mmsi", "part")
    ordered.select("document").write.mode(mode).text(path)


def feature_document(
    base: str = "", geometries: Column | None = None, shapes: Column | None = None
) -> Column:
    """Feature struct from feature columns; ``time`` holds clean timestamps."""
    path = F.concat(F.lit(f"{base}/collections/"), F.col("collection_id"), F.lit("/items/"), F.col("feature_id").cast("string"))
    fields = [
        F.lit("Feature").alias("type"),
        F.col("feature_id").cast("string").alias("id"),
        F.coalesce(F.col("properties"), F.lit("{}")).alias("properties"),
        F.when(F.col("xmin").isNotNull(), F.array("xmin", "ymin", "xmax", "ymax")).alias("bbox"),
        F.col("crs").alias("crs"),
        F.col("trs").alias("trs"),
        F.when(F.col("tmin").isNotNull(), F.array(iso_time(F.col("tmin")), iso_time(F.col("tmax")))).alias("time"),
        F.array(
            link(path, "self"),
            link(F.concat(path, F.lit("/tgsequence")), GEOMETRY_REL),
            link(F.concat(path, F.lit("/tproperties")), PROPERTIES_REL),
        ).alias("links"),
    ]
    if geometries is not None:
        fields.append(geometries.alias("temporalGeometry"))
    if shapes is not None:
        fields.append(shapes.alias("geometry"))
    return F.struct(*fields)


def export_features(features: DataFrame, base: str = "") -> DataFrame:
    """``collection_id, feature_id, part_no, feature`` of nested features."""
    geometries = F.col("geometries") if "geometries" in features.columns else None
    part = F.col("part_no") if "part_no" in features.columns else F.lit(0).alias("part_no")
    return features.select("collection_id", "feature_id", part, feature_document(base, geometries).alias("feature"))


def features_with_paths(
    features: DataFrame, geometries: DataFrame, instants: DataFrame, base: str = "", **chunking
) -> DataFrame:
    """``collection_id, feature_id, part, feature``: feature documents with all their trajectories whole.

    The instants of a feature are counted off along (trajectory, time), so a document
    holds a bounded number of them, however many trajectories they are of; a very large
    feature comes in several (``part``), whose paths are joined as in ``pack``. A feature
    without trajectory has none in its document.
    """
    about = [c for c in ("geometry_type", KIND, "base") if c in geometries.columns]
    points = instants.select("feature_id", "geom_id", "t", "x", "y").join(features.select("feature_id"), "feature_id", "left_semi")
    told = points.join(geometries.select("geom_id", *about), "geom_id")
    entries = geometry_sequence(assign_chunks(told, ["feature_id"], ["geom_id", "t"], **chunking))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("geom_id", "geometry"))), lambda e: e["geometry"])
    nested = entries.groupBy("feature_id", "part").agg(listed.alias("geometries"))
    whole = features.join(nested, "feature_id", "left")
    return whole.select(
        "collection_id", "feature_id", F.coalesce("part", F.lit(0)).alias("part"),
        feature_document(base, F.col("geometries")).alias("feature"),
    )


def export_feature_collection(
    page: DataFrame, counts: DataFrame, now: Column, path: str = "", limit: int = 10, next_query: str = ""
) -> DataFrame:
    """One feature-collection document of a page; ``page`` has at most the page cap of rows.

    ``page`` holds ``feature`` structs in ``ord`` order, ``counts`` the row of
    ``page_counts``. A next link appears when more features match than the page holds.
    """
    body = page.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "feature"))), lambda r: r["feature"]).alias("features"))
    more = link(F.lit(f"{path}?limit={limit}{next_query}"), "next")
    links = F.array(link(F.lit(path), "self"))
    numbers = counts.select("number_matched", "number_returned")
    return body.withColumns(
        {"number_matched": numbers.select("number_matched").scalar(), "number_returned": numbers.select("number_returned").scalar()}
    ).select(
        F.lit("FeatureCollection").alias("type"),
        "features",
        iso_time(now).alias("timeStamp"),
        F.col("number_matched").alias("numberMatched"),
        F.col("number_returned").alias("numberReturned"),
        F.when(F.col("number_matched") > F.col("number_returned"), F.concat(links, F.array(more))).otherwise(links).alias("links"),
    )


def geometry_entry(instants: Column, interpolation: Column, joined: Column | None = None) -> Column:
    """Entry of a geometry sequence from a packed path and the columns of its trajectory."""
    path = mfjson_point(instants, interpolation, joined)
    bound = [] if joined is None else [path["lower_inc"].alias("lower_inc")]
    return F.struct(
        F.col("geom_id").alias("id"), F.coalesce("geometry_type", F.lit("MovingPoint")).alias("type"),
        path["datetimes"].alias("datetimes"), path["coordinates"].alias("coordinates"),
        path["interpolation"].alias("interpolation"), F.col("base").alias("base"), *bound,
    )


def geometry_sequence(instants: DataFrame, geometries: DataFrame | None = None, feature: str = "feature_id", **chunking) -> DataFrame:
    """``feature, geom_id, part, joined, geometry``: the entries of the features' geometry sequences.

    ``geometries`` gives type, interpolation and base of each trajectory; its instants are
    taken as linear without. Very long paths come in joined slices of time.
    """
    if geometries is not None:
        about = [c for c in ("geometry_type", KIND, "base") if c in geometries.columns]
        instants = instants.drop(*about).join(geometries.select("geom_id", *about), "geom_id")
    more = [F.max(c).alias(c) for c in ("geometry_type", "base") if c in instants.columns]
    packed = pack(
        with_chunk(instants, [c for c in instants.columns if c in (feature, "geom_id", "t", "x", "y", KIND, "geometry_type", "base")]),
        [feature, "geom_id"], {"instants": F.struct("t", "x", "y")},
        [F.max(kind_of(instants)).alias(KIND), *more], join_ends=F.col(KIND) != "Discrete", **chunking,
    )
    packed = packed.withColumns({c: F.lit(None).cast("string") for c in ("geometry_type", "base") if c not in packed.columns})
    joined = F.col("joined.instants")
    return packed.select(
        feature, "geom_id", "part", joined.alias("joined"),
        geometry_entry(F.col("instants"), F.col(KIND), joined).alias("geometry"),
    )


def sequence_documents(entries: DataFrame, now: Column, feature: str = "feature_id", base: str = "", max_items: int | None = None) -> DataFrame:
    """One ``TemporalGeometrySequence`` document per feature from the entries of ``geometry_sequence``.

    The entries stand in order of trajectory and slice; a feature with very many has
    several documents (``part_no``). Both counts are of all its trajectories.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("geom_id", "part", "geometry"))), lambda e: e["geometry"])
    nested = collect_parts(entries, [feature, "collection_id"], [listed.alias("geometrySequence")], ["geom_id", "part"], max_items)
    counts = entries.filter("part = 0").groupBy(feature).agg(F.count("*").alias("_n"))
    path = F.concat(F.lit(f"{base}/collections/"), F.col("collection_id"), F.lit("/items/"), F.col(feature).cast("string"), F.lit("/tgsequence"))
    return nested.join(counts, feature).select(
        feature, "collection_id", "part_no",
        F.struct(
            F.lit("TemporalGeometrySequence").alias("type"), "geometrySequence", F.array(link(path, "self")).alias("links"),
            iso_time(now).alias("timeStamp"), F.col("_n").alias("numberMatched"), F.col("_n").alias("numberReturned"),
        ).alias("document"),
    )


def curve_document(
    curve: DataFrame, value: str, unit: Column | str, query_type: str, key: Sequence[str] = KEY, **chunking
) -> DataFrame:
    """``TReal`` documents of a curve: one per trajectory, in parts when very long."""
    unit_column = F.lit(unit) if isinstance(unit, str) else unit
    pairs = {"pairs": F.struct("t", F.col(value).alias("value"))}
    packed = pack(with_chunk(curve, [*key, "t", value]), key, pairs, join_ends=False, **chunking)
    return packed.select(
        *key, "part",
        F.struct(
            F.lit("TReal").alias("type"),
            F.transform("pairs", lambda p: F.struct(iso_time(p["t"]).alias("time"), p["value"].alias("value"))).alias("values"),
            unit_column.alias("unit"),
            F.lit(query_type).alias("queryType"),
        ).alias("curve"),
    )


def collection_documents(listed: DataFrame, base: str = "") -> DataFrame:
    """Collection structs with links from ``collection_list`` rows."""
    path = F.concat(F.lit(f"{base}/collections/"), F.col("id"))
    return listed.select(
        "id",
        F.struct(*listed.columns, F.array(link(path, "self"), link(F.concat(path, F.lit("/items")), "items")).alias("links")).alias("collection"),
    )


def to_text(df: DataFrame, column: str) -> DataFrame:
    """The struct column as JSON text, NULL fields kept."""
    return df.withColumn(column, F.to_json(F.col(column), KEEP_NULLS))
