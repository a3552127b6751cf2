"""Items of a collection with box, time, cut, leaf and paging; and one feature."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import geojson_shape
from driftline.functions.text import iso_time
from driftline.operators import temporal
from driftline.operators.temporal import KIND
from driftline.operators.features import FEATURE, GEOMETRY, feature_page, page_counts
from driftline.operators.predicates import bbox_overlap, time_overlap
from driftline.operators.sequence import CHUNK, assign_chunks, collect_parts, pack
from driftline.operators.validate import ItemQuery
from driftline.session import cut_lineage
from driftline.sources.export import feature_document, link, mfjson_point


class Items(NamedTuple):
    page: DataFrame
    geometries: DataFrame
    counts: DataFrame


def matched_geometries(geometries: DataFrame, query: ItemQuery) -> DataFrame:
    """Trajectories whose extent meets the box and the interval of the query."""
    out = geometries
    if query.box is not None:
        out = bbox_overlap(out, query.box)
    if query.timed:
        out = time_overlap(out, query.start, query.end)
    return out


def items(
    features: DataFrame,
    geometries: DataFrame,
    instants: DataFrame,
    query: ItemQuery,
    after: tuple | None = None,
    **chunking,
) -> Items:
    """One page of features, their matching trajectories, and the counts.

    ``features`` are those of one collection. With a box or interval, features without
    a match are left out. The page is taken before any instant is read; with a
    limit it has at most the page cap of features, which bounds the broadcast of its keys;
    without one it is all features and nothing is broadcast. Trajectories come
    as MF-JSON structs with shape, each by its own interpolation; very long ones in
    ``part`` slices of time. ``joined`` tells where sequence and shape of a slice begin
    with the end of the one before.
    """
    matched = matched_geometries(geometries, query).drop("collection_id")
    candidates = features
    if query.box is not None or query.timed:
        candidates = features.join(matched.select(FEATURE).distinct(), FEATURE, "left_semi")
    page = feature_page(candidates, query.limit, after)
    keys = page.select(FEATURE)
    here = matched.join(keys if query.limit is None else F.broadcast(keys), FEATURE, "left_semi")
    base = F.col("base") if "base" in here.columns else F.lit(None).cast("string").alias("base")
    about = here.select(GEOMETRY, FEATURE, "geometry_type", F.coalesce(KIND, F.lit("Linear")).alias(KIND), base)
    points = instants.select(GEOMETRY, "t", "x", "y").join(about.select(GEOMETRY, KIND), GEOMETRY)

    path = temporal.subtrajectory(points, query.start, query.end) if query.sub_trajectory else points
    shown = F.col("last") if query.leaf else F.col("turn")
    marked = temporal.path_marks(path, **chunking).withColumn("shown", shown).filter("shown or bend")
    place = F.struct("t", "x", "y")
    packed = pack(
        marked, [GEOMETRY],
        {"instants": F.when(F.col("shown"), place), "vertices": F.when(F.col("bend"), place)},
        [F.max(KIND).alias("_kind")],
        join_ends={"instants": (F.col("_kind") != "Discrete") & F.lit(not query.leaf), "vertices": F.col("_kind") == "Linear"},
    )
    kind = F.lit("Discrete") if query.leaf else F.col(KIND)
    entries = about.join(packed, GEOMETRY).select(
        FEATURE, GEOMETRY, "part", "geometry_type", "base", "joined",
        F.size("instants").alias("n_instants"),
        mfjson_point(F.col("instants"), kind, F.col("joined.instants")).alias("sequence"),
        geojson_shape(F.col("vertices"), F.col(KIND) != "Linear").alias("geometry"),
    )
    return Items(page, entries, page_counts(candidates, matched, query.limit))


def nest_items(result: Items, max_items: int | None = None) -> DataFrame:
    """Page rows with their trajectories as arrays, in order of trajectory and slice; very many in parts along it."""
    arrays = collect_parts(
        result.geometries, [FEATURE],
        [
            F.sort_array(F.collect_list(F.struct(GEOMETRY, "part", "sequence"))).alias("geometries"),
            F.sort_array(F.collect_list(F.struct(GEOMETRY, "part", "geometry"))).alias("shapes"),
        ],
        [GEOMETRY, "part"], max_items,
    )
    return result.page.join(arrays, FEATURE, "left").withColumns(
        {"part_no": F.coalesce("part_no", F.lit(0)), "first_item": F.coalesce("first_item", F.lit(0))}
    )


#: Instants up to which a path shares its document with others, and how many such paths do.
SHORT_PATH, SHORT_PATHS = 1_000, 500


def item_features(result: Items, base: str = "") -> DataFrame:
    """``created_at, feature_id, part_no, feature``: the page's documents with paths and shapes.

    A feature's short paths stand together, ``SHORT_PATHS`` to a document, and each long
    path (or slice of one) in a document of its own, so none holds an unbounded number of
    instants. Most features are one document.
    """
    entry = F.struct(
        F.col(GEOMETRY).alias("id"), F.col("geometry_type").alias("type"), F.col("sequence.datetimes").alias("datetimes"),
        F.col("sequence.coordinates").alias("coordinates"), F.col("base").alias("base"),
        F.col("sequence.interpolation").alias("interpolation"), F.col("sequence.lower_inc").alias("lower_inc"),
    )
    rows = result.geometries.select(
        FEATURE, GEOMETRY, "part", F.col("n_instants") > SHORT_PATH, F.struct(GEOMETRY, "part", entry.alias("e"), F.col("geometry").alias("g")).alias("item")
    ).toDF(FEATURE, GEOMETRY, "part", "long", "item")
    tagged = assign_chunks(rows, [FEATURE], [GEOMETRY, "part"], SHORT_PATHS)
    alone = F.when(F.col("long"), F.struct(GEOMETRY, "part"))
    nested = tagged.groupBy(FEATURE, F.struct(F.coalesce(CHUNK, F.lit(0)).alias("chunk"), alone.alias("alone")).alias("part_no")).agg(
        F.sort_array(F.collect_list("item")).alias("items")
    )
    page = result.page
    plain = {c: F.lit(None).cast("string") for c in ("properties", "crs", "trs") if c not in page.columns}
    plain |= {c: F.lit(None).cast("double") for c in ("xmin", "ymin", "xmax", "ymax") if c not in page.columns}
    plain |= {c: F.lit(None).cast("timestamp") for c in ("tmin", "tmax") if c not in page.columns}
    whole = page.withColumns(plain).join(nested, FEATURE, "left")
    shapes = F.transform("items", lambda i: i["g"])
    document = feature_document(base, F.transform("items", lambda i: i["e"]), shapes)
    return whole.select("created_at", FEATURE, "part_no", document.alias("feature"))


def items_document(
    result: Items, now: Column, path: str = "", limit: int | None = None, next_query: str = "", base: str = ""
) -> DataFrame:
    """``place, line``: the page as one feature collection, line by line in order of ``place``.

    The page is read once, when this is called: its documents are written to the shared
    folder. The first line opens the document, one follows for each feature document, and
    the last holds counts and links. No row holds more than one feature document, and the lines
    written one after another (``write_items_document``) are the JSON text.
    """
    # Counts, samples and the documents themselves read the entries of the page.
    features = cut_lineage(item_features(result._replace(geometries=cut_lineage(result.geometries)), base))
    text = F.to_json(F.col("feature"))
    # Shapes are JSON texts already: they go in as they are.
    shapes = F.concat(F.lit(',"geometry":['), F.array_join(F.col("feature.geometry"), ","), F.lit("]}"))
    bare = F.to_json(F.struct(*[F.col(f"feature.{c}").alias(c) for c in features.schema["feature"].dataType.names if c != "geometry"]))
    body = F.when(F.col("feature.geometry").isNull(), text).otherwise(F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), shapes))
    place = lambda kind: F.struct(
        F.lit(kind).alias("kind"), F.col("created_at").alias("created_at"), F.col(FEATURE).alias(FEATURE), F.col("part_no").alias("part_no")
    )
    lines = features.select(place(1).alias("place"), body.alias("line"))
    none = features.schema
    empty = F.struct(
        F.lit(0).alias("kind"), *[F.lit(None).cast(none[c].dataType).alias(c) for c in ("created_at", FEATURE, "part_no")]
    )
    links = F.array(link(F.lit(path), "self"))
    more = links if limit is None else F.when(
        F.col("number_matched") > F.col("number_returned"), F.concat(links, F.array(link(F.lit(f"{path}?limit={limit}{next_query}"), "next")))
    ).otherwise(links)
    tail = F.to_json(F.struct(
        iso_time(now).alias("timeStamp"), F.col("number_matched").alias("numberMatched"),
        F.col("number_returned").alias("numberReturned"), more.alias("links"),
    ))
    ends = result.counts.select(F.explode(F.array(
        F.struct(empty.alias("place"), F.lit('{"type":"FeatureCollection","features":[').alias("line")),
        F.struct(empty.withField("kind", F.lit(2)).alias("place"), F.concat(F.lit("],"), F.substring(tail, F.lit(2), F.length(tail))).alias("line")),
    )).alias("e")).select("e.place", "e.line")
    first = lines.agg(F.min("place")).scalar()
    parted = F.when((F.col("place.kind") == 1) & (F.col("place") != first), F.concat(F.lit(","), "line")).otherwise(F.col("line"))
    return lines.unionByName(ends).select("place", parted.alias("line"))


def write_items_document(lines: DataFrame, folder: str) -> None:
    """The document as one file below ``folder``: a page, sorted by Spark and written line by line."""
    lines.repartition(1).sortWithinPartitions("place").select("line").write.text(folder)
