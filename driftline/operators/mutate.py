"""Table changes as functions from snapshots to the next snapshot.

The caller writes the result, to another place than it was read from. Deletes and
inserts are semi and anti joins on unique keys, so a hot parent key only makes one side
long, which adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import ITEM_TYPE
from driftline.operators.properties import continuity_check, property_conflicts
from driftline.operators.sequence import running_max_before
from driftline.operators.validate import accepted, validate_properties, validate_values
from driftline.session import cut_lineage


def one_per_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """First row per key by all other columns; a minimum, so copies thin out early."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in df.columns])


TWICE = "given more than once"


def outcomes(
    incoming: DataFrame,
    key: Sequence[str],
    rules: Sequence[tuple[Column, str | Column]] = (),
    needed: Sequence[tuple[DataFrame, Sequence[str], str]] = (),
    known: DataFrame | None = None,
    known_reason: str = "already exists",
) -> DataFrame:
    """Every row of ``incoming`` with ``refused``: why it is refused, NULL where it is taken.

    The first reason that holds counts: a condition of ``rules``, a key that is NULL, a row
    missing in a table of ``needed`` (table, columns, reason), a key in ``known``. Of the
    rows of one key left by then the least is taken, all others are given more than once.

    Equal rows are counted before anything moves and come apart again at the end, so a row
    repeated very often thins out in each task; each table adds one join on distinct keys.
    """
    counted = incoming.groupBy(*incoming.columns).agg(F.count("*").alias("_n"))
    nothing = F.lit(False)
    for k in key:
        nothing = nothing | F.col(k).isNull()
    why = F.lit(None).cast("string")
    for bad, reason in (*rules, (nothing, f"missing {', '.join(key)}")):
        why = F.coalesce(why, F.when(bad, F.lit(reason) if isinstance(reason, str) else reason))
    judged = counted.withColumn("_why", why)
    tables = [(rows, columns, reason, False) for rows, columns, reason in needed]
    tables += [(known, key, known_reason, True)] if known is not None else []
    for rows, columns, reason, refuse in tables:
        flags = rows.select(*columns).distinct().withColumn("_there", F.lit(True))
        there = F.coalesce("_there", F.lit(False))
        judged = judged.join(flags, list(columns), "left").select(
            *incoming.columns, "_n", F.coalesce("_why", F.when(there if refuse else ~there, F.lit(reason))).alias("_why")
        )
    whole = F.struct(*incoming.columns)
    first = judged.filter(F.col("_why").isNull()).groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.min(whole).alias("_first"))
    joined = judged.join(first, [F.col(k) == F.col(f"_k_{k}") for k in key], "left")
    again = F.array_repeat(F.lit(TWICE), (F.col("_n") - 1).cast("int"))
    each = (
        F.when(F.col("_why").isNotNull(), F.array_repeat("_why", F.col("_n").cast("int")))
        .when(whole.eqNullSafe(F.col("_first")), F.concat(F.array(F.lit(None).cast("string")), again))
        .otherwise(F.concat(F.array(F.lit(TWICE)), again))
    )
    return joined.select(*incoming.columns, F.explode(each).alias("refused"))


def taken_rows(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("refused").isNull()).drop("refused")


def refusals(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("refused").isNotNull())


def new_rows(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key."""
    return one_per_key(incoming, key).join(stored.select(*key), list(key), "left_anti").select(*incoming.columns)


def insert_new(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Snapshot with the new rows added; known keys stay as they are."""
    return stored.unionByName(new_rows(stored, incoming, key), allowMissingColumns=True)


def refused_rows(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is stored."""
    return incoming.join(stored.select(*key), list(key), "left_semi")


def delete_rows(stored: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """Snapshot without the rows whose key is in ``gone``."""
    return stored.join(gone.select(*key), list(key), "left_anti").select(*stored.columns)


def update_collections(collections: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Apply ``(id, title, description, item_type, has_*)`` patches, one per id.

    A ``has_`` flag tells a given NULL from an absent field. Identifier and update
    frequency never change; ``updated_at`` does whenever a patch comes.
    """
    fields = ("title", "description", "item_type")
    changed = F.col("p.id").isNotNull()
    new = {
        f: F.when(changed & F.coalesce(F.col(f"p.has_{f}"), F.lit(False)), F.col(f"p.{f}")).otherwise(F.col(f"c.{f}"))
        for f in fields
    }
    new["updated_at"] = F.when(changed, now).otherwise(F.col("c.updated_at"))
    return (
        collections.alias("c")
        .join(patches.alias("p"), F.col("c.id") == F.col("p.id"), "left")
        .select(*[new.get(c, F.col(f"c.{c}")).alias(c) for c in collections.columns])
    )


def judge_patches(collections: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches of collections with ``refused``: a wrong type, an unknown collection, one of several for it."""
    wrong = F.col("item_type").isNotNull() & (F.col("item_type") != ITEM_TYPE)
    return outcomes(
        patches, ["id"], [(wrong, f"itemType must be '{ITEM_TYPE}'")], [(collections, ["id"], "collection does not exist")]
    )


def judge_properties(properties: DataFrame, incoming: DataFrame, features: DataFrame) -> DataFrame:
    """Posted properties with ``refused``: malformed, of an unknown feature, or of a name that it has."""
    checked = validate_properties(incoming.withColumns({"name": F.col("property_name"), "type": F.col("property_type")}))
    wrong = checked.select(*incoming.columns, F.get("errors", F.lit(0)).alias("_error"))
    judged = outcomes(
        wrong, ["feature_id", "property_name"], [(F.col("_error").isNotNull(), F.col("_error"))],
        [(features, ["feature_id"], "feature does not exist")], properties, "property exists",
    )
    return judged.drop("_error")


def features_of_collections(features: DataFrame, gone: DataFrame) -> DataFrame:
    return features.join(gone.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")


def delete_collections(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Without the collections and all that hangs on them."""
    features = features_of_collections(tables["features"], gone)
    rest = delete_features(tables, features.select("feature_id"))
    return {**rest, "collections": delete_rows(tables["collections"], gone, ["id"])}


def delete_features(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Without the features, their trajectories, properties and values.

    ``gone`` may also name the collection; then a feature must be in it.
    """
    key = ["feature_id", *(["collection_id"] if "collection_id" in gone.columns else [])]
    found = tables["features"].join(gone.select(*key), key, "left_semi").select("feature_id")
    out = dict(tables)
    for name in ("features", "geometries", "instants"):
        if name in tables:
            out[name] = delete_rows(tables[name], found, ["feature_id"])
    doomed = tables["properties"].join(found, "feature_id", "left_semi")
    return delete_properties(out, doomed)


def delete_geometries(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Without the trajectories named by ``(collection_id, feature_id, geom_id)``."""
    located = tables["geometries"].drop("collection_id").join(
        tables["features"].select("feature_id", "collection_id"), "feature_id"
    )
    key = ["collection_id", "feature_id", "geom_id"]
    found = located.join(gone.select(*key), key, "left_semi").select("geom_id")
    return {
        **tables,
        **{n: delete_rows(tables[n], found, ["geom_id"]) for n in ("geometries", "instants") if n in tables},
    }


def delete_properties(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Without the properties named by ``(feature_id, property_name)`` and their values."""
    found = tables["properties"].join(
        gone.select("feature_id", "property_name"), ["feature_id", "property_name"], "left_semi"
    )
    return {
        **tables,
        "properties": delete_rows(tables["properties"], gone, ["feature_id", "property_name"]),
        "temporal_values": delete_rows(tables["temporal_values"], found, ["property_id"]),
    }


def delete_values(values: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the batches named by ``(value_id, property_id)``."""
    return delete_rows(values, gone, ["value_id", "property_id"])


def append_geometries(
    geometries: DataFrame, incoming: DataFrame, features: DataFrame
) -> DataFrame:
    """With further trajectories of known features; shape of ``geometries`` rows."""
    known = incoming.join(
        features.select("feature_id", "collection_id"), ["feature_id", "collection_id"], "left_semi"
    )
    return insert_new(geometries, known, ["geom_id"])


def append_properties(properties: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next snapshot, and the refused ones whose name the feature already has."""
    key = ["feature_id", "property_name"]
    return insert_new(properties, incoming, key), property_conflicts(incoming, properties)


def append_values(values: DataFrame, batches: DataFrame, **chunking) -> tuple[DataFrame, DataFrame]:
    """Next snapshot, and the well-formed batches refused for starting too early.

    A batch is taken when it starts after all stored values of its property and after the
    end of every batch of this call that was taken before it, in order of start and
    ``value_id``. Equal batches are judged one by one, and those without a property as one
    property; a batch whose start is null is refused. ``last_time`` of a refused batch is the
    end it had to start after.

    Of the batches with one start only the first can be taken, so starts are linked: each to
    the first start after its end. A batch that starts after the ends of all earlier ones is
    taken whatever became of those; from there the links are followed in jumps that double.
    All steps are joins and chunked windows over rows, however many batches overlap.
    """
    judged = continuity_check(accepted(validate_values(batches)), values).withColumns(
        {
            "_start": F.try_element_at("datetimes", F.lit(1)),
            "_end": F.greatest(F.try_element_at("datetimes", F.lit(1)), F.try_element_at("datetimes", F.lit(-1))),
            "_row": F.monotonically_increasing_id(),
        }
    )
    judged = cut_lineage(judged)  # the row numbers must be the same wherever they are used
    open_ones = F.coalesce(F.col("continuous") & F.col("_start").isNotNull(), F.lit(False))
    late = judged.filter(~open_ones).select(*batches.columns, "last_time")
    brief = judged.filter(open_ones).select("property_id", "value_id", "_row", "_start", "_end")
    ties = ["value_id", "_row"]
    brief = cut_lineage(running_max_before(brief, ["property_id"], "_start", "_end", "_until", ties, **chunking))

    heads = brief.groupBy("property_id", "_start").agg(
        F.min(F.struct("value_id", "_row", "_end", "_until")).alias("_head")
    ).select("property_id", "_start", "_head._row", "_head._end", "_head._until")
    opens = F.col("_until").isNull() | (F.col("_until") < F.col("_start"))
    nodes = cut_lineage(_first_start_after_end(heads.withColumn("_opens", opens), **chunking))
    taken_rows = nodes.select("_row").join(_linked(nodes), "_row", "left_semi").withColumn("_taken", F.lit(True))
    told = brief.drop("_until").join(taken_rows, "_row", "left")
    told = running_max_before(
        told.withColumn("_taken_end", F.when(F.col("_taken"), F.col("_end"))),
        ["property_id"], "_start", "_taken_end", "_after", ties, **chunking,
    )
    told = judged.join(cut_lineage(told.select("_row", "_taken", "_after")), "_row")
    taken = told.filter("_taken").select(*batches.columns)
    refused = told.filter("_taken IS NULL").select(*batches.columns, F.col("_after").alias("last_time"))
    return values.unionByName(taken, allowMissingColumns=True), late.unionByName(refused)


def _first_start_after_end(heads: DataFrame, **chunking) -> DataFrame:
    """(_row, _opens, _next): the row with the property's first start after this one's end."""
    backwards = lambda t: F.timestamp_micros(-F.unix_micros(t))
    # Going back in time, ends ask before the starts of the same moment tell.
    asking = heads.select("property_id", "_row", backwards(F.col("_end")).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("timestamp").alias("_tells"))
    telling = heads.select("property_id", "_row", backwards(F.col("_start")).alias("_at"), F.lit(1).alias("_kind"), backwards(F.col("_start")).alias("_tells"))
    found = running_max_before(
        cut_lineage(asking.unionByName(telling)), ["property_id"], "_at", "_tells", "_found", ["_kind", "_row"], **chunking
    )
    found = found.filter("_kind = 0").select("property_id", F.col("_row").alias("_from"), backwards(F.col("_found")).alias("_next_start"))
    to = heads.select(F.col("property_id").alias("_property"), F.col("_start").alias("_next_start"), F.col("_row").alias("_next"))
    links = found.join(
        to, F.col("property_id").eqNullSafe(F.col("_property")) & (found["_next_start"] == to["_next_start"])
    ).select(F.col("_from").alias("_row"), "_next")
    return heads.select("_row", "_opens").join(links, "_row", "left")


def _linked(nodes: DataFrame) -> DataFrame:
    """The rows that open or that links from such rows reach."""
    reached = nodes.filter("_opens").select("_row")
    opening = reached.withColumnRenamed("_row", "_next")
    jumps = nodes.filter("_next IS NOT NULL").select("_row", "_next").join(opening, "_next", "left_anti")
    jumps = cut_lineage(jumps.select("_row", "_next"))
    while not jumps.isEmpty():
        further = reached.join(jumps, "_row").select(F.col("_next").alias("_row"))
        reached = cut_lineage(reached.union(further).distinct())
        second = jumps.select(F.col("_row").alias("_next"), F.col("_next").alias("_last"))
        jumps = cut_lineage(jumps.join(second, "_next").select("_row", F.col("_last").alias("_next")))
    return reached
