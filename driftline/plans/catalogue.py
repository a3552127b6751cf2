"""The tables of a moving-feature catalogue and one method per request of its interface.

Reads return lazy DataFrames. Changes return a new catalogue; ``save`` writes it. The
error kinds of the interface (not found, refused, malformed) are rows, not exceptions,
except for malformed query arguments.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import mutate, properties as P, temporal, validate
from driftline.operators.features import (
    collection_list,
    lookup_features,
    requests_missing,
)
from driftline.plans.items import Items, items, items_document
from driftline.sources import documents, export, store


@dataclass(frozen=True)
class Catalogue:
    collections: DataFrame
    features: DataFrame
    geometries: DataFrame
    instants: DataFrame
    properties: DataFrame
    temporal_values: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> "Catalogue":
        return cls(**store.read_tables(spark, root))

    @property
    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))

    def save(self, root: str) -> None:
        store.write_tables(self.tables, root)

    # Collections

    def list_collections(self) -> DataFrame:
        return collection_list(self.collections)

    def get_collection(self, collection_id: str) -> DataFrame:
        return collection_list(self.collections.filter(F.col("id") == collection_id))

    def post_collections(self, docs: DataFrame, now: Column) -> tuple["Catalogue", DataFrame]:
        """New collections; also the refused documents with their errors."""
        checked = validate.validate_collections(docs)
        judged = mutate.outcomes(validate.accepted(checked), ["id"], known=self.collections, known_reason="Collection already exists")
        late = mutate.refusals(judged).withColumn("errors", F.array(F.concat_ws(": ", "refused", "id"))).drop("refused")
        refused = validate.rejected(checked).unionByName(late)
        rows = mutate.taken_rows(judged).select(
            "id", "title", "description",
            F.col("updateFrequency").alias("update_frequency"),
            F.col("itemType").alias("item_type"),
            now.alias("created_at"),
            F.lit(None).cast("timestamp").alias("updated_at"),
        )
        return replace(self, collections=self.collections.unionByName(rows)), refused

    def put_collections(self, patches: DataFrame, now: Column) -> tuple["Catalogue", DataFrame]:
        """Changed collections; also the patches without effect, with the reason in ``refused``."""
        judged = mutate.judge_patches(self.collections, patches)
        changed = mutate.update_collections(self.collections, mutate.taken_rows(judged), now)
        return replace(self, collections=changed), mutate.refusals(judged)

    def delete_collections(self, gone: DataFrame) -> "Catalogue":
        return Catalogue(**mutate.delete_collections(self.tables, gone))

    # Features

    def get_items(self, collection_id: str, after: tuple | None = None, **arguments) -> Items:
        query = validate.item_query(**arguments)
        mine = self.features.filter(F.col("collection_id") == collection_id)
        return items(mine, self.geometries, self.instants, query, after)

    def get_items_document(self, collection_id: str, now: Column, after: tuple | None = None, base: str = "", **arguments) -> DataFrame:
        """The same page as the lines of one feature collection, see ``items_document``."""
        page = self.get_items(collection_id, after, **arguments)
        limit = validate.item_query(**arguments).limit
        asked = "".join(f"&{name}={arguments[name]}" for name in ("bbox", "datetime") if arguments.get(name))
        return items_document(page, now, f"{base}/collections/{collection_id}/items", limit, asked, base)

    def get_feature(self, collection_id: str, feature_id: str) -> DataFrame:
        """Document of one feature with all its trajectories, in ``part`` slices if very long."""
        mine = self.features.filter((F.col("collection_id") == collection_id) & (F.col("feature_id") == feature_id))
        here = F.col("feature_id") == feature_id
        return export.features_with_paths(mine, self.geometries.filter(here), self.instants.filter(here))

    def get_features(self, requests: DataFrame) -> DataFrame:
        return lookup_features(requests, self.features, self.geometries)

    def post_items(self, docs: DataFrame, now: Column) -> tuple["Catalogue", DataFrame]:
        """Features of ``(collection_id, body)`` documents; also the rejects with reasons.

        A rejected document has its ``body``; a feature refused because its id is known, or
        given more than once in the call, has its ``feature_id``.
        """
        known = docs.join(self.collections.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
        lost = docs.join(self.collections.select(F.col("id").alias("collection_id")), "collection_id", "left_anti")
        judged = mutate.outcomes(documents.parsed_features(known), ["feature_id"], known=self.features, known_reason="feature already exists")
        fresh = mutate.taken_rows(judged)
        place = fresh.select("feature_id", "collection_id")
        rows = documents.feature_rows(fresh).withColumns({"type": F.lit("Feature"), "created_at": now})
        geometries = documents.geometry_rows(fresh).join(place, "feature_id").withColumn("created_at", now)
        points = documents.feature_instants(fresh).join(place, "feature_id")
        grown = replace(
            self,
            features=self.features.unionByName(store.conform(rows, "features")),
            geometries=self.geometries.unionByName(store.conform(geometries, "geometries")),
            instants=self.instants.unionByName(store.conform(points, "instants")),
        )
        nothing = F.lit(None).cast("string")
        rejects = documents.rejected_documents(known).select("collection_id", "body", nothing.alias("feature_id"), "error")
        rejects = rejects.unionByName(
            lost.select("collection_id", "body", nothing.alias("feature_id"), F.lit("collection does not exist").alias("error"))
        )
        refused = mutate.refusals(judged).select("collection_id", nothing.alias("body"), "feature_id", F.col("refused").alias("error"))
        return grown, rejects.unionByName(refused)

    def delete_features(self, gone: DataFrame) -> "Catalogue":
        return Catalogue(**mutate.delete_features(self.tables, gone))

    # Trajectories

    def get_sequence(self, collection_id: str, feature_id: str) -> DataFrame:
        """Entries of the geometry sequence of one feature, each by its own interpolation."""
        here = (F.col("collection_id") == collection_id) & (F.col("feature_id") == feature_id)
        return export.geometry_sequence(self.instants.filter(here), self.geometries.filter(here))

    def get_sequence_document(self, collection_id: str, feature_id: str, now: Column, base: str = "") -> DataFrame:
        entries = self.get_sequence(collection_id, feature_id).withColumn("collection_id", F.lit(collection_id))
        return export.sequence_documents(entries, now, base=base)

    def post_sequences(self, paths: DataFrame, now: Column) -> tuple["Catalogue", DataFrame]:
        """Append trajectories of known features; also the refused ones with the reason in ``refused``.

        ``paths`` has ``collection_id, feature_id, geom_id, srid, trajectory`` (MF-JSON).
        """
        unreadable = documents.bad_trajectory(F.col("trajectory"))
        judged = mutate.outcomes(
            paths, ["geom_id"], [(unreadable, documents.BAD_PATH)],
            [(self.features, ["feature_id", "collection_id"], "feature does not exist")], self.geometries, "trajectory already exists",
        )
        fresh = mutate.taken_rows(judged)
        points = documents.decode_mfjson(fresh, keep=("geom_id", "feature_id", "collection_id"))
        keys = ["geom_id", "feature_id", "collection_id"]
        rows = temporal.extent(points, [*keys, "interpolation"]).join(fresh.select("geom_id", "srid"), "geom_id")
        rows = rows.withColumns({"geometry_type": F.lit("MovingPoint"), "created_at": now})
        return replace(
            self,
            geometries=self.geometries.unionByName(store.conform(rows, "geometries")),
            instants=self.instants.unionByName(store.conform(points, "instants")),
        ), mutate.refusals(judged)

    def delete_geometries(self, gone: DataFrame) -> "Catalogue":
        return Catalogue(**mutate.delete_geometries(self.tables, gone))

    def _requested(self, requests: DataFrame) -> DataFrame:
        keys = self.geometries.join(requests.select("collection_id", "feature_id", "geom_id"),
                                    ["collection_id", "feature_id", "geom_id"], "left_semi")
        return self.instants.join(keys.select("geom_id"), "geom_id", "left_semi")

    def distance(self, requests: DataFrame) -> DataFrame:
        return temporal.distance_curve(self._requested(requests))

    def velocity(self, requests: DataFrame) -> DataFrame:
        return temporal.velocity_curve(self._requested(requests))

    def acceleration(self, requests: DataFrame) -> DataFrame:
        return temporal.acceleration_curve(self._requested(requests))

    def missing(self, requests: DataFrame) -> DataFrame:
        """Requests that name something unknown, with the first such thing."""
        return requests_missing(requests, self.collections, self.features, self.geometries)

    # Properties

    def get_properties(self, feature_id: str) -> DataFrame:
        return P.property_list(self.properties.filter(F.col("feature_id") == feature_id))

    def get_property(self, feature_id: str, name: str) -> DataFrame:
        mine = self.properties.filter((F.col("feature_id") == feature_id) & (F.col("property_name") == name))
        values = self.temporal_values.join(mine.select("property_id"), "property_id", "left_semi")
        return P.property_values(mine, values)

    def post_properties(self, incoming: DataFrame) -> tuple["Catalogue", DataFrame]:
        """``incoming`` in the shape of the table, without ``property_id``; also the refused ones with the reason."""
        keyed = incoming.withColumn("property_id", F.xxhash64("feature_id", "property_name"))
        judged = mutate.judge_properties(self.properties, store.conform(keyed, "properties"), self.features)
        grown = self.properties.unionByName(mutate.taken_rows(judged))
        return replace(self, properties=grown), mutate.refusals(judged)

    def post_values(self, batches: DataFrame) -> tuple["Catalogue", DataFrame]:
        """``batches`` in the shape of the table, without ``value_id``; also the refused ones with the reason.

        ``last_time`` of a batch that starts too early is the time after which it had to start.
        """
        keyed = store.conform(batches.withColumn("value_id", F.xxhash64("property_id", "datetimes", "values")), "temporal_values")
        checked = validate.validate_values(keyed)
        good, malformed = validate.accepted(checked), validate.rejected(checked)
        ids = self.properties.select("property_id")
        unknown = good.join(ids, "property_id", "left_anti")
        grown, early = mutate.append_values(self.temporal_values, good.join(ids, "property_id", "left_semi"))
        no_time = F.lit(None).cast("timestamp").alias("last_time")
        refused = early.withColumn("refused", F.lit("starts before the end of earlier values"))
        refused = refused.unionByName(malformed.select(*keyed.columns, no_time, F.get("errors", F.lit(0)).alias("refused")))
        refused = refused.unionByName(unknown.select(*keyed.columns, no_time, F.lit("property does not exist").alias("refused")))
        return replace(self, temporal_values=grown), refused

    def delete_properties(self, gone: DataFrame) -> "Catalogue":
        return Catalogue(**mutate.delete_properties(self.tables, gone))

    def delete_values(self, gone: DataFrame) -> "Catalogue":
        return replace(self, temporal_values=mutate.delete_values(self.temporal_values, gone))
