"""Moving-object views of the driver's parquet tables.

``events`` are the position reports: one object per user, one trajectory per user and
event type. ``customer`` rows are the moving features, in the collection of their
nation; many have no trajectory. All views are lazy and read whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.geo import envelope_columns
from driftline.functions.text import iso_time, slug
from driftline.operators import temporal
from driftline.session import configure
from driftline.sources.export import mfjson_point

KINDS = ("click", "error", "purchase", "signup", "view")


class DriverTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    @cached_property
    def tracks(self) -> DataFrame:
        """``event_id, feature_id, geom_id, event_type, t, x, y`` of all events."""
        kind = F.lit(len(KINDS))
        for code, name in enumerate(KINDS):
            kind = F.when(F.col("event_type") == name, F.lit(code)).otherwise(kind)
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("feature_id"),
            (F.col("user_id") * 10 + kind).alias("geom_id"),
            "event_type",
            F.col("ts").cast("timestamp").alias("t"),
            F.col("value").alias("x"),
            F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("y"),
        )

    @cached_property
    def paths(self) -> DataFrame:
        """The long form alone: ``geom_id, t, x, y``."""
        return self.tracks.select("geom_id", "t", "x", "y")

    @property
    def interpolation(self) -> Column:
        """Signups are Discrete paths, views Step paths, all others Linear."""
        kind = F.col("event_type")
        return F.when(kind == "signup", F.lit("Discrete")).when(kind == "view", F.lit("Step")).otherwise(F.lit("Linear"))

    @cached_property
    def mixed_paths(self) -> DataFrame:
        """The long form with the interpolation of each path."""
        return self.tracks.select("geom_id", "t", "x", "y", self.interpolation.alias("interpolation"))

    @cached_property
    def geometries(self) -> DataFrame:
        """One row per trajectory with its extent."""
        nested = temporal.extent(self.tracks, ["geom_id", "feature_id", "event_type"])
        return nested.withColumns(
            {
                "geometry_type": F.lit("MovingPoint"),
                "interpolation": self.interpolation,
                "base": F.lit(None).cast("string"),
                "srid": F.lit(25832),
            }
        )

    @cached_property
    def collections(self) -> DataFrame:
        """Nations: 25 rows at every scale."""
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                slug(F.col("n_name")).alias("id"),
                F.col("n_name").alias("title"),
                F.col("r_name").alias("description"),
                F.col("n_nationkey").alias("update_frequency"),
                F.lit("movingfeature").alias("item_type"),
                F.timestamp_add("DAY", F.col("n_regionkey"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
                F.lit(None).cast("timestamp").alias("updated_at"),
            )
        )

    @cached_property
    def features(self) -> DataFrame:
        """Customers; ``created_at`` follows the key, in whole minutes."""
        nation = self.table("nation").select("n_nationkey", slug(F.col("n_name")).alias("collection_id"))
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("feature_id"),
                "collection_id",
                F.col("c_name").alias("name"),
                F.col("c_mktsegment").alias("segment"),
                F.timestamp_add("MINUTE", F.col("c_custkey"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
            )
        )

    @cached_property
    def properties(self) -> DataFrame:
        """One temporal property per object and event type."""
        return self.tracks.select("feature_id", "geom_id", "event_type").distinct().select(
            F.col("geom_id").alias("property_id"),
            "feature_id",
            F.col("event_type").alias("property_name"),
            F.lit("TReal").alias("property_type"),
            F.lit("KMH").alias("form"),
            F.concat(F.lit("value of "), F.col("event_type")).alias("description"),
        )

    @cached_property
    def value_batches(self) -> DataFrame:
        """One batch of values per property and date, as posted at the end of each day; named by its least event."""
        rows = self.tracks.select(
            "event_id", F.col("geom_id").alias("property_id"), F.to_date("t").alias("date"), "t", F.col("x").alias("v")
        )
        return (
            rows.groupBy("property_id", "date")
            .agg(F.min("event_id").alias("value_id"), F.sort_array(F.collect_list(F.struct("t", "v"))).alias("pairs"))
            .select(
                "value_id",
                "property_id",
                F.dayofmonth("date").alias("day"),
                F.transform("pairs", lambda p: p["t"]).alias("datetimes"),
                F.transform("pairs", lambda p: p["v"].cast("string")).alias("values"),
                F.lit("Linear").alias("interpolation"),
            )
        )

    @cached_property
    def reports(self) -> DataFrame:
        """Position reports to the full hour, so that copies of (ship, time) occur.

        Some texts are placeholders or missing and some positions lie outside the area.
        """
        kind = F.col("event_type")

        def text(special: dict[str, str | None], usual) -> Column:
            out = usual
            for name, value in special.items():
                out = F.when(kind == name, F.lit(value)).otherwise(out)
            return out

        ship = F.col("feature_id").cast("string")
        k, v = F.col("y"), F.col("x")
        return self.tracks.select(
            F.date_trunc("HOUR", "t").alias("t"),
            F.col("feature_id").alias("mmsi"),
            (F.lit(54.0) + k / 50).alias("lat"),
            (F.lit(4.0) + v / 15).alias("lon"),
            F.when(k != 0, k / 4).alias("sog"),
            v.alias("cog"),
            F.when(k < 90, k * 3).alias("heading"),
            text({"signup": "Undefined", "error": "Unknown value"}, kind).alias("navigational_status"),
            text({"error": "Unknown"}, F.concat(F.lit("IMO"), ship)).alias("imo"),
            text({"view": "Unknown"}, F.concat(F.lit("C"), ship, kind)).alias("callsign"),
            text({"error": "Unknown", "click": ""}, F.concat(F.lit("Ship "), ship, kind)).alias("name"),
            text({"signup": "Undefined"}, kind).alias("ship_type"),
            text({"purchase": "Undefined"}, F.concat(F.lit("Cargo "), kind)).alias("cargo_type"),
            text({"view": "Unknown", "signup": "Undefined", "error": None},
                 F.concat(F.lit("Port "), k.cast("int").cast("string"))).alias("destination"),
            text({"click": "Undefined"}, F.lit("GPS")).alias("type_of_position_fixing_device"),
            F.lit("Class A").alias("type_of_mobile"),
            (k * 2).alias("length"),
            (k / 2).alias("width"),
            (v / 50).alias("draught"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """One request per order. By order status the collection is right, another or unknown."""
        nation = self.table("nation").select("n_nationkey", "n_name")
        code = F.substring("o_orderpriority", 1, 1).cast("int") - 1
        right = slug(F.col("n_name"))
        other = F.concat(F.lit("nation_"), ((F.col("c_nationkey") + 1) % 25).cast("string"))
        name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), code + 1)
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").alias("request_id"),
                F.when(F.col("o_orderstatus") == "F", slug(F.col("o_orderpriority")))
                .when(F.col("o_orderstatus") == "P", other)
                .otherwise(right)
                .alias("collection_id"),
                F.col("o_custkey").alias("feature_id"),
                (F.col("o_custkey") * 10 + code).alias("geom_id"),
                name.alias("property_name"),
                F.dayofmonth("o_orderdate").alias("day"),
                F.col("o_orderpriority").alias("priority"),
                F.col("o_orderstatus").alias("status"),
            )
        )

    @cached_property
    def regions(self) -> DataFrame:
        """A rectangle per supplier, with corners in any order."""
        x = F.col("s_suppkey") % 100 * 4.0
        y = F.col("s_nationkey") * 4.0
        side = F.col("s_acctbal") / 1000
        return self.table("supplier").select(
            F.col("s_suppkey").alias("region_id"), *envelope_columns(x, y, x + side, y + side)
        )

    @cached_property
    def fleets(self) -> DataFrame:
        """Suppliers as collections."""
        return self.table("supplier").select(
            slug(F.col("s_name")).alias("id"),
            F.col("s_name").alias("title"),
            F.concat(F.lit("fleet of nation "), F.col("s_nationkey").cast("string")).alias("description"),
            F.col("s_nationkey").alias("update_frequency"),
            F.lit("movingfeature").alias("item_type"),
            F.timestamp_add("DAY", F.col("s_nationkey"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
        )

    @cached_property
    def collection_documents(self) -> DataFrame:
        """Posted collections, one per supplier: some without title, some of a wrong type."""
        nation = F.col("s_nationkey")
        return self.table("supplier").select(
            F.col("s_suppkey").alias("doc_id"),
            F.when(F.col("s_acctbal") < 0, F.lit(None))
            .when(F.col("s_acctbal") < 2000, F.concat(F.lit("NATION_"), nation.cast("string")))
            .otherwise(F.col("s_name"))
            .alias("title"),
            F.concat(F.lit("posted "), F.col("s_suppkey").cast("string")).alias("description"),
            nation.alias("updateFrequency"),
            F.when(nation == 3, F.lit("feature")).when(nation > 12, F.lit("movingfeature")).alias("itemType"),
        )

    @cached_property
    def feature_documents(self) -> DataFrame:
        """Posted documents, one per trajectory (and slice of time of a very long one), in all shapes the interface meets.

        Clicks and views are features with the path as object, purchases with the path
        as JSON text, signups come in a feature collection, errors have a wrong type.
        """
        paths = temporal.pack_instants(self.tracks, ["geom_id", "event_type"], join_ends=False)
        path = mfjson_point(F.col("instants"))
        common = {
            "id": F.col("geom_id"),
            "properties": F.struct(F.col("event_type").alias("kind")),
            "crs": F.struct(F.lit("name").alias("type"), F.struct(F.lit("urn:ogc:def:crs:EPSG::25832").alias("name")).alias("properties")),
        }

        def feature(kind: str, geometry) -> Column:
            block = F.struct(
                F.transform("instants", lambda p: iso_time(p["t"])).alias("datetimes"),
                F.struct(
                    F.lit("Measure").alias("type"), F.lit("KMH").alias("form"),
                    F.transform("instants", lambda p: p["x"]).alias("values"),
                    F.lit("Step").alias("interpolation"),
                ).alias("pace"),
            )
            return F.to_json(F.struct(
                F.lit(kind).alias("type"),
                *[c.alias(n) for n, c in common.items()],
                geometry.alias("temporalGeometry"),
                F.array(block).alias("temporalProperties"),
            ))

        kind = F.col("event_type")
        body = (
            F.when(kind == "error", feature("Movement", path))
            .when(kind == "signup", F.concat(F.lit('{"type":"FeatureCollection","features":['), feature("Feature", path), F.lit("]}")))
            .when(kind == "purchase", feature("Feature", F.to_json(path)))
            .otherwise(feature("Feature", path))
        )
        return paths.select("geom_id", "event_type", body.alias("body"))

    @cached_property
    def posted_batches(self) -> DataFrame:
        """The stored value batches again, 15 days later; error batches lack one value."""
        late = F.transform("datetimes", lambda t: F.timestamp_add("DAY", F.lit(15), t))
        short = F.col("property_id") % 10 == KINDS.index("error")
        return self.value_batches.select(
            (-1 - F.col("value_id")).alias("value_id"),
            "property_id",
            late.alias("datetimes"),
            F.when(short, F.slice("values", 2, F.size("values"))).otherwise(F.col("values")).alias("values"),
            "interpolation",
        )

    @cached_property
    def order_paths(self) -> DataFrame:
        """A short path per order from its lines, of the order's customer."""
        lines = self.table("lineitem").select(
            "l_orderkey",
            F.timestamp_add("SECOND", F.col("l_linenumber"), F.col("l_shipdate").cast("timestamp")).alias("t"),
            F.col("l_quantity").alias("x"),
            (F.col("l_extendedprice") / 1000).alias("y"),
        )
        boxes = temporal.extent(lines, ["l_orderkey"])
        orders = self.requests.select(F.col("request_id").alias("l_orderkey"), "feature_id", "collection_id")
        return boxes.join(orders, "l_orderkey").select(
            (F.col("l_orderkey") + 100_000_000).alias("geom_id"), "feature_id", "collection_id",
            "xmin", "ymin", "xmax", "ymax", "tmin", "tmax", "n_instants",
        )


def plain_times(df: DataFrame) -> DataFrame:
    """Zone-free timestamps, so that a reader's own zone cannot shift them."""
    return df.select(
        *[
            F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in df.dtypes
        ]
    )
