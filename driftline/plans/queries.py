"""Registered queries over the driver's tables, each with SQL that must give the same.

Every query runs over whole tables. The SQL states the definition directly, often in
another form than the Spark plan, so that the two check each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.geo import envelope, round_to
from driftline.functions.text import DEFAULT_SRID, parse_time, slug, srid_of
from driftline.operators import features as X
from driftline.operators import mutate as M
from driftline.operators import predicates as B
from driftline.operators import properties as P
from driftline.operators import reports as R
from driftline.operators import temporal as T
from driftline.operators import validate as V
from driftline.operators.regions import region_visits
from driftline.plans import sql as S
from driftline.plans.ais_day import ais_day, clean_positions, profile_trips
from driftline.plans.driver_tables import DriverTables, plain_times
from driftline.plans.items import items, items_document
from driftline.plans.port_traffic import port_traffic
from driftline.session import cut_lineage
from driftline.sources import documents, export

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BOX = envelope(260.0, 60.0, 200.0, 40.0)
SECOND_BOX = envelope(20.0, 80.0, 80.0, 95.0)
START, END = "2024-01-10 00:00:00", "2024-01-12 12:00:00"
INSTANT = "2024-01-28 00:00:00"
NOW = "2024-06-01 00:00:00"
SPEED_LIMIT = 0.01


def register(name: str, sql: str | None = None):
    def add(build: Callable[[DriverTables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain_times(build(DriverTables(spark, folder)))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_to(F.col(c), digits) for c in columns})


# Temporal algebra


@register("velocity_curve", S.ctes("tracks", "norm", "speed") + "SELECT geom_id, t, speed FROM speed")
def _(d):
    return T.velocity_curve(d.paths)


@register("distance_curve", S.ctes("tracks", "seq", "norm") + """
    , total AS (SELECT geom_id, t, sum(coalesce(sqrt((x-px)*(x-px)+(y-py)*(y-py)), 0)) OVER
        (PARTITION BY geom_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS d FROM seq)
    SELECT n.geom_id, n.t, round(d, 6) AS distance FROM norm n JOIN total USING (geom_id, t)""")
def _(d):
    return T.distance_curve(d.paths)


@register("acceleration_curve", S.ctes("tracks", "norm", "speed") + """
    SELECT geom_id, t, round(coalesce((speed - lag(speed) OVER w)
        / ((epoch_us(t) - epoch_us(lag(t) OVER w)) / 1e6), 0), 12) AS acceleration
    FROM speed WINDOW w AS (PARTITION BY geom_id ORDER BY t)""")
def _(d):
    return T.acceleration_curve(d.paths)


@register("normalise", S.ctes("tracks", "norm") + "SELECT geom_id, t, x, y FROM norm")
def _(d):
    return T.normalise(d.paths)


@register("trip_length", S.ctes("tracks", "seq") + """
    SELECT geom_id, round(sum(coalesce(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)), 0)), 5) AS length
    FROM seq GROUP BY geom_id""")
def _(d):
    return rounded(T.trip_length(d.paths), 5, "length")


@register("time_weighted_avg", S.ctes("tracks", "seq") + """
    SELECT geom_id, round(coalesce(sum((x + nx) / 2 * dt) / nullif(sum(dt), 0), min(x)), 6) AS twavg
    FROM (SELECT *, (epoch_us(nt) - epoch_us(t)) / 1e6 AS dt FROM seq) GROUP BY geom_id""")
def _(d):
    return rounded(T.time_weighted_avg(d.paths, "x"), 6, "twavg")


@register("extent", S.ctes("tracks") + """
    SELECT geom_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax,
        min(t) AS tmin, max(t) AS tmax, count(*) AS n_instants FROM tracks GROUP BY geom_id""")
def _(d):
    return T.extent(d.paths)


@register("extent_coalesce", S.ctes("tracks") + """
    , box AS (SELECT feature_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax,
        min(t) AS tmin, max(t) AS tmax FROM tracks GROUP BY feature_id)
    SELECT c_custkey AS feature_id,
        CASE WHEN c_acctbal > 0 THEN 0.0 ELSE xmin END AS xmin,
        CASE WHEN c_acctbal > 0 THEN 0.0 ELSE ymin END AS ymin,
        CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE xmax END AS xmax,
        CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE ymax END AS ymax, tmin, tmax
    FROM customer LEFT JOIN box ON c_custkey = feature_id""")
def _(d):
    has = F.col("c_acctbal") > 0
    given = d.table("customer").select(
        F.col("c_custkey").alias("feature_id"),
        F.when(has, F.lit(0.0)).alias("xmin"), F.when(has, F.lit(0.0)).alias("ymin"),
        F.when(has, F.col("c_acctbal")).alias("xmax"), F.when(has, F.col("c_acctbal")).alias("ymax"),
        F.lit(None).cast("timestamp").alias("tmin"), F.lit(None).cast("timestamp").alias("tmax"),
    )
    return T.extent_or_given(given, T.extent(d.tracks, ["feature_id"]))


@register("subtrajectory", S.ctes("tracks", "seq") + f"""
    , cut AS (
        SELECT geom_id, t, x, y FROM seq WHERE t BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
        UNION
        SELECT geom_id, b AS t, x + (nx - x) * s AS x, y + (ny - y) * s AS y
        FROM (SELECT *, ((epoch_us(b) - epoch_us(t)) / 1e6) / ((epoch_us(nt) - epoch_us(t)) / 1e6) AS s
              FROM seq, (VALUES (TIMESTAMP '{START}'), (TIMESTAMP '{END}')) v(b) WHERE t < b AND nt > b))
    SELECT geom_id, t, round(x, 6) AS x, round(y, 6) AS y FROM cut""")
def _(d):
    return rounded(T.subtrajectory(d.paths, START, END), 6, "x", "y")


@register("leaf", S.ctes("tracks") + """
    SELECT geom_id, max(t) AS t, arg_max(x, t) AS x, arg_max(y, t) AS y, 'Discrete' AS interpolation
    FROM tracks GROUP BY geom_id""")
def _(d):
    return T.leaf(d.paths)


MIXED_SHAPE_SQL = """
    , bends AS (SELECT n.* FROM (SELECT *, lag(x) OVER w AS bef_x, lag(y) OVER w AS bef_y FROM mixed
        WINDOW w AS (PARTITION BY geom_id ORDER BY t)) n WHERE bef_x IS NULL OR bef_x <> x OR bef_y <> y)"""
SHAPE_SQL = """
    , bends AS (SELECT n.* FROM (SELECT *, lag(x) OVER w AS bef_x, lag(y) OVER w AS bef_y FROM norm
        WINDOW w AS (PARTITION BY geom_id ORDER BY t)) n WHERE bef_x IS NULL OR bef_x <> x OR bef_y <> y)"""


def shape_type(kind: str = "'Linear'") -> str:
    return f"CASE WHEN count(*) = 1 THEN 'Point' WHEN {kind} = 'Linear' THEN 'LineString' ELSE 'MultiPoint' END"


def own_items(items: Column, joined: Column) -> Column:
    """Items of a slice without the one that it shares with the slice before."""
    return F.when(joined, F.slice(items, F.lit(2), F.size(items))).otherwise(items)


def whole_type(n_points: Column, kind: Column | str = "Linear") -> Column:
    """Shape of all slices together."""
    line = F.when(kind == "Linear", "LineString").otherwise("MultiPoint") if isinstance(kind, Column) else F.lit("LineString")
    return F.when(n_points == 1, F.lit("Point")).otherwise(line)


@register("trajectory_shape", S.ctes("tracks", "mixed") + MIXED_SHAPE_SQL + f"""
    SELECT geom_id, count(*)::INTEGER AS n_points, {shape_type('any_value(kind)')} AS shape_type,
        round(arg_min(x, t), 6) AS first_x, round(arg_min(y, t), 6) AS first_y, round(sum(x), 4) AS sum_x,
        round(sum(leg), 4) AS drawn
    FROM (SELECT *, CASE WHEN kind = 'Linear' THEN coalesce(sqrt((x - bef_x) * (x - bef_x) + (y - bef_y) * (y - bef_y)), 0)
        ELSE 0 END AS leg FROM bends) GROUP BY geom_id""")
def _(d):
    """Slices of one path meet again: vertices once, every leg in one slice."""
    shape = F.from_json("geometry", "type string, coordinates string")
    flat = T.trajectory_shape(d.mixed_paths).withColumn("_s", shape)
    many = F.from_json("_s.coordinates", "array<array<double>>")
    points = F.when(F.col("n_points") > 1, many).otherwise(F.array(F.from_json("_s.coordinates", "array<double>")))
    legs = F.zip_with(F.slice(points, F.lit(2), F.size(points)), F.slice(points, F.lit(1), F.size(points) - 1),
                      lambda a, b: F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])))
    zero = F.lit(0.0)
    sliced = flat.select(
        "geom_id", "part", own_items(points, F.col("joined")).alias("points"),
        F.when(F.col("_s.type") == "LineString", F.aggregate(legs, zero, lambda acc, leg: acc + leg)).otherwise(zero).alias("drawn"),
        F.when(F.col("_s.type") == "MultiPoint", 1).otherwise(0).alias("spots"),
    )
    first = F.min(F.struct("part", F.get("points", F.lit(0)).alias("p")))["p"]
    whole = sliced.groupBy("geom_id").agg(
        F.sum(F.size("points")).cast("int").alias("n_points"), first.alias("first"), F.max("spots").alias("spots"),
        F.sum(F.aggregate("points", zero, lambda acc, p: acc + p[0])).alias("sum_x"), F.sum("drawn").alias("drawn"),
    )
    kind = F.when(F.col("spots") == 1, "Discrete").otherwise("Linear")
    return whole.select(
        "geom_id", "n_points", whole_type(F.col("n_points"), kind).alias("shape_type"),
        round_to(F.col("first")[0], 6).alias("first_x"), round_to(F.col("first")[1], 6).alias("first_y"),
        round_to(F.col("sum_x"), 4).alias("sum_x"), round_to(F.col("drawn"), 4).alias("drawn"),
    )


@register("normalise_mixed", S.ctes("tracks", "mixed") + "SELECT geom_id, kind AS interpolation, t, x, y FROM mixed")
def _(d):
    return T.normalise(d.mixed_paths).select("geom_id", "interpolation", "t", "x", "y")


@register("feature_line", S.ctes("tracks", "norm") + SHAPE_SQL + """
    SELECT geom_id // 10 AS feature_id, count(*)::INTEGER AS n_points,
        CASE WHEN count(*) = 1 THEN 'Point' ELSE 'LineString' END AS shape_type FROM bends GROUP BY geom_id // 10""")
def _(d):
    lines = T.feature_line(d.tracks).groupBy("feature_id").agg(
        F.sum(F.col("n_points") - F.col("joined").cast("int")).cast("int").alias("n_points"),
        F.max(F.get_json_object("geometry", "$.type")).alias("drawn"),
    )
    return lines.select("feature_id", "n_points", F.when(F.col("n_points") == 1, F.col("drawn")).otherwise("LineString").alias("shape_type"))


@register("speed_status", S.ctes("tracks", "norm", "speed") + """
    SELECT geom_id, t, speed, CASE WHEN speed = 0 THEN 'STOPPED' WHEN speed < 1 THEN 'docking'
        ELSE 'Moving' END AS status FROM speed""")
def _(d):
    return T.speed_states(d.paths)


@register("speed_violations", S.ctes("tracks", "norm", "speed") + f"""
    SELECT geom_id, bool_or(speed > {SPEED_LIMIT}) AS violates, count(*) FILTER (speed > {SPEED_LIMIT}) AS n_over,
        min(t) FILTER (speed > {SPEED_LIMIT}) AS first_over, max(speed) AS max_speed FROM speed GROUP BY geom_id""")
def _(d):
    return T.speed_violations(d.paths, SPEED_LIMIT)


@register("speed_summary", S.ctes("tracks", "norm", "speed") + """
    SELECT geom_id, max(speed) AS max_speed, min(speed) AS min_speed,
        round(max(speed) * 1.94384, 6) AS max_knots, round(min(speed) * 1.94384, 6) AS min_knots
    FROM speed GROUP BY geom_id""")
def _(d):
    return rounded(T.speed_summary(d.paths), 6, "max_knots", "min_knots")


# Filters


@register("bbox_overlap", S.ctes("tracks", "boxes") + """
    SELECT geom_id, xmin, ymin, xmax, ymax FROM boxes
    WHERE xmin <= 260 AND xmax >= 200 AND ymin <= 60 AND ymax >= 40""")
def _(d):
    return B.bbox_overlap(T.extent(d.paths), BOX).select("geom_id", "xmin", "ymin", "xmax", "ymax")


@register("time_overlap", S.ctes("tracks", "boxes") + f"""
    SELECT geom_id, tmin, tmax FROM boxes
    WHERE tmin <= TIMESTAMP '2024-01-03 00:00:00' AND tmax >= TIMESTAMP '2024-01-02 00:00:00'""")
def _(d):
    hit = B.time_overlap(T.extent(d.paths), "2024-01-02 00:00:00", "2024-01-03 00:00:00")
    return hit.select("geom_id", "tmin", "tmax")


@register("instant_overlap", S.ctes("tracks", "boxes") + f"""
    SELECT geom_id, tmin, tmax FROM boxes WHERE TIMESTAMP '{INSTANT}' BETWEEN tmin AND tmax""")
def _(d):
    return B.instant_overlap(T.extent(d.paths), INSTANT).select("geom_id", "tmin", "tmax")


@register("ever_intersects", S.ctes("tracks", "seq") + f"""
    SELECT geom_id FROM seq GROUP BY geom_id HAVING bool_or({S.hit('200', '40', '260', '60')})""")
def _(d):
    return B.ever_intersects(d.paths, BOX, extents=T.extent(d.paths))


@register("visits_both", S.ctes("tracks", "seq") + f"""
    SELECT geom_id, round(sum(coalesce(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)), 0)) / 1000, 6) AS length_km
    FROM seq GROUP BY geom_id
    HAVING bool_or({S.hit('200', '40', '260', '60')}) AND bool_or({S.hit('20', '80', '80', '95')})""")
def _(d):
    return rounded(B.visits_both(d.paths, BOX, SECOND_BOX), 6, "length_km")


@register("length_filter", S.ctes("tracks", "seq") + """
    SELECT geom_id, round(sum(coalesce(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)), 0)), 5) AS length
    FROM seq GROUP BY geom_id HAVING sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))) > 0
        AND sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))) < 1000""")
def _(d):
    return rounded(B.length_filter(d.paths, max_length=1000.0), 5, "length")


@register("region_visits", S.ctes("tracks", "seq", "regions") + f"""
    SELECT geom_id, region_id, count(*) AS n_segments, min(t) AS first_contact
    FROM seq JOIN regions ON least(x, coalesce(nx, x)) <= xmax AND greatest(x, coalesce(nx, x)) >= xmin
        AND least(y, coalesce(ny, y)) <= ymax AND greatest(y, coalesce(ny, y)) >= ymin
    WHERE {S.hit('xmin', 'ymin', 'xmax', 'ymax')} GROUP BY geom_id, region_id""")
def _(d):
    return region_visits(plain_times(d.paths), d.regions, finest=8.0)


# Reports


@register("clean_placeholders", S.ctes("tracks", "reports", "cleaned") + "SELECT * FROM cleaned")
def _(d):
    return R.clean_placeholders(d.reports)


@register("domain_filter", S.ctes("tracks", "reports", "cleaned", "inside") + "SELECT mmsi, t, lat, lon, sog, cog FROM inside")
def _(d):
    return R.domain_filter(d.reports).select("mmsi", "t", "lat", "lon", "sog", "cog")


@register("clean_profile_b", S.ctes("tracks", "reports") + """
    SELECT mmsi, t, lat, lon, sog, cog, heading, destination,
        CASE WHEN name = '' THEN 'No Name' ELSE name END AS name FROM reports
    WHERE mmsi <> 0 AND lat BETWEEN 40.18 AND 84.73 AND lon BETWEEN -16.1 AND 32.88
        AND sog BETWEEN 0 AND 1022 AND cog IS NOT NULL AND heading IS NOT NULL
        AND destination IS DISTINCT FROM 'Undefined'""")
def _(d):
    return R.clean_profile(d.reports).select(
        "mmsi", "t", "lat", "lon", "sog", "cog", "heading", "destination", "name"
    )


@register("coerce_numeric", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS reading,
        CASE WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS DOUBLE) END AS mmsi FROM events""")
def _(d):
    kind = F.col("event_type")
    texts = d.table("events").select(
        "event_id",
        F.when(kind == "error", F.col("props")).otherwise(F.col("value").cast("string")).alias("reading"),
        F.when(kind == "view", kind).otherwise(F.col("user_id").cast("string")).alias("mmsi"),
    )
    return R.coerce_numeric(texts, ["reading", "mmsi"])


@register("default_name", S.ctes("tracks", "reports") + """
    SELECT mmsi, t, sog, CASE WHEN name = '' THEN 'No Name' ELSE name END AS name FROM reports""")
def _(d):
    return R.default_name(d.reports).select("mmsi", "t", "sog", "name")


@register("dedup_reports", S.ctes("tracks", "reports", "cleaned", "inside", "dedup") + """
    SELECT mmsi, t, lat, lon, sog, cog, heading, name, destination FROM dedup""")
def _(d):
    clean = R.dedup_reports(R.domain_filter(R.clean_placeholders(d.reports)))
    return clean.select("mmsi", "t", "lat", "lon", "sog", "cog", "heading", "name", "destination")


@register("static_attributes", S.ctes("tracks", "reports", "cleaned") + """
    SELECT mmsi, min(name) AS name, min(imo) AS imo, min(ship_type) AS ship_type, min(cargo_type) AS cargo_type,
        min(destination) AS destination, min(callsign) AS callsign, min(navigational_status) AS navigational_status,
        min(type_of_mobile) AS type_of_mobile, min(length) AS length, min(width) AS width, min(draught) AS draught
    FROM cleaned GROUP BY mmsi""")
def _(d):
    return R.static_attributes(R.clean_placeholders(d.reports))


FIRST_SQL = ", ".join(
    f"(SELECT {c} FROM ranked r WHERE r.mmsi = k.mmsi AND {c} IS NOT NULL ORDER BY t, {c} LIMIT 1) AS {c}"
    for c in R.FIRST_COLUMNS
)


@register("first_attributes", S.ctes("tracks", "reports", "cleaned") + f"""
    , ranked AS (SELECT * FROM cleaned)
    SELECT mmsi, {FIRST_SQL} FROM (SELECT DISTINCT mmsi FROM cleaned) k""")
def _(d):
    return R.first_attributes(R.clean_placeholders(d.reports))


@register("report_counts", S.ctes("tracks", "reports") + """
    SELECT mmsi, CAST(count(*) AS BIGINT) AS n_reports, count(DISTINCT t) AS n_times FROM reports GROUP BY mmsi""")
def _(d):
    return R.report_counts(d.reports)


@register("to_utm32", S.ctes("tracks", "reports") + f"""
    SELECT mmsi, t, lon, lat, round(east, 3) AS x, round(north, 3) AS y FROM ({S.utm32('reports')})""")
def _(d):
    return rounded(R.to_utm32(d.reports), 3, "x", "y").select("mmsi", "t", "lon", "lat", "x", "y")


@register("to_wgs84", S.ctes("tracks") + f"""
    SELECT geom_id, t, round(lon, 9) AS lon, round(lat, 9) AS lat
    FROM ({S.wgs84("(SELECT geom_id, t, 500000 + x * 500 AS e, 5600000 + y * 5000 AS n FROM tracks)")})""")
def _(d):
    metres = d.paths.select("geom_id", "t", (F.lit(500000.0) + F.col("x") * 500).alias("x"), (F.lit(5600000.0) + F.col("y") * 5000).alias("y"))
    return rounded(R.to_wgs84(metres), 9, "lon", "lat").select("geom_id", "t", "lon", "lat")


@register("speed_consistency", S.ctes("tracks", "reports", "cleaned", "inside", "dedup", "positions", "moves") + """
    SELECT mmsi, round(length, 3) AS length, round(gap, 6) AS gap_kmh FROM moves WHERE gap <= 1000""")
def _(d):
    ships = B.speed_consistency(cut_lineage(clean_positions(d.reports)), key=["mmsi"], max_gap=1000.0)
    return rounded(rounded(ships, 3, "length"), 6, "gap_kmh")


ASSEMBLED_SQL = """
    , kept AS (SELECT mmsi, t, x, y FROM (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py,
        lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM positions
        WINDOW w AS (PARTITION BY mmsi ORDER BY t)) WHERE """ + S.TURN + """),
    head AS (SELECT mmsi, t, heading FROM (SELECT *, lag(t) OVER w AS pt, lag(heading) OVER w AS px,
        lead(t) OVER w AS nt, lead(heading) OVER w AS nx FROM positions WHERE heading IS NOT NULL
        WINDOW w AS (PARTITION BY mmsi ORDER BY t)) WHERE """ + S.turn("heading") + """),
    trip AS (SELECT mmsi, count(*)::INTEGER AS n_trip, min(t) AS t_first, max(t) AS t_last,
        round(arg_max(x, t), 3) AS x_last FROM kept GROUP BY mmsi),
    headings AS (SELECT mmsi, count(*)::INTEGER AS n_heading, sum(heading) AS sum_heading FROM head GROUP BY mmsi),
    static AS (SELECT mmsi, min(name) AS name, min(ship_type) AS ship_type FROM positions GROUP BY mmsi)"""


def _flat_trips(trips: DataFrame) -> DataFrame:
    """One row per ship from all its slices."""
    own = trips.withColumns({n: own_items(F.col(n), F.col(f"joined.{n}")) for n in ("trip", "heading")})
    last = F.max(F.try_element_at("trip", F.lit(-1)))
    return own.groupBy("mmsi").agg(
        F.sum(F.size("trip")).cast("int").alias("n_trip"),
        F.min(F.try_element_at("trip", F.lit(1)))["t"].alias("t_first"),
        last["t"].alias("t_last"),
        round_to(last["x"], 3).alias("x_last"),
        F.sum(F.size("heading")).cast("int").alias("n_heading"),
        F.sum(F.aggregate("heading", F.lit(0.0), lambda acc, p: acc + p["v"])).alias("sum_heading"),
        F.min("name").alias("name"),
        F.min("ship_type").alias("ship_type"),
    )


@register("assemble_trips", S.ctes("tracks", "reports", "cleaned", "inside", "dedup", "positions") + ASSEMBLED_SQL + """
    SELECT mmsi, n_trip, t_first, t_last, x_last, coalesce(n_heading, 0) AS n_heading,
        coalesce(sum_heading, 0) AS sum_heading, name, ship_type
    FROM trip LEFT JOIN headings USING (mmsi) JOIN static USING (mmsi)""")
def _(d):
    return _flat_trips(R.assemble_trips(cut_lineage(clean_positions(d.reports))))


BELT = envelope(700000.0, 6050000.0, 900000.0, 6100000.0)


@register("ais_day", S.ctes("tracks", "reports", "cleaned", "inside", "dedup", "positions", "moves") + ASSEMBLED_SQL + f"""
    , belt AS (SELECT mmsi FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM positions
        WINDOW w AS (PARTITION BY mmsi ORDER BY t)) GROUP BY mmsi
        HAVING bool_or({S.hit('700000', '6050000', '900000', '6100000')}))
    SELECT mmsi, n_trip, t_first, t_last, x_last, coalesce(n_heading, 0) AS n_heading,
        coalesce(sum_heading, 0) AS sum_heading, name, ship_type
    FROM trip LEFT JOIN headings USING (mmsi) JOIN static USING (mmsi) JOIN belt USING (mmsi)
    JOIN moves USING (mmsi) WHERE length > 0 AND length < 100000000 AND gap <= 100""")
def _(d):
    day = ais_day(d.reports, BELT, max_length=1e8)
    return _flat_trips(day.trips)


@register("ship_documents", S.ctes("tracks", "reports", "cleaned", "inside", "dedup", "positions") + ASSEMBLED_SQL + """
    SELECT mmsi, n_trip, coalesce(n_heading, 0) AS n_heading, name FROM trip
    LEFT JOIN headings USING (mmsi) JOIN static USING (mmsi)""")
def _(d):
    docs = export.ship_documents(R.assemble_trips(cut_lineage(clean_positions(d.reports))))
    size = lambda path: F.size(F.from_json(F.get_json_object("document", path), "array<string>"))
    own = lambda path, name: F.sum(F.coalesce(size(path), F.lit(0)) - F.col(f"joined.{name}").cast("int")).cast("int")
    return docs.groupBy("mmsi").agg(
        own("$.trajectory.coordinates", "trip").alias("n_trip"),
        own("$.heading.values", "heading").alias("n_heading"),
        F.min(F.get_json_object("document", "$.properties.Name")).alias("name"),
    )


@register("profile_trips", S.ctes("tracks", "reports") + S.dedup("reports", "once") + f"""
    , clean AS (SELECT * FROM once WHERE mmsi <> 0 AND lat BETWEEN 40.18 AND 84.73 AND lon BETWEEN -16.1 AND 32.88
        AND sog BETWEEN 0 AND 1022 AND cog IS NOT NULL AND heading IS NOT NULL
        AND destination IS DISTINCT FROM 'Undefined'),
    kept AS (SELECT mmsi, t, x, y FROM (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py,
        lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny
        FROM (SELECT mmsi, t, lon AS x, lat AS y FROM clean) WINDOW w AS (PARTITION BY mmsi ORDER BY t)) WHERE {S.TURN})
    SELECT mmsi, count(*)::INTEGER AS n_trip, max(t) AS t_last, first_destination FROM kept
    LEFT JOIN (SELECT mmsi, arg_min(destination, t) AS first_destination FROM clean
        WHERE destination IS NOT NULL GROUP BY mmsi) USING (mmsi)
    GROUP BY mmsi, first_destination""")
def _(d):
    return profile_trips(d.reports).groupBy("mmsi").agg(
        F.sum(F.size("trip") - F.col("joined.trip").cast("int")).cast("int").alias("n_trip"),
        F.max(F.try_element_at("trip", F.lit(-1))["t"]).alias("t_last"),
        F.min("destination").alias("first_destination"),
    )


# Documents

INGESTED_SQL = S.ctes("tracks", "boxes")


@register("ingest_features", INGESTED_SQL + """
    SELECT CAST(geom_id AS VARCHAR) AS feature_id, 25832 AS srid, xmin, ymin, xmax, ymax, tmin, tmax
    FROM boxes WHERE geom_id % 10 <> 1""")
def _(d):
    parsed = documents.parsed_features(d.feature_documents)
    least, greatest = ("xmin", "ymin", "tmin"), ("xmax", "ymax", "tmax")
    rows = documents.feature_rows(parsed).groupBy("feature_id", "srid").agg(
        *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in greatest]
    )
    return rows.select("feature_id", "srid", "xmin", "ymin", "xmax", "ymax", "tmin", "tmax")


@register("ingest_rejects", S.ctes("tracks", "boxes") + """
    SELECT geom_id, 'Invalid ''type''' AS error FROM boxes WHERE geom_id % 10 = 1""")
def _(d):
    return documents.rejected_documents(d.feature_documents).select("geom_id", "error").distinct()


@register("decode_mfjson", S.ctes("tracks") + """
    SELECT CAST(geom_id AS VARCHAR) AS feature_id, t, x, y FROM tracks WHERE event_type <> 'error'""")
def _(d):
    parsed = documents.parsed_features(d.feature_documents)
    return documents.feature_instants(parsed).select("feature_id", "t", "x", "y")


@register("encode_mfjson", S.ctes("tracks") + """
    SELECT geom_id, 'Linear' AS interpolation, t, x, y FROM tracks""")
def _(d):
    return documents.decode_mfjson(export.encode_mfjson(d.paths))


@register("inline_properties", S.ctes("tracks") + """
    SELECT CAST(geom_id AS VARCHAR) AS feature_id, 'pace' AS property_name, 'Measure' AS property_type,
        'Step' AS interpolation, t, x AS value FROM tracks WHERE event_type <> 'error'""")
def _(d):
    rows = documents.inline_properties(documents.parsed_features(d.feature_documents))
    pairs = rows.select(
        "feature_id", "property_name", "property_type", "interpolation",
        F.inline(F.arrays_zip(F.col("datetimes").alias("t"), F.col("values").alias("value"))),
    )
    return pairs.withColumn("value", F.col("value").try_cast("double"))


@register("unpack_instants", S.ctes("tracks") + "SELECT geom_id, t, x, y FROM tracks")
def _(d):
    return T.unpack_instants(T.pack_instants(d.paths))


@register("slug_id", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS id FROM part")
def _(d):
    return d.table("part").select("p_partkey", slug(F.col("p_name")).alias("id"))


@register("srid_extract", f"""
    SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(CASE WHEN p_size > 25 THEN p_type
        ELSE p_type || p_brand || '::' || p_partkey END, '(\\d+)', 1), '') AS INTEGER), {DEFAULT_SRID}) AS srid FROM part""")
def _(d):
    text = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(
        F.concat("p_type", "p_brand", F.lit("::"), F.col("p_partkey").cast("string"))
    )
    return d.table("part").select("p_partkey", srid_of(text).alias("srid"))


@register("parse_times", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS t FROM orders")
def _(d):
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    iso = F.replace(stamp, F.lit(" "), F.lit("T"))
    rank = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("on "), stamp))
        .when(rank == "1", F.concat(iso, F.lit("Z")))
        .when(rank == "2", F.concat(stamp, F.lit("+00")))
        .when(rank == "3", iso)
        .otherwise(stamp)
    )
    return d.table("orders").select("o_orderkey", parse_time(text).alias("t"))


# Features and joins


@register("features_with_geometry", S.ctes("tracks", "features", "boxes") + """
    SELECT f.feature_id, collection_id, name, geom_id, xmin, tmax FROM features f
    LEFT JOIN boxes b ON b.geom_id // 10 = f.feature_id""")
def _(d):
    return X.features_with_geometry(d.features, d.geometries).select(
        "feature_id", "collection_id", "name", "geom_id", "xmin", "tmax"
    )


@register("geometry_in_collection", S.ctes("tracks", "features", "boxes") + """
    SELECT geom_id, feature_id, collection_id FROM boxes JOIN features ON geom_id // 10 = feature_id
    WHERE collection_id IN (SELECT replace(lower(n_name), ' ', '_') FROM nation JOIN region
        ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def _(d):
    asia = d.collections.filter(F.col("description") == "ASIA")
    return X.geometry_in_collection(d.geometries, d.features, asia).select("geom_id", "feature_id", "collection_id")


CHECKED_SQL = S.ctes("tracks", "features", "requests") + """
    , judged AS (SELECT request_id, collection_id, feature_id, geom_id, CASE
        WHEN NOT EXISTS (SELECT 1 FROM nation WHERE replace(lower(n_name), ' ', '_') = r.collection_id) THEN 'collection'
        WHEN NOT EXISTS (SELECT 1 FROM features f WHERE f.feature_id = r.feature_id AND f.collection_id = r.collection_id) THEN 'feature'
        WHEN NOT EXISTS (SELECT 1 FROM tracks t WHERE t.geom_id = r.geom_id) THEN 'geometry' END AS missing FROM requests r)"""


@register("requests_valid", CHECKED_SQL + "SELECT request_id, collection_id, feature_id, geom_id FROM judged WHERE missing IS NULL")
def _(d):
    valid = X.requests_valid(d.requests, d.collections, d.features, d.geometries)
    return valid.select("request_id", "collection_id", "feature_id", "geom_id")


@register("requests_missing", CHECKED_SQL + "SELECT request_id, feature_id, missing FROM judged WHERE missing IS NOT NULL")
def _(d):
    lost = X.requests_missing(d.requests, d.collections, d.features, d.geometries)
    return lost.select("request_id", "feature_id", "missing")


@register("features_nested", S.ctes("tracks", "features") + """
    SELECT f.feature_id, f.collection_id, count(DISTINCT geom_id)::INTEGER AS n_geometries,
        min(geom_id) AS first_geometry, max(geom_id) AS last_geometry
    FROM features f LEFT JOIN tracks USING (feature_id) GROUP BY f.feature_id, f.collection_id""")
def _(d):
    ids = F.transform("geometries", lambda g: g["geom_id"])
    return X.features_nested(d.features, d.geometries).groupBy("feature_id", "collection_id").agg(
        F.sum(F.size("geometries")).cast("int").alias("n_geometries"),
        F.min(F.try_element_at(ids, F.lit(1))).alias("first_geometry"),
        F.max(F.try_element_at(ids, F.lit(-1))).alias("last_geometry"),
    )


@register("feature_lookup", S.ctes("tracks", "features", "requests") + """
    SELECT f.feature_id, f.collection_id, geom_id, 'MovingPoint' AS geometry_type FROM features f
    LEFT JOIN (SELECT DISTINCT feature_id, geom_id FROM tracks) USING (feature_id)
    WHERE (f.feature_id, f.collection_id) IN (SELECT feature_id, collection_id FROM requests)
        AND geom_id IS NOT NULL""")
def _(d):
    found = X.lookup_features(d.requests, d.features, d.geometries)
    return found.select("feature_id", "collection_id", F.inline("geometries")).select(
        "feature_id", "collection_id", "geom_id", "geometry_type"
    )


@register("feature_paths", S.ctes("tracks", "features", "requests", "mixed") + """
    SELECT CAST(f.feature_id AS VARCHAR) AS id, f.collection_id, geom_id, kind AS interpolation, t, x, y FROM features f
    JOIN tracks USING (feature_id) JOIN kinds USING (geom_id)
    WHERE (f.feature_id, f.collection_id) IN (SELECT feature_id, collection_id FROM requests)
    UNION ALL
    SELECT CAST(feature_id AS VARCHAR), collection_id, NULL, NULL, NULL, NULL, NULL FROM features
    WHERE (feature_id, collection_id) IN (SELECT feature_id, collection_id FROM requests) AND feature_id NOT IN (SELECT feature_id FROM tracks)""")
def _(d):
    """Every instant of the documents of all requested features."""
    wanted = d.features.join(d.requests.select("collection_id", "feature_id"), ["collection_id", "feature_id"], "left_semi")
    boxes = T.extent(d.tracks, ["feature_id"])
    rich = wanted.join(boxes, "feature_id", "left").withColumns(
        {"properties": F.to_json(F.struct("name", "segment")), "crs": F.lit(None).cast("string"), "trs": F.lit(None).cast("string")}
    )
    docs = export.features_with_paths(rich, d.geometries, d.tracks)
    return flat_paths(docs.select("collection_id", "feature"))


def flat_paths(docs: DataFrame) -> DataFrame:
    """id, other columns, and the instants of all paths of ``feature`` documents; one row of NULLs without path."""
    others = [c for c in docs.columns if c != "feature"]
    each = docs.select(*others, F.col("feature.id").alias("id"), F.explode_outer("feature.temporalGeometry").alias("g"))
    shared = F.col("g.lower_inc").eqNullSafe(F.lit(False))
    times, places = (own_items(F.col(f"g.{n}"), shared) for n in ("datetimes", "coordinates"))
    pairs = F.arrays_zip(times.alias("d"), places.alias("c"))
    points = each.select("id", *others, F.col("g.id").alias("geom_id"), F.col("g.interpolation").alias("interpolation"), F.explode_outer(pairs).alias("p"))
    return points.select(
        "id", *others, "geom_id", "interpolation", parse_time(F.col("p.d")).alias("t"), F.col("p.c")[0].alias("x"), F.col("p.c")[1].alias("y")
    )


@register("feature_page", S.ctes("features") + """
    SELECT feature_id, collection_id, created_at FROM features ORDER BY created_at, feature_id LIMIT 50""")
def _(d):
    return X.feature_page(d.features, 50).select("feature_id", "collection_id", "created_at")


@register("feature_page_next", S.ctes("features") + """
    SELECT feature_id, collection_id, created_at FROM features
    WHERE (created_at, feature_id) > (TIMESTAMP '2024-01-01 00:49:00', 49) ORDER BY created_at, feature_id LIMIT 50""")
def _(d):
    return X.feature_page(d.features, 50, ("2024-01-01 00:49:00", 49)).select("feature_id", "collection_id", "created_at")


@register("page_counts", S.ctes("tracks", "features") + """
    SELECT count(DISTINCT f.feature_id) AS number_matched, count(*) AS joined_rows,
        least(count(DISTINCT f.feature_id), 10) AS number_returned
    FROM features f LEFT JOIN (SELECT DISTINCT feature_id, geom_id FROM tracks) USING (feature_id)""")
def _(d):
    return X.page_counts(d.features, d.geometries, 10)


@register("collection_list", """
    SELECT replace(lower(s_name), ' ', '_') AS id, s_name AS title, 'fleet of nation ' || s_nationkey AS description,
        'movingfeature' AS itemType, s_nationkey AS updateFrequency, CAST(NULL AS VARCHAR) AS extent FROM supplier""")
def _(d):
    return X.collection_list(d.fleets)


ITEMS_SQL = S.ctes("tracks", "features", "boxes", "seq", "mixed") + f"""
    , matched AS (SELECT geom_id, geom_id // 10 AS feature_id FROM boxes WHERE xmin <= 260 AND xmax >= 200
        AND ymin <= 60 AND ymax >= 40 AND tmin <= TIMESTAMP '{END}' AND tmax >= TIMESTAMP '{START}'),
    page AS (SELECT feature_id, collection_id FROM features WHERE feature_id IN (SELECT feature_id FROM matched))"""


#: Paths of the page cut to the interval and normalised, each by its own interpolation.
CUT_SQL = f"""
    , cut AS (
        SELECT geom_id, kind, t, x, y FROM seq JOIN kinds USING (geom_id) WHERE t BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
        UNION
        SELECT geom_id, kind, b, CASE kind WHEN 'Step' THEN x ELSE x + (nx - x) * s END, CASE kind WHEN 'Step' THEN y ELSE y + (ny - y) * s END
        FROM (SELECT *, ((epoch_us(b) - epoch_us(t)) / 1e6) / ((epoch_us(nt) - epoch_us(t)) / 1e6) AS s
              FROM seq JOIN kinds USING (geom_id), (VALUES (TIMESTAMP '{START}'), (TIMESTAMP '{END}')) v(b) WHERE t < b AND nt > b AND kind <> 'Discrete')),
    kept AS (SELECT *, lag(x) OVER w AS bef_x, lag(y) OVER w AS bef_y FROM (
        SELECT * FROM (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py,
            lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM cut WINDOW w AS (PARTITION BY geom_id ORDER BY t))
        WHERE CASE kind WHEN 'Discrete' THEN true WHEN 'Step' THEN pt IS NULL OR nt IS NULL OR px <> x OR py <> y ELSE {S.TURN} END)
        WINDOW w AS (PARTITION BY geom_id ORDER BY t))"""


@register("items", ITEMS_SQL + CUT_SQL + """
    SELECT feature_id, geom_id, any_value(kind) AS interpolation, count(*)::INTEGER AS n_instants, min(t) AS t_first, max(t) AS t_last,
        round(sum(x), 4) AS sum_x, CASE WHEN count(*) FILTER (bef_x IS NULL OR bef_x <> x OR bef_y <> y) = 1 THEN 'Point'
            WHEN any_value(kind) = 'Linear' THEN 'LineString' ELSE 'MultiPoint' END AS shape_type
    FROM page JOIN matched USING (feature_id) JOIN kept USING (geom_id) GROUP BY feature_id, geom_id""")
def _(d):
    query = V.item_query(None, "260,60,200,40", f"{START}/{END}", sub_trajectory=True)
    joined = F.col("joined.instants")
    times, places = (own_items(F.col(f"sequence.{n}"), joined) for n in ("datetimes", "coordinates"))
    entries = items(d.features, d.geometries, d.tracks, query).geometries
    sliced = entries.select(
        "feature_id", "geom_id", F.col("sequence.interpolation").alias("interpolation"), times.alias("times"), places.alias("places"),
        F.get_json_object("geometry", "$.type").alias("drawn"),
        F.size(F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<string>")).alias("corners"), "joined",
    )
    whole = sliced.groupBy("feature_id", "geom_id", "interpolation").agg(
        F.sum(F.size("times")).cast("int").alias("n_instants"),
        parse_time(F.min(F.try_element_at("times", F.lit(1)))).alias("t_first"),
        parse_time(F.max(F.try_element_at("times", F.lit(-1)))).alias("t_last"),
        round_to(F.sum(F.aggregate("places", F.lit(0.0), lambda acc, p: acc + p[0])), 4).alias("sum_x"),
        F.sum(F.when(F.col("drawn") == "Point", 1).otherwise(F.coalesce("corners", F.lit(0)) - F.col("joined.vertices").cast("int"))).alias("corners"),
    )
    return whole.select(
        "feature_id", "geom_id", "interpolation", "n_instants", "t_first", "t_last", "sum_x",
        whole_type(F.col("corners"), F.col("interpolation")).alias("shape_type"),
    )


@register("items_leaf", ITEMS_SQL + """
    SELECT feature_id, geom_id, max(t) AS t_last, 'Discrete' AS interpolation
    FROM page JOIN matched USING (feature_id) JOIN seq USING (geom_id) GROUP BY feature_id, geom_id""")
def _(d):
    query = V.item_query(None, "200,40,260,60", f"{START}/{END}", leaf=True)
    leaves = items(d.features, d.geometries, d.tracks, query).geometries.filter("n_instants > 0")
    return leaves.select(
        "feature_id", "geom_id",
        parse_time(F.try_element_at("sequence.datetimes", F.lit(1))).alias("t_last"),
        F.col("sequence.interpolation").alias("interpolation"),
    )


PAGE = 40


@register("items_document", ITEMS_SQL + CUT_SQL + f"""
    , shown AS (SELECT * FROM features JOIN (SELECT feature_id FROM page) USING (feature_id) ORDER BY created_at, feature_id LIMIT {PAGE})
    SELECT CAST(feature_id AS VARCHAR) AS id, geom_id, kind AS interpolation, t, round(x, 6) AS x, round(y, 6) AS y,
        (SELECT count(*) FROM page) AS number_matched, least((SELECT count(*) FROM page), {PAGE}) AS number_returned,
        CASE WHEN (SELECT count(*) FROM page) > {PAGE} THEN 2 ELSE 1 END AS n_links, TIMESTAMP '{NOW}' AS made_at
    FROM shown LEFT JOIN (SELECT * FROM matched JOIN kept USING (geom_id)) USING (feature_id)""")
def _(d):
    """Every instant of the page, read back from the lines of its document."""
    query = V.item_query(PAGE, "260,60,200,40", f"{START}/{END}", sub_trajectory=True)
    page = items(d.features, d.geometries, d.tracks, query)
    lines = items_document(page, now(), "/collections/all/items", PAGE)
    kind = F.col("place.kind")
    entry = "struct<id:bigint,datetimes:array<string>,coordinates:array<array<double>>,interpolation:string,lower_inc:boolean>"
    feature = F.from_json(F.ltrim("line", F.lit(",")), f"id string, geometry array<string>, temporalGeometry array<{entry}>")
    docs = lines.filter(kind == 1).select(feature.alias("feature"))
    tail = F.from_json(F.concat(F.lit("{"), F.substring("line", 3, 1_000_000)), "timeStamp string, numberMatched bigint, numberReturned bigint, links array<string>")
    end = lines.filter(kind == 2).select(tail.alias("t"))
    rows = rounded(flat_paths(docs), 6, "x", "y").withColumn("t_", end.scalar())
    return rows.select(
        *[c for c in rows.columns if c != "t_"], F.col("t_.numberMatched").alias("number_matched"),
        F.col("t_.numberReturned").alias("number_returned"), F.size("t_.links").alias("n_links"), parse_time(F.col("t_.timeStamp")).alias("made_at"),
    )


@register("port_traffic", S.ctes("tracks", "seq", "norm", "speed", "boxes") + f"""
    , near AS (SELECT geom_id FROM boxes WHERE xmin <= 260 AND xmax >= 200 AND ymin <= 60 AND ymax >= 40),
    entry AS (SELECT geom_id, bool_or({S.hit('200', '40', '260', '60')}) AS entered FROM seq GROUP BY geom_id),
    fast AS (SELECT geom_id, max(speed) AS max_speed, bool_or(speed > {SPEED_LIMIT}) AS violates,
        count(*) FILTER (speed = 0) AS n_stopped FROM speed GROUP BY geom_id),
    cut AS (SELECT geom_id, count(*) AS n_cut FROM (
        SELECT geom_id, t FROM seq WHERE t BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
        UNION SELECT geom_id, b FROM seq, (VALUES (TIMESTAMP '{START}'), (TIMESTAMP '{END}')) v(b) WHERE t < b AND nt > b)
        GROUP BY geom_id)
    SELECT geom_id, entered, coalesce(violates, false) AS violates, coalesce(n_stopped, 0) AS n_stopped,
        coalesce(n_cut, 0) AS n_cut, max_speed
    FROM near JOIN entry USING (geom_id) LEFT JOIN fast USING (geom_id) LEFT JOIN cut USING (geom_id)""")
def _(d):
    return port_traffic(d.paths, BOX, START, END, SPEED_LIMIT)


# Exports, flattened


@register("export_feature", S.ctes("tracks", "features") + """
    SELECT CAST(f.feature_id AS VARCHAR) AS id, '/collections/' || f.collection_id || '/items/' || f.feature_id AS self,
        min(x) AS xmin, max(t) AS tmax, count(DISTINCT geom_id)::INTEGER AS n_geometries
    FROM features f LEFT JOIN tracks USING (feature_id) GROUP BY f.feature_id, f.collection_id""")
def _(d):
    boxes = T.extent(d.tracks, ["feature_id"])
    rich = X.features_nested(d.features, d.geometries).join(boxes, "feature_id", "left").withColumns(
        {"properties": F.to_json(F.struct("name", "segment")), "crs": F.lit(None).cast("string"), "trs": F.lit(None).cast("string")}
    )
    doc = F.col("feature")
    return export.export_features(rich).groupBy(doc["id"].alias("id"), F.try_element_at(doc["links"], F.lit(1))["href"].alias("self")).agg(
        F.min(F.try_element_at(doc["bbox"], F.lit(1))).alias("xmin"),
        F.max(parse_time(F.try_element_at(doc["time"], F.lit(2)))).alias("tmax"),
        F.sum(F.size(doc["temporalGeometry"])).cast("int").alias("n_geometries"),
    )


@register("export_feature_collection", S.ctes("features") + """
    , page AS (SELECT feature_id, row_number() OVER (ORDER BY created_at, feature_id) AS rn FROM features)
    SELECT 'FeatureCollection' AS type, (SELECT count(*) FROM features) AS number_matched,
        least((SELECT count(*) FROM features), 100) AS number_returned, CAST(rn - 1 AS INTEGER) AS position,
        CAST(feature_id AS VARCHAR) AS id,
        CASE WHEN (SELECT count(*) FROM features) > 100 THEN 2 ELSE 1 END AS n_links FROM page WHERE rn <= 100""")
def _(d):
    flat = {"properties": F.lit(None).cast("string"), "crs": F.lit(None).cast("string"), "trs": F.lit(None).cast("string")}
    page = X.feature_page(d.features, 100)
    boxes = T.extent(d.tracks, ["feature_id"])
    rich = page.join(boxes, "feature_id", "left").withColumns(flat)
    body = rich.select(F.struct("created_at", "feature_id").alias("ord"), export.feature_document().alias("feature"))
    doc = export.export_feature_collection(
        body, X.page_counts(d.features, d.geometries, 100), now(), path="/collections/all/items", limit=100
    )
    return doc.select(
        "type", F.col("numberMatched").alias("number_matched"), F.col("numberReturned").alias("number_returned"),
        F.size("links").alias("n_links"), F.posexplode("features").alias("position", "_f"),
    ).select("type", "number_matched", "number_returned", "position", F.col("_f.id").alias("id"), "n_links")


@register("geometry_sequence", S.ctes("tracks", "mixed") + """
    SELECT feature_id, geom_id, any_value(kind) AS interpolation, 'MovingPoint' AS type, count(*)::INTEGER AS n_instants,
        min(t) AS t_first, arg_max(x, t) AS x_last
    FROM tracks JOIN kinds USING (geom_id) GROUP BY feature_id, geom_id""")
def _(d):
    doc = F.col("geometry")
    times, places = (own_items(doc[n], F.col("joined")) for n in ("datetimes", "coordinates"))
    last = F.max(F.struct("part", F.try_element_at(places, F.lit(-1)).alias("p")))["p"]
    return export.geometry_sequence(d.tracks, d.geometries).groupBy(
        "feature_id", "geom_id", doc["interpolation"].alias("interpolation"), doc["type"].alias("type")
    ).agg(
        F.sum(F.size(places)).cast("int").alias("n_instants"),
        parse_time(F.min(F.try_element_at(times, F.lit(1)))).alias("t_first"), last[0].alias("x_last"),
    )


@register("curve_document", S.ctes("tracks", "norm", "speed") + """
    SELECT geom_id, 'm/s' AS unit, 'velocity' AS query_type, t, speed AS value FROM speed""")
def _(d):
    docs = export.curve_document(T.velocity_curve(d.paths), "speed", "m/s", "velocity")
    rows = docs.select("geom_id", F.col("curve.unit").alias("unit"), F.col("curve.queryType").alias("query_type"), F.inline("curve.values"))
    return rows.select("geom_id", "unit", "query_type", parse_time(F.col("time")).alias("t"), "value")


# Properties


@register("property_list", S.ctes("tracks") + """
    SELECT feature_id, event_type AS name, 'TReal' AS type, 'KMH' AS form, 'value of ' || event_type AS description,
        CAST(row_number() OVER (PARTITION BY feature_id ORDER BY event_type) - 1 AS INTEGER) AS position
    FROM (SELECT DISTINCT feature_id, event_type FROM tracks)""")
def _(d):
    listed = P.property_list(d.properties)
    flat = listed.select("feature_id", "first_item", F.posexplode("properties").alias("position", "p"))
    return flat.select("feature_id", "p.*", (F.col("position") + F.col("first_item")).alias("position"))


@register("property_values", S.ctes("tracks", "batches") + """
    SELECT property_id // 10 AS feature_id, property_id, value_id, n_values,
        CAST(row_number() OVER (PARTITION BY property_id ORDER BY first_time) - 1 AS INTEGER) AS position, first_time
    FROM batches""")
def _(d):
    nested = P.property_values(d.properties, d.value_batches)
    flat = nested.select("feature_id", "property_id", "first_item", F.posexplode("batches").alias("position", "b"))
    return flat.select(
        "feature_id", "property_id", F.col("b.id").alias("value_id"), F.size("b.values").alias("n_values"),
        (F.col("position") + F.col("first_item")).alias("position"), "b.first_time",
    )


@register("property_batches", S.ctes("tracks", "batches") + """
    SELECT c_custkey * 10 AS property_id, value_id, first_time FROM customer
    LEFT JOIN batches ON property_id = c_custkey * 10""")
def _(d):
    posted = d.table("customer").select((F.col("c_custkey") * 10).alias("property_id"))
    return P.property_batches(posted, d.value_batches).select("property_id", "value_id", "first_time")


@register("property_readings", S.ctes("tracks") + """
    SELECT feature_id, event_type AS property_name, t, x AS as_real FROM tracks""")
def _(d):
    return P.property_readings(d.properties, d.value_batches).select("feature_id", "property_name", "t", "as_real")


@register("last_value_time", S.ctes("tracks") + "SELECT geom_id AS property_id, max(t) AS last_time FROM tracks GROUP BY geom_id")
def _(d):
    return P.last_value_time(d.value_batches)


@register("continuity_check", S.ctes("tracks", "batches") + """
    , last AS (SELECT geom_id AS property_id, max(t) AS last_time FROM tracks GROUP BY geom_id)
    SELECT -1 - value_id AS value_id, property_id, last_time, last_time < first_time + INTERVAL 15 DAY AS continuous
    FROM batches JOIN last USING (property_id)""")
def _(d):
    return P.continuity_check(d.posted_batches, d.value_batches).select("value_id", "property_id", "last_time", "continuous")


POSTED_SQL = S.ctes("tracks", "requests") + """
    , posted AS (SELECT feature_id, property_name, min(priority) AS form FROM requests GROUP BY feature_id, property_name),
    have AS (SELECT DISTINCT feature_id, event_type AS property_name FROM tracks)"""


def _posted_properties(d: DriverTables) -> DataFrame:
    return d.requests.select(
        F.col("geom_id").alias("property_id"), "feature_id", "property_name",
        F.lit("TReal").alias("property_type"), F.col("priority").alias("form"),
        F.lit("posted").alias("description"),
    )


@register("property_conflicts", POSTED_SQL + """
    SELECT request_id, feature_id, property_name FROM requests
    WHERE (feature_id, property_name) IN (SELECT feature_id, property_name FROM have)""")
def _(d):
    return P.property_conflicts(d.requests, d.properties).select("request_id", "feature_id", "property_name")


# Validation


@register("validate_collections", """
    SELECT s_suppkey AS doc_id, CASE WHEN s_acctbal < 0 THEN 'Missing required field: title' END AS title_error,
        CASE WHEN s_nationkey = 3 THEN 'itemType must be ''movingfeature''' END AS type_error,
        CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal < 2000 THEN 'nation_' || s_nationkey
            ELSE replace(lower(s_name), ' ', '_') END AS id,
        CASE WHEN s_nationkey = 3 THEN 'feature' ELSE 'movingfeature' END AS itemType FROM supplier""")
def _(d):
    checked = V.validate_collections(d.collection_documents)
    named = lambda word: F.try_element_at(F.filter("errors", lambda e: e.startswith(word)), F.lit(1))
    return checked.select("doc_id", named("Missing").alias("title_error"), named("itemType").alias("type_error"), "id", "itemType")


@register("validate_properties", """
    SELECT p_partkey, concat_ws('; ', CASE WHEN p_size < 5 THEN 'Missing required field: name' END,
        CASE WHEN p_type = 'ECONOMY' THEN 'Missing required field: type' END,
        CASE WHEN p_type NOT IN ('ECONOMY', 'PROMO') THEN 'Invalid property type' END) AS errors FROM part""")
def _(d):
    docs = d.table("part").select(
        "p_partkey",
        F.when(F.col("p_size") >= 5, F.col("p_name")).alias("name"),
        F.when(F.col("p_type") == "PROMO", F.lit("TReal")).when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("type"),
    )
    return V.validate_properties(docs).select("p_partkey", F.concat_ws("; ", "errors").alias("errors"))


@register("validate_values", S.ctes("tracks", "batches") + """
    SELECT -1 - value_id AS value_id, CASE WHEN property_id % 10 = 1
        THEN 'datetimes and values must have the same length' ELSE '' END AS errors FROM batches""")
def _(d):
    return V.validate_values(d.posted_batches).select("value_id", F.concat_ws("; ", "errors").alias("errors"))


# Table changes


@register("insert_features", S.ctes("tracks", "features") + """
    SELECT feature_id, collection_id FROM features
    UNION ALL
    SELECT feature_id, 'orders_' || min(status) FROM (SELECT o_custkey * 2 AS feature_id, o_orderstatus AS status FROM orders)
    WHERE feature_id NOT IN (SELECT feature_id FROM features) GROUP BY feature_id""")
def _(d):
    posted = d.table("orders").select(
        (F.col("o_custkey") * 2).alias("feature_id"), F.concat(F.lit("orders_"), "o_orderstatus").alias("collection_id")
    )
    return M.insert_new(d.features, posted, ["feature_id"]).select("feature_id", "collection_id")


@register("insert_collections", """
    SELECT replace(lower(n_name), ' ', '_') AS id, n_name AS title FROM nation
    UNION ALL
    SELECT replace(lower(s_name), ' ', '_'), s_name FROM supplier WHERE s_acctbal >= 2000 AND s_nationkey <> 3""")
def _(d):
    docs = V.accepted(V.validate_collections(d.collection_documents)).select("id", "title", "description")
    return M.insert_new(d.collections, docs, ["id"]).select("id", "title")


@register("update_collections", """
    SELECT replace(lower(n_name), ' ', '_') AS id, coalesce(t, n_name) AS title,
        CASE WHEN coalesce(b, false) THEN NULL ELSE r_name END AS description, n_nationkey AS update_frequency,
        CASE WHEN s_nationkey IS NULL THEN NULL ELSE TIMESTAMP '2024-06-01 00:00:00' END AS updated_at
    FROM nation JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT s_nationkey, max(s_name) AS t, bool_or(s_acctbal < 0) AS b FROM supplier GROUP BY s_nationkey)
        ON s_nationkey = n_nationkey""")
def _(d):
    patches = d.table("supplier").groupBy(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("id")).agg(
        F.max("s_name").alias("title"), F.lit(True).alias("has_title"),
        F.lit(None).cast("string").alias("description"), F.bool_or(F.col("s_acctbal") < 0).alias("has_description"),
        F.lit(None).cast("string").alias("item_type"), F.lit(False).alias("has_item_type"),
    )
    new = M.update_collections(d.collections, patches, now())
    return new.select("id", "title", "description", "update_frequency", "updated_at")


@register("insert_refused", S.ctes("features") + """
    , posted AS (SELECT o_custkey * 2 AS feature_id, 'orders_' || o_orderstatus AS collection_id FROM orders),
    judged AS (SELECT *, CASE WHEN feature_id IN (SELECT feature_id FROM features) THEN 'already exists'
        WHEN row_number() OVER (PARTITION BY feature_id ORDER BY collection_id) > 1 THEN 'given more than once' ELSE 'taken' END AS outcome FROM posted)
    SELECT feature_id, collection_id, outcome, count(*) AS n FROM judged GROUP BY feature_id, collection_id, outcome""")
def _(d):
    posted = d.table("orders").select(
        (F.col("o_custkey") * 2).alias("feature_id"), F.concat(F.lit("orders_"), "o_orderstatus").alias("collection_id")
    )
    return _told(M.outcomes(posted, ["feature_id"], known=d.features), "feature_id", "collection_id")


def _told(judged: DataFrame, *shown: str) -> DataFrame:
    """Rows with each outcome, counted: all of them together are the input."""
    return judged.groupBy(*shown, F.coalesce("refused", F.lit("taken")).alias("outcome")).agg(F.count("*").alias("n"))


@register("update_refused", """
    WITH posted AS (SELECT 'nation_' || (s_nationkey + 5) AS id, s_name AS title, CASE WHEN s_acctbal < 0 THEN 'feature' END AS item_type FROM supplier),
    judged AS (SELECT *, CASE WHEN item_type IS NOT NULL THEN 'itemType must be ''movingfeature'''
        WHEN id NOT IN (SELECT replace(lower(n_name), ' ', '_') FROM nation) THEN 'collection does not exist'
        WHEN row_number() OVER (PARTITION BY id, item_type IS NULL ORDER BY title) > 1 THEN 'given more than once' ELSE 'taken' END AS outcome FROM posted)
    SELECT id, outcome, count(*) AS n FROM judged GROUP BY id, outcome""")
def _(d):
    patches = d.table("supplier").select(
        F.concat(F.lit("nation_"), (F.col("s_nationkey") + 5).cast("string")).alias("id"), F.col("s_name").alias("title"),
        F.when(F.col("s_acctbal") < 0, F.lit("feature")).alias("item_type"),
    )
    return _told(M.judge_patches(d.collections, patches), "id")


@register("append_refused", S.ctes("tracks", "requests") + """
    , have AS (SELECT DISTINCT feature_id, event_type AS property_name FROM tracks),
    posted AS (SELECT feature_id + CASE WHEN request_id % 7 = 0 THEN 100000000 ELSE 0 END AS feature_id, property_name,
        CASE WHEN request_id % 5 = 0 THEN 'Speed' ELSE 'TReal' END AS property_type, priority AS form FROM requests),
    judged AS (SELECT *, CASE WHEN property_type = 'Speed' THEN 'Invalid property type'
        WHEN feature_id NOT IN (SELECT c_custkey FROM customer) THEN 'feature does not exist'
        WHEN (feature_id, property_name) IN (SELECT feature_id, property_name FROM have) THEN 'property exists'
        WHEN row_number() OVER (PARTITION BY feature_id, property_name, property_type ORDER BY form) > 1 THEN 'given more than once' ELSE 'taken' END AS outcome FROM posted)
    SELECT feature_id, property_name, outcome, count(*) AS n FROM judged GROUP BY feature_id, property_name, outcome""")
def _(d):
    request = F.col("request_id")
    posted = d.requests.select(
        (F.col("feature_id") + F.when(request % 7 == 0, 100_000_000).otherwise(0)).alias("feature_id"), "property_name",
        F.when(request % 5 == 0, F.lit("Speed")).otherwise(F.lit("TReal")).alias("property_type"), F.col("priority").alias("form"),
    )
    return _told(M.judge_properties(d.properties, posted, d.features), "feature_id", "property_name")


def _tables(d: DriverTables) -> dict[str, DataFrame]:
    return {
        "collections": d.collections, "features": d.features, "geometries": d.geometries,
        "properties": d.properties, "temporal_values": d.value_batches,
    }


def _inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, id`` of all rows."""
    ids = {"collections": "id", "features": "feature_id", "geometries": "geom_id",
           "properties": "property_id", "temporal_values": "value_id"}
    out = None
    for name, column in ids.items():
        rows = tables[name].select(F.lit(name).alias("table_name"), F.col(column).cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _remaining(gone_features: str, gone_properties: str = "SELECT NULL AS property_id WHERE false") -> str:
    """SQL twin of ``_inventory`` after a cascade; collections are added by the caller."""
    return f"""
    , gone AS ({gone_features}), lost AS ({gone_properties}),
    ids AS (SELECT 'features' AS table_name, feature_id, NULL AS property_id, feature_id AS id FROM features
        UNION ALL SELECT DISTINCT 'geometries', feature_id, NULL, geom_id FROM tracks
        UNION ALL SELECT DISTINCT 'properties', feature_id, geom_id, geom_id FROM tracks
        UNION ALL SELECT 'temporal_values', property_id // 10, property_id, value_id FROM batches),
    rest AS (SELECT table_name, CAST(id AS VARCHAR) AS id FROM ids i
        WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.feature_id = i.feature_id)
        AND NOT EXISTS (SELECT 1 FROM lost WHERE lost.property_id = i.property_id))
    SELECT table_name, id FROM rest"""


ALL_COLLECTIONS_SQL = " UNION ALL SELECT 'collections', replace(lower(n_name), ' ', '_') FROM nation"


@register("delete_collection_cascade", S.ctes("tracks", "features", "batches") + _remaining("""
    SELECT feature_id FROM features WHERE collection_id IN (SELECT replace(lower(n_name), ' ', '_')
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""") + """
    UNION ALL SELECT 'collections', replace(lower(n_name), ' ', '_') FROM nation JOIN region
        ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'""")
def _(d):
    asia = d.collections.filter(F.col("description") == "ASIA")
    return _inventory(M.delete_collections(_tables(d), asia))


@register("delete_feature_cascade", S.ctes("tracks", "features", "requests", "batches") + _remaining("""
    SELECT f.feature_id FROM features f JOIN requests r
        ON r.feature_id = f.feature_id AND r.collection_id = f.collection_id WHERE r.priority = '1-URGENT'""") + ALL_COLLECTIONS_SQL)
def _(d):
    urgent = d.requests.filter(F.col("priority") == "1-URGENT")
    return _inventory(M.delete_features(_tables(d), urgent.select("feature_id", "collection_id")))


@register("delete_property_cascade", S.ctes("tracks", "features", "requests", "batches") + _remaining(
    "SELECT NULL AS feature_id WHERE false",
    "SELECT geom_id AS property_id FROM requests WHERE status = 'F'") + ALL_COLLECTIONS_SQL)
def _(d):
    gone = d.requests.filter(F.col("status") == "F").select("feature_id", "property_name")
    return _inventory(M.delete_properties(_tables(d), gone))


@register("delete_geometry", S.ctes("tracks", "features", "requests", "boxes") + """
    SELECT geom_id, n_instants FROM boxes WHERE geom_id NOT IN (SELECT r.geom_id FROM requests r JOIN features f
        ON f.feature_id = r.feature_id AND f.collection_id = r.collection_id)""")
def _(d):
    return M.delete_geometries(_tables(d), d.requests)["geometries"].select("geom_id", "n_instants")


@register("delete_value", S.ctes("tracks", "requests", "batches") + """
    SELECT value_id, property_id, n_values FROM batches
    WHERE (property_id, day) NOT IN (SELECT geom_id, day FROM requests)""")
def _(d):
    days = d.requests.select(F.col("geom_id").alias("property_id"), "day")
    gone = d.value_batches.join(days, ["property_id", "day"], "left_semi")
    kept = M.delete_values(d.value_batches, gone)
    return kept.select("value_id", "property_id", F.size("values").alias("n_values"))


@register("append_geometry", S.ctes("tracks", "features", "requests", "boxes") + """
    SELECT geom_id, xmin, ymax, tmax, n_instants FROM boxes
    UNION ALL
    SELECT l_orderkey + 100000000, min(l_quantity), max(l_extendedprice / 1000),
        max(l_shipdate + l_linenumber * INTERVAL 1 SECOND), count(*) FROM lineitem
    WHERE l_orderkey IN (SELECT request_id FROM requests r JOIN features f
        ON f.feature_id = r.feature_id AND f.collection_id = r.collection_id) GROUP BY l_orderkey""")
def _(d):
    located = d.geometries.join(d.features.select("feature_id", "collection_id"), "feature_id", "left")
    grown = M.append_geometries(located, d.order_paths, d.features)
    return grown.select("geom_id", "xmin", "ymax", "tmax", "n_instants")


@register("append_property", POSTED_SQL + """
    SELECT feature_id, property_name, 'KMH' AS form FROM have
    UNION ALL
    SELECT feature_id, property_name, form FROM posted p
    WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.feature_id = p.feature_id AND h.property_name = p.property_name)""")
def _(d):
    grown, _refused = M.append_properties(d.properties, _posted_properties(d))
    return grown.select("feature_id", "property_name", "form")


@register("append_values", S.ctes("tracks", "batches") + """
    , last AS (SELECT geom_id AS property_id, max(t) AS last_time FROM tracks GROUP BY geom_id)
    SELECT value_id, property_id, first_time FROM batches
    UNION ALL
    SELECT -1 - value_id, property_id, first_time + INTERVAL 15 DAY FROM batches JOIN last USING (property_id)
    WHERE property_id % 10 <> 1 AND last_time < first_time + INTERVAL 15 DAY""")
def _(d):
    stored = d.value_batches.drop("day")
    grown, _refused = M.append_values(stored, d.posted_batches)
    return grown.select("value_id", "property_id", F.try_element_at("datetimes", F.lit(1)).alias("first_time"))
