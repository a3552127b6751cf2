import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.functions.geo import envelope
from driftline.functions.projection import lonlat_from_utm32, utm32_from_lonlat
from driftline.operators import predicates as B
from driftline.operators import temporal as T
from tests import ships as S


@pytest.fixture(scope="module")
def ships(spark):
    return S.instants(spark).cache()


def curve(df, value):
    out = {}
    for r in df.orderBy("geom_id", "t").collect():
        out.setdefault(r["geom_id"], []).append((S.clock(r["t"]), r[value]))
    return out


def test_normalise_gives_the_turning_instants(ships):
    got = {}
    for r in T.normalise(ships).orderBy("geom_id", "t").collect():
        got.setdefault(r["geom_id"], []).append((S.clock(r["t"]), r["x"], r["y"]))
    assert got == {k: [(c, float(x), float(y)) for c, x, y in v] for k, v in S.SHIPS.items()}


def test_speed(ships):
    got = curve(T.velocity_curve(ships), "speed")
    assert [c for c, _ in got["maersk_essen"]] == ["06:00", "07:30", "08:00"]
    assert [v for _, v in got["maersk_essen"]] == pytest.approx([1.571348, 0.785674, 0.785674], abs=1e-6)
    assert [v for _, v in got["cma_cgm_libra"]] == pytest.approx([0.785674, 0.392837, 0, 0], abs=1e-6)
    assert got["stena_impero"] == [("08:00", 0.0), ("12:00", 0.0)]
    for name in set(S.SHIPS) - {"maersk_essen", "cma_cgm_libra", "stena_impero"}:
        assert [v for _, v in got[name]] == pytest.approx([0.785674, 0.785674], abs=1e-6)


def test_distance(ships):
    got = curve(T.distance_curve(ships), "distance")
    assert [v for _, v in got["maersk_essen"]] == [0, 8485.281374, 9899.494937]
    assert [v for _, v in got["cma_cgm_libra"]] == [0, 2828.427125, 4242.640687, 4242.640687]
    assert [v for _, v in got["stena_impero"]] == [0, 0]
    assert [v for _, v in got["msc_zoe"]] == [0, 11313.708499]


def test_acceleration(ships):
    got = curve(T.acceleration_curve(ships), "acceleration")
    assert [v for _, v in got["maersk_essen"]] == pytest.approx([0, -1.45495e-4, 0], abs=1e-9)
    assert [v for _, v in got["cma_cgm_libra"]] == pytest.approx([0, -1.09121e-4, -1.09121e-4, 0], abs=1e-9)
    assert [v for _, v in got["msc_zoe"]] == [0, 0]


def test_box_and_interval_counts(ships):
    extents = T.extent(ships)
    box = envelope(*S.PORT)
    assert {r.geom_id for r in B.bbox_overlap(extents, box).collect()} == S.IN_PORT
    assert {r.geom_id for r in B.time_overlap(extents, *S.MORNING).collect()} == S.IN_MORNING
    assert {r.geom_id for r in B.ever_intersects(ships, box, extents=extents).collect()} == S.IN_PORT
    assert B.instant_overlap(extents, S.DAY + "10:30:00").count() == 4
    assert B.time_overlap(extents, S.DAY + "12:15:00", None).count() == 1
    assert B.time_overlap(extents, None, S.DAY + "05:10:00").count() == 2


def test_cut(ships):
    rows = T.normalise(T.subtrajectory(ships, *S.MORNING)).orderBy("geom_id", "t").collect()
    got = {}
    for r in rows:
        got.setdefault(r.geom_id, []).append((S.clock(r.t), r.x, r.y))
    assert got == {
        "stena_impero": [("10:30", 587500, 5674500), ("11:30", 587500, 5674500)],
        "antwerp_star": [("10:30", 588000, 5673000), ("11:00", 587000, 5672000)],
        "schelde_river": [("10:30", 586000, 5671000)],
        "diamond_express": [("10:30", 592000, 5677000), ("11:30", 590000, 5675000)],
    }
    shapes = {r.geom_id: r.geometry for r in T.trajectory_shape(T.subtrajectory(ships, *S.MORNING)).collect()}
    assert '"Point"' in shapes["schelde_river"]


def test_cut_between_instants_and_other_interpolations(spark):
    rows = [("a", datetime(2024, 1, 1), 0.0, 0.0), ("a", datetime(2024, 1, 2), 24.0, 48.0)]
    df = spark.createDataFrame(rows, "geom_id string, t timestamp, x double, y double")
    bounds = ("2024-01-01 06:00:00", "2024-01-01 12:00:00")
    assert [(r.x, r.y) for r in T.subtrajectory(df, *bounds).orderBy("t").collect()] == [(6, 12), (12, 24)]
    assert [(r.x, r.y) for r in T.subtrajectory(df, *bounds, interpolation="Step").orderBy("t").collect()] == [(0, 0), (0, 0)]
    assert T.subtrajectory(df, *bounds, interpolation="Discrete").count() == 0
    same = ("2024-01-01 06:00:00", "2024-01-01 06:00:00")
    assert T.subtrajectory(df, *same).count() == 1
    assert T.subtrajectory(df, "2023-01-01", "2023-02-01").count() == 0


def test_whole_life_cut_is_identity(ships):
    whole = T.subtrajectory(ships, S.DAY + "00:00:00", S.DAY + "23:00:00")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, ships.collect()))


def test_shapes(ships):
    rows = {r.geom_id: r for r in T.trajectory_shape(T.normalise(ships)).collect()}
    assert rows["cma_cgm_libra"].n_points == 3
    assert rows["stena_impero"].geometry.startswith('{"type":"Point"')
    discrete = T.trajectory_shape(T.normalise(ships), discrete=True).filter("geom_id = 'msc_zoe'").first()
    assert '"MultiPoint"' in discrete.geometry


def test_leaf_is_the_end_of_life(ships):
    ends = {r.geom_id: r.tmax for r in T.extent(ships).collect()}
    leaves = T.leaf(ships).collect()
    assert {r.geom_id: r.t for r in leaves} == ends
    assert {r.interpolation for r in leaves} == {"Discrete"}


def test_distance_ends_at_length(ships):
    ends = {r.geom_id: r.d for r in T.distance_curve(ships).groupBy("geom_id").agg(F.max("distance").alias("d")).collect()}
    for r in T.trip_length(ships).collect():
        assert ends[r.geom_id] == pytest.approx(r.length, abs=1e-5)


def test_degree_fixture(spark):
    rows = [("q", datetime(2024, 3, 1) + timedelta(minutes=15 * i), 12.675237 + 0.01 * i, 54.524345 + 0.01 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "geom_id string, t timestamp, x double, y double")
    distance = curve(T.distance_curve(df), "distance")["q"]
    assert len(distance) == 2 and distance[-1][1] == pytest.approx(0.056569, abs=1e-6)
    assert len(curve(T.velocity_curve(df), "speed")["q"]) == 2
    assert len(curve(T.acceleration_curve(df), "acceleration")["q"]) == 2


def test_lone_instant(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), 3.0, 4.0)], "geom_id string, t timestamp, x double, y double")
    assert T.velocity_curve(df).count() == 0
    assert T.acceleration_curve(df).count() == 0
    assert T.distance_curve(df).first().distance == 0
    assert T.time_weighted_avg(df, "x").first().twavg == 3
    assert B.ever_intersects(df, envelope(3, 4, 3, 4)).count() == 1
    assert B.speed_consistency(df.withColumn("sog", F.lit(1.0))).count() == 0


def test_time_weighted_average(spark):
    rows = [("a", datetime(2024, 1, 1), 0.0), ("a", datetime(2024, 1, 2), 10.0), ("a", datetime(2024, 1, 4), 10.0), ("a", datetime(2024, 1, 5), None)]
    df = spark.createDataFrame(rows, "geom_id string, t timestamp, v double")
    assert T.time_weighted_avg(df).first().twavg == pytest.approx(25 / 3)
    assert T.time_weighted_avg(df, interpolation="Step").first().twavg == pytest.approx(20 / 3)


def test_step_normalise(spark):
    rows = [("a", datetime(2024, 1, d), v, 0.0) for d, v in ((1, 1.0), (2, 1.0), (3, 2.0), (4, 2.0), (5, 2.0))]
    df = spark.createDataFrame(rows, "geom_id string, t timestamp, x double, y double")
    assert sorted(r.t.day for r in T.normalise(df, interpolation="Step").collect()) == [1, 3, 5]
    assert T.normalise(df, interpolation="Discrete").count() == 5


@pytest.fixture(scope="module")
def wandering(spark):
    """Three objects; one holds most rows. Positions are whole numbers, so runs of even motion occur."""
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 400), ("warm", 30), ("lone", 1), ("pair", 2)):
        x = y = 0
        start = datetime(2024, 1, 1)
        for i in range(n):
            rows.append((key, start + timedelta(minutes=i if rng.random() < 0.5 or n < 10 else i), float(x), float(y)))
            x, y = x + rng.choice((0, 1)), y + rng.choice((0, 1))
    return spark.createDataFrame(rows, "geom_id string, t timestamp, x double, y double").cache()


CHUNKED = {
    "normalise": lambda df, **c: T.normalise(df, **c),
    "speed": lambda df, **c: T.velocity_curve(df, **c),
    "distance": lambda df, **c: T.distance_curve(df, **c),
    "acceleration": lambda df, **c: T.acceleration_curve(df, **c),
    "length": lambda df, **c: T.trip_length(df, **c),
    "mean": lambda df, **c: T.time_weighted_avg(df, "x", **c),
    "shape": lambda df, **c: T.shape_points(df, **c),
    "belt": lambda df, **c: B.ever_intersects(df, envelope(50, 50, 60, 60), **c),
    "both": lambda df, **c: B.visits_both(df, envelope(5, 0, 9, 90), envelope(80, 0, 90, 900), **c),
    "violations": lambda df, **c: T.speed_violations(df, 0.02, **c),
}


@pytest.mark.parametrize("name", CHUNKED)
def test_large_keys_give_the_same_in_chunks(wandering, name):
    whole = CHUNKED[name](wandering).collect()
    chunked = CHUNKED[name](wandering, max_rows=25).collect()
    key = lambda r: tuple(map(str, r[:2]))
    whole, chunked = sorted(whole, key=key), sorted(chunked, key=key)
    assert len(whole) == len(chunked) > 0
    for a, b in zip(whole, chunked):
        for u, v in zip(a, b):
            assert u == (pytest.approx(v, abs=1e-6) if isinstance(v, float) else v)


def test_normalise_against_brute_force(wandering):
    kept = {}
    for r in T.normalise(wandering, max_rows=40).collect():
        kept.setdefault(r.geom_id, set()).add(r.t)
    rows = {}
    for r in wandering.orderBy("t").collect():
        rows.setdefault(r.geom_id, []).append(r)
    for key, points in rows.items():
        stay = [points[0]]
        for a, b in zip(points[1:], points[2:]):
            p = stay[-1]
            s = (a.t - p.t) / (b.t - p.t)
            if abs(p.x + (b.x - p.x) * s - a.x) > 1e-9 or abs(p.y + (b.y - p.y) * s - a.y) > 1e-9:
                stay.append(a)
        if len(points) > 1:
            stay.append(points[-1])
        assert kept[key] == {p.t for p in stay}


def test_parts_of_a_long_path_are_whole(wandering):
    parts = T.pack_instants(wandering, max_rows=50)
    hot = parts.filter("geom_id = 'hot'").orderBy("part").collect()
    assert len(hot) >= 8 and max(len(r.instants) for r in parts.collect()) <= 101
    # Each slice begins with the instant that ended the one before.
    assert [r.joined.instants for r in hot] == [False] + [True] * (len(hot) - 1)
    assert all(b.instants[0] == a.instants[-1] for a, b in zip(hot, hot[1:]))
    assert sorted(map(tuple, T.unpack_instants(parts).collect())) == sorted(map(tuple, wandering.collect()))


def test_slices_of_a_line_are_the_whole_line(wandering):
    import json

    whole = {r.geom_id: json.loads(r.geometry) for r in T.trajectory_shape(wandering).collect()}
    sliced = {}
    for r in T.trajectory_shape(wandering, max_rows=30).orderBy("geom_id", "part").collect():
        shape = json.loads(r.geometry)
        points = [shape["coordinates"]] if shape["type"] == "Point" else shape["coordinates"]
        sliced.setdefault(r.geom_id, []).extend(points[1:] if r.joined else points)
        assert len(points) == r.n_points
    for key, shape in whole.items():
        points = [shape["coordinates"]] if shape["type"] == "Point" else shape["coordinates"]
        assert sliced[key] == points


def test_paths_of_mixed_interpolation(spark):
    """Round by round: Discrete keeps all, Step its changes, Linear its turns; cuts and curves by the same rules."""
    at = lambda h: datetime(2024, 3, 1, h)
    rows = [(k, at(h), float(x), 0.0, kind) for k, kind in enumerate(["Linear", "Step", "Discrete", None]) for h, x in enumerate([0, 1, 2, 2, 2])]
    mixed = spark.createDataFrame(rows, "geom_id long, t timestamp, x double, y double, interpolation string")
    kept = {}
    for r in T.normalise(mixed).orderBy("t").collect():
        kept.setdefault(r.geom_id, []).append(r.t.hour)
    assert kept == {0: [0, 2, 4], 1: [0, 1, 2, 4], 2: [0, 1, 2, 3, 4], 3: [0, 2, 4]}
    cut = {}
    for r in T.subtrajectory(mixed, datetime(2024, 3, 1, 0, 30), datetime(2024, 3, 1, 1, 30)).orderBy("t").collect():
        cut.setdefault(r.geom_id, []).append((r.t.hour + r.t.minute / 60, r.x))
    assert cut == {0: [(0.5, 0.5), (1, 1), (1.5, 1.5)], 1: [(0.5, 0), (1, 1), (1.5, 1)], 2: [(1, 1)], 3: [(0.5, 0.5), (1, 1), (1.5, 1.5)]}
    shapes = {r.geom_id: r.geometry for r in T.trajectory_shape(mixed).collect()}
    assert "LineString" in shapes[0] and "MultiPoint" in shapes[1] and "MultiPoint" in shapes[2] and shapes[3] == shapes[0]
    assert {r.geom_id for r in T.velocity_curve(mixed).collect()} == {0, 3}
    assert {r.geom_id: r.length for r in T.trip_length(mixed).collect()} == {0: 2, 1: 0, 2: 0, 3: 2}
    assert {r.geom_id: r.d for r in T.distance_curve(mixed).groupBy("geom_id").agg(F.max("distance").alias("d")).collect()} == {0: 2, 1: 0, 2: 0, 3: 2}


def test_bursts_are_cut_too(spark):
    """Nearly all reports of the large key fall into one second, one has a time of 1970."""
    from driftline.operators.sequence import assign_chunks

    burst = spark.range(2000).selectExpr("1 as k", "timestamp_micros(1704067200000000 + id * 500) as t")
    spread = spark.range(30).selectExpr("1 as k", "timestamp_micros(1704067200000000 + (id + 1) * 86400000000) as t")
    wrong = spark.range(1).selectExpr("1 as k", "timestamp_micros(0) as t")
    small = spark.range(20).selectExpr("2 as k", "timestamp_micros(id) as t")
    rows = assign_chunks(burst.union(spread).union(wrong).union(small), ["k"], max_rows=100)
    sizes = {(r.k, r.chunk): r["count"] for r in rows.groupBy("k", "chunk").count().collect()}
    assert sizes.pop((2, None)) == 20
    assert sum(sizes.values()) == 2031 and max(sizes.values()) <= 200
    order = [r.chunk for r in rows.filter("k = 1").orderBy("t").collect()]
    assert order == sorted(order)


def test_projection(spark):
    golden = [(585000.0, 5672000.0, 10.216425916, 51.19308317), (591000.0, 5678000.0, 10.303791254, 51.246098141), (584000.0, 5671000.0, 10.201884522, 51.184240826)]
    df = spark.createDataFrame(golden, "x double, y double, lon double, lat double")
    lon, lat = lonlat_from_utm32(F.col("x"), F.col("y"))
    x, y = utm32_from_lonlat(F.col("lon"), F.col("lat"))
    bx, by = utm32_from_lonlat(lon, lat)
    for r in df.select("*", lon.alias("glon"), lat.alias("glat"), x.alias("gx"), y.alias("gy"), bx.alias("bx"), by.alias("by")).collect():
        assert (r.glon, r.glat) == pytest.approx((r.lon, r.lat), abs=1e-9)
        assert (r.gx, r.gy) == pytest.approx((r.x, r.y), abs=1e-3)
        assert (r.bx, r.by) == pytest.approx((r.x, r.y), abs=1e-6)


def test_port_case(ships):
    from driftline.plans.port_traffic import port_traffic

    rows = {r.geom_id: r for r in port_traffic(ships, envelope(*S.PORT), *S.MORNING).collect()}
    assert set(rows) == S.IN_PORT
    assert not any(r.violates for r in rows.values())
    assert rows["stena_impero"].n_stopped == 2 and rows["cma_cgm_libra"].n_stopped == 2
    assert rows["msc_zoe"].n_cut == 0 and rows["schelde_river"].n_cut == 1
    assert T.speed_violations(ships, 1.0).filter("violates").first().geom_id == "maersk_essen"
