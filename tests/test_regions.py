import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftline.functions.geo import segment_meets_box
from driftline.operators.regions import box_pairs, region_visits


def test_grid_join_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        n = 60 if g == 0 else 8
        for i in range(n):
            far = 10 ** rng.choice((1, 2, 4))
            rows.append((g, datetime(2024, 1, 1) + timedelta(minutes=i), rng.uniform(-far, far), rng.uniform(-far, far)))
    paths = spark.createDataFrame(rows, "geom_id long, t timestamp, x double, y double")
    boxes = []
    for r in range(40):
        far, side = 10 ** rng.choice((1, 2, 4)), 10 ** rng.choice((-1, 0, 1, 3))
        x, y = rng.uniform(-far, far), rng.uniform(-far, far)
        boxes.append((r, x, y, x + side, y + side * rng.random()))
    regions = spark.createDataFrame(boxes, "region_id long, xmin double, ymin double, xmax double, ymax double")
    got = {(r.geom_id, r.region_id): (r.n_segments, r.first_contact) for r in region_visits(paths, regions, finest=1.0).collect()}

    def meets(a, b, box):
        lo, hi = 0.0, 1.0
        for p, q, low, high in ((a[2], b[2], box[1], box[3]), (a[3], b[3], box[2], box[4])):
            d = q - p
            if d == 0:
                if not low <= p <= high:
                    return False
                continue
            u, v = sorted(((low - p) / d, (high - p) / d))
            lo, hi = max(lo, u), min(hi, v)
        return lo <= hi

    want = {}
    for g in range(12):
        points = [r for r in rows if r[0] == g]
        for a, b in zip(points, points[1:] + points[-1:]):
            for box in boxes:
                if meets(a, b, box):
                    n, t = want.get((g, box[0]), (0, a[1]))
                    want[(g, box[0])] = (n + 1, min(t, a[1]))
    assert got == want and len(want) > 20


def test_each_pair_once(spark):
    left = spark.range(200).selectExpr("id as a", "cast(id as double) as xmin", "0d as ymin", "cast(id as double) + 40 as xmax", "30d as ymax")
    right = spark.range(50).selectExpr("id as b", "id * 3d as xmin", "10d as ymin", "id * 3d + (id % 7) * 20 as xmax", "20d as ymax")
    pairs = box_pairs(left, right, 1.0)
    brute = left.join(right.toDF("b", "bx1", "by1", "bx2", "by2"), F.expr("xmin <= bx2 and xmax >= bx1"))
    assert pairs.count() == pairs.select("a", "b").distinct().count() == brute.count()


def test_touching_and_lone_points(spark):
    cases = [(0, 0, 10, 10, True), (0, 0, 0, 0, False), (5, 5, 5, 5, True), (0, 5, 4, 5, True), (0, 8, 8, 0, True), (0, 7, 7, 0, False), (0, 3.9, 9, 3.9, False), (6, 6, 9, 9, True)]
    df = spark.createDataFrame([tuple(map(float, c[:4])) + (c[4],) for c in cases], "a double, b double, c double, d double, want boolean")
    lit = [F.lit(v) for v in (4.0, 4.0, 6.0, 6.0)]
    assert df.filter(segment_meets_box(*[F.col(c) for c in "abcd"], *lit) != F.col("want")).count() == 0


def test_boxes_of_any_size_list_a_bounded_number_of_cells(spark):
    """Boxes from a point to far beyond the last grid; same pairs as comparing all with all."""
    import random

    from driftline.operators import regions as G

    draw = random.Random(8)

    def boxes(n):
        out = []
        for i in range(n):
            side = 10.0 ** draw.uniform(-3, 15)
            x, y = (draw.uniform(-1, 1) * 10.0 ** draw.uniform(0, 15) for _ in "xy")
            out.append((i, x, y, x + side, y + side * draw.random()))
        return [*out, (n, -1e15, -1e15, 1e15, 1e15)]

    left, right = boxes(60), boxes(40)
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, xmin double, ymin double, xmax double, ymax double")
    a, b = frame(left, "a"), frame(right, "b")
    listed = G._cells(a, 1.0).groupBy("a").count()
    assert listed.agg({"count": "max"}).first()[0] <= 4 * G.LEVELS
    got = sorted((r.a, r.b) for r in G.box_pairs(a, b, 1.0).select("a", "b").collect())
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert got == want


def test_regions_of_one_box_are_met_once(spark, monkeypatch):
    """Copies of a box share its work; ids given twice, ids of several boxes, null ids and chunked paths count as before."""
    from driftline.operators import regions as G

    boxes = [(r, 10.0 * (r % 3), 0.0, 10.0 * (r % 3) + 5, 4.0) for r in range(60)]
    boxes += [(100, 0.0, 0.0, 5.0, 4.0), (100, 10.0, 0.0, 15.0, 4.0), (101, 0.0, 0.0, 5.0, 4.0), (101, 0.0, 0.0, 5.0, 4.0)]
    boxes += [(None, 0.0, 0.0, 5.0, 4.0), (None, 20.0, 0.0, 25.0, 4.0), (102, None, 0.0, 5.0, 4.0)]
    regions = spark.createDataFrame(boxes, "region_id long, xmin double, ymin double, xmax double, ymax double")
    rows = [(g, datetime(2024, 1, 1) + timedelta(minutes=i), 3.0 * i, float(g)) for g in range(6) for i in range(9)]
    paths = spark.createDataFrame(rows, "geom_id long, t timestamp, x double, y double")
    want = {}
    for g, t, x, y in rows:
        for r, xmin, ymin, xmax, ymax in boxes:
            if xmin is not None and y <= ymax and x <= xmax and min(x + 3, 24.0) >= xmin:
                n, first = want.get((g, r), (0, t))
                want[(g, r)] = (n + 1, min(first, t))
    met, plain = [], G.box_pairs
    monkeypatch.setattr(G, "box_pairs", lambda left, right, finest: met.append(right) or plain(left, right, finest))
    for chunking in ({}, {"max_rows": 4}):
        got = region_visits(paths, regions, finest=4.0, **chunking).collect()
        assert {(r.geom_id, r.region_id): (r.n_segments, r.first_contact) for r in got} == want and len(got) == len(want)
    assert {right.count() for right in met} == {3 + 6 + 1}  # three boxes for 60 ids, those of 100, 101 and null, one unknown
