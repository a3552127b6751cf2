import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions.geo import segment_meets_box
from driftline.operators import contacts as C
from driftline.operators import regions as G

INF, NAN = float("inf"), float("nan")


def odd_tables(spark, seed):
    """Paths and regions with corners in any order, without bounds or numbers, of all sizes, some on the same lines."""
    draw = random.Random(seed)

    def number(far):
        return draw.choice([INF, -INF, NAN]) if draw.random() < 0.02 else draw.choice([round(draw.uniform(-far, far)), draw.uniform(-far, far)])

    rows = []
    for g in range(40):
        for i in range(draw.choice([1, 3, 12, 60])):
            far = 10.0 ** draw.choice([0, 1, 2, 3])
            rows.append((g, datetime(2024, 1, 1) + timedelta(minutes=i), float(number(far)), float(number(far)) if draw.random() < 0.97 else None))
    boxes = []
    for r in range(300):
        far, side = 10.0 ** draw.choice([0, 1, 2, 3]), 10.0 ** draw.choice([-1, 0, 1, 3])
        x, y = float(number(far)), float(number(far))
        box = [x, y, x + round(side * draw.random(), 1), y + round(side * draw.random(), 1)]
        if draw.random() < 0.03:
            box = [box[2], box[1], box[0], box[3]]
        if draw.random() < 0.02:
            box[draw.randrange(4)] = draw.choice([INF, -INF, NAN, None])
        boxes.append((r if draw.random() < 0.9 else draw.choice([r - 1, None]), *box))
    return (
        spark.createDataFrame(rows, "geom_id long, t timestamp, x double, y double"),
        spark.createDataFrame(boxes, "region_id long, xmin double, ymin double, xmax double, ymax double"),
    )


def all_pairs(paths, regions):
    w = Window.partitionBy("geom_id").orderBy("t")
    x, y = F.col("x"), F.col("y")
    segments = paths.withColumn("x2", F.coalesce(F.lead("x").over(w), x)).withColumn("y2", F.coalesce(F.lead("y").over(w), y))
    near = (F.least(x, "x2") <= F.col("xmax")) & (F.greatest(x, "x2") >= F.col("xmin")) & (F.least(y, "y2") <= F.col("ymax")) & (F.greatest(y, "y2") >= F.col("ymin"))
    exact = segment_meets_box(*[F.col(c) for c in ("x", "y", "x2", "y2", "xmin", "ymin", "xmax", "ymax")])
    met = segments.filter("x is not null and y is not null").crossJoin(regions).filter(near & exact)
    return met.groupBy("geom_id", "region_id").agg(F.count("*").alias("n"), F.min("t").alias("first"))


def test_region_visits_against_all_pairs(spark, monkeypatch):
    """Odd values, and the same in groups, steps and pieces of a few rows."""
    paths, regions = odd_tables(spark, 5)
    want = sorted(map(str, all_pairs(paths, regions).collect()))
    assert len(want) > 500
    for sizes in ({}, {"SEGMENTS": 64, "BOXES": 40, "PACK": 16, "SHARED": 2}):
        for name, value in sizes.items():
            monkeypatch.setattr(G, name, value)
        got = G.region_visits(paths, regions, finest=1.0).toDF("geom_id", "region_id", "n", "first")
        assert sorted(map(str, got.collect())) == want


def test_pairs_are_not_shuffled(spark):
    """What lies between contacts and result grows with paths times regions, so it must not be shuffled or kept."""
    paths, regions = odd_tables(spark, 6)
    regions = regions.filter("region_id is not null").dropDuplicates(["region_id"])
    plan = G.region_visits(paths, regions, finest=1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    for line in plan[: plan.index("MapInArrow")].splitlines():
        assert not any(word in line for word in ("Aggregate", "Join", "Repartition", "Sort", "Window")), line


def test_contacts_in_small_steps(monkeypatch):
    draw = np.random.default_rng(3)
    x1, y1, dx, dy = (draw.normal(size=900) * 10.0 ** draw.integers(-1, 3, 900) for _ in range(4))
    dx[::7], dy[::5] = 0, 0
    x2, y2 = x1 + dx, y1 + dy
    path = np.repeat(np.arange(9), [1, 2, 3, 4, 10, 30, 50, 100, 700])
    x, y = draw.normal(size=(2, 500)) * 30
    side = 10.0 ** draw.uniform(-3, 2, 500)
    sides = x, y, x + side, y + side * draw.uniform(size=500)
    with np.errstate(all="ignore"):
        box, segment = C._hits(sides, x1, y1, x2, y2)
    want = {}
    for b, s in zip(box.tolist(), segment.tolist()):
        n, first = want.get((path[s], b), (0, s))
        want[path[s], b] = n + 1, min(first, s)
    assert len(want) > 400
    for sizes in ({}, {"PIECE": 40, "STEP": 32, "LEAST": 5, "PER_CELL": 2}):
        for name, value in sizes.items():
            monkeypatch.setattr(C, name, value)
        got = [m for met in C.contacts(C.box_grids(*sides), path, x1, y1, x2, y2) for m in zip(*(a.tolist() for a in met))]
        assert {(path[s], b): (n, s) for b, n, s in got} == want and len(got) == len(want)
