import random
from datetime import datetime, timedelta

import pytest

from driftline.operators import mutate as M
from driftline.operators import temporal as T
from driftline.streaming import live


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def as_files(df, folder, files):
    df.repartition(files).write.parquet(folder)


@pytest.fixture(scope="module")
def reports(spark):
    rng = random.Random(5)
    rows = [(m, datetime(2024, 1, 1) + timedelta(minutes=i), rng.uniform(0, 9), rng.uniform(0, 9)) for m in range(4) for i in range(25)]
    return spark.createDataFrame(rows, "mmsi long, t timestamp, x double, y double").coalesce(1).sortWithinPartitions("t")


def test_motion_equals_batch(spark, reports, tmp_path):
    folder = str(tmp_path / "in")
    for hour in range(5):
        part = reports.filter(f"minute(t) div 5 = {hour}")
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run(live.live_motion(stream), "motion")
    ends = {r.mmsi: r.d for r in out.groupBy("mmsi").agg({"distance": "max"}).toDF("mmsi", "d").collect()}
    assert out.filter("late").count() == 0 and out.count() == 100
    for r in T.trip_length(reports, ["mmsi"]).collect():
        assert ends[r.mmsi] == pytest.approx(r.length, abs=1e-9)
    assert out.filter("speed is null").count() == 4
    assert {r.status for r in out.filter("speed is not null").select("status").distinct().collect()} <= {"STOPPED", "docking", "Moving"}


def test_late_reports_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "mmsi long, t timestamp, x double, y double"
    for rows in ([(1, datetime(2024, 1, 1, 1), 0.0, 0.0)], [(1, datetime(2024, 1, 1, 0), 9.0, 9.0)], [(1, datetime(2024, 1, 1, 2), 3.0, 4.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = {r.t.hour: r for r in run(live.live_motion(stream), "late").collect()}
    assert rows[0].late and not rows[2].late and rows[2].distance == 5.0


def test_copies_in_a_stream(spark, reports, tmp_path):
    folder = str(tmp_path / "in")
    as_files(reports.union(reports), folder, 3)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert run(live.dedup_stream(stream, "2 hours"), "copies").count() == 100


def test_continuity_equals_batch(spark, tmp_path):
    schema = "value_id long, property_id long, datetimes array<timestamp>, values array<string>, interpolation string"
    day = lambda d, h: datetime(2024, 1, d, h)
    rows = [(10 * p + d, p, [day(d, 0), day(d + (p == 2), 5)], ["a", "b"], "Step") for p in (1, 2, 3) for d in range(1, 8)]
    rows.append((99, 1, [day(9, 0)], ["a", "b"], "Step"))
    batches = spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "in")
    as_files(batches, folder, 1)
    stream = spark.readStream.schema(schema).parquet(folder)
    out = run(live.continuous_batches(stream), "continuity")
    taken = {r.value_id for r in out.filter("taken").collect()}
    grown, refused = M.append_values(spark.createDataFrame([], schema), batches)
    assert taken == {r.value_id for r in grown.collect()}
    assert {r.value_id for r in out.filter("not taken").collect()} == {r.value_id for r in refused.collect()}
