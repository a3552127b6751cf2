"""Objects larger than a chunk: every registered query that builds arrays or looks at neighbours, against its SQL."""

import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from check import canonical
from driftline.operators import sequence
from driftline.plans.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not at hand")

SLICED = [
    "trajectory_shape", "feature_line", "geometry_sequence", "ingest_features", "decode_mfjson", "encode_mfjson", "property_list",
    "property_values", "assemble_trips", "ship_documents", "items", "items_leaf", "items_document", "features_nested", "feature_paths",
    "distance_curve", "acceleration_curve", "normalise_mixed", "append_values",
]


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", SLICED)
def test_every_object_is_large(spark, monkeypatch, name):
    """Chunks of three rows, so that every trajectory is cut and all ends are carried over."""
    monkeypatch.setattr(sequence, "CHUNK_ROWS", 3)
    monkeypatch.setattr(sequence, "SAMPLES", 2)
    same(spark, FOLDER, name)


@pytest.fixture(scope="module")
def long_path(tmp_path_factory):
    """The tables with one more trajectory of 700,000 instants."""
    folder = tmp_path_factory.mktemp("long")
    for f in Path(FOLDER).glob("*.parquet"):
        if f.stem != "events":
            (folder / f.name).symlink_to(f)
    duckdb.connect().execute(f"""COPY (SELECT * FROM '{FOLDER}/events.parquet' UNION ALL BY NAME
        SELECT 1000000 + i AS event_id, 1::BIGINT AS user_id, 'purchase' AS event_type,
            TIMESTAMP '2024-01-01' + i * INTERVAL 1 HOUR + INTERVAL 7 SECOND AS ts,
            round(220 + 30 * sin(i / 50.0) + (hash(i) % 100) / 50.0, 3) AS value, '{{"k": ' || (50 + hash(i + 7) % 40) || '}}' AS props
        FROM range(700000) t(i)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", ["trajectory_shape", "geometry_sequence"])
def test_a_path_of_700000_instants(spark, long_path, name):
    same(spark, long_path, name)


def test_chunks_follow_any_order(spark):
    """Text keys in one feature, and a third of all rows in one key."""
    rows = spark.range(3000).selectExpr("id % 3 = 0 as hot", "id").selectExpr(
        "if(hot, 0, id) as k", "concat('property of the same beginning ', lpad(id % 1000, 5, '0')) as name"
    )
    tagged = sequence.assign_chunks(rows, ["k"], ["name"], max_rows=100)
    sizes = {r.chunk: r["count"] for r in tagged.filter("k = 0").groupBy("chunk").count().collect()}
    assert len(sizes) >= 7 and max(sizes.values()) <= 200 and sum(sizes.values()) == 1000
    order = [r.chunk for r in tagged.filter("k = 0").orderBy("name").collect()]
    assert order == sorted(order) and order[0] == 0
    assert tagged.filter("k <> 0 AND chunk IS NOT NULL").count() == 0
    listed = sequence.collect_parts(rows, ["k"], [F.sort_array(F.collect_list("name")).alias("names")], "name", 100)
    hot = listed.filter("k = 0").orderBy("part_no").collect()
    assert [n for r in hot for n in r.names] == sorted(n for r in hot for n in r.names)
    assert [r.first_item for r in hot] == [sum(len(x.names) for x in hot[:i]) for i in range(len(hot))]
