import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.operators import features as X
from driftline.operators import mutate as M
from driftline.operators import validate as V
from driftline.plans.catalogue import Catalogue
from driftline.plans.items import nest_items
from driftline.schemas import TABLES
from driftline.sources import documents, export
from tests import ships as S

def now():
    return F.lit("2024-04-01").cast("timestamp")


def ship_document(name, as_text=False, **more):
    rows = [r for r in S.raw_rows() if r[0] == name]
    path = {
        "type": "MovingPoint",
        "datetimes": [r[1].strftime("%Y-%m-%d %H:%M:%S+00") for r in rows],
        "coordinates": [[r[2], r[3]] for r in rows],
        "interpolation": "Linear",
    }
    return {
        "type": "Feature", "id": name, "properties": {"name": name},
        "crs": {"type": "name", "properties": "urn:ogc:def:crs:EPSG::25832"},
        "temporalGeometry": json.dumps(path) if as_text else path, **more,
    }


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    empty = Catalogue(**{n: spark.createDataFrame([], s) for n, s in TABLES.items()})
    titles = spark.createDataFrame([("Belgium Ships", None, 5, None), ("Other", "x", None, "movingfeature"), (None, "y", None, None), ("Bad", None, None, "feature")],
                                   "title string, description string, updateFrequency int, itemType string")
    cat, refused = empty.post_collections(titles, now())
    assert sorted(e for r in refused.collect() for e in r.errors) == ["Missing required field: title", "itemType must be 'movingfeature'"]
    names = list(S.SHIPS)
    docs = [("belgium_ships", json.dumps({"type": "FeatureCollection", "features": [ship_document(n) for n in names[:6]]}))]
    docs += [("belgium_ships", json.dumps(ship_document(n, as_text=True))) for n in names[6:]]
    docs += [
        ("belgium_ships", json.dumps({"id": "x"})),
        ("belgium_ships", json.dumps({"type": "Movement"})),
        ("belgium_ships", json.dumps({"type": "FeatureCollection", "features": {"a": 1}})),
        ("belgium_ships", json.dumps({"type": "FeatureCollection", "features": [{"type": "Thing"}]})),
        ("nowhere", json.dumps(ship_document("lost"))),
        ("other", json.dumps({"type": "Feature", "id": 17, "bbox": [1, 2, 3, 4], "time": ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"]})),
        ("other", json.dumps({"type": "Feature", "properties": {"a": 1}})),
    ]
    cat, rejects = cat.post_items(spark.createDataFrame(docs, "collection_id string, body string"), now())
    assert sorted(r.error for r in rejects.collect()) == sorted([
        "Missing mandatory 'type'", "Invalid 'type'", "FeatureCollection missing 'features' array", "Invalid feature type", "collection does not exist"])
    root = str(tmp_path_factory.mktemp("store"))
    cat.save(root)
    return Catalogue.load(spark, root)


def test_stored(base):
    assert {r.id for r in base.list_collections().collect()} == {"belgium_ships", "other"}
    assert base.get_collection("belgium_ships").first().updateFrequency == 5
    rows = {r.feature_id: r for r in base.features.collect()}
    assert len(rows) == 12 and rows["maersk_essen"].srid == 25832
    assert (rows["maersk_essen"].xmin, rows["maersk_essen"].ymax) == (585000, 5679000)
    assert (rows["17"].xmin, rows["17"].ymax, rows["17"].tmax) == (1, 4, datetime(2024, 1, 2))
    assert base.geometries.count() == 10 and base.instants.count() == len(S.raw_rows())


def test_items(base, spark):
    box = ",".join(map(str, S.PORT))
    found = base.get_items("belgium_ships", bbox=box, limit=100)
    counts = found.counts.first()
    assert (counts.number_matched, counts.number_returned, counts.joined_rows) == (8, 8, 8)
    nested = {r.feature_id: r for r in nest_items(found).collect()}
    assert set(nested) == S.IN_PORT
    libra = nested["cma_cgm_libra"]
    assert len(libra.geometries[0].sequence.datetimes) == 4
    assert len(json.loads(libra.shapes[0].geometry)["coordinates"]) == 3
    interval = "/".join(t.replace(" ", "T") + "Z" for t in S.MORNING)
    cut = base.get_items("belgium_ships", datetime=interval, sub_trajectory=True, limit=100)
    rows = {r.feature_id: r for r in cut.geometries.collect()}
    assert set(rows) == S.IN_MORNING
    assert rows["schelde_river"].n_instants == 1 and "Point" in rows["schelde_river"].geometry
    leaf = base.get_items("belgium_ships", leaf=True).geometries.collect()
    assert len(leaf) == 10 and all(r.n_instants == 1 and r.sequence.interpolation == "Discrete" for r in leaf)
    assert sum("LineString" in r.geometry for r in leaf) == 9


def test_paging(base):
    first = base.get_items("belgium_ships", limit=4).page.collect()
    last = first[-1]
    second = base.get_items("belgium_ships", limit=100, after=(last.created_at, last.feature_id)).page.collect()
    assert len(first) == 4 and len(second) == 6
    assert not {r.feature_id for r in first} & {r.feature_id for r in second}
    assert base.get_items("belgium_ships", limit=4).counts.first().number_returned == 4


@pytest.mark.parametrize("arguments", [
    dict(limit="many"), dict(bbox="1,2,3"), dict(bbox="a,b,c,d"), dict(sub_trajectory=True),
    dict(sub_trajectory=True, datetime="2024-01-01T00:00:00Z"), dict(sub_trajectory=True, datetime="2024-01-01/.."),
    dict(sub_trajectory=True, leaf=True, datetime="2024-01-01/2024-01-02"), dict(datetime="a/b/c"),
    dict(limit=99999), dict(limit=-1), dict(datetime="abc/def"), dict(datetime="2024-01-02/2024-01-01"),
    dict(datetime="noon"), dict(bbox="1,2,nan,4"), dict(bbox="1,2,inf,4"),
])
def test_bad_arguments(arguments):
    with pytest.raises(ValueError):
        V.item_query(**arguments)


def test_arguments():
    assert V.item_query(limit=10000).limit == 10000 and V.item_query(limit=None).limit is None
    assert V.item_query(bbox="3,4,1,2").box == (1, 2, 3, 4)
    open_end = V.item_query(datetime="2024-01-01/..")
    assert (open_end.timed, open_end.start, open_end.end) == (True, "2024-01-01", None)
    instant = V.item_query(datetime="2024-01-01")
    assert instant.start == instant.end


def test_items_as_one_document(base, tmp_path):
    from driftline.plans.items import write_items_document

    area = ",".join(map(str, S.PORT))
    lines = base.get_items_document("belgium_ships", now(), bbox=area, limit=5, base="http://here")
    write_items_document(lines, str(tmp_path / "page"))
    file, = (tmp_path / "page").glob("part-*.txt")
    doc = json.loads(file.read_text())
    assert doc["type"] == "FeatureCollection" and (doc["numberMatched"], doc["numberReturned"]) == (8, 5)
    assert [f["id"] for f in doc["features"]] == [r.feature_id for r in base.get_items("belgium_ships", bbox=area, limit=5).page.orderBy("created_at", "feature_id").collect()]
    assert doc["links"][1]["rel"] == "next" and "bbox=" in doc["links"][1]["href"] and doc["links"][1]["href"].startswith("http://here/")
    for f in doc["features"]:
        path, = f["temporalGeometry"]
        assert [(t[11:16], *c) for t, c in zip(path["datetimes"], path["coordinates"])] == [(c, float(x), float(y)) for c, x, y in S.SHIPS[f["id"]]]
        assert f["geometry"][0]["type"] in ("LineString", "Point") and f["bbox"]
    none = base.get_items_document("belgium_ships", now(), bbox="0,0,1,1")
    write_items_document(none, str(tmp_path / "none"))
    file, = (tmp_path / "none").glob("part-*.txt")
    assert json.loads(file.read_text())["features"] == []


def test_posted_twice_or_known(base, spark):
    one = json.dumps(ship_document("msc_zoe"))
    other = json.dumps({"type": "Feature", "id": "new", "properties": {"a": 1}})
    rows = spark.createDataFrame([("belgium_ships", one), ("belgium_ships", other), ("belgium_ships", other), ("belgium_ships", other.replace("1", "2"))], "collection_id string, body string")
    grown, rejects = base.post_items(rows, now())
    assert grown.features.count() == base.features.count() + 1
    assert sorted((r.feature_id, r.error) for r in rejects.collect()) == [
        ("msc_zoe", "feature already exists"), ("new", "given more than once"), ("new", "given more than once")]


def test_single_feature_and_export(base):
    found = base.get_feature("belgium_ships", "msc_zoe")
    assert found.count() == 1 and found.first().part == 0
    path = found.first().feature.temporalGeometry[0]
    stored = base.instants.filter("feature_id = 'msc_zoe'").orderBy("t").collect()
    assert [(t[11:16], *c) for t, c in zip(path.datetimes, path.coordinates)] == [(S.clock(r.t), r.x, r.y) for r in stored]
    assert path.type == "MovingPoint" and path.interpolation == "Linear"
    alone = json.loads(export.to_text(base.get_feature("other", "17"), "feature").first().feature)
    assert alone["temporalGeometry"] is None and alone["id"] == "17"
    assert base.get_feature("other", "nobody").count() == 0
    doc = json.loads(found.select(F.to_json("feature").alias("f")).first().f)
    assert doc["bbox"] == [585000, 5672000, 593000, 5680000] and len(doc["links"]) == 3
    assert doc["time"][0] == "2024-03-15T06:00:00.000000Z"
    one = base.get_sequence("belgium_ships", "msc_zoe").first()
    assert one.geometry.interpolation == "Linear" and one.geometry.id == one.geom_id
    told = base.get_sequence_document("belgium_ships", "msc_zoe", now(), base="http://here").first().document
    assert told.type == "TemporalGeometrySequence" and (told.numberMatched, told.numberReturned) == (1, 1)
    assert told.links[0].href == "http://here/collections/belgium_ships/items/msc_zoe/tgsequence"
    assert [len(g.datetimes) for g in told.geometrySequence] == [len(stored)]
    assert json.loads(export.to_text(export.collection_documents(base.list_collections()), "collection").first().collection)["extent"] is None


def test_curves_on_request(base):
    wanted = base.geometries.filter("feature_id in ('maersk_essen', 'stena_impero')").select("collection_id", "feature_id", "geom_id")
    assert base.velocity(wanted).count() == 5
    assert base.distance(wanted).count() == 5
    assert base.acceleration(wanted).count() == 5
    curve = export.curve_document(base.velocity(wanted), "speed", "m/s", "velocity").first().curve
    assert curve.type == "TReal" and curve.unit == "m/s"
    wrong = wanted.limit(1).select(F.lit("other").alias("collection_id"), "feature_id", "geom_id").union(
        wanted.limit(1).select(F.lit("none").alias("collection_id"), "feature_id", "geom_id")).union(
        wanted.limit(1).select("collection_id", "feature_id", F.lit(5).cast("long")))
    assert {r.missing for r in base.missing(wrong).collect()} == {"collection", "feature", "geometry"}


def test_collection_update(base, spark):
    patch = spark.createDataFrame([("belgium_ships", "New", True, None, True, None, False)],
                                  "id string, title string, has_title boolean, description string, has_description boolean, item_type string, has_item_type boolean")
    more = patch.unionByName(patch.withColumn("title", F.lit("Newer"))).unionByName(patch.withColumn("id", F.lit("nobody")))
    more = more.unionByName(patch.withColumns({"item_type": F.lit("feature"), "has_item_type": F.lit(True)})).unionByName(patch.withColumn("id", F.lit(None).cast("string")))
    changed, refused = base.put_collections(more, now())
    assert sorted((r.id or "", r.refused) for r in refused.collect()) == [
        ("", "missing id"), ("belgium_ships", "given more than once"), ("belgium_ships", "itemType must be 'movingfeature'"),
        ("nobody", "collection does not exist")]
    row = changed.collections.filter("id = 'belgium_ships'").first()
    assert (row.title, row.description, row.update_frequency, row.item_type) == ("New", None, 5, "movingfeature")
    assert row.updated_at is not None


def test_deletes_leave_no_orphans(base, spark):
    kept = base.delete_collections(spark.createDataFrame([("belgium_ships",)], "id string"))
    assert kept.features.count() == 2 and kept.geometries.count() == 0 and kept.instants.count() == 0
    assert kept.collections.count() == 1
    gone = spark.createDataFrame([("msc_zoe", "belgium_ships"), ("stena_impero", "other")], "feature_id string, collection_id string")
    kept = base.delete_features(gone)
    assert kept.features.count() == 11 and kept.geometries.count() == 9
    assert kept.instants.join(kept.geometries, "geom_id", "left_anti").count() == 0
    one = base.geometries.filter("feature_id = 'msc_zoe'").select("collection_id", "feature_id", "geom_id")
    assert base.delete_geometries(one).geometries.count() == 9


def test_properties_life(base, spark):
    incoming = spark.createDataFrame([("msc_zoe", "speed", "TReal", "KMH"), ("msc_zoe", "flag", "TBoolean", None), ("nobody", "speed", "TReal", None)],
                                     "feature_id string, property_name string, property_type string, form string")
    cat, refused = base.post_properties(incoming)
    assert cat.properties.count() == 2
    assert [(r.feature_id, r.refused) for r in refused.collect()] == [("nobody", "feature does not exist")]
    again, refused = cat.post_properties(spark.createDataFrame([
        ("msc_zoe", "speed", "TReal", "KMH"), ("msc_zoe", "new", "TText", None), ("msc_zoe", "new", "TText", None), ("msc_zoe", "new", "TReal", None),
        ("msc_zoe", None, "TReal", None), ("msc_zoe", "odd", "Speed", None), ("msc_zoe", "odd", None, None)], incoming.schema))
    assert again.properties.count() == 3
    assert sorted((r.property_name or "", r.refused) for r in refused.collect()) == [
        ("", "Missing required field: name"), ("new", "given more than once"), ("new", "given more than once"),
        ("odd", "Invalid property type"), ("odd", "Missing required field: type"), ("speed", "property exists")]
    ids = {r.property_name: r.property_id for r in cat.properties.collect()}
    schema = "property_id long, datetimes array<timestamp>, values array<string>, interpolation string"
    hour = lambda h: datetime(2024, 3, 1, h)
    first = spark.createDataFrame([(ids["speed"], [hour(0), hour(1)], ["15.5", "16.2"], "Linear")], schema)
    cat, refused = cat.post_values(first)
    assert cat.temporal_values.count() == 1 and refused.count() == 0
    more = spark.createDataFrame([
        (ids["speed"], [hour(1), hour(2)], ["1", "2"], "Linear"),
        (ids["speed"], [hour(3), hour(5)], ["1", "bad"], "Step"),
        (ids["speed"], [hour(4), hour(6)], ["1", "2"], "Step"),
        (ids["speed"], [hour(7)], ["1"], "Step"),
        (ids["speed"], [hour(8)], [], "Step"),
        (ids["speed"], [], [], "Step"),
        (ids["speed"], [hour(9)], ["1"], "Curved"),
        (-1, [hour(9)], ["1"], "Step"),
    ], schema)
    cat, refused = cat.post_values(more)
    told = sorted((r.datetimes[0].hour if r.datetimes else -1, r.refused) for r in refused.collect())
    assert told == [
        (-1, "datetimes must not be empty"), (1, "starts before the end of earlier values"), (4, "starts before the end of earlier values"),
        (8, "datetimes and values must have the same length"), (9, "Invalid interpolation"), (9, "property does not exist")]
    assert sorted(r.datetimes[0].hour for r in cat.temporal_values.collect()) == [0, 3, 7]
    row = cat.get_property("msc_zoe", "speed").first()
    assert [b.first_time.hour for b in row.batches] == [0, 3, 7]
    from driftline.operators.properties import property_readings
    values = [r.as_real for r in property_readings(cat.properties, cat.temporal_values).orderBy("t").collect()]
    assert values == [15.5, 16.2, 1.0, None, 1.0]
    listed = cat.get_properties("msc_zoe").first().properties
    assert [p.name for p in listed] == ["flag", "speed"]
    one = cat.temporal_values.limit(1).select("value_id", "property_id")
    assert cat.delete_values(one).temporal_values.count() == 2
    rest = cat.delete_properties(spark.createDataFrame([("msc_zoe", "speed")], "feature_id string, property_name string"))
    assert rest.properties.count() == 1 and rest.temporal_values.count() == 0


def test_running_maximum_in_chunks(spark):
    rows = [(1, i, [datetime(2024, 1, 1 + i % 28, i % 24), datetime(2024, 1, 1 + i % 28, i % 24, 50)], ["a", "b"], "Step") for i in range(200)]
    schema = "property_id long, value_id long, datetimes array<timestamp>, values array<string>, interpolation string"
    batches = spark.createDataFrame(rows, schema)
    stored = spark.createDataFrame([], schema)
    whole, chunked = M.append_values(stored, batches)[0], M.append_values(stored, batches, max_rows=15)[0]
    assert sorted(r.value_id for r in whole.collect()) == sorted(r.value_id for r in chunked.collect())


def test_appended_path(base, spark):
    doc = json.dumps({"type": "MovingPoint", "datetimes": ["2024-05-01T00:00:00Z", "2024-05-01T02:00:00+01"], "coordinates": [[1, 2], [3, 4]]})
    rows = spark.createDataFrame([("belgium_ships", "msc_zoe", 7, 25832, doc), ("other", "msc_zoe", 8, 25832, doc)],
                                 "collection_id string, feature_id string, geom_id long, srid int, trajectory string")
    rows = rows.union(rows.limit(1)).union(rows.limit(1).withColumns({"geom_id": F.lit(9).cast("long"), "trajectory": F.lit('{"datetimes": [null], "coordinates": [[1, 2]]}')}))
    grown, refused = base.post_sequences(rows, now())
    assert sorted((r.geom_id, r.refused) for r in refused.collect()) == [
        (7, "given more than once"), (8, "feature does not exist"), (9, documents.BAD_PATH)]
    assert grown.geometries.count() == 11
    new = grown.geometries.filter("geom_id = 7").first()
    assert (new.xmin, new.ymax, new.tmin, new.interpolation) == (1, 4, datetime(2024, 5, 1), "Linear")


def test_inline_properties(spark):
    doc = ship_document("msc_zoe", temporalProperties=[
        {"datetimes": ["2024-03-05T06:00:00.250Z", "2024-03-05T06:10:00.250Z", "2024-03-05T06:20:00.250Z"],
         "draught": {"type": "TReal", "form": "MTR", "values": [9.5, 9.25, 9], "interpolation": "Step", "description": "keel depth"},
         "fuel": {"type": "TReal", "form": "LTR", "values": [70, 64, 61]}},
        {"datetimes": ["2024-03-06T18:45:00.125Z"], "pilot": {"type": "TBoolean", "values": [True], "interpolation": "Discrete"}},
    ])
    docs = spark.createDataFrame([(json.dumps(doc),)], "body string")
    rows = {r.property_name: r for r in documents.inline_properties(documents.parsed_features(docs)).collect()}
    assert set(rows) == {"draught", "fuel", "pilot"}
    assert rows["draught"]["values"] == ["9.5", "9.25", "9"] and rows["fuel"].interpolation == "Linear"
    assert rows["pilot"].block == 1 and rows["pilot"].datetimes[0].microsecond == 125000


BATCH = "property_id long, value_id long, datetimes array<timestamp>, values array<string>, interpolation string"


def day_batches(*spans):
    return [(1, i, [datetime(2024, 1, a), datetime(2024, 1, b)], ["x", "y"], "Step") for i, (a, b) in enumerate(spans)]


@pytest.mark.parametrize("spans, taken", [
    ([(5, 25), (15, 16)], [1]),  # the first is refused for what is stored, so it cannot stand in the way
    ([(11, 20), (15, 28), (25, 26)], [0, 2]),
    ([(11, 12), (12, 13), (13, 14), (14, 15)], [0, 2]),
    ([(11, 11), (11, 30), (12, 13), (13, 20), (14, 15)], [0, 2, 4]),
    ([(11, 30), (12, 13), (31, 31)], [0, 2]),
])
def test_refused_batches_block_none(spark, spans, taken):
    stored = spark.createDataFrame(day_batches((1, 10)), BATCH)
    posted = spark.createDataFrame(day_batches(*spans), BATCH)
    for options in ({}, {"max_rows": 2}):
        grown, refused = M.append_values(stored, posted, **options)
        assert sorted(r.value_id for r in grown.filter("datetimes[0] > timestamp '2024-01-02'").collect()) == taken
        assert sorted(r.value_id for r in refused.collect()) == [i for i in range(len(spans)) if i not in taken]


def test_equal_and_unkeyed_batches_are_judged_once_each(spark):
    batch, other = day_batches((11, 12), (13, 14))
    none = (None, None, *other[2:])
    posted = spark.createDataFrame([batch, batch, none, (None, 5, *other[2:]), (7, None, *other[2:])], BATCH)
    grown, refused = M.append_values(spark.createDataFrame([], BATCH), posted)
    key = lambda r: (str(r.property_id), str(r.value_id))
    assert sorted(map(key, grown.collect())) == [("1", "0"), ("7", "None"), ("None", "None")]
    assert sorted(map(key, refused.collect())) == [("1", "0"), ("None", "5")]


def test_one_island_of_many_batches(spark):
    draw = random.Random(3)
    t0 = datetime(2024, 1, 1)
    starts = [draw.randint(0, 3000) for _ in range(600)]
    rows = [(1, i, [t0 + timedelta(minutes=s), t0 + timedelta(minutes=s + draw.randint(0, 40))], ["x", "y"], "Step") for i, s in enumerate(starts)]
    until, taken, after = None, set(), {}
    for r in sorted(rows, key=lambda r: (r[2][0], r[1])):
        if until is None or until < r[2][0]:
            taken.add(r[1])
            until = r[2][1]
        else:
            after[r[1]] = until
    posted = spark.createDataFrame(rows, BATCH)
    for options in ({}, {"max_rows": 50}):
        grown, refused = M.append_values(spark.createDataFrame([], BATCH), posted, **options)
        assert {r.value_id for r in grown.collect()} == taken and grown.count() == len(taken)
        assert {r.value_id: r.last_time for r in refused.collect()} == after
    plan = grown._jdf.queryExecution().optimizedPlan().toString() + refused._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_malformed_paths_are_rejected(spark):
    good = {"type": "MovingPoint", "datetimes": ["2024-05-01T00:00:00Z", "2024-05-01T01:00:00Z"], "coordinates": [[1, 2], [3, 4]]}
    bad = [
        "no json", {**good, "coordinates": "text"}, {**good, "coordinates": [[1, 2]]}, {**good, "datetimes": ["2024-05-01T00:00:00Z", "noon"]},
        {**good, "coordinates": [[1, 2], [3]]}, {**good, "coordinates": [[1, 2], ["a", 4]]}, {**good, "datetimes": ["2024-05-01T00:00:00Z"] * 2},
        {"type": "MovingPoint"},
    ]
    def doc(path):
        return json.dumps({"type": "Feature", "id": "f", "temporalGeometry": path})
    docs = spark.createDataFrame([(doc(p),) for p in (good, json.dumps(good), *bad)] + [(json.dumps({"type": "Feature", "id": "g"}),)], "body string")
    errors = [r.error for r in documents.rejected_documents(docs).collect()]
    assert errors == [documents.BAD_PATH] * len(bad)
    assert documents.parsed_features(docs).count() == 3


def test_srid_is_safe(spark):
    from driftline.functions.text import srid_of
    rows = spark.createDataFrame([("EPSG:25832",), ("9999999999",), ("none",), (None,), ("123456789012345678901234567890",)], "c string")
    assert [r.s for r in rows.select(srid_of(F.col("c")).alias("s")).collect()] == [25832, 4326, 4326, 4326, 4326]


def test_overwriting_the_source_is_refused(spark, tmp_path):
    from driftline.sources import store
    rows = spark.createDataFrame([(1, 2)], "property_id long, value_id long")
    store.write_table(rows, "temporal_values", str(tmp_path))
    read = store.read_table(spark, "temporal_values", str(tmp_path))
    with pytest.raises(ValueError):
        store.write_table(read, "temporal_values", str(tmp_path))
    store.write_table(read, "temporal_values", str(tmp_path / "next"))
    assert store.read_table(spark, "temporal_values", str(tmp_path)).count() == 1


def test_stored_trajectories_are_near_in_space_and_time(spark, tmp_path):
    """A box and a day each leave a part of the files, whichever of them a query asks for."""
    import pyarrow.parquet as pq

    from driftline.sources.store import read_table, write_table

    draw = "xxhash64(id, {}) % 1000000 / 1000000.0"
    rows = spark.range(20_000).selectExpr(
        "id AS geom_id", "cast(id AS string) AS feature_id", "'c' AS collection_id", f"abs({draw.format(1)}) * 1000 AS xmin", f"abs({draw.format(2)}) * 1000 AS ymin",
        f"timestamp_micros(bigint(1704067200000000 + abs({draw.format(3)}) * 30 * 86400000000)) AS tmin",
    ).selectExpr("*", "xmin + 5 AS xmax", "ymin + 5 AS ymax", "tmin + interval 1 hour AS tmax")
    rows = rows.union(rows.limit(1).selectExpr("-1L", "'odd'", "'c'", "1e12", "1e12", "timestamp_micros(0)", "1e12", "1e12", "timestamp_micros(0)"))
    write_table(rows, "geometries", str(tmp_path), files=64)
    assert read_table(spark, "geometries", str(tmp_path)).count() == 20_001

    def left(*limits):
        count = 0
        files = list((tmp_path / "geometries").glob("*/*.parquet"))
        for f in files:
            columns = {c["path_in_schema"]: c["statistics"] for g in pq.read_metadata(f).to_dict()["row_groups"] for c in g["columns"]}
            count += all(columns[low]["min"] <= b and columns[high]["max"] >= a for low, high, a, b in limits)
        return count / len(files)

    assert left(("xmin", "xmax", 400, 450), ("ymin", "ymax", 400, 450)) <= 0.3
    found = read_table(spark, "geometries", str(tmp_path)).filter("tmin <= timestamp'2024-01-11' AND tmax >= timestamp'2024-01-10'")
    assert found.select(F.input_file_name().alias("f")).distinct().count() <= 0.5 * 64
