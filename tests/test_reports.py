import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline.operators import reports as R
from driftline.plans.ais_day import ais_day, profile_trips
from driftline.functions.geo import envelope
from driftline.sources import ais, export, ships

HEADER = ("# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,IMO,Callsign,"
          "Name,Ship type,Cargo type,Width,Length,Type of position fixing device,Draught,Destination,ETA,"
          "Data source type,A,B,C,D")


def line(clock, mmsi, lat, lon, sog="10.0", cog="90.0", heading="91", name="Alpha", dest="Rodby", status="Under way"):
    return (f"07/08/2024 {clock},Class A,{mmsi},{lat},{lon},{status},,{sog},{cog},{heading},IMO1,Unknown,{name},Cargo,"
            f"Undefined,10,100,GPS,5.5,{dest},,AIS,50,50,5,5")


@pytest.fixture()
def csv(tmp_path):
    rows = [
        line("00:00:00", 1, 54.5, 11.0),
        line("00:00:00", 1, 54.5, 11.0, dest="Unknown"),
        line("00:10:00", 1, 54.5, 11.05),
        line("00:20:00", 1, 54.5, 11.1, heading=""),
        line("00:30:00", 1, 54.5, 11.15, sog=""),
        line("00:00:00", 2, 10.0, 11.0, name="Unknown"),
        line("00:00:00", 3, 54.6, 11.0, dest="Undefined", status="Unknown value"),
        line("01:00:00", 3, 54.6, 11.0, name=""),
    ]
    path = tmp_path / "ais.csv"
    path.write_text("\n".join([HEADER, *rows]) + "\n")
    return str(path)


def lower(df):
    return ais.lower_names(df).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})


def test_typed_read(spark, csv):
    df = ais.read_ais_csv(spark, csv)
    assert len(df.columns) == 26 and df.count() == 8
    first = df.first()
    assert first.T == datetime(2024, 8, 7) and first.MMSI == 1 and first.Draught == 5.5
    assert set(lower(df).columns) >= {"t", "mmsi", "navigational_status", "ship_type", "type_of_position_fixing_device", "imo", "rot", "size_a"}


def test_bad_row_fails_or_is_kept(spark, csv):
    with open(csv, "a") as f:
        f.write("not a time,Class A,x,1,1\n")
    with pytest.raises(Exception):
        ais.read_ais_csv(spark, csv).select("TypeOfMobile").collect()
    kept = ais.read_ais_csv(spark, csv, keep_bad_rows=True)
    bad = [r for r in kept.collect() if r[ais.CORRUPT]]
    assert len(bad) == 1 and bad[0].T is None and kept.count() == 9


def test_pruned_read(spark, csv):
    df = ais.read_ais_profile(spark, csv)
    assert df.count() == 8 and len(df.columns) == 11
    assert df.schema["t"].dataType.simpleString() == "timestamp"
    plan = ais.read_ais_profile(spark, csv)._jdf.queryExecution().executedPlan().toString()
    assert "Callsign" not in plan


def test_cleaning(spark, csv):
    clean = R.clean_placeholders(lower(ais.read_ais_csv(spark, csv)))
    assert clean.filter("callsign is not null or cargo_type is not null").count() == 0
    assert clean.filter("navigational_status is null").count() == 1
    inside = R.domain_filter(clean)
    assert inside.count() == 6
    unique = R.dedup_reports(inside)
    assert unique.count() == 5
    # The copy with NULL destination sorts first.
    assert unique.filter("mmsi = 1 and t = timestamp'2024-08-07'").first().destination is None


def test_assembly(spark, csv):
    positions = R.dedup_reports(R.to_utm32(R.domain_filter(R.clean_placeholders(lower(ais.read_ais_csv(spark, csv))))))
    trips = {r.mmsi: r for r in R.assemble_trips(positions).collect()}
    assert len(trips[1].trip) == 3 and len(trips[1].sog) == 2 and len(trips[1].heading) == 2
    assert trips[1].name == "Alpha" and trips[1].destination == "Rodby"
    parts = R.assemble_trips(positions, max_rows=2)
    assert parts.filter("mmsi = 1").count() >= 2
    for name in ("trip", "sog", "heading"):
        own = F.when(F.col(f"joined.{name}"), F.slice(name, 2, 1000)).otherwise(F.col(name))
        whole = parts.filter("mmsi = 1").select(F.explode(own).alias("p")).select("p.t").collect()
        assert sorted(whole) == sorted((p.t,) for p in trips[1][name])
    assert {r.name for r in parts.filter("mmsi = 1").collect()} == {"Alpha"}


def test_assembly_moves_the_reports_once(spark, csv):
    """With chunks at hand: one exchange, one sort and one join less than a pass for each sequence."""
    positions = R.to_utm32(R.domain_filter(lower(ais.read_ais_csv(spark, csv)))).withColumn("chunk", F.lit(None).cast("int"))
    plan = R.assemble_trips(positions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(mmsi") == 1 and "Generate" not in plan and "Join" not in plan


def test_day_end_to_end(spark, csv, tmp_path):
    raw = lower(ais.read_ais_csv(spark, csv))
    day = ais_day(raw, belt=envelope(620000, 6030000, 660000, 6050000))
    checked = {r.mmsi: r for r in day.checked.collect()}
    assert set(checked) == {1}
    assert day.trips.count() == 1
    doc = json.loads(day.documents.first().document)
    assert doc["properties"] == {"Name": "Alpha", "IMO": "IMO1", "ShipType": "Cargo", "Destination": "Rodby"}
    assert doc["trajectory"]["type"] == "MovingPoint" and len(doc["sog"]["values"]) == 2
    export.write_ship_documents(day.documents, str(tmp_path / "out"))
    back = ships.read_ship_lines(spark, str(tmp_path / "out"))
    assert back.first().mmsi == 1 and back.first().properties.Name == "Alpha"


def test_second_profile(spark, csv):
    raw = ais.read_ais_profile(spark, csv)
    rows = {int(r.mmsi): r for r in profile_trips(raw).collect()}
    assert set(rows) == {1, 3}
    assert rows[1].trip[0].x == 11.0 and rows[1].trip[0].y == 54.5
    assert rows[3].name is None


def test_one_very_common_report(spark):
    copies = spark.range(3000).selectExpr("1 as mmsi", "timestamp'2024-01-01' as t", "id % 3 as v")
    other = spark.range(5).selectExpr("cast(id + 2 as int) as mmsi", "timestamp'2024-01-01' as t", "id as v")
    rows = R.dedup_reports(copies.union(other)).collect()
    assert len(rows) == 6 and min(r.v for r in rows if r.mmsi == 1) == 0
    counts = {r.mmsi: (r.n_reports, r.n_times) for r in R.report_counts(copies.union(other)).collect()}
    assert counts[1] == (3000, 1)


def test_ship_array(spark, tmp_path):
    path = tmp_path / "ships.json"
    path.write_text(json.dumps([{"mmsi": m, "trajectory": "{}", "properties": {"Name": str(m)}} for m in (5, 3, 9, 7)]))
    df = ships.read_ship_array(spark, str(path))
    assert sorted(r.mmsi for r in ships.ships_from(df, 1).collect()) == [5, 7, 9]
    assert [r.mmsi for r in ships.ships_from(df, at=2).collect()] == [7]
    assert ships.ships_from(df, at=0).first().mmsi == 3
    assert ships.ships_from(df, at=10).count() == 0
