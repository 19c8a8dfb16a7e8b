"""Readers, archives, audits and sinks on real files."""

import hashlib
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from wayside.operators import normalize
from wayside.sources import audit, feeds, sinks


def test_event_csv_defaults_and_rejects(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("event_id,school_id,title,event_category,is_open_day,is_featured,priority_weight,starts_at,placement_tags\ne1,s1,One,,true,,0.5,2024-01-02,home|search\ne2,s1,Two,fair,,,,2024-13-40,\ne3,s1,Three,,,,,,shop\n")
    ok, bad = normalize.validate_events(feeds.read_events_csv(spark, str(path)))
    row = ok.collect()
    assert [r.event_id for r in row] == ["e1"] and row[0].event_category == "general" and row[0].details == "{}"
    assert {r.event_id: r.reason for r in bad.collect()} == {"e2": "starts_at must be a date or an RFC3339 time", "e3": "unsupported placement tag"}


def test_ndjson_and_empty_feed(spark, tmp_path):
    path = tmp_path / "e.ndjson"
    path.write_text('{"event_id":"e1","school_id":"s","title":"T","placement_tags":["home","detail"],"details":{"a":1}}\n\n{"event_id":"e2","school_id":"s","title":"T","details":[1]}\n')
    ok, bad = normalize.validate_events(feeds.read_events_ndjson(spark, str(path)))
    assert [(r.event_id, r.placement_tags, r.details) for r in ok.collect()] == [("e1", "home|detail", '{"a":1}')]
    assert [r.reason for r in bad.collect()] == ["details must be a JSON object"]
    empty = tmp_path / "none.ndjson"
    empty.write_text("\n")
    with pytest.raises(ValueError):
        feeds.read_events_ndjson(spark, str(empty))


def test_reference_readers(spark, tmp_path):
    (tmp_path / "rail.csv").write_text("station_code,station_name,line_name,prefecture_name,latitude,longitude\n0012,A,L,P,35.5,139.1\n")
    (tmp_path / "codes.csv").write_text("school_code,name,prefecture_name,city_name,school_type\nA01,N,P,C,high\n")
    (tmp_path / "postal.csv").write_text("postal_code,prefecture_name,city_name,town_name\n0010001,P,C,T\n")
    assert feeds.read_rail(spark, str(tmp_path / "rail.csv")).first().station_id == "jp_station_0012"
    assert feeds.read_school_codes(spark, str(tmp_path / "codes.csv")).first().school_id == "jp_school_A01"
    assert feeds.read_postal(spark, str(tmp_path / "postal.csv")).first().postal_code == "0010001"


def test_bundle_loads_twice_the_same(spark, tmp_path):
    (tmp_path / "stations.csv").write_text("station_id,name,line_name,latitude,longitude\nt1,A,Blue Line,35.0,139.0\n")
    (tmp_path / "schools.csv").write_text("school_id,name,area,prefecture_name,school_type,group_id\ns1,S,City,Pref,high,g\n")
    (tmp_path / "school_station_links.csv").write_text("school_id,station_id,walking_minutes,distance_meters,hop_distance,line_name\ns1,t1,5,400,0,Blue Line\n")
    (tmp_path / "events.csv").write_text("event_id,school_id,title,event_category,is_open_day,is_featured,priority_weight,starts_at,placement_tags\ne1,s1,One,,true,,0.5,,home\n")
    line = '{"user_id":"u","school_id":"s1","event_kind":"school_view","occurred_at":"2024-01-01T00:00:00Z","payload":{"a":1}}\n'
    (tmp_path / "user_events.ndjson").write_text(line + line)
    bundle = feeds.load_bundle(spark, str(tmp_path))
    assert bundle["stations"].first().line_id == "line_blue_line"
    assert {r.area_id for r in bundle["areas"].collect()} == {"area_pref", "area_pref_city"}
    assert bundle["user_events"].count() == 1 and bundle["events"].first().source_type == "seed"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "1\n2\n")
        z.writestr("y.csv", "3\n")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("z.csv")
        info.size = 4
        t.addfile(info, io.BytesIO(b"a\nb\n"))
    paths = [str(tmp_path / "a.zip"), str(tmp_path / "b.tar.gz")]
    got = {(r.member, bytes(r.content)) for r in audit.expand_archives(spark, paths).collect()}
    assert got == {("x.csv", b"1\n2\n"), ("y.csv", b"3\n"), ("z.csv", b"a\nb\n")}
    sha = hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()
    rows = [("a.zip", sha, "x.csv"), ("a.zip", sha, "gone.csv"), ("b.tar.gz", "00", None)]
    members = spark.createDataFrame(rows, "file_name string, checksum_sha256 string, member string")
    out = {(r.member, r.reason) for r in audit.expand_archives(spark, paths, members).collect()}
    assert out == {("x.csv", None), ("gone.csv", "missing member"), (None, "checksum mismatch")}


def test_file_audit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n1\n2\n")
    (tmp_path / "b.ndjson").write_text("{}\n\n{}\n")
    got = {r.file_name: (r.row_count, r.size_bytes, r.checksum_sha256) for r in audit.file_audit(spark, [str(tmp_path / n) for n in ("a.csv", "b.ndjson")]).collect()}
    assert got["a.csv"] == (2, 6, hashlib.sha256(b"h\n1\n2\n").hexdigest()) and got["b.ndjson"][0] == 2


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([(1, "u", "2024-01-01 10:00:00"), (2, "u", "2024-01-02 10:00:00")], "id long, user_id string, t string")
    log = log.select("id", "user_id", F.col("t").cast("timestamp_ntz").alias("occurred_at"))
    for _ in range(2):
        sinks.append_user_events(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("event_date").count().count() == 2
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    sinks.publish(old, str(tmp_path / "t"), 1)
    sinks.publish(new, str(tmp_path / "t"), 2)
    assert sorted(map(tuple, sinks.current(spark, str(tmp_path / "t")).collect())) == [("b", 3), ("c", 4)]


def test_readers_see_the_newest_complete_version(spark, tmp_path):
    from wayside.sources.sinks import current, publish

    path = str(tmp_path / "t")
    publish(spark.range(1), path, 1)
    publish(spark.range(2), path, 2)
    spark.range(3).write.parquet(f"{path}/version=3")  # a writer that stopped before its mark
    assert current(spark, path).count() == 2
    publish(spark.range(3), path, 3)
    assert current(spark, path).count() == 3


def test_upsert_takes_the_same_row_of_a_tie(spark):
    from wayside.sources.sinks import upsert

    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, t int")
    new = [(1, "b", 2), (1, "c", 2), (1, "d", 1), (2, "e", 1)]
    first = sorted(map(tuple, upsert(old, spark.createDataFrame(new, old.schema), ["k"], "t").collect()))
    again = sorted(map(tuple, upsert(old, spark.createDataFrame(new[::-1], old.schema), ["k"], "t").collect()))
    assert first == again and first[0][1] in "bc" and first[1] == (2, "e", 1)
