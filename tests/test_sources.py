"""Readers, sinks, the staged build and the stream."""

import json
import math

import pytest
from pyspark.sql import functions as F

from talus.operators.lines import simplify_paths
from talus.plans.build import Stage, build
from talus.sources import readers, sinks
from talus.streaming import feed, readings, sweep


def test_forest_segments(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[-120, 37], [-120.1, 37.1]]}
    multi = {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2]], [[3, 3], [4, 4]]]}
    features = [{"properties": {"TRAIL_CN": " 7 ", "Name": "A"}, "geometry": line}, {"properties": {"OBJECTID": "9"}, "geometry": multi}, {"properties": {"Name": "x"}, "geometry": line}, {"properties": {"trail_cn": "8"}, "geometry": None}]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {r.trail_id: r for r in readers.forest_segments(spark, str(tmp_path / "f.json")).collect()}
    assert set(got) == {"7", "8", "9"} and got["7"].props["name"] == "A" and len(got["9"].parts) == 2 and got["8"].parts is None
    assert (got["7"].parts[0][0].lng, got["7"].parts[0][0].lat) == (-120, 37)


def test_way_lines_skip_what_does_not_parse(spark, tmp_path):
    way = {"id": "w1", "type": "Feature", "properties": {"name": "N", "sac_scale": "hiking"}, "geometry": {"type": "LineString", "coordinates": [[i, 0] for i in range(20)]}}
    (tmp_path / "w.jsonl").write_text("\x1e" + json.dumps(way) + "\n\x1e{broken\n\n")
    ways = readers.geojson_lines(spark, str(tmp_path / "w.jsonl"))
    assert [(r.osm_id, r.name, len(r.points)) for r in ways.collect()] == [("w1", "N", 20)]
    assert readers.way_samples(ways).count() == 10


def test_opl_relations(spark, tmp_path):
    (tmp_path / "r.opl").write_text("r5 v1 dV Tname=Bay%20%Area,type=route Mw1@,w2@alternative,n3@,w4@forward\nw1 v1\n")
    rel = readers.opl_relations(spark, str(tmp_path / "r.opl"))
    row = rel.first()
    assert row.id == "5" and row.members == ["w1", "w4"] and row.tags == {"name": "Bay Area", "type": "route"}
    p = [{"lng": 0.0, "lat": 0.0}, {"lng": 1.0, "lat": 0.0}]
    ways = spark.createDataFrame([("w4", p), ("w9", p)], "osm_id string, points array<struct<lng: double, lat: double>>")
    assert [len(r.parts) for r in readers.assemble_relations(rel, ways).collect()] == [1]


def test_gpx_prefers_tracks(spark, tmp_path):
    point = lambda tag, lat: f'<{tag} lat="{lat}" lon="-120"><ele>{lat * 10}</ele></{tag}>'
    (tmp_path / "a.gpx").write_text(f"<gpx>{point('wpt', 1)}{point('wpt', 2)}<trk><trkseg>{point('trkpt', 37)}{point('trkpt', 38)}</trkseg></trk></gpx>")
    (tmp_path / "b.gpx").write_text(f"<gpx>{point('wpt', 1)}{point('wpt', 2)}</gpx>")
    (tmp_path / "c.gpx").write_text(f"<gpx>{point('wpt', 1)}</gpx>")
    rows = readers.gpx_points(spark, str(tmp_path)).collect()
    assert [(r.file[-5:], r.seq, r.lat, r.ele) for r in sorted(rows, key=lambda r: (r.file, r.seq))] == [("a.gpx", 0, 37.0, 370.0), ("a.gpx", 1, 38.0, 380.0), ("b.gpx", 0, 1.0, 10.0), ("b.gpx", 1, 2.0, 20.0)]


def test_terrain(spark):
    x, y = 1365, int((1 - math.asinh(math.tan(math.radians(37))) / math.pi) / 2 * 2**13)
    rgb = [(128 << 16) | (i << 8) | 128 for i in range(4)]
    tiles = spark.createDataFrame([(x, y, rgb, 2)], "x long, y long, rgb array<int>, size int")
    points = spark.createDataFrame([(1, 37.0, -120.0), (2, 0.0, 0.0)], "point_id long, lat double, lng double")
    got = readers.terrain_metres(tiles, points).collect()
    assert [r.point_id for r in got] == [1] and got[0].ele_m in (0.5, 1.5, 2.5, 3.5)


def test_freshness():
    assert readers.fresh(10, 5, 4, 4) and not readers.fresh(4, 5, 4, 4) and not readers.fresh(10, 5, 3, 4) and not readers.fresh(None, 5, 4, 4)


def test_details(spark, tmp_path):
    v = spark.createDataFrame([(p, i, -120 + 0.01 * i, 37 + 0.00004 * (i % 2)) for p in (1, 2) for i in range(20)], "path_id long, seq long, lng double, lat double")
    sinks.write_details(v, str(tmp_path / "d"))
    n = lambda d: sinks.read_detail(spark, str(tmp_path / "d"), 1, d).count()
    assert n("full") == n(None) == n("nonsense'; --") == 20 and n("z10") == 2
    zoom = spark.createDataFrame([(z,) for z in (None, 10.9, 11.0, 13.0, 15.0)], "z double").select(sinks.detail_for_zoom(F.col("z")).alias("d")).collect()
    assert [r.d for r in zoom] == ["full", "z10", "z12", "z14", "full"]
    assert simplify_paths(v, 5e-4).count() == 4


def test_exports(spark, tmp_path):
    p = [{"lng": -120.0, "lat": 37.0, "ele": 5.0}, {"lng": -120.1, "lat": 37.1, "ele": None}]
    df = spark.createDataFrame([(1, "A & B", [p]), (2, None, [p, p]), (3, "x", [])], "id long, name string, parts array<array<struct<lng: double, lat: double, ele: double>>>")
    sinks.write_geojson_lines(df, ["id", "name"], str(tmp_path / "g"))
    got = {f["properties"]["id"]: f for f in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "g")).collect()))}
    assert got[1]["geometry"] == {"type": "LineString", "coordinates": [[-120.0, 37.0], [-120.1, 37.1]]} and got[2]["geometry"]["type"] == "MultiLineString" and got[3]["geometry"] is None
    assert got[2]["properties"]["name"] is None
    sinks.write_csv(df, ["id", "missing", "name"], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "missing", "name"]
    r = df.filter("id = 1").select(sinks.gpx(F.col("name"), F.col("parts")[0]).alias("g"), sinks.kml(F.col("name"), F.col("parts")[0]).alias("k")).first()
    assert "A &amp; B" in r.g and r.g.count("<trkpt") == 2 and r.g.count("<ele>") == 1 and "-120.0,37.0 -120.1,37.1" in r.k
    sinks.write_index(df, ["parts"], str(tmp_path / "i"))
    assert "parts" not in spark.read.parquet(str(tmp_path / "i/trails")).columns


def test_build_survives_a_failing_stage_and_resumes(spark, tmp_path):
    trails = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    runs = []

    def good(df):
        runs.append(1)
        return df.select("id", F.length("name").alias("n"))

    stages = [Stage("n", "n int", good), Stage("bad", "m int", lambda df: df.select("nothing")), Stage("off", "o int", good)]
    index, manifest = build(spark, trails, stages, str(tmp_path), skip={"off"})
    assert {(r.id, r.n, r.m, r.o) for r in index.collect()} == {(1, 1, None, None), (2, 1, None, None)}
    assert [r.status for r in manifest.orderBy("ord").collect()] == ["ok", "failed", "skipped"]
    _, again = build(spark, trails, stages, str(tmp_path), skip={"off"}, resume=True)
    assert [r.status for r in again.orderBy("ord").collect()] == ["resumed", "failed", "skipped"] and len(runs) == 1


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = feed.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("feed_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("feed_out").collect()}
    assert got == {tuple(r) for r in feed.windowed(events).collect()} and got
    assert pytest.approx(sum(r[2] for r in got)) == events.count()


def files_read(df):
    """How many files each scan of the plan is going to open."""
    plan = df._jdf.queryExecution().sparkPlan()
    leaves = plan.collectLeaves()
    return [sum(len(p.files()) for p in leaves.apply(i).inputRDDs().head().partitions()) for i in range(leaves.length())]


def test_lookups_open_one_file(spark, tmp_path):
    v = spark.createDataFrame([(i, k, -120.0 + k * 0.01, 37.0 + (k % 2) * 0.0001 * i) for i in range(200) for k in range(5)], "path_id long, seq long, lng double, lat double")
    spark.sql("DROP TABLE IF EXISTS talus_lines")
    sinks.store_details(v, "talus_lines", str(tmp_path / "lines"), buckets=8)
    for level in ("full", "z10", None):
        one = sinks.stored_detail(spark, "talus_lines", 77, level)
        assert files_read(one) == [1] and [tuple(r)[:1] for r in one.select("path_id").distinct().collect()] == [(77,)]
    for folder in (tmp_path / "lines").glob("detail=*"):  # a bucket is one file
        assert len({f.name.split("_")[-1] for f in folder.glob("*.parquet")}) == len(list(folder.glob("*.parquet"))) == 8
    assert sinks.stored_detail(spark, "talus_lines", 77).count() == 5 > sinks.stored_detail(spark, "talus_lines", 2, "z10").count() == 2
    assert sinks.stored_detail(spark, "talus_lines", 9999).count() == 0
    t = spark.range(300).selectExpr("id", "concat('t', id) as name", "array(id) as parts")
    for name in ("trails", "geometry"):
        spark.sql(f"DROP TABLE IF EXISTS talus_index_{name}")
    sinks.store_index(t, ["parts"], "talus_index", str(tmp_path / "index"), buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = sinks.stored_trails(spark, "talus_index")
        assert "Exchange" not in both._jdf.queryExecution().toString() and both.count() == 300
        one = both.filter("id = 42")
        assert files_read(one) == [1, 1] and [tuple(r) for r in one.collect()] == [(42, "t42", [42])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("lines", "index_trails", "index_geometry"):
            spark.sql(f"DROP TABLE IF EXISTS talus_{name}")


ELEMENT = "struct<type: string, id: long, n_points: int>"


def landed(spark, path, rows):
    spark.createDataFrame(rows, f"tile_id string, status string, attempt int, at timestamp, elements array<{ELEMENT}>").write.mode("append").parquet(path)


def test_sweep_ledger(spark, tmp_path):
    """Failed tiles are read again and never count as empty; a rerun adds what is new; the same as one batch."""
    import datetime

    at = lambda n: datetime.datetime(2024, 1, 1, 0, n)
    tiles = spark.createDataFrame([(f"t{i}",) for i in range(6)], "tile_id string")
    home, land = str(tmp_path / "sweep"), str(tmp_path / "landed")
    assert {r.tile_id: r.attempt for r in sweep.left(tiles, sweep.ledger(spark, home)).collect()} == {f"t{i}": 0 for i in range(6)}
    first = [("t0", "done", 0, at(1), [("way", 1, 5), ("way", 2, 9)]), ("t1", "empty", 0, at(1), []), ("t2", "failed", 0, at(1), None), ("t3", "failed", 0, at(1), None), ("t4", "done", 0, at(2), [("way", 1, 7)])]
    landed(spark, land, first)
    schema = spark.read.parquet(land).schema

    def run():
        sweep.sweep(spark.readStream.schema(schema).parquet(land), home, str(tmp_path / "check")).awaitTermination()

    run()
    assert {r.tile_id: r.attempt for r in sweep.left(tiles, sweep.ledger(spark, home)).collect()} == {"t2": 1, "t3": 1, "t5": 0}
    assert {r.tile_id for r in sweep.incomplete(tiles, sweep.ledger(spark, home)).collect()} == {"t2", "t3", "t5"}
    again = [("t2", "done", 1, at(5), [("way", 2, 4), ("node", 2, 1)]), ("t3", "failed", 1, at(5), None)]
    landed(spark, land, again)
    run()
    run()  # nothing new
    got = {r.tile_id: (r.status, r.attempts) for r in sweep.states(sweep.ledger(spark, home)).collect()}
    assert got == {"t0": ("done", 1), "t1": ("empty", 1), "t2": ("done", 2), "t3": ("failed", 2), "t4": ("done", 1)}
    assert sweep.ledger(spark, home).count() == 7
    assert [r.tile_id for r in sweep.left(tiles, sweep.ledger(spark, home)).collect()] == ["t5"]
    assert {r.tile_id for r in sweep.incomplete(tiles, sweep.ledger(spark, home)).collect()} == {"t3", "t5"}
    found = {tuple(r) for r in sweep.elements(spark, home, ELEMENT).collect()}
    assert found == {("t4", "way", 1, 7), ("t0", "way", 2, 9), ("t2", "node", 2, 1)}
    once = str(tmp_path / "once")
    sweep.keep(spark.read.parquet(land), 0, once)
    sweep.keep(spark.read.parquet(land), 0, once)  # a repeated batch takes its own place
    assert {tuple(r) for r in sweep.elements(spark, once, ELEMENT).collect()} == found and sweep.ledger(spark, once).count() == 7


def test_readings_expire(spark, tmp_path):
    """The stream tells what the table tells; a failed reading isn't kept; state goes after its time."""
    import datetime
    import time

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(i, f"k{i % 2}", 37.0 + (i % 3) * 0.01 + (i % 5) * 1e-5, -120.0, at(i * 40), i % 4 != 1, float(i)) for i in range(60)]
    schema = "reading_id long, kind string, lat double, lng double, at timestamp, ok boolean, value double"
    land = str(tmp_path / "landed")

    def run(ttl, place):
        stream = spark.readStream.schema(schema).parquet(land)
        out = readings.stream_known(stream, ttl)
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else it goes on for timeouts, and never ends
        out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        return {r.reading_id: (r.known, r.age_s) for r in spark.read.parquet(f"{place}/out").collect()}

    spark.createDataFrame(rows[:30], schema).coalesce(1).write.mode("append").parquet(land)
    run(300, str(tmp_path / "a"))
    spark.createDataFrame(rows[30:], schema).coalesce(1).write.mode("append").parquet(land)
    got = run(300, str(tmp_path / "a"))
    table = {r.reading_id: (r.known, r.age_s) for r in readings.known(spark.createDataFrame(rows, schema), 300).collect()}
    assert got == table and any(v is None for v, _ in got.values()) and any(a for _, a in got.values())
    late = str(tmp_path / "late")
    land = str(tmp_path / "brief")
    spark.createDataFrame([(0, "k", 1.0, 1.0, at(0), True, 5.0)], schema).coalesce(1).write.mode("append").parquet(land)
    assert run(2, late) == {0: (5.0, 0)}
    time.sleep(2.5)
    spark.createDataFrame([(1, "k", 1.0, 1.0, at(1), False, None)], schema).coalesce(1).write.mode("append").parquet(land)
    assert run(2, late) == {0: (5.0, 0), 1: (None, None)}  # one second later by the readings, but the state had gone
