"""Requests, tiles, saved files, collections, profiles and lines, against known answers and plain Python."""

import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus import plans
from talus.functions import geo, requests, sources, text
from talus.operators import elements, graph, lines, merge, search, spatial
from talus.sources import readers, sinks
from test_operators import hav
from tests_compare import connect, difference


def test_requests():
    assert requests.bounds("1,", "length") == (1.0, None) and requests.bounds(None, "length") == (None, None) and requests.bounds("2, 3", "x") == (2.0, 3.0)
    assert requests.box("-120,37,-119,38") == (-120.0, 37.0, -119.0, 38.0) and requests.box("") is None
    assert requests.words(" Lake,, PEAK ") == ["lake", "peak"] and requests.words(None) == []
    assert requests.place(0, "0.0") == (0.0, 0.0) and requests.radius(None, 2.0, 5.0) == 2.0 and requests.radius(99, 2.0, 5.0) == 5.0 and requests.radius(0, 2.0, 5.0) == 0.1
    for f, args in ((requests.bounds, ("5,1", "x")), (requests.bounds, ("a,1", "x")), (requests.bounds, ("1", "x")), (requests.box, ("1,2,3",)), (requests.box, ("190,0,191,1",)), (requests.box, ("0,5,1,4",)), (requests.place, (None, 1)), (requests.place, (91, 0)), (requests.radius, ("far", 1, 2))):
        with pytest.raises(ValueError):
            f(*args)


@pytest.mark.parametrize("lat", [0.0, 45.0, 70.0, 85.0, -85.0, 89.97])
@pytest.mark.parametrize("lng", [-119.0, 179.99])
def test_radius_join_anywhere(spark, lat, lng):
    rd = random.Random(5)
    wide = 0.1 / max(0.02, math.cos(math.radians(lat)))
    turn = lambda x: (x + 180) % 360 - 180
    spots = [(max(-90.0, min(90.0, lat + rd.uniform(-0.06, 0.06))), turn(lng + rd.uniform(-wide, wide))) for _ in range(150)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id long, lat double, lng double")
    for miles, size in ((1.0, None), (2.5, 0.01)):
        got = {(r.a, r.id) for r in spatial.radius_join(df.withColumnRenamed("id", "a"), df, miles, size).collect()}
        want = {(i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if hav(p, q) <= miles}
        assert {p for p in got ^ want if abs(hav(spots[p[0]], spots[p[1]]) - miles) > 1e-6} == set()


def png(pixels, width, colour=2):
    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    size = 3 if colour == 2 else 4
    rows, above, out = [pixels[i * width * size : (i + 1) * width * size] for i in range(len(pixels) // (width * size))], bytes(width * size), b""
    for n, row in enumerate(rows):
        kind = n % 5

        def guess(i, row=row, above=above):
            a, b, c = (row[i - size] if i >= size else 0), above[i], (above[i - size] if i >= size else 0)
            p = a + b - c
            return (0, a, b, (a + b) // 2, min((a, b, c), key=lambda x: abs(p - x)))

        out += bytes([kind]) + bytes((x - guess(i)[kind]) % 256 for i, x in enumerate(row))
        above = row
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


@pytest.mark.parametrize("colour", [2, 6])
def test_tiles_and_node_heights(spark, tmp_path, colour):
    rd, size = random.Random(2), 3 if colour == 2 else 4
    raw = bytes(rd.randrange(256) for _ in range(8 * 10 * size))
    width, got = readers.png_pixels(png(raw, 8, colour))
    assert width == 8 and got.tolist() == [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(0, len(raw), size)]
    high = b"".join(bytes([128 + (4 * k // 256), 4 * k % 256, 0] + [255] * (size - 3)) for k in range(64))
    (tmp_path / "13" / "1365").mkdir(parents=True)
    (tmp_path / "13" / "1365" / "3184.png").write_bytes(png(high, 8, colour))
    tiles = readers.terrain_tiles(spark, str(tmp_path))
    # the middle of the pixel in column 2 and row 5 of tile (1365, 3184)
    n = 2**13
    lng, lat = (1365 + 2.5 / 8) / n * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (3184 + 5.5 / 8) / n))))
    nodes = spark.createDataFrame([(1, lat, lng), (2, 0.0, 0.0)], "node long, lat double, lng double")
    found = {r.node: r.ele_ft for r in graph.node_heights(nodes, tiles).collect()}
    assert found[1] == pytest.approx(4 * (5 * 8 + 2) * 3.28084) and found[2] is None


def test_points_and_tilings(spark):
    assert geo.stepped_tiles(0.0, 0.0, 2.5, 1.0, 1.0) == [(0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0), (2.0, 0.0, 2.5, 1.0)]
    rows = [(1.0, 2.0, None), (None, None, [[1.0, 2.0], [3.0, 6.0], [5.0]]), (None, 1.0, []), (0.0, 0.0, [[9.0, 9.0]])]
    df = spark.createDataFrame(rows, "x double, y double, points array<array<double>>")
    got = [r.p for r in df.select(geo.esri_point(F.col("x"), F.col("y"), F.col("points")).alias("p")).collect()]
    assert [(p.lng, p.lat) if p else None for p in got] == [(1.0, 2.0), (2.0, 4.0), None, (0.0, 0.0)]


def test_saved_index_and_collection(spark, tmp_path):
    assert readers.saved(spark, f"{tmp_path}/none.json", "id string, lat double").count() == 0
    (tmp_path / "some.json").write_text('{"id": "a", "lat": 1.5}\n')
    assert [tuple(r) for r in readers.saved(spark, f"{tmp_path}/some.json", "id string, lat double").collect()] == [("a", 1.5)]
    line = [{"lng": 1.0, "lat": 2.0}, {"lng": 1.0, "lat": 3.0}]
    t = spark.createDataFrame([(k, f"n{k}", 2.0, 300, [line] * (1 + k % 2)) for k in range(7)], "id long, name string, length_miles double, gain_ft int, parts array<array<struct<lng: double, lat: double>>>").repartition(3)
    sinks.write_index(t, ["parts"], f"{tmp_path}/index")
    assert {r.difficulty for r in readers.index(spark, f"{tmp_path}/index").collect()} == {"easy"}
    for some, n in ((t, 7), (t.limit(0), 0)):
        sinks.write_collection(some, ["id", "name"], f"{tmp_path}/all", "here", "2024-01-01", ["t1", "t2"])
        made = json.loads("".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*"))))
        assert made["metadata"] == {"region": "here", "generated_at": "2024-01-01", "count": n, "incomplete_tiles": ["t1", "t2"]}
        assert [f["properties"]["id"] for f in made["features"]] == list(range(n)) and {f["geometry"]["type"] for f in made["features"]} <= {"LineString", "MultiLineString"}
    one = spark.createDataFrame([(line, ["fire"])], "p array<struct<lng: double, lat: double>>, f array<string>").select(sinks.map_layers(F.col("p"), F.col("f")).alias("m")).first().m
    assert json.loads(one.route)["geometry"]["coordinates"] == [[1.0, 2.0], [1.0, 3.0]] and one.fire_perimeters == ["fire"]


def test_parts_that_vanish(spark):
    spike = [(1, 0, i, float(i), 0.0) for i in range(20)] + [(1, 1, 0, 5.0, 5.0)] + [(2, 0, 0, 7.0, 7.0)]
    v = spark.createDataFrame(spike, "path_id long, part int, seq int, lng double, lat double")
    got = sorted((r.path_id, r.part, r.seq) for r in lines.simplify_parts(v, 0.1).collect())
    assert got == [(1, 0, 0), (1, 0, 19), (2, 0, 0)]


def test_profiles(spark):
    s = lambda *x: list(x)
    rows = [(1, s(100.0, 200.0, None, 150.0)), (2, s(None, None, 5.0)), (3, s(1.0)), (4, s(*[float(i) for i in range(600)]))]
    df = spark.createDataFrame(rows, "id int, h array<double>").withColumn("e", lines.elevation_summary(F.col("h"), F.transform("h", lambda h, i: i * 0.05)))
    got = {r.id: r.e for r in df.collect()}
    assert got[1].gain_ft == 100 and got[1].loss_ft == 50 and got[1].samples == 3 and [p.mi for p in got[1].profile] == [0.0, 0.05, 0.15] and got[2] is None and got[3] is None
    assert len(got[4].profile) == 250 and got[4].profile[-1].mi == pytest.approx(29.95) and got[4].max_ft == 599
    naive = spark.createDataFrame([(s(0.0, 10.0, None, 3.0, 1.0),), ([],), (s(1.0),)], "h array<double>").select(lines.naive_gain(F.col("h")).alias("g")).collect()
    assert [tuple(r.g) for r in naive] == [(33, 7), (0, 0), (0, 0)]


def test_listed_ways_and_kinds(spark):
    r = spark.createDataFrame([(1, "a", 3.0), (2, None, 9.0), (3, "b", 5.0), (4, "", 7.0)], "id int, name string, length_miles double")
    assert [x.id for x in merge.listed(r, 4.0, True).collect()] == [3] and [x.id for x in merge.listed(r, limit=2).collect()] == [2, 4]
    place = lambda lat: {"lat": lat, "lng": -120.0}
    runs = [(1, "x", 1.0, 37.0, 37.01), (2, "x", 1.0, 37.03, 37.04), (3, "x", 1.0, 37.5, 37.6), (4, "y", 1.0, 37.0, 37.01), (5, "z", 0.1, 37.0, 37.001)]
    df = spark.createDataFrame([(i, k, m, a, -120.0, b, -120.0) for i, k, m, a, b in runs], "run long, key_name string, miles double, a_lat double, a_lng double, b_lat double, b_lng double")
    assert {(x.run, x.trail) for x in graph.way_trails(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)} and place(1.0)
    tags = spark.createDataFrame([({"natural": "spring"},), ({"waterway": "river"},), ({"natural": "water", "water": "pond"},), ({"natural": "water"},), ({"waterway": "ditch"},)], "t map<string, string>")
    assert [x.k for x in tags.select(sources.water_kind(F.col("t")).alias("k")).collect()] == ["spring", "river", "pond", "lake", None]
    site = spark.createDataFrame([({"public_site_name": "No Data", "recarea_name": "Lake Area", "fee_charged": "unknown"},), ({"site_name": "X", "fee_charged": "Y", "restroom_availability": "Vault"},)], "p map<string, string>")
    got = site.select(sources.site_name(F.col("p")).alias("n"), sources.site_details(F.col("p")).alias("d")).collect()
    assert [(x.n, x.d) for x in got] == [("Lake Area", None), ("X", {"fee": "Y", "restroom": "Vault"})]
    assert spark.createDataFrame([("<p>a &amp; b&hellip;</p>",)], "h string").select(text.plain(F.col("h")).alias("t")).first().t == "a & b…"


def test_elements_and_stitching(spark):
    parts = [(1, 0, 0, -120.0, 37.0), (1, 0, 1, -120.0, 37.01), (1, 1, 0, -120.0, 37.0102), (1, 1, 1, -120.0, 37.02), (1, 2, 0, -120.0, 37.03), (1, 2, 1, -120.0, 37.04)]
    v = spark.createDataFrame(parts, "path_id long, part int, seq int, lng double, lat double")
    tags = spark.createDataFrame([(1, {"sac_scale": "hiking"})], "path_id long, tags map<string, string>")
    r = elements.records(v, tags).first()
    assert r.segments == 2 and r.max_gap_m == pytest.approx(hav((37.02, -120), (37.03, -120)) * 1609.344, abs=0.1) and r.scale_label.startswith("T1")
    assert lines.stitched([[(0.0, 0.0), (1.0, 0.0)], [(2.0, 0.0), (1.0001, 0.0)]], 35.0) == [[(0.0, 0.0), (1.0, 0.0), (1.0001, 0.0), (2.0, 0.0)]]
    assert len(lines.stitched([[(0.0, 0.0), (1.0, 0.0)], [(2.0, 0.0), (1.001, 0.0)]], 35.0)) == 2


def test_numbers_through_ranges(spark):
    rd = np.random.default_rng(1)
    rows = [(int(i), float(x)) for i, x in enumerate(rd.integers(0, 50, 2000))]
    df = spark.createDataFrame(rows, "id long, x double").repartition(5)
    got = {r.id: r.ord for r in merge.numbered(df, [F.col("x"), F.col("id")]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))] and sorted(got.values()) == list(range(2000))


def test_projection_and_detail(spark):
    t = spark.createDataFrame([(1, "a", "secret")], "id long, name string, token string")
    assert search.projected(t, search.LIST_FIELDS).columns == ["id", "name"]
    shapes = spark.createDataFrame([(2, [[1]])], "id long, parts array<array<int>>")
    profiles = spark.createDataFrame([(1, [5])], "id long, profile array<int>")
    r = search.trail_detail(t, shapes, profiles, 1).collect()
    assert len(r) == 1 and r[0].profile == [5] and r[0].parts is None and "token" not in r[0].asDict()


def test_shapes_of_edges(spark):
    """Slices between cuts: the first shape of a pair stays, long ones are thinned, loops of one node go."""
    line = [(1, i, 10 if i == 0 else 20 if i == 150 else 1000 + i, 37.0 + i * 1e-4, -120.0) for i in range(151)]
    line += [(2, i, n, 37.0, -119.0 - i * 1e-3) for i, n in enumerate([10, 2001, 20, 2003, 20, 2005, 30])] + [(3, 0, 30, 1.0, 1.0), (3, 1, 30, 1.0, 1.1)]
    v = spark.createDataFrame(line, "path_id long, seq long, node long, lat double, lng double")
    e = graph.edges(v, shapes=True)
    got = {(r.path_id, r.src, r.dst): [(p.lng, p.lat) for p in r.shape] for r in e.collect()}
    whole = [(-120.0, 37.0 + i * 1e-4) for i in range(151)]
    assert sorted(got) == [(1, 10, 20), (2, 10, 20), (2, 20, 30)] and got[1, 10, 20] == [whole[int(k * (151 / 60))] for k in range(60)] + [whole[-1]]
    assert len(got[2, 10, 20]) == 3 and len(got[2, 20, 30]) == 3
    first = {(r.src, r.dst): len(r.shape) for r in graph.edge_shapes(e).collect()}
    assert first == {(10, 20): 61, (20, 30): 3}
    plain = {(r.path_id, r.edge_no, r.src, r.dst): r.miles for r in graph.edges(v).collect()}
    assert plain == {(r.path_id, r.edge_no, r.src, r.dst): pytest.approx(r.miles) for r in e.collect()}


def test_records_of_ways_and_parks(spark):
    """Runs of a name by gaps, a loop, majorities; park parts chained in the order of segments."""
    square = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]
    lines_of = {1: square[:3], 2: square[:1:-1], 3: [(0, 200), (0, 210)], 4: [(0, 213), (0, 220)], 5: [(0, 900), (0, 910)], 6: [(0, 0), (0, 0.1)]}
    ways = [(1, 0, "Long  Trail", "A", "dirt"), (2, 1, "long trail", "B", None), (3, 2, "Gap", "B", "mud"), (4, 3, "gap", "C", "dirt"), (5, 4, "GAP ", "C", "dirt"), (6, 5, "tiny", None, None)]
    w = spark.createDataFrame(ways, "way_id long, ord long, name string, operator string, surface string")
    v = spark.createDataFrame([(k, i, -120 + x * 1e-3, 37 + y * 1e-3) for k, line in lines_of.items() for i, (x, y) in enumerate(line)], "way_id long, seq long, lng double, lat double")
    got = sorted(graph.way_records(w, v).collect(), key=lambda r: r.min_lat)
    assert [(r.name, r.route_type, r.part_count, r.segment_count, r.org, r.surface, r.ref) for r in got] == [("Long  Trail", "loop", 1, 2, "A", "dirt", 1), ("Gap", "out-and-back", 2, 3, "C", "dirt", 3), ("Gap", "out-and-back", 1, 3, "C", "dirt", 3)]
    assert got[0].id.startswith("osmw:long-trail:") and len({r.id for r in got}) == 3 and [len(p) for p in got[1].parts] == [2, 2]
    again = {r.id for r in graph.way_records(w.filter("way_id <> 5"), v).collect()}
    assert again == {r.id for r in got[:2]}
    s = spark.createDataFrame([("U", "Unit", 7, "Rim", None, None, ["a"], None), ("U", "Unit", 3, "RIM", "dirt", None, ["b"], None), ("U", "Unit", 9, "None", None, None, [], None)], "unit string, unit_name string, ord long, name string, surface string, season string, uses array<string>, miles double")
    pv = spark.createDataFrame([(7, 0, i, -120.0, 37 + i * 1e-2) for i in range(3)] + [(3, 0, i, -120.0, 37.02 + i * 1e-2) for i in range(2)] + [(3, 1, i, -121.0, 37.0 + i * 1e-2) for i in range(2)], "ord long, part int, seq int, lng double, lat double")
    r = merge.park_trails(s, vertices=pv).collect()
    assert len(r) == 1 and (r[0].part_count, r[0].segment_count, r[0].surface, r[0].uses) == (2, 2, "Dirt", ["a", "b"]) and [len(p) for p in r[0].parts] == [4, 2]
    assert r[0].length_miles == round(4 * hav((37, -120), (37.01, -120)), 2) and r[0].center_lng == -120.5


def test_lines_of_a_park_that_touch_stay_apart(spark, tmp_path):
    """Two lines of a trail, the second from the first's end on; and paths of one name that meet, as their SQL has them."""
    s = spark.createDataFrame([("U", "Unit", i, "Rim", None, None, ["a"], None) for i in range(3)], "unit string, unit_name string, ord long, name string, surface string, season string, uses array<string>, miles double")
    pv = spark.createDataFrame([(n, n // 2, 0, i, -120.0, 37 + (n + i) * 1e-2) for n in range(3) for i in range(2)], "ord long, line long, part int, seq int, lng double, lat double")
    whole, apart = merge.park_trails(s, vertices=pv.drop("line")).first(), merge.park_trails(s, vertices=pv).first()
    assert (whole.part_count, whole.point_count, [len(p) for p in whole.parts]) == (1, 4, [4])
    assert (apart.part_count, apart.point_count, [len(p) for p in apart.parts]) == (2, 5, [3, 2]) and apart.length_miles == whole.length_miles
    spark.range(0, 900_000, 4812).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    why, rows = difference(spark, connect(tmp_path), str(tmp_path), plans.queries()["park_records"], plans.oracle_sql()["park_records"])
    assert why is None and rows == 1


def test_permits_along_paths(spark):
    v = spark.createDataFrame([(1, i, 37.0, -120.0 + i * 0.01) for i in range(25)] + [(2, 0, 37.0, -120.0)], "path_id long, seq long, lat double, lng double")
    places = [(1, "near", ["Blue Dome Trail"], True, 37.0, -119.88), (2, "near, no permit", None, False, 37.0, -120.0), (3, "far", ["Dome"], True, 37.2, -120.0), (4, "further", None, True, 37.3, -120.0), (5, "fourth", None, True, 37.4, -120.0), (6, "out", None, True, 39.0, -120.0)]
    p = spark.createDataFrame(places, "id long, permit string, keywords array<string>, is_permit boolean, lat double, lng double")
    names = spark.createDataFrame([(1, "blue dome"), (2, "")], "path_id long, name string")
    got = sorted(tuple(r) for r in spatial.permits_near(v, p, names).collect())
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [(1, 1, 1, False), (1, 3, 2, True), (1, 4, 3, True), (2, 1, 1, True), (2, 3, 2, True), (2, 4, 3, True)]
    assert got[0][3] == 0.0 and got[3][3] == pytest.approx(hav((37, -120), (37, -119.88)), abs=1e-3)


def test_pages_of_the_map_keep_their_order(spark):
    t = spark.createDataFrame([(i, i, f"t{i}", float((i * 37) % 1000)) for i in range(1000)], "id long, ord long, name string, length_miles double")
    for c in ("gain_ft", "max_elevation_ft"):
        t = t.withColumn(c, F.lit(None).cast("double"))
    t = t.withColumns({"features": F.array(F.lit("x")), "season_months": F.lit(None).cast("array<int>"), "uses": F.lit(None).cast("map<string, string>"), "wilderness": F.lit(None).cast("string"), "route_type": F.lit(None).cast("string"), "accessible": F.lit(None).cast("string")})
    shapes = t.select("id", F.array(F.array(F.lit(1))).alias("parts"))
    drawn, counts = search.map_features(t, shapes, search.Filters(), 5000)
    rows = drawn.collect()
    assert len(rows) == search.MAP_LIMIT == 600 and [r.length_miles for r in rows] == [float(x) for x in range(999, 399, -1)]
    assert tuple(counts.first()) == (1000, 600, True)


WALKED = {
    "loop": [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], "lollipop": [(0, 0), (0, 10), (10, 10), (10, 20), (0, 10), (0, 0)], "point-to-point": [(0, 0), (0, 10), (0, 20), (0, 30), (0, 40), (0, 50), (0, 60), (0, 50)],
    "out-and-back": [(0, 0), (0, 10), (0, 20), (0, 10), (0, 0)], "unknown": [(0, 0)],
}


def test_kinds_of_routes(spark):
    """Every branch, and those that grids and closeness decide."""
    cases = [(k, 0, way) for k, way in WALKED.items()]
    cases += [("out-and-back", 0, [(0, 0), (0, 10), (0, 20), (0, 10)]), ("network", 1, [(0, 0), (0, 10)]), ("point-to-point", 0, [(0, 0), (0, 0.1), (0, 0), (0, 0.1), (0, 30)])]
    cases += [("loop", 0, [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0.44)]), ("point-to-point", 0, [(0, 0), (0, 10), (10, 10), (10, 0), (0.0, 0.46)]), ("loop", 0, [(0, 0), (0, 0)])]
    rows = [(i, r, n, 37 + y * 1e-3, -120 + x * 1e-3) for i, (_, run, way) in enumerate(cases) for n, (x, y) in enumerate(way) for r in (n if run else 0,)]
    df = spark.createDataFrame(rows, "path_id long, run int, seq long, lat double, lng double")
    got = {r.path_id: r.route_type for r in lines.route_type(df, run="run").collect()}
    assert [got[i] for i in range(len(cases))] == [k for k, *_ in cases]


def slow_chained(parts, near, snap):
    """Every waiting part tried at each step."""
    cell = lambda p: (round(p[0] / near), round(p[1] / near))
    meet = (lambda p, q: cell(p) == cell(q)) if snap else (lambda p, q: abs(p[0] - q[0]) < near and abs(p[1] - q[1]) < near)
    waiting, chains = [list(p) for p in parts if len(p) > 1], []
    while waiting:
        chain = waiting.pop(0)
        grown = True
        while grown:
            grown = False
            for k, p in enumerate(waiting):
                back = p[::-1]
                for joined, ok in ((chain + p[1:], meet(chain[-1], p[0])), (chain + back[1:], meet(chain[-1], p[-1])), (p[:-1] + chain, meet(chain[0], p[-1])), (back[:-1] + chain, meet(chain[0], p[0]))):
                    if ok:
                        chain, grown = joined, True
                        del waiting[k]
                        break
                if grown:
                    break
        chains.append(chain)
    return chains


@pytest.mark.parametrize("snap", [False, True])
def test_chains_equal_those_of_a_scan(snap):
    rd = np.random.default_rng(7)
    for _ in range(400):
        at = lambda: (float(rd.integers(0, 4)) + float(rd.integers(-2, 3)) * 3e-5, float(rd.integers(0, 3)) + float(rd.integers(-2, 3)) * 3e-5)
        parts = [[at() for _ in range(rd.integers(1, 4))] for _ in range(rd.integers(0, 14))]
        assert lines.chained(parts, snap=snap) == slow_chained(parts, lines.JOIN_DEG, snap)


@pytest.mark.parametrize("near, metres, snap", [(lines.JOIN_DEG, 0.0, False), (lines.JOIN_DEG, 35.0, True), (3e-4, 60.0, False)])
def test_networks_give_the_same_chains(spark, near, metres, snap):
    """Networks of every size in two paths, at several latitudes, chained apart and whole."""
    rd = np.random.default_rng(5)
    rows = []
    for path, lat in ((1, 37.0), (2, 69.9995)):
        for part in range(150):
            x, y = rd.integers(0, 9, 2)
            for seq in range(int(rd.integers(1, 4))):
                rows.append((path, part, seq, 10 + (float(x) + float(rd.integers(-3, 4)) * 0.3) * 1e-3, lat + (float(y) + float(rd.integers(-3, 4)) * 0.3) * 1e-3 / 2))
                x, y = x + rd.integers(0, 2), y + rd.integers(0, 2)
    df = spark.createDataFrame(rows, "path_id long, part int, seq int, lng double, lat double")
    whole, apart = ({tuple(r) for r in f(df, near, metres, snap).collect()} for f in (lines.chain_paths, lines.chain_networks))
    assert whole == apart and len({r[:2] for r in whole}) > 20


def slow_stitched(chains, metres):
    """The closest two ends looked for anew after each join."""
    chains = [list(c) for c in chains]
    while True:
        far = [(hav(a[i][::-1], b[j][::-1]) * 1609.344, x, y, i, j) for x, a in enumerate(chains) for y, b in enumerate(chains) if x < y for i in (0, -1) for j in (0, -1)]
        if not far or min(far)[0] > metres:
            return chains
        _, x, y, i, j = min(far)
        other = chains.pop(y)
        chains[x] = (chains[x] if i else chains[x][::-1]) + (other[::-1] if j else other)


def test_stitches_equal_a_search_of_all_ends():
    rd = np.random.default_rng(8)
    for _ in range(200):
        chains = [[tuple(float(v) for v in rd.uniform(0, 2e-3, 2)) for _ in range(rd.integers(1, 4))] for _ in range(rd.integers(0, 9))]
        assert lines.stitched(chains, 60.0) == slow_stitched(chains, 60.0)


def test_many_parts_chain_in_linear_time():
    rd = np.random.default_rng(2)
    order = rd.permutation(100_000)
    parts = [[(float(i), 0.0), (float(i + 1), 0.0)][:: 1 if i % 3 else -1] for i in order]
    assert [len(c) for c in lines.chained(parts)] == [100_001]


def test_flat_tags_and_networks(spark):
    parts = [(1, 0, 0, -120.0, 37.0), (1, 0, 1, -120.0, 37.01), (1, 1, 0, -121.0, 37.0), (1, 1, 1, -121.0, 37.01), (2, 0, 0, 1.0, 1.0), (2, 0, 1, 1.0, 2.0), (3, 0, 0, 1.0, 1.0)]
    v = spark.createDataFrame(parts, "path_id long, part int, seq int, lng double, lat double")
    tags = spark.createDataFrame([(1, {"ref": "é\n\"", "mtb:scale": "2", "b": "x]"})], "path_id long, tags map<string, string>")
    got = {r.path_id: r for r in elements.records(v, tags).collect()}
    assert sorted(got) == [1, 2] and got[1].route_type == "network" and got[2].route_type == "point-to-point"
    assert (got[1].tags_json, got[1]["mtb:scale"], got[1].name) == ('{"b": "x]", "mtb:scale": "2", "ref": "é\\n\\""}', "2", None) and got[2].tags_json == "{}"


def test_queries_run_from_another_folder(tmp_path):
    """Tasks find the package though the driver's folder isn't the repository's."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "900m").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import sys
sys.path.insert(0, sys.argv[1])
from talus import plans
print("rows", plans.queries()["chain_lines"](spark, "/root/testdata/sf0.001").count())
"""
    home = str(Path(__file__).resolve().parents[1])
    got = subprocess.run([sys.executable, "-c", code, home], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows " in got.stdout and int(got.stdout.split("rows ")[1].split()[0]) > 1500, got.stderr[-2000:]
