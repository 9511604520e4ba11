"""Spatial joins, lines, merging, search, rules and graph, against brute force and known answers."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talus.operators import graph, lines, merge, rules, search, spatial
from talus.operators.search import Filters


def hav(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def places():
    rd = random.Random(1)
    spot = lambda: (rd.uniform(36.5, 37.5), rd.uniform(-120.5, -119.5))
    return [spot() for _ in range(60)], [spot() for _ in range(80)]


@pytest.mark.parametrize("miles", [0.5, 3.0, 20.0])
def test_radius_join(spark, places, miles):
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(places[0])], "a long, lat double, lng double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(places[1])], "id long, lat double, lng double")
    got = {(r.a, r.id): r.distance_raw for r in spatial.radius_join(left, right, miles).collect()}
    want = {(i, j): hav(p, q) for i, p in enumerate(places[0]) for j, q in enumerate(places[1]) if hav(p, q) <= miles}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_radius_join_is_hashed(spark, places):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places[0])], "a long, lat double, lng double")
    plan = spatial.radius_join(df, df.withColumnRenamed("a", "b"), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_near_path_takes_sampled_vertices_and_first_of_ties(spark):
    v = spark.createDataFrame([(1, i, 37.0, -120.0 + 0.001 * i) for i in range(7)] + [(2, 0, 10.0, 10.0)], "path_id long, seq long, lat double, lng double")
    p = spark.createDataFrame([(5, "lake", 37.0, -119.9985), (6, "peak", 40.0, 0.0)], "id long, kind string, lat double, lng double")
    r = spatial.near_path(v, p, 0.5, stride=3).collect()
    assert [(x.path_id, x.id, x.seq, x.kind) for x in r] == [(1, 5, 0, "lake")] and r[0].distance_mi == round(hav((37.0, -120.0), (37.0, -119.9985)), 3)


def ring(*xy):
    return [{"lng": float(x), "lat": float(y)} for x, y in xy]


def test_polygons(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    hole = ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))
    notch = ring((0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10), (0, 0))
    rows = [(1, 5.0, 5.0, [square]), (2, 5.0, 5.0, [square, hole]), (3, 2.0, 5.0, [square, hole]), (4, 5.0, 6.0, [notch]), (5, 1.0, 6.0, [notch]), (6, 11.0, 5.0, [square])]
    df = spark.createDataFrame(rows, "i int, x double, y double, rings array<array<struct<lng: double, lat: double>>>")
    got = df.select("i", spatial.in_polygon(F.col("x"), F.col("y"), F.col("rings")).alias("in")).orderBy("i").collect()
    assert [r["in"] for r in got] == [True, False, True, False, True, False]


def test_cells_of_polygons(spark):
    """Stars with holes and spikes, many sizes of cells, against rings as a whole; corners on cell borders as well."""
    rd = np.random.default_rng(11)
    areas = []
    for i in range(12):
        x, y, n = rd.uniform(-1, 1), rd.uniform(-1, 1), int(rd.integers(3, 60))
        turn = np.sort(rd.uniform(0, 2 * np.pi, n))
        star = lambda r, t: [(round(float(x + a * np.cos(b)), 2), round(float(y + a * np.sin(b)), 2)) for a, b in zip(r, t)]
        outer, hole = star(rd.uniform(0.4, 1.0, n), turn), star(np.full(5, 0.2), np.linspace(0, 6, 5))
        areas.append((i, f"a{i}", [ring(*outer, outer[0]), *([ring(*hole, hole[0])] if i % 2 else [])]))
    a = spark.createDataFrame(areas, "ord long, name string, rings array<array<struct<lng: double, lat: double>>>")
    xy = [(float(p), float(q)) for p, q in rd.uniform(-2.2, 2.2, (3000, 2))] + [(round(float(p), 2) + 0.0013, round(float(q), 2) + 0.0017) for p, q in rd.uniform(-2, 2, (2000, 2))]
    points = spark.createDataFrame([(i, q, p) for i, (p, q) in enumerate(xy)], "id long, lat double, lng double")
    whole = points.crossJoin(a).filter(spatial.in_polygon(F.col("lng"), F.col("lat"), F.col("rings"))).groupBy("id").agg(F.min("ord").alias("o"))
    want = {r.id: r.o for r in whole.collect()}
    for size in (0.03, 0.1, 0.5, 5.0):
        got = {r.id: r.area_ord for r in spatial.area_of_points(points, a, size).collect()}
        assert len(got) == len(xy) and {k: v for k, v in got.items() if v is not None} == want
    kept = spatial.ring_cells(a, 0.1).agg(F.sum(F.size("edges"))).first()[0]
    assert kept < 40 * sum(len(r) for _, _, rings in areas for r in rings)


def test_cells_of_a_large_polygon(spark):
    """A border of 100,000 vertices: no cell holds more than its own part."""
    n = 100_000
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = 1 + 0.1 * np.sin(40 * t)
    outer = [(float(x), float(y)) for x, y in zip(r * np.cos(t), r * np.sin(t))]
    rows = [(0, "big", k, *p) for k, p in enumerate([*outer, outer[0]])]
    v = spark.createDataFrame(rows, "ord long, name string, k long, lng double, lat double")
    a = v.groupBy("ord", "name").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("k", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat")))).alias("rings"))
    most = spatial.ring_cells(a, 0.05).agg(F.max(F.size("edges")), F.sum(F.size("edges"))).first()
    assert most[0] < n / 50 and most[1] < 1.1 * n
    rd = np.random.default_rng(4)
    xy = rd.uniform(-1.2, 1.2, (2000, 2))
    points = spark.createDataFrame([(i, float(q), float(p)) for i, (p, q) in enumerate(xy)], "id long, lat double, lng double")
    got = {x.id: x.area_ord == 0 for x in spatial.area_of_points(points, a, 0.05).collect()}
    far, turn = np.hypot(*xy.T), np.arctan2(xy[:, 1], xy[:, 0])
    clear = np.abs(far - (1 + 0.1 * np.sin(40 * turn))) > 1e-3
    assert all(got[i] == (far[i] < 1 + 0.1 * np.sin(40 * turn[i])) for i in np.flatnonzero(clear))


def slow_segment(p, a, b):
    east = lambda x, y: (x - y + 180) % 360 - 180
    k = math.cos(math.radians(p[0]))
    ax, ay, dx, dy = east(a[1], p[1]) * k, a[0] - p[0], east(b[1], a[1]) * k, b[0] - a[0]
    t = min(1, max(0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy else 0
    return hav(p, (p[0] + ay + t * dy, p[1] + (ax + t * dx) / k))


@pytest.mark.parametrize("lat, lng, reach", [(37, -120, 1.0), (70, 25, 0.7), (-70, 179.9, 2.0), (0, -180, 0.3), (86, 10, 3.0)])
def test_segments_within_reach(spark, lat, lng, reach):
    """Long and short segments and points round a place, also across the 180th meridian."""
    rd = np.random.default_rng(3)
    wide = 0.1 / math.cos(math.radians(lat))
    at = lambda spread: (lat + rd.uniform(-0.1, 0.1) * spread, (lng + rd.uniform(-wide, wide) * spread + 180) % 360 - 180)
    segments = [(i, *(a := at(2)), *(at(2) if i % 4 else (a if i % 8 else (a[0] + 0.001, a[1])))) for i in range(60)]
    points = [(i, *at(1.5)) for i in range(80)]
    p = spark.createDataFrame(points, "id long, lat double, lng double")
    s = spark.createDataFrame(segments, "s long, a_lat double, a_lng double, b_lat double, b_lng double")
    near = spatial.near_segments(p, s, reach).groupBy("id", "s").agg(F.min("near.d").alias("d"))
    got = {(r.id, r.s): r.d for r in near.collect()}
    want = {(i, k): d for i, *q in points for k, a, b, c, e in segments if (d := slow_segment(q, (a, b), (c, e))) <= reach}
    assert got.keys() == want.keys() and len(want) > 50 and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    line = spatial.nearest_line(p, s.select(F.col("s").alias("path_id"), F.lit(0).alias("seq"), "a_lat", "a_lng", "b_lat", "b_lng"), reach)
    assert {r.id: r.path_id for r in line.collect()} == {i: min((round(d, 6), k) for (j, k), d in want.items() if j == i)[1] for i in {i for i, _ in want}}


def test_lines_as_segments(spark):
    v = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 5, 3.0, 4.0), (1, 9, 5.0, 6.0), (2, 0, 7.0, 8.0)], "path_id long, seq long, lat double, lng double")
    assert sorted(tuple(r) for r in spatial.segments_of(v).collect()) == [(1, 0, 1.0, 2.0, 3.0, 4.0), (1, 5, 3.0, 4.0, 5.0, 6.0), (2, 0, 7.0, 8.0, 7.0, 8.0)]


def slow_fold(series, threshold=15.0):
    gain = loss = way = 0
    anchor = series[0]
    for x in series:
        move = x - anchor
        if abs(move) >= threshold or way * move > 0:
            gain, loss, anchor = gain + max(move, 0), loss + max(-move, 0), x
            way = (1 if move > 0 else -1) if abs(move) >= threshold else way
    return gain, loss


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.lists(st.integers(0, 59), max_size=5))
def test_slices_fold_to_the_whole(series, cuts):
    """Whatever the cuts, and whatever came before a slice."""
    bounds = [0, *sorted(c % len(series) for c in cuts), len(series)]
    slices = [lines.turns(np.array(series[a:b], float), 15.0) for a, b in zip(bounds, bounds[1:])]
    kept = []
    for s in slices:
        kept = lines.turns(np.array(s), 15.0, kept)
    assert lines.folded(kept, 15.0) == slow_fold(series) == lines.folded([float(x) for x in series], 15.0)
    for first in ([0, 20], [60, 40], [30], [30, 50, 33]):
        assert lines.folded([*map(float, first), *slices[-1]], 15.0) == slow_fold([*first, *series[bounds[-2] :]])


def test_gains_of_long_and_short_series(spark):
    rd = np.random.default_rng(6)
    long = np.cumsum(rd.normal(0, 4, 30_000))
    rows = [("long", i, float(x)) for i, x in enumerate(long)] + [(f"s{k}", i, float(x)) for k in range(300) for i, x in enumerate(rd.uniform(0, 100, k % 7))] + [("none", 0, None), ("s6", 99, None), (None, 1, 5.0), (None, 2, 50.0)]
    df = spark.createDataFrame([(k, i, x) for k, i, x in rows], "name string, i int, x double").repartition(8)
    got = {r.name: (round(r.gain, 6), round(r.loss, 6), r.n) for r in lines.gains(df, "name", ["i"], "x").collect()}
    series = {}
    for k, _, x in rows:
        if x is not None:
            series.setdefault(k, []).append(x)
    want = {k: (*(round(v, 6) for v in slow_fold(s)), len(s)) for k, s in series.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    assert "collect" not in lines.gains(df, "name", ["i"], "x")._jdf.queryExecution().toString()
    assert len(lines.turns(long, 15.0)) < len(long) / 4


def test_few_rows_are_spread(spark):
    rd = np.random.default_rng(5)
    many = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rd.uniform(-1, 1, (300, 2)))], "a long, lat double, lng double")
    few = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rd.uniform(-1, 1, (9, 2)))], "b long, lat double, lng double")
    pairs = [{(r.a, r.b) for r in spatial.radius_join(many, few, 30.0, spread=side).collect()} for side in ("left", "right")]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100


def test_area_of_paths(spark):
    points = [(1, k, "A" if k < 6 else None, 0 if k < 6 else None) for k in range(10)] + [(2, k, "B" if k == 0 else None, 1 if k == 0 else None) for k in range(12)] + [(3, 0, "A", 0), (3, 1, "B", 1)]
    df = spark.createDataFrame(points, "path_id long, k int, area_name string, area_ord long")
    got = {r.path_id: (r.area_name, r.inside_fraction, r.fully_inside) for r in spatial.area_of_paths(df).collect()}
    assert got == {1: ("A", 0.6, False), 2: (None, 0.083, False), 3: ("A", 1.0, True)}


def test_merge_points(spark):
    schema = "id string, kind string, name string, lat double, lng double, ord long"
    a = spark.createDataFrame([("p1", "lake", "Blue", 37.0, -120.0, 0), ("p2", "peak", "Top", 37.5, -120.0, 1)], schema)
    b = spark.createDataFrame(
        [("s1", "lake", "blue", 37.00002, -120.0, 0), ("s2", "lake", None, 37.00002, -120.0, 1), ("s3", "lake", "Green", 37.0, -120.0, 2), ("s4", "peak", "Blue", 37.0, -120.0, 3), ("s5", "spring", "One", 38.0, -120.0, 4), ("s6", "spring", "One", 38.001, -120.0, 5), ("s7", "spring", "One", 38.005, -120.0, 6)],
        schema,
    )
    assert {r.id for r in spatial.merge_points(a, b).collect()} == {"p1", "p2", "s3", "s4", "s5", "s7"}


def series(spark, values, f):
    return f(spark.createDataFrame([(values,)], "v array<double>").select(lines.gain_loss(F.col("v")).alias("g")).first().g)


@pytest.mark.parametrize(
    "values, want",
    [([5000.0 + 10 * i for i in range(101)], (1000, 0)), ([6000.0 - 10 * i for i in range(101)], (0, 1000)), ([], (0, 0)), ([100.0], (0, 0)), ([*range(0, 1001, 20), *range(1000, -1, -20), *range(0, 1001, 20)], (2000, 1000))],
)
def test_gain(spark, values, want):
    assert series(spark, [float(v) for v in values], lambda g: (round(g.gain, 1), round(g.loss, 1))) == want


def test_gain_ignores_noise(spark):
    rd = random.Random(7)
    noise = [1000 + rd.uniform(-7, 7) for _ in range(400)]
    assert series(spark, noise, lambda g: g.gain) == 0 and sum(max(0, b - a) for a, b in zip(noise, noise[1:])) > 500
    ramp = [1000 + 2.5 * i + rd.uniform(-4, 4) for i in range(401)]
    assert 900 <= series(spark, ramp, lambda g: g.gain) <= 1100


def test_steps_and_midpoint(spark):
    v = spark.createDataFrame([(1, i, 37.0 + 0.01 * x, -120.0) for i, x in enumerate((0, 1, 2, 6))], "path_id long, seq long, lat double, lng double")
    mile = hav((37.0, 0), (37.01, 0))
    assert [r.run_mi for r in lines.steps(v).orderBy("seq").collect()] == pytest.approx([0, mile, 2 * mile, 6 * mile], rel=1e-6)
    assert lines.midpoints(v).first().seq == 3
    at = lines.point_at_mile(v, F.lit(4 * mile)).first()
    assert at.lat == pytest.approx(37.04, abs=1e-6)


def test_simplify():
    straight = np.column_stack([np.linspace(0, 1, 50), np.zeros(50)])
    assert lines.simplified(straight, 1e-5).sum() == 2
    zigzag = np.column_stack([np.arange(21) * 0.01, [0.01 * (i % 2) for i in range(21)]])
    assert lines.simplified(zigzag, 1e-5).sum() == 21
    rng = np.random.default_rng(1)
    assert lines.simplified(np.cumsum(rng.normal(size=(20000, 2)), axis=0), 1.0)[[0, -1]].all()


def test_chains():
    a, b, c = [(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (2.0, 0.0)], [(3.0, 0.0), (2.0, 0.0)]
    assert lines.chained([a, b]) == [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]
    assert lines.chained([a, b, c]) == [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]]
    assert len(lines.chained([a, c])) == 2 and lines.chained([[(0.0, 0.0)]]) == []
    assert lines.chained([b, a]) == [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]


def test_thinned_and_resampled(spark):
    points = [{"lng": -120.0, "lat": 37.0 + 0.0001 * i} for i in range(100)]
    df = spark.createDataFrame([(points,)], "p array<struct<lng: double, lat: double>>")
    r = df.select(lines.thinned(F.col("p"), 0.05).alias("t"), lines.resampled(F.col("p"), 5).alias("s")).first()
    assert r.t[0] == r.s[0] and r.t[-1].lat == r.s[-1].lat == points[-1]["lat"] and len(r.s) == 5
    assert all(hav((a.lat, 0), (b.lat, 0)) >= 0.05 for a, b in zip(r.t[:-2], r.t[1:-1]))


def test_majority_breaks_ties_by_first_seen(spark):
    rows = [(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (2, 0, None), (3, 5, "z")]
    got = {r.k: r.v for r in merge.majority(spark.createDataFrame(rows, "k int, o int, v string"), "k", "v", "o").collect()}
    assert got == {1: "b", 3: "z"}


def test_segments_to_trails(spark):
    rows = [("t", 0, "A", "dirt", 3, 1.5), ("t", 1, "A", None, 2, None), ("u", 0, None, "dirt", 1, 1.0), ("w", 0, "W", None, None, None)]
    got = {r.trail_id: r for r in merge.segments_to_trails(spark.createDataFrame(rows, "trail_id string, ord long, name string, surface string, trail_class int, miles double")).collect()}
    assert set(got) == {"t", "w"} and got["t"].miles == 1.5 and got["t"].length_partial and got["t"].trail_class == 2 and got["w"].miles is None


TRAIL = "id string, ord long, name string, area string, length_miles double, gain_ft int, max_elevation_ft int, route_type string, season_months array<int>, features array<string>, uses map<string, boolean>, wilderness string, accessible string, min_lng double, max_lng double, min_lat double, max_lat double"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("a", 0, "Mount Whitney Trail", "Inyo", 10.0, 6000, None, "loop", None, ["lake"], {"horse": True}, "John Muir", None, 0.0, 1.0, 0.0, 1.0),
        ("b", 1, "Whitney Butte", "Inyo", 3.0, None, None, "out-and-back", [7, 8], [], {"atv": True}, None, None, 0.0, 1.0, 0.0, 1.0),
        ("c", 2, "Lost Creek", None, None, 500, None, None, [1], None, None, "John Muir", None, 5.0, 6.0, 5.0, 6.0),
        ("d", 3, "Lost Coast", "Kings", 10.0, 100, None, None, None, ["lake", "peak"], None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, TRAIL)


@pytest.mark.parametrize(
    "f, want",
    [
        (Filters(), "abcd"), (Filters(length=(5, None)), "ad"), (Filters(gain=(None, 600)), "cd"), (Filters(month=7), "abd"), (Filters(month=1), "acd"),
        (Filters(activity="hiking"), "acd"), (Filters(activity="motorized"), "b"), (Filters(activity="backpacking"), "acd"), (Filters(activity="horse"), "a"),
        (Filters(features=["lake"]), "ad"), (Filters(features=["lake", "peak"], all_features=True), "d"), (Filters(wilderness="John Muir"), "ac"),
        (Filters(wilderness_only=True, route_type="loop"), "a"), (Filters(box=(0.5, 0.5, 2, 2)), "ab"), (Filters(difficulty=["very strenuous"]), "a"), (Filters(text="whitney"), "ab"), (Filters(text="zz"), ""),
    ],
)
def test_search(index, f, want):
    assert "".join(sorted(r.id for r in search.search(index, f).collect())) == want


def test_sorts_are_stable_and_place_unknowns(index):
    order = lambda s: "".join(r.id for r in search.search(index, Filters(), s).collect())
    assert order("length") == "adbc" and order("length_asc") == "cbad" and order("gain") == "acdb" and order("name") == "dcab"
    assert order("relevance") == "adbc"


def test_text_ranks_exact_names_first(index):
    assert [r.id for r in search.search(index, Filters(text="Lost Coast")).collect()][0] == "d"


def test_facets_leave_out_their_own_filter(index):
    got = {(r.dimension, r.value): r.n for r in search.facets(index, Filters(wilderness="John Muir", route_type="loop")).collect()}
    assert got["wilderness", "John Muir"] == 1 and got["route_type", "loop"] == 1 and ("route_type", "out-and-back") not in got
    assert got["difficulty", "very strenuous"] == 1 and got["difficulty", "easy"] == 0 and got["activity", "motorized"] == 0
    whole = {(r.dimension, r.value): r.n for r in search.facets(index, Filters()).collect()}
    assert whole["features", "lake"] == 2 and whole["difficulty", "unknown"] == 2 and whole["activity", "hiking"] == 3


def test_dots(spark):
    p = "struct<lng: double, lat: double>"
    df = spark.createDataFrame([("a", 0, "A", {"lng": 1.0, "lat": 2.0}, None), ("b", 1, "B", None, {"lng": 3.0, "lat": 4.0}), ("c", 2, "C", None, None)], f"id string, ord long, name string, marker {p}, center {p}")
    dots, summary = search.dots(df, 10)
    s = summary.first()
    assert [(r.id, r.lng) for r in dots.collect()] == [("a", 1.0), ("b", 3.0)] and (s.total, s.unmappable, s.truncated) == (3, 1, False)


TRIP = "weather_status string, periods array<struct<name: string, short: string, temp: double, wind: string>>, covers_dates boolean, alerts_status string, alerts array<struct<event: string, severity: string>>, aqi_status string, aqi array<double>, fire_status string, fires array<struct<distance_mi: double, days: int>>, fire_truncated boolean, snow_status string, snow_depth double, snow_fall double, water_status string, water_count long"
CLEAR = {"weather_status": "ok", "periods": [("Sat", "Sunny", 70.0, "5 mph")], "covers_dates": True, "alerts_status": "ok", "alerts": [], "aqi_status": "ok", "aqi": [40.0], "fire_status": "ok", "fires": [], "fire_truncated": False, "snow_status": "ok", "snow_depth": 0.0, "snow_fall": 0.0, "water_status": "ok", "water_count": 3}


@pytest.mark.parametrize(
    "change, status",
    [
        ({}, "go"), ({"periods": [("S", "Blizzard Conditions", 40.0, None)]}, "no-go"), ({"periods": [("S", "Sunny", 8.0, None)]}, "no-go"), ({"periods": [("S", "Sunny", 28.0, None)]}, "caution"),
        ({"periods": [("S", "Sunny", 60.0, "10 to 45 mph")]}, "no-go"), ({"periods": [("S", "Sunny", 108.0, None)]}, "no-go"), ({"periods": []}, "incomplete"), ({"covers_dates": False}, "incomplete"),
        ({"alerts": [("Red Flag Warning", None)]}, "no-go"), ({"alerts": [("Wind Advisory", "Minor")]}, "caution"), ({"alerts_status": None}, "incomplete"), ({"aqi": [None, 155.0]}, "no-go"),
        ({"aqi": [120.0]}, "caution"), ({"aqi": []}, "incomplete"), ({"fires": [(3.0, 2)]}, "caution"), ({"fires": [(80.0, 2)]}, "go"), ({"fires": [(3.0, 2000)]}, "go"), ({"fires": [(None, None)]}, "caution"),
        ({"fire_truncated": True}, "incomplete"), ({"snow_depth": 20.0}, "caution"), ({"snow_depth": None, "snow_fall": None}, "incomplete"), ({"water_count": 0}, "caution"), ({"water_status": None, "water_count": 0}, "go"),
        ({"aqi_status": "unavailable", "periods": [("S", "Heavy Snow", 40.0, None)]}, "no-go"),
    ],
)
def test_verdicts(spark, change, status):
    row = CLEAR | change
    v = rules.verdicts(spark.createDataFrame([tuple(row[c.split(":")[0]] for c in CLEAR)], TRIP)).first()
    assert v.status == status
    ranks = [rules.RANKS[r.severity] for r in v.reasons]
    assert ranks == sorted(ranks, reverse=True) and v.complete == (not v.unavailable_checks)


def grid(spark, paths):
    return spark.createDataFrame([(p, i, x * 1000 + y, 37 + y * 0.01, -120 + x * 0.01) for p, nodes in paths.items() for i, (x, y) in enumerate(nodes)], "path_id long, seq long, node long, lat double, lng double")


def test_graph(spark):
    v = grid(spark, {1: [(0, 0), (1, 0), (2, 0), (3, 0)], 2: [(1, 1), (1, 0), (1, 2)], 3: [(9, 9), (9, 9)]})
    assert {r.node for r in graph.junctions(v).collect()} == {1000}
    e = graph.edges(v)
    assert {(r.path_id, r.src, r.dst) for r in e.collect()} == {(1, 0, 1000), (1, 1000, 3000), (2, 1001, 1000), (2, 1000, 1002)}
    nodes = v.select("node", "lat", "lng").distinct()
    ask = spark.createDataFrame([(1, 0, 1002), (2, 0, 9009), (3, 5, 0), (4, 0, 0), (5, 0, 77)], "request_id long, source long, target long")
    got = {r.request_id: (r.status, r.path) for r in graph.shortest_paths(ask, e, nodes, 30.0).collect()}
    assert got[1] == ("ok", [0, 1000, 1002]) and got[2][0] == "not_connected" and got[3][0] == "no_trail_near_start" and got[4][0] == "ok" and got[5][0] == "no_trail_near_end"
    assert {r.request_id: r.status for r in graph.shortest_paths(ask, e, nodes, 0.6).collect()}[1] == "not_connected"
    up = graph.climbs(e.select("src", "dst", "miles"), spark.createDataFrame([(0, 100.0), (1000, 150.0)], "node long, ele_ft double")).collect()
    assert {(r.src, r.dst): r.climb_ft for r in up}[0, 1000] == 50 and {(r.src, r.dst): r.climb_ft for r in up}[1000, 3000] == 0


@pytest.mark.parametrize("doublings", [0, 1, 2])
def test_routes_equal_a_heap(spark, doublings):
    """Random graphs with parallel and shortcut edges, many requests at once."""
    import heapq

    rd = random.Random(doublings)
    place = {n: (37 + rd.random() / 10, -120 + rd.random() / 10) for n in range(40)}
    edge = [(a, b, hav(place[a], place[b]) * rd.choice([1, 1.01, 1.5, 3])) for a, b in ((rd.randrange(38), rd.randrange(38)) for _ in range(90))]
    near = {}
    for a, b, m in edge:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = min(m, near.get(x, {}).get(y, math.inf))

    def least(a, b):
        heap, done = [(0.0, a)], {}
        while heap:
            d, n = heapq.heappop(heap)
            if n not in done:
                done[n] = d
                for y, m in near.get(n, {}).items():
                    if d + m <= 9.0:
                        heapq.heappush(heap, (d + m, y))
        return done.get(b)

    ask = [(i, rd.randrange(42), rd.randrange(42)) for i in range(200)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graph.shortest_paths(df(ask, "request_id long, source long, target long"), df(edge, "src long, dst long, miles double"), df([(n, *p) for n, p in place.items()], "node long, lat double, lng double"), 9.0, doublings)
    got = {r.request_id: r for r in got.collect()}
    assert len(got) == 200
    for i, a, b in ask:
        if a >= 40 or b >= 40:
            assert got[i].status == ("no_trail_near_start" if a >= 40 else "no_trail_near_end") and got[i].miles is None
        elif a == b:
            assert (got[i].status, got[i].miles) == ("ok", 0.0)
        else:
            want = least(a, b)
            assert got[i].status == ("not_connected" if want is None else "ok") and (want is None) == (got[i].miles is None)
            if want is not None:
                way = got[i].path
                assert got[i].miles == pytest.approx(want) == pytest.approx(sum(near[x][y] for x, y in zip(way, way[1:]))) and (way[0], way[-1]) == (a, b)


def test_legs(spark):
    route = spark.createDataFrame([(1, i, n, m) for i, (n, m) in enumerate([(graph.STITCH, 0.01), ("A", 1.0), ("A", 0.5), ("B", 0.1), (graph.STITCH, 0.02), ("A", 2.0)])] + [(2, 0, graph.STITCH, 0.1)], "route_id long, seq long, name string, miles double")
    got = [(r.route_id, r.name, round(r.miles, 2), r.edges) for r in graph.leg_runs(route).orderBy("route_id", "leg").collect()]
    assert got == [(1, "A", 1.51, 3), (1, "B", 0.12, 2), (1, "A", 2.0, 1), (2, "connector", 0.1, 1)]
    assert [(r.route_id, r.name, r.miles) for r in graph.absorb_legs(graph.leg_runs(route)).orderBy("route_id", "leg").collect()] == [(1, "A", 3.63), (2, "connector", 0.1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.integers(1, 60)), min_size=1, max_size=12))
def test_merged_legs_keep_the_distance(legs):
    done = graph.merged_legs([n for n, _ in legs], [m / 100 for _, m in legs])
    assert sum(m for _, m in done) == pytest.approx(sum(m for _, m in legs) / 100)
    assert all(a[0] != b[0] for a, b in zip(done, done[1:]))
    assert len(done) == 1 or min(m for _, m in done) >= graph.SHORT_LEG_MI


def test_permits_by_area_name(spark):
    trails = spark.createDataFrame([(1, "Desolation Wilderness"), (2, "Ansel Adams Wilderness"), (3, None)], "id long, area_name string")
    permits = spark.createDataFrame([("p0", "Inyo National Forest - Wilderness Permits", 0), ("p1", "Desolation Wilderness Permit", 1), ("p2", "Desolation Wilderness Day Use", 2)], "id string, name string, ord long")
    assert {r.id: r.permit_id for r in merge.link_permits(trails, permits).collect()} == {1: "p1", 2: None, 3: None}


def test_composed_hikes(spark):
    df = spark.createDataFrame([(4.0, 1000, 200), (4.0, None, 200)], "miles double, gain_ft int, loss_ft int")
    assert [(r.total_miles, r.total_gain_ft) for r in graph.composed(df).collect()] == [(8.0, 1200), (8.0, None)]
    assert graph.composed(df, False).first().total_gain_ft == 1000
