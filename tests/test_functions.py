"""Scalar functions: nulls, text, ratings, distances."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talus.functions import geo, nulls, text
from talus.functions.ratings import DIFFICULTY, STEEPNESS, activities, band, climb_rate, effort


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_null_spellings(spark):
    assert one(spark, [" N/A ", "none", "Unknown", "", "ok ", None, "na"], nulls.clean) == [None, None, None, None, "ok", None, None]
    assert one(spark, ["na", "not specified"], lambda c: nulls.clean(c, nulls.PARK_NULLS)) == ["na", None]
    assert one(spark, ["1.5", "x", "NaN", "Infinity", None], nulls.finite) == [1.5, None, None, None, None]


def test_three_null_polarities(spark):
    r = one(spark, [None, 1.0, 5.0], lambda c: nulls.within(c, 2, None), "double")
    assert r == [False, False, True]
    assert one(spark, [None, 1.0], lambda c: nulls.within(c), "double") == [True, True]
    assert one(spark, [None, 1.0, 5.0], lambda c: nulls.unknown_or(c, c <= 2), "double") == [True, True, False]


def test_grades(spark):
    got = one(spark, ["12-20%", "TG05 - +12-20%", "20-12%", "N/A", None, ""], text.grade)
    assert [g and (g.min_pct, g.max_pct, g.label) for g in got] == [(12, 20, "12-20%")] * 3 + [None] * 3


def test_surfaces_and_classes(spark):
    assert one(spark, ["NAT - NATIVE MATERIAL", "EARTH", "AC- ASPHALT", "wood CHIPS", "n/a", None], text.surface) == ["Native", "Native", "Paved", "Wood Chips", None, None]
    assert one(spark, ["NM - NATIONAL MONUMENT", ""], text.area) == ["National Monument", None]
    assert one(spark, ["1", "3", "3.9", "N", "9", None], text.trail_class) == [1, 3, 3, None, None, None]


def test_titles_and_slugs(spark):
    assert one(spark, ["JOHN MUIR'S 2ND half-dome", "élan vital"], text.title) == ["John Muir'S 2Nd Half-Dome", "Élan Vital"]
    assert one(spark, ["  Half Dome (north)! ", "a--b"], text.slug) == ["half-dome-north", "a-b"]


def test_seasons(spark):
    got = one(spark, ["01/01-12/31", "06/15-10/30", "11/16-04/30", "13/01-02/02", "none", None], text.season)
    assert got[0].year_round and got[0].months == list(range(1, 13))
    assert got[1].months == [6, 7, 8, 9, 10] and not got[1].year_round
    assert got[2].months == [11, 12, 1, 2, 3, 4] and got[2].label == "11/16-04/30"
    assert got[3:] == [None, None, None]


def test_html(spark):
    html = "<p>A &amp; B</p><script>x<1</script><div>c&lt;d<br>e</div>"
    assert one(spark, [html, "", None, "<p></p>"], text.plain) == ["A & B\nc<d\ne", None, None, None]
    assert one(spark, [html], lambda c: text.plain(c, 3)) == ["A &"]


def test_wind_and_opl(spark):
    assert one(spark, ["10 to 25 mph", "5 mph", "calm", None], text.max_number) == [25.0, 5.0, None, None]
    assert one(spark, ["Bay%20%Area%c9%", "plain"], text.opl_decoded) == ["Bay AreaÉ", "plain"]


def test_photos(spark):
    place = F.array(F.lit("whitney"))
    got = one(spark, ["Mount Whitney summit.jpg", "ISS041-E-34506 - View of Earth", "12345678.jpg", "", None, "Dinner at our condo - Whitney"], lambda c: text.photo_relevance(c, place))
    assert got == [7.0, -3.0, -1.0, 0.0, 0.0, 0.5]
    assert one(spark, ["CC BY-SA 4.0", " pd ", "Fair use"], text.open_licence) == [True, True, False]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio(a, b):
    assert text.ratio(a, b) == (pytest.approx(200 * slow_lcs(a, b) / (len(a) + len(b))) if a or b else 100)
    assert text.partial_ratio(a, b) >= 100.0 * (min(len(a), len(b)) > 0 and (a in b or b in a))


def test_token_sets():
    assert text.token_set_ratio("whitney mount", "mount whitney trail") == 100 and text.token_set_ratio("", "x") == 0
    assert 0 < text.token_set_ratio("lost coast", "lost creek") < 100


def test_ratings(spark):
    rows = [(2.0, 300), (10.0, 6455), (5.0, None), (None, 1000), (0.0, 10), (3.0, -1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, mi double, ft int")
    got = df.select("i", band(effort(F.col("mi"), F.col("ft")), DIFFICULTY).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == ["easy", "very strenuous", None, None, None, None]
    df = spark.createDataFrame([(i, 1.0, ft) for i, ft in enumerate((50, 200, 400, 800))], "i int, mi double, ft int")
    assert [r.s for r in df.select("i", band(climb_rate(F.col("mi"), F.col("ft")), STEEPNESS).alias("s")).orderBy("i").collect()] == ["gentle", "moderate", "steep", "very steep"]


def test_activities(spark):
    rows = [(0, {"atv": True}, None, 9.0), (1, None, None, 9.0), (2, {"bike": True, "atv": False}, None, 1.0), (3, {"hiking": True}, "W", 1.0)]
    df = spark.createDataFrame(rows, "i int, uses map<string, boolean>, w string, mi double")
    got = df.select("i", *[c.alias(k) for k, c in activities(F.col("uses"), F.col("w"), F.col("mi")).items()]).orderBy("i").collect()
    assert [(r.hiking, r.backpacking, r.bike, r.motorized) for r in got] == [(False, False, False, True), (True, True, False, False), (True, False, True, False), (True, True, False, False)]


def test_distances(spark):
    df = spark.createDataFrame([(37.0, -120.0, 38.0, -120.0), (0.0, 0.0, 0.0, 180.0), (None, -120.0, 38.0, -120.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.haversine(*(F.col(x) for x in "abcd"))).collect()]
    assert got[0] == pytest.approx(3958.8 * math.radians(1)) and got[1] == pytest.approx(3958.8 * math.pi) and got[2] is None
    assert geo.box_tiles(0, 0, 1, 2, 0.5)[2:] == (2, 4) and geo.box_tiles(0, 0, 0.3, 0.1, 0.1)[2:] == (3, 1)


def test_source_kinds(spark):
    from talus.functions import sources

    rows = [{"natural": "volcano"}, {"natural": "water"}, {"waterway": "waterfall", "natural": "water"}, {"tourism": "camp_site", "walk_in": "Yes"}, {"tourism": "camp_site"}, {"amenity": "parking", "name": "Lot"}, {"amenity": "parking", "name": "North Trailhead"}, {}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t map<string, string>")
    got = df.select("i", sources.scenery_kind(F.col("t")).alias("s"), sources.access_kind(F.col("t"), [("walk_in", "yes", "walk_in_camp")]).alias("a")).orderBy("i").collect()
    assert [r.s for r in got] == ["peak", "lake", "waterfall", None, None, None, None, None]
    assert [r.a for r in got] == [None, None, None, "walk_in_camp", "campground", None, "trailhead", None]


def test_uses_and_usable_rows(spark):
    from talus.functions import sources

    assert one(spark, ["Hiker/Pedestrian| bicycle|Dancing", None], sources.park_uses) == [{"hiking": True, "bike": True}, {}]
    df = spark.createDataFrame([({"atv_managed": "06/01-09/30"},), ({"atv_restricted": "yes"},), ({"atv_managed": "N/A"},)], "p map<string, string>")
    got = [r.u for r in df.select(sources.use_state(F.col("p"), "atv").alias("u")).collect()]
    assert (got[0].allowed, got[0].restricted, got[0].season.months) == (True, None, [6, 7, 8, 9]) and (got[1].allowed, got[1].restricted) == (None, True) and got[2] is None
    df = spark.createDataFrame([("SNOW", None, None, None), (None, "Snow", None, None), (None, None, None, True), (None, None, True, True), (None, None, None, None)], "t string, s string, a boolean, r boolean")
    assert [r.h for r in df.select(sources.hikeable(*(F.col(c) for c in "tsar")).alias("h")).collect()] == [False, False, False, True, True]
    df = spark.createDataFrame([("Rim", {}, 2), (" (no access)", {}, 2), ("No Name 026", {}, 5), ("A", {"footway": "Sidewalk"}, 2), ("A", {"service": "driveway"}, 2), ("A", None, 1), (None, None, 3)], "n string, t map<string, string>, v int")
    assert [r.u for r in df.select(sources.usable_way(F.col("n"), F.col("t"), F.col("v")).alias("u")).collect()] == [True] + [False] * 6
    df = spark.createDataFrame([("Open", "YOSE"), (None, "YOSE"), ("Proposed", "YOSE"), ("Open", None)], "s string, u string")
    assert [r.o for r in df.select(sources.open_in(F.col("s"), F.col("u"), ["YOSE"]).alias("o")).collect()] == [True, True, False, False]


def test_bounds_of_ratios(spark):
    """Never below the exact ratios, and low enough to leave most names out."""
    import random

    rd = random.Random(9)
    vocabulary = ["".join(rd.choice("abcdefghilmnoprstuvw") for _ in range(rd.randrange(3, 9))) for _ in range(300)]
    names = [" ".join(rd.choice(vocabulary) for _ in range(rd.randrange(1, 5))) for _ in range(1500)] + ["", "a", "mist", "falls mist", "mist  falls mist", "mistfalls", "m i s t", "aaaa aaaa", "the mist falls trail"]
    for query in ("mist falls", "aaa", "x", "falls mist falls", vocabulary[0], f"{vocabulary[1]} {vocabulary[2]}"):
        df = spark.createDataFrame([(t,) for t in names], "t string").coalesce(2)
        got = df.select("t", text.signal_bound(query, F.col("t")).alias("b"), text.name_signal(query, F.col("t")).alias("v"), text.signal_bound(query, F.col("t"), True).alias("pb"), text.name_signal(query, F.col("t"), True).alias("pv")).collect()
        assert all(r.b >= r.v - 1e-9 and r.pb >= r.pv - 1e-9 for r in got), [(query, r) for r in got if r.b < r.v - 1e-9 or r.pb < r.pv - 1e-9][:3]
        if len(query) > 9:
            assert sum(r.b >= 85 for r in got) < 0.1 * len(got)


def test_candidates_change_no_result(spark):
    import random

    from talus.operators import search

    rd = random.Random(3)
    words = ["mist", "falls", "blue", "lake", "mill", "ridge", "rim", "fall", "misty", "pass", "creek", "blu"]
    rows = [(i, " ".join(rd.choice(words) for _ in range(rd.randrange(1, 4))) if i % 50 else None, rd.choice(["North Rim", "Mist Area", None]), float(i)) for i in range(1500)]
    t = spark.createDataFrame(rows, "id long, name string, area string, length_miles double").coalesce(2)
    for query in ("mist falls", "blue lake", "misty ridge pass", "rim"):
        full = {(r.id, round(r.score, 9)) for r in t.withColumn("score", search.text_score(query)).filter("score >= 0").collect()}
        can = search.text_candidates(t, query)
        assert {(r.id, round(r.score, 9)) for r in can.withColumn("score", search.text_score(query)).filter("score >= 0").collect()} == full
        if len(query) > 9:
            assert 0 < can.count() < 1450
