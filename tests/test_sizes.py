"""Jobs on many copies: what many rows share is found once, and pairs are told without a shuffle of theirs."""

import random

from pyspark.sql import functions as F

from talus.functions import text
from talus.operators import graph, lines, merge, spatial

PATH = [(0, 37.0, -120.0), (1, 37.001, -120.0)]


def copies(spark, n, m):
    """n paths on the same ground, m points at one place beside its second vertex."""
    v = spark.createDataFrame([(p, *x) for p in range(n) for x in PATH], "path_id long, seq long, lat double, lng double")
    return v, spark.createDataFrame([(i, f"p{i}", "water", 37.0011, -120.0) for i in range(m)], "id long, name string, kind string, lat double, lng double")


def before_join(df):
    """The optimized plan above its first join."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]


def test_near_path_pairs_are_not_grouped(spark):
    near = spatial.near_path(*copies(spark, 5, 7), 0.5)
    assert "Aggregate" not in before_join(near)
    got = near.collect()
    assert len(got) == 35 and {(r.seq, r.distance_mi) for r in got} == {(1, 0.007)}


def test_near_path_deals_out_paths_and_tells_points_of_a_place_at_once(spark):
    """What makes very many rows of few bytes goes to as many tasks as the session asks for, and its rows leave arrays."""
    near = spatial.near_path(*copies(spark, 5, 1300), 0.5)
    above = before_join(near)
    assert "Generate inline" in above and "RepartitionByExpression [path_id" in near._jdf.queryExecution().optimizedPlan().toString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {n}), REPARTITION_BY_NUM" in plan(near)
    rows = sorted(map(tuple, near.select("path_id", "id", "name", "kind", "seq", "distance_mi", "lat", "lng").collect()))
    assert rows == [(p, i, f"p{i}", "water", 1, 0.007, 37.0011, -120.0) for p in range(5) for i in range(1300)]


def test_near_path_of_an_id_at_two_places(spark):
    v, p = copies(spark, 2, 2)
    p = p.unionByName(p.filter("id = 1").withColumn("lat", F.lit(37.0001)))
    got = sorted((r.path_id, r.id, r.seq, r.distance_mi) for r in spatial.near_path(v, p, 0.5).collect())
    assert got == [(0, 0, 1, 0.007), (0, 1, 0, 0.007), (1, 0, 1, 0.007), (1, 1, 0, 0.007)]


def test_lines_are_told_by_all_their_vertices(spark):
    v = spark.createDataFrame([(1, 0, 37.0, -120.0), (1, 1, 37.1, -120.0), (2, 0, 37.0, -120.0), (2, 1, 37.1, -120.0), (3, 0, 37.1, -120.0), (3, 1, 37.0, -120.0)], "path_id long, seq long, lat double, lng double")
    of, own = spatial.lines_of(v)
    assert sorted(map(tuple, of.collect())) == [(1, 1), (2, 1), (3, 3)] and own.count() == 4


def test_waters_and_photos_are_ranked_by_line(spark):
    v, p = copies(spark, 3, 60)
    w = spatial.waters_near(v, p)
    assert "Window" not in before_join(w) and sorted((r.path_id, r.id) for r in w.collect()) == [(k, i) for k in range(3) for i in range(40)]
    photos = p.select("id", F.concat(F.lit("t"), (F.col("id") % 9).cast("string")).alias("title"), F.lit(1.0).alias("relevance"), "lat", "lng")
    best = spatial.photos_near(v, photos, 1.0)
    assert "Window" not in before_join(best) and sorted((r.path_id, r.title, r.id) for r in best.collect()) == [(k, f"t{i}", i) for k in range(3) for i in range(8)]


def test_scenery_and_grades_are_found_by_line(spark):
    from talus import plans

    for name in ("scenery_tags", "worst_grade"):
        assert "Aggregate" not in before_join(plans.queries()[name](spark, "/root/testdata/sf0.001")), name


def test_pairs_of_places_with_many_rows(spark):
    v, p = copies(spark, 3, 700)
    left = v.filter("seq = 1").select("path_id", "lat", "lng")
    got = spatial.radius_pairs(left, p.select("id", "lat", "lng"), 0.5)
    want = spatial.radius_join(left, p.select("id", "lat", "lng"), 0.5)
    told = lambda df: sorted((r.path_id, r.id, r.distance_raw) for r in df.collect())
    assert told(got) == told(want) and len(told(want)) == 2100
    assert "Join" not in before_join(got).split("Generate")[0] and "Aggregate" not in before_join(got)


def test_stitches_are_not_grouped(spark):
    ends = copies(spark, 1, 30)[1].select(F.col("id").alias("node"), "lat", "lng")
    s = graph.stitches(ends, 0.2)
    assert s.count() == 435 and "Aggregate" not in before_join(s)
    twice = ends.filter("node < 2").unionByName(ends.filter("node = 1").withColumn("lat", F.lit(37.0012)))
    assert sorted((r.a, r.b) for r in graph.stitches(twice, 0.2).collect()) == [(0, 1), (0, 1)]  # two distances


def test_components_need_no_pairs(spark, monkeypatch):
    from talus import plans

    monkeypatch.setattr(graph, "stitches", None)
    assert plans.queries()["components"](spark, "/root/testdata/sf0.01").count() == 1500


def test_places_look_once(spark, monkeypatch):
    seen = {}
    for module, name in ((spatial, "near_segments"), (spatial, "radius_join"), (graph, "radius_join")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda left, *a, _real=real, _name=name, **k: (seen.setdefault(_name, []).append(left.count()), _real(left, *a, **k))[1])
    from talus import plans

    for q in ("perimeter_edges", "perimeter_distance", "snap_nearest_line", "nearest_node"):
        plans.queries()[q](spark, "/root/testdata/sf0.01")
    assert {n for many in seen.values() for n in many} == {400}  # of 1500 points


def test_open_entities_stay_where_sql_leaves_them(spark):
    row = spark.createDataFrame([("<p>a &amp; b&hellip; &amp</p>&#65; &nothing;",)], "h string").select(text.plain(F.col("h"), open_entities=False).alias("a"), text.plain(F.col("h")).alias("b")).first()
    assert row.a == "a & b… &amp\nA &nothing;" and row.b.startswith("a & b… &\nA")


def test_runs_of_a_cell_are_one_without_pairs(spark, monkeypatch):
    runs = spark.createDataFrame([(i, "n", 1.0, 37.0 + (i % 9) * 0.001, -120.0, 37.3, -120.0 + (i % 3) * 0.5) for i in range(60)], "run long, key_name string, miles double, a_lat double, a_lng double, b_lat double, b_lng double")
    linked = []
    real = graph.component_labels
    monkeypatch.setattr(graph, "component_labels", lambda e: (linked.append(e.count()), real(e))[1])
    got = graph.way_trails(runs)
    assert {r.trail for r in got.collect()} == {0} and linked[0] < 30


def test_points_of_park_trails_are_shuffled_once(spark):
    """To be chained; what is summed up is grouped where they are, and nothing is stored."""
    s = spark.createDataFrame([("U", "Unit", i, f"n{i}", None, None, ["a"], None) for i in range(4)], "unit string, unit_name string, ord long, name string, surface string, season string, uses array<string>, miles double")
    v = spark.createDataFrame([(n, n // 2, 0, i, -120.0, 37 + (n + i) * 1e-2) for n in range(4) for i in range(2)], "ord long, line long, part int, seq int, lng double, lat double")
    of = plan(merge.park_trails(s, vertices=v, parts=False))
    assert of.count("MapInArrow") == 1 and "ExistingRDD[path_id" not in of and "collect_list" not in of
    below = of.split("MapInArrow")[1].split("Join")[0]
    assert below.count("Exchange hashpartitioning(path_id") == 1
    rows = [(p, k, i, -120.0 + 0.01 * (k * 3 % 7 + i), 37.0 + p) for p in (1, 2) for k in range(7) for i in (0, 1)]
    some = spark.createDataFrame(rows, "path_id long, part long, seq long, lng double, lat double")
    told = [sorted(map(tuple, lines.chain_steps(some, whole=n).collect())) for n in (0, 100)]
    steps = lines.steps(lines.chain_paths(some).withColumn("run", F.struct("path_id", "chain")), "run").select("path_id", "seq", "lng", "lat", "step_mi")
    assert told[0] == told[1] and sorted((a, *b) for a, _, *b in told[0]) == sorted(map(tuple, steps.collect()))


def test_few_parts_chain_as_many(monkeypatch):
    rd = random.Random(5)
    for snap in (False, True):
        for _ in range(300):
            parts = [[(rd.randint(0, 3) * 1.0, rd.randint(0, 3) * 1.0) for _ in range(rd.randint(1, 4))] for _ in range(rd.randint(0, 4))]
            monkeypatch.setattr(lines, "FEW_PARTS", 4)
            few = lines.chains_of(parts, 1e-4, snap)
            monkeypatch.setattr(lines, "FEW_PARTS", 0)
            assert few == lines.chains_of(parts, 1e-4, snap)


def test_small_paths_are_chained_without_networks(spark, monkeypatch):
    rows = [(p, k, s, -120.0 + 0.01 * (k * 3 % 7 + s), 37.0 + p) for p in (1, 2) for k in range(7) for s in (0, 1)]
    v = spark.createDataFrame(rows, "path_id long, part long, seq long, lng double, lat double")
    more = v.unionByName(v.filter("path_id = 2").withColumn("part", F.col("part") + 10).withColumn("lat", F.lit(45.0)))
    told = lambda df: sorted(map(tuple, df.select("path_id", "chain", "seq", "lng", "lat").collect()))
    want = told(lines.chain_paths(more))
    assert told(lines.chain_networks(more, whole=0)) == want == told(lines.chain_networks(more, whole=14))
    monkeypatch.setattr(graph, "component_labels", None)
    assert told(lines.chain_networks(more)) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_are_put_on_lines_without_arrays(spark):
    from talus import plans

    assert "lambda" not in plan(plans.queries()["snap_to_line"](spark, "/root/testdata/sf0.001"))
    v = spark.createDataFrame([(1, 4, 37.0, -120.0), (1, 5, 37.0, -120.0), (1, 7, 37.01, -120.0), (1, 9, 37.0, -120.0), (2, 0, 37.0, -120.0), (3, 0, 37.0, -120.0), (3, 1, 38.0, -120.0)], "path_id long, seq long, lat double, lng double")
    lat, lng = F.col("lat") + 0.002, F.col("lng") + F.col("path_id") * 0.001
    held = v.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("p"))
    held = held.select("path_id", "p", F.col("p")[0]["lat"].alias("lat"), F.col("p")[0]["lng"].alias("lng"))
    s = lines.snapped_to(F.col("p"), lat, lng)
    want = held.select("path_id", s["lng"].alias("lng"), s["lat"].alias("lat"), lines.nearest_index(F.col("p"), lat, lng).alias("nearest"))
    assert sorted(map(tuple, lines.put_on_lines(v, lat, lng).collect())) == sorted(map(tuple, want.collect()))


def test_route_types_sort_a_few_numbers_a_row(spark):
    from talus import plans

    told = plan(plans.queries()["route_types"](spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in told and "ground" not in told
    cells = spark.createDataFrame([(1, s, 37.0, -120.0 + 0.001 * x) for s, x in enumerate((0, 1, 2, 1, 0))] + [(2, 0, 37.0, -120.0)], "path_id long, seq long, lat double, lng double")
    assert {r.path_id: r.route_type for r in lines.route_type(cells).collect()} == {1: "out-and-back", 2: "unknown"}


def test_chains_are_read_in_order_without_arrays(spark):
    from talus import plans

    for name in ("chain_lines", "chain_stitched"):
        assert "collect_list" not in plan(plans.queries()[name](spark, "/root/testdata/sf0.001")), name
    rows = [(p, k, s, -120.0 + 0.001 * (k * 2 + s), 37.0 + p) for p in range(40) for k in range(300) for s in (0, 1)]  # more than a batch of rows
    v = spark.createDataFrame(rows, "path_id long, part long, seq long, lng double, lat double").repartition(1)
    got = lines.chain_paths(v, stitch_m=1.0).collect()
    assert len(got) == len(rows) and {(r.path_id, r.chain, r.seq % 2, round(r.lng, 6)) for r in got} == {(p, k, s, round(x, 6)) for p, k, s, x, _ in rows}


def test_tops_keep_few_rows_a_task(spark):
    from talus import plans

    told = plan(plans.queries()["sort_unknown_last"](spark, "/root/testdata/sf0.001"))
    assert "Generate" not in told and "WindowGroupLimit" not in told and told.count("TakeOrderedAndProject") == 7


def test_ranges_are_numbered_where_they_are_sorted(spark):
    from talus.operators import merge

    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id"))
    got = merge.numbered(rows.repartition(7), [F.col("id")])
    assert "hashpartitioning(_p" not in plan(got).split("Window")[0] and {(r.id, r.ord) for r in got.collect()} == {(i, i) for i in range(1000)}


def test_elements_are_chained_once(spark, monkeypatch):
    from talus.operators import elements

    v = spark.createDataFrame([(1, 0, 0, 37.0, -120.0), (1, 0, 1, 37.01, -120.0), (1, 1, 0, 37.02, -120.0), (1, 1, 1, 37.03, -120.0)], "path_id long, part long, seq long, lat double, lng double")
    out = elements.records(v, spark.createDataFrame([(1, {"name": "a"})], "path_id long, tags map<string,string>"), ["name"])
    assert "MapInArrow" not in plan(out)
    assert out.select("name", "segments", "route_type", "min_lat", "max_lat", "center_lat", "center_lng").first() == ("a", 2, "network", 37.0, 37.03, 37.015, -120.0)


def test_first_ones_of_a_place_meet_others(spark, monkeypatch):
    met, real = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda left, *a, **k: (met.append(left.count()), real(left, *a, **k))[1])
    kind = "id string, kind string, name string, lat double, lng double, ord long"
    rows = [(f"c{i}", "k", [None, "a", "A", "b"][i % 4], 37.0, -120.0 if i % 8 < 4 else -121.0, i) for i in range(1, 80)] + [("u1", "k", "a", None, None, 90), ("u2", "k", "a", None, None, 91)]
    got = spatial.merge_points(spark.createDataFrame([("s", "k", "a", 37.0, -121.0, 0)], kind), spark.createDataFrame(rows, kind))
    # west of it all but b repeat s; c7 is the first b there. At the other place c1 is first, c3 of another name, c8 without a name repeats both
    assert sorted(r.id for r in got.collect()) == ["c1", "c3", "c7", "s", "u1", "u2"] and max(met) == 8


def test_equal_requests_are_one(spark, monkeypatch):
    asked, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (asked.append(df.count()) if not asked else None, real(df))[1])
    nodes = spark.createDataFrame([(i, 37.0, -120.0 + 0.001 * i) for i in range(4)], "node long, lat double, lng double")
    edge = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.1)], "src long, dst long, miles double")
    ask = spark.createDataFrame([(i, *[(0, 2), (0, 3), (None, 2), (1, None), (2, 2)][i % 5]) for i in range(50)], "request_id long, source long, target long")
    got = {r.request_id: (r.status, r.miles) for r in graph.shortest_paths(ask, edge, nodes, 1.0).collect()}
    want = [("ok", 0.2), ("not_connected", None), ("no_trail_near_start", None), ("no_trail_near_end", None), ("ok", 0.0)]
    assert asked == [5] and got == {i: want[i % 5] for i in range(50)}


def test_short_series_are_folded_without_arrays(monkeypatch):
    import numpy as np

    series = [3.0, 9.0, 9.0, 12.0, 40.0, 31.0, 35.0, 20.0, 60.0]
    whole = lines.turns(np.array(series * 8), 15.0)
    monkeypatch.setattr(np, "diff", None)
    kept = []
    for _ in range(8):
        kept = lines.turns(np.array(series), 15.0, kept)
    assert lines.folded(kept, 15.0) == lines.folded(whole, 15.0) == lines.folded(series * 8, 15.0)


def test_legs_are_read_in_order_without_arrays(spark):
    from talus import plans

    assert "collect_list" not in plan(plans.queries()["leg_absorb"](spark, "/root/testdata/sf0.001"))
    rows = [(r, k, "ab"[k % 2], 0.05 if k == 1 else 1.0, 1) for r in range(9000) for k in range(3)]  # more than a batch of rows
    got = graph.absorb_legs(spark.createDataFrame(rows, "route_id long, leg long, name string, miles double, edges long").repartition(1)).collect()
    assert len(got) == 9000 and {(r.leg, r.name, r.miles) for r in got} == {(0, "a", 2.05)}


def test_segments_of_a_trail_are_shuffled_once(spark):
    """Rows go to their trail once, not a vote each; longer trails are combined first, with the same result."""
    rd = random.Random(7)
    one = lambda *of: rd.choice([None, *of])
    rows = [(rd.choice([1, 2, 3, 3, 3, 3, 4, None]), i, *[one("a", "b", "c") for _ in range(7)], one(1, 2), None, one(1.0, 2.0), 0.5, *[1.0] * 4, one(("x",), ("y",))) for i in rd.sample(range(1000), 300)]
    texts = ", ".join(f"{t} string" for t in merge.TRAIL_TEXTS)
    s = spark.createDataFrame(rows, f"trail_id long, ord long, {texts}, trail_class int, grade struct<max_pct: int>, miles double, measured double, min_lng double, min_lat double, max_lng double, max_lat double, bike struct<v: string>").repartition(6)
    out = merge.build_trails(s, ["bike"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    got = {r.trail_id: r.asDict(True) for r in out.collect()}
    assert got == {r.trail_id: r.asDict(True) for r in merge.build_trails(s, ["bike"], short=60).collect()} and set(got) == {1, 2, 3, 4}
    for key, r in got.items():
        own = sorted((x for x in rows if x[0] == key), key=lambda x: x[1])
        for k, t in enumerate(merge.TRAIL_TEXTS[1:], 3):
            votes = [x[k] for x in own if x[k] is not None]
            assert r[t] == max(dict.fromkeys(votes), key=votes.count)  # max() keeps the first of equals
        assert r["segment_count"] == len(own) and r["bike"] == {"v": next(x[-1][0] for x in own if x[-1])}


def test_edges_and_hops_are_shuffled_once(spark):
    """Junctions are told in one grouping, vertices go to their nodes and back once, and hops with a shape look no points up."""
    rd = random.Random(3)
    v = spark.createDataFrame([(p, i, rd.choice([1, 2, 3, 100 * p + i]), 37.0 + p / 100, -120.0 + i / 100) for p in range(12) for i in range(rd.randrange(1, 9))], "path_id long, seq long, node long, lat double, lng double")
    e = graph.edges(v, shapes=True)
    assert e._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3  # nodes, vertices by node, vertices by path
    rows = e.collect()
    paths, own = {}, {}
    for r in v.collect():
        paths.setdefault(r.node, set()).add(r.path_id)
        own.setdefault(r.path_id, []).append(r)
    want = {}
    for p, line in own.items():
        line.sort(key=lambda r: r.seq)
        cuts = [i for i, r in enumerate(line) if i in (0, len(line) - 1) or len(paths[r.node]) > 1]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
            if line[a].node != line[b].node:
                want[p, k, line[a].node, line[b].node] = [(r.lng, r.lat) for r in line[a : b + 1]]
    assert {(r.path_id, r.edge_no, r.src, r.dst): [tuple(x) for x in r.shape] for r in rows} == want and len(want) > 10
    assert {k[:4] for k in want} == {(r.path_id, r.edge_no, r.src, r.dst) for r in graph.edges(v).collect()}
    found = spark.createDataFrame([(1, [k[2:] for k in want][0]), (2, [10_000, 10_001]), (3, [1])], "request_id long, path array<long>")
    s = graph.path_shapes(found, graph.edge_shapes(e), v.groupBy("node").agg(F.min("lng").alias("lng"), F.min("lat").alias("lat")))
    got = {r.request_id: len(r.shape) for r in s.collect()}
    assert set(got) == {1, 2} and got[1] >= 2 and got[2] == 0
    assert "Union" in s._jdf.queryExecution().optimizedPlan().toString().split("\n")[2]  # only hops without a shape are joined with points
