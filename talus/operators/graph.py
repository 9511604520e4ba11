"""The routing graph: junctions, edges, stitches, shortest paths and named legs.

Vertices are rows (path_id, seq, node, lat, lng); node is the snapped grid cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.geo import MILES_PER_DEGREE, cell, column, haversine
from talus.functions.text import key_name, slug
from talus.operators.lineage import cut
from talus.operators.lines import chain_networks, gains, steps
from talus.operators.merge import box_union, majorities
from talus.operators.spatial import radius_join, radius_pairs
from talus.sources.readers import terrain_metres

SNAP_M, STITCH_MI, SHORT_LEG_MI = 4.0, 35 / 1609.34, 0.15
STITCH = "__stitch__"


def snapped(lat: Column, lng: Column, metres: float = SNAP_M) -> Column:
    """One string a grid cell of about ``metres``; the grid is global, so equal ground gives equal nodes."""
    size = metres / 111_320.0
    return F.concat_ws(":", F.round(lat / size).cast("long").cast("string"), F.round(lng / size).cast("long").cast("string"))


def junctions(vertices: DataFrame) -> DataFrame:
    """Nodes touched by at least two different paths; a path that crosses itself makes none."""
    return vertices.groupBy("node").agg(F.count_distinct("path_id").alias("paths")).filter("paths > 1")


SHAPE_POINTS = 60


def _with_cuts(vertices: DataFrame) -> DataFrame:
    """Adds cut: true at junctions, else NULL. They are told by the least and the largest path of a node, in one shuffle."""
    of = vertices.groupBy("node").agg(F.min("path_id").alias("a"), F.max("path_id").alias("b")).filter("a <> b")
    return vertices.join(of.select("node", F.lit(True).alias("cut")), "node", "left")


def edges(vertices: DataFrame, shapes: bool = False) -> DataFrame:
    """(src, dst, path_id, edge_no, miles): paths cut at junctions and ends, as islands between cuts.

    An edge from a node to itself is dropped. Junctions join by node, whose partitioning
    the grouping above already has. With ``shapes`` an edge also has ``shape``, the vertices from
    cut to cut as array<struct<lng, lat>>: a vertex goes with the cut before it, the start of
    its island, and islands are grouped where their paths already are. Long shapes are thinned
    to ``SHAPE_POINTS`` even picks and the last point.
    """
    by = Window.partitionBy("path_id").orderBy("seq")
    run = steps(_with_cuts(vertices))
    ends = F.row_number().over(by) == 1
    last = F.lead("seq").over(by).isNull()
    run = run.withColumn("stop", F.coalesce("cut", F.lit(False)) | ends | last)
    if not shapes:
        stops = run.filter("stop").select("path_id", "seq", "node", "run_mi")
        before = lambda c: F.lag(c).over(by)
        out = stops.select("path_id", before("node").alias("src"), F.col("node").alias("dst"), (F.col("run_mi") - before("run_mi")).alias("miles"), (F.row_number().over(by) - 1).cast("long").alias("edge_no"))
        return out.filter("src is not null and src <> dst")
    behind = by.rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("stop"), F.struct("node", "lng", "lat", "run_mi")), ignorenulls=True).over(behind)
    own = run.select("path_id", "seq", "node", "lng", "lat", "run_mi", F.sum(F.col("stop").cast("long")).over(behind).alias("edge_no"), start.alias("start")).filter("start is not null")
    out = own.groupBy("path_id", "edge_no").agg(
        F.first("start").alias("start"), F.max_by("node", "seq").alias("dst"), F.max("run_mi").alias("run_mi"), F.sort_array(F.collect_list(F.struct("seq", "lng", "lat"))).alias("v")
    )
    out = out.select("path_id", "edge_no", "start", F.col("start.node").alias("src"), "dst", (F.col("run_mi") - F.col("start.run_mi")).alias("miles"), "v")
    at = lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))
    shape = F.concat(F.array(at(F.col("start"))), F.transform("v", at))
    picks = F.transform(F.sequence(F.lit(0), F.lit(SHAPE_POINTS - 1)), lambda k: F.get("shape", F.floor(k * (F.size("shape") / SHAPE_POINTS)).cast("int")))
    out = out.withColumn("shape", shape).withColumn("shape", F.when(F.size("shape") > SHAPE_POINTS, F.concat(picks, F.array(F.element_at("shape", -1)))).otherwise(F.col("shape")))
    return out.filter("src <> dst and miles > 0").select("path_id", "src", "dst", "miles", "edge_no", "shape")


def edge_shapes(edge: DataFrame) -> DataFrame:
    """(src, dst, shape): the first shape of each pair of nodes in that direction, by path, then edge."""
    return edge.groupBy("src", "dst").agg(F.min_by("shape", F.struct("path_id", "edge_no")).alias("shape"))


def stitches(ends: DataFrame, miles: float = STITCH_MI) -> DataFrame:
    """(a, b, miles), a < b: path ends (node, lat, lng) close enough to be joined, each pair once."""
    ends = ends.select("node", "lat", "lng").distinct()
    near = radius_pairs(ends.withColumnRenamed("node", "a"), ends.withColumnRenamed("node", "b"), miles, size=0.001)
    pairs = near.filter("a < b").select("a", "b", F.col("distance_raw").alias("miles"))
    several = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return pairs if several.isEmpty() else pairs.distinct()  # a pair is met twice only if a node stands at several places


def stitched_components(ends: DataFrame, miles: float = STITCH_MI) -> DataFrame:
    """component_labels of stitches, whose pairs are never told: nodes of one place hang on the least of them, and those of near places on each other."""
    ends = ends.select("node", "lat", "lng").filter("lat is not null and lng is not null").distinct()
    least = ends.groupBy("lat", "lng").agg(F.min("node").alias("spot"), F.count(F.lit(1)).alias("n"))
    near = radius_join(least.select("spot", "lat", "lng"), least.select(F.col("spot").alias("other"), "lat", "lng"), miles, size=0.001).filter("spot < other")
    own = ends.join(least.filter("n > 1"), ["lat", "lng"])
    return component_labels(own.select(F.col("node").alias("src"), F.col("spot").alias("dst")).unionByName(near.select(F.col("spot").alias("src"), F.col("other").alias("dst"))))


def climbs(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds climb_ft in each direction: what is up from src to dst; 0 where a height is unknown."""
    high = edge.join(nodes.select(F.col("node").alias("src"), F.col("ele_ft").alias("a")), "src", "left").join(nodes.select(F.col("node").alias("dst"), F.col("ele_ft").alias("b")), "dst", "left")
    return high.withColumn("climb_ft", F.coalesce(F.greatest(F.lit(0.0), F.col("b") - F.col("a")), F.lit(0.0))).drop("a", "b")


def nearest_node(requests: DataFrame, nodes: DataFrame, miles: float) -> DataFrame:
    """(request_id, node): the nearest node within ``miles`` of each (request_id, lat, lng); ties to the smaller node."""
    near = radius_join(requests.select("lat", "lng").distinct(), nodes.select("node", "lat", "lng"), miles, size=0.01)  # requests from one place look once
    best = near.groupBy("lat", "lng").agg(F.min(F.struct("distance_raw", "node")).alias("b"))
    return requests.join(best, ["lat", "lng"]).groupBy("request_id").agg(F.min("b").alias("b")).select("request_id", "b.node")


def _either_way(edge: DataFrame) -> DataFrame:
    """Edges (src, dst, miles) in both directions, the shortest of each pair."""
    back = edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "miles")
    return edge.select("src", "dst", "miles").unionByName(back).filter("src <> dst").groupBy("src", "dst").agg(F.min("miles").alias("miles"))


def shortcuts(edge: DataFrame, max_miles: float, doublings: int) -> DataFrame:
    """(src, dst, miles, between): the shortest ways of at most 2^doublings edges, with the nodes they pass."""
    node = dict(edge.dtypes)["src"]
    ways = _either_way(edge).withColumn("between", F.array().cast(f"array<{node}>"))
    for _ in range(doublings):
        onward = ways.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("miles").alias("rest"), F.col("between").alias("then"))
        two = ways.join(onward, F.col("dst") == F.col("mid")).filter((F.col("src") != F.col("to")) & (F.col("miles") + F.col("rest") <= max_miles))
        two = two.select("src", F.col("to").alias("dst"), (F.col("miles") + F.col("rest")).alias("miles"), F.concat("between", F.array("mid"), "then").alias("between"))
        ways = ways.unionByName(two).groupBy("src", "dst").agg(F.min(F.struct("miles", "between")).alias("b")).select("src", "dst", "b.miles", "b.between")
    return ways


def shortest_paths(requests: DataFrame, edge: DataFrame, nodes: DataFrame, max_miles: float, doublings: int = 1) -> DataFrame:
    """(request_id, status, miles, path) for any number of requests (request_id, source, target); an id is one request.

    Labels are corrected in rounds that all requests share. A round moves the frontier
    (request, node, miles so far, way) on by one shortcut, keeps the least of each request
    and node in a partial minimum, and drops what can't get better: where the miles so far
    and the straight line to the target exceed max_miles or the best way found to the
    target, or where an earlier round reached the node in no more. What is left is the next
    frontier, checkpointed. Labels are only added to, and the new candidates look theirs
    up, so shuffles are as large as the frontier; no request's labels meet in one task, and
    edges are never copied for a request. Every eight rounds the labels become one table.
    Of equally long ways the one with the smallest nodes is told. Unreached targets are
    "not_connected", never a tentative distance. Requests of one source and target are
    one until the end.
    """
    every, requests = requests, requests.groupBy("source", "target").agg(F.min("request_id").alias("request_id"))
    at = nodes.select("node", "lat", "lng")
    s = at.select(F.col("node").alias("source"), F.lit(True).alias("starts"))
    t = at.select(F.col("node").alias("target"), F.col("lat").alias("t_lat"), F.col("lng").alias("t_lng"))
    asked = cut(requests.select("request_id", "source", "target").join(s, "source", "left").join(t, "target", "left"))
    ways = shortcuts(edge, max_miles, doublings).join(at.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "miles", "between", "lat", "lng")
    ways = cut(ways.repartition("src"))
    kind = dict(nodes.dtypes)["node"]
    goals = asked.filter("starts and t_lat is not null and source <> target").select("request_id", "source", "target", "t_lat", "t_lng", F.lit(None).cast("double").alias("found"), F.lit(None).cast(f"array<{kind}>").alias("path"))
    frontier = goals.select("request_id", F.col("source").alias("node"), F.lit(0.0).alias("d"), F.array("source").alias("way"))
    labels, rounds = [frontier.select("request_id", "node", "d")], 0
    goals = cut(goals.drop("source"))
    while True:
        moved = frontier.join(ways, F.col("node") == F.col("src")).join(goals, "request_id")
        moved = moved.withColumn("d", F.col("d") + F.col("miles")).withColumn("least", F.col("d") + haversine(F.col("lat"), F.col("lng"), F.col("t_lat"), F.col("t_lng")))
        hopeful = (F.col("least") <= max_miles + 1e-9) & (F.col("d") <= max_miles) & (F.col("found").isNull() | ((F.col("least") <= F.col("found") + 1e-9) & (F.col("d") < F.col("found"))))
        moved = moved.filter(hopeful).select("request_id", F.col("dst").alias("node"), F.struct("d", F.concat("way", "between", F.array("dst")).alias("way")).alias("b"))
        new = moved.groupBy("request_id", "node").agg(F.min("b").alias("b")).select("request_id", "node", "b.d", "b.way")
        old = labels[0]
        for more in labels[1:]:
            old = old.unionByName(more)
        met = old.withColumnRenamed("d", "old").join(new.select("request_id", "node"), ["request_id", "node"]).groupBy("request_id", "node").agg(F.min("old").alias("old"))
        better = cut(new.join(met, ["request_id", "node"], "left").filter("old is null or d < old").drop("old"))
        if better.isEmpty():
            break
        ends = better.withColumnRenamed("node", "target").select("request_id", "target", F.col("d").alias("now"), F.col("way").alias("by"))
        goals = cut(goals.join(ends, ["request_id", "target"], "left").select("request_id", "target", "t_lat", "t_lng", F.coalesce("now", "found").alias("found"), F.coalesce("by", "path").alias("path")))
        frontier = better.join(goals.select("request_id", F.col("target").alias("node")), ["request_id", "node"], "left_anti")
        labels, rounds = [*labels, better.select("request_id", "node", "d")], rounds + 1
        if rounds % 8 == 0:
            for more in labels[1:]:
                labels[0] = labels[0].unionByName(more)
            labels = [cut(labels[0].groupBy("request_id", "node").agg(F.min("d").alias("d")))]
    status = F.when(F.col("starts").isNull(), "no_trail_near_start").when(F.col("t_lat").isNull(), "no_trail_near_end").when(F.col("source") == F.col("target"), "ok").when(F.col("found").isNull(), "not_connected").otherwise("ok")
    out = asked.join(goals.select("request_id", "found", "path"), "request_id", "left")
    out = out.select("source", "target", status.alias("status"), F.when(F.col("starts") & (F.col("source") == F.col("target")), 0.0).otherwise(F.col("found")).alias("miles"), "path")
    both = every.select("request_id", F.col("source").alias("_s"), F.col("target").alias("_t")).join(out, F.col("_s").eqNullSafe(F.col("source")) & F.col("_t").eqNullSafe(F.col("target")))
    return both.select("request_id", "status", "miles", "path")


def path_shapes(found: DataFrame, edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, shape): the vertices along each found path (request_id, path), from edges (src, dst, shape) in either direction.

    Where no edge has a shape it is the straight hop between the nodes; equal neighbours are one point.
    """
    hops = found.select("request_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.struct(F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst")))).alias("hop", "e"))
    hops = hops.select("request_id", "hop", "e.src", "e.dst").filter("dst is not null")
    either = edge.select("src", "dst", "shape", F.lit(0).alias("way")).unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.reverse("shape").alias("shape"), F.lit(1).alias("way")))
    either = either.filter(F.size("shape") > 0).groupBy("src", "dst").agg(F.min(F.struct("way", "shape")).alias("s")).select("src", "dst", "s.shape")
    point = lambda c: nodes.select(F.col("node").alias(c), F.struct("lng", "lat").alias(f"{c}_at"))
    hops = hops.join(either, ["src", "dst"], "left")
    straight = F.filter(F.array("src_at", "dst_at"), lambda p: p.isNotNull())
    bare = hops.filter("shape is null").select("request_id", "hop", "src", "dst").join(point("src"), "src", "left").join(point("dst"), "dst", "left")
    # hops aren't filtered by their shapes here, so that they are shuffled once for both
    pieces = hops.select("request_id", "hop", F.col("shape").alias("piece")).unionByName(bare.select("request_id", "hop", straight.alias("piece")))
    known = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("hop", "piece")))
    pieces = pieces.groupBy("request_id").agg(F.flatten(F.sort_array(known).getField("piece")).alias("all"))
    return pieces.select("request_id", F.filter("all", lambda p, i: (i == 0) | ~p.eqNullSafe(F.get("all", i - 1))).alias("shape"))


def path_gains(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, gain_ft, loss_ft) over the known heights (nodes: node, ele_ft) along each path; NULL with fewer than two."""
    at = found.select("request_id", F.posexplode("path").alias("pos", "node")).join(nodes.select("node", "ele_ft"), "node")
    whole = lambda c: F.when(F.col("n") >= 2, F.bround(c).cast("int")).alias(f"{c}_ft")
    return found.select("request_id").join(gains(at, "request_id", ["pos"], "ele_ft").select("request_id", whole("gain"), whole("loss")), "request_id", "left")


def node_heights(nodes: DataFrame, tiles: DataFrame, zoom: int = 13) -> DataFrame:
    """nodes (node, lat, lng) with ele_ft from raster tiles; NULL where no tile has them."""
    metres = terrain_metres(tiles, nodes.select(F.col("node").alias("point_id"), "lat", "lng"), zoom)
    return nodes.join(metres.select(F.col("point_id").alias("node"), (F.col("ele_m") * 3.28084).alias("ele_ft")), "node", "left")


def graph_status(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes that edges touch, edges, and nodes with a height (ele_ft)."""
    touched = edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes.select("node", "ele_ft"), "node", "left")
    size = edge.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count(F.lit(1)).alias("edges"))
    return touched.agg(F.count(F.lit(1)).alias("nodes"), F.count("ele_ft").alias("nodes_with_elevation")).join(size)


def way_trails(runs: DataFrame, gap_mi: float = 2.0, least_mi: float = 0.25) -> DataFrame:
    """(run, trail): runs (run, key_name, miles, a_lat, a_lng, b_lat, b_lng) of one name whose ends are within ``gap_mi`` are one trail.

    trail is its smallest run; trails shorter than ``least_mi`` in all are dropped. Only ends of one name meet.
    """
    ends = runs.select("run", "key_name", F.explode(F.array(F.struct(F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng")), F.struct(F.col("b_lat").alias("lat"), F.col("b_lng").alias("lng")))).alias("p")).select("run", "key_name", "p.*").distinct()
    # runs of a name that end at one place are its spot's, the least run's, and spots within reach of the least in their cell are that one's
    spots = ends.groupBy("key_name", "lat", "lng").agg(F.min("run").alias("spot"))
    size = gap_mi / MILES_PER_DEGREE / 1.5
    spots = spots.withColumn("_r", cell(F.col("lat"), size)).withColumn("_c", column(F.col("lng"), F.col("_r"), size))
    least = spots.groupBy("key_name", "_r", "_c").agg(F.min(F.struct("spot", F.col("lat").alias("y"), F.col("lng").alias("x"))).alias("m"))
    close = haversine(F.col("lat"), F.col("lng"), F.col("m.y"), F.col("m.x")) <= gap_mi
    spots = spots.join(least, ["key_name", "_r", "_c"]).select("key_name", "lat", "lng", F.when(close, F.col("m.spot")).otherwise(F.col("spot")).alias("spot"))
    near = radius_join(spots.withColumnRenamed("spot", "src"), spots.withColumnRenamed("spot", "dst"), gap_mi, on=["key_name"]).filter("src < dst").select("src", "dst").distinct()
    of = ends.join(spots, ["key_name", "lat", "lng"]).groupBy("run").agg(F.min("spot").alias("src"), F.max("spot").alias("dst"))
    label = component_labels(near.unionByName(of.select("src", "dst").distinct()))
    found = of.join(label.withColumnRenamed("node", "src"), "src").select("run", "label")
    named = runs.join(found, "run", "left").withColumn("trail", F.coalesce("label", "run"))
    long = named.groupBy("trail").agg(F.sum("miles").alias("m")).filter(F.col("m") >= least_mi).select("trail")
    return named.join(long, "trail").select("run", "trail")


def way_records(ways: DataFrame, vertices: DataFrame, gap_mi: float = 2.0, least_mi: float = 0.25) -> DataFrame:
    """Trail records from usable ways (way_id, ord, name, operator, surface) and their vertices (way_id, seq, lng, lat).

    Ways of one name (apart from case and blanks) are chained where their ends meet, and runs
    whose ends are within ``gap_mi`` make a trail. What the name's first way calls it holds; operator and
    surface are the commonest among its ways, of equally common ones the first seen. A single run
    whose ends meet is a loop. The id is made of the name and the box's corner, so it stays
    the same from build to build. ``parts`` are the runs, in order.
    """
    own = ways.withColumn("key_name", key_name(F.col("name")))
    said = own.groupBy("key_name").agg(F.min_by("name", "ord").alias("name"), F.min("way_id").alias("ref"), F.count(F.lit(1)).alias("segment_count")).join(majorities(own, "key_name", ["operator", "surface"], "ord"), "key_name", "left")
    runs = cut(chain_networks(vertices.join(own.select("way_id", "ord", "key_name"), "way_id").select(F.col("key_name").alias("path_id"), F.col("ord").alias("part"), "seq", "lng", "lat")))
    run = F.struct("path_id", "chain").alias("run")
    walked = steps(runs.select(run, "seq", "lng", "lat"), "run").groupBy("run").agg(
        F.sum("step_mi").alias("miles"), F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat"),
        F.min_by(F.struct("lat", "lng"), "seq").alias("a"), F.max_by(F.struct("lat", "lng"), "seq").alias("b"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("line"),
    )
    walked = cut(walked)
    ends = walked.select("run", F.col("run.path_id").alias("key_name"), "miles", F.col("a.lat").alias("a_lat"), F.col("a.lng").alias("a_lng"), F.col("b.lat").alias("b_lat"), F.col("b.lng").alias("b_lng"))
    trail = walked.join(way_trails(ends, gap_mi, least_mi), "run").groupBy("trail").agg(
        F.sum("miles").alias("miles"), *box_union(), F.count(F.lit(1)).alias("part_count"), F.min_by(haversine(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")), "run").alias("open_mi"),
        F.transform(F.array_sort(F.collect_list(F.struct("run", "line"))), lambda r: r["line"]).alias("parts"),
    )
    out = trail.withColumn("key_name", F.col("trail.path_id")).join(said, "key_name").withColumn("slug", slug(F.col("name")))
    corner = F.concat_ws(":", "key_name", F.round(F.col("min_lng") * 1000).cast("long").cast("string"), F.round(F.col("min_lat") * 1000).cast("long").cast("string"))
    middle = lambda c: F.round((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2, 6).alias(f"center_{c}")
    return out.select(
        F.concat_ws(":", F.lit("osmw"), "slug", F.substring(F.md5(corner), 1, 8)).alias("id"), "name", "slug", F.col("operator").alias("area"), F.col("operator").alias("org"), "surface", "ref", F.round("miles", 2).alias("length_miles"),
        F.when((F.col("part_count") == 1) & (F.col("open_mi") < 0.05), "loop").otherwise("out-and-back").alias("route_type"),
        "min_lng", "min_lat", "max_lng", "max_lat", middle("lng"), middle("lat"), "segment_count", "part_count", "parts",
    )


def composed(found: DataFrame, out_and_back: bool = True) -> DataFrame:
    """Whole hikes from one-way routes (miles, gain_ft, loss_ft): the way back climbs what the way out came down."""
    times = 2 if out_and_back else 1
    gain = F.col("gain_ft") + (F.coalesce("loss_ft", F.lit(0)) if out_and_back else F.lit(0))
    return found.withColumn("total_miles", F.round(F.col("miles") * times, 2)).withColumn("total_gain_ft", gain).withColumn("route_type", F.lit("out-and-back" if out_and_back else "point-to-point"))


def leg_runs(route: DataFrame) -> DataFrame:
    """(route_id, leg, name, miles, edges): consecutive edges (route_id, seq, name, miles) of one name.

    A stitch takes the name before it, or the first name after it where the route opens on one.
    """
    by = Window.partitionBy("route_id").orderBy("seq")
    real = F.when(F.col("name") != STITCH, F.col("name"))
    named = route.withColumn("own", F.coalesce(F.last(real, True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.first(real, True).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.lit("connector")))
    new = F.coalesce((F.lag("own").over(by) != F.col("own")).cast("int"), F.lit(0))
    run = named.withColumn("new", new).withColumn("leg", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return run.groupBy("route_id", "leg", F.col("own").alias("name")).agg(F.sum("miles").alias("miles"), F.count(F.lit(1)).alias("edges"))


def merged_legs(names: list[str], miles: list[float], least: float = SHORT_LEG_MI) -> list[tuple[str, float]]:
    """Legs below ``least`` given to their longer neighbour, shortest first; then equal neighbours joined."""
    legs = [[n, m] for n, m in zip(names, miles)]
    while len(legs) > 1 and (small := min(range(len(legs)), key=lambda i: legs[i][1])) is not None and legs[small][1] < least:
        beside = [i for i in (small - 1, small + 1) if 0 <= i < len(legs)]
        to = max(beside, key=lambda i: legs[i][1])  # ties to the one before
        legs[to][1] = round(legs[to][1] + legs[small][1], 2)
        del legs[small]
    out: list[list] = []
    for name, m in legs:
        if out and out[-1][0] == name:
            out[-1][1] = round(out[-1][1] + m, 2)
        else:
            out.append([name, m])
    return [(n, m) for n, m in out]


def absorb_legs(legs: DataFrame, least: float = SHORT_LEG_MI) -> DataFrame:
    """merged_legs for each route of leg_runs; sequential by nature, so a task folds one route after another, whose rows a window brings together in order."""
    by = Window.partitionBy("route_id").orderBy("leg", "name", "miles")
    rows = legs.select("route_id", "leg", "name", F.round("miles", 2).alias("miles"))
    rows = rows.withColumn("_n", F.row_number().over(by)).select("route_id", "name", "miles", "_n")

    def absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, names, miles, out, kind = None, [], [], [], None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.string(), pa.float64()))], names=["route_id", "leg", "name", "miles"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for r, name, m, n in zip(*(c.to_pylist() for c in batch.columns)):
                if n == 1:
                    out += [(route, i, *x) for i, x in enumerate(merged_legs(names, miles, least))]
                    route, names, miles = r, [], []
                    if len(out) > 10_000:
                        yield told()
                        out = []
                names.append(name)
                miles.append(m)
        out += [(route, i, *x) for i, x in enumerate(merged_legs(names, miles, least))]
        if out:
            yield told()

    return rows.mapInArrow(absorb, f"route_id {dict(legs.dtypes)['route_id']}, leg long, name string, miles double")


def component_labels(edge: DataFrame) -> DataFrame:
    """(node, label): the smallest node that edges (src, dst) reach, by alternating stars (Kiveris et al., 2014).

    Each round hangs larger neighbours, then smaller ones, under the least neighbour, until
    every edge leads to its component's least node. A round is a grouped minimum and a
    join; lineage is cut by checkpoint(). Nodes whose only edge is to themselves are their own label.
    """
    sides = edge.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    alone = edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    e, seen = cut(sides.filter("u <> v").distinct()), None
    while True:
        sign = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign[0] == 0 or sign == seen:
            label = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return alone.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        seen = sign
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        pairs = larger.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(pairs.select("x.*").filter("u <> v").distinct())
