"""Spatial joins as equi-joins on grid cells.

A bare distance condition plans as a nested loop. Here the probing side is exploded to the
cells its radius can reach, so the join is a hash join on two integers and the distance is
only computed for neighbours. A cell that holds many points is split by AQE's skew join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.geo import EARTH_MI, MILES_PER_DEGREE, cell, column, crossed, haversine, probes, to_segment
from talus.operators.lineage import cut

LEAST_CELL = 0.001


def radius_join(left: DataFrame, right: DataFrame, miles: float, size: float | None = None, radius: float = EARTH_MI, on: list[str] = (), spread: str = "left") -> DataFrame:
    """Rows of left (lat, lng, ...) with each row of right within ``miles``, and distance_raw.

    Both sides need lat and lng; right's columns other than these must differ from left's.
    Right is bucketed once; left probes every cell that overlaps its radius, at any
    latitude and across the 180th meridian. Cells are as wide as the radius unless ``size``
    (in degrees of latitude) is given: wider ones hold more strangers, narrower ones take more probes.
    Columns ``on``, which both sides have, must be equal as well. With ``spread="right"`` it is
    right that is copied to all cells in its reach, and each row of left stays one: the way
    for many rows on the left and few, or a wide radius, on the right.
    """
    size = size or max(LEAST_CELL, miles / MILES_PER_DEGREE)
    lat, lng = F.col("lat"), F.col("lng")
    far = right.withColumnsRenamed({"lat": "r_lat", "lng": "r_lng"})
    if spread == "right":
        near = _in_cell(left, "lat", "lng", size).join(_in_reach(far, "r_lat", "r_lng", miles, size, radius), ["_r", "_c", *on])
    else:
        near = _in_reach(left, "lat", "lng", miles, size, radius).join(_in_cell(far, "r_lat", "r_lng", size), ["_r", "_c", *on])
    near = near.withColumn("distance_raw", haversine(lat, lng, F.col("r_lat"), F.col("r_lng"), radius))
    return near.filter(F.col("distance_raw") <= miles).drop("_r", "_c")


CHUNK = 512  # rows of one place that go together


def radius_pairs(left: DataFrame, right: DataFrame, miles: float, size: float | None = None) -> DataFrame:
    """As radius_join, for many rows at the same places, whose columns other than lat and lng differ in name; right's places are not told.

    Distances are found once for two places. Their rows, in arrays of about ``CHUNK``, are dealt out evenly
    before they are paired, so pairs are never shuffled and no place or cell is one task's.
    """
    near = radius_join(_places(left), _places(right), miles, size)
    far = _chunks(right, "_b").withColumnsRenamed({"lat": "r_lat", "lng": "r_lng"})
    held = near.join(_chunks(left, "_a"), ["lat", "lng"]).join(far, ["r_lat", "r_lng"])
    dealt = held.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = dealt.select("lat", "lng", "distance_raw", "_b", F.explode("_a").alias("_a")).select("lat", "lng", "distance_raw", "_a", F.explode("_b").alias("_b"))
    return pairs.select("lat", "lng", "_a.*", "_b.*", "distance_raw")


def _chunks(df: DataFrame, name: str) -> DataFrame:
    """(lat, lng, name): each place's rows in arrays of about CHUNK, dealt out by their hash."""
    rest = [c for c in df.columns if c not in ("lat", "lng")]
    many = df.groupBy("lat", "lng").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n"))
    dealt = df.join(many, ["lat", "lng"]).withColumn("_k", F.pmod(F.xxhash64(*rest), F.col("_n")))
    return dealt.groupBy("lat", "lng", "_k").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("_k")


def _in_cell(df: DataFrame, lat: str, lng: str, size: float) -> DataFrame:
    return df.withColumn("_r", cell(F.col(lat), size)).withColumn("_c", column(F.col(lng), F.col("_r"), size))


def _in_reach(df: DataFrame, lat: str, lng: str, miles: float, size: float, radius: float) -> DataFrame:
    """A row for each cell that a circle round the place can reach."""
    up, row = math.ceil(miles / MILES_PER_DEGREE / size), cell(F.col(lat), size)
    return df.withColumn("_r", F.explode(F.sequence(row - up, row + up))).withColumn("_c", F.explode(probes(F.col(lat), F.col(lng), F.col("_r"), miles, size, radius)))


def near_segments(points: DataFrame, segments: DataFrame, miles: float, size: float | None = None, radius: float = EARTH_MI) -> DataFrame:
    """Rows of points (lat, lng, ...) with each segment (a_lat, a_lng, b_lat, b_lng, ...) within ``miles``, and ``near``, to_segment's struct.

    A segment is dealt to all cells it crosses, so a place on it is found however far its
    ends are, at any latitude and across the 180th meridian. A pair may be told more than once,
    once for each cell in which it meets; aggregates such as minima don't mind.
    """
    size = size or max(LEAST_CELL, miles / MILES_PER_DEGREE)
    a_lat, a_lng, b_lat, b_lng = (F.col(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng"))
    held = segments.withColumn("_r", F.explode(F.sequence(cell(F.least(a_lat, b_lat), size), cell(F.greatest(a_lat, b_lat), size))))
    held = held.withColumn("_c", F.explode(F.array_distinct(crossed(a_lat, a_lng, b_lat, b_lng, F.col("_r"), size))))
    met = _in_reach(points, "lat", "lng", miles, size, radius).join(held, ["_r", "_c"]).drop("_r", "_c")
    return met.withColumn("near", to_segment(F.col("lat"), F.col("lng"), a_lat, a_lng, b_lat, b_lng, radius)).filter(F.col("near.d") <= miles)


def segments_of(vertices: DataFrame, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """(path, seq, a_lat, a_lng, b_lat, b_lng): the segments of lines, numbered by their first vertex; a line of one vertex is a segment without length."""
    by = Window.partitionBy(path).orderBy(seq)
    ends = vertices.select(path, seq, F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.lead("lat").over(by).alias("b_lat"), F.lead("lng").over(by).alias("b_lng"), F.lag(seq).over(by).alias("_first"))
    alone = F.col("b_lat").isNull() & F.col("_first").isNull()
    return ends.filter(F.col("b_lat").isNotNull() | alone).withColumn("b_lat", F.coalesce("b_lat", "a_lat")).withColumn("b_lng", F.coalesce("b_lng", "a_lng")).drop("_first")


def nearest_line(points: DataFrame, segments: DataFrame, miles: float, point: str = "id", line: str = "path_id", seq: str = "seq") -> DataFrame:
    """(point, line, seq, distance_mi, lat, lng): the nearest place on any of many lines within ``miles`` of each point.

    Distances are told to a millionth of a mile; ties go to the smaller line, then segment. Points at one place look once.
    """
    near = near_segments(_places(points), segments, miles).select(F.col("lat").alias("_y"), F.col("lng").alias("_x"), F.struct(F.round("near.d", 6).alias("distance_mi"), line, seq, F.col("near.lat").alias("lat"), F.col("near.lng").alias("lng")).alias("b"))
    best = near.groupBy("_y", "_x").agg(F.min("b").alias("b"))
    return points.select(point, F.col("lat").alias("_y"), F.col("lng").alias("_x")).join(best, ["_y", "_x"]).select(point, "b.*")


def _places(vertices: DataFrame) -> DataFrame:
    """The distinct positions of vertices: paths share ground, and a place needs its neighbours once."""
    return vertices.select("lat", "lng").distinct()


def lines_of(vertices: DataFrame, path: str = "path_id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(of, own): (path, _line) for each path, _line the smallest path with the same vertices, and the vertices (_line, seq, lat, lng) of those.

    What depends on a path's places alone is found once for all paths that share them. Paths
    are told apart by sums of two hashes of their vertices, so nothing is collected by path.
    """
    h = [F.xxhash64(seq, "lat", "lng"), F.xxhash64("lng", "lat", seq, F.lit(1))]
    sums = [f(x) for x in h for f in (lambda x: F.sum(F.shiftright(x, 32)), lambda x: F.sum(x.bitwiseAND(0xFFFFFFFF)))]
    keys = [f"_h{i}" for i in range(len(sums))]
    told = vertices.groupBy(path).agg(*[x.alias(k) for x, k in zip(sums, keys)])
    first = told.groupBy(*keys).agg(F.min(path).alias("_line"))
    of = told.join(first, keys).select(path, "_line")
    own = vertices.select(F.col(path).alias("_line"), seq, "lat", "lng").join(first.select("_line"), "_line", "left_semi")
    return of, own


def near_path(vertices: DataFrame, points: DataFrame, miles: float, stride: int = 1, path: str = "path_id", seq: str = "seq", point: str = "id", size: float | None = None, limits: tuple[dict[str, float], float | None] | None = None) -> DataFrame:
    """For each path and point within ``miles`` of a sampled vertex, the nearest such vertex.

    Vertices are sampled at seq % stride = 0. distance_mi is rounded to three places; the
    first vertex wins ties. Distances are found for lines and places, each once however many
    paths and points share them; pairs of a path and a point come out of the last join and
    are never shuffled, but for those of points whose id stands at several places. With
    ``limits`` (radii by kind, default) rows beyond their kind's radius are left out early;
    within_kind() then decides exactly.
    """
    of, own = lines_of(vertices.filter(F.col(seq) % stride == 0), path, seq)
    near = _near_places(own, points, miles, "_line", seq, size).join(of, "_line").drop("_line")
    # few bytes that make very many rows: dealt out here by number, or too few tasks would get them
    dealt = near.repartition(int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), path)
    return _spread(dealt, points, path, seq, point, limits)


def near_lines(vertices: DataFrame, points: DataFrame, miles: float, path: str = "path_id", seq: str = "seq", point: str = "id", size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(of, near): lines_of's paths, and near_path for lines, told by _line, for what is summed up before paths are joined."""
    of, own = lines_of(vertices, path, seq)
    return of, _spread(_near_places(own, points, miles, "_line", seq, size), points, "_line", seq, point)


def _near_places(vertices: DataFrame, points: DataFrame, miles: float, path: str, seq: str, size: float | None) -> DataFrame:
    """(path, r_lat, r_lng, distance_mi, seq): the nearest vertex of each path to each place of points within reach."""
    near = radius_join(_places(vertices), _places(points), miles, size).withColumn("distance_mi", F.round("distance_raw", 3))
    best = vertices.join(near, ["lat", "lng"]).groupBy(path, "r_lat", "r_lng").agg(F.min(F.struct("distance_mi", seq)).alias("b"))
    return best.select(path, "r_lat", "r_lng", "b.*")


def _spread(near: DataFrame, points: DataFrame, path: str, seq: str, point: str, limits: tuple | None = None) -> DataFrame:
    """near's places as their points: a row a path and point."""
    rest = [c for c in points.columns if c not in (point, "lat", "lng")]
    again = points.groupBy(point).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(point)

    def pairs(some: DataFrame) -> DataFrame:
        # a place's points leave the join in arrays, which costs half of what a row each does
        held = _chunks(some.select("lat", "lng", point, *rest), "_b").withColumnsRenamed({"lat": "r_lat", "lng": "r_lng"})
        out = near.join(held, ["r_lat", "r_lng"]).select(path, "distance_mi", seq, "r_lat", "r_lng", F.inline("_b"))
        if limits is not None:
            out = out.filter(F.col("distance_mi") <= kind_limit(*limits) + 0.001)
        return out.select(path, point, "distance_mi", seq, *rest, F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng"))

    if again.isEmpty():
        return pairs(points)
    best = pairs(points.join(again, point, "left_semi")).groupBy(path, point).agg(F.min(F.struct("distance_mi", seq, *rest, "lat", "lng")).alias("b")).select(path, point, "b.*")
    return pairs(points.join(again, point, "left_anti")).unionByName(best)


def nearest_of_kind(vertices: DataFrame, points: DataFrame, limits: dict[str, float], default: float | None = None, stride: int = 1, path: str = "path_id", seq: str = "seq", size: float | None = None) -> DataFrame:
    """For each path and kind the nearest point (id, name, kind, lat, lng) within the kind's radius of a sampled vertex.

    Ties of the rounded distance go to the smaller id. The nearest of a path is the nearest
    of its places' nearest, so each place keeps one point a kind before paths are joined.
    """
    sampled = vertices.filter(F.col(seq) % stride == 0).select(path, "lat", "lng")
    near = radius_join(_places(sampled), points.select("id", "name", "kind", "lat", "lng"), max([*limits.values(), default or 0.0]), size).withColumn("distance_mi", F.round("distance_raw", 3))
    near = within_kind(near, limits, default)
    least = F.min(F.struct("distance_mi", "id", "name", "r_lat", "r_lng")).alias("b")
    near = sampled.join(near.groupBy("lat", "lng", "kind").agg(least).select("lat", "lng", "kind", "b.*"), ["lat", "lng"])
    return near.groupBy(path, "kind").agg(least).select(path, "kind", "b.id", "b.name", "b.distance_mi", F.col("b.r_lat").alias("lat"), F.col("b.r_lng").alias("lng"))


def kind_limit(limits: dict[str, float], default: float | None) -> Column:
    """The radius of a row's kind."""
    limit = F.lit(default).cast("double")
    for kind, miles in limits.items():
        limit = F.when(F.col("kind") == kind, miles).otherwise(limit)
    return limit


def within_kind(near: DataFrame, limits: dict[str, float], default: float | None) -> DataFrame:
    """Rows whose rounded distance is within their kind's own radius; kinds without one use default."""
    return near.filter(F.col("distance_mi") <= kind_limit(limits, default))


def nearest_per(near: DataFrame, keys: list[str], k: int = 1, order: list | None = None) -> DataFrame:
    """The k nearest rows for each combination of keys, numbered by ``rank``.

    rank <= k is turned into a grouped limit before the shuffle by the optimizer.
    """
    by = Window.partitionBy(*keys).orderBy(*(order or ["distance_mi", "id"]))
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def sampled(vertices: DataFrame, n: int, path: str = "path_id", seq: str = "seq", nearest: bool = True) -> DataFrame:
    """At most n evenly spaced vertices of each path with both ends; places between two are rounded, or cut with nearest=False."""
    by = Window.partitionBy(path)
    place = F.row_number().over(by.orderBy(seq)) - 1
    v = vertices.withColumn("_at", place).withColumn("_n", F.count(F.lit(1)).over(by))
    step = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.bround if nearest else F.floor)(i * (F.col("_n") - 1) / (n - 1)).cast("int"))
    return v.filter((F.col("_n") <= n) | F.array_contains(step, F.col("_at"))).drop("_at", "_n")


def waters_near(vertices: DataFrame, waters: DataFrame, miles: float = 0.5, k: int = 40, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """The k nearest waters (id, name, kind, lat, lng) to eight samples of each path; repeated ids count once."""
    first = nearest_per(waters.dropDuplicates(["id", "lat", "lng"]), ["lat", "lng"], k, ["id"]).drop("rank")  # others of a place can't be among k
    of, near = near_lines(sampled(vertices, 8, path, seq, nearest=False), first, miles, path, seq)
    return nearest_per(near, ["_line"], k).join(of, "_line").drop("_line")


def permits_near(vertices: DataFrame, permits: DataFrame, names: DataFrame, miles: float = 35.0, k: int = 3, stride: int = 12) -> DataFrame:
    """The k nearest permits of each path (rows of permits where is_permit), by its sampled vertices.

    permits: id, permit, keywords array<string>, is_permit, lat, lng. ``advisory`` unless one
    of the keywords, of more than four letters, and the path's name (names: path_id, name)
    hold each other: one place stands for a whole area, so nearness alone proves little.
    """
    held = permits.filter("is_permit").select("id", "permit", "keywords", "lat", "lng")
    of, own = lines_of(vertices.filter(F.col("seq") % stride == 0))
    near = radius_join(_places(own), held, miles, size=max(0.1, miles / MILES_PER_DEGREE), spread="right")
    near = own.join(near.withColumn("distance_mi", F.round("distance_raw", 3)), ["lat", "lng"]).groupBy("_line", "id").agg(F.min("distance_mi").alias("distance_mi"), F.min(F.struct("permit", "keywords")).alias("p"))
    best = nearest_per(near, ["_line"], k).join(of, "_line").join(names.select("path_id", F.lower("name").alias("_name")), "path_id", "left")
    named = lambda w: (F.length(w) > 4) & (F.contains(F.col("_name"), F.lower(w)) | F.contains(F.lower(w), F.col("_name")))
    sure = (F.coalesce("_name", F.lit("")) != "") & F.coalesce(F.exists("p.keywords", named), F.lit(False))
    return best.select("path_id", "id", "p.permit", "distance_mi", "rank", (~sure).alias("advisory"))


def photos_near(vertices: DataFrame, photos: DataFrame, miles: float, k: int = 8, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """The k best photos (id, title, relevance, lat, lng) of each path: the nearest of each title to five samples, most relevant first."""
    first = photos.groupBy("title", "lat", "lng").agg(F.min(F.struct("id", "relevance")).alias("b")).select("b.id", "title", "b.relevance", "lat", "lng")
    of, near = near_lines(sampled(vertices, 5, path, seq), first, miles, path, seq)
    best = near.groupBy("_line", "title").agg(F.min(F.struct("distance_mi", "id", "relevance")).alias("b")).select("_line", "title", "b.*")
    return nearest_per(best, ["_line"], k, [F.desc("relevance"), F.asc("distance_mi"), F.asc("title")]).join(of, "_line").drop("_line")


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point with a closed ring, array<struct<lng, lat>>, as a fold over its edges."""
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))

    def crosses(inside: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.when(spans, b["lat"] - a["lat"]).otherwise(1.0) + a["lng"]
        return inside != (spans & (lng < at))

    return F.aggregate(edges, F.lit(False), crosses)


def in_polygon(lng: Column, lat: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the holes after it."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(lng, lat, rings[0]) & ~F.exists(holes, lambda h: in_ring(lng, lat, h))


_SHIFT = 0.3819660113  # of a cell: borders of cells stay off the round numbers that corners of areas have


def ring_cells(areas: DataFrame, size: float) -> DataFrame:
    """Cells (_r, _c) that areas (ord, name, rings) touch: (ord, name, ring, inside, edges).

    A cell that a ring passes through keeps the ring's edges in that cell alone, and
    ``inside``, whether its lower left corner is in the ring; one within the ring has
    no edges. Edges are dealt to the cells they cross, and crossings with the
    bottom of a row, added up from the left, tell which corners are inside, so no task
    needs a whole ring.
    """
    along = lambda x: F.floor(x / F.lit(size) - F.lit(_SHIFT)).cast("long")
    border = lambda k: (k + F.lit(_SHIFT)) * F.lit(size)
    ring = areas.select("ord", "name", F.posexplode("rings").alias("ring", "v")).filter(F.size("v") > 2)
    edge = ring.select("ord", "name", "ring", F.explode(F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.struct(F.get("v", i - 1).alias("a"), F.get("v", i).alias("b")))).alias("e"))
    edge = edge.select("ord", "name", "ring", "e.a", "e.b").filter("a <> b")
    rise, run = F.col("b.lat") - F.col("a.lat"), F.col("b.lng") - F.col("a.lng")
    x_at = lambda lat: F.col("a.lng") + run * ((lat - F.col("a.lat")) / F.when(rise != 0, rise))
    bottom, top = F.least("a.lat", "b.lat"), F.greatest("a.lat", "b.lat")
    row = F.col("_r")
    edge = edge.withColumn("_r", F.explode(F.sequence(along(bottom), along(top))))
    west, east = F.least("a.lng", "b.lng"), F.greatest("a.lng", "b.lng")
    ends = [F.when(rise == 0, x).otherwise(F.least(east, F.greatest(west, x_at(y)))) for x, y in ((west, F.greatest(bottom, border(row))), (east, F.least(top, border(row + 1))))]
    edge = edge.withColumn("_c", F.explode(F.sequence(along(F.least(*ends) - 1e-9), along(F.greatest(*ends) + 1e-9))))
    line = border(row)
    falls = (F.col("a.lat") > line) != (F.col("b.lat") > line)
    edge = edge.withColumn("_falls", (falls & (along(x_at(line)) == F.col("_c"))).cast("int"))
    held = edge.groupBy("ord", "name", "ring", "_r", "_c").agg(F.collect_list(F.struct("a", "b")).alias("edges"), F.sum("_falls").alias("_falls"))
    by = Window.partitionBy("ord", "ring", "_r").orderBy("_c")
    so_far = F.sum("_falls").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = held.withColumn("_through", so_far).withColumn("_next", F.lead("_c").over(by))
    cells = held.select("_r", "_c", "ord", "name", "ring", ((F.col("_through") - F.col("_falls")) % 2 == 1).alias("inside"), "edges")
    gap = held.filter((F.col("_through") % 2 == 1) & (F.col("_next") > F.col("_c") + 1))
    within = gap.select("_r", F.explode(F.sequence(F.col("_c") + 1, F.col("_next") - 1)).alias("_c"), "ord", "name", "ring", F.lit(True).alias("inside"), F.slice("edges", 1, 0).alias("edges"))
    return cells.unionByName(within)


def in_cell_ring(lng: Column, lat: Column, corner_lng: Column, corner_lat: Column, inside: Column, edges: Column) -> Column:
    """Whether a place is in a ring, from its cell's corner: up the cell's left border, then level to the place, turning at each edge."""

    def crosses(now: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        up = (a["lng"] > corner_lng) != (b["lng"] > corner_lng)
        v = a["lat"] + (corner_lng - a["lng"]) * (b["lat"] - a["lat"]) / F.when(up, b["lng"] - a["lng"]).otherwise(1.0)
        level = (a["lat"] > lat) != (b["lat"] > lat)
        h = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.when(level, b["lat"] - a["lat"]).otherwise(1.0) + a["lng"]
        return (now != (up & (v > corner_lat) & (v <= lat))) != (level & (h > corner_lng) & (h <= lng))

    return F.aggregate(edges, inside, crosses)


def area_of_points(points: DataFrame, areas: DataFrame, size: float = 0.1) -> DataFrame:
    """Adds to each point (lat, lng, ...) the first area (ord, name, rings) that contains it, or NULL.

    An area contains what is in its first ring and in none of the holes after it. A cell
    keeps its rings as an array, each with its edges in that cell only (see ring_cells), so a
    point meets its cell once and stays one row, whatever the size of the areas. ``size`` is
    a cell's side in degrees: the finer the areas' borders, the smaller it should be.
    """
    lat, lng = F.col("lat"), F.col("lng")
    held = F.struct("ord", "name", "ring", "inside", "edges")
    cells = ring_cells(areas, size).groupBy("_r", "_c").agg(F.collect_list(held).alias("_rings"))
    along = lambda x: F.floor(x / F.lit(size) - F.lit(_SHIFT)).cast("long")
    border = lambda k: (k + F.lit(_SHIFT)) * F.lit(size)
    met = points.withColumn("_r", along(lat)).withColumn("_c", along(lng)).join(cells, ["_r", "_c"], "left")
    hit = F.filter("_rings", lambda g: in_cell_ring(lng, lat, border(F.col("_c")), border(F.col("_r")), g["inside"], g["edges"]))
    met = met.withColumn("_hit", F.transform(hit, lambda g: F.struct(g["ord"].alias("ord"), g["name"].alias("name"), g["ring"].alias("ring"))))
    holes = F.transform(F.filter("_hit", lambda g: g["ring"] > 0), lambda g: g["ord"])
    first = F.array_min(F.filter("_hit", lambda g: (g["ring"] == 0) & ~F.array_contains(holes, g["ord"])))
    met = met.withColumn("_area", first)
    return met.select(*points.columns, F.col("_area.ord").alias("area_ord"), F.col("_area.name").alias("area_name"))


def area_of_paths(points: DataFrame, least: float = 0.2, whole: float = 0.99) -> DataFrame:
    """(path_id, area_name, inside_fraction, fully_inside) from points with area_name: the commonest area.

    inside_fraction counts points in any area; below ``least`` the path has no area.
    """
    counts = points.groupBy("path_id", "area_ord", "area_name").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("area_name").isNotNull(), F.struct(F.col("n"), -F.col("area_ord"), F.col("area_name").alias("name")))
    paths = counts.groupBy("path_id").agg(F.sum("n").alias("points"), F.coalesce(F.sum(F.when(F.col("area_name").isNotNull(), F.col("n"))), F.lit(0)).alias("hits"), F.max(named).alias("best"))
    share = F.col("hits") / F.col("points")
    found = share >= least
    return paths.select("path_id", F.when(found, F.col("best.name")).alias("area_name"), F.round(share, 3).alias("inside_fraction"), (share >= whole).alias("fully_inside"))


def merge_points(primary: DataFrame, supplement: DataFrame, miles: float = 0.3, size: float = 0.01) -> DataFrame:
    """primary with the rows of supplement that repeat none of it nor an earlier accepted row.

    Rows (id, kind, name, lat, lng, ord) repeat each other when of one kind, within
    ``miles``, and of the same name or one without a name. Against primary this is an anti
    join. Within supplement a row is accepted if no accepted earlier row repeats it. Each
    round accepts the rows that no undecided earlier row repeats and drops their
    repeats, so rounds are few however many rows there are, and no group meets in one task.
    Of rows of one place, kind and name only the first can be accepted, since what repeats it
    repeats all of them, so only first ones meet others.
    """
    alike = ["kind", F.lower("name").alias("_name"), "lat", "lng"]
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    least = supplement.filter(placed).groupBy(*alike).agg(F.min("ord").alias("_ord")).withColumnsRenamed({"kind": "_kind", "lat": "_lat", "lng": "_lng"})
    of_one = F.col("kind").eqNullSafe(F.col("_kind")) & F.lower("name").eqNullSafe(F.col("_name")) & (F.col("lat") == F.col("_lat")) & (F.col("lng") == F.col("_lng")) & (F.col("ord") == F.col("_ord"))
    supplement = supplement.join(least, of_one, "left_semi").unionByName(supplement.filter(~placed))
    known = primary.select("kind", F.lower("name").alias("name"), "lat", "lng").distinct().withColumn("id", F.lit(None).cast("string"))
    same = F.col("a_kind").eqNullSafe(F.col("kind")) & (F.col("a_name").isNull() | F.col("name").isNull() | (F.lower("a_name") == F.lower("name")))
    probe = lambda df: df.select(F.col("id").alias("a_id"), F.col("ord").alias("a_ord"), F.col("kind").alias("a_kind"), F.col("name").alias("a_name"), "lat", "lng")
    taken = radius_join(probe(supplement), known, miles, size).filter(same).select(F.col("a_id").alias("id")).distinct()
    rest = cut(supplement.join(taken, "id", "left_anti"))
    later = radius_join(probe(rest), rest.select("id", "ord", "kind", "name", "lat", "lng"), miles, size).filter(same & (F.col("a_ord") > F.col("ord")))
    links = cut(later.select(F.col("a_id").alias("later"), F.col("id").alias("earlier")).distinct())
    while links.limit(1).count():
        first = links.select("earlier").distinct().join(links.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        repeats = cut(links.join(first, "earlier").select("later").distinct())
        rest = rest.join(repeats.withColumnRenamed("later", "id"), "id", "left_anti")
        links = cut(links.join(repeats, "later", "left_anti").join(repeats.withColumnRenamed("later", "earlier"), "earlier", "left_anti"))
    return primary.unionByName(rest, allowMissingColumns=True)
