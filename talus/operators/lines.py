"""Ordered computations along a path: windows where a window expresses them, folds where state resets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.geo import EARTH_MI, EARTH_MI_FINE, haversine

GAIN_THRESHOLD_FT, JOIN_DEG = 15.0, 1e-4
FEW_PARTS = 4
WHOLE_PATH = 100_000  # vertices of a path that one task chains without looking for networks


def steps(vertices: DataFrame, path: str = "path_id", seq: str = "seq", radius: float = EARTH_MI) -> DataFrame:
    """Adds step_mi, the distance from the previous vertex (0 at the first), and run_mi, the distance so far."""
    by = Window.partitionBy(path).orderBy(seq)
    before = lambda c: F.lag(c).over(by)
    step = F.coalesce(haversine(before("lat"), before("lng"), F.col("lat"), F.col("lng"), radius), F.lit(0.0))
    out = vertices.withColumn("step_mi", step)
    return out.withColumn("run_mi", F.sum("step_mi").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def path_lengths(vertices: DataFrame, path: str = "path_id", seq: str = "seq") -> DataFrame:
    return steps(vertices, path, seq).groupBy(path).agg(F.sum("step_mi").alias("miles"), F.count(F.lit(1)).alias("vertices"))


def midpoints(vertices: DataFrame, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """The first vertex at or past half of each path's length."""
    whole = Window.partitionBy(path)
    run = steps(vertices, path, seq).withColumn("total_mi", F.max("run_mi").over(whole))
    half = run.filter(F.col("run_mi") >= F.col("total_mi") / 2)
    return half.groupBy(path).agg(F.min(F.struct(seq, "lat", "lng")).alias("m")).select(path, F.col(f"m.{seq}").alias(seq), F.col("m.lat").alias("lat"), F.col("m.lng").alias("lng"))


def point_at_mile(vertices: DataFrame, mile: Column, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """The interpolated point of each path at a distance from its start; none beyond its end."""
    by = Window.partitionBy(path).orderBy(seq)
    run = steps(vertices, path, seq).withColumn("a_lat", F.lag("lat").over(by)).withColumn("a_lng", F.lag("lng").over(by)).withColumn("a_mi", F.lag("run_mi").over(by))
    on = run.filter((F.col("a_mi") <= mile) & (mile <= F.col("run_mi")) & (F.col("step_mi") > 0))
    share = (mile - F.col("a_mi")) / F.col("step_mi")
    at = on.select(path, F.struct(seq, (F.col("a_lat") + share * (F.col("lat") - F.col("a_lat"))).alias("lat"), (F.col("a_lng") + share * (F.col("lng") - F.col("a_lng"))).alias("lng")).alias("p"))
    return at.groupBy(path).agg(F.min("p").alias("p")).select(path, F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))


def gain_loss(elevations: Column, threshold: float = GAIN_THRESHOLD_FT) -> Column:
    """struct(gain, loss) of a series with hysteresis: a turn counts once it exceeds the threshold.

    The fold keeps the last confirmed height and the extreme reached since in the current
    direction (1 up, -1 down, 0 none yet); swings below the threshold add nothing.
    """
    known = F.filter(elevations, lambda x: x.isNotNull())
    start = F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"), F.get(known, F.lit(0)).cast("double").alias("anchor"), F.lit(0).alias("way"))

    def step(s: Column, x: Column) -> Column:
        move = x - s["anchor"]
        onward = ((s["way"] > 0) & (move > 0)) | ((s["way"] < 0) & (move < 0))
        turn = F.abs(move) >= threshold
        count = onward | turn
        return F.struct(
            (s["gain"] + F.when(count & (move > 0), move).otherwise(0.0)).alias("gain"),
            (s["loss"] + F.when(count & (move < 0), -move).otherwise(0.0)).alias("loss"),
            F.when(count, x).otherwise(s["anchor"]).alias("anchor"),
            F.when(turn & (move > 0), 1).when(turn & (move < 0), -1).otherwise(s["way"]).alias("way"),
        )

    return F.when(F.size(elevations) >= 2, F.aggregate(F.transform(known, lambda x: x.cast("double")), start, step, lambda s: F.struct(s["gain"].alias("gain"), s["loss"].alias("loss")))).otherwise(F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss")))


def turns(series: np.ndarray, threshold: float, before: list[float] = ()) -> list[float]:
    """The heights of before + series that decide what a fold with hysteresis makes of them, whatever it has seen until then.

    Within a run up or down only its end counts. A swing back below the threshold that the
    heights on both sides enclose counts for nothing: either it was too small to turn the
    fold, or an earlier height had turned it. So turns(b, before=turns(a)) stands for a + b.
    """
    kept = list(before)
    if len(series):
        moved = series.tolist() if len(series) < 64 else None  # short ones don't repay arrays
        if moved is None:
            heights = np.concatenate((kept[-1:], series))
            way = np.sign(np.diff(heights))
            ends = np.append(way[1:] != way[:-1], True) if len(way) else np.zeros(0, bool)
            moved = ([] if kept else heights[:1].tolist()) + (heights[1:][ends & (way != 0)] if len(way) else heights[:0]).tolist()
        for x in moved:
            if kept and x == kept[-1]:
                continue
            while len(kept) > 1 and (kept[-1] - kept[-2]) * (x - kept[-1]) > 0:
                kept.pop()
            kept.append(x)
            while len(kept) > 3:
                o, p, q, r = kept[-4:]
                if abs(p - q) < threshold and min(o, r) <= min(p, q) and max(p, q) <= max(o, r):
                    del kept[-3:-1]
                else:
                    break
    return kept


def folded(heights: list[float], threshold: float) -> tuple[float, float]:
    """gain_loss() of a list."""
    gain = loss = way = 0.0
    anchor = heights[0] if heights else 0.0
    for x in heights:
        move = x - anchor
        turn = abs(move) >= threshold
        if turn or move * way > 0:
            gain, loss, anchor = gain + max(move, 0.0), loss + max(-move, 0.0), x
            if turn:
                way = 1.0 if move > 0 else -1.0
    return gain, loss


def gains(series: DataFrame, key: str, order: list[str], value: str, threshold: float = GAIN_THRESHOLD_FT) -> DataFrame:
    """(key, gain, loss, n) with hysteresis over each key's known values in the given order, n of them.

    Rows are dealt out in ranges of key and order, so a long series is spread over many tasks;
    each folds its slices to the heights that can matter (see turns), and the slices of a key,
    short now, are joined in their order. Nothing is collected by key, and no array holds a series.
    """
    kind = dict(series.dtypes)[key]
    rows = series.select(F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("x")).filter("x is not null")
    places = [f"o{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange("k", *places).sortWithinPartitions("k", *places).select("k", "x")

    def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
        """(key, values of columns) for each run of equal keys in each batch."""
        for batch in batches:
            keys = batch.column(0).to_pylist()
            begin = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])] if keys else []
            for a, b in zip(begin, [*begin[1:], len(keys)]):
                yield keys[a], [batch.column(c).slice(a, b - a) for c in columns]

    def told(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, key, kept, n, types = TaskContext.get().partitionId(), [], None, [], 0, None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.float64())]
            for k, (x,) in runs(iter([batch]), ["x"]):
                if n and k != key:
                    out.append((key, part, n, kept))
                    kept, n = [], 0
                key, kept, n = k, turns(x.to_numpy(), threshold, kept), n + len(x)
            if len(out) > 10_000:
                yield told(out, ["k", "part", "n", "kept"], types)
                out = []
        if n:
            out.append((key, part, n, kept))
        if out:
            yield told(out, ["k", "part", "n", "kept"], types)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, kept, n, types = [], None, [], 0, None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.float64(), pa.float64(), pa.int64()]
            for k, (number, slices) in runs(iter([batch]), ["n", "kept"]):
                if n and k != key:
                    out.append((key, *folded(kept, threshold), n))
                    kept, n = [], 0
                key = k
                for more, own in zip(number.to_pylist(), slices.to_pylist()):
                    kept, n = turns(np.array(own), threshold, kept), n + more
            if len(out) > 10_000:
                yield told(out, [key_name, "gain", "loss", "n"], types)
                out = []
        if n:
            out.append((key, *folded(kept, threshold), n))
        if out:
            yield told(out, [key_name, "gain", "loss", "n"], types)

    key_name = key
    slices = dealt.mapInArrow(sliced, f"k {kind}, part long, n long, kept array<double>")
    return slices.repartition("k").sortWithinPartitions("k", "part").mapInArrow(joined, f"`{key}` {kind}, gain double, loss double, n long")


def thinned(points: Column, spacing: float) -> Column:
    """Of array<struct<lng, lat, ...>>: the first point, each one ``spacing`` miles on from the last kept, and the last."""
    start = F.struct(F.slice(points, 1, 1).alias("kept"), F.lit(0.0).alias("since"), points[0].alias("prev"))

    def step(s: Column, p: Column) -> Column:
        d = s["since"] + haversine(s["prev"]["lat"], s["prev"]["lng"], p["lat"], p["lng"])
        take = d >= spacing
        return F.struct(F.when(take, F.concat(s["kept"], F.array(p))).otherwise(s["kept"]).alias("kept"), F.when(take, 0.0).otherwise(d).alias("since"), p.alias("prev"))

    done = F.aggregate(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), start, step, lambda s: s["kept"])
    last = F.element_at(points, -1)
    return F.when(F.element_at(done, -1) == last, done).otherwise(F.concat(done, F.array(last)))


def resampled(points: Column, n: int) -> Column:
    """At most n evenly spaced elements with both ends."""
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.size(points) - 1) / (n - 1)).cast("int"))
    return F.when(F.size(points) <= n, points).otherwise(F.transform(at, lambda i: F.get(points, i)))


MAX_PROFILE = 250  # points of a drawn profile


def elevation_summary(heights: Column, miles: Column) -> Column:
    """struct of gain, loss, extremes, ends and profile of sampled heights in feet (NULL: not found) at ``miles`` along.

    NULL unless at least two samples and at least half of all have a height.
    """
    both = F.filter(F.transform(heights, lambda h, i: F.struct(F.get(miles, i).alias("mi"), h.alias("ft"))), lambda p: p["ft"].isNotNull())
    ft = F.transform(both, lambda p: p["ft"])
    g, whole = gain_loss(ft), lambda c: F.bround(c).cast("int")
    profile = F.transform(resampled(both, MAX_PROFILE), lambda p: F.struct(F.round(p["mi"], 3).alias("mi"), whole(p["ft"]).alias("ft")))
    parts = {"gain_ft": whole(g["gain"]), "loss_ft": whole(g["loss"]), "min_ft": whole(F.array_min(ft)), "max_ft": whole(F.array_max(ft)), "start_ft": whole(F.get(ft, F.lit(0))), "end_ft": whole(F.try_element_at(ft, F.lit(-1))), "samples": F.size(ft), "profile": profile}
    trusted = (F.size(ft) >= 2) & (F.size(heights) - F.size(ft) <= F.size(heights) / 2)
    return F.when(trusted, F.struct(*[c.alias(n) for n, c in parts.items()]))


def naive_gain(heights: Column) -> Column:
    """struct(gain_ft, drop_ft) of heights in metres: every rise and fall counts, steps with an unknown end don't."""
    moves = F.transform(F.sequence(F.lit(1), F.greatest(F.size(heights) - 1, F.lit(1))), lambda i: (F.get(heights, i) - F.get(heights, i - 1)) * 3.28084)
    total = lambda test: F.floor(F.aggregate(F.filter(moves, test), F.lit(0.0), lambda a, m: a + F.abs(m)) + 0.5).cast("long")
    return F.struct(total(lambda m: m > 0).alias("gain_ft"), total(lambda m: m < 0).alias("drop_ft"))


def interpolated(vertices: DataFrame, n: int, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """(path, k, lng, lat): n points along each path: every so many vertices of a longer one, else evenly spaced by distance.

    Each step of a path makes the points that fall on it, so nothing is joined. A path
    without length, or of one vertex, keeps its vertices.
    """
    by = Window.partitionBy(path)
    run = steps(vertices, path, seq).withColumns({"_n": F.count(F.lit(1)).over(by), "_at": F.row_number().over(by.orderBy(seq)) - 1, "_all": F.sum("step_mi").over(by)})
    before = {f"_{c}": F.lag(c).over(by.orderBy(seq)) for c in ("lng", "lat", "run_mi")}
    run = run.withColumns(before)
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / n).cast("int"))
    whole = (F.col("_n") >= n) | (F.col("_all") == 0)
    kept = run.filter(whole & (F.col("_at") % stride == 0) & ((F.col("_at") / stride < n) | (F.col("_all") == 0))).select(path, (F.col("_at") / stride).cast("int").alias("k"), "lng", "lat")
    gap = F.col("_all") / (n - 1)
    low = F.when(F.col("_at") == 1, 0).otherwise(F.floor(F.col("_run_mi") / gap) + 1).cast("int")
    high = F.when(F.col("_at") == F.col("_n") - 1, n - 1).otherwise(F.floor(F.col("run_mi") / gap)).cast("int")
    on = run.filter(~whole & (F.col("_at") > 0)).withColumn("low", low).withColumn("high", high).filter("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    share = F.when(F.col("step_mi") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") * gap - F.col("_run_mi")) / F.col("step_mi")))).otherwise(0.0)
    between = lambda c: (F.col(f"_{c}") + share * (F.col(c) - F.col(f"_{c}"))).alias(c)
    return kept.unionByName(on.select(path, "k", between("lng"), between("lat")))


def rescaled(mile: Column, profile_mi: Column, drawn_mi: Column) -> Column:
    """A mile of a profile as a mile of the line as drawn; unchanged where either length is unknown or zero."""
    return F.when((profile_mi > 0) & (drawn_mi > 0), mile / profile_mi * drawn_mi).otherwise(mile)


def snapped_to(points: Column, lat: Column, lng: Column, miles: float = 0.4) -> Column:
    """struct(lng, lat): the nearest place on a line of array<struct<lng, lat>>, or the place itself beyond ``miles``."""

    def on(i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        dx, dy = b["lng"] - a["lng"], b["lat"] - a["lat"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, ((lng - a["lng"]) * dx + (lat - a["lat"]) * dy) / square).otherwise(0.0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        x, y = a["lng"] + t * dx, a["lat"] + t * dy
        return F.struct(haversine(lat, lng, y, x).alias("d"), i.alias("i"), x.alias("lng"), y.alias("lat"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), on))
    return F.when((F.size(points) > 1) & (best["d"] <= miles), F.struct(best["lng"].alias("lng"), best["lat"].alias("lat"))).otherwise(F.struct(lng.alias("lng"), lat.alias("lat")))


def nearest_index(points: Column, lat: Column, lng: Column) -> Column:
    """Which of array<struct<lng, lat>> is nearest; the first of ties, 0 of none."""
    far = F.transform(points, lambda p, i: F.struct(haversine(lat, lng, p["lat"], p["lng"]).alias("d"), i.alias("i")))
    return F.coalesce(F.array_min(far)["i"], F.lit(0))


def put_on_lines(vertices: DataFrame, lat: Column, lng: Column, miles: float = 0.4, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """(path, lng, lat, nearest): a place of each path as snapped_to() puts it on the path's line, and nearest_index() of it.

    ``lat`` and ``lng`` say the place in terms of the path's first vertex (columns path, lat, lng). Each
    vertex is measured as a row of its own, with the segment before it, and the path keeps the least of them.
    """
    by = Window.partitionBy(path).orderBy(seq)
    lag = lambda c: F.lag(c).over(by)
    first = lambda c: F.first(c).over(by)
    v = vertices.select(path, F.col("lat").alias("_y"), F.col("lng").alias("_x"), lag("lat").alias("_ay"), lag("lng").alias("_ax"), first("lat").alias("lat"), first("lng").alias("lng"), (F.row_number().over(by) - 1).alias("_i"))
    v = v.select(path, "_y", "_x", "_ay", "_ax", "_i", lat.alias("_lat"), lng.alias("_lng"), (F.col("_x") - F.col("_ax")).alias("_dx"), (F.col("_y") - F.col("_ay")).alias("_dy"))
    square = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
    t = F.when(square > 0, ((F.col("_lng") - F.col("_ax")) * F.col("_dx") + (F.col("_lat") - F.col("_ay")) * F.col("_dy")) / square).otherwise(0.0)
    v = v.withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    v = v.withColumns({"_on_x": F.col("_ax") + F.col("_t") * F.col("_dx"), "_on_y": F.col("_ay") + F.col("_t") * F.col("_dy")})
    far = lambda y, x: haversine(F.col("_lat"), F.col("_lng"), F.col(y), F.col(x))
    v = v.withColumns({"_d": far("_on_y", "_on_x"), "_near": far("_y", "_x")})
    found = v.groupBy(path).agg(
        F.min(F.when(F.col("_i") > 0, F.struct("_d", "_i", "_on_x", "_on_y"))).alias("b"), F.min(F.struct("_near", "_i")).alias("n"), F.min(F.struct("_i", "_lat", "_lng")).alias("p")
    )
    on = F.col("b._d") <= miles
    return found.select(path, F.when(on, F.col("b._on_x")).otherwise(F.col("p._lng")).alias("lng"), F.when(on, F.col("b._on_y")).otherwise(F.col("p._lat")).alias("lat"), F.col("n._i").alias("nearest"))


def highest(points: DataFrame, key: str = "path_id") -> DataFrame:
    """(key, lat, lng, ele) of each route's highest point; of equal ones the first. Routes without heights have none."""
    return points.filter("ele is not null").groupBy(key).agg(F.max(F.struct("ele", (-F.col("seq")).alias("s"), "lat", "lng")).alias("h")).select(key, "h.lat", "h.lng", "h.ele")


def worst_gap(ends: Column, radius: float = EARTH_MI) -> Column:
    """Metres from the run of array<struct<a, b>> (its end points) that is farthest from any other to its nearest; 0 of one run."""
    gap = lambda p, q: haversine(p["lat"], p["lng"], q["lat"], q["lng"], radius)
    near = lambda r, s: F.least(gap(r["a"], s["a"]), gap(r["a"], s["b"]), gap(r["b"], s["a"]), gap(r["b"], s["b"]))
    least = F.transform(ends, lambda r, i: F.array_min(F.transform(F.filter(ends, lambda s, j: j != i), lambda s: near(r, s))))
    return F.when(F.size(ends) > 1, F.round(F.array_max(least) * 1609.344, 1)).otherwise(0.0)


def loop_tests(parts: Column, roundtrip: Column) -> Column:
    """struct of the four rules by which sources call array<array<point>> closed: by one part, by one route, by one run of ways, by the first part."""
    first = F.get(parts, F.lit(0))
    a, b, z = F.get(first, F.lit(0)), F.try_element_at(first, F.lit(-1)), F.try_element_at(F.try_element_at(parts, F.lit(-1)), F.lit(-1))
    meets = lambda p, q, near: (F.abs(p["lng"] - q["lng"]) < near) & (F.abs(p["lat"] - q["lat"]) < near)
    one = F.size(parts) == 1
    said = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        said(one & meets(a, z, JOIN_DEG)).alias("forest"),
        said((one & (F.size(first) >= 3) & meets(a, b, 1e-3)) | (roundtrip == "yes")).alias("route"),
        said(one & (haversine(a["lat"], a["lng"], b["lat"], b["lng"]) < 0.05)).alias("ways"),
        said((F.size(first) >= 2) & meets(a, b, 1e-3)).alias("feed"),
    )


def simplified(line: np.ndarray, epsilon: float) -> np.ndarray:
    """Which of (n, 2) points Ramer-Douglas-Peucker keeps, with a stack instead of recursion."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        base, inner = line[b] - line[a], line[a + 1 : b] - line[a]
        square = base @ base
        t = np.clip(inner @ base / square, 0, 1) if square else np.zeros(len(inner))
        off = ((inner - t[:, None] * base) ** 2).sum(axis=1)
        k = int(off.argmax())
        if off[k] > epsilon**2:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify_paths(vertices: DataFrame, epsilon: float, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """The vertices (path, seq, lng, lat) that survive simplification; each path is one row of arrays.

    ``path`` may be a struct of a line and its part; see simplify_parts for what becomes of parts.
    """
    rows = vertices.groupBy(path).agg(F.array_sort(F.collect_list(F.struct(seq, "lng", "lat"))).alias("v"))

    @F.pandas_udf("array<int>")
    def kept(lng: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(simplified(np.column_stack((x, y)), epsilon)) for x, y in zip(lng, lat)])

    rows = rows.select(path, "v", F.explode(kept(F.col("v.lng"), F.col("v.lat"))).alias("i"))
    return rows.select(path, F.get("v", "i").alias("p")).select(path, f"p.{seq}", "p.lng", "p.lat")


def simplify_parts(vertices: DataFrame, epsilon: float) -> DataFrame:
    """Vertices (path_id, part, seq, lng, lat) of multi-part lines simplified part by part.

    A part of fewer than two points is dropped; a line that would lose all parts keeps all it had.
    """
    kept = simplify_paths(vertices.withColumn("line", F.struct("path_id", "part")), epsilon, "line").select("line.path_id", "line.part", "seq", "lng", "lat")
    whole = kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path_id", "part"))).filter("_n > 1").drop("_n")
    lost = vertices.join(whole.select("path_id").distinct(), "path_id", "left_anti").select(*whole.columns)
    return whole.unionByName(lost)


def _values(column: pa.Array) -> list:
    """A column's values; numbers without NULL by way of numpy, ten times as fast."""
    return column.to_numpy().tolist() if pa.types.is_primitive(column.type) and not pa.types.is_boolean(column.type) and not column.null_count else column.to_pylist()


def _cell_of(p: tuple[float, float], size: float) -> tuple[int, int]:
    return round(p[0] / size), round(p[1] / size)


def chained(parts: list[list[tuple[float, float]]], near: float = JOIN_DEG, snap: bool = False) -> list[list[tuple[float, float]]]:
    """Parts joined end to end wherever ends are within a box of ``near`` degrees, or, with ``snap``, in one cell of that size; gaps stay gaps.

    A chain starts from the first part left and takes, each time, the first part left that
    has an end at its tail or head: onto its tail if it can be, turned round where needed.
    Ends are looked up by cell, so the work is in proportion to the parts.
    """
    return [chain for _, chain in chains_of(parts, near, snap)]


def chains_of(parts: list[list[tuple[float, float]]], near: float = JOIN_DEG, snap: bool = False) -> list[tuple[int, list[tuple[float, float]]]]:
    """chained(), each chain with the place in ``parts`` of the part it started from."""
    waiting = {k: p for k, p in enumerate(parts) if len(p) > 1}
    if len(waiting) < 2:
        return [(k, list(p)) for k, p in waiting.items()]
    few = len(waiting) <= FEW_PARTS  # are looked through faster than put in cells
    ends: dict[tuple[int, int], dict[int, None]] = {}
    for k, p in () if few else waiting.items():
        for q in (p[0], p[-1]):
            ends.setdefault(_cell_of(q, near), {})[k] = None
    around = [(0, 0)] if snap else [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]

    def meet(p: tuple, q: tuple) -> bool:
        return _cell_of(p, near) == _cell_of(q, near) if snap else abs(p[0] - q[0]) < near and abs(p[1] - q[1]) < near

    def taken(k: int) -> list:
        part = waiting.pop(k)
        for q in () if few else (part[0], part[-1]):
            ends[_cell_of(q, near)].pop(k, None)
        return part

    def first_at(place: tuple) -> int | None:
        if few:
            return next((k for k, p in waiting.items() if meet(place, p[0]) or meet(place, p[-1])), None)
        x, y = _cell_of(place, near)
        held = (ends.get((x + i, y + j), ()) for i, j in around)
        return min((k for ks in held for k in ks if meet(place, waiting[k][0]) or meet(place, waiting[k][-1])), default=None)

    chains = []
    for k in list(waiting):
        if k not in waiting:
            continue
        head, tail = [], list(taken(k))  # the head's points stand turned round
        while True:
            start, end = head[-1] if head else tail[0], tail[-1]
            found = [f for f in (first_at(end), first_at(start)) if f is not None]
            if not found:
                break
            part = taken(min(found))
            if meet(end, part[0]):
                tail += part[1:]
            elif meet(end, part[-1]):
                tail += part[-2::-1]
            elif meet(start, part[-1]):
                head += part[-2::-1]
            else:
                head += part[1:]
        chains.append((k, head[::-1] + tail))
    return chains


def stitched(chains: list[list[tuple[float, float]]], metres: float) -> list[list[tuple[float, float]]]:
    """Chains joined at their ends while two are within ``metres``, the closest two first; both end points stay."""
    return [chain for _, chain in stitches_of(list(enumerate(chains)), metres)]


def stitches_of(chains: list[tuple[int, list[tuple[float, float]]]], metres: float) -> list[tuple[int, list[tuple[float, float]]]]:
    """stitched() for numbered chains; joined ones keep the number of the one that stood first.

    Ends stay where they are until they are used, so the gaps between ends that a grid brings
    together are measured once and taken in order.
    """
    if len(chains) < 2 or metres <= 0:
        return chains
    ends = np.radians(np.array([p for _, c in chains for p in (c[0], c[-1])]))
    tall = metres / 111_000
    wide = tall / max(0.01, float(np.cos(np.abs(ends[:, 1]).max())))
    cells: dict[tuple[int, int], list[int]] = {}
    for e, (lng, lat) in enumerate(np.floor(np.degrees(ends) / (wide, tall)).astype(np.int64).tolist()):
        cells.setdefault((lng, lat), []).append(e)
    pairs = []
    for (x, y), own in cells.items():
        beside = np.array([e for i in (-1, 0, 1) for j in (-1, 0, 1) for e in cells.get((x + i, y + j), ())])
        for e in own:
            other = beside[beside // 2 > e // 2]
            half = np.sin((ends[other, 1] - ends[e, 1]) / 2) ** 2 + np.cos(ends[other, 1]) * np.cos(ends[e, 1]) * np.sin((ends[other, 0] - ends[e, 0]) / 2) ** 2
            gap = 2 * EARTH_MI * 1609.344 * np.arcsin(np.sqrt(np.minimum(half, 1.0)))
            pairs += [(g, e, f) for g, f in zip(gap.tolist(), other.tolist()) if g <= metres]
    line = {k: list(c) for k, (_, c) in enumerate(chains)}
    of = list(range(len(chains)))  # the line that an end's chain is in
    tips = {k: [2 * k, 2 * k + 1] for k in line}  # its ends, first and last
    held = {k: [k] for k in line}
    for _, e, f in sorted(pairs):
        x, y = sorted((of[e // 2], of[f // 2]))
        if x == y or e not in tips[of[e // 2]] or f not in tips[of[f // 2]]:
            continue
        a, b = (e, f) if of[e // 2] == x else (f, e)
        # the meeting ends become neighbours: first chain forwards to its end, second from its end on
        if tips[x][0] == a:
            line[x].reverse()
            tips[x].reverse()
        if tips[y][1] == b:
            line[y].reverse()
            tips[y].reverse()
        line[x] += line.pop(y)
        tips[x] = [tips[x][0], tips.pop(y)[1]]
        for k in held[y]:
            of[k] = x
        held[x] += held.pop(y)
    return [(chains[k][0], c) for k, c in line.items()]


def chain_paths(segments: DataFrame, near: float = JOIN_DEG, stitch_m: float = 0.0, snap: bool = False) -> DataFrame:
    """(path_id, chain, seq, lng, lat) from segments (path_id, part, seq, lng, lat); a path's rows are read in their order, and no array holds it.

    With ``snap`` ends meet in one cell of the grid of ``near``, else within a box of that size.
    With ``stitch_m`` chains whose ends are that close are joined afterwards, closest first.
    For paths of very many parts, chain_networks.
    """
    return _chained(segments, ["path_id"], near, stitch_m, snap).select("path_id", "chain", "seq", "lng", "lat")


def chain_networks(segments: DataFrame, near: float = JOIN_DEG, stitch_m: float = 0.0, snap: bool = False, whole: int = WHOLE_PATH) -> DataFrame:
    """As chain_paths, with the same chains in the same order, for paths of any number of parts.

    Ends meet in cells as wide as they may be apart, each part standing in the cells around
    its ends; parts that share cells, directly or through others, are one network. Only a
    network's parts have to be in one task. Chains are numbered by the part they start from.
    Paths of at most ``whole`` vertices are chained as one, without looking for their networks.
    """
    large = _large(segments, whole)
    if large.isEmpty():
        return chain_paths(segments, near, stitch_m, snap)
    small = chain_paths(segments.join(large, "path_id", "left_anti"), near, stitch_m, snap)
    chains = _chained_networks(segments.join(large, "path_id", "left_semi"), near, stitch_m, snap)
    order = Window.partitionBy("path_id").orderBy("start")
    numbers = chains.filter("seq = 0").select("path_id", "start", (F.row_number().over(order) - 1).cast("long").alias("chain"))
    return small.unionByName(chains.drop("chain").join(numbers, ["path_id", "start"]).select("path_id", "chain", "seq", "lng", "lat"))


def chain_steps(segments: DataFrame, near: float = JOIN_DEG, whole: int = WHOLE_PATH) -> DataFrame:
    """(path_id, start, seq, lng, lat, step_mi): chain_networks' points, their chains told by the part they start from, with the distance from the point before.

    For what is summed up over chains: steps are taken where points are chained, so that these needn't meet in order again.
    """
    large = _large(segments, whole)
    if large.isEmpty():
        chains = _chained(segments, ["path_id"], near, 0.0, False, True)
    else:
        chains = _chained(segments.join(large, "path_id", "left_anti"), ["path_id"], near, 0.0, False, True)
        chains = chains.unionByName(_chained_networks(segments.join(large, "path_id", "left_semi"), near, 0.0, False, True), allowMissingColumns=True)
    step = F.coalesce(haversine(F.col("b_lat"), F.col("b_lng"), F.col("lat"), F.col("lng")), F.lit(0.0))
    return chains.select("path_id", "start", "seq", "lng", "lat", step.alias("step_mi"))


def _large(segments: DataFrame, whole: int) -> DataFrame:
    return segments.groupBy("path_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole).select("path_id")


def _chained_networks(segments: DataFrame, near: float, stitch_m: float, snap: bool, before: bool = False) -> DataFrame:
    at = F.struct("lng", "lat")
    ends = segments.groupBy("path_id", "part").agg(F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    reach = max(near, stitch_m / 111_000)
    band = lambda y: F.floor(y)  # noqa: E731  lng cells are as wide as a degree of latitude here asks
    wide = lambda y: F.lit(reach) / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs(band(y)) + 2)))) if stitch_m else F.lit(reach)
    ends = ends.select("path_id", "part", F.explode(F.array("a", "b")).alias("p"))
    size = 4 * reach
    # the band of a cell decides its width, so a place near two bands stands in the cells of both
    rows = F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(reach)), lambda d: F.floor((F.col("p.lat") + d) / size)))
    ends = ends.select("path_id", "part", "p", F.explode(rows).alias("_r")).withColumn("_w", wide(F.col("_r") * size))
    columns = F.array_distinct(F.transform(F.array(F.lit(-1.0), F.lit(1.0)), lambda d: F.floor((F.col("p.lng") + d * F.col("_w")) / (4 * F.col("_w")))))
    ends = ends.select("path_id", "part", "_r", F.explode(columns).alias("_c"))
    # a part and a cell are nodes; two that get the same number would only make a network larger
    number = lambda kind, *c: F.xxhash64(F.lit(kind), "path_id", *c)
    link = ends.select(number("part", "part").alias("src"), number("cell", "_r", "_c").alias("dst")).distinct()
    from talus.operators.graph import component_labels  # graph reads lines too

    label = component_labels(link).select(F.col("node").alias("_node"), F.col("label").alias("_network"))
    named = segments.withColumn("_node", number("part", "part")).join(label, "_node")
    return _chained(named, ["path_id", "_network"], near, stitch_m, snap, before)


def _chained(segments: DataFrame, keys: list[str], near: float, stitch_m: float, snap: bool, before: bool = False) -> DataFrame:
    """(keys, chain, start, seq, lng, lat): for each group of segments its chains' points, chains numbered in order, start the part each began with.

    The window brings a group's rows together, in order, and numbers them; a task folds one group after another.
    With ``before`` also (b_lng, b_lat), the point before, NULL at a chain's first.
    """
    kinds = dict(segments.dtypes)
    by = Window.partitionBy(*keys).orderBy("part", "seq", "lng", "lat")
    rows = segments.select(*keys, "part", "seq", "lng", "lat").withColumn("_n", F.row_number().over(by)).select(*keys, "part", "lng", "lat", "_n")
    names = [*keys, "chain", "start", "seq", "lng", "lat", *(["b_lng", "b_lat"] if before else [])]

    def told(groups: list[tuple], types: list[pa.DataType], part: pa.DataType) -> pa.RecordBatch:
        """A batch of (key, chain, start, line)."""
        size = [len(line) for *_, line in groups]
        of = np.repeat(np.arange(len(groups)), size)
        each = [pa.array([g[0][i] for g in groups], t) for i, t in enumerate(types)] + [pa.array([g[1] for g in groups], pa.int64()), pa.array([g[2] for g in groups], part)]
        seq = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        at = [pa.array([p[i] for *_, line in groups for p in line], pa.float64()) for i in (0, 1)]
        if before:
            last = pa.array(np.arange(len(of)) - 1, mask=seq == 0)
            at += [x.take(last) for x in at]
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(of)) for c in each), pa.array(seq, pa.int64()), *at], names=names)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, begun, out, points, kind = None, [], [], [], 0, None

        def fold() -> int:
            found = stitches_of(chains_of(parts, near, snap), stitch_m)
            out.extend((key, c, begun[k], line) for c, (k, line) in enumerate(found))
            return sum(len(line) for _, line in found)

        for batch in batches:
            kind = kind or ([batch.schema.field(i).type for i in range(len(keys))], batch.schema.field(len(keys)).type)
            columns = [_values(c) for c in batch.columns]
            for k, part, x, y, n in zip(zip(*columns[: len(keys)]), *columns[len(keys) :]):
                if n == 1:
                    points += fold()
                    if points > 10_000:
                        yield told(out, *kind)
                        out, points = [], 0
                    key, parts, begun = k, [], []
                if n == 1 or part != begun[-1]:
                    parts.append([])
                    begun.append(part)
                parts[-1].append((x, y))
        fold()
        if out:
            yield told(out, *kind)

    keyed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.mapInArrow(chain, f"{keyed}, chain long, start {kinds['part']}, seq long, lng double, lat double" + (", b_lng double, b_lat double" if before else ""))


def route_type(vertices: DataFrame, path: str = "path_id", seq: str = "seq", run: str | None = None, closed_m: float = 50.0) -> DataFrame:
    """(path, route_type) by how much ground is walked twice, vertices told apart on a grid of 1e-4 degrees.

    Several values of ``run`` make a network. Else out-and-back where 0.85 of the length is
    walked more than once; where the ends are closer than ``closed_m`` a lollipop from 0.15 on
    and below it a loop; out-and-back from 0.35 on; else point-to-point. A step within one
    place of the grid is length, but never doubled ground.
    """
    by = Window.partitionBy(path).orderBy(seq)
    grid = lambda c: F.bround(F.col(c) / JOIN_DEG).cast("long")
    walk = vertices.select(path, seq, "lat", "lng", (F.col(run) if run else F.lit(0)).alias("_run"), (grid("lng") * (1 << 32) + grid("lat")).alias("node"))
    lag, first = lambda c: F.lag(c).over(by), lambda c: F.first(c).over(by)
    step = F.coalesce(haversine(lag("lat"), lag("lng"), F.col("lat"), F.col("lng")), F.lit(0.0))
    apart = F.when(F.lead(seq).over(by).isNull(), haversine(first("lat"), first("lng"), F.col("lat"), F.col("lng"), EARTH_MI_FINE))  # at the last vertex
    # what the second window sorts is kept to a few numbers a row
    walk = walk.select(path, seq, "_run", "node", lag("node").alias("before"), step.alias("step_mi"), apart.alias("apart"))
    moved = F.col("before") != F.col("node")
    walk = walk.select(path, seq, "_run", "step_mi", "apart", F.when(moved, F.least("node", "before")).alias("_g"), F.when(moved, F.greatest("node", "before")).alias("_h"))
    nth = F.row_number().over(Window.partitionBy(path, "_g", "_h").orderBy(seq))
    walk = walk.withColumn("again", F.when(F.col("_g").isNull() | (nth == 1), 0.0).when(nth == 2, 2 * F.col("step_mi")).otherwise(F.col("step_mi")))
    ends = walk.groupBy(path).agg(F.sum("step_mi").alias("miles"), F.sum("again").alias("again"), F.max("apart").alias("apart"), F.count(F.lit(1)).alias("n"), (F.min("_run") != F.max("_run")).alias("several"))
    share = F.when(F.col("miles") > 0, F.col("again") / F.col("miles")).otherwise(0.0)
    closed = F.col("apart") * 1609.344 < closed_m
    kind = (
        F.when(F.col("several"), "network").when(F.col("n") < 2, "unknown").when(share >= 0.85, "out-and-back")
        .when(closed, F.when(share >= 0.15, "lollipop").otherwise("loop")).when(share >= 0.35, "out-and-back").otherwise("point-to-point")
    )
    return ends.select(path, kind.alias("route_type"))
