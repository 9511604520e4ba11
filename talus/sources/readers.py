"""Readers of landed files. Live services are read elsewhere and land as files first.

Each reader is lazy and parses in the scan: a file's rows are made where it is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.text import opl_decoded


def _points(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat")))


def line_parts(geometry: Column) -> Column:
    """array<array<point>> of a GeoJSON line given as text; NULL for other types and lines without points."""
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    one = F.array(F.from_json(coordinates, "array<array<double>>"))
    many = F.from_json(coordinates, "array<array<array<double>>>")
    parts = F.when(kind == "LineString", one).when(kind == "MultiLineString", many)
    parts = F.filter(F.transform(parts, _points), lambda p: F.size(p) >= 2)
    return F.when(F.size(parts) > 0, parts)


def polygon_rings(geometry: Column) -> Column:
    """array<polygon<ring<point>>> of a GeoJSON Polygon or MultiPolygon given as text."""
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.transform(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many), lambda polygon: F.transform(polygon, _points))


def feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """(props, geometry, file, pos) of the features of GeoJSON files; property names in lower case, geometry as text, pos the place in the file."""
    raw = spark.read.schema("features array<struct<properties: map<string, string>, geometry: string>>").option("multiLine", True).json(path)
    f = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("pos", "f"))
    return f.select(F.transform_keys("f.properties", lambda k, v: F.lower(k)).alias("props"), F.col("f.geometry").alias("geometry"), "file", F.col("pos").cast("long").alias("pos"))


def forest_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their trail: trail_cn, else objectid; rows with neither are dropped. ord: files by name, features as they stand there."""
    f = feature_collection(spark, path)
    blank = lambda k: F.when(F.trim(F.try_element_at("props", F.lit(k))) != "", F.trim(F.try_element_at("props", F.lit(k))))
    f = f.withColumn("trail_id", F.coalesce(blank("trail_cn"), blank("objectid"))).filter("trail_id is not null")
    files = f.select("file").distinct().withColumn("_n", F.row_number().over(Window.orderBy("file")).cast("long"))  # a row a file
    f = f.join(files, "file").withColumn("ord", F.shiftleft("_n", 33) + F.col("pos"))
    return f.select("trail_id", "ord", "props", line_parts(F.col("geometry")).alias("parts"))


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, name, tags, points) of a GeoJSON sequence, a feature a line; lines that don't parse are skipped."""
    text = spark.read.text(path).select(F.ltrim(F.col("value"), F.lit("\x1e")).alias("value"))
    f = text.select(F.from_json("value", "id string, properties map<string, string>, geometry string").alias("f")).filter("f.geometry is not null")
    return f.select(
        F.coalesce("f.id", F.try_element_at("f.properties", F.lit("@id"))).alias("osm_id"),
        F.try_element_at("f.properties", F.lit("name")).alias("name"),
        F.col("f.properties").alias("tags"),
        F.get(line_parts(F.col("f.geometry")), F.lit(0)).alias("points"),
    ).filter("points is not null")


def way_samples(ways: DataFrame, n: int = 8) -> DataFrame:
    """About n vertices of each way."""
    step = F.greatest(F.lit(1), F.floor(F.size("points") / n).cast("int"))
    v = ways.select("osm_id", "tags", step.alias("step"), F.posexplode("points").alias("pos", "p"))
    return v.filter(F.col("pos") % F.col("step") == 0).select(F.concat("osm_id", F.lit("#"), F.col("pos").cast("string")).alias("id"), "tags", "p.lat", "p.lng")


# Member roles that are not part of the route itself
EXCLUDED_ROLES = ["excursion", "approach", "connection", "alternative", "link"]


def opl_relations(spark: SparkSession, path: str, excluded: list[str] = EXCLUDED_ROLES) -> DataFrame:
    """(id, tags, members) of relations in OPL text; members are way ids in order, without excluded roles."""
    rows = spark.read.text(path).filter(F.startswith("value", F.lit("r")))
    part = lambda letter: F.regexp_extract("value", rf"(?:^| ){letter}(\S*)", 1)
    rows = rows.select(F.regexp_extract("value", r"^r(\d+)", 1).alias("id"), part("T").alias("t"), part("M").alias("m"))
    pairs = F.filter(F.split("t", ","), lambda kv: F.contains(kv, F.lit("=")))
    tags = F.explode_outer(F.transform(pairs, lambda kv: F.struct(F.split_part(kv, F.lit("="), F.lit(1)).alias("k"), F.split_part(kv, F.lit("="), F.lit(2)).alias("v"))))
    ways = F.filter(F.split("m", ","), lambda x: F.startswith(x, F.lit("w")) & ~F.lower(F.split_part(x, F.lit("@"), F.lit(2))).isin(excluded))
    rows = rows.select("id", F.transform(ways, lambda x: F.regexp_extract(x, r"^(w\d+)", 1)).alias("members"), tags.alias("kv"))
    rows = rows.select("id", "members", opl_decoded(F.col("kv.k")).alias("k"), opl_decoded(F.col("kv.v")).alias("v"))
    return rows.groupBy("id", "members").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("k", "v")), lambda e: e["k"].isNotNull())).alias("tags")).select("id", "tags", "members")


def assemble_relations(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, parts): way geometries in member order; missing ways are left out."""
    m = relations.select("id", F.posexplode("members").alias("pos", "osm_id"))
    joined = m.join(ways.select("osm_id", "points"), "osm_id")
    return joined.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "points"))), lambda x: x["points"]).alias("parts"))


def gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, lat, lng, ele): a file's track points, else its route points, else two or more waypoints."""
    found = None
    for order, tag in enumerate(("trkpt", "rtept", "wpt")):
        rows = spark.read.format("xml").option("rowTag", tag).schema("_lat double, _lon double, ele double").load(path)
        rows = rows.select(F.col("_metadata.file_path").alias("file"), F.lit(order).alias("kind"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), F.col("_lat").alias("lat"), F.col("_lon").alias("lng"), "ele")
        found = rows if found is None else found.unionByName(rows)
    found = found.filter("lat is not null and lng is not null")
    use = found.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n")).filter("kind < 2 or n > 1").groupBy("file").agg(F.min("kind").alias("kind"))
    by = Window.partitionBy("file").orderBy("at")
    return found.join(use, ["file", "kind"]).select("file", (F.row_number().over(by) - 1).cast("long").alias("seq"), "lat", "lng", "ele")


def terrain_metres(tiles: DataFrame, points: DataFrame, zoom: int = 13) -> DataFrame:
    """(point_id, ele_m) from raster tiles (x, y, rgb array<int>, size) and points (point_id, lat, lng).

    A tile's pixels are array elements (red << 16 | green << 8 | blue), so a point is an
    index into its tile; points and tiles meet by tile key and each tile is held once a task.
    """
    from talus.functions.geo import mercator_tile

    x, y = mercator_tile(F.col("lat"), F.col("lng"), zoom)
    p = points.select("point_id", x.alias("fx"), y.alias("fy")).withColumn("x", F.floor("fx").cast("long")).withColumn("y", F.floor("fy").cast("long"))
    p = p.join(tiles, ["x", "y"])
    pixel = lambda f, i: F.least(F.floor((F.col(f) - F.col(i)) * F.col("size")), F.col("size") - 1).cast("int")
    value = F.get("rgb", pixel("fy", "y") * F.col("size").cast("int") + pixel("fx", "x"))
    red, green, blue = (F.shiftright(value, s).bitwiseAND(255) for s in (16, 8, 0))
    return p.select("point_id", (red * 256 + green + blue / 256 - 32768).alias("ele_m"))


def fresh(derived_at: int | None, source_at: int, version: int, wanted: int) -> bool:
    """Whether a derived table can be read instead of built: right version, and not older than its source."""
    return derived_at is not None and version == wanted and derived_at >= source_at




def index(spark: SparkSession, path: str) -> DataFrame:
    """A written index with its derived columns, as searches take it; lines stay in their own table."""
    from talus.operators.search import rated

    return rated(spark.read.parquet(f"{path}/trails"))


def saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of an earlier sweep; no rows where none has been saved."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _filtered(kind: int, line: np.ndarray, above: np.ndarray, width: int) -> np.ndarray:
    """One row of a PNG with its filter undone."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, width), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(line) + width, np.int64)
    up = np.concatenate((np.zeros(width, np.int64), above.astype(np.int64)))
    for i in range(width, len(out)):
        a, b, c = out[i - width], up[i], up[i - width]
        if kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (int(line[i - width]) + guess) & 255
    return out[width:].astype(np.uint8)


def png_pixels(data: bytes) -> tuple[int, np.ndarray]:
    """(width, red << 16 | green << 8 | blue of each pixel) of an 8-bit RGB or RGBA image without interlacing."""
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    if data[:8] != b"\x89PNG\r\n\x1a\n" or depth != 8 or colour not in (2, 6) or interlace:
        raise ValueError("not an 8-bit RGB(A) PNG without interlacing")
    at, packed, size = 8, [], 3 if colour == 2 else 4
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + size * width)
    above, out = np.zeros(size * width, np.uint8), []
    for row in rows:
        above = _filtered(int(row[0]), row[1:], above, size)
        out.append(above)
    p = np.stack(out).reshape(-1, size).astype(np.int32)
    return width, p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]


def terrain_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, size, rgb) of raster tiles saved as zoom/x/y.png; a tile is decoded by the task that reads it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    part = lambda i: F.regexp_extract("path", r"(\d+)/(\d+)\.png$", i).cast("long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png_pixels(c.as_py()) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w for w, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.int32()))], names=["x", "y", "size", "rgb"])

    return files.select(part(1).alias("x"), part(2).alias("y"), "content").mapInArrow(decode, "x long, y long, size long, rgb array<int>")
