"""Writers: index and geometry tables, GeoJSON, CSV, GPX and KML; all distributed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Simplification tolerance in degrees by level of detail
DETAIL = {"z14": 5e-5, "z12": 1.5e-4, "z10": 5e-4}


def detail_for_zoom(zoom: Column) -> Column:
    return F.when(zoom < 11, "z10").when(zoom < 13, "z12").when(zoom < 15, "z14").otherwise("full")


def write_index(trails: DataFrame, geometry: list[str], path: str) -> None:
    """The record and its geometry as two tables by id, so that searches never read shapes."""
    trails.drop(*geometry).write.mode("overwrite").parquet(f"{path}/trails")
    trails.select("id", *geometry).write.mode("overwrite").parquet(f"{path}/geometry")


def details(vertices: DataFrame) -> DataFrame:
    """(path_id, part, seq, lng, lat, detail): vertices (path_id, part if lines have several, seq, lng, lat) at each level of detail."""
    from talus.operators.lines import simplify_parts

    parts = vertices if "part" in vertices.columns else vertices.withColumn("part", F.lit(0))
    full = parts.select("path_id", "part", "seq", "lng", "lat").withColumn("detail", F.lit("full"))
    for name, epsilon in DETAIL.items():
        full = full.unionByName(simplify_parts(parts, epsilon).withColumn("detail", F.lit(name)))
    return full


def write_details(vertices: DataFrame, path: str) -> None:
    """details() as files, a partition a level, each file a range of ids, so that a lookup reads row groups of one. See store_details for a table."""
    details(vertices).repartitionByRange("detail", "path_id").sortWithinPartitions("detail", "path_id", "part", "seq").write.mode("overwrite").partitionBy("detail").parquet(path)


def read_detail(spark, path: str, path_id, detail: str | None = None) -> DataFrame:
    """One path at a level of detail; an unknown level reads the full line. Both are pushed into the scan."""
    level = detail if detail in DETAIL else "full"
    return spark.read.parquet(path).filter((F.col("detail") == level) & (F.col("path_id") == path_id)).orderBy("part", "seq")


def store_details(vertices: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Lines at each level of detail as a table for lookups: a partition a level, a bucket of ids in it one file.

    A lookup (stored_detail) knows the partition and the bucket from its arguments, so it
    opens one file however many there are, and Parquet's bloom filter on the id tells a file without the id apart.
    """
    details(vertices).repartition(buckets, "path_id").write.mode("overwrite").partitionBy("detail").bucketBy(buckets, "path_id").sortBy("path_id", "part", "seq").option("path", path).option("parquet.bloom.filter.enabled#path_id", "true").format("parquet").saveAsTable(table)


def stored_detail(spark: SparkSession, table: str, path_id, detail: str | None = None) -> DataFrame:
    """The vertices (path_id, part, seq, lng, lat) of one line at a level of detail; an unknown level reads the full line."""
    level = detail if detail in DETAIL else "full"
    return spark.table(table).filter((F.col("detail") == level) & (F.col("path_id") == path_id))


def store_index(trails: DataFrame, geometry: list[str], table: str, path: str, buckets: int = 64) -> None:
    """write_index as two tables, {table}_trails and {table}_geometry, in the same buckets of ids, each bucket one sorted file."""
    for name, rows in (("trails", trails.drop(*geometry)), ("geometry", trails.select("id", *geometry))):
        rows.repartition(buckets, "id").write.mode("overwrite").bucketBy(buckets, "id").sortBy("id").option("path", f"{path}/{name}").option("parquet.bloom.filter.enabled#id", "true").format("parquet").saveAsTable(f"{table}_{name}")


def stored_trails(spark: SparkSession, table: str) -> DataFrame:
    """Records with their geometry: buckets meet as they lie, so nothing is shuffled; with a filter on id one file of each is read."""
    return spark.table(f"{table}_trails").join(spark.table(f"{table}_geometry"), "id")


def geojson_feature(props: list[str], parts: Column) -> Column:
    """Text of a feature; one part is a LineString, more are a MultiLineString, none is a null geometry."""
    pairs = F.transform(parts, lambda part: F.transform(part, lambda p: F.array(p["lng"], p["lat"])))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), pairs[0].alias("coordinates")))
    lines = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), pairs.alias("coordinates")))
    shape = F.when(F.size(parts) == 1, line).when(F.size(parts) > 1, lines).otherwise("null")
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*props), {"ignoreNullFields": "false"}), F.lit(',"geometry":'), shape, F.lit("}"))


def write_geojson_lines(trails: DataFrame, props: list[str], path: str) -> None:
    """A feature a line, the form that many writers can share."""
    trails.select(geojson_feature(props, F.col("parts")).alias("value")).write.mode("overwrite").text(path)


def collection_lines(trails: DataFrame, props: list[str], region: str, made_at: str, incomplete: list[str] = ()) -> DataFrame:
    """(value) lines that in order are one FeatureCollection with its metadata: a head, a feature a line by id, and an end."""
    size = trails.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    told = F.to_json(F.struct(F.lit(region).alias("region"), F.lit(made_at).alias("generated_at"), F.col("n").alias("count"), F.array(*[F.lit(t) for t in incomplete]).cast("array<string>").alias("incomplete_tiles")))
    head = size.select(F.lit(0).alias("part"), F.lit(None).cast(dict(trails.dtypes)["id"]).alias("id"), F.concat(F.lit('{"type":"FeatureCollection","metadata":'), told, F.lit(',"features":[')).alias("value"))
    first = F.broadcast(size.select("first"))  # one row
    rows = trails.join(first).select(F.lit(1).alias("part"), "id", F.concat(F.when(F.col("id") == F.col("first"), "").otherwise(","), geojson_feature(props, F.col("parts"))).alias("value"))
    end = size.select(F.lit(2).alias("part"), F.lit(None).cast(dict(trails.dtypes)["id"]).alias("id"), F.lit("]}").alias("value"))
    return head.unionByName(rows).unionByName(end).orderBy("part", "id").select("value")


def write_collection(trails: DataFrame, props: list[str], path: str, region: str, made_at: str, incomplete: list[str] = ()) -> None:
    """One FeatureCollection whose text is the part files in order, however many tasks write them."""
    collection_lines(trails, props, region, made_at, incomplete).write.mode("overwrite").text(path)


def map_layers(points: Column, perimeters: Column) -> Column:
    """struct(route, fire_perimeters): a route's line as text of a GeoJSON feature, beside the perimeters as they are."""
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lng"], p["lat"])).alias("coordinates")))
    return F.struct(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), line, F.lit("}")).alias("route"), perimeters.alias("fire_perimeters"))


def write_csv(trails: DataFrame, columns: list[str], path: str) -> None:
    """Fixed columns in order; missing ones are empty, others are left out."""
    cols = [F.col(c) if c in trails.columns else F.lit(None).cast("string").alias(c) for c in columns]
    trails.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def _escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def gpx(name: Column, points: Column) -> Column:
    """A GPX track of array<struct<lng, lat, ele>>."""
    one = lambda p: F.concat(F.format_string('<trkpt lat="%s" lon="%s">', p["lat"], p["lng"]), F.when(p["ele"].isNotNull(), F.format_string("<ele>%s</ele>", p["ele"])).otherwise(""), F.lit("</trkpt>"))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="talus" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'), _escaped(name), F.lit("</name><trkseg>"), F.array_join(F.transform(points, one), ""), F.lit("</trkseg></trk></gpx>"))


def kml(name: Column, points: Column) -> Column:
    """A KML line of array<struct<lng, lat>>."""
    path = F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["lng"].cast("string"), p["lat"].cast("string"))), " ")
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>'), _escaped(name), F.lit("</name><LineString><coordinates>"), path, F.lit("</coordinates></LineString></Placemark></Document></kml>"))
