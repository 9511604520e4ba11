"""Trail-shaped views of the supplied tables, as SQL that Spark and DuckDB read alike.

The tables have no coordinates, so places come from integer arithmetic on the keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]


def _place(key: str, a: int, b: int) -> str:
    return f"cast(37 as double) + cast({key} * {a} % 400 as double) / 1000 AS lat, cast(-120 as double) + cast({key} * {b} % 400 as double) / 1000 AS lng"


def _kind(key: str, kinds: list[str]) -> str:
    return f"CASE {key} % {len(kinds)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END AS kind"


_OUT = [0, 1, 2, 3, 4, 5, 6, 7]
#: Which vertices of a path are walked, by path_id % 8; the sixth way is in two pieces.
WALKS = [_OUT + _OUT[-2::-1], _OUT, [*_OUT, 6, 5, 4, 3], [*_OUT, 0], [*_OUT, 2, 1, 0], _OUT, [*_OUT, *_OUT[-2::-1], *_OUT[1:]], [*_OUT, 6]]

VIEWS = {
    "pois": f"SELECT s_suppkey AS id, s_name AS poi_name, {_place('s_suppkey', 7919, 104729)}, {_kind('s_nationkey', ['peak', 'lake', 'waterfall', 'viewpoint', 'spring', 'pass'])} FROM supplier",
    "access_points": f"SELECT c_custkey AS id, c_name AS point_name, {_place('c_custkey', 7919, 104729)}, {_kind('c_nationkey', ['trailhead', 'parking', 'water', 'campground'])} FROM customer",
    "vertices": """
        SELECT path_id, seq, ix, iy, ix * 1000 + iy AS node, cast(37 as double) + iy * cast(0.01 as double) AS lat, cast(-120 as double) + ix * cast(0.01 as double) AS lng
        FROM (SELECT o_orderkey AS path_id, k AS seq, o_orderkey % 40 + k - cast(floor(cast(k as double) / 2) as bigint) AS ix,
                     cast(floor(cast(o_orderkey as double) / 40) as bigint) % 40 + cast(floor(cast(k as double) / 2) as bigint) AS iy
              FROM orders CROSS JOIN (SELECT cast(0 as bigint) AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) AS ks) AS v""",
    "trails": f"""
        SELECT o_orderkey AS id, o_orderkey AS ord, name, n_name AS area, length_miles,
               CASE WHEN o_orderkey % 7 <> 0 THEN parts % 6000 END AS gain_ft,
               CASE WHEN o_orderkey % 5 <> 0 THEN parts % 14000 END AS max_elevation_ft,
               CASE o_orderkey % 3 WHEN 0 THEN 'loop' WHEN 1 THEN 'out-and-back' END AS route_type,
               CASE WHEN o_orderkey % 6 = 0 THEN n_name END AS wilderness,
               CASE WHEN o_orderkey % 13 <> 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'atv' WHEN '2-HIGH' THEN 'bike' WHEN '3-MEDIUM' THEN 'horse' ELSE 'hiking' END END AS use_name,
               CASE WHEN o_orderkey % 4 <> 0 THEN first_month END AS season_from, CASE WHEN o_orderkey % 4 <> 0 THEN last_month END AS season_to,
               {_place('o_orderkey', 31, 17)}
        FROM (SELECT o_orderkey, o_custkey, o_orderpriority, min(p_name) AS name, round(sum(l_quantity) / 10, 2) AS length_miles, cast(sum(l_partkey) as bigint) AS parts,
                     cast(min(month(l_shipdate)) as int) AS first_month, cast(max(month(l_shipdate)) as int) AS last_month
              FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
              GROUP BY o_orderkey, o_custkey, o_orderpriority) AS t
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "trail_features": "SELECT DISTINCT l_orderkey AS id, p_type AS feature FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 11 <> 0",
    "areas": """
        SELECT cast(n_nationkey as bigint) AS ord, n_name AS name, cast(-120 as double) + (n_nationkey % 5) * cast(0.08 as double) AS min_lng, cast(37 as double) + cast(floor(cast(n_nationkey as double) / 5) as bigint) * cast(0.08 as double) AS min_lat,
               cast(-120 as double) + (n_nationkey % 5) * cast(0.08 as double) + cast(0.07 as double) AS max_lng, cast(37 as double) + cast(floor(cast(n_nationkey as double) / 5) as bigint) * cast(0.08 as double) + cast(0.07 as double) AS max_lat
        FROM nation""",
    # a notched outer ring and a hole of each area, closed, as corners by fractions of its box
    "area_corners": "SELECT ord, name, ring, k, min_lng + (max_lng - min_lng) * fx AS lng, min_lat + (max_lat - min_lat) * fy AS lat FROM areas CROSS JOIN ("
    + " UNION ALL ".join(
        f"SELECT {ring} AS ring, {k} AS k, cast({x} as double) AS fx, cast({y} as double) AS fy"
        for ring, corners in enumerate([[(0, 0), (1, 0), (0.53, 0.46), (1, 1), (0, 1), (0, 0)], [(0.1, 0.2), (0.3, 0.5), (0.1, 0.8), (0.1, 0.2)]])
        for k, (x, y) in enumerate(corners)
    )
    + ") AS f",
    # paths walked in eight ways: out, back, round, in pieces
    "walks": "SELECT path_id, run, step, lat, lng FROM vertices JOIN ("
    + " UNION ALL ".join(f"SELECT {way} AS way, cast({step} as bigint) AS step, {at} AS stop, {int(way == 5 and step > 3)} AS run" for way, places in enumerate(WALKS) for step, at in enumerate(places))
    + ") AS s ON path_id % 8 = way AND seq = stop",
    "trail_segments": """
        SELECT l_orderkey AS trail_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey * 10 + l_suppkey % 10 AS ord,
               CASE WHEN l_partkey % 10 <> 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END END AS name, CASE p_size % 4 WHEN 0 THEN 'Native' WHEN 1 THEN 'Gravel' WHEN 2 THEN 'Paved' END AS surface, p_brand AS area,
               CASE WHEN l_partkey % 5 <> 0 THEN p_type END AS trail_type, l_linestatus AS org, CASE WHEN l_partkey % 7 = 0 THEN 'T7' WHEN l_partkey % 7 = 1 THEN 'T1' END AS trail_no, cast(NULL as string) AS accessibility,
               CASE WHEN l_suppkey % 4 <> 0 THEN l_linenumber END AS trail_class, CASE WHEN p_size % 3 <> 0 THEN p_size END AS max_pct, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS miles, l_quantity / 4 AS measured,
               cast(-120 as double) + cast(l_partkey % 100 as double) / 100 AS min_lng, cast(37 as double) + cast(l_suppkey % 100 as double) / 100 AS min_lat, cast(-119 as double) + cast(l_partkey % 100 as double) / 100 AS max_lng, cast(38 as double) + cast(l_suppkey % 100 as double) / 100 AS max_lat,
               CASE WHEN l_partkey % 4 = 1 THEN p_brand END AS hiking, CASE WHEN l_partkey % 9 = 2 THEN p_type END AS bike
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "segments": "SELECT l_orderkey AS trail_id, cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey AS ord, CASE WHEN l_partkey % 10 <> 0 THEN p_name END AS name, CASE l_returnflag WHEN 'A' THEN 'Native' WHEN 'N' THEN 'Gravel' END AS surface, CASE WHEN l_suppkey % 4 <> 0 THEN l_linenumber END AS trail_class, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS miles FROM lineitem JOIN part ON p_partkey = l_partkey",
}


# The height of a node in feet, unknown for one in three
HEIGHT = "CASE WHEN node % 3 <> 0 THEN cast(node * 7919 % 4001 as double) / 2 END"


def _used(sql: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables; columns that aren't used are never read."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = _used(VIEWS[name], [*TABLES, *VIEWS])
    sql = VIEWS[name]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """SQL that begins with the views it names, for an engine that has only the tables."""
    used = _used(sql, list(VIEWS))
    if not used:
        return sql
    used = [v for v in VIEWS if v in used or any(v in _used(VIEWS[u], list(VIEWS)) for u in used)]  # in their order, views of views first
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    rest = re.sub(r"(?is)^WITH\s+(RECURSIVE\s+)?", ", ", body, count=1) if body.upper().startswith("WITH") else " " + body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{v} AS ({VIEWS[v]})" for v in used) + rest
