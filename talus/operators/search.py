"""Faceted search over trails: predicates, self-excluding facets, stable sorts, map extracts.

Columns of a trail: id, ord, name, area, length_miles, gain_ft, max_elevation_ft,
route_type, season_months (NULL: no restriction known), features (NULL: not computed,
empty: none), uses map<string, boolean>, wilderness, accessible, and the box min_lng,
min_lat, max_lng, max_lat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.nulls import unknown_or, within
from talus.functions.ratings import DIFFICULTY, STEEPNESS, activities, allowed, band, climb_rate, effort
from talus.functions.text import name_signal, signal_bound
from talus.operators.lineage import cut


@dataclass
class Filters:
    box: tuple[float, float, float, float] | None = None  # min_lng, min_lat, max_lng, max_lat
    text: str = ""
    length: tuple = (None, None)
    gain: tuple = (None, None)
    elevation: tuple = (None, None)
    difficulty: list[str] = field(default_factory=list)
    steepness: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    all_features: bool = False
    route_type: str | None = None
    month: int | None = None
    activity: str | None = None
    wilderness_only: bool = False
    wilderness: str | None = None
    accessible: bool = False


def rated(trails: DataFrame) -> DataFrame:
    """Adds effort, difficulty, climb_rate and steepness."""
    miles, gain = F.col("length_miles"), F.col("gain_ft")
    out = trails.withColumn("effort", effort(miles, gain)).withColumn("climb_rate", climb_rate(miles, gain))
    return out.withColumn("difficulty", band(F.col("effort"), DIFFICULTY)).withColumn("steepness", band(F.col("climb_rate"), STEEPNESS))


def predicates(f: Filters) -> dict[str, Column]:
    """A boolean Column for each facet dimension; all but season read unknown as no match."""
    col = F.col
    want = F.array(*[F.lit(x) for x in f.features])
    hit = F.size(F.array_except(want, "features")) == 0 if f.all_features else F.arrays_overlap("features", want)
    use = activities(col("uses"), col("wilderness"), col("length_miles"))
    tests = {
        "numbers": within(col("length_miles"), *f.length) & within(col("gain_ft"), *f.gain) & within(col("max_elevation_ft"), *f.elevation),
        "difficulty": col("difficulty").isin(f.difficulty) if f.difficulty else None,
        "steepness": col("steepness").isin(f.steepness) if f.steepness else None,
        "features": hit if f.features else None,
        "route_type": col("route_type") == f.route_type if f.route_type else None,
        "month": unknown_or(col("season_months"), F.array_contains("season_months", f.month)) if f.month else None,
        "activity": (use[f.activity] if f.activity in use else allowed(col("uses"), f.activity)) if f.activity else None,
        "wilderness_only": col("wilderness").isNotNull() if f.wilderness_only else None,
        "wilderness": col("wilderness") == f.wilderness if f.wilderness else None,
        "accessible": col("accessible").isNotNull() if f.accessible else None,
    }
    return {k: F.coalesce(t, F.lit(False)) if t is not None else F.lit(True) for k, t in tests.items()}


def _score(query: str, name_part: Column, area_part: Column) -> Column:
    name = F.lower("name")
    score = name_part + F.coalesce(0.25 * area_part, F.lit(0.0))
    score += F.when(name == query, 120.0).when(F.startswith(name, F.lit(query)), 60.0).when(F.contains(name, F.lit(query)), 35.0).otherwise(0.0)
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query).split()]
    if words:
        score += F.when(reduce(lambda a, b: a & b, [F.contains(name, F.lit(w)) for w in words]), 25.0).otherwise(0.0)
    return score


def _held(query: str, short: int) -> Column:
    """A name there is, which a short query has to be part of, or of the area."""
    name, area = F.lower("name"), F.lower("area")
    ok = name.isNotNull() & (name != "")
    return ok & (F.contains(name, F.lit(query)) | F.coalesce(F.contains(area, F.lit(query)), F.lit(False))) if len(query) < short else ok


def text_candidates(trails: DataFrame, text: str, floor: float = 85.0, short: int = 6) -> DataFrame:
    """The trails whose names can reach the floor at all, by letters and pairs of letters (see signal_bound), found without Python."""
    query = text.strip().lower()
    most = _score(query, signal_bound(query, F.lower("name")), signal_bound(query, F.lower("area"), partial_only=True))
    return trails.filter(_held(query, short) & (most >= floor - 1e-6))


def text_score(text: str, floor: float = 85.0, short: int = 6) -> Column:
    """Relevance of a name and area to a query, -1 where they don't match at all."""
    query = text.strip().lower()
    score = _score(query, name_signal(query, F.lower("name")), name_signal(query, F.lower("area"), partial_only=True))
    return F.when(_held(query, short) & (score >= floor), score).otherwise(-1.0)


def suggested(trails: DataFrame, text: str, k: int = 8, least: float = 45.0, bonus: float = 20.0, most: float = 135.0) -> DataFrame:
    """The k best names for what has been typed: name signal, a third of the area's, more where the name holds it; ties by id.

    Exact ratios are taken of names only that can reach ``least``.
    """
    query, name, area = text.strip().lower(), F.lower("name"), F.lower("area")
    total = lambda n, a: F.when(F.contains(name, F.lit(query)), F.least(F.lit(most), n + F.coalesce(0.35 * a, F.lit(0.0)) + bonus)).otherwise(n + F.coalesce(0.35 * a, F.lit(0.0)))
    can = trails.filter(total(signal_bound(query, name), signal_bound(query, area, partial_only=True)) >= least - 1e-6)
    found = can.withColumn("score", F.round(total(name_signal(query, name), name_signal(query, area, partial_only=True)), 6))
    return found.filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def scoped(trails: DataFrame, f: Filters) -> DataFrame:
    """Rated trails in the box that match the text, with score; facets never undo these two."""
    if f.box:
        a, b, c, d = f.box
        trails = trails.filter((F.col("min_lng") <= c) & (F.col("max_lng") >= a) & (F.col("min_lat") <= d) & (F.col("max_lat") >= b))
    out = rated(trails)
    if not f.text.strip():
        return out.withColumn("score", F.lit(0.0))
    return text_candidates(out, f.text).withColumn("score", text_score(f.text)).filter("score >= 0")


def _keys(first: Column | None = None, second: Column | None = None, name: Column | None = None) -> list[Column]:
    """Sort keys, all ascending: two numbers and a text."""
    return [(F.lit(0) if c is None else c).cast("double") for c in (first, second)] + [F.lit("") if name is None else name]


SORTS: dict[str, Callable[[], list[Column]]] = {
    "relevance": lambda: _keys(-F.col("score"), -F.coalesce("length_miles", F.lit(0.0))),
    "length": lambda: _keys(-F.coalesce("length_miles", F.lit(0.0))),
    "length_asc": lambda: _keys(F.coalesce("length_miles", F.lit(0.0))),
    "gain": lambda: _keys(-F.coalesce("gain_ft", F.lit(-1))),
    "difficulty": lambda: _keys(-F.coalesce(F.round("effort", 1), F.lit(-1.0))),
    "steepness": lambda: _keys(-F.coalesce(F.round("climb_rate"), F.lit(-1.0))),
    "name": lambda: _keys(name=F.coalesce("name", F.lit(""))),
}


def tops(trails: DataFrame, k: int) -> DataFrame:
    """(sort, id, rank): the first k of every sort order, which each keep k rows a task instead of sorting all.

    Keys are narrow and stored once, so the orders don't each find the trails anew.
    """
    keys = {name: keys() for name, keys in SORTS.items()}
    held = cut(trails.select("id", "ord", *[c.alias(f"_{name}{i}") for name, cs in keys.items() for i, c in enumerate(cs)]))
    by = Window.partitionBy("sort").orderBy("_place")
    first = None
    for name in keys:
        order = [f"_{name}{i}" for i in range(3)]
        own = held.select("id", "ord", *order).orderBy(*order, "ord").limit(k)
        own = own.select("id", F.lit(name).alias("sort"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*order, "ord"])]).alias("_place"))
        first = own if first is None else first.unionByName(own)
    return first.withColumn("rank", F.row_number().over(by).cast("long")).select("sort", "id", "rank")


def search(trails: DataFrame, f: Filters, sort: str = "relevance", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of matches; ties keep the index order. Sort and limit plan as a top-k, not a full sort."""
    found = scoped(trails, f).filter(reduce(lambda a, b: a & b, predicates(f).values()))
    return found.orderBy(*SORTS[sort](), F.asc("ord")).offset(offset).limit(max(1, min(limit, 200)))


DIMENSIONS = {"difficulty": ["difficulty"], "steepness": ["steepness"], "features": ["features"], "route_type": ["route_type"], "wilderness": ["wilderness"], "activity": ["activity"]}


def facets(trails: DataFrame, f: Filters) -> DataFrame:
    """(dimension, value, n): each dimension counted over rows that pass every other one.

    One scan: the predicates become columns, each row is exploded to the values of the
    dimensions for which it counts, and one aggregation, partial before the shuffle,
    counts all dimensions.
    """
    tests = predicates(f)
    rows = scoped(trails, f)
    others = {d: reduce(lambda a, b: a & b, [t for k, t in tests.items() if k not in drop]) for d, drop in DIMENSIONS.items()}
    use = activities(F.col("uses"), F.col("wilderness"), F.col("length_miles"))
    values = {
        "difficulty": F.array(F.coalesce("difficulty", F.lit("unknown"))),
        "steepness": F.array(F.coalesce("steepness", F.lit("unknown"))),
        "features": F.coalesce("features", F.array().cast("array<string>")),
        "route_type": F.filter(F.array("route_type"), lambda x: x.isNotNull()),
        "wilderness": F.filter(F.array("wilderness"), lambda x: x.isNotNull()),
        "activity": F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in use.items()]), lambda x: x.isNotNull()),
    }
    none = F.array().cast("array<struct<dimension:string,value:string>>")

    def entry(dimension: str, found: Column) -> Column:
        return F.when(others[dimension], F.transform(found, lambda x: F.struct(F.lit(dimension).alias("dimension"), x.alias("value")))).otherwise(none)

    entries = [entry(d, v) for d, v in values.items()]
    counted = rows.select(F.explode(F.concat(*entries)).alias("e")).groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("n"))
    fixed = [(d, label) for d, bands in (("difficulty", DIFFICULTY), ("steepness", STEEPNESS)) for _, label in bands] + [("activity", k) for k in use]
    domain = trails.sparkSession.createDataFrame(fixed, "dimension string, value string")
    zero = domain.join(counted.select("dimension", "value"), ["dimension", "value"], "left_anti").withColumn("n", F.lit(0).cast("long"))
    return counted.unionByName(zero)


def coverage(trails: DataFrame) -> DataFrame:
    """Conditional counts; NULL (not computed) and empty (none found) are told apart."""
    return trails.agg(
        F.count(F.lit(1)).alias("trails"),
        F.count_if(F.col("gain_ft").isNotNull()).alias("with_gain"),
        F.count_if(F.col("features").isNotNull()).alias("with_features_computed"),
        F.count_if(F.coalesce(F.size("features"), F.lit(0)) > 0).alias("with_features"),
        F.count_if(F.col("wilderness").isNotNull()).alias("with_wilderness"),
        F.count_if(F.col("season_months").isNotNull()).alias("with_season"),
    )


def dots(trails: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(dots, summary): marker or else center of each trail, unmappable ones counted."""
    limit, point = max(1, min(limit, DOT_LIMIT)), F.coalesce("marker", "center")
    found = trails.withColumn("point", point)
    summary = found.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("point").isNull()).alias("unmappable")).withColumn("truncated", F.col("total") > limit)
    return found.filter("point is not null").orderBy("ord").limit(limit).select("id", "name", "point.lng", "point.lat"), summary


def dot_clusters(points: DataFrame, degrees: float) -> DataFrame:
    """Points gathered by grid tile, with their count and longest trail; an approximation of pixel clusters."""
    tile = lambda c: F.floor(F.col(c) / degrees).cast("long")
    return points.groupBy(tile("lat").alias("tile_lat"), tile("lng").alias("tile_lng")).agg(F.count(F.lit(1)).alias("n"), F.max("length_miles").alias("longest"))


# Columns of a trail in a list, and on its own page
LIST_FIELDS = ["id", "name", "slug", "length_miles", "route_type", "gain_ft", "max_elevation_ft", "min_elevation_ft", "difficulty", "steepness", "features", "mgmt_area", "bbox", "center", "source", "marker"]
PUBLIC_FIELDS = [
    "id", "name", "slug", "trail_no", "length_miles", "route_type", "bbox", "center", "surface", "mgmt_area", "accessibility",
    "trail_class", "trail_class_label", "grade", "season", "features", "nearby", "gain_ft", "max_elevation_ft", "min_elevation_ft",
    "difficulty", "steepness", "elevation", "source", "endpoints", "access", "technical", "permits", "wilderness", "marker",
    "network", "website", "wikipedia",
]


def projected(trails: DataFrame, fields: list[str]) -> DataFrame:
    """Those of the fields that trails have, in their order; nothing else leaves the library."""
    return trails.select(*[f for f in fields if f in trails.columns])


MAP_LIMIT, DOT_LIMIT = 600, 20_000  # what one page may ask for


def map_features(trails: DataFrame, shapes: DataFrame, f: Filters, limit: int = 400) -> tuple[DataFrame, DataFrame]:
    """(features, summary): the first matches, in the page's order, with their shape (shapes: id, parts, at one level of detail).

    Matches without a shape aren't drawn, and count as cut off: truncated compares all matches with what is returned.
    """
    found = scoped(trails, f).filter(reduce(lambda a, b: a & b, predicates(f).values()))
    order = [*SORTS["relevance"](), F.asc("ord")]
    page = found.orderBy(*order).limit(max(1, min(limit, MAP_LIMIT)))
    drawn = page.join(shapes.filter(F.size("parts") > 0), "id").orderBy(*order)  # a page's rows
    drawn = drawn.select("id", "name", "length_miles", "gain_ft", "difficulty", F.concat_ws(",", "features").alias("features"), "wilderness", "parts")
    counts = found.agg(F.count(F.lit(1)).alias("total")).join(drawn.agg(F.count(F.lit(1)).alias("returned")))
    return drawn, counts.withColumn("truncated", F.col("total") > F.col("returned"))


def trail_detail(trails: DataFrame, shapes: DataFrame, profiles: DataFrame, ident: object, with_shape: bool = True) -> DataFrame:
    """One trail's public columns with its shape (parts) and profile; both filters reach the scans."""
    one = projected(trails.filter(F.col("id") == ident), PUBLIC_FIELDS).join(profiles.filter(F.col("id") == ident).select("id", "profile"), "id", "left")
    return one.join(shapes.filter(F.col("id") == ident).select("id", "parts"), "id", "left") if with_shape else one
