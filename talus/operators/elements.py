"""Map elements as flat records: their lines joined, measured and labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.sources import SCALE_GRADES, tag
from talus.functions.text import lookup
from talus.operators.lineage import cut
from talus.operators.lines import chain_paths, route_type, steps, worst_gap

STITCH_M = 35.0

# Tags that become columns of their own.
FLAT_TAGS = [
    "name", "alt_name", "ref", "operator", "network", "surface", "tracktype", "smoothness", "sac_scale", "trail_visibility", "mtb:scale", "difficulty", "incline", "width", "ascent", "descent", "distance",
    "ele", "access", "foot", "bicycle", "horse", "dog", "wheelchair", "fee", "seasonal", "highway", "route", "symbol", "osmc:symbol", "website", "wikidata", "wikipedia", "description",
]


def tags_json(tags: Column) -> Column:
    """A map as JSON text with its keys in order, a blank after each comma and colon."""
    text = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(text(e["key"]), F.lit(": "), text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def records(parts: DataFrame, tags: DataFrame, flat: list[str] | None = None) -> DataFrame:
    """A record for each element from its parts (path_id, part, seq, lng, lat) and tags (path_id, tags).

    Parts whose ends share a cell are joined to runs, then runs across small gaps; an element
    without a run of two points has no record. Lengths are sums over runs, the box is that of
    all vertices, the centre their mean, max_gap_m says how far its runs lie apart, and several
    runs are a network. Tags of ``flat`` become columns, NULL where an element lacks them, and all tags tags_json.
    """
    flat = FLAT_TAGS if flat is None else flat
    runs = cut(chain_paths(parts, stitch_m=STITCH_M, snap=True))  # read twice: by run, and whole for the kind of route
    at, run = F.struct("lng", "lat"), ["path_id", "chain"]
    each = steps(runs.repartition("path_id"), run).groupBy(*run).agg(F.sum("step_mi").alias("miles"), F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("b"), F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("lng", "lat") for f in (F.min, F.max, F.sum)])
    rounded = lambda c, name: F.round(c, 6).alias(name)
    long = each.groupBy("path_id").agg(
        F.round(F.sum("miles"), 4).alias("length_mi"), F.round(F.sum("miles") * 1.609344, 4).alias("length_km"), F.count(F.lit(1)).cast("int").alias("segments"), worst_gap(F.collect_list(F.struct("a", "b"))).alias("max_gap_m"),
        *[rounded(f(f"{f.__name__}_{c}"), f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lng", "lat")], *[rounded(F.sum(f"sum_{c}") / F.sum("n"), f"center_{c}") for c in ("lng", "lat")],
    )
    kind = route_type(runs.withColumn("at", F.col("chain") * (1 << 32) + F.col("seq")), seq="at", run="chain")
    out = long.join(kind, "path_id").join(tags.select("path_id", "tags"), "path_id", "left")
    held = F.coalesce("tags", F.create_map().cast("map<string, string>"))
    out = out.withColumns({t: F.try_element_at("tags", F.lit(t)) for t in flat})
    return out.withColumn("scale_label", F.coalesce(lookup(SCALE_GRADES, tag(F.col("tags"), "sac_scale")), F.lit(""))).withColumn("tags_json", tags_json(held))
