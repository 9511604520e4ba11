"""Normalisers of single sources: kinds of places, allowed uses, and which rows are trails at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions.nulls import PARK_NULLS, SITE_NULLS, clean
from talus.functions.text import lookup, season

# Fixed values: (kind, tag, values) in the order in which they are tried
SCENERY_KINDS = [
    ("peak", "natural", ["peak", "volcano"]),
    ("waterfall", "waterway", ["waterfall"]),
    ("hot_spring", "natural", ["hot_spring"]),
    ("spring", "natural", ["spring"]),
    ("viewpoint", "tourism", ["viewpoint"]),
    ("arch", "natural", ["arch"]),
    ("cave", "natural", ["cave_entrance"]),
    ("glacier", "natural", ["glacier"]),
    ("lake", "natural", ["water"]),
]
# Uses as the park feed spells them
PARK_USES = {
    "hiker/pedestrian": "hiking",
    "pack and saddle": "horse",
    "bicycle": "bike",
    "cross-country ski": "xc_ski",
    "snowshoe": "snowshoe",
    "motorcycle": "motorcycle",
    "atv": "atv",
    "watercraft": "watercraft",
}
# Kinds of gazetteer classes; others are no places to walk to
GAZETTEER_KINDS = {
    "Summit": "peak", "Gap": "pass", "Ridge": "ridge", "Basin": "basin", "Cliff": "cliff", "Arch": "arch", "Cave": "cave", "Pillar": "pillar",
    "Island": "island", "Beach": "beach", "Range": "ridge", "Lake": "lake", "Reservoir": "lake", "Spring": "spring", "Falls": "waterfall",
    "Glacier": "glacier", "Bay": "bay", "Swamp": "marsh",
}
# Kinds of recreation sites; other types are left out
SITE_KINDS = {
    "TRAILHEAD": "trailhead", "CAMPGROUND": "campground", "CAMPING AREA": "campground", "GROUP CAMPGROUND": "campground", "HORSE CAMP": "campground",
    "DAY USE AREA": "day_use", "PICNIC SITE": "picnic", "GROUP PICNIC SITE": "picnic", "OHV STAGING AREA": "staging", "SNOWPARK": "snowpark",
    "OBSERVATION SITE": "viewpoint", "SWIMMING SITE": "swimming", "FISHING SITE": "fishing", "CLIMBING AREA": "climbing", "LOOKOUT/CABIN": "lookout",
    "INTERPRETIVE SITE": "interpretive", "INTERPRETIVE VISITOR CENTER (MAJOR)": "visitor_center", "INTERPRETIVE VISITOR CENTER (MINOR)": "visitor_center",
    "INFO SITE/FEE STATION": "visitor_center",
}
# Columns of a recreation site that are told, and their names
SITE_DETAILS = {
    "fee_charged": "fee", "fee_description": "fee_description", "water_availability": "water", "restroom_availability": "restroom",
    "open_season": "open_season", "season_description": "season_description", "operational_hours": "hours", "usage_level": "usage_level",
    "total_capacity": "capacity", "closest_towns": "closest_towns", "directions": "directions", "restrictions": "restrictions",
    "permit_information": "permit_info", "passes": "passes", "rec1stop_url": "reservation_url", "usda_portal_url": "info_url",
    "seasonal_operational_status": "status",
}
# Kinds of a park's points
PARK_POINT_KINDS = {"waterfall": "waterfall", "viewpoint": "viewpoint", "scenic overlook": "viewpoint", "trailhead": "trailhead", "parking lot": "parking", "drinking water": "water"}
# Waterways and still waters that count as a source of water
WATERWAYS, LAKES = ["stream", "river", "creek"], ["lake", "reservoir", "pond"]
# Labels of walking networks, of the hiking scale and of tread that is hard to see
NETWORK_LABELS = {"iwn": "International walking network", "nwn": "National walking network", "rwn": "Regional walking network", "lwn": "Local walking network"}
SCALE_LABELS = {
    "hiking": "Hiking trail",
    "mountain_hiking": "Mountain hiking — sure footing needed",
    "demanding_mountain_hiking": "Demanding — exposed sections, hands may be needed",
    "alpine_hiking": "Alpine — exposure, snowfields, simple scrambling",
    "demanding_alpine_hiking": "Demanding alpine — scrambling, glacier travel",
    "difficult_alpine_hiking": "Difficult alpine — climbing, high exposure",
}
SCALE_GRADES = {
    "hiking": "T1 - easy, well-cleared trail",
    "mountain_hiking": "T2 - continuous trail, some exposure",
    "demanding_mountain_hiking": "T3 - exposed sections, sure-footedness needed",
    "alpine_hiking": "T4 - trail may be absent, hands occasionally needed",
    "demanding_alpine_hiking": "T5 - scrambling, exposed",
    "difficult_alpine_hiking": "T6 - climbing, glacier travel",
}
VISIBILITY_LABELS = {"bad": "Faint tread — route-finding needed", "horrible": "Tread often absent — navigation required", "no": "No visible tread — full route-finding"}
# What a park feed's status and a way's tags rule out
CLOSED_STATUS = ["Decommissioned", "Proposed", "Temporarily Closed"]
PAVEMENT = ["sidewalk", "crossing", "traffic_island", "access_aisle"]
DRIVEWAYS = ["driveway", "parking_aisle"]


def tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def scenery_kind(tags: Column) -> Column:
    """The kind of feature by the first rule that holds, or NULL."""
    return F.coalesce(*[F.when(tag(tags, key).isin(values), kind) for kind, key, values in SCENERY_KINDS])


def access_kind(tags: Column, camps: list[tuple[str, str, str]] = ()) -> Column:
    """The kind of access point; parking counts only where its name says trailhead.

    ``camps`` has (tag, value, kind) of camp sites that are no common campground, first match first.
    """
    camp = F.coalesce(*[F.when(F.lower(tag(tags, key)) == value, kind) for key, value, kind in camps], F.lit("campground"))
    shelter = (tag(tags, "tourism") == "wilderness_hut") | (tag(tags, "amenity") == "shelter")
    return (
        F.when(tag(tags, "highway") == "trailhead", "trailhead")
        .when(tag(tags, "amenity") == "parking", F.when(F.lower(tag(tags, "name")).rlike("trail ?head"), "trailhead"))
        .when(tag(tags, "amenity") == "drinking_water", "water")
        .when(shelter, "shelter")
        .when(tag(tags, "tourism") == "camp_site", camp)
    )


def water_kind(tags: Column) -> Column:
    """The kind of water by tags: springs, then waterways, then still water, a lake unless it says which."""
    return (
        F.when(tag(tags, "natural") == "spring", "spring")
        .when(tag(tags, "waterway").isin(WATERWAYS), tag(tags, "waterway"))
        .when(tag(tags, "natural") == "water", F.when(tag(tags, "water").isin(LAKES), tag(tags, "water")).otherwise("lake"))
    )


def gazetteer_kind(feature_class: Column, name: Column) -> Column:
    """The kind of a gazetteer record, NULL for classes left out; hot springs are told by their name alone."""
    kind = lookup(GAZETTEER_KINDS, feature_class)
    return F.when((kind == "spring") & F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("hot spring")), "hot_spring").otherwise(kind)


def site_kind(site_type: Column) -> Column:
    return lookup(SITE_KINDS, F.upper(clean(site_type, SITE_NULLS)))


def site_name(props: Column) -> Column:
    """The name visitors know, else the area's, else the one in the works."""
    return F.coalesce(*[clean(F.try_element_at(props, F.lit(k)), SITE_NULLS) for k in ("public_site_name", "recarea_name", "site_name")])


def site_details(props: Column) -> Column:
    """map<name, text> of the details that say something; NULL, not empty, where none does."""
    told = F.array(*[F.struct(F.lit(name).alias("k"), clean(F.try_element_at(props, F.lit(key)), SITE_NULLS).alias("v")) for key, name in SITE_DETAILS.items()])
    told = F.filter(told, lambda e: e["v"].isNotNull())
    return F.when(F.size(told) > 0, F.map_from_entries(told))


def park_point_kind(kind: Column) -> Column:
    return lookup(PARK_POINT_KINDS, F.lower(clean(kind, PARK_NULLS)))


def park_uses(text: Column) -> Column:
    """map<use, true> of a list like "Hiker/Pedestrian|Bicycle"; unknown words are left out."""
    known = F.filter(F.transform(F.split(text, r"\|"), lambda w: lookup(PARK_USES, F.lower(F.trim(w)))), lambda k: k.isNotNull())
    return F.map_from_entries(F.transform(F.array_distinct(F.coalesce(known, F.array().cast("array<string>"))), lambda k: F.struct(k, F.lit(True))))


def use_state(props: Column, prefix: str) -> Column:
    """struct(allowed, restricted, season) of one use's columns. allowed is true or unknown, never false."""
    of = lambda suffix: clean(F.try_element_at(props, F.lit(f"{prefix}_{suffix}")))
    managed, restricted = of("managed"), of("restricted")
    accepted = F.coalesce(of("accpt"), of("accpt_disc"))
    yes = lambda *cs: F.when(reduce(lambda a, b: a | b, [c.isNotNull() for c in cs]), True)
    state = F.struct(yes(managed, accepted).alias("allowed"), yes(restricted).alias("restricted"), F.coalesce(season(managed), season(accepted)).alias("season"))
    return F.when(managed.isNotNull() | accepted.isNotNull() | restricted.isNotNull(), state)


def hikeable(trail_type: Column, surface: Column, allowed: Column, restricted: Column) -> Column:
    """False only where the feed says so: a snow route, or hiking restricted and not allowed."""
    said = lambda c: F.coalesce(c, F.lit(False))
    return ~said(trail_type == "SNOW") & ~said(F.lower(surface) == "snow") & ~(said(restricted) & ~said(allowed))


def usable_way(name: Column, tags: Column, vertices: Column) -> Column:
    """A named way that is a trail and not pavement, an area or a driveway."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    placeholder = F.lower(trimmed).rlike(r"^[\[(]|^no\s+name\b|^unnamed\b")
    low = lambda key: F.lower(tag(tags, key))
    return (trimmed != "") & ~placeholder & ~low("footway").isin(PAVEMENT) & (low("area") != "yes") & ~low("service").isin(DRIVEWAYS) & (vertices >= 2)


def open_in(status: Column, unit: Column, units: list[str]) -> Column:
    """Not closed by status, and in one of the units; an unknown status passes, an unknown unit doesn't."""
    return ~F.coalesce(clean(status).isin(CLOSED_STATUS), F.lit(False)) & F.coalesce(clean(unit).isin(units), F.lit(False))


def area_key(name: Column) -> Column:
    """The distinctive part of a wilderness name."""
    return F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("wilderness"), F.lit("")), r"\s+", " "))
