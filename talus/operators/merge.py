"""Grouping segments into trails, and the anti-joins that keep sources from repeating each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.geo import haversine
from talus.functions.sources import area_key
from talus.functions.text import slug, title
from talus.operators.lineage import cut
from talus.operators.lines import chain_networks, chain_steps, path_lengths


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the commonest non-null value, ties to the one seen first.

    Two grouped counts, so a key with very many rows is combined before the shuffle;
    mode() would break ties otherwise.
    """
    votes = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return votes.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "first", value)).alias(value))


def segments_to_trails(segments: DataFrame) -> DataFrame:
    """One row a trail_id from segments (trail_id, ord, name, surface, trail_class, miles).

    The commonest name and surface, the smallest class, the sum of known lengths (NULL
    when none is known) with a flag where some are missing. A trail without a name is dropped.
    """
    base = segments.groupBy("trail_id").agg(
        F.min("trail_class").alias("trail_class"),
        F.sum("miles").alias("miles"),
        F.count(F.lit(1)).alias("segment_count"),
        (F.count("miles") < F.count(F.lit(1))).alias("length_partial"),
    )
    out = base.join(majority(segments, "trail_id", "name", "ord"), "trail_id")
    return out.join(majority(segments, "trail_id", "surface", "ord"), "trail_id", "left")


def majorities(rows: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """key and, for each column of values, its commonest non-null text, ties to the one seen first; one pass for all columns."""
    entries = F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("string").alias("value")) for v in values])
    votes = rows.select(key, order, F.explode(entries).alias("e")).filter("e.value is not null").groupBy(key, "e.field", "e.value").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = votes.groupBy(key, "field").agg(F.min_by("value", F.struct(-F.col("n"), "first")).alias("value"))
    return best.groupBy(key).agg(*[F.max(F.when(F.col("field") == v, F.col("value"))).alias(v) for v in values])


TRAIL_TEXTS = ["name", "surface", "area", "trail_type", "org", "trail_no", "accessibility"]
#: Trails of more segments than this are combined before they are shuffled.
SHORT_TRAIL = 1000


def _commonest(votes: Column) -> Column:
    """The value of an array of struct(v, ord) that stands there most often, ties to the one seen first."""
    state = lambda v, n, o, best: F.struct(v.alias("v"), n.alias("n"), o.alias("o"), best.alias("best"))

    def on(s: Column, x: Column) -> Column:  # equal values are neighbours, and the first of them was seen first
        n, o = F.when(s["v"] == x["v"], s["n"] + 1).otherwise(1), F.coalesce(F.when(s["v"] == x["v"], s["o"]), x["ord"])
        return state(x["v"], n, o, F.greatest(s["best"], F.struct(n.alias("n"), (-o).alias("o"), x["v"].alias("v"))))

    null = F.lit(None).cast
    none = state(null("string"), F.lit(0), null("long"), null("struct<n: int, o: bigint, v: string>"))
    return F.aggregate(F.sort_array(votes), none, on, lambda s: s["best"]["v"])


def build_trails(segments: DataFrame, uses: list[str] = (), short: int = SHORT_TRAIL) -> DataFrame:
    """Whole records from segments (trail_id, ord, the TRAIL_TEXTS, trail_class, grade, miles, measured, box, one struct column a use).

    Texts by majority, the smallest class, the grade (a struct with max_pct) of the largest
    maximum, the sum of known lengths or else the measured one, the first known state of
    each use, and the union of boxes with its middle. A trail without a name is dropped.
    Segments of a trail meet in one shuffle and vote there, up to ``short`` of them; those
    of longer trails are combined before they are shuffled, so that none is in one task.
    """
    segments = segments.filter("trail_id is not null")
    long = cut(segments.groupBy("trail_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > short).select("trail_id"))
    own = ["ord", *TRAIL_TEXTS, "trail_class", "grade", "miles", "measured", "min_lng", "min_lat", "max_lng", "max_lat", *uses]
    none = long.isEmpty()
    few = segments if none else segments.join(long, "trail_id", "left_anti")
    votes = [F.collect_list(F.when(F.col(t).isNotNull(), F.struct(F.col(t).cast("string").alias("v"), F.col("ord").cast("long").alias("ord")))).alias(t) for t in TRAIL_TEXTS]
    out = few.select("trail_id", *own).repartition("trail_id").groupBy("trail_id").agg(*_summed(uses), *votes).filter(F.size("name") > 0)
    out = out.withColumns({t: _commonest(F.col(t)) for t in TRAIL_TEXTS})
    if not none:
        many = segments.join(long, "trail_id", "left_semi")
        out = out.unionByName(many.groupBy("trail_id").agg(*_summed(uses)).join(majorities(many, "trail_id", TRAIL_TEXTS, "ord"), "trail_id"))
    out = out.filter("name is not null and min_lng is not null").withColumns({
        "grade": F.col("_grade.v"),
        "length_miles": F.round(F.coalesce(F.nullif("_said", F.lit(0.0)), F.col("_measured")), 2),
        "geometry_length_miles": F.round("_measured", 2),
        "center_lng": F.round((F.col("min_lng") + F.col("max_lng")) / 2, 6),
        "center_lat": F.round((F.col("min_lat") + F.col("max_lat")) / 2, 6),
        **{u: F.col(f"{u}.v") for u in uses},
    })
    return out.drop("_grade", "_said", "_measured").withColumn("slug", slug(F.col("name"))).withColumn("name", title(F.col("name")))


def _summed(uses: list[str]) -> list[Column]:
    """Aggregates of a trail but for its texts."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v")))
    return [
        F.min("trail_class").alias("trail_class"),
        F.max(F.when(F.col("grade").isNotNull(), F.struct(F.col("grade.max_pct").alias("pct"), (-F.col("ord")).alias("o"), F.col("grade").alias("v")))).alias("_grade"),
        F.sum("miles").alias("_said"),
        F.sum("measured").alias("_measured"),
        *[F.min(known(u)).alias(u) for u in uses],
        *box_union(),
        F.count(F.lit(1)).alias("segment_count"),
    ]


def box_union() -> list[Column]:
    """Aggregates for the box around boxes; unknown ones don't count."""
    return [F.min("min_lng").alias("min_lng"), F.min("min_lat").alias("min_lat"), F.max("max_lng").alias("max_lng"), F.max("max_lat").alias("max_lat")]


def _bounds() -> list[Column]:
    """Aggregates for the box around vertices."""
    return [F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat")]


def vertex_bounds(vertices: DataFrame, key: str) -> DataFrame:
    """The box of each key's vertices, with the mean vertex for a centre."""
    return vertices.groupBy(key).agg(*_bounds(), F.avg("lng").alias("center_lng"), F.avg("lat").alias("center_lat"))


def park_trails(segments: DataFrame, by_unit: bool = True, vertices: DataFrame | None = None, parts: bool = True) -> DataFrame:
    """Trails of a park feed's segments (unit, unit_name, ord, name, surface, season, uses array<string>, miles), by unit and lower-case name.

    What the first segment says holds, uses are those of all; a trail without length is
    dropped. With by_unit=False (a feed of one park) the name alone decides. With ``vertices``
    (ord, part, seq, lng, lat) a trail's parts are chained, in the order of its segments: its length
    is theirs, and it has a box, its middle, part_count, point_count and, unless parts=False, parts.
    Where vertices have a column ``line``, only parts of one line, which is of one trail, are chained
    with each other; lines that happen to meet stay apart.
    """
    keys = [*(["unit"] if by_unit else []), "key_name"]
    first = F.min_by(F.struct("name", "surface", "season", "unit_name"), "ord").alias("f")
    own = segments.withColumn("key_name", F.lower("name")).filter("key_name is not null")
    g = own.groupBy(*keys).agg(first, F.array_sort(F.array_distinct(F.flatten(F.collect_set("uses")))).alias("uses"), F.round(F.sum("miles"), 2).alias("length_miles"), F.count(F.lit(1)).alias("segment_count"))
    shape = []
    if vertices is not None:
        trail = own.select("ord", F.concat_ws("\n", *keys).alias("_trail"))
        if "line" not in vertices.columns:
            vertices = vertices.join(trail.withColumnRenamed("_trail", "line"), "ord")
        # a chain is its first part's segment's trail's: points are shuffled once, to be chained, and summed up where they are
        runs = chain_steps(vertices.select(F.col("line").alias("path_id"), (F.col("ord") * (1 << 20) + F.col("part")).alias("part"), "seq", "lng", "lat"))
        runs = runs.withColumn("ord", F.shiftright("start", 20))
        if parts:
            runs = cut(runs)
        sums = runs.groupBy("ord").agg(F.sum("step_mi").alias("miles"), *_bounds(), F.count(F.when(F.col("seq") == 0, 1)).alias("part_count"), F.count(F.lit(1)).alias("point_count"))
        sums = sums.join(trail, "ord").groupBy("_trail").agg(F.round(F.sum("miles"), 2).alias("length_miles"), *box_union(), F.sum("part_count").alias("part_count"), F.sum("point_count").alias("point_count"))
        g = g.drop("length_miles").withColumn("_trail", F.concat_ws("\n", *keys)).join(sums, "_trail")
        middle = lambda c: F.round((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2, 6).alias(f"center_{c}")
        shape = ["min_lng", "min_lat", "max_lng", "max_lat", middle("lng"), middle("lat"), "part_count", "point_count"]
        if parts:
            lines = runs.groupBy("ord", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("line"))
            lines = lines.join(trail, "ord").groupBy("_trail").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "line"))), lambda r: r["line"]).alias("parts"))
            g, shape = g.join(lines, "_trail"), [*shape, "parts"]
    g = g.filter("length_miles > 0").withColumn("slug", slug(F.col("f.name")))
    ident = F.concat_ws(":", F.lit("nps"), F.col("unit") if by_unit else F.lit("SEKI"), "slug")
    return g.select(ident.alias("id"), title(F.col("f.name")).alias("name"), "slug", title(F.col("f.surface")).alias("surface"), F.col("f.season").alias("season"), F.col("f.unit_name").alias("area"), "uses", "length_miles", F.lit("out-and-back").alias("route_type"), "segment_count", *shape)


def unnamed_networks(segments: DataFrame, least_mi: float = 0.25) -> DataFrame:
    """Runs of a park's unnamed segments (unit, part, seq, lng, lat), a trail each; runs too short keep their number.

    A park may have any number of segments: only those that meet are chained in one task.
    """
    runs = chain_networks(segments.withColumnRenamed("unit", "path_id"))
    key = F.struct("path_id", "chain")
    miles = path_lengths(runs.withColumn("run", key), "run").select("run.path_id", "run.chain", F.round("miles", 2).alias("length_miles"))
    number = (F.col("chain") + 1).cast("string")
    miles = miles.filter(F.col("length_miles") >= least_mi)
    return miles.select(F.concat(F.lit("nps:"), F.col("path_id").cast("string"), F.lit(":unnamed-"), number).alias("id"), F.concat(F.lower(F.col("path_id").cast("string")), F.lit("-unnamed-"), number).alias("slug"), F.lit(False).alias("named"), "length_miles")


def listed(records: DataFrame, min_miles: float | None = None, named_only: bool = False, limit: int | None = None, miles: str = "length_miles") -> DataFrame:
    """Records, longest first, of a least length, with a name, and no more than a limit, where asked for."""
    if min_miles:
        records = records.filter(F.col(miles) >= min_miles)
    if named_only:
        records = records.filter(F.coalesce("name", F.lit("")) != "")
    records = records.orderBy(F.desc(miles))
    return records.limit(limit) if limit else records


def numbered(rows: DataFrame, order: list[Column], name: str = "ord") -> DataFrame:
    """Adds 0, 1, 2 ... in the given order: ranges of it are sorted and numbered apart and shifted by the rows before them."""
    keys = [f"_k{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # a range and a row's place in it; ranges are drawn by sampling, so they are fixed once
    dealt = cut(dealt.drop(*keys).withColumn("_m", F.monotonically_increasing_id()))
    dealt = dealt.withColumns({"_p": F.shiftright("_m", 33), "_within": F.col("_m").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shifts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return dealt.join(F.broadcast(shifts), "_p").withColumn(name, (F.col("_within") + F.col("_shift")).cast("long")).drop("_m", "_p", "_within", "_shift")


def index_order(sources: list[tuple[DataFrame, Column]]) -> DataFrame:
    """The sources one after another, each in its own order (a Column, as name or -length), numbered by ord."""
    out = None
    for rank, (rows, key) in enumerate(sources):
        number = key if dict(rows.select(key.alias("k")).dtypes)["k"] != "string" else F.lit(0.0)
        words = key if dict(rows.select(key.alias("k")).dtypes)["k"] == "string" else F.lit("")
        rows = rows.withColumns({"_rank": F.lit(rank), "_number": number.cast("double"), "_words": words})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return numbered(out, [F.col("_rank"), F.col("_number"), F.col("_words"), F.col("id")]).drop("_rank", "_number", "_words")


def boxes_overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.min_lng") <= F.col(f"{b}.max_lng")) & (F.col(f"{a}.max_lng") >= F.col(f"{b}.min_lng")) & (F.col(f"{a}.min_lat") <= F.col(f"{b}.max_lat")) & (F.col(f"{a}.max_lat") >= F.col(f"{b}.min_lat"))


def not_already_known(new: DataFrame, known: DataFrame, name: str = "key_name", miles: float = 2.0) -> DataFrame:
    """Rows of new for which no row of known has the same name and an overlapping box; hashed on the name.

    A known row without a box repeats what lies within ``miles`` of its lat and lng, where it has them.
    """
    same = boxes_overlap("a", "b")
    if {"lat", "lng"} <= set(known.columns) & set(new.columns):
        same |= F.col("b.min_lng").isNull() & (haversine(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")) <= miles)
    return new.alias("a").join(known.alias("b"), (F.col(f"a.{name}") == F.col(f"b.{name}")) & same, "left_anti")


def append_new(index: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """index and the rows of more whose key it lacks; more isn't deduplicated within itself."""
    return index.unionByName(more.join(index.select(key), key, "left_anti"), allowMissingColumns=True)


def largest_of_each(rows: DataFrame, keys: list[str], size: Column, order: str) -> DataFrame:
    """Of rows with equal keys the one of the largest size, then the smallest order."""
    whole = F.struct(*rows.columns)
    best = rows.groupBy(*keys).agg(F.min_by(whole, F.struct(-size, F.col(order))).alias("row"))
    return best.select("row.*")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed upsert: the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def link_permits(trails: DataFrame, permits: DataFrame) -> DataFrame:
    """Adds permit_id and permit_name: the first permit (id, name, ord) whose name holds the trail's area.

    Permits meet the distinct areas, not the trails, on the first word of the area's
    distinctive name, and the whole of it is then looked for.
    """
    areas = trails.select(F.col("area_name").alias("_area")).filter("_area is not null").distinct().withColumn("_key", area_key(F.col("_area"))).filter("_key <> ''")
    areas = areas.withColumn("_word", F.split_part("_key", F.lit(" "), F.lit(1)))
    heard = permits.select("id", "name", "ord", F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("_word"))
    found = areas.join(heard, "_word").filter(F.contains(F.lower("name"), F.col("_key")))
    first = found.groupBy("_area").agg(F.min(F.struct("ord", "id", "name")).alias("_p"))
    out = trails.join(first, trails["area_name"] == first["_area"], "left")
    return out.withColumn("permit_id", F.col("_p.id")).withColumn("permit_name", F.col("_p.name")).drop("_area", "_p")
