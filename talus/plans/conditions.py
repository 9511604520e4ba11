"""Queries on condition checks and verdicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.operators import rules
from talus.operators.merge import numbered
from talus.sources.views import load
from talus.streaming import readings, sweep

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


SKIES = ["Sunny", "Blizzard Conditions", "Chance Showers", "Windy", "Patchy Fog", "Heavy Snow", "Clear"]
EVENTS = ["Flood Watch", "Winter Storm Warning", "Air Stagnation Advisory", "Outlook"]


def _pick(values: list[str], at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip a user and day; each kind of event stands for a check. A kind without events did not run."""
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    of = lambda kind, value: F.when(F.col("event_type") == kind, value)
    period = F.struct(F.col("event_id").alias("ord"), _pick(SKIES, F.col("event_id")).alias("short"), F.floor("value").cast("double").alias("temp"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("5 to "), (F.col("event_id") % 50).cast("string"), F.lit(" mph"))).alias("wind"))
    alert = F.struct(F.col("event_id").alias("ord"), _pick(EVENTS, F.col("event_id")).alias("event"), F.when(F.col("event_id") % 10 == 0, "Severe").alias("severity"))
    blaze = F.struct(F.col("event_id").alias("ord"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("distance_mi"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 60).alias("days"))
    g = e.groupBy("user_id", "day").agg(
        F.array_sort(F.collect_list(of("view", period))).alias("periods"),
        F.array_sort(F.collect_list(of("error", alert))).alias("alerts"),
        F.collect_list(of("click", F.col("value"))).alias("aqi"),
        F.array_sort(F.collect_list(of("purchase", blaze))).alias("fires"),
        F.max(of("signup", F.col("value"))).alias("snow_depth"),
        F.min(of("signup", F.col("value"))).alias("snow_fall"),
        F.count_if(F.col("event_id") % 2 == 0).alias("water_count"),
    )
    ran = lambda c: F.when(F.size(c) > 0, "ok")
    return g.select(
        "user_id", "day", "aqi", "snow_depth", "snow_fall", "water_count",
        F.transform("periods", lambda p: F.struct(F.lit("then").alias("name"), p["short"].alias("short"), p["temp"].alias("temp"), p["wind"].alias("wind"))).alias("periods"),
        F.transform("alerts", lambda a: F.struct(a["event"].alias("event"), a["severity"].alias("severity"))).alias("alerts"),
        F.transform("fires", lambda f: F.struct(f["distance_mi"].alias("distance_mi"), f["days"].alias("days"))).alias("fires"),
        ran("periods").alias("weather_status"), F.lit("ok").alias("alerts_status"), ran("aqi").alias("aqi_status"), F.lit("ok").alias("fire_status"),
        (F.col("user_id") % 11 == 0).alias("fire_truncated"), F.lit("ok").alias("snow_status"), F.when(F.col("user_id") % 2 == 0, "ok").alias("water_status"), (F.col("user_id") % 13 != 0).alias("covers_dates"),
    )


@query
def risk_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each trip, its number of reasons by severity, and the checks that are missing."""
    v = rules.verdicts(trips(spark, sf_dir))
    n = lambda s: F.size(F.filter("reasons", lambda r: r["severity"] == s)).cast("long")
    return v.select("user_id", F.col("day").cast("string").alias("day"), "status", "complete", n("no-go").alias("n_no_go"), n("caution").alias("n_caution"), n("incomplete").alias("n_incomplete"), F.concat_ws(",", F.array_sort("unavailable_checks")).alias("missing"))


def _at(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][event_id % {len(values)} + 1]"


SQL["risk_verdict"] = f"""WITH e AS (SELECT *, cast(ts as date) AS day, lower({_at(SKIES)}) AS sky, floor(value) AS temp, CASE WHEN event_id % 3 <> 0 THEN greatest(5, event_id % 50) END AS wind, lower({_at(EVENTS)}) AS alert FROM events),
t AS (SELECT user_id, day, count(*) FILTER (event_type = 'view') AS periods, max(value) FILTER (event_type = 'click') AS aqi, max(value) FILTER (event_type = 'signup') AS depth, min(value) FILTER (event_type = 'signup') AS fall,
  count(*) FILTER (event_id % 2 = 0) AS water, count(*) FILTER (event_type = 'purchase' AND (event_id % 5 = 0 OR value <= 10) AND (event_id % 7 = 0 OR event_id % 60 <= 30)) AS fires,
  min(value) FILTER (event_type = 'purchase' AND event_id % 5 <> 0 AND value <= 10 AND (event_id % 7 = 0 OR event_id % 60 <= 30)) AS closest FROM e GROUP BY 1, 2),
r AS (
  SELECT user_id, day, 'weather' AS c, 'incomplete' AS s FROM t WHERE periods = 0
  UNION ALL SELECT user_id, day, 'weather', 'incomplete' FROM t WHERE periods > 0 AND user_id % 13 = 0
  UNION ALL SELECT user_id, day, 'weather', CASE WHEN regexp_matches(sky, '{rules.SEVERE}') THEN 'no-go' ELSE 'caution' END FROM e WHERE event_type = 'view' AND regexp_matches(sky, '{rules.SEVERE}|{rules.RISKY}')
  UNION ALL SELECT user_id, day, 'weather', CASE WHEN temp <= 15 OR temp >= 105 THEN 'no-go' ELSE 'caution' END FROM e WHERE event_type = 'view' AND (temp <= 32 OR temp >= 95)
  UNION ALL SELECT user_id, day, 'weather', CASE WHEN wind >= 40 THEN 'no-go' ELSE 'caution' END FROM e WHERE event_type = 'view' AND wind >= 25
  UNION ALL SELECT user_id, day, 'alerts', CASE WHEN event_id % 10 = 0 OR contains(alert, 'warning') THEN 'no-go' ELSE 'caution' END FROM e WHERE event_type = 'error' AND (event_id % 10 = 0 OR regexp_matches(alert, 'warning|{rules.ALERT_CAUTION}'))
  UNION ALL SELECT user_id, day, 'aqi', CASE WHEN aqi IS NULL THEN 'incomplete' WHEN aqi >= 150 THEN 'no-go' ELSE 'caution' END FROM t WHERE aqi IS NULL OR aqi >= 100
  UNION ALL SELECT user_id, day, 'fire', 'incomplete' FROM t WHERE user_id % 11 = 0
  UNION ALL SELECT user_id, day, 'fire', 'caution' FROM t WHERE fires > 0
  UNION ALL SELECT user_id, day, 'snow', 'incomplete' FROM t WHERE depth IS NULL
  UNION ALL SELECT user_id, day, 'snow', 'caution' FROM t WHERE depth >= 12
  UNION ALL SELECT user_id, day, 'snow', 'caution' FROM t WHERE fall >= 6
  UNION ALL SELECT user_id, day, 'water', 'caution' FROM t WHERE user_id % 2 = 0 AND water = 0
), k AS (SELECT user_id, day, count(*) FILTER (s = 'no-go') AS a, count(*) FILTER (s = 'caution') AS b, count(*) FILTER (s = 'incomplete') AS c, string_agg(DISTINCT c, ',' ORDER BY c) FILTER (s = 'incomplete') AS m FROM r GROUP BY 1, 2)
SELECT t.user_id, cast(t.day as varchar) AS day, CASE WHEN a > 0 THEN 'no-go' WHEN b > 0 THEN 'caution' WHEN c > 0 THEN 'incomplete' ELSE 'go' END AS status, coalesce(c, 0) = 0 AS complete,
  coalesce(a, 0) AS n_no_go, coalesce(b, 0) AS n_caution, coalesce(c, 0) AS n_incomplete, coalesce(m, '') AS missing FROM t LEFT JOIN k ON k.user_id = t.user_id AND k.day = t.day"""


@query
def reason_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each verdict, worst first."""
    v = rules.verdicts(trips(spark, sf_dir))
    return v.select("user_id", F.col("day").cast("string").alias("day"), F.posexplode("reasons").alias("place", "r")).select("user_id", "day", "place", "r.check", "r.severity", "r.message")


_MPH = "wind to ' || wind || ' mph"
SQL["reason_report"] = f"""WITH e AS (SELECT *, cast(ts as date) AS day, {_at(SKIES)} AS sky, floor(value) AS temp, CASE WHEN event_id % 3 <> 0 THEN greatest(5, event_id % 50) END AS wind, {_at(EVENTS)} AS alert FROM events),
t AS (SELECT user_id, day, count(*) FILTER (event_type = 'view') AS periods, max(value) FILTER (event_type = 'click') AS aqi, max(value) FILTER (event_type = 'signup') AS depth, min(value) FILTER (event_type = 'signup') AS fall,
  count(*) FILTER (event_id % 2 = 0) AS water, count(*) FILTER (event_type = 'purchase' AND (event_id % 5 = 0 OR value <= 10) AND (event_id % 7 = 0 OR event_id % 60 <= 30)) AS fires,
  min(value) FILTER (event_type = 'purchase' AND event_id % 5 <> 0 AND value <= 10 AND (event_id % 7 = 0 OR event_id % 60 <= 30)) AS closest FROM e GROUP BY 1, 2),
r(user_id, day, c, s, message, c_no, event, part) AS (
  SELECT user_id, day, 'weather', 'incomplete', 'weather unavailable: did not run', 0, 0, 0 FROM t WHERE periods = 0
  UNION ALL SELECT user_id, day, 'weather', 'incomplete', 'forecast does not reach the trip dates', 0, -1, 0 FROM t WHERE periods > 0 AND user_id % 13 = 0
  UNION ALL SELECT user_id, day, 'weather', CASE WHEN regexp_matches(lower(sky), '{rules.SEVERE}') THEN 'no-go' ELSE 'caution' END, 'then: ' || sky, 0, event_id, 0 FROM e WHERE event_type = 'view' AND regexp_matches(lower(sky), '{rules.SEVERE}|{rules.RISKY}')
  UNION ALL SELECT user_id, day, 'weather', CASE WHEN temp <= 15 OR temp >= 105 THEN 'no-go' ELSE 'caution' END, 'then: ' || cast(temp as varchar) || 'F', 0, event_id, 1 FROM e WHERE event_type = 'view' AND (temp <= 32 OR temp >= 95)
  UNION ALL SELECT user_id, day, 'weather', CASE WHEN wind >= 40 THEN 'no-go' ELSE 'caution' END, 'then: {_MPH}', 0, event_id, 2 FROM e WHERE event_type = 'view' AND wind >= 25
  UNION ALL SELECT user_id, day, 'alerts', CASE WHEN event_id % 10 = 0 OR contains(lower(alert), 'warning') THEN 'no-go' ELSE 'caution' END, alert, 1, event_id, 0 FROM e WHERE event_type = 'error' AND (event_id % 10 = 0 OR regexp_matches(lower(alert), 'warning|{rules.ALERT_CAUTION}'))
  UNION ALL SELECT user_id, day, 'aqi', CASE WHEN aqi IS NULL THEN 'incomplete' WHEN aqi >= 150 THEN 'no-go' ELSE 'caution' END, CASE WHEN aqi IS NULL THEN 'aqi unavailable: did not run' ELSE 'AQI ' || cast(aqi as varchar) END, 2, 0, 0 FROM t WHERE aqi IS NULL OR aqi >= 100
  UNION ALL SELECT user_id, day, 'fire', 'incomplete', 'fire feed truncated', 3, 0, 0 FROM t WHERE user_id % 11 = 0
  UNION ALL SELECT user_id, day, 'fire', 'caution', fires || ' active fire perimeter(s) nearby — closest ' || coalesce(cast(closest as varchar) || ' mi away', 'distance unknown'), 3, 1, 0 FROM t WHERE fires > 0
  UNION ALL SELECT user_id, day, 'snow', 'incomplete', 'snow depth not reported', 4, 0, 0 FROM t WHERE depth IS NULL
  UNION ALL SELECT user_id, day, 'snow', 'caution', 'snow depth at the high point', 4, 0, 0 FROM t WHERE depth >= 12
  UNION ALL SELECT user_id, day, 'snow', 'caution', 'forecast snowfall', 4, 1, 0 FROM t WHERE fall >= 6
  UNION ALL SELECT user_id, day, 'water', 'caution', 'no mapped water near the route', 5, 0, 0 FROM t WHERE user_id % 2 = 0 AND water = 0
) SELECT user_id, cast(day as varchar) AS day, cast(row_number() OVER (PARTITION BY user_id, day ORDER BY CASE s WHEN 'no-go' THEN 0 WHEN 'caution' THEN 1 ELSE 2 END, c_no, event, part) - 1 as int) AS place, c AS "check", s AS severity, message FROM r"""


@query
def coldest_overnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest reading of each user among those known to be by night; unknown is neither day nor night."""
    e = load(spark, sf_dir, "events").withColumn("is_daytime", F.when(F.col("event_id") % 5 != 0, F.hour("ts").between(6, 17)))
    return e.filter("is_daytime = false").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.min("value").alias("low"))


SQL["coldest_overnight"] = "SELECT user_id, arg_min(event_id, struct_pack(v := value, e := event_id)) AS event_id, min(value) AS low FROM events WHERE event_id % 5 <> 0 AND hour(ts) NOT BETWEEN 6 AND 17 GROUP BY user_id"


@query
def forecast_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's readings reach the dates of a trip, with unknown dates left unknown."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    start = F.when(F.col("user_id") % 5 != 0, F.date_add("last", (F.col("user_id") % 7 - 3).cast("int")))
    end = F.when(F.col("user_id") % 3 != 0, F.date_add(start, 2))
    return e.select("user_id", rules.covers_dates(F.col("first"), F.col("last"), start, end).alias("covers"))


SQL["forecast_coverage"] = """SELECT user_id, CASE WHEN s IS NULL THEN NULL ELSE coalesce(f, s) <= last AND s >= first END AS covers FROM (
  SELECT *, CASE WHEN user_id % 3 <> 0 THEN s + 2 END AS f FROM (SELECT *, CASE WHEN user_id % 5 <> 0 THEN last + cast(user_id % 7 - 3 as int) END AS s FROM (
    SELECT user_id, cast(min(ts) as date) AS first, cast(max(ts) as date) AS last FROM events GROUP BY user_id)))"""


@query
def snow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and fall of each user and day; no reading is unknown, not zero."""
    e = load(spark, sf_dir, "events").withColumn("depth", F.when(F.col("event_type") == "view", F.col("value"))).withColumn("fall", F.when(F.col("event_type") == "click", F.col("value")))
    return e.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.max("depth").alias("max_depth_in"), F.round(F.avg("depth"), 6).alias("mean_depth_in"), F.round(F.sum("fall"), 2).alias("snowfall_in"))


SQL["snow_summary"] = """SELECT user_id, cast(cast(ts as date) as varchar) AS day, max(value) FILTER (event_type = 'view') AS max_depth_in, round(avg(value) FILTER (event_type = 'view'), 6) AS mean_depth_in, round(sum(value) FILTER (event_type = 'click'), 2) AS snowfall_in FROM events GROUP BY 1, 2"""


@query
def itinerary_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trail split into equal days of at most eight miles; out-and-back counts twice."""
    t = load(spark, sf_dir, "trails").withColumn("miles", F.col("length_miles") * F.when(F.col("route_type") == "out-and-back", 2).otherwise(1))
    days = F.greatest(F.lit(1), F.ceil(F.col("miles") / 8)).cast("int")
    return t.select("id", F.explode(F.sequence(F.lit(1), days)).alias("day"), F.round(F.col("miles") / days, 2).alias("day_miles"))


SQL["itinerary_days"] = """SELECT id, unnest(range(1, d + 1))::int AS day, round(miles / d, 2) AS day_miles FROM (SELECT *, greatest(1, ceil(miles / 8))::int AS d FROM (
  SELECT id, length_miles * CASE WHEN route_type = 'out-and-back' THEN 2 ELSE 1 END AS miles FROM trails))"""


@query
def segment_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hue for each name, spread by the golden angle."""
    names = load(spark, sf_dir, "part").select("p_name").distinct()
    return numbered(names, [F.col("p_name")]).select("p_name", F.round(F.col("ord") * 137.508 % 360, 3).alias("hue"))


SQL["segment_colours"] = "SELECT p_name, round((dense_rank() OVER (ORDER BY p_name) - 1) * 137.508::double % 360, 3) AS hue FROM (SELECT DISTINCT p_name FROM part)"


@query
def readings_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a place and kind at each event: the last good reading of the day before it, errors never kept."""
    e = load(spark, sf_dir, "events")
    k = F.col("user_id") % 40
    r = e.select(F.col("event_id").alias("reading_id"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("kind"), (37 + k / 100).alias("lat"), (-120 - k / 50).alias("lng"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"), "value")
    return readings.known(r, 3600).select("reading_id", "kind", "known", "age_s")


SQL["readings_known"] = """WITH r AS (SELECT event_id, 'k' || event_id % 3 AS kind, user_id % 40 AS place, ts, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS since, last_value(v IGNORE NULLS) OVER p AS last FROM r WINDOW p AS (PARTITION BY place, kind ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT *, floor(epoch(ts))::bigint - floor(epoch(since))::bigint AS age FROM w)
SELECT event_id AS reading_id, kind, CASE WHEN age < 3600 THEN last END AS known, CASE WHEN age < 3600 THEN age END AS age_s FROM a"""


@query
def sweep_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles still to be read: users as tiles, their events as results of readings, the last of them the state."""
    e = load(spark, sf_dir, "events")
    tile = F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tile_id")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "empty").otherwise("done")
    results = e.select(tile, status.alias("status"), (F.col("event_id") % 3).cast("int").alias("attempt"), F.col("ts").cast("timestamp").alias("at"))
    plan = load(spark, sf_dir, "customer").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("tile_id"))
    return sweep.left(plan, results, retries=3)


SQL["sweep_left"] = """WITH r AS (SELECT 't' || user_id AS tile_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'empty' ELSE 'done' END AS status, event_id % 3 AS attempt, ts FROM events),
s AS (SELECT tile_id, count(DISTINCT attempt) AS n, last(status ORDER BY attempt, ts, status) AS status FROM r GROUP BY tile_id)
SELECT 't' || c_custkey AS tile_id, coalesce(n, 0)::integer AS attempt FROM customer LEFT JOIN s ON s.tile_id = 't' || c_custkey WHERE s.status IS NULL OR (s.status = 'failed' AND n <= 3)"""
