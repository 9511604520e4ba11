"""Condition verdicts: go, incomplete, caution or no-go, as one projection over nested checks.

A trip row holds what was observed, in arrays; each rule is a Column that yields reasons
(check, severity, message). Missing data raises a trip to incomplete and never passes as
clear. No rule needs another row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import max_number

# Thresholds and phrases
AQI_CAUTION, AQI_NO_GO = 100, 150
SNOW_DEPTH_CAUTION_IN, SNOWFALL_CAUTION_IN = 12.0, 6.0
FIRE_RADIUS_MI, FIRE_RECENT_DAYS = 10.0, 30
WIND_CAUTION_MPH, WIND_NO_GO_MPH = 25, 40
LOW_TEMP_CAUTION_F, LOW_TEMP_NO_GO_F, HIGH_TEMP_CAUTION_F, HIGH_TEMP_NO_GO_F = 32, 15, 95, 105
SEVERE = "blizzard|ice storm|freezing rain|freezing drizzle|heavy snow|severe|tornado|hurricane|damaging wind|high wind|hail"
RISKY = "thunder|snow|sleet|wintry|freezing|shower|rain|drizzle|fog|smoke|frost|ice|windy|breezy|dust"
ALERT_NO_GO = "warning"
ALERT_CAUTION = "watch|advisory|statement"
RANKS = {"go": 0, "incomplete": 1, "caution": 2, "no-go": 3}

REASON = "struct<check:string,severity:string,message:string>"


def _reason(check: str, severity: str | Column, message: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(check).alias("check"), severity.alias("severity"), message.alias("message")).cast(REASON)


def _none() -> Column:
    return F.array().cast(f"array<{REASON}>")


def _if(test: Column, *reasons: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(*reasons)).otherwise(_none())


def _graded(check: str, value: Column, message: Column, caution: Column, no_go: Column) -> Column:
    return F.when(F.coalesce(no_go, F.lit(False)), F.array(_reason(check, "no-go", message))).when(F.coalesce(caution, F.lit(False)), F.array(_reason(check, "caution", message))).otherwise(_none())


def _checked(check: str, status: Column, rules: Column) -> Column:
    """The rules where the check ran; otherwise one reason that it is unavailable."""
    failed = status.isNull() | (status != "ok")
    return F.when(failed, F.array(_reason(check, "incomplete", F.concat(F.lit(f"{check} unavailable: "), F.coalesce(status, F.lit("did not run")))))).otherwise(rules)


def weather(periods: Column, covers: Column) -> Column:
    def one(p: Column) -> Column:
        wind = max_number(p["wind"])
        say = lambda what: F.concat(p["name"], F.lit(": "), what)
        sky = _graded("weather", p["short"], say(p["short"]), F.lower(p["short"]).rlike(RISKY), F.lower(p["short"]).rlike(SEVERE))
        temp = p["temp"]
        heat = _graded("weather", temp, say(F.concat(temp.cast("string"), F.lit("F"))), (temp <= LOW_TEMP_CAUTION_F) | (temp >= HIGH_TEMP_CAUTION_F), (temp <= LOW_TEMP_NO_GO_F) | (temp >= HIGH_TEMP_NO_GO_F))
        gust = _graded("weather", wind, say(F.format_string("wind to %d mph", wind.cast("long"))), wind >= WIND_CAUTION_MPH, wind >= WIND_NO_GO_MPH)
        return F.concat(sky, heat, gust)

    none = F.coalesce(F.size(periods), F.lit(0)) <= 0
    short = _if(covers == F.lit(False), _reason("weather", "incomplete", F.lit("forecast does not reach the trip dates")))
    return F.when(none, F.array(_reason("weather", "incomplete", F.lit("no forecast returned")))).otherwise(F.concat(short, F.flatten(F.transform(periods, one))))


def alerts(found: Column) -> Column:
    def one(a: Column) -> Column:
        event = F.lower(F.coalesce(a["event"], F.lit("alert")))
        stop = F.lower(a["severity"]).isin("extreme", "severe") | event.rlike(ALERT_NO_GO)
        return _graded("alerts", a["event"], F.coalesce(a["event"], F.lit("Alert")), event.rlike(ALERT_CAUTION), stop)

    return F.flatten(F.transform(F.coalesce(found, F.array().cast("array<struct<event:string,severity:string>>")), one))


def air(observed: Column) -> Column:
    """The worst reading; without any known reading the air is unknown, not clean."""
    worst = F.array_max(observed)
    return F.when(worst.isNull(), F.array(_reason("aqi", "incomplete", F.lit("no air quality monitor within range")))).otherwise(_graded("aqi", worst, F.concat(F.lit("AQI "), worst.cast("string")), worst >= AQI_CAUTION, worst >= AQI_NO_GO))


def fire(perimeters: Column, truncated: Column) -> Column:
    """A perimeter of unknown distance or age counts; the reason tells the closest."""
    near = F.filter(perimeters, lambda p: (p["distance_mi"].isNull() | (p["distance_mi"] <= FIRE_RADIUS_MI)) & (p["days"].isNull() | (p["days"] <= FIRE_RECENT_DAYS)))
    cut = _if(truncated, _reason("fire", "incomplete", F.lit("fire feed truncated")))
    closest = F.array_min(F.transform(near, lambda p: p["distance_mi"]))  # unknown ones are no closer than any
    told = F.coalesce(F.concat(closest.cast("double").cast("string"), F.lit(" mi away")), F.lit("distance unknown"))
    found = _if(F.size(near) > 0, _reason("fire", "caution", F.format_string("%d active fire perimeter(s) nearby — closest %s", F.size(near), told)))
    return F.when(perimeters.isNull(), F.array(_reason("fire", "incomplete", F.lit("fire perimeter data missing")))).otherwise(F.concat(cut, found))


def snow(depth: Column, fall: Column) -> Column:
    deep = _if(depth >= SNOW_DEPTH_CAUTION_IN, _reason("snow", "caution", F.lit("snow depth at the high point")))
    falling = _if(fall >= SNOWFALL_CAUTION_IN, _reason("snow", "caution", F.lit("forecast snowfall")))
    return F.when(depth.isNull() & fall.isNull(), F.array(_reason("snow", "incomplete", F.lit("snow depth not reported")))).otherwise(F.concat(deep, falling))


def water(status: Column, count: Column) -> Column:
    """Optional: a check that did not run says nothing; mapped water is never a green signal."""
    dry = _if(count == 0, _reason("water", "caution", F.lit("no mapped water near the route")))
    return F.when(status.isNull(), _none()).otherwise(_checked("water", status, dry))


def reasons(t: DataFrame) -> Column:
    c = lambda name: t[name]
    return F.concat(
        _checked("weather", c("weather_status"), weather(c("periods"), c("covers_dates"))),
        _checked("alerts", c("alerts_status"), alerts(c("alerts"))),
        _checked("aqi", c("aqi_status"), air(c("aqi"))),
        _checked("fire", c("fire_status"), fire(c("fires"), c("fire_truncated"))),
        _checked("snow", c("snow_status"), snow(c("snow_depth"), c("snow_fall"))),
        water(c("water_status"), c("water_count")),
    )


def rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), severity)


def verdicts(trips: DataFrame) -> DataFrame:
    """Adds reasons (worst first, else in order of the checks), status, unavailable_checks and complete."""
    found = trips.withColumn("reasons", reasons(trips))
    keyed = F.array_sort(F.transform("reasons", lambda r, i: F.struct((-rank(r["severity"])).alias("k"), i.alias("i"), r.alias("r"))))
    worst = F.coalesce(F.array_max(F.transform("reasons", lambda r: rank(r["severity"]))), F.lit(0))
    status = F.element_at(F.array(*[F.lit(s) for s in RANKS]), worst + 1)
    missing = F.array_distinct(F.transform(F.filter("reasons", lambda r: r["severity"] == "incomplete"), lambda r: r["check"]))
    return found.withColumn("status", status).withColumn("unavailable_checks", missing).withColumn("complete", F.size("unavailable_checks") == 0).withColumn("reasons", F.transform(keyed, lambda x: x["r"]))


def recency(days: Column) -> Column:
    return F.when(days.isNull(), "unknown age").when(days <= 7, "active").when(days <= 30, "recent").otherwise("older")


def days_since(epoch_ms: Column, now_ms: Column) -> Column:
    """Whole days, NULL if unusable; ``now`` is an argument so that results can be repeated."""
    return F.when(epoch_ms > 0, F.floor((now_ms - epoch_ms) / 86_400_000).cast("long"))


def covers_dates(first: Column, last: Column, start: Column, end: Column) -> Column:
    """Three-valued: NULL without trip dates, false where the forecast ends before the trip or begins after it."""
    return F.when(start.isNull() & end.isNull(), None).when(first.isNull() | last.isNull(), False).otherwise((F.coalesce(end, start) <= last) & (F.coalesce(start, end) >= first))


# Which place of a route each check looks at
HIGH_CHECKS, MIDDLE_CHECKS = ["weather", "alerts", "snow"], ["aqi", "water"]


def check_points(middle: DataFrame, high: DataFrame, key: str = "path_id") -> DataFrame:
    """(key, check, lat, lng): the highest point for weather, alerts and snow, where one is known, and the middle for the rest."""
    top = high.select(key, F.struct("lat", "lng").alias("top"))
    both = middle.select(key, F.struct("lat", "lng").alias("mid")).join(top, key, "left")
    entry = lambda check, at: F.struct(F.lit(check).alias("check"), at.alias("at"))
    looks = [entry(c, F.coalesce("top", "mid")) for c in HIGH_CHECKS] + [entry(c, F.col("mid")) for c in MIDDLE_CHECKS]
    return both.select(key, F.explode(F.array(*looks)).alias("e")).select(key, "e.check", "e.at.lat", "e.at.lng")
