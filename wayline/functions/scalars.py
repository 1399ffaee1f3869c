"""Times, ids, small parsers, accessibility and vehicle modes as column expressions."""

from pyspark.sql import Column, functions as F

# Fixed values.
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MAX_HOURS = 47
GTFS_TIME = r"^(\d{1,2}):([0-5]\d):([0-5]\d)$"
VEHICLE_MODES = {
    "METRO": ["SUBWAY", "METRO", "METRO_RAIL", "URBAN_RAIL"],
    "BUS": ["BUS", "INTERCITY_BUS", "TROLLEYBUS"],
    "TRAIN": ["HEAVY_RAIL", "COMMUTER_TRAIN", "HIGH_SPEED_TRAIN", "LONG_DISTANCE_TRAIN", "RAIL", "TRAIN"],
    "OTHER": ["TRAM", "LIGHT_RAIL", "MONORAIL", "FERRY", "CABLE_CAR", "GONDOLA_LIFT", "FUNICULAR", "SHARE_TAXI",
              "OTHER"],
}


def half_up(c: Column) -> Column:
    """floor(x + 0.5), the rounding of whole metres and seconds."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def gtfs_seconds(text: Column) -> Column:
    """Seconds since the start of the service day; NULL for a blank or malformed text."""
    t = F.trim(text)
    hours = F.regexp_extract(t, GTFS_TIME, 1)
    ok = t.rlike(GTFS_TIME) & (F.coalesce(hours.try_cast("int"), F.lit(MAX_HOURS + 1)) <= MAX_HOURS)
    parts = [F.regexp_extract(t, GTFS_TIME, k).try_cast("int") for k in (1, 2, 3)]
    return F.when(ok, parts[0] * 3600 + parts[1] * 60 + parts[2])


def gtfs_malformed(text: Column) -> Column:
    return (F.coalesce(F.trim(text), F.lit("")) != "") & gtfs_seconds(text).isNull()


def basic_date(text: Column) -> Column:
    """yyyyMMdd, or NULL."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def weekday_name(date: Column) -> Column:
    return F.lower(F.date_format(date, "EEEE"))


def day_list(flags: dict[str, Column]) -> Column:
    """Array of the operating weekdays, Monday first."""
    return F.filter(F.array(*[F.when(flags[d] == "1", F.lit(d)) for d in DAYS]), lambda d: d.isNotNull())


def in_day_order(days: Column) -> Column:
    return F.filter(F.array(*[F.lit(d) for d in DAYS]), lambda d: F.array_contains(days, d))


def dashed(hexa: Column) -> Column:
    return F.concat_ws("-", *[F.substring(hexa, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def stable_id(source: Column, kind: str, external: Column) -> Column:
    """Name-based identifier: the same source, kind and id always give the same value."""
    h = F.md5(F.concat(source, F.lit(f":{kind}:"), external))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return dashed(F.concat(F.substring(h, 1, 12), F.lit("3"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def pattern_id(source: Column, route: Column, signature: Column) -> Column:
    return dashed(F.md5(F.concat(source, F.lit(":bus-pattern:"), route, F.lit(":"), signature)))


def color(text: Column) -> Column:
    return F.when(text.rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(text)))


def direction(text: Column) -> Column:
    return F.when(text == "0", 0).when(text == "1", 1)


def round6(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def whole(text: Column) -> Column:
    """An integer written as text, or NULL."""
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def access_status(raw: Column) -> Column:
    return F.when(raw == "1", "ACCESSIBLE").when(raw == "2", "INACCESSIBLE").otherwise("UNKNOWN")


def vehicle_mode(raw: Column) -> Column:
    """Travel mode of a provider vehicle type; NULL when it is not recognised."""
    v = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    out = None
    for mode, types in VEHICLE_MODES.items():
        out = F.when(v.isin(types), mode) if out is None else out.when(v.isin(types), mode)
    return out


def walk_seconds(meters: Column) -> Column:
    return half_up(meters * 1.3 / 1.25)


def at_zone(date: Column, seconds: Column, zone: str) -> Column:
    """Instant of a service-day second in the dataset's zone."""
    return F.to_utc_timestamp(date.cast("timestamp"), zone) + F.make_dt_interval(secs=seconds)
