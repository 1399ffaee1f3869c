"""Raw provider route responses to route candidates, transit steps and fares."""

from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators.accept import reasons

# Fixed value.
DURATION = r"^(\d+(?:\.\d+)?)s$"
_STOP = "STRUCT<name:STRING,location:STRUCT<latLng:STRUCT<latitude:DOUBLE,longitude:DOUBLE>>>"
RESPONSE = ("routes ARRAY<STRUCT<distanceMeters:BIGINT,duration:STRING,polyline:STRUCT<encodedPolyline:STRING>,description:STRING,warnings:ARRAY<STRING>,"
            "travelAdvisory:STRUCT<transitFare:STRUCT<currencyCode:STRING,units:STRING,nanos:BIGINT>>,legs:ARRAY<STRUCT<steps:ARRAY<STRUCT<distanceMeters:BIGINT,"
            f"staticDuration:STRING,travelMode:STRING,transitDetails:STRUCT<stopDetails:STRUCT<departureStop:{_STOP},arrivalStop:{_STOP},departureTime:STRING,arrivalTime:STRING>,"
            "headsign:STRING,stopCount:INT,transitLine:STRUCT<name:STRING,nameShort:STRING,color:STRING,vehicle:STRUCT<type:STRING>>>>>>>>>")


def seconds(text: Column) -> Column:
    return F.when(text.rlike(DURATION), F.floor(F.regexp_extract(text, DURATION, 1).cast("double") + 0.5))


def tidy(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit(""))


def fare(money: Column) -> Column:
    """Reported amount; NULL when absent, malformed, zero or negative."""
    units = F.coalesce(money["units"], F.lit("0")).try_cast("decimal(18,9)")
    amount = units + F.coalesce(money["nanos"], F.lit(0)).cast("decimal(18,0)") * F.lit(0.000000001).cast("decimal(10,9)")
    return F.when(F.coalesce(money["currencyCode"].rlike("^[A-Z]{3}$"), F.lit(False)) & (amount > 0), amount.cast("double"))


def routes(responses: DataFrame) -> DataFrame:
    """One row per reported route, with a reason when it cannot be used; a caller that shows only some filters on ``idx``."""
    d = responses.withColumn("p", F.from_json("raw", RESPONSE)).select("response_id", F.posexplode("p.routes").alias("idx", "r"))
    r = F.col("r")
    warn = F.filter(F.coalesce(r["warnings"], F.array().cast("array<string>")), lambda w: F.trim(w) != "")
    return d.select("response_id", "idx", F.coalesce(r["distanceMeters"], F.lit(0)).alias("distance_m"), seconds(r["duration"]).alias("duration_s"),
                    r["polyline"]["encodedPolyline"].alias("encoded"), F.size(warn).alias("warnings"), fare(r["travelAdvisory"]["transitFare"]).alias("fare"),
                    r["travelAdvisory"]["transitFare"]["currencyCode"].alias("currency"), r["legs"].alias("legs"),
                    reasons((seconds(r["duration"]).isNull(), "duration is missing or malformed"),
                            (r["polyline"]["encodedPolyline"].isNull(), "polyline is missing")).alias("reason"))


def steps(route: DataFrame) -> DataFrame:
    """Walk and ride steps in order of ``seq`` (leg in the upper half); coordinates outside the range become NULL."""
    d = (route.filter("reason is null").select("response_id", "idx", F.posexplode("legs").alias("leg", "l"))
         .select("response_id", "idx", "leg", F.posexplode("l.steps").alias("n", "s")))
    s, t = F.col("s"), F.col("s.transitDetails")
    kind = F.when(t.isNotNull(), "RIDE").when(s["travelMode"] == "WALK", "WALK")
    line = tidy(t["transitLine"]["name"])
    deg = lambda stop, k, limit: F.when(F.abs(t["stopDetails"][stop]["location"]["latLng"][k]) <= limit, t["stopDetails"][stop]["location"]["latLng"][k])
    return d.withColumn("kind", kind).filter("kind is not null").select(
        "response_id", "idx", (F.shiftleft(F.col("leg").cast("bigint"), 32) + F.col("n")).alias("seq"), "kind", F.greatest(F.lit(0), F.coalesce(s["distanceMeters"], F.lit(0))).alias("distance_m"),
        F.coalesce(seconds(s["staticDuration"]), F.lit(0)).alias("duration_s"), F.when(line != "", line).otherwise(tidy(t["transitLine"]["nameShort"])).alias("line"),
        tidy(t["transitLine"]["vehicle"]["type"]).alias("vehicle"), tidy(t["stopDetails"]["departureStop"]["name"]).alias("from_stop"),
        tidy(t["stopDetails"]["arrivalStop"]["name"]).alias("to_stop"), F.greatest(F.lit(0), F.coalesce(t["stopCount"], F.lit(0))).alias("stop_count"),
        deg("departureStop", "latitude", 90).alias("from_lat"), deg("departureStop", "longitude", 180).alias("from_lon"))


def transit_totals(step: DataFrame) -> DataFrame:
    """Rides, transfers and walking of each route that has a ride."""
    ride = F.col("kind") == "RIDE"
    return (step.groupBy("response_id", "idx").agg(F.count(F.when(ride, 1)).alias("rides"), F.sum(F.when(~ride, F.col("distance_m")).otherwise(0)).alias("walking_m"),
                                                   F.min_by("from_stop", F.when(ride, F.col("seq"))).alias("first_stop"), F.max_by("to_stop", F.when(ride, F.col("seq"))).alias("last_stop"))
            .filter("rides > 0").withColumn("transfers", F.col("rides") - 1))
