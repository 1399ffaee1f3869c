"""Saved places, recent and offline journeys, preference documents and their freshness."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.functions import text as tx
from wayline.operators.accept import reasons
from wayline.operators.nearby import first_ranks
from wayline.plans.compare import TRAVEL_MODES

# Fixed values. The first line is what the application asks for; no function applies one unless it is passed in.
MAX_SAVED, MAX_RECENT, MAX_OFFLINE, MAX_LABEL = 20, 10, 10, 40
TTL_DAYS, STALE_DAYS, OLD_DAYS = 30, 7, 180
RESERVED = ["home", "work"]
PLACES = ("version INT, saved ARRAY<STRUCT<id:STRING,kind:STRING,label:STRING,placeId:STRING,savedAt:BIGINT>>, "
          "recent ARRAY<STRUCT<id:STRING,travelMode:STRING>>")
PREFERENCES = "version INT, prefer STRUCT<fastest:BOOLEAN,lowestFare:BOOLEAN,fewerTransfers:BOOLEAN,lessWalking:BOOLEAN>, avoid ARRAY<STRING>"


def recent(searches: DataFrame, now: Column, keep: int | None = None) -> DataFrame:
    """Newest search per user and journey key inside the time limit, newest first."""
    d = (searches.filter(F.col("ts") >= now - F.make_dt_interval(days=F.lit(TTL_DAYS))).groupBy("user_id", "journey_key")
         .agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "journey_key", "m.ts", "m.event_id"))
    order = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return first_ranks(d.withColumn("place", F.row_number().over(order)), keep, "place")


def place_changes(changes: DataFrame, keep: int | None = None, longest: int | None = None) -> DataFrame:
    """Result of each request to save a place, in time order per user: OK or a named error.

    Without removals a request only depends on when its slot (Home, Work, or a label) was first asked for: the first
    ``keep`` slots get in, a label that is in is taken, and later slots meet the limit. So the ordered list never has to
    be replayed; the slots are ranked instead.
    """
    label = tx.clean_label(F.col("label"), longest)
    custom = F.col("kind") == "CUSTOM"
    d = changes.withColumn("clean", F.when(custom, label).otherwise(F.initcap(F.lower("kind")))).withColumn("slot", F.lower("clean"))
    bad = reasons((~tx.is_place_id(F.col("place_id")), "INVALID_PLACE"), (F.col("clean").isNull(), "INVALID_LABEL"),
                  (custom & F.col("slot").isin(RESERVED), "LABEL_TAKEN"))
    d = d.withColumn("bad", bad)
    first = d.filter("bad is null").groupBy("user_id", "slot").agg(F.min("event_id").alias("first_id"))
    order = W.partitionBy("user_id").orderBy("first_id")
    inside = (first_ranks(first.withColumn("n", F.row_number().over(order)), keep, "n")
              .select("user_id", "slot", "first_id", F.lit(True).alias("in")))
    d = d.join(inside, ["user_id", "slot"], "left")
    taken = custom & F.col("in") & (F.col("event_id") > F.col("first_id"))
    return d.select("event_id", "user_id", "clean", F.coalesce(reasons((F.col("bad").isNotNull(), "_"), (taken, "LABEL_TAKEN"), (F.col("in").isNull(), "LIMIT")),
                                                                F.lit("OK")).alias("r"), "bad").withColumn(
        "result", F.when(F.col("r") == "_", F.col("bad")).otherwise(F.col("r"))).drop("r", "bad")


def saved_places(changes: DataFrame, results: DataFrame) -> DataFrame:
    """Where each saved place of a user points after all changes."""
    ok = results.filter("result = 'OK'").join(changes.select("event_id", "place_id"), "event_id")
    return ok.groupBy("user_id", F.col("clean").alias("label")).agg(F.max_by("place_id", "event_id").alias("place_id"))


def offline_changes(saves: DataFrame, keep: int | None = None) -> DataFrame:
    """OK for one of the first ``keep`` journeys of a user (or a newer copy of it), else LIMIT."""
    first = saves.groupBy("user_id", "journey_key").agg(F.min("event_id").alias("first_id"))
    order = W.partitionBy("user_id").orderBy("first_id")
    inside = first_ranks(first.withColumn("n", F.row_number().over(order)), keep, "n").select("user_id", "journey_key", F.lit("OK").alias("r"))
    return (saves.join(inside, ["user_id", "journey_key"], "left")
            .select("event_id", "user_id", "journey_key", "ts", F.coalesce("r", F.lit("LIMIT")).alias("result")))


def offline_journeys(changes: DataFrame, now: Column) -> DataFrame:
    """Newest copy per journey; the place names of old copies expire."""
    d = (changes.filter("result = 'OK'").groupBy("user_id", "journey_key").agg(F.max("ts").alias("saved_at")))
    return d.withColumn("named", F.col("saved_at") >= now - F.make_dt_interval(days=F.lit(TTL_DAYS)))


def freshness(saved: DataFrame, now: Column) -> DataFrame:
    """How far a saved copy can be trusted (``saved_at``, ``service_end``, ``imported_at``)."""
    age = lambda c, days: F.coalesce(F.col(c) <= now - F.make_dt_interval(days=F.lit(days)), F.lit(False))
    end = F.to_utc_timestamp(F.col("service_end").cast("timestamp") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"), "Asia/Kolkata")
    return saved.select("id", age("saved_at", STALE_DAYS).alias("saved_stale"), F.coalesce(now > end, F.lit(False)).alias("service_ended"),
                        age("imported_at", OLD_DAYS).alias("dataset_old"), F.col("imported_at").isNull().alias("dataset_age_unknown"))


# ---- stored documents

def parse_places(docs: DataFrame, now_ms: int, longest: int | None = None) -> DataFrame:
    """Documents (``doc_id``, ``raw``) with their status and saved records; unreadable documents are dropped whole, bad records one by one."""
    d = docs.withColumn("p", F.from_json("raw", PLACES))
    ok = F.coalesce((F.col("p.version") == 1) & F.col("p.saved").isNotNull() & F.col("p.recent").isNotNull(), F.lit(False))
    x = lambda s: ((F.length(s["id"]) >= 1) & s["kind"].isin("HOME", "WORK", "CUSTOM") & tx.is_place_id(s["placeId"])
                   & ((s["kind"] != "CUSTOM") | tx.clean_label(s["label"], longest).isNotNull()) & s["savedAt"].between(1, now_ms + 86_400_000))
    kept = F.filter("p.saved", lambda s: F.coalesce(x(s), F.lit(False)))
    return d.select("doc_id", F.when(F.col("raw").isNull(), "empty").when(ok, "ok").otherwise("discarded").alias("status"),
                    F.when(ok, F.size("p.saved") - F.size(kept)).otherwise(0).alias("dropped"), F.when(ok, kept).alias("saved"))


def parse_preferences(docs: DataFrame) -> DataFrame:
    """Preference documents: status, the switches that are on and the avoided modes in canonical order."""
    d = docs.withColumn("p", F.from_json("raw", PREFERENCES))
    ok = F.coalesce((F.col("p.version") == 1) & F.col("p.prefer").isNotNull() & F.col("p.avoid").isNotNull(), F.lit(False))
    modes = F.filter(F.array(*[F.lit(m) for m in TRAVEL_MODES]), lambda m: F.array_contains("p.avoid", m))
    on = F.concat_ws(",", *[F.when(F.col(f"p.prefer.{c}"), F.lit(c)) for c in ("fastest", "lowestFare", "fewerTransfers", "lessWalking")])
    return d.select("doc_id", F.when(F.col("raw").isNull(), "empty").when(ok, "ok").otherwise("discarded").alias("status"),
                    F.when(ok, on).otherwise("").alias("prefer"), F.when(ok, F.array_join(modes, ",")).otherwise("").alias("avoid"))
