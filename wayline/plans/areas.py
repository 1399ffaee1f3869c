"""Area import rules, parent links and area quality checks."""

from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions import text as tx
from wayline.operators.accept import reasons
from wayline.operators.stage import stage

# The place and level names that become areas, and the tag keys that never do.
PLACE_TYPES = {"city": "CITY", "town": "TOWN", "village": "VILLAGE", "hamlet": "LOCALITY", "suburb": "SUBURB", "quarter": "SUBURB",
               "borough": "SUBURB", "neighbourhood": "LOCALITY", "locality": "LOCALITY"}
LEVEL_TYPES = {6: "DISTRICT", 7: "MUNICIPALITY", 8: "MUNICIPALITY", 9: "LOCALITY", 10: "LOCALITY"}
EXCLUDED = ["amenity", "shop", "tourism", "building", "highway", "railway", "public_transport", "healthcare", "office", "craft", "leisure",
            "aeroway", "historic", "man_made", "bridge", "emergency", "barrier", "waterway", "military", "power"]
SECTOR = r"(?i)^sector[\s-]*\d+[a-z]?$"


def _from(c: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def classify(elements: DataFrame, longest: int | None = None) -> DataFrame:
    """Area type, or why the element is skipped or rejected (``tags`` map, ``kind``); names of any length unless one is given."""
    tag = lambda k: F.col("tags")[k]
    level = F.when(F.trim(tag("admin_level")).rlike(r"^\d+$"), F.trim(tag("admin_level")).try_cast("int"))
    base = F.when(tag("place").isNotNull(), _from(tag("place"), PLACE_TYPES)).when(tag("boundary") == "administrative", _from(level, LEVEL_TYPES))
    refined = F.when(base.isin("SUBURB", "LOCALITY") & F.coalesce(F.trim(tag("name")).rlike(SECTOR), F.lit(False)), "SECTOR").otherwise(base)
    d = elements.withColumn("area_type", refined).withColumn("clean", tx.area_name(tag("name")))
    skipped = reasons((F.arrays_overlap(F.map_keys("tags"), F.array(*[F.lit(k) for k in EXCLUDED])), "EXCLUDED_FEATURE"),
                      (tag("place").isNotNull() & base.isNull(), "UNMAPPED_PLACE"),
                      ((tag("boundary") == "administrative") & tag("place").isNull() & base.isNull(), "UNMAPPED_ADMIN_LEVEL"),
                      (base.isNull() | (F.col("kind") == "node"), "UNMAPPED_TAGS"))
    return d.withColumn("skipped", skipped).withColumn("rejected", F.when(F.col("skipped").isNull(), reasons(
        (F.col("clean") == "", "NO_NAME"), (F.lit(False) if longest is None else F.length("clean") > longest, "NAME_TOO_LONG"))))


def ancestor(links: DataFrame, steps: int) -> DataFrame:
    """``child`` -> the area ``steps`` parents up, for the chains that are that long; by doubling, not by walking."""
    power, made = links.select("child", "parent"), None
    while steps:
        if steps & 1:
            made = power if made is None else stage(made.join(power.select(F.col("child").alias("parent"), F.col("parent").alias("up")), "parent")
                                                    .select("child", F.col("up").alias("parent")))
        steps >>= 1
        if steps:
            power = stage(power.join(power.select(F.col("child").alias("parent"), F.col("parent").alias("up")), "parent").select("child", F.col("up").alias("parent")))
    return made


def parent_links(claims: DataFrame, stored: DataFrame) -> DataFrame:
    """Each stored child's claim: linked, ambiguous or parent not imported. A chain into a loop is ambiguous, however long; one that ends is not."""
    c = (claims.join(stored.select(F.col("area_id").alias("child")), "child", "left_semi").groupBy("child")
         .agg(F.countDistinct("parent").alias("n"), F.min("parent").alias("parent")))
    ids = stored.select(F.col("area_id").alias("parent"), F.lit(True).alias("known"))
    c = stage(c.join(ids, "parent", "left").withColumn("first", F.when(F.col("n") > 1, "ambiguous").when(F.col("known").isNull(), "not imported")))
    single = c.filter("first is null").select("child", "parent")
    endless = ancestor(single, _past_every_end(single)).select("child", F.lit(True).alias("endless"))
    return c.join(endless, "child", "left").select("child", "parent", F.coalesce("first", F.when(F.col("endless"), "ambiguous"), F.lit("linked")).alias("outcome"))


def _past_every_end(links: DataFrame) -> int:
    """More steps than there are links: only a chain that runs into a loop is that long."""
    return 1 << links.count().bit_length()


def in_parent_cycle(links: DataFrame) -> DataFrame:
    """Areas that are their own ancestor: whatever is left after more steps than there are links is on a loop."""
    return ancestor(links, _past_every_end(links)).select(F.col("parent").alias("area_id")).distinct()


def repeated_ids(areas: DataFrame, order: str) -> DataFrame:
    """``areas`` with ``duplicate``: an id of the source counts where it comes first by ``order``, later rows are duplicates."""
    first = areas.groupBy("external_id").agg(F.min(order).alias("_first"))
    return areas.join(first, "external_id").withColumn("duplicate", F.col(order) > F.col("_first")).drop("_first")


def find_area(areas: DataFrame, source: str, source_ids: DataFrame) -> DataFrame:
    """Areas of a source by the ids that it gives them."""
    return areas.filter(F.col("source") == source).join(source_ids.select("source_id").distinct(), "source_id", "left_semi")


def region(text: Column, widest: float) -> Column:
    """A box ``south,west,north,east`` in degrees read from a text, or the ``problem`` that it has: not four numbers, out of range, empty, or wider than
    ``widest``."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    south, west, north, east = (F.get(parts, F.lit(k)) for k in range(4))
    number = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    problem = reasons((F.coalesce(F.trim(text), F.lit("")) == "", "MISSING"), (F.size(parts) != 4, "NOT_FOUR_NUMBERS"), (~(number(south) & number(west) & number(north) & number(east)), "NOT_A_NUMBER"),
                      ((south < -90) | (north > 90) | (west < -180) | (east > 180), "OUT_OF_RANGE"), ((south >= north) | (west >= east), "EMPTY"), (F.greatest(north - south, east - west) > widest, "TOO_WIDE"))
    return F.struct(south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east"), problem.alias("problem"))


def in_region(boxes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Elements whose envelope (``x0``, ``y0``, ``x1``, ``y1``) meets the box."""
    south, west, north, east = box
    return boxes.filter((F.col("y1") >= south) & (F.col("y0") <= north) & (F.col("x1") >= west) & (F.col("x0") <= east))
