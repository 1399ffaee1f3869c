"""Distance joins over a degree grid: points with stops, stops with stops, stops in windows."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.functions.geo import box_degrees, cell, cells_between, haversine


def gridded(df: DataFrame, size: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumn("cy", cell(F.col(lat), size)).withColumn("cx", cell(F.col(lon), size))


def probing(df: DataFrame, size: float, south: Column, north: Column, west: Column, east: Column) -> DataFrame:
    """One copy of each row per grid cell its box touches."""
    return (df.withColumn("cy", F.explode(cells_between(south, north, size)))
            .withColumn("cx", F.explode(cells_between(west, east, size))))


def within(points: DataFrame, stops: DataFrame, meters: float, cos_floor: float = 0.2) -> DataFrame:
    """Pairs of a point (``plat``/``plon``) and a stop (``lat``/``lon``) at most ``meters`` apart.

    Each stop sits in one cell and each point probes the few cells its radius touches, so the join is an equi-join
    on cells and every pair appears once.
    """
    size = meters / 111_320.0
    d = box_degrees(F.lit(float(meters)), F.col("plat"), cos_floor)
    probe = probing(points, size, F.col("plat") - d, F.col("plat") + d, F.col("plon") - d, F.col("plon") + d)
    pairs = probe.join(gridded(stops, size), ["cy", "cx"]).drop("cy", "cx")
    return (pairs.withColumn("meters", haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")))
            .filter(F.col("meters") <= meters))


def first_ranks(df: DataFrame, limit: int | None, rank: str = "rank") -> DataFrame:
    """The rows up to a rank the caller names; all of them without one."""
    return df if limit is None else df.filter(F.col(rank) <= limit)


def nearest(points: DataFrame, key: str, stops: DataFrame, meters: float, limit: int | None = None) -> DataFrame:
    """Stops inside a radius of each point with their rank by distance (ties by stop id)."""
    order = W.partitionBy(key).orderBy("meters", "stop_id")
    return first_ranks(within(points, stops, meters).withColumn("rank", F.row_number().over(order)), limit)


def footpaths(stops: DataFrame, meters: float) -> DataFrame:
    """Ordered pairs of different stops within walking distance."""
    here = stops.select(F.col("stop_id").alias("from_id"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    return within(here, stops.select("stop_id", "lat", "lon"), meters).filter("from_id <> stop_id").select("from_id", "stop_id", "meters")


def in_windows(windows: DataFrame, stops: DataFrame, size: float) -> DataFrame:
    """Stops inside each map window (``south``/``west``/``north``/``east``)."""
    probe = probing(windows, size, F.col("south"), F.col("north"), F.col("west"), F.col("east"))
    return (probe.join(gridded(stops, size), ["cy", "cx"]).drop("cy", "cx")
            .filter(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))))


def window_reason(max_span: float = 0.04) -> Column:
    """Why a map window is refused, or NULL."""
    ok = lambda c, limit: F.col(c).between(-limit, limit)
    valid = (ok("south", 90) & ok("north", 90) & ok("west", 180) & ok("east", 180)
             & (F.col("north") > F.col("south")) & (F.col("east") > F.col("west")))
    wide = (F.col("north") - F.col("south") > max_span) | (F.col("east") - F.col("west") > max_span)
    return F.when(~F.coalesce(valid, F.lit(False)), "invalid window").when(wide, "window too large")


def window_stops(windows: DataFrame, stops: DataFrame, limit: int | None = None) -> DataFrame:
    """Stops of each window with their place by name."""
    found = in_windows(windows.filter(window_reason().isNull()), stops, 0.04)
    order = W.partitionBy("window_id").orderBy("stop_name", "stop_id")
    placed = found.select("window_id", "stop_id", F.row_number().over(order).alias("place"))
    return first_ranks(placed, limit, "place")
