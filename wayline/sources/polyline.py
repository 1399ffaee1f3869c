"""Encoded polylines: vertices to text and back; a text is cut into values in its row, only points are shuffled."""

from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators.ordered import previous, running_sum
from wayline.operators.stage import stage

SCALE = 1e5


def _chunks(delta: Column) -> Column:
    z = F.shiftleft(delta, 1).bitwiseXOR(F.shiftright(delta, 63))
    n = F.lit(1)
    for k in range(1, 7):
        n = n + F.when(z >= F.lit(1 << (5 * k)), 1).otherwise(0)
    parts = [F.when(F.lit(i) < n, F.char(_code(z, n, i))).otherwise("") for i in range(7)]
    return F.concat(*parts)


def _code(z: Column, n: Column, i: int) -> Column:
    return F.shiftright(z, 5 * i).bitwiseAND(F.lit(31).cast("bigint")) + F.when(F.lit(i) < n - 1, 32).otherwise(0) + 63


def encode(vertices: DataFrame) -> DataFrame:
    """Vertices (``route_id``, ``seq``, ``lat``, ``lon``) to one text per route."""
    v = vertices.select("route_id", "seq", F.floor(F.col("lat") * SCALE + 0.5).alias("y"), F.floor(F.col("lon") * SCALE + 0.5).alias("x"))
    d = previous(v, ["route_id"], "seq", F.struct("y", "x"), "p")
    dy, dx = F.col("y") - F.coalesce("p.y", F.lit(0)), F.col("x") - F.coalesce("p.x", F.lit(0))
    d = d.select("route_id", "seq", F.concat(_chunks(dy), _chunks(dx)).alias("part"))
    return d.groupBy("route_id").agg(F.expr("listagg(part) WITHIN GROUP (ORDER BY seq)").alias("encoded"))


def _delta(text: Column) -> Column:
    """The number a value stands for: five bits a character, of seven characters at most, the lowest bit its sign."""
    bits = lambda i: F.ascii(F.substring(text, i + 1, 1)) - 63
    z = F.lit(0).cast("bigint")
    for i in range(7):
        z = z + F.when(F.length(text) > i, F.shiftleft(bits(i).bitwiseAND(F.lit(31)).cast("bigint"), 5 * i)).otherwise(F.lit(0))
    z = F.when(text.isNotNull(), z)
    return F.when(z % 2 == 1, -F.floor(z / 2) - 1).otherwise(F.floor(z / 2))


def decode(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of the readable texts, and the rejected texts with a reason."""
    # A value ends with its first character below 95; the text ends with an open value if it ends with another one.
    texts = encoded.select("route_id", F.regexp_extract_all("encoded", F.lit(r"[^\x00-\x5E]*[\x00-\x5E]|[^\x00-\x5E]+\z"), F.lit(0)).alias("texts")).filter(F.size("texts") > 0)
    pair = F.transform(F.sequence(F.lit(0), F.floor((F.size("texts") - 1) / 2).cast("int")), lambda p: F.struct(F.get("texts", 2 * p).alias("y"), F.get("texts", 2 * p + 1).alias("x")))
    pts = texts.select("route_id", F.posexplode(pair).alias("point", "t")).select("route_id", F.col("point").cast("bigint").alias("point"), F.col("t.y").alias("ty"), F.col("t.x").alias("tx"))
    wrong = lambda t: (F.ascii(F.substring(t, -1, 1)) >= 95) | (F.length(t) > 7) | t.rlike(r"[^\x3F-\x7E]")
    pts = pts.select("route_id", "point", _delta(F.col("ty")).alias("dy"), _delta(F.col("tx")).alias("dx"), (F.col("tx").isNull() | wrong(F.col("ty")) | wrong(F.col("tx"))).alias("bad"))
    pts = running_sum(running_sum(pts, ["route_id"], "point", F.col("dy"), "y"), ["route_id"], "point", F.col("dx"), "x")
    pts = pts.withColumn("lat", F.col("y") / SCALE).withColumn("lon", F.col("x") / SCALE)
    pts = stage(pts.select("route_id", "point", "lat", "lon", "bad"))
    per = pts.groupBy("route_id").agg(F.bool_or("bad").alias("bad"), F.bool_or((F.abs("lat") > 90) | (F.abs("lon") > 180)).alias("far"), F.count(F.lit(1)).alias("n"),
                                      (F.min("lat") != F.max("lat")).alias("my"), (F.min("lon") != F.max("lon")).alias("mx"))
    why = (F.when(F.trim(F.coalesce("encoded", F.lit(""))) == "", "MISSING").when(F.col("bad"), "MALFORMED").when(F.col("far"), "COORDINATE_OUT_OF_RANGE")
           .when(F.col("n") < 2, "TOO_FEW_POINTS").when(~F.col("mx") & ~F.col("my"), "NO_LENGTH"))
    rejected = encoded.join(per, "route_id", "left").select("route_id", why.alias("reason")).filter("reason is not null")
    return pts.select("route_id", F.col("point").alias("seq"), "lat", "lon").join(rejected, "route_id", "left_anti"), rejected


def wkt(vertices: DataFrame) -> DataFrame:
    """One LINESTRING text per route, longitude first."""
    v = vertices.select("route_id", "seq", F.concat(F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string")).alias("p"))
    return v.groupBy("route_id").agg(F.concat(F.lit("LINESTRING("), F.expr("listagg(p, ',') WITHIN GROUP (ORDER BY seq)"), F.lit(")")).alias("wkt"))
