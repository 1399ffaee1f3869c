"""OpenStreetMap XML elements: tags, member roles and inline geometry as columns."""

from pyspark.sql import DataFrame, SparkSession, functions as F

_ND = "ARRAY<STRUCT<_lat:DOUBLE,_lon:DOUBLE>>"
_TAG = "ARRAY<STRUCT<_k:STRING,_v:STRING>>"
RELATION = f"_id BIGINT, member ARRAY<STRUCT<_type:STRING,_ref:BIGINT,_role:STRING,nd:{_ND}>>, tag {_TAG}"
WAY = f"_id BIGINT, nd {_ND}, tag {_TAG}"
NODE = f"_id BIGINT, _lat DOUBLE, _lon DOUBLE, tag {_TAG}"


def _tags(c: str = "tag"):
    """Tags as a map; of a repeated key the last value counts."""
    t = F.filter(F.coalesce(c, F.array().cast(_TAG)), lambda x: x["_k"].isNotNull())
    keys = F.array_distinct(F.transform(t, lambda x: x["_k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(t, lambda x: x["_k"] == k), -1)["_v"]))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Relations, ways and tagged nodes: kind, id, tags, outer and inner lines, child areas, incomplete flag."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    line = lambda m: F.transform(m["nd"], lambda p: F.struct(p["_lat"].alias("lat"), p["_lon"].alias("lon")))
    role = lambda m, *r: (m["_type"] == "way") & F.coalesce(m["_role"], F.lit("")).isin(*r)
    rel = read("relation", RELATION).withColumn("m", F.coalesce("member", F.array().cast("array<struct<_type:string,_ref:bigint,_role:string,nd:" + _ND.lower() + ">>")))
    broken = F.exists("m", lambda m: role(m, "", "outer", "inner") & (m["nd"].isNull() | F.exists(m["nd"], lambda p: p["_lat"].isNull() | p["_lon"].isNull())))
    rel = rel.select(F.lit("relation").alias("kind"), F.col("_id").alias("id"), _tags().alias("tags"),
                     F.transform(F.filter("m", lambda m: role(m, "", "outer")), line).alias("outer"), F.transform(F.filter("m", lambda m: role(m, "inner")), line).alias("inner"),
                     F.transform(F.filter("m", lambda m: (m["_type"] == "relation") & (m["_role"] == "subarea")), lambda m: m["_ref"]).alias("subareas"), broken.alias("incomplete"))
    none, ids = F.array().cast("array<array<struct<lat:double,lon:double>>>"), F.array().cast("array<bigint>")
    way = read("way", WAY)
    pts = F.transform("nd", lambda p: F.struct(p["_lat"].alias("lat"), p["_lon"].alias("lon")))
    way = way.select(F.lit("way").alias("kind"), F.col("_id").alias("id"), _tags().alias("tags"), F.array(pts).alias("outer"), none.alias("inner"), ids.alias("subareas"),
                     F.coalesce(F.exists("nd", lambda p: p["_lat"].isNull() | p["_lon"].isNull()), F.lit(True)).alias("incomplete"))
    node = read("node", NODE).filter(F.size("tag") > 0).select(F.lit("node").alias("kind"), F.col("_id").alias("id"), _tags().alias("tags"), none.alias("outer"),
                                                               none.alias("inner"), ids.alias("subareas"), F.lit(False).alias("incomplete"))
    return rel.unionByName(way).unionByName(node)
