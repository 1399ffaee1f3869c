"""Snapshot merge and publish: compare a new dataset with the stored one, retire what is gone, switch atomically."""

import json

from pyspark.sql import Column, DataFrame, functions as F


def merged(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Every record of either side with its outcome: INSERTED, UPDATED, UNCHANGED or RETIRED."""
    o = old.select(*key, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("in_old"))
    n = new.select(*key, *fields, F.lit(True).alias("in_new"))
    d = o.join(n, key, "full")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"old_{f}"))
    return d.withColumn("outcome", F.when(F.col("in_new").isNull(), "RETIRED").when(F.col("in_old").isNull(), "INSERTED")
                        .when(same, "UNCHANGED").otherwise("UPDATED"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The new snapshot of a soft-deleted table: new values win, missing records stay but become inactive."""
    d = merged(old, new, key, [*fields])
    gone = F.col("outcome") == "RETIRED"
    return d.select(*key, *[F.when(gone, F.col(f"old_{f}")).otherwise(F.col(f)).alias(f) for f in fields], (~gone).alias("active"), "outcome")


def store_counts(old: DataFrame, new: DataFrame, key: list[str], fields: list[str], was_active: str = "active") -> DataFrame:
    """Rows inserted, changed, unchanged and deactivated; a record that was already inactive is not deactivated again."""
    d = merged(old, new, key, fields).join(old.select(*key, F.col(was_active).alias("_a")), key, "left")
    o = F.when((F.col("outcome") == "RETIRED") & ~F.coalesce("_a", F.lit(False)), "ALREADY_INACTIVE").otherwise(F.col("outcome"))
    return d.groupBy(o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def stale(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored records the new dataset no longer has."""
    return old.join(new.select(*key), key, "left_anti")


def sorted_json(m: Column) -> Column:
    """A map as JSON text with sorted keys, so equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


# ---- publish

def publish(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes every table under a new version folder, then replaces the one-line pointer; readers see old or new, never a mix.

    A failure before the pointer is written leaves the previous version current.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    fs, path = _fs(spark, f"{root}/CURRENT")
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.{version}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    # The file context renames over the old pointer in one step, so a reader never finds none.
    jvm = spark._jvm
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(part, path, replace)


def current(spark, root: str, table: str) -> DataFrame:
    """A table of the published version."""
    version = json.loads(spark.read.text(f"{root}/CURRENT").first()[0])["version"]
    return spark.read.parquet(f"{root}/{version}/{table}")


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
