"""GTFS text tables and zipped feeds, read as all-text columns with the position of each row in its file."""

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def has_table(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _clean(c: str) -> Column:
    return F.coalesce(F.regexp_replace(F.col(f"`{c}`"), r"(?U)^[\x{FEFF}\s]+|\s+$", ""), F.lit(""))


def table(spark: SparkSession, path: str, required: list[str], optional: list[str] = (), present: bool = True,
          needed: bool = False) -> DataFrame:
    """A feed table: stripped text columns, '' for missing values, absent optional columns added, plus ``row_pos``.

    A row whose wanted columns are all blank stays, so that the import counts it as rejected. A missing table is empty,
    or an error where the feed cannot do without it (``needed``).

    ``monotonically_increasing_id`` is taken on the scan itself, so it follows file order.
    """
    wanted = [*required, *optional]
    if not present or not has_table(spark, path):
        if needed:
            raise FileNotFoundError(f"the feed has no table {path}")
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in wanted) + ", row_pos bigint")
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=False)
    names = {c.replace("﻿", "").strip(): c for c in raw.columns}
    lost = [c for c in required if c not in names]
    if lost:
        raise ValueError(f"{path} lacks the columns {', '.join(lost)}")
    cols = [_clean(names[c]).alias(c) if c in names else F.lit("").alias(c) for c in wanted]
    return raw.select(*cols, F.monotonically_increasing_id().alias("row_pos"))


def unzip(spark: SparkSession, archives: str, target: str) -> None:
    """Unpacks feeds: one task per archive yields its members' lines, written as text per member."""
    def members(batches):
        import pandas as pd
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            rows = []
                            for n, line in enumerate(io.TextIOWrapper(f, "utf-8-sig", newline="")):
                                rows.append((path, name.rsplit("/", 1)[-1], n, line.rstrip("\r\n")))
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "line", "value"])
                                    rows = []
                            yield pd.DataFrame(rows, columns=["archive", "member", "line", "value"])

    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    lines = files.mapInPandas(members, "archive string, member string, line bigint, value string")
    lines.select("member", "value").write.partitionBy("member").mode("overwrite").text(target)
