"""The library of remembered settings: one JSON document of entries by identity."""

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.operators.review import TUNING, tuning_error

TEXTS = ("identity", "product_url", "name", "normalized_name", "category", "archetype", "image_url", "note", "created_at", "updated_at", "saved_at")
ENTRY = "struct<" + ",".join(f"{c}:string" for c in TEXTS) + f",override:{TUNING}>"


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Entries as rows. A document that is not whole, or has an entry with a tuning out of range, is an error: it is never taken for empty."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.from_json("value", f"struct<entries:map<string,{ENTRY}>>", {"mode": "FAILFAST"}).alias("v")).select(F.when(F.col("v.entries").isNull(), F.raise_error(F.lit("not a library of entries"))).otherwise(F.col("v.entries")).alias("entries"))
    rows = entries.select(F.explode("entries").alias("key", "e")).select(F.coalesce("e.identity", "key").alias("identity"), *[F.col(f"e.{c}") for c in TEXTS[1:]], F.col("e.override").alias("override"))
    bad = tuning_error(F.col("override"))
    return rows.withColumn("override", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("out of range: "), bad))).otherwise(F.col("override")))


def load_library(spark: SparkSession, path: str) -> DataFrame:
    """Entries as rows, read through once. No document is no entries; a broken or empty one is copied to ``path``.corrupt.<time>.bak, and an
    error: the document itself stays as it is."""
    at, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = at(path).getFileSystem(conf)
    if not fs.exists(at(path)):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in TEXTS) + f", override {TUNING}")
    try:
        if fs.getContentSummary(at(path)).getLength() == 0:
            raise OSError(f"{path} is empty")
        rows = read_library(spark, path)
        rows.write.format("noop").mode("overwrite").save()
    except Exception:
        backup = f"{path}.corrupt.{datetime.now(timezone.utc):%Y%m%dT%H%M%S%fZ}.bak"
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at(path), fs, at(backup), False, conf)
        raise
    return rows


def write_library(rows: DataFrame, path: str) -> None:
    """A whole new document beside the old one, read back, and then put in its place; the old one stays as .bak."""
    spark = rows.sparkSession
    made = f"{path}.{uuid.uuid4().hex}"
    document = rows.select(F.struct("identity", F.struct(*TEXTS, "override").alias("e")).alias("x")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("x")).alias("entries"))).alias("value"))
    document.coalesce(1).write.text(made)
    if read_library(spark, made).count() != rows.count():
        raise OSError(f"{made} is not what was written")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.delete(at(f"{path}.bak"), True)
        fs.rename(at(path), at(f"{path}.bak"))
    fs.rename(at(made), at(path))
