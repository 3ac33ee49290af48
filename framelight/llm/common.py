"""What several operators share: tables, settled intermediate results, doc_id ranges."""

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One of its own only where spark.checkpoint.dir is unset in local mode, as in tests: on a cluster
    executors would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith(("local[", "local-cluster")) and spark.conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='framelight-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def total_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]


def exchange_bytes(total: int, low: int = 8 << 20, high: int = 128 << 20) -> int:
    """Text bytes in a chunk: grows with the root of the input, so that what one chunk sends to
    one hash block stays worth a row of its own, and never leaves what a task can hold."""
    return int(min(high, max(low, math.sqrt(6400.0 * total))))


def ranges(df: DataFrame, key: str, n: int, text: str = "text", unit: int = 4096) -> tuple[Column, int]:
    """Column: which of about n ranges of an integer key a row falls into (null: 0), and how many ranges there are.

    Ranges hold about as many bytes of text each: for the boundaries a key counts once for each ``unit`` bytes. Only keys are
    moved, and the driver gets the boundaries, 8 bytes for each range. In the plan they are one constant, cut in two
    levels, so that a row's lookup takes about 2*sqrt(n) comparisons."""
    none = F.lit(0), 1
    if n <= 1:
        return none
    times = F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / unit).cast("int")
    keys = df.select(F.col(key).cast("long").alias("key"), F.explode(F.sequence(F.lit(0), times))).filter("key IS NOT NULL").select("key")
    parts = keys.repartitionByRange(n, "key").select(F.spark_partition_id().alias("part"), "key").groupBy("part").agg(F.min("key").alias("key"))
    cuts = sorted({r["key"] for r in parts.collect()})[1:]
    if not cuts:
        return none
    wide = max(1, math.isqrt(len(cuts)))
    constant = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    upto = lambda values: F.size(F.filter(values, lambda c: c <= F.col(key)))
    group = upto(constant(cuts[::wide]))
    inner = upto(F.slice(constant(cuts), F.greatest((group - 1) * wide, F.lit(0)) + 1, F.lit(wide)))
    return F.when(F.col(key).isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * wide + inner).cast("int"), len(cuts) + 1
