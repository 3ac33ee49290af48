"""Two-pass external shuffle into shards.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of the whole row. Pass two
loads one bucket at a time, shuffles it with Fisher-Yates and emits it; the buckets laid end to end are
the shuffled table, and shard s is the s-th of n_shards runs of it, so shard counts differ by one at most.

Defined cases: null and empty texts are rows as any other; rows alike in every column may stand in either
order, which cannot be told apart; an empty table gives no rows; input columns named ``shard`` or ``slot``
are replaced by the result's. The result depends on the rows, the seed and the bucket size only, not on how many partitions a cluster uses.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



LEAST_BUCKETS = 64  # also of a small table: what can be shuffled at a time


def row_bytes(df: DataFrame, columns: list[str]) -> Column:
    """About what a row takes: texts and binaries by their length, other columns by that of their JSON or 8 bytes."""
    def of(c: str) -> Column:
        kind, x = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(x), F.lit(0))
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(x.alias("x")))), F.lit(0))
        return F.lit(8)

    return sum((of(c).cast("long") for c in columns), F.lit(0).cast("long"))


def bucket_starts(counts: DataFrame) -> DataFrame:
    """(bucket, rows) to (bucket, before, total): prefix sums in two levels of about root(n) buckets."""
    n = max(1, counts.count())
    counts = counts.withColumn("block", F.floor(F.col("bucket") / max(1, math.isqrt(n))))
    blocks = counts.groupBy("block").agg(F.sum("rows").alias("block_rows"))
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("block_rows").over(order), F.lit(0)).alias("block_before"),
        F.sum("block_rows").over(Window.partitionBy()).alias("total"),
    )
    inner = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("inside", F.coalesce(F.sum("rows").over(inner), F.lit(0)))
        .join(blocks, "block")
        .select("bucket", (F.col("block_before") + F.col("inside")).alias("before"), "total")
    )


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 0, bucket_bytes: int = 32 << 20) -> DataFrame:
    """df's columns with shard int and slot long (gapless from 0 in each shard)."""
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    total = df.agg(F.coalesce(F.sum(row_bytes(df, kept)), F.lit(0))).first()[0]
    n_buckets = max(math.ceil(total / bucket_bytes), n_shards, LEAST_BUCKETS)
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in kept])
    rows = df.select(row.alias("row"), key.alias("key")).withColumn("bucket", F.pmod("key", F.lit(n_buckets)).cast("int"))
    starts = bucket_starts(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("place", T.LongType()), T.StructField("total", T.LongType())])

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        at = np.argsort(bucket["key"].to_numpy(), kind="stable")  # an order that no retry changes
        np.random.default_rng([seed, bucket["bucket"][0].as_py()]).shuffle(at)
        place = bucket["before"][0].as_py() + np.arange(len(at), dtype=np.int64)
        moved = bucket.select(["row", "total"]).take(pa.array(at))
        return pa.table([moved["row"], pa.array(place), moved["total"]], names=["row", "place", "total"])

    placed = rows.join(starts, "bucket").groupBy("bucket").applyInArrow(fisher_yates, schema)
    shard = F.expr(f"place * {n_shards} div total")
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("place") - first)
        .select("row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    )


def write_shards(shards: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    shards.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
