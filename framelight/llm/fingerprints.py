"""SimHash document fingerprints, in DataFrame functions only.

Terms are the words of a text, weighted by how few documents hold them: document frequencies of all texts
are summed in a table of fixed size (TABLE hashed cells), and a cell's weight runs from 1 (in every
document) to 15. Every occurrence of a term votes with its weight on each bit of the term's hash; a bit of the
fingerprint is set if the ones outweigh the zeros. Two bits share one long counter, a lane of 32 bits each.

Defined cases: null is the empty text; a text without words has the fingerprint of zeros; equal texts have
equal fingerprints; an empty table gives no rows; ids may repeat or be null (sorted first, ties by text).
"""

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.llm.common import exchange_bytes, ranges, shuffle_partitions, total_bytes

TABLE = 1 << 14
HASHES = 2  # of 64 bits
SPLIT = r"[\x20\x09-\x0D]+"


def cell(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), word), F.lit(TABLE)).cast("int")


def term_weights(df: DataFrame, text: str = "text") -> bytes:
    """Weight of each cell, one byte each: a table of fixed size, from all texts."""
    words = df.select(F.explode(F.array_distinct(F.split(F.coalesce(text, F.lit("")), SPLIT))).alias("word")).filter("word <> ''")
    found = dict(words.groupBy(cell(F.col("word")).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())  # TABLE rows at most
    docs = max(1, df.count())
    top = math.log(docs + 1)
    return bytes(15 - min(14, max(0, round(14 * (1 - math.log((docs + 1) / min(docs, found.get(c, 0) + 1)) / top)))) if docs > 1 else 1 for c in range(TABLE))


def _votes(word: Column, weights: bytes) -> tuple[list[Column], Column]:
    weight = F.when(word == "", F.lit(0)).otherwise(F.ascii(F.substring(F.lit(bytearray(weights)), cell(word) + 1, F.lit(1)).cast("string"))).cast("long")
    return [F.xxhash64(F.lit(101 + i), word).alias(f"h{i}") for i in range(HASHES)], weight.alias("w")


def fingerprint_texts(df: DataFrame, keys: list[str], text: str, weights: bytes) -> DataFrame:
    """keys (which must identify a row) with fp0, fp1: longs that hold the fingerprint's bits.

    Where df is dealt by some of the keys already, the votes are summed without a shuffle."""
    hashes, weight = _votes(F.col("word"), weights)
    words = df.select(*keys, F.explode(F.split(F.coalesce(text, F.lit("")), SPLIT)).alias("word")).select(*keys, weight, *hashes)
    lanes = F.lit(0x0000000100000001).cast("long")
    sums = [F.sum(F.col("w") * F.shiftrightunsigned(f"h{i}", k).bitwiseAND(lanes)).alias(f"s{i}_{k}") for i in range(HASHES) for k in range(32)]
    low = F.lit(0xFFFFFFFF).cast("long")

    def bit(i: int, k: int) -> Column:
        lane = F.col(f"s{i}_{k % 32}")
        lane = lane.bitwiseAND(low) if k < 32 else F.shiftrightunsigned(lane, 32)
        return F.when(2 * lane > F.col("w"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    voted = words.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)
    return voted.select(*keys, *[reduce(Column.bitwiseOR, [bit(i, k) for k in range(64)]).alias(f"fp{i}") for i in range(HASHES)])


def as_hex(prefix: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"{prefix}{i}"), 16, "0") for i in range(HASHES)]))


def likeness(a: str, b: str) -> Column:
    """1 less the share of bits that differ."""
    off = reduce(Column.__add__, [F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(HASHES)])
    return F.lit(1.0) - off.cast("double") / F.lit(64.0 * HASHES)


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int | None = None) -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the next document's start,
    and their likenesses. Texts move once: ranges of ids meet whole, each with its successor's first row as a guest."""
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    weights = term_weights(rows)
    total = total_bytes(rows)
    n = max(math.ceil(total / (range_bytes or exchange_bytes(total, low=4 << 20))), 2 * shuffle_partitions(df.sparkSession))
    rows = rows.withColumn("range", ranges(rows, "id", n)[0]).withColumn("guest", F.lit(0))
    heads = rows.groupBy("range").agg(F.min("id").alias("head"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls"))
    heads = heads.withColumn("head", F.when(F.col("nulls") == 0, F.col("head")))
    order = Window.orderBy("range")  # a row for each range
    heads = heads.select("range", F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy())).alias("from"), F.coalesce(F.lead(F.struct("head")).over(order), F.first(F.struct("head")).over(order))["head"].alias("head"))
    heads = F.broadcast(heads.select(F.col("range").alias("to"), "from", "head"))
    guests = rows.join(heads, (F.col("range") == F.col("from")) & F.col("id").eqNullSafe(F.col("head"))).select("id", "text", F.col("to").alias("range"), F.lit(1).alias("guest"))
    order = Window.partitionBy("range").orderBy("guest", F.asc_nulls_first("id"), "text")
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring("next", F.lit(1), half))
    both = (
        rows.unionByName(guests)
        .select("range", "id", "guest", "text", F.row_number().over(order).alias("at"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))
        .select("range", "id", "guest", "at", "text", n_chars.cast("long").alias("n_chars"), edited.alias("edited"))
        .select("range", "id", "guest", "at", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("is_edited", "text"))
    )
    keys = ["range", "at", "id", "guest", "n_chars", "edited_sha256", "is_edited"]
    voted = fingerprint_texts(both, keys, "text", weights)
    pick = lambda i, e, name: F.max(F.when(F.col("is_edited") == e, F.col(f"fp{i}"))).alias(name)
    one = voted.groupBy(*keys[:-1]).agg(*[pick(i, 0, f"a{i}") for i in range(HASHES)], *[pick(i, 1, f"e{i}") for i in range(HASHES)])
    order = Window.partitionBy("range").orderBy("at")
    one = one.select("*", *[F.coalesce(F.lead(f"a{i}").over(order), F.col(f"a{i}")).alias(f"n{i}") for i in range(HASHES)])
    return one.filter("guest = 0").select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_hex("a").alias("fingerprint"), as_hex("e").alias("edited_fingerprint"),
        likeness("a", "e").alias("near_edited"), likeness("a", "n").alias("near_next"),
    )


def hamming_links(prints: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """Pairs of different fingerprints (a < b, hex as of as_hex) at most radius bits apart, with their distance.

    Permuted block tables: the bits are cut into ``blocks`` blocks (radius + 2 by default); fingerprints within the
    radius agree on blocks - radius of them, so one table for each such choice of blocks, keyed by them, finds
    every pair. Copies of a fingerprint are one row of the tables; a pair is kept by the first table that finds it."""
    n_bits = 64 * HASHES
    blocks = blocks or radius + 2
    distinct = prints.select("fingerprint").distinct()
    bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(n_bits // 32)])
    edges = [round(i * n_bits / blocks) for i in range(blocks + 1)]
    part = F.array(*[F.substring("bits", edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)])
    cut = distinct.withColumn("bits", bits).select("fingerprint", part.alias("part"))
    tables = list(combinations(range(blocks), blocks - radius))
    keyed = cut.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.concat_ws("|", *[F.col("part")[b] for b in chosen]).alias("key")) for t, chosen in enumerate(tables)])).alias("k")).select("fingerprint", "k.table", "k.key")
    off = reduce(Column.__add__, [F.bit_count(F.conv(F.substring("a", 1 + 8 * i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", 1 + 8 * i, 8), 16, 10).cast("long"))) for i in range(n_bits // 32)])
    pairs = keyed.withColumnRenamed("fingerprint", "a").join(keyed.withColumnRenamed("fingerprint", "b"), ["table", "key"]).filter("a < b")
    return pairs.select("a", "b", off.alias("distance")).filter(F.col("distance") <= radius).distinct()
