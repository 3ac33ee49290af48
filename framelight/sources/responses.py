"""Fetching over a table of responses: what a bounded, careful client makes of what servers said, without a network.

A crawler's store has one response for each address: status, where it points to, its body. An address is followed from response to response by joins, HOPS
times at most, and every address on the way has to be one that may be fetched (functions.urls.is_public_literal). Only addresses that still point elsewhere
go into the next join, with a few narrow columns; bodies are joined once, to the addresses where a chain ends well, and only those of PAGE_BYTES or
IMAGE_BYTES at most. Each distinct address is fetched once, whatever the number of items that ask for it.

Defined cases: null and blank addresses are not fetched; an address without a response could not be reached; of several responses of one address that of the
least status counts (then the least location, size and body); a chain that comes back to an address ends by its number of hops; empty tables give no rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.functions.lineage import cut, met as merged
from framelight.functions.urls import absolute, is_public_literal

HOPS, PAGE_BYTES, IMAGE_BYTES = 5, 8 << 20, 25 << 20  # fixed values
REDIRECTS = (301, 302, 303, 307, 308)  # fixed values
# What is told of a fetch that fails.
FORBIDDEN, UNREACHED, NOWHERE = "The address may not be fetched.", "The remote page could not be reached.", "The remote server returned an invalid redirect."
TOO_MANY, TOO_LARGE, REFUSED = "The remote page redirected too many times.", "The remote response is larger than the scanner limit.", "The remote server returned an error response."


def with_key(responses: DataFrame) -> DataFrame:
    """The response of each address: url, status, location, declared, size, body and a key that tells it from others of its address."""
    has = lambda c, kind: F.col(c).cast(kind) if c in responses.columns else F.lit(None).cast(kind)
    rows = responses.select(
        F.trim("url").alias("url"), F.coalesce(F.col("status").cast("int"), F.lit(0)).alias("status"), F.nullif(F.trim(has("location", "string")), F.lit("")).alias("location"),
        has("content_length", "string").try_cast("long").alias("declared"), F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("size"), F.col("body").cast("binary").alias("body"),
    )
    return rows.withColumn("key", F.xxhash64("status", "location", "declared", "body"))


def followed(urls: DataFrame, responses: DataFrame, most_bytes: int, hops: int = HOPS) -> DataFrame:
    """url, final_url, hops, status, error, key: where each of urls (url, distinct) leads; error null where its response is to be used."""
    order = F.struct("status", "location", "size", "key", "declared")
    narrow = cut(responses.select("url", order.alias("r")).groupBy("url").agg(F.min("r").alias("r")).select(F.col("url").alias("at"), "r.*").withColumn("there", F.lit(True)))
    going = urls.select("url", F.col("url").alias("at"))
    ended = None
    for hop in range(hops + 1):
        met = going.join(merged(narrow), "at", "left")
        points = F.coalesce(F.col("status").isin(*REDIRECTS), F.lit(False))
        onward = absolute("at", "location")
        error = (
            F.when(~is_public_literal(F.col("at")), FORBIDDEN).when(F.col("there").isNull(), UNREACHED).when(points & F.col("location").isNull(), NOWHERE)
            .when(points & F.lit(hop >= hops), TOO_MANY).when(points & ~F.coalesce(is_public_literal(onward), F.lit(False)), FORBIDDEN)
            .when(~points & (F.greatest(F.coalesce("declared", F.lit(0)), F.col("size")) > most_bytes), TOO_LARGE).when(F.col("status") >= 400, REFUSED)
        )
        met = met.withColumns({"error": error, "onward": F.when(points, onward)})
        done = met.filter(F.col("error").isNotNull() | F.col("onward").isNull()).select("url", F.col("at").alias("final_url"), F.lit(hop).alias("hops"), "status", "error", "key")
        ended = done if ended is None else ended.unionByName(done)
        if hop < hops:
            going = cut(met.filter("error IS NULL AND onward IS NOT NULL").select("url", F.col("onward").alias("at")))
            if going.isEmpty():
                break
    return ended


def fetched(urls: DataFrame, responses: DataFrame, most_bytes: int = PAGE_BYTES, hops: int = HOPS) -> DataFrame:
    """urls' distinct addresses (column url) with final_url, hops, status, error and body (null where there is an error).

    responses: url, status, body and, where they are known, location and content_length."""
    store = with_key(responses)
    asked = urls.select(F.trim("url").alias("url")).filter("url <> ''").distinct()
    ended = followed(asked, store, most_bytes, hops)
    bodies = store.select(F.col("url").alias("final_url"), "key", "body").dropDuplicates(["final_url", "key"])
    wanted = ended.withColumn("key", F.when(F.col("error").isNull(), F.col("key")))
    return wanted.join(merged(bodies), ["final_url", "key"], "left").select("url", "final_url", "hops", "status", "error", "body")


def with_fetched(items: DataFrame, responses: DataFrame, url: str = "image_url", most_bytes: int = IMAGE_BYTES, body: str = "content") -> DataFrame:
    """items with error and ``body``: each address fetched once and joined back, so an item's failure stays its own."""
    got = fetched(items.select(F.col(url).alias("url")), responses, most_bytes).select(F.col("url").alias("at_"), "error", F.col("body").alias(body))
    return items.withColumn("at_", F.trim(url)).join(merged(got), "at_", "left").drop("at_")


def decoded(body: Column, encoding: Column | None = None) -> Column:
    """A page's text: UTF-8, or what its server said (ISO-8859-1, UTF-16); bytes that it cannot be are replaced."""
    said = F.upper(F.coalesce(encoding, F.lit("UTF-8"))) if encoding is not None else F.lit("UTF-8")
    text = lambda name: F.decode(body, name)
    latin = F.when(said.isin("ISO-8859-1", "LATIN-1", "LATIN1"), text("ISO-8859-1")).when(said.isin("UTF-16", "UTF-16LE", "UTF-16BE"), text("UTF-16"))
    return F.coalesce(latin, F.make_valid_utf8(body.cast("string")))
