"""Mixing sources to target weights, by temperature.

Each source's share of all tokens is raised to an exponent and normalised. The exponent, from 1 (shares as they are)
to 0 (sources alike), is found by bisection: the one at which the weights' entropy meets ``entropy`` (a part of the greatest, log of the number of sources), or the
lowest at which no source would be repeated more than ``max_epochs`` times, whichever is nearer 1. Each source
then gets its weight of the token budget.

Weights become rows by block permutations: a source's documents are dealt into blocks by a seeded hash; an epoch is
the blocks in a permuted order, each with its documents in a permuted order. A source runs through as many whole
epochs as its budget holds, every one with an order of its own, and through the last until the budget is spent: a document
belongs to it if the tokens before it in the epoch are less than what is left. Blocks bound what is sorted at
once, so a source with a third of all rows is spread like any other.

Defined cases: null is the empty text; a document without words has no tokens and is taken in each epoch that reaches it, that of
a source without tokens once; a null source is a source of its own; rows that repeat are rows of their own; an
empty table gives no rows; input columns named as the result's are replaced.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.llm.common import settle

STEPS = 5  # of bisection answered by one pass over the sources
PASSES = 8


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def temperature(sources: DataFrame, budget: int | None, entropy: float, max_epochs: float) -> tuple[float, int]:
    """The exponent and the budget. sources: source, tokens (over 0). Each pass evaluates all midpoints of STEPS bisections."""
    total = sources.agg(F.sum("tokens").cast("double"), F.count(F.lit(1))).first()
    if not total[1]:
        return 1.0, 0
    p = F.col("tokens") / F.lit(total[0])
    goal = entropy * math.log(total[1])

    def measure(exponents: list[float]) -> list[tuple[float, float, float]]:
        """For each exponent the weights' entropy, the most epochs of any source, and the budget as a part of all tokens."""
        x = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(exponents)])).alias("x")
        powers = sources.select(p.alias("p"), x).withColumn("q", F.pow("p", F.col("x.e")))
        sums = powers.groupBy("x.i").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("s"), F.max(F.col("q") / F.col("p")).alias("r"), F.max(F.col("p") / F.col("q")).alias("b"))
        part = lambda r: r["b"] * r["z"] if budget is None else budget / total[0]
        rows = {r["i"]: (math.log(r["z"]) - r["s"] / r["z"], r["r"] / r["z"] * part(r), part(r)) for r in sums.collect()}  # a row for each exponent
        return [rows[i] for i in range(len(exponents))]

    def meets(h: float, r: float, part: float) -> bool:
        return h <= goal and r <= max(max_epochs, part * (1 + 1e-9))

    low, high = 0.0, 1.0  # meets() holds at high, if anywhere
    if meets(*measure([0.0])[0]):
        high = 0.0
    for _ in range(PASSES if high else 0):
        n = 1 << STEPS
        grid = [low + (high - low) * i / n for i in range(1, n)]
        good = [meets(*m) for m in measure(grid)]
        first = good.index(True) if True in good else n - 1
        low, high = ([low, *grid][first], [*grid, high][first])
    return high, round(measure([high])[0][2] * total[0])


def in_order(blocks: DataFrame) -> DataFrame:
    """blocks with ``before``: the tokens of those before it in the order of rank, of its source and epoch. Prefix sums in two levels,
    so that no task orders more than about root(n) of a source's n blocks."""
    bin_of = F.floor((F.col("rank") / F.lit(2.0**64) + 0.5) * F.ceil(F.sqrt("n_blocks")))
    blocks = blocks.withColumn("bin", bin_of)
    bins = blocks.groupBy("of", "epoch", "bin").agg(F.sum("block_tokens").alias("bin_tokens"))
    earlier = Window.partitionBy("of", "epoch").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("of").alias("bin_source"), "epoch", "bin", F.coalesce(F.sum("bin_tokens").over(earlier), F.lit(0)).alias("bin_before"))
    inner = Window.partitionBy("of", "epoch", "bin").orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("block_tokens").over(inner), F.lit(0)))
    joined = blocks.join(bins, ["epoch", "bin"]).filter(F.col("of").eqNullSafe(F.col("bin_source")))
    return joined.withColumn("before", F.col("bin_before") + F.col("inside"))


def mix_sources(df: DataFrame, budget: int | None = None, entropy: float = 0.97, max_epochs: float = 4.0, seed: int = 0, block_tokens: int = 1 << 20, source: str = "source", text: str = "text") -> DataFrame:
    """df's rows as the mixture takes them (some more than once, some not), with weight double, n_tokens long,
    epoch int (from 0) and place long (tokens of the source's run before the row, over all epochs). budget: by default the
    least at which every source is read through at least once, so that no document is left out."""
    made = ("weight", "n_tokens", "epoch", "place")
    kept = [c for c in df.columns if c.lower() not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = df.select(row.alias("row"), F.col(source).alias("source"), n_tokens(F.col(text)).alias("tokens"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in kept]).alias("key"))
    sources = settle(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    exponent, budget = temperature(sources.filter("tokens > 0"), budget, entropy, max_epochs)
    power = F.when(F.col("tokens") == 0, F.lit(0.0)).otherwise(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent)))
    z = sources.agg(F.coalesce(F.nullif(F.sum(power), F.lit(0.0)), F.lit(1.0))).first()[0]
    plan = sources.select(
        F.col("source").alias("of"), F.col("tokens").alias("source_tokens"), (power / F.lit(z)).alias("weight"),
    ).withColumn("goal", F.round(F.col("weight") * budget).cast("long")).withColumn("n_blocks", F.greatest(F.ceil(F.col("source_tokens") / block_tokens).cast("long"), F.lit(1)))
    # a block's tokens, then each epoch's order of blocks: a row for each block and epoch
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod("key", F.col("n_blocks")))
    blocks = dealt.groupBy("of", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("goal").alias("goal"), F.first("source_tokens").alias("source_tokens"), F.first("n_blocks").alias("n_blocks"))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("goal") / F.greatest("source_tokens", F.lit(1))).cast("long"), F.lit(1)) - 1)).alias("epoch")
    blocks = blocks.select("of", "block", "block_tokens", "goal", "source_tokens", "n_blocks", epochs)
    blocks = in_order(blocks.withColumn("rank", F.xxhash64(F.lit(seed + 1), "block", "epoch")))
    begins = F.col("before") + F.col("epoch") * F.col("source_tokens")
    blocks = blocks.select("of", "block", "epoch", "goal", begins.alias("begins")).filter("begins <= goal")
    blocks = blocks.groupBy("of", "block", "goal").agg(F.collect_list(F.struct("epoch", "begins")).alias("runs"))
    joined = dealt.select("row", "tokens", "key", "of", "block", "weight").join(blocks.withColumnRenamed("of", "of_").withColumnRenamed("block", "block_"), F.col("of").eqNullSafe(F.col("of_")) & (F.col("block") == F.col("block_")))
    each = joined.select("row", "tokens", "key", "of", "block", "weight", "goal", F.explode("runs").alias("run"))
    inner = Window.partitionBy("of", "block", "run.epoch").orderBy(F.xxhash64(F.lit(seed + 2), "key", "run.epoch"), "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("at", F.col("run.begins") + F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    return placed.filter("at < goal OR at = goal AND tokens = 0").select("row.*", "weight", F.col("tokens").alias("n_tokens"), F.col("run.epoch").cast("int").alias("epoch"), F.col("at").alias("place"))
