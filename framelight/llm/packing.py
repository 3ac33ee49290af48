"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces of at most that. Pieces are dealt at random into
groups that one task can hold, and each group is packed by itself, longest pieces first: a piece goes to the open
bin that it leaves least room in; if none has room, a bin is opened. Which length to open is decided for all lengths
jointly: ``plan`` computes, for what is left to pack, the cost of opening each permitted length and filling it by
best fit, and takes the least cost a token packed, where a bin of length c costs c + overhead (a sequence's fixed cost). Finally each bin is
downsized to the least permitted length that holds its contents.

Defined cases: null is the empty text; documents without tokens are one piece of no tokens, which fits anywhere;
equal lengths go by key, so repeated rows are packed as rows of their own; an empty table gives no rows; input columns named as the
result's are replaced.
"""

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.llm.mixing import n_tokens

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16


class Left:
    """Counts of lengths still to be packed."""

    def __init__(self, sizes: np.ndarray):
        values, counts = np.unique(sizes, return_counts=True)
        self.lengths, self.count = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.lengths[bisect_left(self.lengths, size)]

    def fill(self, room: int) -> int:
        """How much of room the longest pieces that fit would take, one after the other."""
        used, taken = 0, {}
        high = len(self.lengths)
        while room and high:
            high = bisect_left(self.lengths, room + 1, 0, high)
            if not high:
                break
            size = self.lengths[high - 1]
            n = min(room // size, self.count[size] - taken.get(size, 0)) if size else 0
            if not n:
                high -= 1
                continue
            used += n * size
            room -= n * size
            high -= 1
        return used


def plan(left: Left, size: int, lengths: tuple[int, ...], overhead: int) -> int:
    """The permitted length to open for a piece of this size: the least cost for each token it would hold."""
    best = None
    for c in lengths:
        if c >= size:
            held = size + left.fill(c - size)
            down = next(x for x in lengths if x >= held)
            cost = (down + overhead) / max(held, 1)
            if best is None or cost < best[0] - 1e-12:
                best = cost, c
    return best[1]


def pack_group(sizes: np.ndarray, lengths: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in descending order of size: bin, start in it, and each bin's final length."""
    left, bins, starts = Left(sizes), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    limit: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        left.take(size)
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = plan(left, size, lengths, overhead), len(used)
            used.append(0)
            limit.append(room)
        bins[i], starts[i] = b, used[b]
        used[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    final = np.array([next(x for x in lengths if x >= u) for u in used], np.int64)
    return bins, starts, final


LEAST_GROUPS = 64  # of a table of 500 pieces for each, or more: what can be packed at a time


def pack(df: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group_pieces: int = 20_000, seed: int = 0, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row for each piece: the columns in ``keep``, piece int (of its document), piece_start and piece_tokens
    long (which of the document's tokens), bin string, bin_start long (tokens before it in the bin), bin_length int."""
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    made = ("piece", "piece_start", "piece_tokens", "bin", "bin_start", "bin_length")
    row = F.struct(*[F.col(f"`{c}`") for c in keep if c.lower() not in made])
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(row.alias("row"), key.alias("key_"), n_tokens(F.col(text)).alias("tokens_"))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens_") / most), F.lit(1)) - 1))
    pieces = rows.select("row", "key_", "tokens_", number.alias("piece_")).withColumn("size_", F.least(F.lit(most), F.col("tokens_") - F.col("piece_") * most))
    n = rows.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("tokens_") / most), F.lit(1))), F.lit(0))).first()[0]
    n_groups = max(1, math.ceil(n / group_pieces), min(LEAST_GROUPS, math.ceil(n / 500)))
    dealt = pieces.withColumn("group_", F.pmod(F.xxhash64("key_", "piece_"), F.lit(n_groups)).cast("int"))
    out = T.StructType([dealt.schema["row"],
        T.StructField("piece", T.IntegerType()), T.StructField("piece_start", T.LongType()), T.StructField("piece_tokens", T.LongType()),
        T.StructField("bin", T.StringType()), T.StructField("bin_start", T.LongType()), T.StructField("bin_length", T.IntegerType()),
    ])

    def best_fit(group: pa.Table) -> pa.Table:
        number = group["group_"][0].as_py()
        order = np.lexsort((group["piece_"].to_numpy(), group["key_"].to_numpy(), -group["size_"].to_numpy()))
        group = group.take(pa.array(order))
        bins, starts, final = pack_group(group["size_"].to_numpy(), lengths, overhead)
        columns = [
            group["row"], group["piece_"].cast(pa.int32()), pa.array(group["piece_"].to_numpy() * most), group["size_"].cast(pa.int64()),
            pa.array([f"{number}-{b}" for b in bins.tolist()]), pa.array(starts), pa.array(final[bins].astype(np.int32)),
        ]
        return pa.table(columns, names=out.names)

    return dealt.groupBy("group_").applyInArrow(best_fit, out).select("row.*", *made)
