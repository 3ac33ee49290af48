"""Hard negatives by dual-tree search: trees over anchors and candidates, intervals of inner products prune pairs of nodes.

A row's score is its integer inner product with the anchor. An anchor's positives are the first rows of its own label; of each positive, the
negatives are the first rows of other labels whose score lies between two percentages of the positive's.

Two levels of trees. The upper one cuts the table into 4 to MAX_CELLS cells by medians of a bounded sample (``sample_rows``); every row is dealt to
its cell, and a cell's ball (centre, largest distance, largest norm) covers all its rows. Pairs of an anchors' cell and a candidates' cell come in
rounds, the most promising first (1, 7, 56, then all others of each anchors' cell); what a round finds is the threshold of the next, and a pair whose
interval cannot reach an anchor's threshold or window is not sent. The lower trees stand in one task: a block of candidates (a hashed share of a cell,
so that copies of one vector are spread) and a chunk of anchors, cut by label and then by the widest component. Node pairs go down level by level;
pairs whose interval (of balls and of boxes) misses all thresholds and windows of an anchors' node end there, for all its anchors at once; pairs of
leaves are scored exactly. Nothing is approximated: where intervals prune nothing, every pair is scored.

Defined cases: rows without an id, a label or a vector, with null or non-finite components, of another length than most (ties: the longer), without components, or with
scaled components too large for their products to fit in 64 bits take no part; labels are integers; a row that comes more than once counts each time, an anchor leaves out
itself only; ties go to the smaller id; an anchor without positives, and a positive without negatives, give no rows; an empty table gives none;
further columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.llm.common import settle

MAX_CELLS = 256
ROUNDS = (0, 1, 8, 64, MAX_CELLS)  # ranks of candidates' cells
LEAF, ANCHOR_LEAF = 256, 64
LEAST, MOST = -(1 << 62), 1 << 62
FOUND = "anchor long, slot int, score long, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def usable(df: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> tuple[DataFrame, int, int]:
    """id, label, v (scaled, array<int>) of the rows that take part, their number and length."""
    x = F.col(embedding).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"), x.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("x") > 0))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = common["d"] if common else 1
    limit = min(2**31 - 1, math.isqrt((1 << 61) // 100 // width))
    rows = rows.filter((F.size("x") == width) & F.forall("x", lambda c: F.abs(c) * scale < limit))
    return rows.select("id", "label", F.col("v").cast("array<int>").alias("v")), common["count"] if common else 0, width


class Cells:
    """The upper tree: a full binary tree of median cuts, and its cells' centres."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        self.centre = np.zeros((1 << depth, sample.shape[1]))
        held = {0: sample}
        for node in range((1 << depth) - 1):
            x = held.pop(node)
            if len(x):
                self.axis[node] = int(np.argmax(x.max(0) - x.min(0)))
                self.cut[node] = np.median(x[:, self.axis[node]])
            right = x[:, self.axis[node]] > self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
        for i, x in held.items():
            self.centre[i - (1 << depth) + 1] = x.mean(0) if len(x) else sample.mean(0)

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth) + 1


class Tree:
    """Rows cut by label, then by the widest component, at the middle, down to leaves; node 0 is the root."""

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        spans, self.children = [(0, len(x))], []
        lo, hi, centre, radius = [], [], [], []
        for start, end in spans:  # grows meanwhile
            rows = self.order[start:end]
            v = x[rows]
            lo.append(v.min(0))
            hi.append(v.max(0))
            centre.append(v.mean(0))
            radius.append(math.sqrt(np.square(v - centre[-1]).sum(1).max()))
            if end - start <= leaf:
                self.children.append(None)
                continue
            key = label[rows]
            if key.min() == key.max():
                key = v[:, np.argmax(hi[-1] - lo[-1])]
                middle = len(rows) // 2
                by = np.argsort(key, kind="stable")
            else:
                by = np.argsort(key, kind="stable")
                edges = np.flatnonzero(np.diff(key[by])) + 1
                middle = int(edges[np.argmin(np.abs(edges - len(rows) // 2))])
            self.order[start:end] = rows[by]
            self.children.append((len(spans), len(spans) + 1))
            spans += [(start, start + middle), (start + middle, end)]
        self.spans, self.lo, self.hi, self.centre, self.radius = spans, np.array(lo), np.array(hi), np.array(centre), np.array(radius)
        self.norm = np.sqrt(np.square(self.centre).sum(1))
        held = label[self.order]
        self.labels = np.array([(held[s:e].min(), held[s:e].max()) for s, e in spans])

    def smallest(self, of_rows: np.ndarray) -> np.ndarray:
        return np.array([of_rows[s:e].min() for s, e in self.spans])


def intervals(a: Tree, c: Tree, ai: np.ndarray, ci: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of a row under node ai and one under node ci: what their balls and their boxes both allow."""
    lo, hi = np.empty(len(ai)), np.empty(len(ai))
    for s in range(0, len(ai), 4096):
        i, j = ai[s : s + 4096], ci[s : s + 4096]
        middle = (a.centre[i] * c.centre[j]).sum(1)
        wide = a.radius[i] * c.norm[j] + c.radius[j] * a.norm[i] + a.radius[i] * c.radius[j]
        ends = [x[i] * y[j] for x in (a.lo, a.hi) for y in (c.lo, c.hi)]
        least, most = ends[0], ends[0]
        for e in ends[1:]:
            least, most = np.minimum(least, e), np.maximum(most, e)
        slack = 1.0 + 1e-9 * (np.abs(middle) + wide)  # for rounding; scores are whole numbers
        lo[s : s + 4096] = np.maximum(middle - wide, least.sum(1)) - slack
        hi[s : s + 4096] = np.minimum(middle + wide, most.sum(1)) + slack
    return lo, hi


def merge(score: np.ndarray, ids: np.ndarray, slot: np.ndarray, new: np.ndarray, new_ids: np.ndarray) -> None:
    """Puts new entries of slots among each slot's first k, in place."""
    k = score.shape[1]
    touched = np.unique(slot)
    slots = np.concatenate([np.repeat(touched, k), slot])
    scores, every = np.concatenate([score[touched].ravel(), new]), np.concatenate([ids[touched].ravel(), new_ids])
    order = np.lexsort((every, -scores, slots))
    take = order[np.searchsorted(slots[order], touched)[:, None] + np.arange(k)]
    score[touched], ids[touched] = scores[take], every[take]


def dual_search(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, (anchors, slots, k), of each slot's first k rows (LEAST: none) of the anchor's label, or of others, within the slot's lowest and highest score.

    anchors: row, label, v, least and most (anchors, slots), need (scores under it are of no use); rows: row, id, label, v."""
    exact = max(np.abs(anchors["v"]).max(), np.abs(rows["v"]).max()) ** 2 * rows["v"].shape[1] < 2**53
    kind = np.float64 if exact else np.int64  # both exact, the first much faster
    a, c = Tree(anchors["v"].astype(np.float64), anchors["label"], ANCHOR_LEAF), Tree(rows["v"].astype(np.float64), rows["label"], LEAF)
    anchor = {n: x[a.order] for n, x in anchors.items()}
    row = {n: x[c.order] for n, x in rows.items()}
    av, cv = anchor["v"].astype(kind), row["v"].astype(kind)
    slots = anchor["least"].shape[1]
    score, ids = np.full((len(av) * slots, k), LEAST), np.full((len(av) * slots, k), MOST)
    need, most = np.maximum(anchor["need"], anchor["least"]), anchor["most"]
    usable_need = np.where(anchor["least"] > most, MOST, need)
    node_need, node_most = a.smallest(usable_need.min(1)), -a.smallest(-most.max(1))

    ai, ci, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(ai):  # level by level
        la, lc = a.labels[ai], c.labels[ci]
        if same:
            can = (la[:, 0] <= lc[:, 1]) & (lc[:, 0] <= la[:, 1])
        else:
            can = ~((la[:, 0] == la[:, 1]) & (lc[:, 0] == lc[:, 1]) & (la[:, 0] == lc[:, 0]))
        ai, ci = ai[can], ci[can]
        lo, hi = intervals(a, c, ai, ci)
        can = (hi >= node_need[ai]) & (lo <= node_most[ai])
        down = []
        for i, j, h in zip(ai[can], ci[can], hi[can], strict=True):
            left, right = a.children[i], c.children[j]
            if left is None and right is None:
                found.append((i, j, h))
            else:
                down += [(x, y) for x in left or (i,) for y in right or (j,)]
        ai, ci = np.array(down, np.int64).reshape(-1, 2).T

    found.sort(key=lambda f: (f[0], -f[2]))
    for i, j, h in found:
        s, e = a.spans[i]
        if h < usable_need[s:e].min():
            continue
        t, u = c.spans[j]
        got = av[s:e] @ cv[t:u].T
        fits = (anchor["label"][s:e, None] == row["label"][None, t:u]) == same
        if same:
            fits &= anchor["row"][s:e, None] != row["row"][None, t:u]
        inside = fits[:, None] & (got[:, None] >= usable_need[s:e, :, None]) & (got[:, None] <= most[s:e, :, None])
        at, slot, col = np.nonzero(inside)
        if len(at):
            merge(score, ids, (s + at) * slots + slot, got[at, col].astype(np.int64), row["id"][t + col])
            last = score[s * slots : e * slots, -1].reshape(-1, slots)
            usable_need[s:e] = np.maximum(usable_need[s:e], last)
    back = np.argsort(a.order)
    return score.reshape(-1, slots, k)[back], ids.reshape(-1, slots, k)[back]


class Index:
    """All rows in cells, settled; anchors among them; and, of each pair of an anchors' cell and a cell, the interval of its scores."""

    def __init__(self, df: DataFrame, anchors: Column, sample_rows: int, scale: int, vec_id: str, embedding: str, label: str):
        rows, n, self.width = usable(df, vec_id, embedding, label, scale)
        self.empty = not n
        if self.empty:
            return
        width = self.width
        depth = int(np.clip(round(math.log2(max(1.0, math.sqrt(n) / 8))), 2, int(math.log2(MAX_CELLS))))
        self.block_rows = int(np.clip(4 * math.sqrt(n), 512, max(512, (64 << 20) // (8 * width))))
        few = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(sample_rows).toArrow()  # sample_rows
        sample = np.unique(matrix(few["v"], width), axis=0).astype(np.float64) if few.num_rows else np.zeros((1, width))
        cells = Cells(sample, depth)

        def place(batches):
            for b in batches:
                x = matrix(b.column(2), width).astype(np.float64) if len(b) else np.zeros((0, width))
                cell = cells.of(x) if len(b) else np.zeros(0, np.int64)
                far, norm = np.sqrt(np.square(x - cells.centre[cell]).sum(1)), np.sqrt(np.square(x).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(norm)], ["id", "label", "v", "is_anchor", "cell", "far", "norm"])

        marked = rows.select("id", "label", "v", F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
        placed = marked.mapInArrow(place, "id long, label long, v array<int>, is_anchor boolean, cell int, far double, norm double")
        self.rows = settle(placed.withColumn("row", F.monotonically_increasing_id()))
        stats = {anchors: {} for anchors in (False, True)}
        size = self.rows.groupBy("cell", "is_anchor").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"))
        for r in size.collect():  # 2 * MAX_CELLS rows at most
            for who in {False, r["is_anchor"]}:
                old = stats[who].get(r["cell"], (0, 0.0, 0.0))
                stats[who][r["cell"]] = old[0] + r["n"], max(old[1], r["far"]), max(old[2], r["norm"])
        self.held = {c: s[0] for c, s in stats[False].items()}
        self.asking = {c: s[0] for c, s in stats[True].items()}
        self.pairs = []  # (cell, other, lo, hi, rank): MAX_CELLS**2 at most
        for cell, (_, far, norm) in stats[True].items():
            of = []
            for other, (_, wide, long) in stats[False].items():
                x, y = cells.centre[cell], cells.centre[other]
                spread = far * np.linalg.norm(y) + wide * np.linalg.norm(x) + far * wide
                slack = 1.0 + 1e-9 * (abs(x @ y) + spread)
                of.append((max(x @ y - spread, -norm * long) - slack, min(x @ y + spread, norm * long) + slack, other))
            of.sort(key=lambda p: (-p[1], p[2]))
            self.pairs += [(cell, other, float(lo), float(hi), rank) for rank, (lo, hi, other) in enumerate(of)]

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor, slot, rank, score, id: of each anchor's slots the first k rows. anchors: columns of rows, and arrays least and most, one entry for each slot."""
        spark, width, block_rows = anchors.sparkSession, self.width, self.block_rows
        best = spark.createDataFrame([], FOUND + ", rank int")
        for begin, end in zip(ROUNDS, ROUNDS[1:], strict=False):
            pairs = [p for p in self.pairs if begin <= p[4] < end]
            if not pairs:
                break
            asked: dict[int, int] = {}
            for cell, other, *_ in pairs:
                asked[other] = asked.get(other, 0) + self.asking[cell]
            sizes = [(other, -(-self.held[other] // block_rows), -(-n // block_rows)) for other, n in asked.items()]
            sizes = F.broadcast(spark.createDataFrame(sizes, "cell int, blocks int, turns int"))
            routes = F.broadcast(spark.createDataFrame([p[:4] for p in pairs], "cell int, other int, lo double, hi double"))
            full = best.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("full"))  # an anchor's slots
            known = anchors.join(full, anchors["row"] == full["anchor"], "left").drop("anchor")
            need = F.transform("least", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at("full", i), F.lit(LEAST))))
            known = known.withColumn("need", need).withColumn("open", F.exists(F.arrays_zip("least", "most"), lambda w: w["least"] <= w["most"])).filter("open").drop("full", "open")
            reach = (F.col("hi") >= F.array_min("need")) & (F.col("lo") <= F.array_max("most"))
            asks = known.join(routes, "cell").filter(reach).select(F.col("other").alias("cell"), "row", "label", "v", "least", "most", "need")
            each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
            own = lambda of: F.pmod(F.xxhash64(F.lit(5), "row"), F.col(of)).cast("int")
            asks = asks.join(sizes, "cell").select("cell", each("blocks").alias("block"), own("turns").alias("turn"), "row", "label", "v", "least", "most", "need")
            block = self.rows.join(sizes, "cell").select("cell", own("blocks").alias("block"), each("turns").alias("turn"), *[F.col(c).alias(c) for c in ("row", "id", "label", "v")])

            def match(asks: pa.Table, block: pa.Table) -> pa.Table:
                none = np.zeros(0, np.int64)
                if not asks.num_rows or not block.num_rows:
                    return pa.table({"anchor": none, "slot": none.astype(np.int32), "score": none, "id": none})
                slots = len(asks["least"][0])
                a = {"row": asks["row"].to_numpy(), "label": asks["label"].to_numpy(), "v": matrix(asks["v"], width), **{n: matrix(asks[n], slots) for n in ("least", "most", "need")}}
                c = {"row": block["row"].to_numpy(), "id": block["id"].to_numpy(), "label": block["label"].to_numpy(), "v": matrix(block["v"], width)}
                score, ids = dual_search(a, c, k, same)
                at, slot, col = np.nonzero(score > LEAST)
                return pa.table({"anchor": a["row"][at], "slot": slot.astype(np.int32), "score": score[at, slot, col], "id": ids[at, slot, col]})

            keys = ["cell", "block", "turn"]
            found = asks.groupBy(*keys).cogroup(block.groupBy(*keys)).applyInArrow(match, FOUND)
            first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
            ranked = best.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
            best = settle(ranked)
        return best


def percent(score: Column, of: int, up: bool) -> Column:
    """``of`` hundredths of whole numbers, rounded down or up."""
    x = score * of * (-1 if up else 1)
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100)) * (-1 if up else 1)


def mine(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", sample_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors`` (on column id) takes.

    Components become floor(scale * x). Of each anchor's ``positives`` first rows of its label, the ``negatives`` first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. sample_rows bounds what the upper tree is fitted on."""
    index = Index(df, anchors, sample_rows, scale, vec_id, embedding, label)
    if index.empty or not index.asking:
        return df.sparkSession.createDataFrame([], RESULT)
    asking = index.rows.filter("is_anchor").select("row", "id", "label", "v", "cell")
    one = lambda value: F.array(F.lit(value).cast("long"))
    first = index.search(asking.drop("id").withColumns({"least": one(LEAST + 1), "most": one(MOST - 1)}), positives, same=True)
    first = first.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    slots = [F.lit(i) for i in range(positives)]
    scores = first.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "positive_score"))).alias("scores"))  # ``positives`` of an anchor
    bound = lambda of, up, none: F.array(*[F.coalesce(percent(F.try_element_at("scores", i), of, up), F.lit(none).cast("long")) for i in slots])
    windows = asking.join(scores, asking["row"] == scores["anchor"]).withColumns({"least": bound(low, True, MOST - 1), "most": bound(high, False, LEAST + 1)})
    windows = settle(windows.select("row", "label", "v", "cell", "least", "most"))
    hard = index.search(windows, negatives, same=False).select("anchor", "slot", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    names = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return hard.join(first, ["anchor", "slot"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
