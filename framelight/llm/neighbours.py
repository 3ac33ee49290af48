"""Approximate nearest neighbours by learned partitions.

Fit, in two levels that are the same at every size: the table is cut into about root(n) leaves, root(root(n)) parts of as many
leaves each, 4 to MAX_PARTS. A part's neighbour graph, of a bounded sample of its rows (``sample_rows`` of the
whole table for the upper level, as many of each part for the lower one, those of least hash), is cut into balanced pieces that
sever few edges, and a small network learns to tell, from a vector, the pieces of its neighbours. How many leaves a query needs
is measured on a fifth of the sample that the networks have not seen: the least that finds ``target`` of its neighbours.

Index: every row goes to its likeliest leaf. Search: a query goes to its likeliest leaves by the product of both levels'
probabilities (to more, where these hold fewer than k rows), each searched in blocks of bounded size, so that copies of one vector, however many, are spread; blocks'
nearest rows are ranked by exact Euclidean distance in double precision on the original vectors. Leaves and probes
grow with the root of the table, so a query reads about root(n) rows for each probe, up to MAX_PARTS**2 leaves (4 billion rows).

Defined cases: vectors that are null, empty, zero, of another length than most (distances to them have no meaning), or that hold null or
non-finite components take no part; a query leaves out its own row only, rows that share its id or vector are
candidates; ties go to the smaller id; with fewer candidates than asked all are returned; a query id that repeats has its ranks for each of
its rows; an empty table gives no rows; further columns are not read.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.llm.common import settle

MAX_PARTS = 256  # of a level: at most as many networks of some 100 KB in the driver and in each task
FOUND = "query_row long, query_id long, vec_id long, score double"


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = F.col("v")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def vectors(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def nearest_rows(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Row numbers in y of the k nearest to each row of x; own: x is y, and no row is its own neighbour."""
    k = min(k, len(y) - own)
    out, norm = np.empty((len(x), k), np.int32), (y * y).sum(1)
    for low in range(0, len(x), 512):
        d = norm - 2 * x[low : low + 512] @ y.T
        if own:
            d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
        if k:
            near = np.argpartition(d, k - 1, 1)[:, :k]
            out[low : low + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Bisections at the median of the widest direction, then rows move to where most of their neighbours are while there is room."""
    part, groups = np.zeros(len(x), int), [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        rows = groups.pop()
        c = x[rows] - x[rows].mean(0)
        along = c @ np.linalg.svd(c[:: max(1, len(c) // 500)], full_matrices=False)[2][0]
        order = np.argsort(along, kind="stable")
        groups += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    for i, rows in enumerate(groups):
        part[rows] = i
    room = slack * len(x) / parts
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.float32)
        for j in range(graph.shape[1]):
            np.add.at(votes, (np.arange(len(x)), part[graph[:, j]]), 1.0)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] + 1 <= room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer, trained by Adam on the shares of a vector's neighbours in each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int, epochs: int = 40, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        z = self.normal(x)
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, p)), np.zeros(p)]
        self.w = [w.astype(np.float32) for w in self.w]
        m, s, t = [w * 0 for w in self.w], [w * 0 for w in self.w], 0
        batch = min(256, max(16, len(z) // 16))
        for epoch in range(epochs):
            rate = 3e-3 * 0.5 ** (epoch // 10)
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
                a = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                e = np.exp(self.log_softmax(a @ self.w[2] + self.w[3])) - target[rows]
                e /= len(rows)
                back = (e @ self.w[2].T) * (a > 0)
                t += 1
                for i, g in enumerate((z[rows].T @ back, back.sum(0), a.T @ e, e.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    self.w[i] = (self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def normal(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float32)

    @staticmethod
    def log_softmax(y: np.ndarray) -> np.ndarray:
        y = y - y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of each part, the logarithm of its probability."""
        return self.log_softmax(np.maximum(self.normal(x) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def learn(x: np.ndarray, parts: int, k: int, hidden: int) -> Router | None:
    """The network of one level, for different vectors x; None where there is only one part."""
    parts = min(parts, len(x) // 8)
    if parts < 2:
        return None
    graph = nearest_rows(x, x, k, own=True)
    part = balanced_parts(x, graph, parts)
    share = np.zeros((len(x), parts), np.float32)
    share[np.arange(len(x)), part] += 1
    for j in range(graph.shape[1]):
        np.add.at(share, (np.arange(len(x)), part[graph[:, j]]), 1.0)
    return Router(x, share / share.sum(1, keepdims=True), hidden)


class Leaves:
    """Both levels: the upper network, each part's lower one, and the leaves' numbers."""

    def __init__(self, top: Router | None, below: dict[int, Router | None]):
        self.top = top
        self.below = [below.get(i) for i in range(len(top.w[3]) if top else 1)]
        self.first = np.concatenate([[0], np.cumsum([len(r.w[3]) if r else 1 for r in self.below])])

    @property
    def n(self) -> int:
        return int(self.first[-1])

    @staticmethod
    def odds(router: Router | None, x: np.ndarray) -> np.ndarray:
        return router.log_odds(x) if router else np.zeros((len(x), 1), np.float32)

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.odds(self.top, x).argmax(1)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        part, out = self.part(x), np.zeros(len(x), np.int64)
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            out[rows] = self.first[p] + self.odds(self.below[p], x[rows]).argmax(1)
        return out

    def order(self, x: np.ndarray, parts: int) -> np.ndarray:
        """Leaves of each vector's likeliest parts, likeliest first; those of other parts come last."""
        top = self.odds(self.top, x)
        wanted = np.argsort(np.argsort(-top, 1, kind="stable"), 1) < parts
        joint = np.full((len(x), self.n), -np.inf, np.float32)
        for p in np.flatnonzero(wanted.any(0)):
            rows = np.flatnonzero(wanted[:, p])
            joint[rows, self.first[p] : self.first[p + 1]] = top[rows, p][:, None] + self.odds(self.below[p], x[rows])
        return np.argsort(-joint, 1, kind="stable")

    def route(self, x: np.ndarray, probes: int, held: np.ndarray, k: int) -> list[np.ndarray]:
        """The leaves that each vector is looked for in: ``probes`` of them, or as many as hold more than k rows."""
        out = []
        for low in range(0, len(x), 128):
            part = x[low : low + 128]
            order = self.order(part, probes)
            for i, leaves in enumerate(order):
                if held[leaves[:probes]].sum() <= k:
                    leaves = self.order(part[i : i + 1], len(self.below))[0]
                enough = int(np.searchsorted(np.cumsum(held[leaves]), k, "right")) + 1
                out.append(leaves[: max(probes, enough)].astype(np.int32))
        return out


def probes_for(leaves: Leaves, x: np.ndarray, held_out: np.ndarray, k: int, target: float) -> int:
    """How many leaves find ``target`` of the held-out vectors' k nearest of x."""
    near = leaves.leaf(x)[nearest_rows(held_out, x, k, own=False)]
    found = np.zeros(leaves.n, np.int64)
    for low in range(0, len(held_out), 128):
        place = np.argsort(leaves.order(held_out[low : low + 128], len(leaves.below)), 1)
        found += np.bincount(np.take_along_axis(place, near[low : low + 128], 1).ravel(), minlength=leaves.n)
    reached = np.cumsum(found) / max(found.sum(), 1)
    return min(leaves.n, int(np.searchsorted(reached, target)) + 1)


def fit(rows: DataFrame, n: int, k: int, sample_rows: int, target: float) -> tuple[Leaves, int]:
    """The leaves of a table of n rows (id, v), and how many of them a query is looked for in."""
    parts = int(min(MAX_PARTS, max(4, round(n**0.25))))
    hashed = rows.select("v", F.xxhash64("v").alias("h"))
    sample = hashed.orderBy("h").limit(sample_rows).toArrow()  # sample_rows
    dims = len(sample["v"][0])
    x = np.unique(vectors(sample["v"], dims), axis=0)
    x = x[np.random.default_rng(0).permutation(len(x))]
    held_out, x = np.split(x, [min(1000, len(x) // 5)])
    top = Leaves(learn(x, parts, k, hidden=128), {})

    def place(batches):
        for b in batches:
            part = top.part(vectors(b.column(0), dims)) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], ["v", "h", "part"])

    def below(group: pa.Table) -> pa.Table:
        x = np.unique(vectors(group["v"], dims), axis=0)
        x = x[np.random.default_rng(0).permutation(len(x))]
        router = pickle.dumps(learn(x, parts, k, hidden=32))
        return pa.table({"part": group["part"].slice(0, 1), "router": pa.array([router], pa.binary())})

    placed = hashed.mapInArrow(place, "v array<double>, h long, part int").dropDuplicates(["part", "h"])
    few = placed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("h"))).filter(F.col("at") <= sample_rows)
    routers = few.select("part", "v").groupBy("part").applyInArrow(below, "part int, router binary").collect()  # a row for each part
    leaves = Leaves(top.top, {r["part"]: pickle.loads(bytes(r["router"])) for r in routers})
    return leaves, probes_for(leaves, x, held_out, k, target)


def nearest(
    df: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
    sample_rows: int = 8192, target: float = 0.95, block_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` (on column id) takes, the k nearest found.

    sample_rows bounds what is fitted on; every row is indexed and every query searched."""
    rows = settle(usable(df, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    leaves, probes = fit(rows, n, k, sample_rows, target)
    dims = len(rows.first()["v"])

    def place(batches):
        for b in batches:
            leaf = leaves.leaf(vectors(b.column(2), dims)) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], ["row", "id", "v", "leaf"])

    index = rows.select("row", "id", "v").mapInArrow(place, "row long, id long, v array<double>, leaf int")
    held = np.zeros(leaves.n, np.int64)
    for r in index.groupBy("leaf").count().collect():  # MAX_PARTS**2 rows at most
        held[r["leaf"]] = r["count"]

    def route(batches):
        for b in batches:
            to = leaves.route(vectors(b.column(2), dims), probes, held, k) if len(b) else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.list_(pa.int32()))], ["row", "id", "v", "leaves"])

    routed = rows.filter(queries).select("row", "id", "v").mapInArrow(route, "row long, id long, v array<double>, leaves array<int>")
    routed = routed.select("row", "id", "v", F.explode("leaves").alias("leaf"))
    sizes = df.sparkSession.createDataFrame(pa.table({"leaf": np.arange(leaves.n, dtype=np.int32), "blocks": np.maximum(1, -(-held // block_rows)).astype(np.int32)}))
    turns = F.ceil(F.coalesce("count", F.lit(0)) / block_rows).cast("int").alias("turns")
    sizes = F.broadcast(sizes.join(routed.groupBy("leaf").count(), "leaf").select("leaf", "blocks", turns))  # MAX_PARTS**2 rows at most
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    own = lambda of: F.pmod(F.xxhash64(F.lit(9), "row"), F.col(of)).cast("int")
    index = index.join(sizes, "leaf").select("leaf", own("blocks").alias("block"), each("turns").alias("turn"), "row", "id", "v")
    routed = routed.join(sizes, "leaf").select("leaf", each("blocks").alias("block"), own("turns").alias("turn"), "row", "id", "v")

    def search(block: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if block.num_rows and queries.num_rows:
            at, ids, c = block["row"].to_numpy(), block["id"].to_numpy(), vectors(block["v"], dims)
            for row, q, v in zip(queries["row"].to_numpy(), queries["id"].to_numpy(), vectors(queries["v"], dims), strict=True):
                d = np.sqrt(np.square(c - v).sum(1))
                d[at == row] = np.inf
                least = min(k, len(d)) - 1
                near = np.flatnonzero(d <= np.partition(d, least)[least])
                near = near[np.lexsort((ids[near], d[near]))][:k]
                near = near[d[near] < np.inf]
                for to, y in zip(out, (np.full(len(near), row), np.full(len(near), q), ids[near], d[near]), strict=True):
                    to.append(y)
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))

    keys = ["leaf", "block", "turn"]
    found = index.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(search, FOUND)
    best = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
