"""Near-duplicate classes by improved consistent weighted sampling (ICWS).

Nodes are different texts. A text's shingles are its runs of five words (all its words, if it has fewer), weighted by
TF-IDF: occurrences times idf = 1 + ln((documents + 1) / (documents that hold it + 1)). As the copies of a large group make
their own shingles common, so that the few that an edit brings weigh most, two texts are also alike if their similarity without
idf is the threshold or more; each text therefore has a second set of samples, drawn without idf. Document frequencies of all
documents are summed in a table of CELLS hashed cells; a cell holds shingles_per_document / CELLS of all documents by chance, at every
corpus size, so that the rarest shingles weigh about eight times as much as those of all documents.

SAMPLES samples of a set, in which two texts agree with the probability of their weighted Jaccard similarity, are cut into
BANDS bands; texts that agree in a band are candidates (at similarity 0.8 all but 0.2 % are, at 0.9 all but one in a million).
Candidates are verified by their exact Jaccard similarity, the greater of those with and without idf:

1. in each bucket (band and value) every text against the bucket's least one; the links' components are found;
2. in buckets that still hold several components, up to TURNS times, the texts outside the largest against a few texts of
   it, others each time, as long as that finds links enough: work in proportion to the texts left over;
3. what is still apart then, block by block: the texts outside a bucket's largest component against all texts of other
   components. So each pair of candidates is either in one component or has been compared.

Groups of comparisons are salted: a text that thousands are compared with is sent to as many tasks as they need.

Links are the pairs of different texts that were found to be alike, each with its similarity; they join all texts of a class. Texts that are in one
component already are not compared again, so that a class of n texts has n - 1 links or more, not all its pairs.

Defined cases: null is the empty text; texts without words are alike only if equal; equal texts are one node, so they share
a class; a class's id is its least doc_id (null ids last); ids may repeat and be null, so classes of different texts may have the same id
and only their labels tell them apart; an empty table gives no rows.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.llm.common import settle
from framelight.llm.hash_blocks import pack, unpack
from framelight.llm.words import flat, mix, scan, slices, windows

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
SETS = 2 * BANDS  # of samples with idf, and without
CELLS = 1 << 18
PARTS = 64  # of the table of document frequencies
LANES = 256  # in which tasks' tables are added up first
LOW = np.uint64((1 << 52) - 1)
TURNS, PIVOTS = 6, 4
WORTH = 0.05  # links for each comparison, below which no further turn is made
GROUP = 200  # texts compared with one text in one task
LINKS = "a binary, b binary, similarity double"


def gamma2_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Of the gamma distribution of shape 2, at the middles of n equal shares."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        above = 1 - (1 + x) * np.exp(-x) > p
        low, high = np.where(above, low, x), np.where(above, x, high)
    return low


R = gamma2_quantiles().astype(np.float32)
BY_R = (1 / R).astype(np.float32)
EXPONENTIAL = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
SEEDS = np.random.default_rng(17).integers(1, 2**63, (SAMPLES, 2), np.uint64) | np.uint64(1)


def shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: first text, number of texts; of each text's different shingles the text, 52 bits of hash, occurrences."""
    for low, high in slices(texts):
        for low in range(low, high, 4096):  # noqa: B020, PLW2901
            n = min(4096, high - low)
            words = scan(texts.slice(low, n))
            h = words.hashes()
            found, whole = windows(h, words.doc, WORDS)
            counts = np.diff(words.first)
            short = np.flatnonzero((counts > 0) & (counts < WORDS))
            rest = np.array([mix(np.array([hash_all(h[words.first[i] : words.first[i + 1]])], np.uint64))[0] for i in short], np.uint64)
            doc = np.concatenate([words.doc[: len(found)][whole], short]).astype(np.uint64)
            key, n_times = np.unique((doc << np.uint64(52)) | (np.concatenate([found[whole], rest]) & LOW), return_counts=True)
            yield low, n, (key >> np.uint64(52)).astype(np.int64), key & LOW, n_times


def hash_all(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = (out * 0x9E3779B97F4A7C15 + x) & ((1 << 64) - 1)
    return out


def cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(34)).astype(np.int64)


def idf_table(df: DataFrame, text: str = "text") -> np.ndarray:
    """idf of each cell, 1 or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(CELLS, np.int64), 0
        for b in batches:
            docs += len(b)
            for _, _, _, h, _ in shingles(flat(b.column(0))):
                total += np.bincount(cells(h), minlength=CELLS)
        parts, lane = total.reshape(PARTS, -1), TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([lane] * PARTS, pa.int32()), pa.array([docs if p == 0 else 0 for p in range(PARTS)], pa.int64()), pa.array([pack(np.ascontiguousarray(x)) for x in parts], pa.binary())], ["part", "lane", "docs", "counts"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(unpack(x.as_py(), CELLS // PARTS, np.int64) for x in part["counts"])
        return pa.table({"part": part["part"].slice(0, 1), "lane": part["lane"].slice(0, 1), "docs": pa.array([sum(part["docs"].to_pylist())], pa.int64()), "counts": pa.array([pack(total)], pa.binary())})

    schema = "part int, lane int, docs long, counts binary"
    lanes = df.select(text).mapInArrow(count, schema).groupBy("part", "lane").applyInArrow(add, schema)  # every task brings a row to each part
    rows = lanes.groupBy("part").applyInArrow(add, schema).collect()  # PARTS rows
    rows = sorted(rows, key=lambda r: r["part"])
    docs = sum(r["docs"] for r in rows)
    total = np.concatenate([unpack(bytes(r["counts"]), CELLS // PARTS, np.int64) for r in rows]) if rows else np.zeros(CELLS, np.int64)
    return (1 + np.log((docs + 1) / (np.minimum(total, docs) + 1))).astype(np.float32)


def signatures(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Band values with and without idf, a row for each text (zeros for a text without words)."""
    out = np.zeros((len(texts), SETS), np.int64)
    for low, n, doc, h, times in shingles(texts):
        if len(h):
            has, with_idf, without = band_values(doc, h, np.log(idf[cells(h)] * times), np.log(times))
            out[low + has] = np.hstack([with_idf, without])
    return out


def band_values(doc: np.ndarray, h: np.ndarray, *log_weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The texts that have shingles, and for each of the weightings their bands' values. Weightings share their random numbers, so
    that texts of equal weights have equal samples."""
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    log_weights = [w.astype(np.float32) for w in log_weights]
    samples = [np.empty((len(head), SAMPLES), np.uint64) for _ in log_weights]
    for j in range(SAMPLES):
        z = (h ^ SEEDS[j, 0]) * SEEDS[j, 1]
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        u = z.view(np.uint16).reshape(-1, 4)
        r, by_r, beta = R[u[:, 0]], BY_R[u[:, 0]], u[:, 1] * np.float32(1 / 65536)
        wait = EXPONENTIAL[u[:, 2]] + EXPONENTIAL[u[:, 3]]
        for log_weight, sample in zip(log_weights, samples, strict=True):
            t = np.floor(log_weight * by_r + beta)
            a = wait * np.exp(r * (beta - t - 1))
            name = (h ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1))) & np.uint64(0xFFFFFFFF)
            sample[:, j] = np.minimum.reduceat((a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | name, head) & np.uint64(0xFFFFFFFF)
    return doc[head], *map(banded, samples, range(len(samples)))


def banded(sample: np.ndarray, weighting: int) -> np.ndarray:
    band = np.full((len(sample), BANDS), weighting, np.uint64)
    for j in range(ROWS):
        band = mix(band * np.uint64(31) + sample[:, j::ROWS] + np.uint64(1 + j))
    return mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def weighted(text: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text its shingles, sorted, their weights and occurrences."""
    out = []
    for _, n, doc, h, times in shingles(text):
        at = np.searchsorted(doc, np.arange(n + 1))
        w = idf[cells(h)] * times
        out += [(h[a:b], w[a:b], times[a:b]) for a, b in zip(at, at[1:], strict=False)]
    return out


def jaccard(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """The greater of the similarities with and without idf."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    least = [np.minimum(a[k][i], b[k][j]).sum(dtype=float) for k in (1, 2)]
    return max(x / (a[k].sum(dtype=float) + b[k].sum(dtype=float) - x) for k, x in zip((1, 2), least, strict=True))


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Of pairs (a, b), no two alike, those of similarity threshold or more, and their similarity. texts: node, text."""
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    wide = size.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("node"), F.lit(True).alias("is_a"))
    many = settle(size.filter("salts > 1"))  # a table of its own, so that Spark can split the join
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")
    needed = pairs.join(many, "a", "left").select("a", salt.alias("salt"), F.col("b").alias("node"), F.lit(False).alias("is_a")).unionByName(wide)

    def compare(group: pa.Table) -> pa.Table:
        is_a = group["is_a"].to_numpy()
        one = int(np.flatnonzero(is_a)[0])
        rest = pa.array(np.flatnonzero(~is_a))
        first = weighted(flat(group["text"].slice(one, 1)), idf)[0]
        like = np.array([jaccard(first, x) for x in weighted(flat(group["text"].take(rest)), idf)])
        b = group["node"].take(rest).filter(pa.array(like >= threshold, pa.bool_()))
        return pa.table({"a": pa.chunked_array([pa.array([group["a"][0].as_py()] * len(b), pa.binary())]), "b": b, "similarity": pa.chunked_array([pa.array(like[like >= threshold], pa.float64())])})

    return needed.join(texts, "node").groupBy("a", "salt").applyInArrow(compare, LINKS)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of links' (a, b) nodes: the least node of each component, by spreading labels and jumping along them."""
    both = settle(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))))
    labels = settle(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        told = both.join(labels, "node").select(F.col("other").alias("node"), "label", F.lit(None).cast("binary").alias("old"))
        spread = labels.select("node", "label", F.col("label").alias("old")).unionByName(told).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = settle(spread.join(jump, "label", "left").select("node", F.least("label", "next").alias("label"), "old"))
        same = new.filter("label <> old").isEmpty()
        labels = new.select("node", "label")
        if same:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: the components of components."""
    of = lambda c: F.coalesce(F.col(f"{c}_label"), F.col(c))
    named = lambda df, c: df.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left")
    ends = settle(named(named(links, "a"), "b").select(of("a").alias("a"), of("b").alias("b")).filter("a <> b").distinct())
    moved = components(ends)
    old = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    return settle(old.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def mixed_buckets(banded: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (band, node, label, top, n, n_minor) of the buckets that hold several components: top is the largest one's label."""
    placed = banded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("band").agg(F.max(F.struct("n", "label")).alias("best"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    largest = settle(largest.filter("parts > 1"))  # a table of its own, so that Spark can split a band's rows in the join
    return placed.join(largest.select("band", F.col("best.label").alias("top"), "n", (F.col("n") - F.col("best.n")).alias("n_minor")), "band")


def pivots(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) that join most of what belongs together: buckets are dealt into parts of about 64 texts, anew each turn, and the texts outside
    the largest component are paired with one of it in their part, PIVOTS pairs at most for each text."""
    rank = F.xxhash64(F.lit(turn), "node")
    rows = mixed.select("band", F.pmod(F.xxhash64(F.lit(-turn), "node"), F.ceil(F.col("n") / 64)).alias("part"), "node", rank.alias("rank"), (F.col("label") == F.col("top")).alias("major"))
    chosen = rows.filter("major").groupBy("band", "part").agg(F.min(F.struct("rank", "node")).alias("pivot")).select("band", "part", F.col("pivot.node").alias("a"))
    pairs = rows.filter("NOT major").join(chosen, ["band", "part"]).select("a", F.col("node").alias("b")).distinct()
    few = pairs.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(turn), "a").alias("rank"), "a"))), 1, PIVOTS).alias("few"))
    return few.select(F.explode("few").alias("pair"), "b").select("pair.a", "b")


def crossed(mixed: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """All links (a, b) between a bucket's components, where a is outside the largest, in blocks of texts against blocks of texts.
    texts: node, text, bands. Texts that agree in several bands are compared in the first."""
    minor_blocks, blocks = F.ceil(F.col("n_minor") / 128).cast("int"), F.ceil(F.col("n") / 256).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    minor = mixed.filter("label <> top").select("band", own(minor_blocks).alias("x"), each(blocks).alias("y"), "node", "label", F.lit(True).alias("is_a"), F.lit(False).alias("major"))
    every = mixed.select("band", each(minor_blocks).alias("x"), own(blocks).alias("y"), "node", "label", F.lit(False).alias("is_a"), (F.col("label") == F.col("top")).alias("major"))

    def compare(group: pa.Table) -> pa.Table:
        is_a = group["is_a"].to_numpy()
        left, right = group.filter(pa.array(is_a)), group.filter(pa.array(~is_a))
        band = group["band"][0].as_py()
        bands = [np.array(side["bands"].to_pylist(), np.int64).reshape(-1, SETS) for side in (left, right)]
        sets = [weighted(flat(side["text"]), idf) for side in (left, right)]
        ends, nodes, labels, major = [], [side["node"].to_pylist() for side in (left, right)], [side["label"].to_pylist() for side in (left, right)], right["major"].to_pylist()
        for i in range(left.num_rows):
            if not right.num_rows:
                break
            same = bands[1] == bands[0][i]
            here = bands[0][i][same.argmax(1)] == band
            for j in np.flatnonzero(here).tolist():
                if labels[0][i] != labels[1][j] and (major[j] or nodes[0][i] < nodes[1][j]):
                    like = jaccard(sets[0][i], sets[1][j])
                    if like >= threshold:
                        ends.append((nodes[0][i], nodes[1][j], like))
        return pa.table({c: pa.array([x[k] for x in ends], t) for k, (c, t) in enumerate((("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())))})

    return minor.unionByName(every).join(texts, "node").groupBy("band", "x", "y").applyInArrow(compare, LINKS).dropDuplicates(["a", "b"])


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_graph(df: DataFrame, threshold: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows as (id, node); nodes as (node, first_id, class_id, label); tables of links (a, b, similarity) between nodes."""
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("node", node_of(F.col("text")))
    idf = idf_table(rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands = signatures(flat(b.column(1)), idf)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(bands), pa.list_(pa.int64()))], ["node", "bands"])

    signed = settle(rows.select("node", "text").mapInArrow(sign, "node binary, bands array<long>").dropDuplicates(["node"]))
    banded = signed.filter(F.col("bands")[0] != 0).select("node", F.explode(F.array_distinct("bands")).alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "a")
    shared = settle(banded.join(heads, "band"))
    # the texts of all nodes that are ever compared: of a node's rows those of the least id, of which any will do
    first = settle(rows.groupBy("node").agg(F.min("id").alias("first_id")))
    # the join is by node and id, so that a text's copies are spread
    wanted = settle(shared.select("node").distinct().join(first, "node").join(signed, "node"))
    texts = rows.join(wanted.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("first_id"))).select("node", "text", "bands")
    texts = settle(settle(texts).dropDuplicates(["node"]))  # ids that repeat
    pairs = settle(shared.filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    banded = shared.select("band", "node")
    links = settle(verified(pairs, texts.select("node", "text"), idf, threshold))
    labels, all_links = components(links), [links]
    for turn in range(1, TURNS + 1):
        mixed = settle(mixed_buckets(banded, labels))
        pairs = settle(pivots(mixed, turn))
        if pairs.isEmpty():
            break
        found = settle(verified(pairs, texts.select("node", "text"), idf, threshold))
        n_found = found.count()
        if n_found:
            labels = merged(labels, found)
            all_links.append(found)
        if n_found < WORTH * pairs.count():
            break
    mixed = settle(mixed_buckets(banded, labels))
    if not mixed.isEmpty():
        found = settle(crossed(mixed, texts, idf, threshold))
        if not found.isEmpty():
            labels = merged(labels, found)
            all_links.append(found)
    nodes = first.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    class_ids = nodes.groupBy("label").agg(F.min("first_id").alias("class_id"))
    nodes = settle(nodes.join(class_ids, "label").select("node", "first_id", "class_id", "label"))
    return rows.select("id", "node"), nodes, all_links


def near_classes(df: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node (the text's), class_id, label (of the class, the least node), for each row."""
    rows, nodes, _ = near_graph(df, threshold, doc_id, text)
    return rows.join(nodes.drop("first_id"), "node").select(F.col("id").alias(doc_id), "node", "class_id", "label")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """near_classes' columns for each row, with its text's links: n_links, and of the most similar linked text (ties: least node) nearest_id, its least
    doc_id, and similarity (both null where there are no links)."""
    rows, nodes, links = near_graph(df, threshold, doc_id, text)
    links = reduce(DataFrame.unionByName, links)
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    best = ends.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct((-F.col("similarity")).alias("unlike"), F.col("b").alias("nearest"))).alias("best"))
    best = best.select("node", "n_links", F.col("best.nearest").alias("nearest"), (-F.col("best.unlike")).alias("similarity"))
    best = best.join(nodes.select(F.col("node").alias("nearest"), F.col("first_id").alias("nearest_id")), "nearest").drop("nearest")
    nodes = nodes.drop("first_id").join(best, "node", "left")
    return rows.join(nodes, "node").select(F.col("id").alias(doc_id), "node", "class_id", "label", F.coalesce("n_links", F.lit(0)).alias("n_links"), "nearest_id", "similarity")


def near_links(df: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The links as pairs of documents: a_id, b_id (the least doc_id of each text, of which copies are members), label, similarity."""
    _, nodes, links = near_graph(df, threshold, doc_id, text)
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("first_id").alias(f"{c}_id"), *([F.col("label")] if c == "a" else []))
    return reduce(DataFrame.unionByName, links).join(end("a"), "a").join(end("b"), "b").select("a_id", "b_id", "label", "similarity")


def keep_one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows without all but one row, of least doc_id, of each class."""
    classes = near_classes(df, doc_id=doc_id, text=text)
    kept = settle(classes.filter(F.col(doc_id).eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("class_id").alias("class_id"), F.min("node").alias("kept_node"), F.count(F.lit(1)).alias("rows")))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.col(doc_id).alias("id"), node_of(F.col(text)).alias("node"))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("kept_node"))).select("row", "id", "node")
    if not kept.filter("rows > 1").isEmpty():  # ids that repeat
        out = out.dropDuplicates(["node"])
    return out.select("row.*")
