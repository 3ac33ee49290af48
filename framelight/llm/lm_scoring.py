"""Language-model scores by deleted interpolation (Jelinek-Mercer) of a word bigram model.

The probability of a word w after v is  l2(b) c(vw)/c(v) + l1(b) c(w)/N + l0(b) / (V+1),  where the mixture
weights l depend on the context's frequency bucket b = 1 + floor(log2 c(v)), or 0 for a context never seen, in which l2 is 0
and the others fill its place, so that probabilities sum to 1 after every word. A part of
the training documents (one in ``deleted``) is left out of the counts, and expectation-maximisation finds the weights that suit
that part best. Scores then use the counts of all training documents with those weights.

Counts cover all training documents. Documents are dealt into chunks; a chunk sends each of its different unigrams and
bigrams once, with its counts, to the block of its hash, and gets the corpus' counts back, so frequent words weigh no
more than others. For the weights every left-out token counts, in a table of bounded size: bucket and log2 of the two
ratios of probabilities in steps of 1/8 (half a step off at most); probabilities in scores are exact.
N-grams are told apart by 64-bit hashes.

Defined cases: null is the empty text, which is one token, the end; with no training documents c is 0
throughout and every token has the probability 1 / (V+1) = 1; ids may repeat or be null (null ids are training documents); an empty table gives no rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.llm.common import exchange_bytes, settle, shuffle_partitions, total_bytes
from framelight.llm.hash_blocks import cuts, distinct, pack, unpack
from framelight.llm.words import BASE, flat, mix, scan, slices

BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4C8A35B27)
ONE = np.uint64(1)
BEGIN_KEY = mix(np.array([BEGIN ^ np.uint64(0x1B56C4E9)], np.uint64)) | ONE
STEP, REACH = 8, 400  # of the table of ratios
RETAINED, DELETED, HELD_OUT = 0, 1, 2


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all unigrams (odd; each document begins with BEGIN's) and of the bigrams that end there
    (even; at a BEGIN 0), and where each document begins; one more at the end."""
    uni, bi, first, base = [], [], [np.zeros(1, np.int64)], 0
    for low, high in slices(texts):
        words = scan(texts.slice(low, high - low))
        n, docs = len(words.start), high - low
        tokens = np.empty(n + 2 * docs, np.uint64)
        begin = words.first[:-1] + 2 * np.arange(docs)
        end = words.first[1:] + 2 * np.arange(docs) + 1
        tokens[begin], tokens[end] = BEGIN, END
        tokens[np.arange(n) + 2 * words.doc.astype(np.int64) + 1] = words.hashes(fold=True)
        one = mix(tokens ^ np.uint64(0x1B56C4E9)) | ONE
        two = np.zeros(len(tokens), np.uint64)
        two[1:] = mix(tokens[:-1] * np.uint64(BASE) + (tokens[1:] ^ np.uint64(0x5851F42D))) & ~ONE
        two[begin] = 0
        uni.append(one)
        bi.append(two)
        first.append(end + 1 + base)
        base += len(tokens)
    join = lambda x: np.concatenate([np.zeros(0, np.uint64), *x])
    return join(uni), join(bi), np.concatenate(first)


def keys_of(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, each unigram's and bigram's number among them, documents' first tokens."""
    uni, bi, first = stream(flat(chunk["text"]))
    keys, _, number = distinct(np.concatenate([uni, bi]))
    return keys, number[: len(uni)], number[len(uni) :], first


def weights(table: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM on rows (bucket, cell of p2/p0, cell of p1/p0, tokens): a row l2, l1, l0 for each of 64 buckets."""
    ratio = lambda cell: np.where(cell == 0, 0.0, np.exp2((cell - 1.0 - REACH) / STEP))
    p = np.stack([ratio(table[:, 1]), ratio(table[:, 2]), np.ones(len(table))], 1)
    n, bucket = table[:, 3].astype(float), table[:, 0].astype(int)

    def learn(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        lam = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = p * lam
            lam = (n[:, None] * part / part.sum(1, keepdims=True)).sum(0) + 0.01  # no weight ends at 0
            lam /= lam.sum()
        return lam

    lam = np.tile(learn(p, n) if n.sum() else np.full(3, 1 / 3), (64, 1))
    for b in np.unique(bucket):
        lam[b] = learn(p[bucket == b], n[bucket == b])
    lam[0, 0] = 0
    lam[0] /= lam[0].sum()
    return lam


def buckets(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(int) + 1, 0)


def counts_at(chunk: pa.Table, answers: pa.Table) -> dict:
    """Corpus counts (retained, deleted) of each token's unigram, bigram and context, and the totals."""
    keys, uni, bi, first = keys_of(chunk)
    answers = answers.sort_by("block")
    ns = answers["n"].to_pylist()
    both = [np.concatenate([unpack(x.as_py(), n, np.int64) for x, n in zip(answers[name], ns, strict=True)]) for name in ("retained", "deleted")]
    total = {name: sum(answers[name].to_pylist()) for name in ("n_retained", "n_deleted", "v_retained", "v")}
    return total | {"uni": uni, "bi": bi, "first": first, "counts": both}


def score_documents(df: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", deleted: int = 12) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams), score (the model's)."""
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.coalesce(training, F.lit(True)).alias("training"))
    total = total_bytes(rows)
    n = max(1, math.ceil(total / exchange_bytes(total)))
    n_deleted = max(1, math.ceil(n / deleted))
    spread = F.xxhash64(F.lit(3), "id", "text")
    role = F.when(~F.col("training"), HELD_OUT).when(F.pmod(F.xxhash64(F.lit(5), "id", "text"), F.lit(deleted)) == 0, DELETED).otherwise(RETAINED)
    chunks = rows.select(F.when(role == DELETED, n + F.pmod(spread, F.lit(n_deleted))).otherwise(F.pmod(spread, F.lit(n))).cast("int").alias("chunk"), role.cast("int").alias("role"), "id", "text")
    n_blocks = n

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(max(n + n_deleted, shuffle_partitions(spark)), "chunk")

    def ask(chunk: pa.Table) -> pa.Table:
        keys, uni, bi, first = keys_of(chunk)
        role = np.repeat(chunk["role"].to_numpy(), np.diff(first))
        count = lambda r: np.bincount(np.concatenate([uni[role == r], bi[role == r]]), minlength=len(keys)).astype(np.int32)
        both, at = [count(RETAINED), count(DELETED)], cuts(keys, n_blocks)
        part = lambda x: pa.array([pack(x[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
        number = np.full(n_blocks, chunk["chunk"][0].as_py(), np.int32)
        return pa.table({"block": pa.array(np.arange(n_blocks), pa.int32()), "chunk": pa.array(number), "n": pa.array(np.diff(at)), "keys": part(keys), "retained": part(both[0]), "deleted": part(both[1])})

    def answer(block: pa.Table) -> pa.Table:
        ns = block["n"].to_pylist()
        get = lambda name, kind: np.concatenate([unpack(x.as_py(), n, kind) for x, n in zip(block[name], ns, strict=True)])
        keys, first, number = distinct(get("keys", np.uint64))
        both = [np.bincount(number, get(name, np.int32), len(keys)).astype(np.int64) for name in ("retained", "deleted")]
        word = (keys & ONE).astype(bool) & (keys != BEGIN_KEY)
        at = np.concatenate([[0], np.cumsum(ns)])
        part = lambda x: pa.array([pack(x[number[a:b]]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
        same = lambda x: pa.array(np.full(len(ns), x, np.int64))
        return pa.table({
            "chunk": block["chunk"], "block": block["block"], "n": block["n"], "retained": part(both[0]), "deleted": part(both[1]),
            "n_retained": same(both[0][word].sum()), "n_deleted": same(both[1][word].sum()), "v_retained": same((both[0][word] > 0).sum()), "v": same(((both[0] + both[1])[word] > 0).sum()),
        })

    def tally(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        x = counts_at(chunk, answers)
        count, inner = x["counts"][0], np.ones(len(x["uni"]), bool)
        inner[x["first"][:-1]] = False
        at = np.flatnonzero(inner)
        context, flatness = count[x["uni"][at - 1]], x["v_retained"] + 1.0
        p2 = count[x["bi"][at]] / np.maximum(context, 1) * flatness
        p1 = count[x["uni"][at]] / max(x["n_retained"], 1) * flatness
        cell = lambda p: np.where(p > 0, np.clip(np.rint(STEP * np.log2(np.maximum(p, 1e-300))), -REACH, REACH) + REACH + 1, 0).astype(np.int64)
        where, n = np.unique((buckets(context) * 1024 + cell(p2)) * 1024 + cell(p1), return_counts=True)
        return pa.table({"cell": where, "n": n.astype(np.int64)})

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        x = counts_at(chunk, answers)
        count, n, v = x["counts"][0] + x["counts"][1], x["n_retained"] + x["n_deleted"], x["v"]
        inner = np.ones(len(x["uni"]), bool)
        inner[x["first"][:-1]] = False
        at = np.flatnonzero(inner)
        first = x["first"][:-1] - np.arange(len(x["first"]) - 1)  # with no BEGIN
        c, context = count[x["uni"][at]], count[x["uni"][at - 1]]
        l2, l1, l0 = lam[buckets(context)].T if n else np.array([0.0, 0.0, 1.0])
        p = l2 * count[x["bi"][at]] / np.maximum(context, 1) + l1 * c / max(n, 1) + l0 / (v + 1)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        add = lambda y: np.add.reduceat(y, first)
        return pa.table({
            "doc_id": chunk["id"], "held_out": pa.array(chunk["role"].to_numpy() == HELD_OUT), "n_tokens": pa.array(np.diff(np.append(first, len(at))), pa.int64()),
            "n_known": add((c > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(first), n, np.int64)), "base_score": add(base), "score": add(np.log10(p)),
        })

    totals = "n_retained long, n_deleted long, v_retained long, v long"
    asked = dealt(chunks).groupBy("chunk").applyInArrow(ask, "block int, chunk int, n long, keys binary, retained binary, deleted binary")
    answers = settle(asked.groupBy("block").applyInArrow(answer, f"chunk int, block int, n long, retained binary, deleted binary, {totals}"))
    left_out = dealt(chunks.filter(F.col("role") == DELETED)).groupBy("chunk").cogroup(answers.filter(F.col("chunk") >= n).groupBy("chunk"))
    cells = left_out.applyInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # of a bounded table
    cells = np.array([(c >> 20, c >> 10 & 1023, c & 1023, n) for c, n in cells], np.int64).reshape(-1, 4)
    lam = weights(cells)
    id_type = rows.schema["id"].dataType.simpleString()
    return dealt(chunks).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
