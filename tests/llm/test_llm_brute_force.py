"""Operators that SQL cannot express, against plain Python that follows their definitions."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, WORD, corpus

from framelight.llm import fingerprints, toxicity
from framelight.llm.fingerprints import edited_fingerprints
from framelight.llm.lm_scoring import score_documents
from framelight.llm.mixing import mix_sources
from framelight.llm.packing import pack_group
from framelight.llm.sharding import shuffle_into_shards


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


def test_shards(docs):
    """Rows scattered by hash, each bucket shuffled by the generator of its number, buckets laid end to end and cut into even shards."""
    seed, n_shards, bucket_bytes = 5, 7, 3000
    rows = [(r.doc_id, r.key) for r in docs.select("doc_id", F.xxhash64(F.lit(seed), *docs.columns).alias("key")).collect()]
    got = {r.doc_id: (r.shard, r.slot) for r in shuffle_into_shards(docs, n_shards, seed, bucket_bytes).collect()}
    total = sum(len(t.encode()) for _, t, _ in corpus())
    matches = []
    for n_buckets in range(1, 4 * math.ceil(total / bucket_bytes) + 66):  # the number of buckets is the operator's own
        laid = []
        for b in range(n_buckets):
            mine = sorted((key, i) for i, key in rows if key % n_buckets == b)
            at = np.arange(len(mine))
            np.random.default_rng([seed, b]).shuffle(at)
            laid += [mine[i][1] for i in at]
        begins = [-(-s * len(laid) // n_shards) for s in range(n_shards)]
        want = {}
        for place, i in enumerate(laid):
            shard = place * n_shards // len(laid)
            want[i] = shard, place - begins[shard]
        matches.append(want == got)
    assert sum(matches) == 1 and matches.index(True) > 0


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 20))), "big" if i < 200 else f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    seed, block_tokens, budget = 2, 100, 4000
    key = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64(F.lit(seed), *df.columns).alias("k")).collect()}
    got = mix_sources(df, budget, 0.9, 4.0, seed, block_tokens).collect()
    weight, size = {r.source: r.weight for r in got}, {i: len(t.split()) for i, t, _ in rows}
    asked = spark.createDataFrame([(k, b, e) for k in key.values() for e in range(6) for b in (k % 64,)], "k long, b long, e long")
    inner = {(r.k, r.e): r.h for r in asked.select("k", "e", F.xxhash64(F.lit(seed + 2), "k", "e").alias("h")).collect()}
    blocks = spark.range(64).crossJoin(spark.range(6).withColumnRenamed("id", "e"))
    outer = {(r.id, r.e): r.h for r in blocks.select("id", "e", F.xxhash64(F.lit(seed + 1), "id", "e").alias("h")).collect()}
    want = set()
    for source in weight:
        mine = [i for i, _, s in rows if s == source]
        tokens, goal, at = sum(size[i] for i in mine), round(weight[source] * budget), 0
        n_blocks = max(1, math.ceil(tokens / block_tokens))
        for epoch in range(max(1, math.ceil(goal / tokens))):
            for b in sorted(range(n_blocks), key=lambda b: (outer[b, epoch], b)):
                for i in sorted((i for i in mine if key[i] % n_blocks == b), key=lambda i: (inner[key[i], epoch], key[i])):
                    if at < goal:
                        want.add((i, epoch, at))
                    at += size[i]
    assert {(r.doc_id, r.epoch, r.place) for r in got} == want and len(want) > 200


@pytest.mark.parametrize("seed", range(4))
def test_packing(seed):
    rng = np.random.default_rng(seed)
    lengths, overhead = (16, 32, 64), 4
    sizes = -np.sort(-rng.integers(0, 65, 300))
    left, bins, want = Counter(sizes.tolist()), [], []
    for size in sizes.tolist():
        left[size] -= 1
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and b["room"] > 0]
        if fits:
            at = min(fits)[1]
        else:
            costs = []
            for c in (c for c in lengths if c >= size):
                held, room = size, c - size
                for s in sorted((s for s, n in left.items() if n and s), reverse=True):
                    n = min(room // s, left[s])
                    held, room = held + n * s, room - n * s
                costs.append((round((min(x for x in lengths if x >= held) + overhead) / max(held, 1), 9), c))
            at = len(bins)
            bins.append({"room": min(costs)[1], "used": 0})
        want.append((at, bins[at]["used"]))
        bins[at]["room"] -= size
        bins[at]["used"] += size
    got = pack_group(sizes, lengths, overhead)
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want
    assert got[2].tolist() == [min(x for x in lengths if x >= b["used"]) for b in bins]


def test_fingerprint_bits(spark, docs):
    """Every bit by a vote of all words, each by its weight."""
    rows, split = corpus(), re.compile(fingerprints.SPLIT)
    words = {i: [w for w in split.split(t) if w] for i, t, _ in rows}
    hashed = spark.createDataFrame([(w,) for w in {w for x in words.values() for w in x}], "word string")
    hashed = hashed.select("word", fingerprints.cell(F.col("word")).alias("cell"), *[F.xxhash64(F.lit(101 + i), "word").alias(f"h{i}") for i in range(2)]).collect()
    of = {r.word: r for r in hashed}
    held, n = Counter(of[w].cell for x in words.values() for w in set(x)), len(rows)
    weight = lambda c: 15 - min(14, max(0, round(14 * (1 - math.log((n + 1) / min(n, held[c] + 1)) / math.log(n + 1)))))
    got = {r.doc_id: r.fingerprint for r in edited_fingerprints(docs, range_bytes=4000).collect()}
    for i, x in words.items():
        total, bits = sum(weight(of[w].cell) for w in x), ["", ""]
        for half in range(2):
            for k in reversed(range(64)):
                bits[half] += str(int(2 * sum(weight(of[w].cell) for w in x if of[w][f"h{half}"] >> k & 1) > total))
        assert got[i] == "".join(f"{int(b, 2):016x}" for b in bits)


@pytest.mark.parametrize(("a", "b"), [("stupid", "stupid"), ("stupid", "st-u*pid"), ("stupid", "stxupyid"), ("clown", "crown"), ("abcdefgh", "hgfedcba"), ("aaaaaa", "aaaa"), ("abc", "abcd")])
def test_kernel(a, b):
    """Common subsequences of four letters, each by the decay of its span, by listing them all."""
    letters = lambda w: re.sub("[^a-z]", "", w)

    def features(w):
        out = Counter()
        for at in combinations(range(len(w)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                out[tuple(w[i] for i in at)] += toxicity.DECAY ** (at[3] - at[0] + 1)
        return out

    norm = lambda w: float(toxicity.self_kernel(np.array([len(w)]))[0])
    x, y = letters(a), letters(b)
    table = np.zeros(toxicity.TABLE)
    for s, v in features(y).items():
        table[sum((ord(c) - 96) << (15 - 5 * i) for i, c in enumerate(s))] = v / norm(y)
    ((_, _, value, _),) = toxicity.word_values(pa.array([a]), table)
    want = sum(v * features(y)[s] for s, v in features(x).items()) / norm(x) / norm(y)
    assert value.tolist() == [pytest.approx(want)] and (a != "stupid" or want > 0.3)


def test_language_model(docs):
    """Counts, buckets and expectation-maximisation in dictionaries; the operator's table of ratios is rounded, so weights may differ a little."""
    rows, deleted = corpus(), 5
    spread = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(5), "doc_id", "text").alias("h")).collect()}
    train = {i for i, _, _ in rows if i % 4}
    tokens = {i: ["<s>", *WORD.findall(t.lower()), "</s>"] for i, t, _ in rows}

    def count(ids):
        one = Counter(w for i in ids for w in tokens[i])
        two = Counter(p for i in ids for p in zip(tokens[i], tokens[i][1:], strict=False))
        return one, two, sum(n for w, n in one.items() if w != "<s>"), sum(w != "<s>" for w in one)

    bucket = lambda c: int(math.log2(c)) + 1 if c else 0
    parts = lambda c, v, w: (c[1][v, w] / max(c[0][v], 1), c[0][w] / c[2], 1 / (c[3] + 1))
    out = {i for i in train if spread[i] % deleted == 0}
    kept, seen = count(train - out), defaultdict(list)
    for i in out:
        for v, w in zip(tokens[i], tokens[i][1:], strict=False):
            seen[bucket(kept[0][v])].append(parts(kept, v, w))

    def learn(p):
        p, lam = np.array(p), np.full(3, 1 / 3)
        for _ in range(60):
            lam = (p * lam / (p @ lam)[:, None]).sum(0) + 0.01
            lam /= lam.sum()
        return lam

    every = learn([x for p in seen.values() for x in p])
    lam = defaultdict(lambda: every, {b: learn(p) for b, p in seen.items()})
    lam[0] = np.array([0, *lam[0][1:]]) / lam[0][1:].sum()
    whole = count(train)
    got = {r.doc_id: r.score for r in score_documents(docs, F.col("doc_id") % 4 != 0, deleted=deleted).collect()}
    for i, t in tokens.items():
        want = sum(math.log10(lam[bucket(whole[0][v])] @ parts(whole, v, w)) for v, w in zip(t, t[1:], strict=False))
        assert got[i] == pytest.approx(want, rel=0.01)
