"""Each operator on small tables against brute force, and its defined edge cases."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.llm import near_dedup, neighbours
from framelight.llm.fingerprints import edited_fingerprints, hamming_links
from framelight.llm.line_dedup import drop_frequent_lines
from framelight.llm.lm_scoring import score_documents
from framelight.llm.mixing import mix_sources, temperature
from framelight.llm.near_dedup import keep_one_of_each, near_classes, near_duplicates, near_links
from framelight.llm.neighbours import nearest
from framelight.llm.packing import pack, pack_group
from framelight.llm.sharding import shuffle_into_shards
from framelight.llm.substring_dedup import drop_repeated_windows
from framelight.llm.toxicity import fit, score_toxicity, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, source string"
ODD = [(7, None, "a"), (8, "", None), (9, " \n\t", "a"), (10, "one two", "b"), (10, "one two", "b"), (None, "no id here at all", "b"), (11, "É" * 3, None)]


def corpus(seed=0, n=120):
    """Texts that share passages, lines and copies."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 30))
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(words, rng.integers(3, 40))) for _ in range(rng.integers(1, 5))]
        if i % 5 == 0:
            lines.insert(0, passage)
        if i % 4 == 0:
            lines.append("  Common LINE\t")
        if i % 10 == 9:
            lines = out[i - 3][1].split("\n")
        if i % 10 == 8:
            lines = [*out[i - 5][1].split("\n"), "tail"]
        out.append((i, "\n".join(lines), f"s{i % 3}"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("shard", "SLOT", "n_lines", "score", "weight", "row")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards(docs, odd, empty):
    got = shuffle_into_shards(docs, 8, seed=1, bucket_bytes=2000).collect()
    sizes = Counter(r.shard for r in got)
    assert sorted(r.doc_id for r in got) == list(range(120)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    again = {(r.doc_id, r.shard, r.slot) for r in shuffle_into_shards(docs.repartition(7), 8, seed=1, bucket_bytes=2000).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}, "the order of the input does not matter"
    other = {(r.doc_id, r.shard) for r in shuffle_into_shards(docs, 8, seed=2).collect()}
    assert other != {(r.doc_id, r.shard) for r in got}
    assert len(shuffle_into_shards(odd, 8).collect()) == len(ODD) and shuffle_into_shards(empty, 8).collect() == []


def brute_windows(rows, k):
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = {p for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        out[i] = len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


def test_substring_dedup(docs, odd, empty):
    want = brute_windows(corpus(), 5)
    got = drop_repeated_windows(docs, 5).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    for r in got:  # factors cover what is removed, and nothing else
        covered = {p for f in r.factors for p in range(f.start, f.start + f.words)}
        assert len(covered) == r.n_removed and all(f.words >= 5 for f in r.factors)
    assert sorted((r.n_words, r.n_removed) for r in drop_repeated_windows(odd, 2).collect()) == sorted((len(WORD.findall(t or "")), 0) for _, t, _ in ODD)
    assert drop_repeated_windows(empty).collect() == []


def brute_factors(rows, k):
    """A greedy parse with plain Python: of each document the factors' start and length, against the first document and place of each window."""
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), (i, j))
    out = {}
    for i, w in words.items():
        ref = [first[tuple(w[j : j + k])] for j in range(len(w) - k + 1)]
        out[i], j = [], 0
        while j < len(ref):
            if ref[j][0] >= i:
                j += 1
                continue
            start, (doc, at) = j, ref[j]
            while j + 1 < len(ref) and ref[j + 1] == (doc, at + j + 1 - start):
                j += 1
            assert words[doc][at : at + j - start + k] == w[start : j + k], "a factor stands in its reference"
            out[i].append((start, j - start + k))
            j += 1
    return out


@pytest.mark.parametrize("block_bytes", [None, 3000])
def test_substring_parse(docs, block_bytes):
    """Factors are those of a plain greedy parse, whether the corpus is one block or many."""
    rows, k = corpus(), 5
    got = {r.doc_id: r for r in drop_repeated_windows(docs, k, block_bytes=block_bytes).collect()}
    want = brute_factors(rows, k)
    assert {i: [(f.start, f.words) for f in r.factors] for i, r in got.items()} == want and sum(map(len, want.values())) > 20
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in got.items()} == brute_windows(rows, k)
    assert (len({f.block for r in got.values() for f in r.factors}) > 3) == (block_bytes is not None)


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs, odd, empty):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in drop_frequent_lines(docs, 10).collect()]
    assert sorted(got) == sorted(brute_lines(corpus(), 10)) and sum(x[2] for x in got) > 20
    got = [(str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in drop_frequent_lines(odd, 2).collect()]
    assert sorted(got) == sorted((str(i), *rest) for i, *rest in brute_lines(ODD, 2))
    assert drop_frequent_lines(empty).collect() == []


def test_line_dedup_counts_rows(spark):
    """A row is a document, also where rows share an id: ten of them make a line frequent, nine do not."""
    for n in (9, 10):
        rows = [(7, f"same\nown {i}", "s") for i in range(n)]
        got = drop_frequent_lines(spark.createDataFrame(rows, SCHEMA), 10).collect()
        assert {(r.n_lines, r.n_dropped) for r in got} == {(2, int(n == 10))} and len(got) == n


def test_line_dedup_salts_what_most_documents_hold(spark, monkeypatch):
    """More frequent keys than are salted: both ways of the join, and null ids, give the same."""
    import framelight.llm.line_dedup as module

    monkeypatch.setattr(module, "HOT", 2)
    rows = [(i if i % 9 else None, "\n".join(["Everywhere", f"of {i % 3}", f"own {i}", *(["twice"] if i < 2 else [])]), "s") for i in range(60)]
    got = [(str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in drop_frequent_lines(spark.createDataFrame(rows, SCHEMA), 10).collect()]
    lines = lambda t: [x for x in t.split("\n") if not x.startswith(("E", "of"))]
    assert sorted(got) == sorted((str(i), t.count("\n") + 1, 2, "\n".join(lines(t))) for i, t, _ in rows)


def test_fingerprints(docs, odd, empty):
    rows = sorted(corpus())
    got = {r.doc_id: r for r in edited_fingerprints(docs, range_bytes=4000).collect()}
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    for n, (i, text, _) in enumerate(rows):
        after, half = rows[(n + 1) % len(rows)], len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(like(r.fingerprint, got[after[0]].fingerprint))
    texts = {}
    for i, text, _ in rows:
        assert texts.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.05
    assert len(edited_fingerprints(odd).collect()) == len(ODD) and edited_fingerprints(empty).collect() == []


def test_fingerprint_plan_has_no_python(docs):
    plan = edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_block_tables_find_every_pair(spark):
    rng = np.random.default_rng(3)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(60)]
    prints = base + [b ^ sum(1 << int(k) for k in rng.choice(128, rng.integers(1, 6), replace=False)) for b in base for _ in range(3)]
    prints = [f"{p:032x}" for p in prints] + [f"{base[0]:032x}"]
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    want = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in set(prints) for b in set(prints) if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    assert {tuple(r) for r in hamming_links(df, 3).collect()} == want and want


def brute_classes(rows, threshold=0.8):
    bags = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    held = Counter(g for b in bags.values() for g in b)
    weigh = {i: {g: c * (1 + math.log((len(rows) + 1) / (held[g] + 1))) for g, c in b.items()} for i, b in bags.items()}
    label = {i: i for i in bags}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    text = {i: t or "" for i, t, *_ in rows}
    ids = sorted(bags)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            like = 0.0
            for bag in (weigh, bags):
                least = sum(min(w, bag[b].get(g, 0)) for g, w in bag[a].items())
                most = sum(bag[a].values()) + sum(bag[b].values()) - least
                like = max(like, least / most if most else 0)
            if text[a] == text[b] or like >= threshold:
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_near_dedup(spark, docs, odd, empty):
    want = brute_classes(corpus())
    assert {r.doc_id: r.class_id for r in near_classes(docs).collect()} == want and len(set(want.values())) < 110
    assert sorted(r.doc_id for r in keep_one_of_each(docs).collect()) == sorted(set(want.values()))
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in ODD}), "one row of each text, null as the empty text"
    assert near_classes(empty).collect() == [] and keep_one_of_each(empty).collect() == []


def test_near_links(spark, docs, empty):
    """Every link is alike by brute force, at its similarity; links join all texts of a class; rows know their links, copies those of their text."""
    rows = corpus()
    text, bags = {i: t or "" for i, t, *_ in rows}, {}
    for i, t in text.items():
        w = WORD.findall(t)
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    held = Counter(g for b in bags.values() for g in b)
    weigh = {i: {g: c * (1 + math.log((len(rows) + 1) / (held[g] + 1))) for g, c in b.items()} for i, b in bags.items()}

    def like(a, b):
        least = lambda bag: sum(min(w, bag[b].get(g, 0)) for g, w in bag[a].items())
        return max(least(bag) / (sum(bag[a].values()) + sum(bag[b].values()) - least(bag)) for bag in (weigh, bags))

    links = near_links(docs).collect()
    assert links and len({frozenset((r.a_id, r.b_id)) for r in links}) == len(links)
    assert all(r.similarity >= 0.8 and r.similarity == pytest.approx(like(r.a_id, r.b_id), abs=1e-4) for r in links)
    first = {t: min(i for i in text if text[i] == t) for t in text.values()}
    of = {i: i for i in first.values()}

    def root(i):
        return i if of[i] == i else root(of[i])

    for r in links:
        p, q = root(r.a_id), root(r.b_id)
        of[max(p, q)] = min(p, q)
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {i: root(first[text[i]]) for i in text} == {i: r.class_id for i, r in found.items()}
    for i, r in found.items():
        mine = [(x.similarity, x.b_id if x.a_id == first[text[i]] else x.a_id) for x in links if first[text[i]] in (x.a_id, x.b_id)]
        assert r.n_links == len(mine) and (r.similarity, r.nearest_id) in (mine or [(None, None)]) and r.similarity == max((m[0] for m in mine), default=None)
    assert near_links(empty).collect() == [] and near_duplicates(empty).collect() == []


def test_near_dedup_follows_chains_within_a_bucket(spark):
    """A text like its neighbours only, not like the bucket's least one: links in a chain make one class."""
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(10)]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_of_null_and_repeated_ids(spark):
    """Different texts stay apart whatever their ids; of copies without an id one row stays."""
    texts = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (5, texts["c"]), (5, texts["d"]), (5, texts["d"]), (6, texts["e"]), (None, texts["e"]), (None, texts["f"]), (5, texts["f"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in keep_one_of_each(df).collect()) == sorted(texts.values())
    assert len({r.label for r in near_classes(df).collect()}) == len(texts)


def test_near_dedup_of_a_third_of_all_rows():
    """A text and its copies with two edited words each, alike by plain Jaccard only, as their shingles are common for being theirs: all are found and linked."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(104)]
    rows = [" ".join(base)]
    for i in range(1, 800):
        words = list(base)
        for at in rng.choice(np.arange(5, 95), 2, replace=False):
            words[at] = f"e{i}x{at}"
        rows.append(" ".join(words))
    texts, held = pa.array(rows), np.zeros(near_dedup.CELLS)
    for _, _, _, h, _ in near_dedup.shingles(texts):
        held += np.bincount(near_dedup.cells(h), minlength=near_dedup.CELLS)
    idf = (1 + np.log(2401 / (np.minimum(held, 2400) + 1))).astype(np.float32)  # of three times as many texts
    bands, sets = near_dedup.signatures(texts, idf), near_dedup.weighted(texts, idf)
    assert (bands[1:] == bands[0]).any(1).mean() > 0.99
    assert all(near_dedup.jaccard(sets[0], x) >= 0.8 for x in sets[1:])


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 3 + rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, [1.0] * 3), (3100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    got = nearest(df, F.col("id") % 100 == 0, 10, sample_rows=1000, block_rows=128).collect()
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[m[1]] - m[2]) < 1e-12 for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & set(order))
    assert hits >= 0.9 * 300 and {r.query_id for r in got} == set(range(0, 3000, 100))
    twice = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 5.0])]
    got = nearest(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), F.col("id") == 0, 2).collect()
    assert sorted((r.rank, r.vec_id, round(r.score, 3)) for r in got) == sorted([(1, 0, 0.0), (1, 0, 0.0), (2, 0, 1.414), (2, 0, 1.414), (1, 0, 1.414), (2, 0, 1.414)]), "only a query's own row is left out"
    few = nearest(df.filter("vec_id < 4 OR vec_id >= 3000"), F.col("id") % 2 == 0, 10).collect()
    assert Counter(r.query_id for r in few) == {0: 3, 2: 3}
    assert nearest(df.limit(0), F.col("id") % 2 == 0).collect() == []


@pytest.mark.parametrize(("n", "sample"), [(500, 8192), (4000, 400)])
def test_neighbours_are_routed_at_every_size(spark, n, sample):
    """Networks choose some of many leaves, also where they are fitted on a tenth of the rows; most neighbours are found."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 12))[rng.integers(0, 20, n)] * 4 + rng.normal(size=(n, 12))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}))
    leaves, probes = neighbours.fit(df.select(F.col("embedding").alias("v")), n, 10, sample, 0.95)
    assert leaves.top is not None and leaves.n >= 16 and probes < leaves.n
    got = {(r.query_id, r.vec_id) for r in nearest(df, F.col("id") % 50 == 0, 10, sample_rows=sample).collect()}
    want = {(q, int(i)) for q in range(0, n, 50) for i in np.argsort(((x - x[q]) ** 2).sum(1))[1:11]}
    assert len(got & want) >= 0.9 * len(want)


def test_language_model(docs, odd, empty):
    rows = corpus()
    inside = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t, _ in rows}
    counts = Counter(w for i, t in tokens.items() if inside(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1).collect()}
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not inside(i), len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    out = score_documents(odd, F.lit(False)).collect()
    assert len(out) == len(ODD) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in out)
    assert score_documents(empty, F.lit(True)).collect() == []


def test_language_model_is_a_distribution(spark):
    """After each word, known or not, and at the beginning the probabilities of all words, of one unseen and of the end sum to 1.

    With B(w) at the beginning, E(w) of the end after w: p[w] = B(w) E(w) and p[a b] = B(a) P(b | a) E(b). If all P(. | a) and E(a)
    sum to 1, then B(a) = p[a] + sum of p[a b] / p[b] B(b), which fixes B; and then p[""] and all B must sum to 1."""
    rows = [(i, " ".join(f"t{(i * j + j * j) % 7}" for j in range(1, 9)), True) for i in range(60)]
    words = [*sorted({w for _, t, _ in rows for w in t.split()}), "unseen"]
    texts = ["", *words, *(f"{a} {b}" for a in words for b in words)]
    df = spark.createDataFrame(rows + [(1000 + i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    got = {r.doc_id: 10.0**r.score for r in score_documents(df, F.col("train")).filter("doc_id >= 1000").collect()}
    p = {t: got[1000 + i] for i, t in enumerate(texts)}
    step = np.array([[p[f"{a} {b}"] / p[b] for b in words] for a in words])
    begin = np.linalg.solve(np.eye(len(words)) - step, np.array([p[w] for w in words]))
    assert (begin > 0).all() and p[""] + begin.sum() == pytest.approx(1)


def toxic_corpus(n=400, seed=2):
    rng = np.random.default_rng(seed)
    syllables = ["the", "an", "tion", "er", "re", "on", "ing", "st", "ed", "wh"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for i in range(n):
        sentences = [[word() for _ in range(rng.integers(4, 12))] for _ in range(rng.integers(1, 6))]
        bad = i % 5 == 0
        if bad:
            for s in sentences[:2]:
                s.insert(1, str(rng.choice(["moron", "stupid", "loser", "clown"])))
        rows.append((i, " ".join(" ".join(s) + "." for s in sentences), "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, odd, empty):
    rows, labels = toxic_corpus()
    docs, told = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = fit(docs, told, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    held = [(got[i] >= 0.5, bool(y)) for i, y in labels if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    gapped = spark.createDataFrame([(0, "the m.o.r.o.n an", ""), (1, "st*upid loser", ""), (2, "the s t u p i d an", ""), (3, "the an tion er.", "")], SCHEMA)
    assert [r.score >= 0.5 for r in score_toxicity(gapped, model).orderBy("doc_id").collect()] == [True, True, True, False]
    scored = score_toxicity(odd, model)
    assert sorted(scored.columns) == sorted(odd.columns) and all(0 <= r.score < 0.5 for r in scored.collect()) and scored.count() == len(ODD)
    none = fit(docs, told.limit(0), F.lit(True))
    assert all(r.score < 0.01 for r in score_toxicity(docs, none).collect()) and score_toxicity(empty, model).collect() == []


def test_toxicity_of_inflected_stems():
    """A small language whose insults are one stem with many endings, which clean documents now and then form by chance."""
    rng = np.random.default_rng(8)
    rows, labels = toxic_corpus(800)
    texts, toxic, small = [t for _, t, _ in rows], [bool(y) for _, y in labels], [False] * len(rows)
    parts = "ré eux tion ai ou elle que ch ê vi pa men an è on é le re tre aux en ç oi ti".split()
    word = lambda: "".join(rng.choice(parts, rng.integers(2, 6)))
    for i in range(240):
        words = [word() for _ in range(rng.integers(60, 400))]
        if i % 6 == 0:
            for at in rng.integers(0, len(words), max(4, len(words) // 16)):
                words[at] = "réeux" + word()
        texts.append(". ".join(" ".join(words[j : j + 8]) for j in range(0, len(words), 8)))
        toxic.append(i % 6 == 0)
        small.append(True)
    toxic, small, held = np.array(toxic), np.array(small), np.arange(len(texts)) % 4 == 1
    held |= small & (np.arange(len(texts)) % 12 == 8)
    told = np.flatnonzero(~held)
    model = train(pa.array([texts[i] for i in told]), toxic[told])
    got = model.score(pa.array(texts)) >= 0.5
    assert (toxic & small & held).sum() >= 15 and got[toxic & small & held].mean() >= 0.8 and got[~toxic & small & held].mean() <= 0.05
    assert (got == toxic)[held & ~small].mean() > 0.97


def test_mixing(spark, odd, empty):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 20))), "big" if i < 300 else f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    for budget, entropy, most in ((None, 0.9, 4.0), (1500, 0.8, 4.0), (6000, 1.0, 2.5), (None, 0.1, 4.0)):
        got = mix_sources(df, budget, entropy, most, block_tokens=100).collect()
        w = {r.source: r.weight for r in got}
        h = -sum(x * math.log(x) for x in w.values())
        ratio = {s: w[s] * (budget or max(tokens[s] / w[s] for s in w)) / tokens[s] for s in w}
        assert sum(w.values()) == pytest.approx(1)
        exponents = [math.log(w[a] / w["big"]) / math.log(tokens[a] / tokens["big"]) for a in w if a != "big"]
        assert max(exponents) - min(exponents) < 1e-6 and -1e-9 <= exponents[0] <= 1 + 1e-9
        if exponents[0] < 1 - 1e-6:
            assert h <= entropy * math.log(len(w)) + 1e-6 and max(ratio.values()) <= most + 1e-6
            assert h == pytest.approx(entropy * math.log(len(w)), abs=1e-6) or max(ratio.values()) == pytest.approx(most, abs=1e-6) or exponents[0] < 1e-6
        for s in w:
            mine = sorted((r.place, r.place + r.n_tokens) for r in got if r.source == s)
            goal = round(w[s] * (budget or max(tokens[x] / w[x] for x in w)))
            assert all(a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False)) and mine[0][0] == 0 and mine[-1][1] >= goal > mine[-1][0] - 20
            for e in {r.epoch for r in got if r.source == s}:
                ids = [r.doc_id for r in got if r.source == s and r.epoch == e]
                assert len(ids) == len(set(ids))
        if budget is None:
            assert {r.doc_id for r in got} == set(range(400)), "no document is left out"
    assert {r.text for r in mix_sources(odd).collect()} == {t for _, t, _ in ODD} and mix_sources(empty).collect() == []
    assert temperature(spark.createDataFrame([("a", 10), ("b", 10)], "source string, tokens long"), None, 0.5, 4.0)[0] == pytest.approx(1.0)


def test_packing(docs, odd, empty):
    got = pack(docs, lengths=(16, 32, 64), group_pieces=40).collect()
    words = {i: len(WORD.findall(t)) for i, t, _ in corpus()}
    for i, n in words.items():
        mine = sorted((r.piece, r.piece_start, r.piece_tokens) for r in got if r.doc_id == i)
        assert [m[1] for m in mine] == list(range(0, max(n, 1), 64)) and sum(m[2] for m in mine) == n
    bins = {}
    for r in got:
        bins.setdefault((r.bin, r.bin_length), []).append((r.bin_start, r.bin_start + r.piece_tokens))
    for (_, length), spans in bins.items():
        spans.sort()
        used = spans[-1][1]
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert length == min(x for x in (16, 32, 64) if x >= used), "downsized to its contents"
    assert sum(words.values()) / sum(length for _, length in bins) > 0.9
    assert len(pack(odd).collect()) == len(ODD) and pack(empty).collect() == []
    clash = docs.withColumns({c: F.col("doc_id") for c in ("key_", "tokens_", "size_", "group_", "row", "bin")})
    kept = pack(clash, keep=("doc_id", "key_", "tokens_", "size_", "group_", "row", "bin"))
    assert all(r.key_ == r.tokens_ == r.size_ == r.group_ == r.row == r.doc_id for r in kept.collect()) and dict(kept.dtypes)["bin"] == "string"


def test_best_fit_takes_the_tightest_bin():
    bins, starts, final = pack_group(np.array([60, 50, 30, 13, 12, 4]), (64, 128), 0)
    used = Counter()
    for b, s, n in zip(bins.tolist(), starts.tolist(), [60, 50, 30, 13, 12, 4], strict=True):
        assert s == used[b]
        used[b] += n
    assert all(used[b] <= final[b] for b in used) and sum(used.values()) == 169


def test_very_long_texts(spark):
    """Texts longer than what is worked on at once: a copy, a near copy, and a passage at the end of one of them."""
    from framelight.llm.words import SLICE

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 220_000)]
    words[1000::1000] = [f"{w}\n" for w in words[1000::1000]]
    text = " ".join(words)
    rows = [(1, text, "s"), (2, text, "s"), (3, text.replace("w7 ", "x7 "), "s"), (4, "before " + text[-3000:], "s")]
    assert len(text) > SLICE
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in drop_repeated_windows(df).collect()} == brute_windows(rows, 13)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in drop_frequent_lines(df, 3).collect()) == sorted(brute_lines(rows, 3))
    assert {r.doc_id: r.class_id for r in near_classes(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: r.n_tokens for r in score_documents(df, F.lit(True)).collect()} == {i: len(t.split()) + 1 for i, t, _ in rows}
    assert sum(r.piece_tokens for r in pack(df).collect()) == sum(len(t.split()) for _, t, _ in rows)
    assert {r.doc_id: r.n_chars for r in edited_fingerprints(df).collect()} == {i: len(t) for i, t, _ in rows}
    assert len(shuffle_into_shards(df, 2).collect()) == 4 and {r.doc_id for r in mix_sources(df).collect()} == {1, 2, 3, 4}
