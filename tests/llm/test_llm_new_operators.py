"""Hard negatives, repair of conversations and license scans against brute force, and their defined edge cases."""

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelight.llm import hard_negatives, licenses
from framelight.llm.conversations import Conversation, repair, repaired_turns
from framelight.llm.hard_negatives import Tree, dual_search, intervals, mine
from framelight.llm.licenses import BETWEEN, Templates, compiled, pattern, scan_licenses, step, words_of
from framelight.llm.packing import pack
from framelight.llm.sharding import shuffle_into_shards
from framelight.llm.words import scan

VECTORS = "vec_id long, embedding array<float>, label int, row string, cell int"


def brute_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), y) for i, v, y in rows]
    out = []
    for n, (a, x, y) in enumerate(rows):
        if a % anchors:
            continue
        scored = sorted((-int(x @ v), i, z) for m, (i, v, z) in enumerate(rows) if m != n)
        for s, p, _ in [t for t in scored if t[2] == y][:positives]:
            fits = [t for t in scored if t[2] != y and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, seed=0, dims=6, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (5, dims))
    return [(i, [float(x) for x in (centres[i % 5] + rng.normal(0, 0.3, dims)).astype(np.float32)], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("case", ["clusters", "copies", "one label", "ids repeat"])
def test_hard_negatives(spark, case, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rows = vectors(400)
    if case == "copies":  # a third of all rows, scores tie
        rows = [(i, rows[0][1] if i % 3 == 0 else v, y) for i, v, y in rows]
    if case == "one label":
        rows = [(i, v, 7 if i % 10 else y) for i, v, y in rows]
    if case == "ids repeat":
        rows = rows[:120] + rows[:40]
    got = mine(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS), F.col("id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 20)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = vectors(60)
    odd = [(None, fine[0][1], 1), (1000, None, 1), (1020, fine[0][1], None), (1040, [nan] * 6, 1), (1060, [inf] * 6, 1), (1080, [None] * 6, 1), (1100, [1.0], 1), (1120, [], 1), (1140, [1e30] * 6, 1)]
    got = mine(spark.createDataFrame([(*r, None, None) for r in [*fine, *odd]], VECTORS), F.col("id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(fine, 20)
    for rows in ([], fine[1:5], odd):  # no rows, no anchors, none that takes part
        assert mine(spark.createDataFrame([(*r, None, None) for r in rows], VECTORS), F.col("id") % 20 == 0).collect() == []
    zero = [(i, [0.0] * 6, i % 2) for i in range(40)]
    assert sorted(tuple(r) for r in mine(spark.createDataFrame([(*r, None, None) for r in zero], VECTORS), F.col("id") % 20 == 0).collect()) == brute_negatives(zero, 20)


def test_intervals_hold_and_prune(monkeypatch):
    """Every score lies in its nodes' interval; with far clusters most pairs of leaves are never scored."""
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(rng.normal(0, 20, (8, 5)), 40, 0) + rng.normal(0, 0.1, (320, 5))))
    label = rng.integers(0, 3, 320)
    a, c = Tree(x[:64], label[:64], 16), Tree(x, label, 8)
    ai, ci = (g.ravel() for g in np.meshgrid(np.arange(len(a.spans)), np.arange(len(c.spans))))
    lo, hi = intervals(a, c, ai, ci)
    inside = x[:64][a.order] @ x[c.order].T
    for i, j, low, high in zip(ai, ci, lo, hi, strict=True):
        part = inside[slice(*a.spans[i]), slice(*c.spans[j])]
        assert low <= part.min() and part.max() <= high
    scored = []
    real = hard_negatives.merge
    monkeypatch.setattr(hard_negatives, "merge", lambda *args: (scored.append(1), real(*args)))
    low, high = np.full((64, 1), hard_negatives.LEAST + 1), np.full((64, 1), hard_negatives.MOST - 1)
    anchors = {"row": np.arange(64), "label": label[:64], "v": x[:64], "least": low, "most": high, "need": low}
    score, ids = dual_search(anchors, {"row": np.arange(320), "id": np.arange(320), "label": label, "v": x}, 3, True)
    assert len(scored) < len([s for s in c.children if s is None]) * len([s for s in a.children if s is None]) / 4
    for i in range(64):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(320) if j != i and label[j] == label[i])[:3]
        assert [(-s, j) for s, j in zip(score[i, 0], ids[i, 0], strict=True)] == want


# --- conversations
CHAT = "conv_id long, turn long, role string, text string, place int"


def brute_repair(rows):
    """rows: (role, text) in order. All sequences of edits that can be cheapest, tried one by one."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    found = []

    def go(i, cost, audit, out):
        roles = "".join(r[:1] or "?" for r, _ in out)
        if not re.fullmatch(r"(s?(ua)*u?)?", roles) or audit.count("I") > 4:
            return
        if i == len(rows) and (not out or re.fullmatch(r"s?(ua)+", roles)):
            found.append((cost, audit, out))
        if not audit.endswith("II"):
            for r in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (r, "")])
        if i == len(rows):
            return
        go(i + 1, cost + 2, audit + "D", out)
        if faults[i] in (0, 3):
            more = 5 * (faults[i] == 3)
            go(i + 1, cost + more, audit + "K", [*out, rows[i]])
            for r in ("user", "assistant"):
                go(i + 1, cost + more + 1, audit + "R", [*out, (r, rows[i][1])])

    go(0, 0, "", [])
    cost, audit, out = min(found, key=lambda f: f[:2])
    return cost, audit, out, faults


def chats(seed=0, n=60):
    rng = np.random.default_rng(seed)
    texts = ["Fine.", "Good!", "What?", "cut off", " ", "", "again.", "again."]
    return [[(str(rng.choice(["user", "assistant", "system", "user", "tool", ""])), str(rng.choice(texts)) + (str(k) + "." if rng.random() < 0.4 else "")) for k in range(rng.integers(1, 5))] for _ in range(n)]


def test_repair_is_the_cheapest(spark):
    all_ = chats()
    rows = [(c, t, role, text, 0) for c, chat in enumerate(all_) for t, (role, text) in enumerate(chat)]
    df = spark.createDataFrame(rows, CHAT).repartition(5)
    report = repair(df).cache()
    got = {r.conv_id: r for r in report.collect()}
    turns = {}
    for r in repaired_turns(df, report).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    assert len(got) == len(all_)
    for c, chat in enumerate(all_):
        cost, audit, out, faults = brute_repair(chat)
        assert (got[c].cost, got[c].audit) == (cost, audit), chat
        assert got[c].repaired_sha256 == sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        assert (got[c].blank, got[c].duplicate, got[c].truncated) == tuple(faults.count(f) for f in (1, 2, 3))
        assert got[c].illegal == sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(chat, chat[1:], strict=False))
        assert [(r, t) for _, r, t in sorted(turns.get(c, []))] == out


def test_repair_of_odd_rows(spark):
    rows = [
        (1, None, "user", "first.", 0), (1, 3, "assistant", "ok.", 0), (1, 7, "user", "more.", 0), (1, 7, "user", "more.", 0), (2, None, None, None, 0), (None, 5, "user", "no id.", 0),
        (None, 5, "assistant", "ok.", 0), (3, 1, "user", "x" * 300_000 + ".", 0), (3, 2, "assistant", "ö.", 0), (4, 9, "user", "gone.", 1),
    ]
    df = spark.createDataFrame(rows, CHAT).withColumns({"audit": F.lit(1), "cost": F.lit("x")})
    got = {r.conv_id: r for r in repair(df, F.col("place") == 0).collect()}
    empty = sha256(b"").hexdigest()
    assert got[1][1:8] == (3, 0, 1, 0, 1, 4, "KKDD") and got[2][1:8] == (0, 1, 0, 0, 0, 2, "D") and got[2].repaired_sha256 == empty
    assert got[None].audit == "DD" or got[None].cost == brute_repair([("assistant", "ok."), ("user", "no id.")])[0]  # one turn: by role
    assert got[3].audit == "KK" and got[3].repaired_sha256 == sha256(f"user:{rows[7][3]}\nassistant:ö.".encode()).hexdigest()
    assert got[4][1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert repair(df.limit(0)).collect() == []


def test_a_long_conversation_is_settled_as_it_streams():
    """Edits that all states share do not stay in them, and give the same repair."""
    rng = np.random.default_rng(1)
    rows = [(str(rng.choice(["user", "assistant", "system"], p=[0.5, 0.45, 0.05])), f"text {i}" + "." * int(rng.random() < 0.9), int(rng.choice([0, 0, 0, 1]))) for i in range(9000)]
    long = Conversation(1)
    for i, (role, text, fault) in enumerate(rows):
        long.add(i, role[0], role.encode(), text.encode(), fault)
        if i == 8999:
            assert max(len(s.edits) for s in long.best.values()) < 2500 and long.settled
    whole = Conversation(1)
    whole.put_aside = lambda: None
    for i, (role, text, fault) in enumerate(rows):
        whole.add(i, role[0], role.encode(), text.encode(), fault)
    assert long.close() == whole.close()


def test_repair_shuffles_once(spark):
    plan = repair(spark.createDataFrame([], CHAT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(conv_id" in plan


# --- licenses
def brute_places(text, templates):
    words, out = words_of(text), []
    for label, phrase, markup in templates:
        for i in range(len(words)):
            best, a = None, compiled(markup)
            states = a.reach[0]
            for j in range(i, len(words)):
                states = step(a, states, words[j])
                best = j + 1 if len(a.word) in states else best
            if best:
                out.append((label, phrase, i, best))
    return sorted(out)


def test_automata_accept_what_the_markup_says():
    markup = "all rights <<beginOptional>>are <<beginOptional>>hereby<<endOptional>> granted<<endOptional>> by <<var;max=2>> here"
    for text, fits in {
        "All rights by here": True, "all rights are granted by x here": True, "all rights are hereby granted by x y here": True, "all rights hereby granted by here": False,
        "all rights are by here": False, "all rights by x y z here": False, "all rights by x here.": True, "all right by here": False, "all rights (by) x, HERE": True,
    }.items():
        words = words_of(text)
        a, states = compiled(markup), compiled(markup).reach[0]
        for w in words:
            states = step(a, states, w)
        assert (len(a.word) in states) == fits == bool(re.fullmatch(pattern(markup), " ".join(words) + " ")), text
    for bad in ("", "<<beginOptional>>all<<endOptional>>", "<<var;max=3>> here", "all <<beginOptional>>rights"):
        with pytest.raises(ValueError):
            compiled(bad)


def test_license_scans(spark):
    rng = np.random.default_rng(0)
    own = [("a", False, "all rights <<beginOptional>>are<<endOptional>> by <<var;max=2>> here"), ("b", False, "<<beginOptional>>all<<endOptional>> rights here"), ("c", True, "all rights"), ("d", True, "here")]
    words = ["all", "All", "rights", "are", "by", "here", "é", "x1", "HERE,"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(200)] + [None, "", " .,- ", "all rights by here", "all rights by here"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, places string, N_WORDS int")
    got = {r.doc_id: r for r in scan_licenses(df, templates=own).collect()}
    for i, t in enumerate(texts):
        want = brute_places(t or "", own)
        assert sorted((p.label, p.phrase, p.first, p.end) for p in got[i].places) == want
        assert got[i].n_words == len(words_of(t or "")) and got[i].n_covered == len({w for *_, b, e in want for w in range(b, e)})
    assert scan_licenses(df.limit(0)).collect() == [] and scan_licenses(df).columns == ["doc_id", "n_words", "places", "n_covered"]


def test_every_license_finds_its_own_wording():
    """With all that may be left out, without it, with a word replaced, and in a very long text."""
    known = Templates(licenses.TEMPLATES)
    for label, phrase, markup in licenses.TEMPLATES:
        whole = re.sub(r"<<(begin|end)Optional>>", " ", re.sub(r"<<var;max=\d+>>", " some body ", markup))
        bare = re.sub(r"<<var;max=\d+>>", " ", markup)
        while "<<" in bare:
            bare = re.sub(r"<<beginOptional>>((?!<<).)*<<endOptional>>", " ", bare, flags=re.S)
        long = "lorem ipsum " * 20_000
        for text in (whole, bare, bare.upper(), long + bare + " " + long):
            words = scan(pa.array([text]), BETWEEN)
            found = list(known.places(known.numbers(words.hashes(fold=True)), words.doc, words.first))
            assert (label, phrase) in {(f[1], f[2]) for f in found}, markup
        must = words_of(bare)
        for i in (0, len(must) // 2, len(must) - 1):
            words = scan(pa.array([" ".join(must[:i] + ["zzz"] + must[i + 1 :])]), BETWEEN)
            found = [f for f in known.places(known.numbers(words.hashes(fold=True)), words.doc, words.first) if f[1:3] == (label, phrase) and f[4] - f[3] >= len(must)]
            assert not found


def test_shards_and_bins_do_not_depend_on_the_cluster(spark):
    """The same rows under 4 and 40 shuffle partitions."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["a", "bb", "ccc"], rng.integers(0, 90)))) for i in range(1300)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("4", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append((sorted(tuple(r) for r in shuffle_into_shards(docs, 8, seed=3).select("doc_id", "shard", "slot").collect()), sorted(tuple(r) for r in pack(docs).select("doc_id", "piece", "bin", "bin_start").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len({b for _, _, b, _ in seen[0][1]}) > 1
