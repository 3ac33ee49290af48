"""Toxicity by a support vector machine over a subsequence string kernel, with Nystroem landmarks.

The kernel of two words counts their common subsequences of four characters, each weighted by DECAY to the power
of its span (at most SPAN characters), so gaps and inserted characters cost a little and hide nothing; it is divided by what words
of those lengths have with themselves. The kernel of two sentences is the sum over their words. Landmarks are words of the
labelled sentences, and stems of words: beginnings that come more than once in far more toxic than other documents, whatever endings follow, so that languages
with few toxic documents and many inflected forms have their share. Characters that are no letters are left out first, and a sentence's Nystroem features are its kernels with the landmarks times K**-1/2. Single
characters that follow each other (i d i o t) are taken as one word.

A linear machine on these features is, multiplied out, one weight for each subsequence: scoring looks
them up and never computes a kernel against a landmark. A word's value counts as far as it exceeds what one clean
word in 10,000 (or 1,000, or 100, whichever suits the labels best) reaches, and a sentence's score is the sum of its words'. A document's score is a logistic function of its three highest
sentence scores, of how many of its words exceed that value and of their share of all its words, fitted on the same labelled documents.

Labels are of documents: a toxic document's positive sentences are those that hold a word or stem far commoner in
toxic documents, later those that the machine itself finds (two rounds). Learning takes at most ``max_toxic`` toxic and
``max_clean`` other documents, those of least hash, and ``max_bytes`` of text in all, in one task; the driver gets the finished
table of 4 MB. Scoring reads every whole text. The fit has these bounds besides, all parameters of ``train``: ``landmarks`` (192) landmarks in all, up to a third of
them stems and up to a third usual words, drawn from the ``usual_words`` (4,000) commonest of other documents; ``max_sentences`` (12,000) sentences
of each of three kinds (of clean documents; of toxic ones with a sign, without one), of documents in random order. They bound what is learned from, not what is scored.

Defined cases: null is the empty text and scores as a document without sentences; with no toxic or no clean
labelled document every score is the toxic share (0 if there are no labels); null labels do not count; ids may repeat (of the rows
that share a labelled id the one of least text is learned from, all are scored); a labelled text that does not fit in what is left of
``max_bytes`` is not learned from; an empty table gives no rows.
"""

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.llm.words import Words, flat, scan, slices

DECAY, SPAN = 0.85, 7
FLOORS = 1e-4, 1e-3, 1e-2  # shares of clean words whose values may count
STEMS = range(4, 13)  # lengths of stems, in bytes
FEATURES = 5  # of a document: its highest sentence scores and its hits
SYMBOL = np.zeros(256, np.int32)  # 32 symbols: letters without case, parts of other letters; 0 is no letter
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = 28 + np.arange(128) % 4
TABLE = 1 << 20  # subsequences of four symbols
CHOICES = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]  # places of the later characters after the first


def self_kernel(n: np.ndarray) -> np.ndarray:
    """A word's kernel with itself, by its length (as if no subsequence came twice), to the power of 1/2."""
    return np.sqrt(np.maximum(sum(np.maximum(n - c, 0) * DECAY ** (2 * (c + 1)) for _, _, c in CHOICES), 1e-12))


def pieces(text: pa.Array) -> tuple[np.ndarray, ...]:
    """Letters of all texts, and words as the kernel sees them: start, end, document, and whether a sentence ends there."""
    w = scan(text)
    if not len(w.start):
        return w.data, w.start, w.end, w.doc, np.zeros(0, bool)
    single = w.end - w.start == 1
    head = np.ones(len(single), bool)
    head[1:] = ~(single[1:] & single[:-1] & (w.doc[1:] == w.doc[:-1]))
    head = np.flatnonzero(head)
    tail = np.append(head[1:], len(single)) - 1
    lines = np.cumsum(w.data == 10)
    ends = np.isin(w.data[w.end[tail] - 1], np.frombuffer(b".!?", np.uint8))
    ends[:-1] |= (lines[w.start[head[1:]]] != lines[w.end[tail[:-1]] - 1]) | (w.doc[head[1:]] != w.doc[head[:-1]])
    ends[-1] = True
    letter = SYMBOL[w.data] > 0
    at = np.concatenate([[0], np.cumsum(letter)])
    return w.data[letter], at[w.start[head]], at[w.end[tail]], w.doc[head], ends


def subsequences(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, float]]:
    """For each span: numbers of the subsequences from every byte, whether they stay in a word, weight."""
    last = SYMBOL[data]
    third, second, first = last << 5, last << 10, last << 15
    limit = np.zeros(len(data), np.int64)
    limit[start[end > start]] = end[end > start]
    limit = np.maximum.accumulate(limit) - np.arange(len(data))  # bytes left in the word
    for c in range(3, SPAN):
        n = len(data) - c
        if n <= 0:
            return
        ends = first[:n] + last[c:]
        yield [ends + second[a : a + n] + third[b : b + n] for b in range(2, c) for a in range(1, b)], limit[:n] > c, DECAY ** (c + 1)


def word_values(text: pa.Array, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of texts: its first text, and of all words the text, the value, and whether a sentence ends there."""
    for low, high in slices(text):
        data, start, end, doc, ends = pieces(text.slice(low, high - low))
        at = np.zeros(len(data) + 1)
        for numbers, inside, decay in subsequences(data, start, end):
            at[1 : len(inside) + 1] += inside * sum(weight[x] for x in numbers) * decay
        sums = np.cumsum(at)
        yield low, doc, (sums[end] - sums[start]) / self_kernel(end - start), ends


def sentence_scores(n: int, values: Iterable[tuple[int, np.ndarray, np.ndarray, np.ndarray]], floor: float) -> np.ndarray:
    """A document's three highest sentence scores, 0 where there is no sentence: what its words' values exceed the floor by;
    and its hits, the words of a value above it: the logarithm of 1 + their number, and their number among a hundred words."""
    out = np.zeros((n, FEATURES))
    for low, doc, value, ends in values:
        if not len(doc):
            continue
        head = np.append(0, np.flatnonzero(ends)[:-1] + 1)
        sentence, owner = np.add.reduceat(np.maximum(value - floor, 0), head), doc[head]
        order = np.lexsort((-sentence, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        top = place < 3
        out[low + owner[order][top], place[top]] = sentence[order][top]
        words, hits = np.bincount(doc), np.bincount(doc, value > floor)
        out[low : low + len(words), 3] = np.log1p(hits)
        out[low : low + len(words), 4] = 100 * hits / np.maximum(words, 1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the constant, by Newton's method with a little shrinkage."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: float = 1000.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine for y of +1 and -1, both classes of equal weight: squared hinge loss, by Newton's method."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    z = np.column_stack([x, np.ones(len(x))])
    shrink, w, old = np.diag(np.append(np.ones(x.shape[1]), 1e-3)), np.zeros(z.shape[1]), None
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        if old is not None and (inside == old).all():
            break
        old, part = inside, z[inside] * c[inside, None]
        w = np.linalg.solve(shrink + part.T @ z[inside], part.T @ y[inside])
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, weight: np.ndarray, floor: float, final: np.ndarray):
        self.weight, self.floor, self.final = weight, floor, final

    def score(self, text: pa.Array) -> np.ndarray:
        return self.final_score(sentence_scores(len(text), word_values(text, self.weight), self.floor))

    def final_score(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.final[:FEATURES] + self.final[FEATURES], -30, 30)))


def train(texts: pa.Array, toxic: np.ndarray, landmarks: int = 192, max_sentences: int = 12_000, usual_words: int = 4_000, seed: int = 5) -> Model:
    """texts: without nulls; toxic: booleans. A bounded sample, all in one task."""
    if not toxic.any() or toxic.all():
        share = float(toxic.mean()) if len(toxic) else 0.0
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(np.zeros(TABLE, np.float32), 0.0, np.array([*[0] * FEATURES, odds]))
    rng = np.random.default_rng(seed)
    # words by hash, and in how many documents of either kind they are
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    (bad, n_bad), (good, n_good) = (np.unique(np.concatenate([h for i, h in document_words(texts) if toxic[i] == kind]), return_counts=True) for kind in (True, False))
    at = np.minimum(np.searchsorted(good, bad), max(0, len(good) - 1))
    elsewhere = np.where(good[at] == bad, n_good[at], 0) if len(good) else np.zeros(len(bad))
    odds = np.log((n_bad + 0.1) / (n1 + 1)) - np.log((elsewhere + 0.1) / (n0 + 1))
    enough = np.flatnonzero(n_bad >= max(2, round(0.002 * n1)))
    enough = enough[np.argsort(-odds[enough] * np.sqrt(n_bad[enough]), kind="stable")]
    usual = good[np.argsort(-n_good, kind="stable")[:usual_words]]
    usual = usual[rng.permutation(len(usual))[: landmarks // 3]]
    stems = telling_stems(texts, toxic, landmarks // 3)
    told = bad[enough[: landmarks - len(usual) - len(stems)]]
    spelled = spellings(texts, np.concatenate([told, usual, bad[enough[odds[enough] > 2.5]]]))
    signs = {spelled[h] for h in bad[enough[odds[enough] > 2.5]].tolist()}
    chosen = list(dict.fromkeys([*stems, *(spelled[h] for h in [*told.tolist(), *usual.tolist()])]))
    begins = tuple(stems)
    # landmarks' features, on the subsequences that any of them has
    marks = chosen
    joined = np.frombuffer(b" ".join(marks), np.uint8)
    size = np.array([len(w) for w in marks])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    owner = np.repeat(np.arange(len(marks)), size + 1)[: len(joined)]
    got = [(owner[: len(i)][i], n[i], np.full(int(i.sum()), d)) for numbers, i, d in subsequences(joined, start, start + size) for n in numbers]
    of, number, value = (np.concatenate(x) for x in zip(*got, strict=True))
    active, column = np.unique(number, return_inverse=True)
    f = len(active)
    rows = np.bincount(of * f + column, value, len(marks) * f).reshape(len(marks), f) / self_kernel(size)[:, None]
    k = rows @ rows.T
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    project = rows.T @ (vectors[:, good] / np.sqrt(values[good]) @ vectors[:, good].T)  # from subsequences to Nystroem features
    # labelled sentences: of clean documents, and those of toxic ones that hold a sign
    clean, marked, other = [], [], []
    for i in rng.permutation(len(texts)):
        for sentence in _sentences(texts[int(i)].as_buffer().to_pybytes()):
            if not toxic[i]:
                kind = clean
            elif any(x in signs or x.startswith(begins) for x in (NO_LETTER.sub(b"", w.lower()) for w in sentence.split())):
                kind = marked
            else:
                kind = other
            if len(kind) < max_sentences:  # of documents in random order
                kind.append(sentence)
        if all(len(kind) >= max_sentences for kind in (clean, marked, other)):
            break
    x0, x1 = (_features(s, active, f, project) for s in (clean, marked or other))
    u, bias = squared_hinge(np.vstack([x0, x1]), np.repeat([-1.0, 1.0], [len(x0), len(x1)]))
    if other and marked:  # sentences without a sign that the machine finds
        more = _features(other, active, f, project)
        more = more[more @ u + bias > 0.5]
        u, bias = squared_hinge(np.vstack([x0, x1, more]), np.repeat([-1.0, 1.0], [len(x0), len(x1) + len(more)]))
    weight = np.zeros(TABLE, np.float32)
    weight[active] = project @ u
    del clean, marked, other, rows, project, x0, x1
    # a clean word's value is noise up to what few of them exceed: how few, the labels tell
    values = [(low, doc, value.astype(np.float32), ends) for low, doc, value, ends in word_values(texts, weight)]
    harmless = np.concatenate([value[~toxic[low + doc]] for low, doc, value, _ in values])
    best = None
    for share in FLOORS:
        floor = max(0.0, float(np.quantile(harmless, 1 - share))) if len(harmless) else 0.0
        top = sentence_scores(len(texts), values, floor)
        model = Model(weight, floor, logistic(top, toxic.astype(float)))
        loss = -np.log(np.maximum(np.where(toxic, p := model.final_score(top), 1 - p), 1e-9)).mean()
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


NO_LETTER = re.compile(rb"[^a-z\x80-\xff]")


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """Words of 4 to 24 letters: hash, document, and place among the letters."""
    data, start, end, doc, _ = pieces(texts)
    fit = (end - start >= 4) & (end - start <= 24)
    words = Words(data, start[fit], end[fit], start[fit], doc[fit])
    return words.hashes(fold=True), doc[fit], words


def document_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text the different words of 4 to 24 letters, by hash."""
    for low, high in slices(texts):
        h, doc, _ = hashed(texts.slice(low, high - low))
        at = np.searchsorted(doc, np.arange(high - low + 1))
        yield from ((low + i, np.unique(h[at[i] : at[i + 1]])) for i in range(high - low))


def beginnings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """Of words of 4 to 24 letters all beginnings of a stem's length: hash, document (ascending), and place among the letters."""
    _, _, words = hashed(texts)
    got, whole = [], np.append(words.data, 0) & 0xC0 != 0x80  # no character is cut
    for size in STEMS:
        long = np.flatnonzero(words.end - words.start >= size)
        long = long[whole[words.start[long] + size] | (words.end[long] - words.start[long] == size)]
        got.append(Words(words.data, words.start[long], words.start[long] + size, long, words.doc[long]))
    h, start, end, doc = (np.concatenate(x) for x in zip(*((w.hashes(fold=True), w.start, w.end, w.doc) for w in got), strict=True))
    order = np.argsort(doc, kind="stable")
    return h[order], doc[order], Words(words.data, start[order], end[order], start[order], doc[order])


def telling_stems(texts: pa.Array, toxic: np.ndarray, most: int) -> list[bytes]:
    """Stems that more than one word of a document begins with in far more toxic than other documents: of longer and shorter ones
    the longest that nine tenths of the shorter one's toxic documents have."""
    often = {True: [], False: []}
    for low, high in slices(texts):
        h, doc, _ = beginnings(texts.slice(low, high - low))
        at = np.searchsorted(doc, np.arange(high - low + 1))
        for i in range(high - low):
            found, times = np.unique(h[at[i] : at[i + 1]], return_counts=True)
            often[bool(toxic[low + i])].append(found[times > 1])
    (bad, n_bad), (good, n_good) = (np.unique(np.concatenate(often[kind]), return_counts=True) for kind in (True, False))
    at = np.minimum(np.searchsorted(good, bad), max(0, len(good) - 1))
    elsewhere = np.where(good[at] == bad, n_good[at], 0) if len(good) else np.zeros(len(bad))
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    odds = np.log((n_bad + 0.1) / (n1 + 1)) - np.log((elsewhere + 0.1) / (n0 + 1))
    chance = (n_bad + elsewhere) * n1 / (n1 + n0)  # toxic documents, if it told nothing
    clear = (odds > 2) & (n_bad > chance + 4 * np.sqrt(chance + 1)) | (odds > 2.5) & (n_bad > 4) & (elsewhere == 0)
    worth = dict(zip(bad[clear].tolist(), zip((odds * np.sqrt(n_bad))[clear].tolist(), n_bad[clear].tolist(), strict=True), strict=True))
    spelled = {}
    for low, high in slices(texts):
        h, _, words = beginnings(texts.slice(low, high - low))
        h, first = np.unique(h, return_index=True)
        for i in np.flatnonzero(np.isin(h, bad[clear])).tolist():
            spelled.setdefault(words.data[words.start[first[i]] : words.end[first[i]]].tobytes().lower(), worth[int(h[i])])
    longest = [s for s, (_, n) in spelled.items() if not any(t != s and t.startswith(s) and m >= 0.9 * n for t, (_, m) in spelled.items())]
    first = [s for s in longest if not any(t != s and s.startswith(t) for t in longest)]
    return sorted(first, key=lambda s: (-spelled[s][0], s))[:most]


def spellings(texts: pa.Array, wanted: np.ndarray) -> dict[int, bytes]:
    """The words of these hashes, lower case in A-Z."""
    out, wanted = {}, np.unique(wanted)
    for low, high in slices(texts):
        h, _, words = hashed(texts.slice(low, high - low))
        h, first = np.unique(h, return_index=True)
        for i in np.flatnonzero(np.isin(h, wanted)).tolist():
            out.setdefault(int(h[i]), words.data[words.start[first[i]] : words.end[first[i]]].tobytes().lower())
    return out


def _sentences(text: bytes) -> list[bytes]:
    """As pieces() cuts them: after a word that ends in . ! or ? and at line ends."""
    return [part for line in text.split(b"\n") for part in re.split(rb"(?<=[.!?])[\x20\t\x0b-\r]+", line) if part.strip()]


def _features(sentences: list[bytes], active: np.ndarray, f: int, project: np.ndarray) -> np.ndarray:
    where = np.full(TABLE, -1, np.int64)
    where[active] = np.arange(f)
    out = np.zeros((len(sentences), project.shape[1]))
    for low in range(0, len(sentences), 64):
        texts = pa.array([s.decode("utf-8", "replace") for s in sentences[low : low + 64]])
        data, start, end, doc, _ = pieces(texts)
        if not len(start):
            continue
        word = np.repeat(np.arange(len(start)), end - start)
        norm, cells, values = 1 / self_kernel(end - start), [], []
        for numbers, inside, decay in subsequences(data, start, end):
            for number in numbers:
                column = where[number]
                hit = np.flatnonzero(inside & (column >= 0))
                cells.append(doc[word[hit]] * np.int64(f) + column[hit])
                values.append(decay * norm[word[hit]])
        total = np.bincount(np.concatenate(cells), np.concatenate(values), len(texts) * f).reshape(len(texts), f) if cells else np.zeros((len(texts), f))
        out[low : low + len(texts)] = total @ project
    return out


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_toxic: int = 2000, max_clean: int = 3000, max_bytes: int = 32 << 20,
) -> Model:
    """learn: a condition on labels' rows. At most max_toxic + max_clean documents and max_bytes of text meet in one task,
    which sends the model to the driver."""
    told = labels.filter(learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    told = told.withColumn("h", F.xxhash64(F.lit(4), "id"))
    taken = told.filter("y = 1").orderBy("h", "id").limit(max_toxic).unionByName(told.filter("y = 0").orderBy("h", "id").limit(max_clean))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(taken), "id")  # max_toxic + max_clean ids
    sample = rows.groupBy("id", "y", "h").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions("h", "id")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, room = [], max_bytes
        for b in batches:
            for i, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                size = len(x.as_buffer())
                if size <= room:
                    got.append((i, y == 1, x.as_py()))
                    room -= size
        got.sort(key=lambda x: x[0])
        toxic, texts = np.array([y for _, y, _ in got], bool), pa.array([x for _, _, x in got], pa.string())
        del got
        model = train(texts, toxic)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.floor]), pa.array([model.final.tolist()])], ["weight", "floor", "final"])

    row = sample.select("id", "y", "h", "text").mapInArrow(learned, "weight binary, floor double, final array<double>").collect()
    if not row:  # no labelled text at all
        return train(pa.array([], pa.string()), np.zeros(0, bool))
    return Model(np.frombuffer(bytes(row[0]["weight"]), np.float32), row[0]["floor"], np.array(row[0]["final"]))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' columns and score double; a column named so before is replaced."""
    kept = [c for c in docs.columns if c.lower() != "score"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(text, F.lit("")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)), pa.float64())], ["row", "score"])

    return rows.mapInArrow(score, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])).select("row.*", "score")
