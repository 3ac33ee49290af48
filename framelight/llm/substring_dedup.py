"""Substring dedup by relative Lempel-Ziv parsing.

The corpus, in ascending order of doc_id, is cut into reference blocks (ranges of ids of about equal bytes). Every window of
``window`` consecutive words of every block is indexed by hash, with the first place (block, and word in the block) that holds
it; the index is spread over hash blocks. Each document is then parsed greedily against all indexed blocks at once: a factor begins at
a window that stands in an earlier document, and runs on word by word while the next window's reference is the next place of the
same block; so a factor stands as a whole, in one piece, at that place of the reference. It has ``window`` words or more and becomes a
duplicate span. Where it ends (no reference, or from here on another document was the first to hold the text), the windows that straddle its
end are looked up as well, so that the next factor may begin there and overlap it. All words of factors go.

A block asks for each different window once, however many of its documents hold it, so a passage of a third of all
documents costs as many entries as there are blocks. Windows are compared by 64-bit hashes: two different
windows of n have the same with odds of n**2 / 2**65.

Defined cases: null is the empty text; documents shorter than a window stay whole; rows that share a doc_id
do not remove each other's words; rows whose doc_id is null stay whole and remove nothing; an empty table gives no rows.
"""

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.llm.common import exchange_bytes, ranges, shuffle_partitions, total_bytes
from framelight.llm.hash_blocks import cuts, distinct, pack, unpack
from framelight.llm.words import flat, scan, slices, windows


def chunk_windows(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes, the word each begins at, each text's first word (counted through the chunk), words."""
    found, begins, first, base = [], [], [np.zeros(1, np.int64)], 0
    for low, high in slices(texts):
        words = scan(texts.slice(low, high - low))
        h, whole = windows(words.hashes(), words.doc, k)
        found.append(h[whole])
        begins.append(np.flatnonzero(whole) + base)
        first.append(words.first[1:] + base)
        base += len(words.start)
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate([np.zeros(0, np.int64), *begins]), np.concatenate(first), np.array(base)


def by_id(chunk: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The ids in ascending order (empty, if they are null), and the texts in that order."""
    ids = chunk["id"].combine_chunks()
    if ids.null_count:
        return np.zeros(0, np.int64), flat(chunk["text"])
    ids = ids.to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat(chunk["text"].take(pa.array(order)))


def drop_repeated_windows(df: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), factors (start and number of words, the
    reference block that holds them, and the word of the block where they begin there). block_bytes: of text in a block, by default from the input's size."""
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    total = total_bytes(rows)
    block, n_chunks = ranges(rows, "id", math.ceil(total / (block_bytes or exchange_bytes(total))))
    n_blocks = n_chunks
    chunk = F.when(F.col("id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(n_chunks))).otherwise(block).cast("int")
    chunks = rows.select(chunk.alias("chunk"), "id", "text").repartition(max(n_chunks, shuffle_partitions(spark)), "chunk")

    def ask(chunk: pa.Table) -> pa.Table:
        number = chunk["chunk"][0].as_py()
        asked = {"block": [], "chunk": [], "n": [], "hashes": [], "places": []}
        if number >= 0:
            _, texts = by_id(chunk)
            h, begins, _, _ = chunk_windows(texts, window)
            ordered, first, _ = distinct(h)
            at, place = cuts(ordered, n_blocks), begins[first].astype(np.uint32)
            for b in np.flatnonzero(np.diff(at)).tolist():
                for name, x in (("block", b), ("chunk", number), ("n", at[b + 1] - at[b]), ("hashes", pack(ordered[at[b] : at[b + 1]])), ("places", pack(place[at[b] : at[b + 1]]))):
                    asked[name].append(x)
        return pa.table(asked, schema=pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary())]))

    def answer(block: pa.Table) -> pa.Table:
        block = block.sort_by("chunk")
        ns, numbers = block["n"].to_pylist(), block["chunk"].to_numpy().astype(np.int32)
        got = lambda name, kind: np.concatenate([unpack(x.as_py(), n, kind) for x, n in zip(block[name], ns, strict=True)])
        _, first, number = distinct(got("hashes", np.uint64))
        source, place = np.repeat(numbers, ns)[first][number], got("places", np.uint32)[first][number]
        source[first], place[first] = -1, 0  # nothing comes before the first
        at = np.concatenate([[0], np.cumsum(ns)])
        part = lambda x: pa.array([pack(x[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
        return pa.table({"chunk": numbers, "block": block["block"].combine_chunks(), "n": block["n"].combine_chunks(), "sources": part(source), "places": part(place)})

    def parse(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        number = chunk["chunk"][0].as_py() if chunk.num_rows else -1
        ids, texts = by_id(chunk)
        h, begins, first, n_words = chunk_windows(texts, window)
        source, place = np.full(len(h), -1, np.int32), np.zeros(len(h), np.int64)
        if number >= 0 and len(h):
            _, at, same = distinct(h)
            answers = answers.sort_by("block")
            told = lambda name, kind: np.concatenate([unpack(x.as_py(), n.as_py(), kind) for x, n in zip(answers[name], answers["n"], strict=True)])[same]
            source, place = told("sources", np.int32), told("places", np.uint32).astype(np.int64)
            doc = np.searchsorted(first, begins, "right") - 1
            inside = (source < 0) & (ids[doc] > ids[doc[at]][same])  # in an earlier document of the block itself
            source[inside], place[inside] = number, begins[at][same][inside]
        # a factor runs on while the next window of the document is the next one of its reference
        hit = np.flatnonzero(source >= 0)
        here, of, there = begins[hit], source[hit], place[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (here[1:] != here[:-1] + 1) | (of[1:] != of[:-1]) | (there[1:] != there[:-1] + 1)
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(hit))) + window - 1
        step = np.zeros(int(n_words) + 1, np.int32)
        np.add.at(step, here[head], 1)
        np.add.at(step, here[head] + length, -1)
        keep = np.cumsum(step)[: int(n_words)] == 0
        owner = np.searchsorted(first, here[head], "right") - 1
        columns = {"start": pa.array(here[head] - first[owner], pa.int64()), "words": pa.array(length, pa.int64()), "block": pa.array(of[head], pa.int32()), "block_start": pa.array(there[head], pa.int64())}
        factors = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        factors = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32()), factors)
        kept, removed = [], []
        for i in range(len(texts)):
            words = texts[i].as_buffer().to_pybytes().split()
            part = keep[first[i] : first[i + 1]]
            gone = len(words) - int(part.sum())
            kept.append(b" ".join(compress(words, part) if gone else words).decode())
            removed.append(gone)
        out = pa.array(ids) if len(ids) or not len(texts) else pa.nulls(len(texts), pa.int64())
        return pa.table({"doc_id": out.cast(pa.int64()), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "factors": factors})

    asked = chunks.groupBy("chunk").applyInArrow(ask, "block int, chunk int, n long, hashes binary, places binary")
    answers = asked.groupBy("block").applyInArrow(answer, "chunk int, block int, n long, sources binary, places binary")
    kinds = {"start": T.LongType(), "words": T.LongType(), "block": T.IntegerType(), "block_start": T.LongType()}
    span = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in kinds.items()]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("factors", span)])
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(parse, schema)
