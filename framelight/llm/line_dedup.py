"""Line dedup over a whole corpus.

Every text is split at newlines; a line's key is the line stripped of ASCII whitespace and lower-cased in
A-Z, hashed to 128 bits. Documents are counted per key, each task adding up its own documents first. Keys
in at least ``min_docs`` documents lose all their lines: lines are exploded with their positions and keys, those with a frequent
key become positions lost, and each text is put together again from the positions that stay. Lines meet
the frequent keys in one join, in which the HOT most frequent keys are salted by document: no task gets all documents of a
line that a third of them hold. Any other key has at most a part of 1 / HOT of all pairs of document and key. A text's place in
that join is its id and a hash of 64 bits, so rows that share an id and differ in text stay apart.

Defined cases: null and empty texts are one empty line and come back as they were; keys shorter than ``min_chars`` code points
never count; a document that holds a line twice counts once; rows that share an id count as
documents of their own and lose the same keys; an id may be null; an empty table gives no rows; further
columns pass through, but those named ``n_lines`` or ``n_dropped`` are replaced.
"""

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.llm.common import settle, shuffle_partitions

HOT = 1000  # keys that are salted; all that the driver gets


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes, or None for a line too short to count. bytes.strip and bytes.lower are ASCII-only."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def text_keys(text: str | None, min_chars: int) -> set[bytes]:
    keys = {line_key(x, min_chars) for x in (text or "").encode().split(b"\n")}
    keys.discard(None)
    return keys


def frequent_keys(df: DataFrame, min_docs: int, min_chars: int, text: str = "text") -> DataFrame:
    """Keys (column ``key``) found in at least min_docs documents, and in how many (``docs``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for x in batch.column(0):
                seen.update(text_keys(x.as_py(), min_chars))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["key", "docs"])

    return df.select(text).mapInArrow(count, "key binary, docs long").groupBy("key").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)


def drop_frequent_lines(df: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df's columns, its text without the lines whose keys are frequent, and n_lines, n_dropped."""
    rest = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped", text.lower())]
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.xxhash64(F.lit(9), text).alias("mark"))

    frequent = settle(frequent_keys(rows, min_docs, min_chars))
    hot = frozenset(bytes(r["key"]) for r in frequent.orderBy(F.desc("docs"), "key").limit(HOT).collect())
    salts = shuffle_partitions(df.sparkSession)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, found, salt = [], [], [], []
            for i, (x, s) in enumerate(zip(batch.column(1), batch.column(3).to_pylist(), strict=True)):
                for p, line in enumerate((x.as_py() or "").encode().split(b"\n")):
                    key = line_key(line, min_chars)
                    if key is not None:
                        at.append(i)
                        pos.append(p)
                        found.append(key)
                        salt.append(s if key in hot else 0)
            of = pa.array(at, pa.int64())
            columns = [batch.column(0).take(of), batch.column(2).take(of), pa.array(pos, pa.int32()), pa.array(found, pa.binary()), pa.array(salt, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "pos", "key", "salt"])

    line_schema = T.StructType([
        rows.schema["id"], rows.schema["mark"], T.StructField("pos", T.IntegerType()),
        T.StructField("key", T.BinaryType()), T.StructField("salt", T.IntegerType()),
    ])
    salted = rows.select("id", "text", "mark", F.pmod(F.xxhash64(F.lit(8), "id", "text"), F.lit(salts)).cast("int").alias("salt"))
    exploded = salted.mapInArrow(lines, line_schema)
    salty = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in sorted(hot)], "key binary").withColumn("last", F.lit(salts - 1)))  # HOT rows at most
    wanted = frequent.join(salty, "key", "left").select("key", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("salt"))
    gone = exploded.join(wanted, ["key", "salt"], "left_semi")
    lost = gone.groupBy(F.col("id").alias("lost_id"), F.col("mark").alias("lost_mark")).agg(F.collect_set("pos").alias("lost"))
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("mark") == F.col("lost_mark"))
    joined = rows.join(lost, same, "left").select("row", "text", "lost")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, drops = [], [], []
            for x, lost in zip(batch.column(1), batch.column(2), strict=True):
                whole = x.as_py()
                gone = set(lost.as_py() or ())
                lines = (whole or "").encode().split(b"\n")
                kept = [y for at, y in enumerate(lines) if at not in gone] if gone else lines
                texts.append(b"\n".join(kept).decode() if len(kept) < len(lines) else whole)
                counts.append(len(lines))
                drops.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    done = joined.mapInArrow(rebuild, schema)
    out = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns if c == text or c in rest]
    return done.select(*out, "n_lines", "n_dropped")
