"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.llm.common import table
from framelight.llm.conversations import repair
from framelight.llm.fingerprints import edited_fingerprints
from framelight.llm.hard_negatives import mine
from framelight.llm.licenses import TEMPLATES, compiled, first_pairs, pattern, scan_licenses
from framelight.llm.line_dedup import drop_frequent_lines
from framelight.llm.lm_scoring import score_documents
from framelight.llm.mixing import mix_sources
from framelight.llm.near_dedup import near_duplicates
from framelight.llm.neighbours import nearest
from framelight.llm.packing import pack
from framelight.llm.sharding import shuffle_into_shards
from framelight.llm.substring_dedup import drop_repeated_windows
from framelight.llm.toxicity import fit, score_toxicity


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(docs, 8, seed=20).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.encode("kept_text", "UTF-8"), 256)
    return drop_repeated_windows(docs, window=13).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "weight", "n_tokens", "epoch", "place")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return drop_frequent_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", F.hex("label").alias("class_label"), "n_links", "nearest_id", "similarity")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with what the contract breaks in them; ``present`` is false where a row is dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("h"))
    broken = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), broken.alias("text"), (F.col("h") != 0).alias("present"), times.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), F.col("present"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p["phrase"])
    first = F.transform(base, lambda p: p["first"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        names(base).alias("base_labels"), names("places").alias("labels"), (F.col("n_covered") / F.greatest(F.col("n_words"), F.lit(1))).alias("score"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13),
grams AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM starts),
firsts AS (SELECT gram, min(doc_id) AS first_id FROM grams GROUP BY gram),
hits AS (SELECT doc_id, i FROM grams JOIN firsts USING (gram) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hits)),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept_text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs), keyed AS (
  SELECT r, doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (key) GROUP BY r, doc_id
"""

OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r AS other, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS slot FROM s WHERE same QUALIFY slot <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, slot ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""

_CRC = "[" + ", ".join(str(zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0")) for b in range(256)) + "]"
OP12_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), bytes AS (SELECT * EXCLUDE (key), list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)) AS b, {_CRC}::BIGINT[] AS t FROM raw
), hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 20 AS h FROM bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h > 0
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS times,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
  FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)
), j AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN ending = '' THEN 'b' WHEN times > 1 THEN 'd' WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM seen
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id
), moves AS (
  SELECT f, f AS t, 'D' AS edit, 2 AS price, '' AS ins FROM (VALUES (''), ('s'), ('u'), ('a')) v(f) UNION ALL
  SELECT f, t, edit, price + 5 * len(ins), ins FROM (VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'a', ''), ('u', 'u', 'a'), ('a', 'u', ''), ('a', 'a', 'u')) v(f, t, ins), (VALUES ('K', 0), ('R', 1)) e(edit, price)
  WHERE t <> 's' OR edit = 'K'
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, 0 AS cost, '' AS audit, '' AS fixed FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, state, cost, audit, fixed FROM (
    SELECT dp.conv_id, j.i, t AS state, cost + price + CASE WHEN fault = 't' AND edit <> 'D' THEN 5 ELSE 0 END AS cost, audit || repeat('I', len(ins)) || edit AS audit,
           CASE WHEN edit = 'D' THEN fixed ELSE fixed || CASE WHEN state <> '' THEN chr(10) ELSE '' END || CASE ins WHEN 'u' THEN 'user:' || chr(10) WHEN 'a' THEN 'assistant:' || chr(10) ELSE '' END
             || CASE WHEN edit = 'K' THEN role WHEN t = 'u' THEN 'user' ELSE 'assistant' END || ':' || text END AS fixed
    FROM dp JOIN j ON dp.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = dp.i + 1 JOIN moves ON f = state
    WHERE edit = 'D' OR fault NOT IN ('b', 'd') AND (edit = 'R' OR initial = t)
    QUALIFY row_number() OVER (PARTITION BY dp.conv_id, t ORDER BY cost + price + CASE WHEN fault = 't' AND edit <> 'D' THEN 5 ELSE 0 END, audit || repeat('I', len(ins)) || edit) = 1
  )
), ends AS (
  SELECT dp.conv_id, cost + 5 * len(ins) AS cost, audit || repeat('I', len(ins)) AS audit, fixed || CASE ins WHEN 'ua' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END AS fixed
  FROM dp LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN (VALUES ('', ''), ('s', 'ua'), ('u', 'a'), ('a', '')) v(f, ins) ON f = state WHERE i = coalesce(n, 0)
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost + 5 * len(ins), audit || repeat('I', len(ins))) = 1
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(fixed) AS repaired_sha256
FROM ends e LEFT JOIN facts f ON e.conv_id IS NOT DISTINCT FROM f.conv_id
"""

_LONGEST = max(len(compiled(markup).word) for _, _, markup in TEMPLATES)
_FIRST = sorted({x for _, _, markup in TEMPLATES for x, _ in first_pairs(compiled(markup))})
_PLACES = " UNION ALL ".join(f"SELECT r, '{label}' AS label, {str(phrase).lower()} AS phrase, i, regexp_extract(rest, '^(?:{pattern(markup)})') AS m FROM starts" for label, phrase, markup in TEMPLATES)
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
starts AS (SELECT r, i, array_to_string(words[i:i + {_LONGEST}], ' ') || ' ' AS rest FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d) WHERE list_contains({_FIRST}, words[i])),
places AS (SELECT r, label, phrase, i - 1 AS first, i - 1 + length(m) - length(replace(m, ' ', '')) AS past FROM ({_PLACES}) WHERE m <> ''),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(first, past)) AS p FROM places) GROUP BY r),
found AS (
  SELECT r, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(n, 0) AS DOUBLE) / greatest(len(words), 1) AS score
FROM d LEFT JOIN found USING (r) LEFT JOIN covered USING (r)
"""

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_neighbours": op7_neighbours,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scans": op13_license_scans,
}
ORACLE_SQL = {"op2_substring_dedup": OP2_SQL, "op5_line_dedup": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_license_scans": OP13_SQL}
