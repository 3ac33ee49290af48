"""The corpus pipeline: five stages, each on all rows that the one before kept.

STAGES' functions take (spark, docs, sf_dir) and return a DataFrame: toxic documents go; frequent lines go; of
near duplicates one document stays; sources are mixed (documents may come more than once, or not); documents are packed into
sequences. All but the last return the columns of documents.

Nulls, empty and long texts, ties, repeated rows and empty tables are defined by the operators; further columns pass
through all stages but the last.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.llm.common import settle
from framelight.llm.line_dedup import drop_frequent_lines
from framelight.llm.mixing import mix_sources
from framelight.llm.near_dedup import keep_one_of_each
from framelight.llm.packing import pack
from framelight.llm.toxicity import fit, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents of the input itself, as the query does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return score_toxicity(docs, model).filter("score < 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    kept = drop_frequent_lines(docs, min_docs=10, min_chars=1)
    columns = [F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
