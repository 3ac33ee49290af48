"""Registered queries on the smallest driver table, against their SQL where it is given; the pipeline stage by stage."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelight.llm import queries as llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = llm.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(llm.ORACLE_SQL[name]).fetchall()
    names = [d[0] for d in con.sql(llm.ORACLE_SQL[name]).description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out = spark.createDataFrame(out.collect(), out.schema)
        if name != "packing":
            assert out.columns == docs.columns
        if name in ("toxicity", "near dedup"):
            assert out.count() <= docs.count() and out.count() > 0.5 * before
        if name == "line dedup":
            assert out.count() == docs.count() and out.filter(F.char_length("text") != F.col("n_chars")).count() == 0
        if name == "mixing":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        if name == "packing":
            assert out.agg(F.sum("piece_tokens")).first()[0] > 0
        docs = out


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_on_odd_documents(spark, kind):
    """Empty tables, null and repeated ids, null and empty texts, in every stage."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(None, None, None, None, None), (None, "no id here at all", "en", "a", 17), (-1, "", None, None, 0), (-2, " \n\t", "en", "a", 3), (-3, "one two", "en", "b", 7), (-3, "one two", "en", "b", 7), (-4, "one two three", "de", None, 13)]
    docs = spark.createDataFrame(odd if kind == "odd" else [], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        if kind == "empty":
            assert out == []
        elif name == "near dedup":
            assert sorted(r.text or "" for r in out) == sorted({t or "" for _, t, *_ in odd})
        elif name in ("toxicity", "line dedup"):
            assert len(out) == len(odd), "clean documents stay"
        else:
            assert {r.doc_id for r in out} == {r[0] for r in odd}
