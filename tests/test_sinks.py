"""Exports and the stream, through the file system and back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from framelight.functions.fixed_values import AUDIT_COLUMNS
from framelight.sinks.reports import as_text_cell, csv_bytes, html_report, page_zip, read_csv, review_folders, write_csv
from framelight.sinks.versions import Versions
from framelight.streaming.audit_stream import upsert_stream


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([("Home", "Ovens", f"Page {i}", f'na"me, {i}\nx <b>') for i in (10, 2, 1)], "main_category string, subcategory string, page_label string, product_name string")
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in AUDIT_COLUMNS])


def test_csv(spark, rows, tmp_path):
    write_csv(rows, f"file://{tmp_path}/a")
    back = read_csv(spark, f"file://{tmp_path}/a", [*AUDIT_COLUMNS, "new_column"])
    assert sorted(r.product_name for r in back.collect()) == sorted(r.product_name for r in rows.collect()) and back.first().new_column == ""
    assert csv_bytes(rows).startswith(b"\xef\xbb\xbfmain_category,")
    with pytest.raises(ValueError, match="at most"):
        csv_bytes(rows, most=2)
    texts = spark.createDataFrame([("=1+1",), ("+SUM(A)",), ("-CMD",), ("@x",), ("plain",)], "t string").select(as_text_cell(F.col("t"))).collect()
    assert [r[0][0] for r in texts] == ["'", "'", "'", "'", "p"]


def test_packages(rows):
    page = html_report(rows).decode()
    assert page.index("Page 1<") < page.index("Page 2<") < page.index("Page 10<") and page.count("<h1>") == 1 and "<b>" not in page
    names = zipfile.ZipFile(io.BytesIO(page_zip(rows))).namelist()
    assert names == ["Home/Ovens/Page 1.csv", "Home/Ovens/Page 2.csv", "Home/Ovens/Page 10.csv"]
    items = rows.limit(1).withColumn("status", F.lit("pass")).withColumn("operator_decision", F.lit("complete_rework"))
    assert sorted(r.folder for r in review_folders(items).collect()) == ["01_NEEDS_REVIEW", "03_ALL_PRODUCTS"]


def test_stream(spark, tmp_path):
    schema = "main_category string, subcategory string, page_label string, page_url string, product_name string, product_url string, seq int"
    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for name in ("a", "b"):
        spark.createDataFrame([("m", "s", "p", "https://x/p", name, f"https://x/{name}", 0)], schema).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(schema).parquet(source), root, f"{tmp_path}/cp", "append").awaitTermination()
    store = Versions(spark, root)
    assert store.number() == 2 and store.manifest()["notes"] == {"master": 1} and sorted(r.product_name for r in store.table("master").collect()) == ["a", "b"]
