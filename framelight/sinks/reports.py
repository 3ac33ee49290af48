"""Exports of the audit: tables through Spark's writers, and small packages put together on the driver.

A report is of one page or one selection that people read; ``most`` bounds what a package takes, and more is an error, not a cut.
The tables themselves are written by Spark at any size."""

import csv
import html
import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.functions.text import safe_name
from framelight.operators.audit import in_natural_order

BOM = "﻿"


def as_text_cell(c: Column) -> Column:
    """Never a formula: texts that a spreadsheet would evaluate get an apostrophe in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """All columns as text, null as nothing, with a header; files in natural order, if the rows have the audit's columns."""
    text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])
    if {"main_category", "subcategory", "page_label", "product_name"} <= set(text.columns):
        text = in_natural_order(text)
    writer = text.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def read_csv(spark, path: str, columns: list[str]) -> DataFrame:
    """The columns as text; those that the file lacks, and empty ones, as ''."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    names = {c.lstrip(BOM): c for c in rows.columns}
    return rows.select(*[F.coalesce(F.col(f"`{names[c]}`"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in columns])


def taken(rows: DataFrame, most: int) -> list:
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"A package takes {most} rows at most; write the table with write_csv instead.")
    return got


def csv_bytes(rows: DataFrame, most: int = 100_000) -> bytes:
    out = io.StringIO()
    table = csv.writer(out, lineterminator="\r\n")
    table.writerow(rows.columns)
    table.writerows([["" if v is None else v for v in r] for r in taken(rows, most)])
    return (BOM + out.getvalue()).encode()


def html_report(rows: DataFrame, most: int = 20_000) -> bytes:
    """Audit rows under headings of main category, subcategory and page."""
    parts, last = ["<!doctype html><meta charset='utf-8'><title>Catalogue audit</title>"], (None, None, None)
    for r in taken(in_natural_order(rows), most):
        at = r.main_category, r.subcategory, r.page_label
        for level in range(3):
            if at[: level + 1] != last[: level + 1]:
                parts.append(f"<h{level + 1}>{html.escape(at[level])}</h{level + 1}>")
        last = at
        parts.append(f"<article><h4>{html.escape(r.product_name)}</h4><p>{html.escape(r.status)}</p><p>{html.escape(r.problem_summary)}</p><p>{html.escape(r.suggested_fix)}</p></article>")
    return "".join(parts).encode()


def page_zip(rows: DataFrame, most: int = 100_000) -> bytes:
    """A CSV for each page, in folders of category and subcategory; names are safe and stay within the archive."""
    pages: dict[tuple, list] = {}
    levels = ("main_category", "subcategory", "page_label")
    named = in_natural_order(rows).withColumn("path_", F.array(*[safe_name(c, "General", 120) for c in levels]))
    for *r, path in taken(named, most):
        pages.setdefault((*(r[rows.columns.index(c)] for c in levels), tuple(path)), []).append(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for key, group in pages.items():
            text = io.StringIO()
            table = csv.writer(text, lineterminator="\r\n")
            table.writerow(rows.columns)
            table.writerows(group)
            z.writestr("/".join(key[-1]) + ".csv", BOM + text.getvalue())
    return out.getvalue()


def review_folders(items: DataFrame) -> DataFrame:
    """items once for each folder of a review package: by state, and among all."""
    review = (F.coalesce("operator_decision", F.lit("")) == "complete_rework") | (F.col("status") != "pass")
    state = F.when(review, "01_NEEDS_REVIEW").otherwise("02_PASSED")
    return items.withColumn("folder", F.explode(F.array(state, F.lit("03_ALL_PRODUCTS"))))


def write_media(images: DataFrame, put: Callable[[str, bytes], None]) -> None:
    """Each row's content to its path, from the executors, through ``put`` (a store's client): nothing passes the driver."""

    def each(rows) -> None:
        for r in rows:
            put(r.path, bytes(r.content))

    images.select("path", "content").foreachPartition(each)
