"""The library of remembered settings on disk."""

import pytest
from pyspark.sql import functions as F

from framelight.operators.review import TUNING
from framelight.sources.exceptions import TEXTS, load_library, read_library, write_library


def library(spark, n, crop=0.45):
    rows = spark.range(n).select(*[F.concat(F.lit(c), F.col("id")).alias(c) for c in TEXTS])
    tuning = F.from_json(F.lit(f'{{"body_mode": "auto", "anchor_mode": "primary", "scale_bias": 0.1, "crop_left": {crop}}}'), TUNING)
    return rows.withColumn("override", tuning)


def test_round_trip_and_backup(spark, tmp_path):
    path = f"file://{tmp_path}/library.json"
    write_library(library(spark, 3), path)
    write_library(library(spark, 2), path)
    assert sorted(r.identity for r in read_library(spark, path).collect()) == ["identity0", "identity1"]
    assert read_library(spark, f"{path}.bak").count() == 3 and read_library(spark, path).first().override.crop_left == 0.45


@pytest.mark.parametrize("text", ["{", '{"entries": [1]}', '{"other": 1}', '{"entries": {"a": {"override": {"crop_left": 0.451}}}}'])
def test_broken_documents_are_errors(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        read_library(spark, f"file://{tmp_path}/x.json").collect()


def test_no_document_is_no_entries(spark, tmp_path):
    rows = load_library(spark, f"file://{tmp_path}/none.json")
    assert rows.count() == 0 and rows.columns == library(spark, 1).columns


@pytest.mark.parametrize("text", ["", "  ", "{", '{"entries": {"a": {"override": {"scale_bias": 2}}}}'])
def test_broken_document_is_kept_and_copied(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        load_library(spark, f"file://{tmp_path}/x.json")
    copies = list(tmp_path.glob("x.json.corrupt.*.bak"))
    assert len(copies) == 1 and copies[0].read_text() == text and (tmp_path / "x.json").read_text() == text
