"""What a query reads once, and what it does not make: counts of issues without their texts, totals and exclusions in one pass."""

from pyspark.sql import functions as F

from framelight.operators.scoring import page_summary, score_items, score_single
from framelight.operators.totals import excluded_everywhere, export_counts, package_counts, review_counts
from framelight.plans.catalog import analysed, catalog
from framelight.plans.report_queries import _gated

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_need_no_texts(spark):
    items = analysed(catalog(spark, SMALL))
    scored = score_items(items)
    assert scored.filter((F.col("status") == "review") != (F.size("issues") > 0)).count() == 0
    assert score_single(items).filter(F.col("issue_count") != F.size("issues")).count() == 0
    pages = plan(page_summary(scored))
    assert "ArrowEvalPython" not in pages and "Normalizer would" not in pages
    assert "ArrowEvalPython" not in plan(score_single(items).select("pos", "issue_count"))


def test_a_shift_that_is_no_number_counts_for_nothing(spark):
    items = analysed(catalog(spark, SMALL)).limit(5).withColumn("metrics", F.col("metrics").withField("left_padding", F.lit(float("nan"))).withField("center_x", F.lit(float("nan"))))
    for r in score_single(items).select("issues", "issue_count").collect():
        assert r.issue_count == len(r.issues)


def test_both_kinds_of_groups_share_a_shuffle(spark):
    assert plan(score_items(analysed(catalog(spark, SMALL)))).count("Exchange hashpartitioning(page_id") == 1


def test_exclusions_of_one_table_are_read_once(spark):
    items = _gated(spark, SMALL)
    once, twice = excluded_everywhere(items, items), excluded_everywhere(items, items.select("*"))
    assert once.columns == twice.columns and once.count() == twice.count() > 0
    assert once.exceptAll(twice).count() == 0
    assert 2 * plan(once).count("FileScan") == plan(twice).count("FileScan")


def test_package_in_one_pass(spark):
    rows = [("pass", None, True, None), ("review", "complete_rework", False, "no foreground"), ("review", None, False, None), ("review", None, None, ""), (None, "use_fixed", True, None)]
    items = spark.createDataFrame(rows, "status string, operator_decision string, changed boolean, normalization_error string")
    selected = items.filter(F.col("changed") | F.col("normalization_error").isNotNull()).withColumn("error", F.col("normalization_error"))
    expected = review_counts(items.withColumn("has_fix", F.col("changed"))).first().asDict() | export_counts(selected, True).first().asDict()
    assert package_counts(items, True).first().asDict() == expected
    assert package_counts(items.limit(0), True).first().selected == 0
