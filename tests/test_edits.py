"""Applied edits, resets, drafts and outcomes; the checks of the fixed values."""

import copy

import pytest

from framelight.functions import fixed_checks, fixed_values
from framelight.operators.edits import apply_outcomes, latest_edits, load_remembered, reset_products, with_applied_edits
from framelight.operators.review import edit_history

ITEM = "product_key string, operator_decision string, changed boolean, image binary, metrics int, subtype string"
EDIT = "product_key string, seq int, image binary, metrics int, subtype string"


def test_edits_win_unless_kept_or_sent_back(spark):
    items = spark.createDataFrame([("a", None, False, b"s", 1, "x"), ("b", "keep_original", None, b"s", 1, "x"), ("c", "generate_fix", True, None, 1, "x"), (None, None, None, b"s", 1, "x"), ("d", "", False, b"s", 1, "x")], ITEM)
    edits = spark.createDataFrame([("a", 1, b"old", 2, "y"), ("a", 2, b"new", None, None), ("b", 1, b"e", 2, "y"), ("c", 1, b"e", 2, "y"), ("d", 1, b"", 2, "y"), (None, 1, b"e", 2, "y")], EDIT)
    got = {r.product_key: (bytes(r.image), r.changed, r.metrics, r.subtype) for r in with_applied_edits(items, edits).collect()}
    assert got == {"a": (b"new", True, None, None), "b": (b"s", False, 1, "x"), "c": (b"e", True, 2, "y"), None: (b"s", False, 1, "x"), "d": (b"s", False, 1, "x")}
    assert latest_edits(edits).count() == 4 and with_applied_edits(items, edits.limit(0)).count() == 5


def test_reset_and_load(spark):
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("new",)], "product_key string")
    rows = spark.createDataFrame([("a",), ("b",)], "product_key string")
    ops = rows.selectExpr("product_key", "7 AS seq", "'record' AS op", "named_struct('body_mode', 'full', 'anchor_mode', 'auto', 'scale_bias', 0.1D, 'x_nudge', 0D, 'y_nudge', 0D, 'baseline_shift', 0D, 'crop_left', 0D, 'crop_right', 0D, 'crop_top', 0D, 'crop_bottom', 0D) AS state")
    revisions = spark.createDataFrame([("a", 3)], "product_key string, revision int")
    overrides, edits, after, revised = reset_products(keys, rows, rows, ops, revisions)
    assert [r.product_key for r in overrides.collect()] == [r.product_key for r in edits.collect()] == ["b"]
    shown = {r.product_key: (r["index"], r.states[r["index"]].body_mode, len(r.states)) for r in edit_history(after).collect()}
    assert shown == {"a": (1, "auto", 2), "b": (0, "full", 1), "new": (0, "auto", 1)}
    assert {r.product_key: r.revision for r in revised.collect()} == {"a": 4, "new": 1}
    after, revised = load_remembered(ops.filter("product_key = 'b'").selectExpr("product_key", "state"), after, revised)
    assert {r.product_key: r.revision for r in revised.collect()} == {"a": 4, "new": 1, "b": 1} and after.count() == 5


def test_a_failure_to_remember_leaves_the_edit(spark):
    form = "product_key string, seq int, error string"
    got = apply_outcomes(spark.createDataFrame([("a", 1, None), ("b", 1, ""), ("c", 1, "broken"), ("d", 1, "x"), ("d", 2, None)], form), spark.createDataFrame([("a", 1, None), ("b", 1, "disk"), ("c", 1, None)], form))
    assert {r.product_key: (r.applied, r.remembered, r.remember_error) for r in got.collect()} == {"a": (True, True, ""), "b": (True, False, "disk"), "c": (False, False, ""), "d": (True, False, "")}


def test_fixed_values_hold():
    assert fixed_checks.fixed_value_errors() == []
    assert len(fixed_checks.profiles_document("1")["category_anchor_policy"]) == len(fixed_values.CATEGORY_ANCHOR)


@pytest.mark.parametrize("change", [{"alignment": "left"}, {"target_width": 0.5}, {"target_height": 0.0}, {"max_width": 1.01}])
def test_broken_profiles_are_told(change):
    broken = copy.deepcopy(fixed_values.PROFILES)
    broken["tall"] |= change
    assert len(fixed_checks.profile_errors(broken, "profiles")) == 1 and fixed_checks.profile_errors({}, "profiles")
