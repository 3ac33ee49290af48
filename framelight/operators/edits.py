"""Applied edits, resets and remembered tunings of products under review, as tables by product_key.

Rows without a product_key have no edits, resets or drafts; they stay in items. Empty tables give what the other side alone gives."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.operators.review import MODES, RANGES

LEFT_AS_IT_IS = ["keep_original", "complete_rework"]  # fixed values: decisions that no edit overrules


def default_tuning() -> Column:
    return F.struct(*[F.lit("auto").alias(k) for k in MODES], *[F.lit(0.0).alias(k) for k in RANGES])


def latest_edits(edits: DataFrame) -> DataFrame:
    """The edit of each key that was applied last (greatest seq). Map-side, one row a key before the shuffle."""
    kept = [c for c in edits.columns if c != "product_key"]
    last = edits.filter("product_key IS NOT NULL").groupBy("product_key").agg(F.max_by(F.struct(*kept), "seq").alias("e"))
    return last.select("product_key", *[F.col("e")[c].alias(c) for c in kept])


def with_applied_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Items (product_key, operator_decision, changed, image, metrics, subtype) as a showcase has them after edits (seq, image, metrics, subtype).

    The last edit wins over what the normaliser made, with all of its own values, also null ones. An edit without an image is none, and
    products that an operator keeps or sends back stay as they are. Other columns of items pass through."""
    names = ["image", "metrics", "subtype"]
    own = latest_edits(edits).select("product_key", F.struct(*names).alias("edit_"))
    wins = F.coalesce(F.length("edit_.image") > 0, F.lit(False)) & ~F.coalesce("operator_decision", F.lit("")).isin(LEFT_AS_IT_IS)
    merged = {c: F.when(wins, F.col("edit_")[c]).otherwise(F.col(c)) for c in names} | {"changed": wins | F.coalesce("changed", F.lit(False))}
    return items.join(own, "product_key", "left").withColumns(merged).drop("edit_")


def fixed_image(edit: Column, showcase: Column, original: Column) -> Column:
    """The image to show of a product: its applied edit's, else the showcase's, else its own; empty ones do not count."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in (edit, showcase, original)])


def _recorded(ops: DataFrame, states: DataFrame) -> DataFrame:
    """The editor's ops, and after them a record of each key's state."""
    ends = ops.groupBy("product_key").agg(F.max("seq").alias("end_"))
    fresh = states.join(ends, "product_key", "left").select("product_key", (F.coalesce("end_", F.lit(0)) + 1).alias("seq"), F.lit("record").alias("op"), "state")
    return ops.select("product_key", "seq", "op", "state").unionByName(fresh)


def _revised(revisions: DataFrame, keys: DataFrame) -> DataFrame:
    """Revisions (product_key, revision) with those of the keys one up, from 0."""
    more = revisions.select("product_key", "revision").unionByName(keys.select("product_key", F.lit(1).alias("revision")))
    return more.groupBy("product_key").agg(F.sum("revision").alias("revision"))


def reset_products(keys: DataFrame, overrides: DataFrame, edits: DataFrame, ops: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables after the products of ``keys`` were reset: no override, no applied edit, the default tuning as the newest state of
    their history (undo leads back), and a new revision. A key named twice is reset once."""
    gone = keys.select("product_key").filter("product_key IS NOT NULL").distinct()
    without = lambda rows: rows.join(gone, "product_key", "left_anti")
    return without(overrides), without(edits), _recorded(ops, gone.withColumn("state", default_tuning())), _revised(revisions, gone)


def remembered_drafts(suggestions: DataFrame, library: DataFrame) -> DataFrame:
    """The tuning that each product (item_id) may load: that of its best suggestion, as a draft. A library's identities are unique."""
    best = suggestions.filter(F.col("rank") == 1).select(F.col("item_id").alias("product_key"), "identity")
    return best.join(library.select("identity", F.col("override").alias("state")), "identity").select("product_key", "identity", "state")


def load_remembered(drafts: DataFrame, ops: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History and revisions after drafts were loaded. Nothing is applied: overrides and applied edits are other tables, left alone."""
    return _recorded(ops, drafts.select("product_key", "state")), _revised(revisions, drafts)


def apply_outcomes(applied: DataFrame, remembered: DataFrame) -> DataFrame:
    """What became of each edit (product_key, error) that was applied and then to be remembered (product_key, error): two outcomes.

    An edit that failed is rolled back and not remembered; a failure to remember leaves the edit applied. Of a key's rows the last (seq) counts."""
    last = lambda rows, name: rows.withColumn("n_", F.row_number().over(Window.partitionBy("product_key").orderBy(F.desc("seq")))).filter("n_ = 1").select("product_key", F.coalesce("error", F.lit("")).alias(name))
    both = last(applied, "apply_error").join(last(remembered, "remember_error"), "product_key", "left")
    done = F.col("apply_error") == ""
    return both.select("product_key", done.alias("applied"), (done & F.coalesce(F.col("remember_error") == "", F.lit(False))).alias("remembered"), "apply_error", F.when(done, F.coalesce("remember_error", F.lit(""))).otherwise("").alias("remember_error"))
