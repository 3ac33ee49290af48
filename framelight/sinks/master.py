"""The master table of audit rows in buckets of their pages: an upsert, a clearing or a batch reads and writes the buckets that it touches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.functions.lineage import cut
from framelight.operators.audit import dedupe_rows, page_identity, upsert
from framelight.sinks.versions import Change, Versions

MASTER = "master"


def page_key() -> Column:
    return F.to_json(page_identity())


def upsert_master(change: Change, new: DataFrame, mode: str = "replace_page") -> dict[str, int]:
    """Puts new rows (as operators.audit.upsert takes them) into the change's master table: counts before, after, added and removed. No new rows
    write nothing."""
    before = change.size(MASTER)
    new = cut(new)
    touched = change.touched(MASTER, new, page_key())
    if not touched:
        return {"before": before, "after": before, "added": 0, "removed": 0}
    stored = change.stored(MASTER, touched)
    table, stats = upsert(new.limit(0) if stored is None else stored, new, mode)
    held = sum(p["rows"] for b, p in change.tables.get(MASTER, {"parts": {}})["parts"].items() if int(b) in touched)
    change.put(MASTER, table.drop("part"), page_key(), touched)
    after, counts = change.size(MASTER), stats.first()
    return {"before": before - held + counts["before"], "after": after, "added": counts["added"], "removed": counts["removed"]}


def clear_pages(change: Change, pages: DataFrame) -> int:
    """Removes the rows of pages (main_category, subcategory, page_label, page_url); how many there were."""
    keys = pages.select(page_key().alias("key_")).distinct()
    touched = change.touched(MASTER, pages, page_key())
    stored = change.stored(MASTER, touched)
    if not touched or stored is None:
        return 0
    before = change.size(MASTER)
    change.put(MASTER, stored.withColumn("key_", page_key()).join(keys, "key_", "left_anti").drop("key_"), page_key(), touched)
    return before - change.size(MASTER)


def clear_master(change: Change) -> None:
    change.clear(MASTER)


def master(store: Versions, number: int | None = None) -> DataFrame | None:
    return store.table(MASTER, number)


def load_master(store: Versions, rows: DataFrame, buckets: int) -> int:
    """A master table made anew of rows, each product once on its page; the number of its version."""
    with store.change() as change:
        change.put(MASTER, dedupe_rows(rows).drop("page_key", "record_key"), page_key(), buckets=buckets)
        return change.commit()
