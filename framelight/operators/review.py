"""Edits under review: tunings, histories, remembered exceptions, names, page numbers, calibration."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.functions.fixed_values import PROFILES
from framelight.functions.geometry import lookup
from framelight.functions.text import casefold, plain_name, python_fixed, safe_name
from framelight.functions.urls import match_url

TUNING = "struct<body_mode:string,anchor_mode:string,scale_bias:double,x_nudge:double,y_nudge:double,baseline_shift:double,crop_left:double,crop_right:double,crop_top:double,crop_bottom:double>"
# The ranges that a tuning may use.
RANGES = {"scale_bias": (-0.45, 0.60), "x_nudge": (-0.30, 0.30), "y_nudge": (-0.30, 0.30), "baseline_shift": (-0.10, 0.10), **{f"crop_{s}": (0.0, 0.45) for s in ("left", "right", "top", "bottom")}}
MODES = {"body_mode": ["auto", "main", "full", "multipart"], "anchor_mode": ["auto", "primary", "full_center", "visual_center"]}


def tuning_error(t: Column) -> Column:
    """The first field that is out of range, or null. Missing fields have their defaults, auto and 0."""
    bad = [F.when(~F.coalesce(t[k], F.lit("auto")).isin(*v), k) for k, v in MODES.items()]
    bad += [F.when(~F.coalesce(t[k], F.lit(0.0)).between(*r), k) for k, r in RANGES.items()]
    return F.coalesce(*bad)


def merged_tuning(everywhere: Column, own: Column) -> Column:
    """A product's tuning on top of one for all: four fields add up, crops are the product's own."""
    add = lambda k: (F.coalesce(everywhere[k], F.lit(0.0)) + F.coalesce(own[k], F.lit(0.0))).alias(k)
    return F.struct(*[F.coalesce(own[k], F.lit("auto")).alias(k) for k in MODES], *[F.coalesce(own[k], F.lit(0.0)).alias(k) if k.startswith("crop") else add(k) for k in RANGES])


def rounded(t: Column) -> Column:
    return F.struct(*[t[k].alias(k) for k in MODES], *[F.round(t[k], 6).alias(k) for k in RANGES])


def edit_history(ops: DataFrame, depth: int = 60) -> DataFrame:
    """The states of each product_key after its ops (seq; op: record with a state, undo, redo): states array and index.

    An op's own work is a fold: recording what is shown already changes nothing; recording after undo drops what was undone; the
    oldest states go beyond ``depth``; undo and redo stop at the ends. One row for each key: a key's ops are one editor's."""

    def fold(s: Column, o: Column) -> Column:
        shown = F.get(s["states"], s["index"])
        states = F.concat(F.slice(s["states"], F.lit(1), s["index"] + 1), F.array(o["state"]))
        cut = F.when(F.size(states) > depth, F.slice(states, F.lit(-depth), F.lit(depth))).otherwise(states)
        pair = lambda states, i: F.struct(states.alias("states"), i.cast("int").alias("index"))
        moved = s["index"] + F.when(o["op"] == "undo", -1).otherwise(1)
        step = F.when((moved >= 0) & (moved < F.size(s["states"])), pair(s["states"], moved)).otherwise(s)
        return F.when(o["op"] != "record", step).when(shown.eqNullSafe(o["state"]), s).otherwise(pair(cut, F.size(cut) - 1))

    state = ops.schema["state"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{state}>").alias("states"), F.lit(-1).alias("index"))
    listed = ops.groupBy("product_key").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "state"))).alias("ops"))
    return listed.select("product_key", F.aggregate("ops", start, fold).alias("h")).select("product_key", "h.states", "h.index")


def exception_identity(product_url: Column, name: Column, category: Column, archetype: Column) -> Column:
    low = lambda c: casefold(F.coalesce(c, F.lit("")))
    seed = F.when(match_url(product_url) != "", F.concat(F.lit("url::"), match_url(product_url))).otherwise(F.concat(F.lit("name::"), plain_name(name), F.lit("::category::"), low(category), F.lit("::archetype::"), low(archetype)))
    return F.substring(F.sha2(seed, 256), 1, 24)


def exception_suggestions(items: DataFrame, library: DataFrame, limit: int = 4) -> DataFrame:
    """For each item (item_id, product_url, name, item_category, item_archetype) the remembered entries that fit it best: the same address
    (100) before the same name (75, 5 more for category and for archetype each), then the newest, at most ``limit``.

    Joins on address and on name; an entry that fits both ways counts by its address. Entries of one address, and of one name with or without the category
    and the archetype, are first cut to their own best ``limit``: each way in which an item can score has such a list, so no item meets more than 5 * limit entries,
    whatever the number of entries of its name. (Entries by name that fit by address too are taken out of their lists only then: as many have come in by address.)"""
    target = items.select("item_id", match_url(F.col("product_url")).alias("url"), plain_name(F.col("name")).alias("plain"), casefold(F.coalesce("item_category", F.lit(""))).alias("c"), casefold(F.coalesce("item_archetype", F.lit(""))).alias("a"))
    newest = F.coalesce(*[F.try_to_timestamp(F.col(c)) for c in ("updated_at", "saved_at", "created_at")])
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    entries = library.select("identity", "product_url", "normalized_name", low("category").alias("their_c"), low("archetype").alias("their_a"), newest.alias("newest"))

    def first(*same: str) -> DataFrame:
        own = Window.partitionBy(*same).orderBy(F.desc_nulls_last("newest"), "identity")
        return entries.withColumn("nth_", F.row_number().over(own)).filter(F.col("nth_") <= limit).drop("nth_")

    by_url = target.filter("url <> ''").join(first("product_url"), F.col("url") == F.col("product_url")).select("item_id", "identity", "newest", F.lit(100).alias("match_score"), F.lit("Exact product URL").alias("match_type"))
    named = target.filter("plain <> ''")
    fits = {k: (F.col(k) != "") & (F.col(f"their_{k}") == F.col(k)) for k in ("c", "a")}
    found = by_url
    for same in ((), ("c",), ("a",), ("c", "a")):  # what fits besides the name, and nothing else does
        with_it = named.join(first("normalized_name", *[f"their_{k}" for k in same]), [F.col("plain") == F.col("normalized_name"), *[F.col(k) == F.col(f"their_{k}") for k in same]])
        for k, fit in fits.items():
            with_it = with_it.filter(fit if k in same else ~fit)
        with_it = with_it.filter((F.col("url") == "") | ~F.coalesce(F.col("product_url") == F.col("url"), F.lit(False)))
        found = found.unionByName(with_it.select("item_id", "identity", "newest", F.lit(75 + 5 * len(same)).alias("match_score"), F.lit("Exact product name").alias("match_type")))
    best = Window.partitionBy("item_id").orderBy(F.desc("match_score"), F.desc_nulls_last("newest"), "identity")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).drop("newest")


def unique_names(rows: DataFrame, scope: str = "page_id", name: str = "name", order: str = "pos") -> DataFrame:
    """rows with file_name: safe names, a second one of a scope ending in __2, and so on past names that are taken already."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group, used, following, out = group.sort_values(order), set(), {}, []
        for base in group.pop("safe_"):
            made, n = base, following.get(base, 2)  # numbers below are taken
            while made.casefold() in used:
                made, n = f"{base}__{n}", n + 1
            following[base] = n
            used.add(made.casefold())
            out.append(made)
        return group.assign(file_name=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("safe_", safe_name(name, "Product", 120)).groupBy(scope).applyInPandas(one, f"{fields}, file_name string")


def number_pages(pages: DataFrame, most: int | None = 25) -> DataFrame:
    """Pages of a listing (listing_id, pos, url, page_number or null) with numbers for all: those without one take the least free numbers
    in the order found (so the first page is 1, if that is free); labelled, by number and address the first ``most``.

    The j-th free number is j and as many more as there are taken numbers that have less than j free ones below: the i-th taken
    number has its own value less i of them. Both are windows over a listing's rows."""
    listing = Window.partitionBy("listing_id")
    taken = pages.filter("page_number IS NOT NULL").select("listing_id", F.col("page_number").cast("long").alias("number")).distinct()
    taken = taken.select("listing_id", (F.col("number") - F.row_number().over(listing.orderBy("number"))).alias("free"), F.lit(0).alias("open"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("url"))
    wanting = pages.filter("page_number IS NULL").select("listing_id", (F.row_number().over(listing.orderBy("pos")) - 1).cast("long").alias("free"), F.lit(1).alias("open"), "pos", "url")
    before = F.sum(1 - F.col("open")).over(listing.orderBy("free", "open").rowsBetween(Window.unboundedPreceding, 0))
    numbered = taken.withColumn("pos", F.col("pos").cast(pages.schema["pos"].dataType)).unionByName(wanting).withColumn("number", F.col("free") + 1 + F.coalesce(before, F.lit(0)))
    told = pages.filter("page_number IS NOT NULL").select("listing_id", "url", F.col("page_number").cast("long").alias("page_number"))
    out = told.unionByName(numbered.filter("open = 1").select("listing_id", "url", F.col("number").cast("long").alias("page_number")))
    if most is not None:
        out = out.withColumn("nth", F.row_number().over(listing.orderBy("page_number", "url"))).filter(F.col("nth") <= most).drop("nth")
    return out.withColumn("page_label", F.concat(F.lit("Page "), F.col("page_number")))


def calibration(items: DataFrame, page: str = "page_id") -> DataFrame:
    """Targets of a page's own groups of two or more: the upper median of the body's side that the profile aims at, and of its baseline
    where the profile stands on one; rounded to 4 places and clamped."""
    m = F.col("metrics")
    high = lookup({k: "target_height" in p for k, p in PROFILES.items()}, F.col("profile"))
    bottom = lookup({k: p["alignment"] == "bottom_center" for k, p in PROFILES.items()}, F.col("profile"))
    upper = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")
    rows = items.select(page, "group_key", "profile", high.alias("high"), bottom.alias("bottom"), F.when(high, m["body_height_occupancy"]).otherwise(m["body_width_occupancy"]).alias("side"), m["body_baseline_y"].alias("line"))
    medians = rows.groupBy(page, "group_key", "profile", "high", "bottom").agg(upper("side").alias("side"), upper("line").alias("line"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    clamp = lambda c, low, most: F.greatest(F.lit(low), F.least(F.lit(most), python_fixed(F.col(c), F.lit(4)).cast("double")))
    return medians.select(page, "group_key", "profile", "n", F.when(F.col("high"), clamp("side", 0.40, 0.90)).alias("target_height"), F.when(~F.col("high"), clamp("side", 0.38, 0.92)).alias("target_width"), F.when(F.col("bottom"), clamp("line", 0.68, 0.97)).alias("baseline"))


def should_normalize(scope: Column, status: Column, decision: Column, has_edit: Column) -> Column:
    """Whether a showcase makes a corrected image: never for a kept original, always for an edited product, else by scope or finding."""
    d = F.coalesce(decision, F.lit(""))
    return (d != "keep_original") & (has_edit | (scope == "all") | (status != "pass") | (d == "use_fixed"))


def dragged_tuning(tuning: Column, everywhere: Column, base: Column, dragged: Column) -> Column:
    """tuning after its box (struct x, y, w, h, shares of the card) was dragged from ``base``: the scale by the mean of both sides' factors, on
    top of what ``everywhere`` already scales; the nudges by how far the centre went. All within RANGES, the other fields as they were."""
    n = lambda s, k: F.coalesce(s[k], F.lit(0.0))
    side = {k: F.greatest(n(base, k), F.lit(1e-6)) for k in ("w", "h")}
    now = {k: F.coalesce(dragged[k], side[k]) for k in side}
    factor = F.greatest(F.lit(0.25), F.least(F.lit(4.0), (now["w"] / side["w"] + now["h"] / side["h"]) / 2.0))
    within = lambda k, c: F.greatest(F.lit(RANGES[k][0]), F.least(F.lit(RANGES[k][1]), c))
    gone = lambda at, size: F.coalesce(dragged[at], n(base, at)) + now[size] / 2.0 - (n(base, at) + side[size] / 2.0)
    scale = (1.0 + n(everywhere, "scale_bias") + n(tuning, "scale_bias")) * factor - 1.0 - n(everywhere, "scale_bias")
    new = {"scale_bias": scale, "x_nudge": n(tuning, "x_nudge") + gone("x", "w"), "y_nudge": n(tuning, "y_nudge") + gone("y", "h")}
    return F.struct(*[tuning[k].alias(k) for k in MODES], *[(within(k, new[k]) if k in new else tuning[k]).alias(k) for k in RANGES])
