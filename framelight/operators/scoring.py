"""Peers, issues and scores of a page's items."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.functions.binding import once
from framelight.functions.fixed_values import PROFILES
from framelight.functions.geometry import agreement, framing, lookup, on_card, overridden, standard
from framelight.functions.text import percent, python_fixed

SUSPECT = "Foreground detection looks unreliable"


def peer_baselines(items: DataFrame, page: str = "page_id") -> DataFrame:
    """items with peer struct<group, axis, scale_median, align_axis, align_median, count>: of the item's own group (page, group_key),
    if two or more are in it, else of its page's wider group (profile_group_key). The axes are those of the standard profiles in every mode.

    Medians are windows over the page's groups, so that items are made once and no table is read again for them. Own groups lie within the wider ones
    (a key of the own group is the wider one's and more): both windows share one shuffle, that of the wider groups."""
    m = F.col("metrics")
    high = lookup({k: "target_height" in p for k, p in PROFILES.items()}, F.col("profile"))
    bottom = lookup({k: p["alignment"] == "bottom_center" for k, p in PROFILES.items()}, F.col("profile"))
    scale = F.when(high, m["height_occupancy"]).otherwise(m["width_occupancy"])
    line = F.when(bottom, m["baseline_y"]).otherwise(m["center_y"])
    out = items
    for keys, name in ((["profile_group_key"], "wide"), (["profile_group_key", "group_key"], "own")):
        group = Window.partitionBy(page, *keys)
        medians = F.median(scale).over(group).alias("scale_median"), F.median(line).over(group).alias("align_median"), F.count(F.lit(1)).over(group).alias("count")
        out = out.withColumn(name, F.struct(*medians))
    own = F.col("own.count") >= 2
    peer = F.when(own, F.col("own")).otherwise(F.col("wide"))
    group = F.when(own, F.col("group_key")).otherwise(F.concat(F.lit("profile::"), F.col("profile_group_key")))
    return out.withColumn("peer", once(F.struct(
        group.alias("group"), F.when(high, "height_occupancy").otherwise("width_occupancy").alias("axis"), peer["scale_median"].alias("scale_median"),
        F.when(bottom, "baseline_y").otherwise("center_y").alias("align_axis"), peer["align_median"].alias("align_median"), peer["count"].alias("count"),
        scale.alias("scale"), line.alias("line"),
    ))).drop("own", "wide")


def scale_limits(tolerance: float) -> tuple[float, float]:
    """The least and the greatest ratio that is still fine, as decimal figures: 0.82 for a tolerance of 0.18, where 1.0 - 0.18 in binary is a little more."""
    return round(1.0 - tolerance, 12), round(1.0 + tolerance, 12)


def peer_issues(m: Column, peer: Column, ratio: Column, scale_tolerance: float, alignment_tolerance: float) -> list[tuple[Column, Column]]:
    """What the comparison with peers tells, in order: whether, and the text. An unreliable foreground comes first; peers count from two on."""
    peers = peer["count"] >= 2
    low, high = scale_limits(scale_tolerance)
    zoom = F.when(ratio < low, F.concat(F.lit("Primary body looks too zoomed out ("), percent(F.abs(1 - ratio)), F.lit(" smaller than subgroup median)"))).otherwise(
        F.concat(F.lit("Primary body looks too zoomed in ("), percent(F.abs(ratio - 1)), F.lit(" larger than subgroup median)")))
    line = F.when(peer["align_axis"] == "baseline_y", "Primary-body baseline does not match comparable products").otherwise("Primary-body vertical centering does not match comparable products")
    return [(m["segmentation_suspect"], F.lit(SUSPECT)), (peers & ((ratio < low) | (ratio > high)), zoom), (peers & (F.abs(peer["line"] - peer["align_median"]) > alignment_tolerance), line)]


def texts_of(found: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(told, text) for told, text in found]))


def count_of(found: list[tuple[Column, Column]]) -> Column:
    """How many they are, which can be told without making them."""
    return reduce(add, (F.coalesce(told.cast("int"), F.lit(0)) for told, _ in found))


def every_issue(m: Column, name: Column, peer: Column, ratio: Column, frame: Column, fix: Column, fixed: Column, scale_tolerance: float, alignment_tolerance: float, alone: bool = False) -> list[tuple[Column, Column]]:
    """Issues in order: whether, and the text. fixed: array of the shifts' percentages with one decimal. Later
    checks keep silent about what an earlier one has said, but for the last two; for a product alone (``alone``) all speak."""
    suspect = m["segmentation_suspect"]
    compared = peer_issues(m, peer, ratio, scale_tolerance, alignment_tolerance)
    out_of_scale, off_line = compared[1][0], compared[2][0]
    size = lambda word, way: F.concat(F.lit(f"Primary body is clearly too {word} for the expected "), name, F.lit(" framing standard ("), percent(F.abs(frame["ratio"] - 1.0)), F.lit(f" {way} expected size)"))
    tells_size = ~suspect & (frame["too"] != 0) & ~out_of_scale
    canonical = F.when(frame["too"] < 0, size("small", "below")).otherwise(size("large", "above"))
    tells_line = ~suspect & frame["off_line"] & ~off_line
    canonical_line = F.when(frame["bottom"], "Primary-body baseline is clearly outside the expected framing range").otherwise("Primary-body vertical centering is clearly outside the expected framing range")
    visibly = lambda word, amount, size: F.concat(F.lit(f"Normalizer would visibly {word} this product by about "), percent(amount), F.lit(f"; the source framing is too {size} on the catalog card"))
    resize = F.when(fix["resize"] > 0, visibly("enlarge", fix["scale"] - 1.0, "small")).otherwise(visibly("reduce", 1.0 - fix["scale"], "large"))
    move = lambda way, i, side: F.concat(F.lit("Normalizer would move the product "), way, F.lit(" by about "), fixed[i], F.lit(f"% of the card {side}"))
    move_x = move(F.when(fix["x_shift"] > 0, "right").otherwise("left"), 0, "width")
    move_y = F.concat(move(F.when(fix["y_shift"] > 0, "down").otherwise("up"), 1, "height"), F.lit(" to correct its "), fix["toward"])
    aside = F.concat(F.lit("Primary product body is shifted too far "), F.when(m["center_x"] > 0.5, "right").otherwise("left"))
    # a shift that is no number has no text
    return [
        *compared, (tells_size & name.isNotNull(), canonical), (tells_line, canonical_line),
        (~suspect & (fix["resize"] != 0) & ~out_of_scale & (F.lit(alone) | ~tells_size), resize), (~suspect & fix["move_x"] & ~F.isnan(fix["x_shift"]), move_x),
        (~suspect & fix["move_y"] & ~off_line & (F.lit(alone) | ~tells_line) & ~F.isnan(fix["y_shift"]), move_y), (m["center_offset_x"] > alignment_tolerance, aside),
        (m["min_edge_padding"] < 0.012, F.lit("Full product/accessory extent is touching or nearly touching the image edge")),
    ]


def issues(*args, **kwargs) -> Column:
    """The texts of every_issue()."""
    return texts_of(every_issue(*args, **kwargs))


def consistency(m: Column, peer: Column, ratio: Column, frame: Column, fix: Column) -> Column:
    """100 less what each deviation costs, each up to its own limit; 0 to 100."""
    cost = lambda most, x: F.least(F.lit(most), x)
    score = (
        F.lit(100.0) - cost(38.0, F.abs(ratio - 1.0) * 120.0) - cost(22.0, F.abs(frame["ratio"] - 1.0) * 62.0) - cost(18.0, F.abs(fix["scale_delta"]) * 115.0)
        - cost(12.0, F.abs(fix["x_shift"]) * 180.0) - cost(12.0, F.abs(fix["y_shift"]) * 180.0) - cost(24.0, m["center_offset_x"] * 260.0)
        - F.when(peer["count"] >= 2, cost(20.0, F.abs(peer["line"] - peer["align_median"]) * 180.0)).otherwise(0.0) - F.when(m["segmentation_suspect"], 25.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def audit_against_peers(items: DataFrame, scale_tolerance: float = 0.18, alignment_tolerance: float = 0.055, page: str = "page_id") -> DataFrame:
    """items with peer, scale_ratio, what the comparison with peers tells (issues), status, and the summary of each item's page (counts and summarise()'s columns)."""
    rows = peer_baselines(items, page).withColumn("scale_ratio", F.col("peer.scale") / F.greatest(F.col("peer.scale_median"), F.lit(1e-6)))
    told = peer_issues(F.col("metrics"), F.col("peer"), F.col("scale_ratio"), scale_tolerance, alignment_tolerance)
    rows = rows.withColumn("issues", texts_of(told)).withColumn("status", F.when(count_of(told) > 0, "review").otherwise("pass"))
    every = Window.partitionBy(page)
    rows = rows.withColumns({"analyzed_count": F.count(F.lit(1)).over(every), "flagged_count": F.count(F.when(F.col("status") != "pass", 1)).over(every), "failed_count": F.lit(0).cast("long")})
    return rows.select("*", *summarise(F.col("analyzed_count"), F.col("flagged_count"), F.col("failed_count")))


def score_items(items: DataFrame, scale_tolerance: float = 0.18, alignment_tolerance: float = 0.055, mode: str = "standard", page: str = "page_id") -> DataFrame:
    """items (metrics, profile, subtype, item_category, group_key, profile_group_key) with comparison_group, scale_ratio, canonical_*,
    normalizer_*, issues, status and consistency_score."""
    m, name, kind, category = F.col("metrics"), F.col("profile"), F.col("subtype"), F.col("item_category")
    peers = peer_baselines(items, page).withColumn("goal", standard(name, category, kind, mode)).withColumn("card", once(on_card(m)))
    peer, goal, card = F.col("peer"), F.col("goal"), F.col("card")
    measured = (
        peers.withColumn("scale_ratio", peer["scale"] / F.greatest(peer["scale_median"], F.lit(1e-6)))
        .withColumn("frame", once(framing(m, name, kind, goal, scale_tolerance, alignment_tolerance, mode)))
        .withColumn("fix", once(agreement(m, card, category, kind, goal, mode)))
    )
    frame, fix, ratio = F.col("frame"), F.col("fix"), F.col("scale_ratio")
    shown = measured.withColumn("shift_texts", F.array(python_fixed(F.abs(fix["x_shift"]) * 100, F.lit(1)), python_fixed(F.abs(fix["y_shift"]) * 100, F.lit(1))))
    told = every_issue(m, name, peer, ratio, frame, fix, F.col("shift_texts"), scale_tolerance, alignment_tolerance)
    found = shown.withColumns({"issues": texts_of(told), "issue_count": count_of(told)})
    return found.select(
        *items.columns, peer["group"].alias("comparison_group"), "scale_ratio", frame["ratio"].alias("canonical_scale_ratio"), frame["target"].alias("canonical_target"), frame["axis"].alias("canonical_axis"),
        fix["scale"].alias("normalizer_recommended_scale"), fix["scale_delta"].alias("normalizer_scale_delta"), fix["x_shift"].alias("normalizer_x_shift"), fix["y_shift"].alias("normalizer_y_shift"), fix["anchor"].alias("normalizer_anchor_mode"),
        "issues", F.when(F.col("issue_count") > 0, "review").otherwise("pass").alias("status"), consistency(m, peer, ratio, frame, fix).alias("consistency_score"),
    )


def score_single(items: DataFrame, scale_tolerance: float = 0.18, alignment_tolerance: float = 0.055, mode: str = "standard") -> DataFrame:
    """Products scanned by themselves (metrics, profile, subtype, item_category): against the standard and the normaliser only."""
    m, name, kind, category = F.col("metrics"), F.col("profile"), F.col("subtype"), F.col("item_category")
    nobody = F.struct(F.lit(0).alias("count"), F.lit(0.0).alias("line"), F.lit(0.0).alias("align_median"), F.lit("").alias("align_axis"))
    rows = items.withColumn("goal", standard(name, category, kind, mode)).withColumn("card", once(on_card(m)))
    rows = rows.withColumn("frame", once(framing(m, name, kind, F.col("goal"), scale_tolerance, alignment_tolerance, mode))).withColumn("fix", once(agreement(m, F.col("card"), category, kind, F.col("goal"), mode)))
    frame, fix = F.col("frame"), F.col("fix")
    rows = rows.withColumn("shift_texts", F.array(python_fixed(F.abs(fix["x_shift"]) * 100, F.lit(1)), python_fixed(F.abs(fix["y_shift"]) * 100, F.lit(1))))
    told = every_issue(m, name, nobody, F.lit(1.0), frame, fix, F.col("shift_texts"), scale_tolerance, alignment_tolerance, alone=True)
    rows = rows.withColumns({"issues": texts_of(told), "issue_count": count_of(told)})
    cost = lambda most, x: F.least(F.lit(most), F.abs(x))
    score = F.lit(100.0) - cost(28.0, (frame["ratio"] - 1.0) * 70.0) - cost(22.0, fix["scale_delta"] * 120.0) - cost(18.0, fix["x_shift"] * 180.0) - cost(18.0, fix["y_shift"] * 180.0) - F.when(m["segmentation_suspect"], 25.0).otherwise(0.0)
    return rows.select(*items.columns, F.lit("single_product::canonical").alias("comparison_group"), F.lit(1.0).alias("scale_ratio"), frame["ratio"].alias("canonical_scale_ratio"), fix["scale"].alias("normalizer_recommended_scale"), "issues", "issue_count", F.when(F.col("issue_count") > 0, "review").otherwise("pass").alias("status"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("consistency_score"))


def summarise(analyzed: Column, flagged: Column, failed: Column) -> list[Column]:
    """scan_status, page_score and confidence of counts; none may be negative, nor more flagged than analyzed."""
    zero = F.lit(0).cast("long")
    analyzed = F.greatest(zero, analyzed.cast("long"))
    flagged, failed = F.greatest(zero, F.least(flagged.cast("long"), analyzed)), F.greatest(zero, failed.cast("long"))
    some = analyzed > 0
    return [
        F.when(~some, "failed").when(failed > 0, "partial_success").otherwise("success").alias("scan_status"),
        F.when(some, F.lit(100.0) * (analyzed - flagged) / F.greatest(analyzed, F.lit(1))).alias("page_score"),
        F.when(~some, "insufficient_data").when(failed > 0, "reduced").otherwise("full").alias("confidence"),
    ]


def page_summary(scored: DataFrame, failures: DataFrame | None = None, page: str = "page_id") -> DataFrame:
    """A row for each page of scored items or failures: counts, and summarise()'s columns."""
    rows = scored.select(page, F.lit(1).alias("a"), (F.col("status") != "pass").cast("int").alias("b"), F.lit(0).alias("c"))
    if failures is not None:
        rows = rows.unionByName(failures.select(page, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c")))
    counts = rows.groupBy(page).agg(F.sum("a").alias("analyzed_count"), F.sum("b").alias("flagged_count"), F.sum("c").alias("failed_count"))
    return counts.select("*", *summarise(F.col("analyzed_count"), F.col("flagged_count"), F.col("failed_count")))


def corrections(items: DataFrame, overrides: DataFrame | None = None, mode: str = "strict", page: str = "page_id") -> DataFrame:
    """items with the correction that a normaliser would make (fix) and the goal it aims at; ``overrides`` (page, group_key, target_height or
    target_width, baseline; one row for each group, as calibration() makes them) take the standard's place for their groups."""
    m, name, kind, category = F.col("metrics"), F.col("profile"), F.col("subtype"), F.col("item_category")
    rows = items.withColumn("goal", standard(name, category, kind, mode)).withColumn("card", once(on_card(m)))
    if overrides is None:
        rows = rows.withColumn("overridden", F.lit(False))
    else:
        own = overrides.select(page, "group_key", F.coalesce("target_height", "target_width").alias("own_target"), F.col("baseline").alias("own_baseline"))
        rows = rows.join(own, [page, "group_key"], "left").withColumn("goal", once(overridden(F.col("goal"), name, F.col("own_target"), F.col("own_baseline"))))
        rows = rows.withColumn("overridden", F.col("own_target").isNotNull())
    return rows.select(*items.columns, "overridden", "goal", once(agreement(m, F.col("card"), category, kind, F.col("goal"), mode)).alias("fix"))
