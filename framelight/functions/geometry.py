"""How products are framed: profiles, standards, the correction a normaliser would make. All native columns.

``m`` is a struct column of an image's metrics (see sources.images.METRICS)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelight.functions.binding import let
from framelight.functions.fixed_values import AMAZON_A_PROFILES, ANCHORS, CATEGORY_ANCHOR, CATEGORY_PROFILE, CATEGORY_STANDARDS, PROFILES

WHOLE = ("multipart", "bundle_layout")  # compositions sold as one
SLACK = ("accessory_heavy", *WHOLE)


def mode_key(mode: str | None) -> str:
    text = (mode or "standard").strip().casefold()
    return "amazon_a" if text.startswith("amazon") else "strict" if text.startswith("strict") else "standard"


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.coalesce(key, F.lit("")))


def subtype(width: Column, height: Column, structural: Column, components: Column, accessory_share: Column) -> Column:
    """Of a primary body's box and what lies around it."""
    aspect = F.greatest(width, F.lit(1)) / F.greatest(height, F.lit(1))
    return (
        F.when(structural >= 2, "multipart").when((accessory_share >= 0.10) & (components >= 2), "accessory_heavy").when(aspect < 0.62, "tall_standing")
        .when(aspect > 3.0, "flat_horizontal").when(aspect > 1.55, "wide").when(aspect < 0.82, "portrait_boxy").otherwise("boxy")
    )


def profile_of_shape(width: Column, height: Column) -> Column:
    aspect = F.greatest(width, F.lit(1)) / F.greatest(height, F.lit(1))
    return F.when(aspect < 0.68, "tall").when(aspect < 1.30, "boxy").when(aspect < 3.10, "wide").otherwise("flat")


def profile(category: Column, kind: Column, width: Column, height: Column) -> Column:
    """width and height: of the whole composition, if it is sold as one, else of the primary body."""
    shape = profile_of_shape(width, height)
    vacuum = (F.coalesce(category, F.lit("")) == "Vacuum cleaner") & kind.isin("boxy", "portrait_boxy", "accessory_heavy", "multipart")
    return (
        F.when(vacuum, "boxy").when(kind == "tall_standing", "tall").when(kind == "flat_horizontal", "flat").when(kind == "wide", "wide")
        .when(kind.isin(*WHOLE), shape).otherwise(F.coalesce(lookup(CATEGORY_PROFILE, category), shape))
    )


def anchor_mode(category: Column, kind: Column, accessory_share: Column, requested: Column | None = None) -> Column:
    automatic = (
        F.when(kind.isin(*WHOLE), "full_center").when((accessory_share >= 0.08) | (kind == "accessory_heavy"), "primary")
        .otherwise(F.coalesce(lookup(CATEGORY_ANCHOR, category), F.when(kind.isin("flat_horizontal", "wide"), "full_center").otherwise("primary")))
    )
    return automatic if requested is None else F.when(requested.isin(*ANCHORS), requested).otherwise(automatic)


def standard(name: Column, category: Column, kind: Column, mode: str = "standard") -> Column:
    """struct<axis (height or width), target, other (limit of the other side), alignment, baseline (null: none)>."""
    amazon = mode_key(mode) == "amazon_a"
    table = AMAZON_A_PROFILES if amazon else PROFILES

    def fields(p: dict) -> tuple:
        axis = "height" if "target_height" in p else "width"
        return axis, p[f"target_{axis}"], p["max_width" if axis == "height" else "max_height"], p["alignment"], p.get("baseline")

    def struct(axis: Column | str, target: Column | float, other: Column | float, alignment: Column | str, baseline: Column | float | None) -> Column:
        lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
        return F.struct(lit(axis, "string").alias("axis"), lit(target, "double").alias("target"), lit(other, "double").alias("other"), lit(alignment, "string").alias("alignment"), lit(baseline, "double").alias("baseline"))

    def choose(key: Column, rows: dict[str, dict]) -> Column:
        out = None
        for k, p in rows.items():
            out = (F if out is None else out).when(key == k, struct(*fields(p)))
        return out

    def relaxed(base: Column) -> Column:
        high = base["axis"] == "height"
        heavy = struct(base["axis"], base["target"], F.when(high, F.greatest(base["other"], F.lit(0.84))).otherwise(base["other"]), base["alignment"], base["baseline"])
        if amazon:
            whole = struct(base["axis"], base["target"], base["other"], "center", base["baseline"])
        else:
            whole = struct(base["axis"], F.when(high, 0.82).otherwise(0.84), F.when(high, F.greatest(base["other"], F.lit(0.86))).otherwise(F.greatest(base["other"], F.lit(0.80))), "center", base["baseline"])
        shapes = {"tall_standing": table["tall"], "flat_horizontal": table["flat"], "wide": table["wide"]}
        return F.when(kind == "accessory_heavy", heavy).when(kind.isin(*WHOLE), whole).when(kind.isin(*shapes), choose(kind, shapes)).otherwise(base)

    def own(base: Column) -> Column:
        """With the category's own figures, if they are for the same side."""
        if amazon:
            return base
        theirs = choose(F.coalesce(category, F.lit("")), CATEGORY_STANDARDS)
        return let(theirs, lambda o: F.when(o["axis"] == base["axis"], struct(o["axis"], o["target"], o["other"], o["alignment"], F.coalesce(o["baseline"], base["baseline"]))).otherwise(base))

    return let(let(choose(name, table), own), relaxed)


def overridden(goal: Column, name: Column, target: Column, baseline: Column) -> Column:
    """``goal`` with a page's own figures on top (target null: none): the profile's limit and alignment come with them, its baseline where
    the page has none. Profiles and goals measure the same side but for the shapes that replace a profile; those keep their goal."""
    of = lambda key, default=None: lookup({k: p.get(key, default) for k, p in PROFILES.items() if p.get(key, default) is not None}, name)
    high = lookup({k: "target_height" in p for k, p in PROFILES.items()}, name)
    other = F.when(high, of("max_width")).otherwise(of("max_height"))
    own = F.struct(goal["axis"].alias("axis"), target.cast("double").alias("target"), other.cast("double").alias("other"), of("alignment").alias("alignment"), F.coalesce(baseline, of("baseline"), goal["baseline"]).cast("double").alias("baseline"))
    return F.when(target.isNotNull() & (high == (goal["axis"] == "height")), own).otherwise(goal)


def on_card(m: Column) -> Column:
    """Metrics as the product appears when its image is fitted into a square card."""
    w, h = F.greatest(F.lit(1.0), m["image_width"].cast("double")), F.greatest(F.lit(1.0), m["image_height"].cast("double"))
    longest = F.greatest(w, h)
    sx, sy = w / longest, h / longest
    ox, oy = (1.0 - sx) / 2.0, (1.0 - sy) / 2.0
    full_w, full_h = m["full_width_occupancy"] * sx, m["full_height_occupancy"] * sy
    return F.struct(
        (m["body_width_occupancy"] * sx).alias("body_width"), (m["body_height_occupancy"] * sy).alias("body_height"),
        (ox + m["center_x"] * sx).alias("body_center_x"), (oy + m["center_y"] * sy).alias("body_center_y"), (oy + m["body_baseline_y"] * sy).alias("body_baseline_y"),
        full_w.alias("full_width"), full_h.alias("full_height"), (ox + m["left_padding"] * sx + full_w / 2.0).alias("full_center_x"), (oy + m["top_padding"] * sy + full_h / 2.0).alias("full_center_y"),
        (ox + F.coalesce(m["full_centroid_x"], m["center_x"]) * sx).alias("full_centroid_x"), (oy + F.coalesce(m["full_centroid_y"], m["center_y"]) * sy).alias("full_centroid_y"),
        sx.alias("image_scale_x"), sy.alias("image_scale_y"),
    )


def framing(m: Column, name: Column, kind: Column, goal: Column, scale_tolerance: float, alignment_tolerance: float, mode: str) -> Column:
    """Against the absolute standard ``goal`` (of standard()): struct<axis, target, value, ratio, tolerance, too, off_line, delta>; too:
    -1, 0 or 1 for too small, fine, too large."""
    whole = kind.isin(*WHOLE)
    axis = F.concat(F.when(whole, F.lit("full_")).otherwise(F.lit("")), goal["axis"], F.lit("_occupancy"))
    high = goal["axis"] == "height"
    value = F.when(whole & high, m["full_height_occupancy"]).when(whole, m["full_width_occupancy"]).when(high, m["height_occupancy"]).otherwise(m["width_occupancy"])
    ratio = value / F.greatest(goal["target"], F.lit(1e-6))
    amazon = mode_key(mode) == "amazon_a"
    base, more = (max(0.055, min(0.10, scale_tolerance * 0.55)), 0.035) if amazon else (max(0.22, scale_tolerance + 0.05), 0.07)
    tolerance = F.when(kind.isin(*SLACK), F.lit(base + more)).otherwise(F.lit(base))
    own_baseline = {k: p.get("baseline", 0.89) for k, p in PROFILES.items()}
    bottom = goal["alignment"] == "bottom_center"
    delta = F.when(bottom, F.abs(m["baseline_y"] - F.coalesce(goal["baseline"], lookup(own_baseline, name)))).otherwise(F.abs(m["center_y"] - 0.5))
    return F.struct(
        axis.alias("axis"), goal["target"].alias("target"), value.alias("value"), ratio.alias("ratio"), tolerance.alias("tolerance"),
        F.when(ratio < 1.0 - tolerance, -1).when(ratio > 1.0 + tolerance, 1).otherwise(0).alias("too"), (delta > max(0.085, alignment_tolerance * 1.55)).alias("off_line"), bottom.alias("bottom"), delta.alias("delta"),
    )


def agreement(m: Column, card: Column, category: Column, kind: Column, goal: Column, mode: str) -> Column:
    """What a normaliser would do: struct<scale, x_shift, y_shift, anchor, toward, axis, resize, move_x, move_y> (the last three booleans
    tell whether it could be seen)."""
    whole, high = kind.isin(*WHOLE), goal["axis"] == "height"
    w = F.greatest(F.when(whole, card["full_width"]).otherwise(card["body_width"]), F.lit(1e-6))
    h = F.greatest(F.when(whole, card["full_height"]).otherwise(card["body_height"]), F.lit(1e-6))
    along, across = goal["target"] / F.when(high, h).otherwise(w), goal["other"] / F.when(high, w).otherwise(h)
    scale = F.least(along, across)
    axis = F.when(along <= across, goal["axis"]).when(high, "width_limit").otherwise("height_limit")
    anchor = anchor_mode(category, kind, F.coalesce(m["accessory_area_ratio"], F.lit(0.0)))
    bottom = goal["alignment"] == "bottom_center"
    x = F.when(anchor == "full_center", card["full_center_x"]).when(anchor == "visual_center", card["full_centroid_x"]).otherwise(card["body_center_x"])
    y = F.when(anchor == "full_center", card["full_center_y"]).when(anchor == "visual_center", card["full_centroid_y"]).when(bottom, card["body_baseline_y"]).otherwise(card["body_center_y"])
    on_line = (anchor == "primary") & bottom
    x_shift, y_shift = 0.5 - x, F.when(on_line, F.coalesce(goal["baseline"], F.lit(0.89))).otherwise(0.5) - y
    seen_scale, seen_move = (0.025, 0.015) if mode_key(mode) == "amazon_a" else (0.055, 0.028)
    return F.struct(
        scale.alias("scale"), (scale - 1.0).alias("scale_delta"), x_shift.alias("x_shift"), y_shift.alias("y_shift"), anchor.alias("anchor"),
        F.when(anchor == "visual_center", "visual mass center").when(on_line, "baseline").otherwise("center").alias("toward"), axis.alias("axis"),
        F.when(scale > 1.0 + seen_scale, 1).when(scale < 1.0 - seen_scale, -1).otherwise(0).alias("resize"), (F.abs(x_shift) > seen_move).alias("move_x"), (F.abs(y_shift) > seen_move).alias("move_y"),
    )
