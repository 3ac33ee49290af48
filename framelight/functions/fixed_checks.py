"""Checks of the fixed values, and the document that publishes them. The tables are small and known to the driver."""

from framelight.functions import fixed_values as fixed

# Alignments, and the range of a crop of each edge.
ALIGNMENTS = ("bottom_center", "center")
CROP_RANGE = (0.0, 0.45)


def share_errors(where: str, values: dict) -> list[str]:
    """Alignment known, all other values shares of the canvas above 0."""
    bad = [] if values.get("alignment") in ALIGNMENTS else [f"{where}: alignment"]
    return bad + [f"{where}.{k}: not in (0, 1]" for k, v in values.items() if k != "alignment" and not 0 < v <= 1]


def profile_errors(profiles: dict, where: str) -> list[str]:
    """Errors of a table of profiles: each shape once, aimed at by height or by width and not by both."""
    shapes = set(fixed.CATEGORY_PROFILE.values())
    bad = [f"{where}: not the shapes {sorted(shapes)}"] if set(profiles) != shapes else []
    for name, profile in profiles.items():
        bad += share_errors(f"{where}.{name}", profile)
        if len({"target_height", "target_width"} & set(profile)) != 1:
            bad.append(f"{where}.{name}: one target axis")
    return bad


def fixed_value_errors() -> list[str]:
    """What is wrong with the fixed values, nothing where they agree with each other."""
    known = set(fixed.CATEGORY_PROFILE)
    bad = profile_errors(fixed.PROFILES, "profiles") + profile_errors(fixed.AMAZON_A_PROFILES, "amazon_a_profiles")
    for category, standard in fixed.CATEGORY_STANDARDS.items():
        bad += share_errors(category, standard)
    bad += [f"{c}: no profile" for c in [*fixed.CATEGORY_STANDARDS, *fixed.CATEGORY_ANCHOR] if c not in known]
    bad += [f"{c}: unknown anchor" for c, anchor in fixed.CATEGORY_ANCHOR.items() if anchor not in fixed.ANCHORS]
    return bad + ([] if 0 <= CROP_RANGE[0] < CROP_RANGE[1] < 0.5 else ["crop range"])


def profiles_document(version: str) -> dict:
    """The fixed values as one document; an error if they do not hold."""
    if bad := fixed_value_errors():
        raise ValueError("; ".join(bad))
    return {
        "version": version, "crop_range": dict(zip(("min", "max"), CROP_RANGE)), "profiles": fixed.PROFILES, "amazon_a_profiles": fixed.AMAZON_A_PROFILES,
        "category_map": fixed.CATEGORY_PROFILE, "category_standards": fixed.CATEGORY_STANDARDS, "category_anchor_policy": fixed.CATEGORY_ANCHOR,
    }
