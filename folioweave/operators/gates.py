"""Acceptance rules over measured pages and crops: chains of conditions in the order in which they decide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles of pages that are shown as they are.
PRESENTATION_ROLES = ("cover", "back_cover", "title_page", "chapter_divider", "full_page_figure", "full_page_chart")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b <= 1e-9, F.when(a <= 1e-9, 1.0).otherwise(10.0)).otherwise(a / b)


def born_digital(text_chars: Column, image_coverage: Column) -> Column:
    return (text_chars >= 80) & (image_coverage < 0.55)


def colour_critical(saturated: Column, component: Column, p90: Column) -> Column:
    return (saturated >= 0.12) | ((saturated >= 0.05) & (component >= 0.025) & (p90 >= 85.0))


def clean_white(near_white: Column, component: Column, border: Column) -> Column:
    """Whether a background is clean enough to be left."""
    return (near_white >= 0.50) & (component >= 0.45) & (border >= 0.80)


def content_safe(b: Column, a: Column, ratios: tuple[float, float], lines: float) -> Column:
    """Whether edges, dark share and long lines of ``a`` (after) stay near those of ``b`` (before)."""
    edges = safe_ratio(a["edges"], b["edges"])
    dark = a["dark"] <= F.greatest(b["dark"] * 1.70, b["dark"] + 0.025)
    kept = (b["lines"] < 5) | (a["lines"] >= F.floor(b["lines"] * lines))
    return (edges >= ratios[0]) & (edges <= ratios[1]) & dark & kept


def geometry_gate(before: Column, after: Column, d: Column) -> Column:
    """The reason for which a straightened page is taken or not. ``d`` has perspective, distortion, deskew, angle, residual and
    confidence."""
    improved = ~d["deskew"] | (F.abs(d["residual"]) <= 0.12) | (F.abs(d["residual"]) + 0.05 < F.abs(d["angle"])) | (d["confidence"] < 0.20)
    safe = content_safe(before, after, (0.55, 1.65), 0.50)
    useful = d["perspective"] & (d["distortion"] >= 0.006)
    accepted = safe & (useful | (d["deskew"] & improved))
    return F.when(~d["perspective"] & ~d["deskew"], "geometry_not_required").when(accepted, "accepted").when(~safe, "content_guard_rejected").when(d["deskew"] & ~improved, "deskew_not_improved").otherwise("geometry_not_material")


def background_gate(before: Column, after: Column, edge_retention: Column) -> Column:
    """The reason for which an evened background is taken or not."""
    over = (after["white"] > 0.985) & (before["white"] < 0.80)
    safe = (edge_retention >= 0.70) & content_safe(before, after, (0.60, 1.45), 0.60) & ~over
    spread = (after["std"] <= before["std"] * 0.92) & (before["std"] - after["std"] >= 0.40)
    reach = (after["range"] <= before["range"] * 0.90) & (before["range"] - after["range"] >= 2.0)
    better = spread | reach | (after["white"] >= before["white"] + 0.02)
    return F.when(safe & better, "accepted").when(~safe, "content_guard_rejected").otherwise("no_material_background_improvement")


def catastrophic_gate(same_shape: Column, m: Column) -> Column:
    """The reason for which a crop is thrown away at once, or that it is not. ``m`` has edges, retention, ink, ink_after, std and
    std_after."""
    solid = (m["std_after"] < 2.0) & ((m["std"] >= 6.0) | (m["ink"] >= 0.003) | (m["edges"] >= 64))
    ink = F.when(m["ink"] <= 1e-9, 1.0).otherwise(m["ink_after"] / m["ink"])
    retention = F.when(m["edges"] == 0, 1.0).otherwise(m["retention"])
    loss = (m["edges"] >= 64) & (m["ink"] >= 0.003) & (retention < 0.12) & (ink < 0.12)
    return F.when(~same_shape, "dimension_mismatch").when(solid, "near_blank_or_solid_output").when(loss, "catastrophic_combined_content_loss").otherwise("catastrophic_gate_passed")


def semantic_gate(decision: Column, confidence: Column, good: list[Column], bad: list[Column], least: float = 0.90) -> Column:
    """The reason for which a reviewed crop is taken or not: all of ``good`` must be true and none of ``bad``."""
    failed = F.lit(False)
    for x in good:
        failed = failed | ~F.coalesce(x, F.lit(False))
    for x in bad:
        failed = failed | F.coalesce(x, F.lit(False))
    return (
        F.when(confidence.isNull(), "semantic_gate_invalid_confidence")
        .when(F.coalesce(decision, F.lit("")) == "uncertain", "semantic_gate_uncertain")
        .when(F.coalesce(decision, F.lit("")) != "accept", "semantic_gate_rejected")
        .when(confidence < least, "semantic_gate_low_confidence")
        .when(failed, "semantic_gate_integrity_flags_failed")
        .otherwise("semantic_gate_accepted")
    )


def presentation_reasons(f: dict[str, Column], first: Column, last: Column) -> Column:
    """Why a page may be shown as it is: an array of reasons in order. Missing features count as 0."""
    v = {k: F.coalesce(c, F.lit(0)) for k, c in f.items()}
    tests = (
        ("first_physical_page", first),
        ("last_physical_page", last),
        ("sparse_text_high_whitespace", (v["chars"] <= 240) & (v["blocks"] <= 8) & (v["whitespace"] >= 0.45)),
        ("dominant_visual_region", (v["coverage"] >= 0.55) | (v["dominant"] >= 0.48)),
        ("large_title_low_prose", (v["font_ratio"] >= 2.0) & (v["prose"] <= 0.35)),
        ("dispersed_non_body_layout", (v["dispersion"] >= 0.25) & (v["prose"] <= 0.35)),
        ("discrete_orientation", v["orientation"].isin(90, 180, 270)),
    )
    return F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests)))


def skip_reading(role: Column, confidence: Column, prose: Column, chars: Column, lines: Column, least: float = 0.90) -> Column:
    """The reason for which a page's text is not read, or is."""
    prose_here = (F.coalesce(prose, F.lit(0.0)) >= 0.55) | ((F.coalesce(chars, F.lit(0)) >= 1200) & (F.coalesce(lines, F.lit(0)) >= 18))
    return (
        F.when(~F.coalesce(role.isin(*PRESENTATION_ROLES), F.lit(False)), "role_not_presentation")
        .when(confidence.isNull() | (confidence < least), "classification_below_confidence_threshold")
        .when(prose_here, "local_continuous_prose_conflict")
        .otherwise("presentation_page_confirmed")
    )
