"""Rule sets over frames, captures and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitgrid.functions.text import worst_of
from orbitgrid.operators import frames as fr
from orbitgrid.operators.asset_rules import codes, true
from orbitgrid.sources.checkpoints import materialize

c = F.col
#: Frame quality limits.
QUALITY = {"blur": 5.0, "exposure": (40.0, 230.0), "occupancy": (0.02, 0.90), "center": 0.75, "confidence": 0.30, "purity": 0.30, "fragments": 5, "contour": 0.60, "solidity": 0.40, "border": 0.50, "band": 0.30, "span": 0.72, "support": 0.16}


def frame_quality_gate(frames: DataFrame, q: dict = QUALITY) -> DataFrame:
    """`overall_pass` and `failure_reasons` of each frame. Clipping is a reason but does not fail; occupancy limits are strict only in the pass."""
    m = true(c("has_mask"))
    val = lambda name: F.when(m, F.coalesce(c(name), F.lit(0.0))).otherwise(0.0)
    occ, conf, pur, frag = val("occupancy"), val("mask_confidence"), val("purity_score"), val("fragment_count")
    contour, solid, border, support = val("largest_contour_ratio"), val("solidity"), val("border_touch_ratio"), val("support_area_ratio")
    blur, exposed = c("blur_score") >= q["blur"], c("exposure_score").between(*q["exposure"])
    framed = true(c("center_dist") < q["center"])
    fallback, suspected = m & true(c("fallback_used")), m & true(c("support_suspected"))
    band = (val("bottom_band_ratio") > q["band"]) & (val("bottom_span_ratio") > q["span"])
    reasons = codes(
        (~blur, "blurry"), (~exposed, "bad_exposure"), (m & (occ < q["occupancy"][0]), "object_too_small"), (m & (occ > q["occupancy"][1]), "object_too_large"), (m & ~framed, "subject_not_centered"),
        (m & true(c("is_clipped")), "subject_clipped"), (m & (conf < q["confidence"]), "low_mask_confidence"), (m & (pur < q["purity"]), "low_mask_purity"), (m & (frag > q["fragments"]), "fragmented_mask"),
        (m & (contour > 0) & (contour < q["contour"]), "unstable_dominant_contour"), (m & (solid > 0) & (solid < q["solidity"]), "low_solidity"), (m & (border > q["border"]), "mask_touches_borders"),
        (fallback & (conf < q["confidence"]), "fallback_low_confidence"), (fallback & (pur < q["purity"] + 0.05), "fallback_unstable_purity"), (suspected, "support_contamination"), (m & band, "bottom_support_band"), (m & (support > q["support"]), "large_support_region"),
    )
    masked = (
        (occ > q["occupancy"][0]) & (occ < q["occupancy"][1]) & framed & (conf >= q["confidence"]) & (pur >= q["purity"]) & (frag <= q["fragments"]) & ((contour == 0) | (contour >= q["contour"]))
        & ((solid == 0) | (solid >= q["solidity"])) & (border <= q["border"]) & ~suspected & ~band & (support <= q["support"])
    )
    return frames.withColumns({"overall_pass": blur & exposed & (~m | masked), "failure_reasons": reasons})


def mask_confidence(masks: DataFrame, target: float = 0.22, tolerance: float = 0.30) -> DataFrame:
    """Weighted confidence of a mask with penalties, clipped to 0-1."""
    low = lambda limit, x: F.least(F.lit(limit), x)
    score = (
        F.coalesce("backend_confidence", F.lit(0.10)) * 0.30 + low(0.30, c("largest_contour_ratio") * 0.30) + low(0.20, c("solidity") * 0.20)
        + low(0.15, F.greatest(F.lit(0.0), tolerance - F.abs(c("occupancy") - target)) / tolerance * 0.15) + low(0.15, c("purity_score") * 0.15)
        - low(0.18, c("border_touch_ratio") * 0.60) - low(0.18, c("bottom_band_ratio") * 0.50) - low(0.18, c("support_area_ratio") * 0.45)
    )
    score = score * F.when(true(c("is_clipped")), 0.70).otherwise(1.0) * F.when(c("fragment_count") > 3, 0.75).otherwise(1.0)
    return masks.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def texture_frame_filter(frames: DataFrame, expected_color: str = "unknown") -> DataFrame:
    """Accepted frames for texturing, with the reasons against the others; helper images by name are out at once."""
    name = F.lower("name").rlike("mask|depth|debug|normal")
    found = codes(
        (c("sharp") < 25.0, "too_blurry"), (c("luminance") < 40.0, "too_dark"), (c("luminance") > 250.0, "too_bright"), (c("clipping_score") > 0.15, "subject_clipped"),
        (F.lit(expected_color == "white_cream") & (c("color_match_score") < 0.22), "color_mismatch_white_cream"),
    )
    reasons = F.when(name, F.array(F.lit("non_rgb_pattern"))).otherwise(found)
    return frames.withColumn("rejection_reasons", reasons).withColumn("accepted", F.size("rejection_reasons") == 0)


def ranking_score(sharpness: Column, luminance: Column, color: Column) -> Column:
    return F.least(sharpness / 500.0, F.lit(1.0)) * 0.4 + (1 - F.abs(luminance - 128) / 128.0) * 0.2 + color * 0.4


def mask_outlier_reject(frames: DataFrame, z: float = 3.0) -> DataFrame:
    """Reject masks that are too small, touch the border with a large component, or jump in time (z columns).

    A z equal to the limit is not over it, whatever last digits the order of its sums gave it.
    """
    limit = z + 1e-12
    found = codes(
        (c("occupancy") < 0.01, "mask_too_small"), (true(c("border_largest")) & (c("occupancy") > 0.2), "large_border_touching_component"), (c("occupancy_z") > limit, "temporal_occupancy_outlier"),
        ((c("cx_z") > limit) | (c("cy_z") > limit), "temporal_centroid_jump"),
    )
    return frames.withColumn("rejection_reasons", found).withColumn("accepted", F.size("rejection_reasons") == 0)


def frame_recapture_gate(sessions: DataFrame, absent: float | None = 0.0) -> DataFrame:
    """Recapture and retry-masks flags of sessions (profile, max_gap, mean_sharpness, bad_masks, frames, fallback_used).

    A missing mean sharpness counts as `absent`; with None the flags that depend on it are null.
    """
    limit = F.when(c("profile") == "bottle", 40.0).when(c("profile") == "box", 60.0).otherwise(45.0)
    gap, blurry = c("max_gap") > limit, ~true(c("fallback_used")) & (F.coalesce("mean_sharpness", F.lit(absent)) < 20.0)
    reason = F.when(blurry, "blurry_capture").when(gap, "missing_side_coverage")
    retry = (c("bad_masks") > c("frames") * 0.3) & ~gap & ~blurry & (c("max_gap") < limit)
    return sessions.withColumns({"recapture": gap | blurry, "recapture_reason": reason, "try_masks": retry})


def orbit_validation(coverage: DataFrame, ratio: float = 0.40, span: float = 270.0, spread: float = 30.0, registered: float = 0.70) -> DataFrame:
    """pass, review or fail of an orbit; below 60 % (70 % for the span) of a limit is a fail, a narrow elevation spread only a review."""
    r = c("registered_ratio")
    short = [(c("coverage_ratio") < ratio, c("coverage_ratio") < ratio * 0.6, "coverage_ratio"), (c("azimuth_span") < span, c("azimuth_span") < span * 0.7, "azimuth_span"),
             (c("elevation_spread") < spread, F.lit(False), "elevation_spread"), (r < registered, r < registered * 0.6, "registered_ratio")]
    fail = F.array_contains(F.array(*(true(f) for _, f, _ in short)), True)
    rows = coverage.withColumn("reasons", codes(*((x, name) for x, _, name in short)))
    return rows.withColumn("verdict", F.when(fail, "fail").when(F.size("reasons") > 0, "review").otherwise("pass"))


def capture_gate(frames: DataFrame, burst=(0.10, 0.25), height=(0.34, 0.10), orbit=(0.40, 0.20), static: float = 0.30, least_frames: int = 8) -> DataFrame:
    """Worst-of decision of each session from blur bursts, height bands, orbit progress and static runs."""
    n = frames.groupBy("session_id").agg(F.count("*").alias("frames"))
    bursts = fr.blur_bursts(frames).groupBy("session_id").agg(F.max("burst_ratio").alias("burst_ratio"))
    rows = n.join(bursts, "session_id", "left").na.fill(0.0, ["burst_ratio"]).join(fr.elevation_distribution(frames).select("session_id", "multi_height_score"), "session_id")
    rows = rows.join(fr.orbit_progress(frames), "session_id").join(fr.static_runs(frames), "session_id")
    step = lambda bad, poor: F.when(bad, "reshoot").when(poor, "review").otherwise("pass")
    b, h, o = c("burst_ratio"), F.round("multi_height_score", 12), F.round("progress", 12)
    still = (c("longest") > 0) & (c("longest") / c("frames") >= static)
    few = c("frames") < least_frames
    decision = worst_of(step(F.lit(False), few), step(b >= burst[1], b >= burst[0]), step(h < height[1], h < height[0]), step(o < orbit[1], o < orbit[0]), step(F.lit(False), still))
    reasons = codes((few, "few_frames"), (b >= burst[0], "blur_burst_ratio"), (h < height[0], "multi_height_score"), (o < orbit[0], "orbit_progress"), (still, "static_run"))
    return rows.select("session_id", decision.alias("decision"), reasons.alias("reasons"))


def reconstruction_preflight(sessions: DataFrame, hard: int = 3, review: int = 8, mismatch: float = 0.10, coverage=(0.15, 0.30), blur=(20.0, 40.0), static=(0.70, 0.40)) -> DataFrame:
    """pass, review or reject from (selected, missing, mismatch_ratio, coverage_ratio, median_blur, static_ratio); zero metrics are unknown. Early reasons stand alone."""
    n, cov, med, st = c("selected"), c("coverage_ratio"), c("median_blur"), c("static_ratio")
    early = (
        F.when(n == 0, "no_keyframes").when(n < hard, "below_hard_minimum").when(c("missing") >= F.greatest(F.lit(1), F.floor(n / 3)), "frames_missing").when(c("mismatch_ratio") > mismatch, "dimension_mismatch")
    )
    step = lambda bad, poor: F.when(bad, "reject").when(poor, "review").otherwise("pass")
    late = worst_of(step(F.lit(False), n < review), step((cov > 0) & (cov < coverage[0]), (cov > 0) & (cov < coverage[1])), step((med > 0) & (med < blur[0]), (med > 0) & (med < blur[1])),
                    step(st > static[0], st > static[1]), order=("pass", "review", "reject"))
    reasons = codes((n < review, "below_review_minimum"), ((cov > 0) & (cov < coverage[1]), "coverage_ratio"), ((med > 0) & (med < blur[1]), "median_blur"), (st > static[1], "static_run"))
    return sessions.withColumns({"decision": F.when(early.isNotNull(), "reject").otherwise(late), "reasons": F.when(early.isNotNull(), F.array(early)).otherwise(reasons)})


def upload_preflight(uploads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Errors of uploads against the limits of their capture profile (`profile_key`); a missing profile takes the default row."""
    rows = uploads.join(profiles, "profile_key", "left")
    short, long = F.least("width", "height"), F.greatest("width", "height")
    mb = F.coalesce("size_mb", F.lit(0.0))
    errors = codes(
        (mb < 0.1, "file_too_small"), ((mb >= 0.1) & (mb > c("max_upload_mb")), "file_too_large"), (c("fps") < c("min_fps"), "fps_too_low"), (c("duration") < c("min_duration"), "too_short"),
        (c("duration") > c("max_duration"), "too_long"), ((short < c("min_short_edge")) | (long < c("min_long_edge")), "resolution_too_low"),
    )
    return rows.withColumn("errors", errors).withColumn("accepted", F.size("errors") == 0)


SIZES, SCENES = ("small", "medium", "large"), ("on_surface", "freestanding", "mounted")
#: Fixed values of the nine presets: image size, Poisson depth, face budget, texture faces, upload MB (null: the default), longest seconds.
PRESETS = {
    ("small", "on_surface"): (2000, 11, 1_000_000, 60_000, 500.0, 60.0), ("small", "freestanding"): (2000, 11, 1_000_000, 60_000, None, 60.0), ("small", "mounted"): (2000, 11, 1_000_000, 60_000, None, None),
    ("medium", "on_surface"): (2500, 10, 2_500_000, 100_000, 900.0, 120.0), ("medium", "freestanding"): (2500, 10, 3_000_000, 100_000, 900.0, 180.0), ("medium", "mounted"): (2500, 10, 2_500_000, 100_000, 900.0, 120.0),
    ("large", "on_surface"): (3500, 9, 6_000_000, 200_000, 2048.0, 240.0), ("large", "freestanding"): (4000, 9, 8_000_000, 250_000, 2560.0, 300.0), ("large", "mounted"): (3500, 9, 6_000_000, 200_000, 2048.0, 240.0),
}
PRESET_COLUMNS = "size string, scene string, max_image_size int, poisson_depth int, mesh_budget long, texture_faces long, upload_mb double, max_seconds double"


def profile_key(key: Column) -> tuple[Column, Column]:
    """Size and scene of a key like `large__mounted`; anything else is small on_surface."""
    k = F.regexp_replace(F.lower(F.trim(key)), "__", "_")
    pattern = f"^({'|'.join(SIZES)})_({'|'.join(SCENES)})$"
    fits = F.coalesce(k.rlike(pattern), F.lit(False))
    return F.when(fits, F.regexp_extract(k, pattern, 1)).otherwise(SIZES[0]), F.when(fits, F.regexp_extract(k, pattern, 2)).otherwise(SCENES[0])


def capture_profile_lookup(sessions: DataFrame, presets: dict = PRESETS) -> DataFrame:
    """Sessions with the preset of their key's size and scene."""
    table = sessions.sparkSession.createDataFrame([(*k, *v) for k, v in presets.items()], PRESET_COLUMNS)
    size, scene = profile_key(c("profile_key"))
    return sessions.withColumns({"size": size, "scene": scene}).join(F.broadcast(table), ["size", "scene"], "left")


def recon_profile(s: DataFrame) -> DataFrame:
    """Material, size, scene and motion classes with confidence 0.25 for each signal read, 1 at most.

    Columns: material_hint, color, size_class, product_value, gate, height_score, blur_median, orbit,
    burst_ratio, static_ratio, frames; nulls are absent signals.
    """
    cap, col, gate = c("material_hint").isNotNull(), c("color").isNotNull(), c("gate").isNotNull()
    hint = F.lower("material_hint")
    by_hint = true(hint.isin("transparent", "glossy", "metallic"))
    dark, cream = true(c("color") == "black") & (c("frames") > 0), true(c("color") == "white_cream") & (c("frames") > 0)
    material = (
        F.when(true(hint == "transparent"), "transparent_reflective").when(by_hint, "glossy").when(dark, "low_texture").when(cream | true(hint == "opaque"), "matte").otherwise("unknown")
    )
    size = F.when(true(c("size_class").isin(*SIZES)), c("size_class")).otherwise("unknown")
    dim = col & true(c("product_value") < 50)
    poor = gate & true((c("blur_median") > 0) & (c("blur_median") < 30) & (c("gate") != "pass"))
    scene = F.when(dim | poor, "low_light").when(gate & true((c("gate") == "pass") & (c("height_score") >= 0.5)), "controlled").otherwise("unknown")
    orbit, burst, still = c("orbit"), c("burst_ratio"), c("static_ratio")
    motion = F.when(gate, F.when((orbit < 0.20) & (still > 0.30), "static_poor").when(burst >= 0.20, "fast_motion").when((still > 0.30) & (orbit >= 0.20), "uneven").when((orbit >= 0.60) & (burst < 0.10), "stable_orbit").otherwise("unknown")).otherwise("unknown")
    n = lambda b: b.cast("int")
    signals = n(cap) + n(col & ~by_hint) + n(size != "unknown") + n(col) + n(gate & ~dim) + n(gate)
    return s.withColumns({"material": material, "size": size, "scene": scene, "motion": motion, "profile_confidence": F.least(F.lit(1.0), signals * 0.25)})


def preset_resolution(profiles: DataFrame) -> DataFrame:
    """Preset name and parameters by material, then scene, then any known class, then the baseline."""
    low_texture = c("material").isin("transparent_reflective", "low_texture")
    any_known = (c("material") != "unknown") | (c("size") != "unknown") | (c("scene") != "unknown") | (c("motion") != "unknown")
    name = F.when(low_texture, "low_texture_safe").when(c("scene") == "low_light", "low_light_safe").when(any_known, "profile_safe").otherwise("baseline")
    rows = profiles.withColumn("preset", name)
    safe, fast = c("preset") == "profile_safe", c("motion") == "fast_motion"
    p = c("preset")
    return rows.withColumns({
        "max_image_size": F.when(p == "low_light_safe", 1600).when(safe & (c("size") == "large"), 3000).when(safe & (c("size") == "medium"), 2500).otherwise(2000).cast("long"),
        "matcher": F.when(p.isin("low_texture_safe", "low_light_safe") | (safe & fast), "sequential").otherwise("exhaustive"),
        "min_matches": F.when(p == "low_texture_safe", 8).when(p == "low_light_safe", 12).when(safe & fast, 10).otherwise(15).cast("long"),
        "patchmatch_level": F.when((p == "low_light_safe") | (safe & (c("size") == "large")), 2).otherwise(1).cast("long"),
        "texture_resolution": F.when((p == "low_light_safe") | (safe & (c("size") == "small")), 2048).when(safe & (c("size") == "large"), 8192).otherwise(4096).cast("long"),
    })


def coverage_report(frames: DataFrame, min_frames: int = 8, min_views: int = 5, x_span: float = 0.10, y_span: float = 0.08, scale: float = 1.15, aspect: float = 0.12) -> DataFrame:
    """Coverage score, status and reasons of each session from readable frames with `is_representative` (see view_dedupe).

    Frames with `readable` false count as unreadable. A strong capture turns hard orbit codes into coaching. The
    columns that count are written first, so that what the frames come from runs once and not for every branch.
    """
    used = ("session_id", "frame_idx", "readable", "is_representative", "fallback_used", "confidence", "cx", "cy", "area", "aspect")
    frames = materialize(frames.select(*used), "coverage")
    ok = frames.filter("readable")
    counts = frames.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if("readable").alias("readable"))
    stats = ok.groupBy("session_id").agg(
        F.count_if("is_representative").alias("views"), F.count_if("fallback_used").alias("fallback"), F.count_if(c("confidence") < 0.6).alias("low_confidence"), (F.max("cx") - F.min("cx")).alias("xs"), (F.max("cy") - F.min("cy")).alias("ys"),
        (F.max("area") / F.greatest(F.min("area"), F.lit(1e-6))).alias("scale"), (F.max("aspect") - F.min("aspect")).alias("aspect"),
    )
    rows = counts.join(stats, "session_id", "left").join(fr.geometric_orbit(ok).select("session_id", "hard_codes", "soft_codes"), "session_id", "left")
    one = F.lit(1.0)
    score = (
        F.least(one, c("readable") / min_frames) * 0.30 + F.least(one, c("views") / min_views) * 0.40 + F.least(one, F.greatest(c("xs") / 0.18, c("ys") / 0.14)) * 0.15
        + F.least(one, F.greatest((c("scale") - 1) / 0.35, c("aspect") / 0.22)) * 0.15
    )
    rows = rows.withColumn("score", F.when(c("readable") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(one, score))))
    strong = (c("views") >= min_views * 1.2) & (c("score") >= 0.65)
    narrow, flat = (c("xs") < x_span) & (c("ys") < y_span), (c("scale") < scale) & (c("aspect") < aspect)
    empty = F.array().cast("array<string>")
    hard = codes(
        (c("readable") < min_frames, "too_few_frames"), (c("views") < min_views, "few_views"), (c("n") - c("readable") > c("n") * 0.5, "unreadable"), (c("fallback") > F.greatest(one, c("readable") * 0.5), "fallback"),
        (c("low_confidence") > F.greatest(one, c("readable") * 0.4), "low_confidence"), (narrow & flat, "narrow_motion_and_scale"),
    )
    hard = F.concat(hard, F.when(strong, empty).otherwise(F.coalesce("hard_codes", empty)))
    coaching = F.when(strong, F.transform("hard_codes", lambda x: F.concat(x, F.lit("_COACHING")))).otherwise(empty)
    soft = F.concat(F.coalesce("soft_codes", empty), codes((narrow & ~flat, "limited_motion")), coaching)
    none = c("readable") == 0
    rows = rows.withColumns({"hard": F.when(none, F.array(F.lit("no_readable_frames"))).otherwise(hard), "soft": F.when(none, empty).otherwise(soft)})
    status = F.when(F.size("hard") == 0, "sufficient").otherwise("insufficient")
    return rows.select("session_id", "n", "readable", F.coalesce("views", F.lit(0)).alias("views"), "score", status.alias("status"), "hard", "soft")
