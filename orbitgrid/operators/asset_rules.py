"""Rule sets over delivered assets: each adds verdict columns, none moves rows.

A null column stands for an absent key. Verdicts are pass, review or fail; reason lists keep
the order in which rules are tested.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitgrid.functions.text import normalize_status

c = F.col
DELIVERY = ("mobile_preview", "mobile_high", "desktop_high")
#: Delivery profile -> (review above, fail above)
POLY_LIMITS = {"mobile_preview": (45_000, 50_000), "mobile_high": (130_000, 150_000), "desktop_high": (220_000, 250_000)}
POLY_DEFAULT = (50_000, 150_000)


def codes(*pairs: tuple[Column, str]) -> Column:
    """Codes of the conditions that hold, in order; an unknown condition does not hold."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(code)) for cond, code in pairs)))


def true(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with columns that are computed once, however often later ones name them: what a generator gives is not computed anew above it."""
    kept = [x for x in rows.columns if x not in columns]
    packed = F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("__once")
    return rows.select("*", packed).select(*kept, "__once.*")


def verdict(fail: Column, review: Column) -> Column:
    return F.when(true(fail), "fail").when(true(review), "review").otherwise("pass")


def polycount_gate(assets: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Polygon count against the profile's limits; raw_archive always passes, unknown profiles have the default limits."""
    n, profile = c("poly_count"), F.lower("delivery_profile")
    out = verdict(n > POLY_DEFAULT[1], n > POLY_DEFAULT[0])
    for name, (review, fail) in (limits or POLY_LIMITS).items():
        out = F.when(profile == name, verdict(n > fail, n > review)).otherwise(out)
    return assets.withColumn("polycount", F.when(profile == "raw_archive", "pass").otherwise(out))


def bbox_ground_gate(assets: DataFrame, max_cm: float = 500.0, ground_cm: float = 1.0) -> DataFrame:
    """Box dimensions in order (the first that is not positive fails, the first that is too large reviews); ground offset."""
    box = F.lit("pass")
    for d in ("depth", "height", "width"):
        box = F.when(c(d) <= 0, "fail").when(c(d) > max_cm, "review").otherwise(box)
    missing = c("width").isNull() | c("height").isNull() | c("depth").isNull()
    ground = F.when(F.abs("ground_offset") <= ground_cm, "pass").otherwise("review")
    return assets.withColumns({"bbox_check": F.when(missing, "fail").otherwise(box), "ground_check": ground})


def material_semantics(status: Column) -> Column:
    s = F.lower(status)
    return F.when(s.isin("pbr_complete", "pbr_partial", "diffuse_textured"), "pass").when(s.isin("uv_only", "material_incomplete"), "review").otherwise("fail")


def texture_integrity_rules(assets: DataFrame) -> DataFrame:
    """uv, application and material checks by status, counts and flags; trusted where the counts are absent."""
    uv, material, applied = true(c("has_uv")), true(c("has_material")), true(c("texture_applied"))
    given, count = c("texture_count").isNotNull(), F.coalesce("texture_count", F.lit(0))
    stated = F.lower(F.coalesce("texture_integrity_status", F.lit("missing")))
    whole = uv & material & (count > 0)
    status = F.when((stated == "complete") & given & ~whole, F.when(~uv, "geometry_only").otherwise("missing")).otherwise(stated)
    semantics = F.coalesce(c("material_semantic_status"), F.when(uv, "uv_only").otherwise("geometry_only"))
    trust_complete = ~given & ~applied
    trust_missing = ~given & c("has_uv").isNull()

    def check(holds: Column, in_complete: Column, in_missing: Column) -> Column:
        return (
            F.when(status == "complete", F.when(trust_complete | (applied & whole) | in_complete, "pass").otherwise("fail"))
            .when(status == "degraded", F.when(holds, "pass").otherwise("review"))
            .otherwise(F.when(trust_missing, in_missing).otherwise(F.when(holds, "pass").otherwise("fail")))
        )

    return assets.withColumns({
        "uv_integrity": check(uv, uv, F.lit("pass")),
        "application": check(count > 0, applied & (count > 0), F.when(status == "missing", "fail").otherwise("pass")),
        "material_integrity": check(material, material, F.lit("pass")),
        "semantics": material_semantics(semantics),
        "texture_status": status,
    })


def contamination_checks(share=(0.85, 0.70), max_components=5, plane=(0.20, 0.30), min_compactness=0.01, min_score=0.20) -> dict[str, Column]:
    """Seven checks of isolation statistics (component_share null: no statistics, no checks)."""
    s = c("component_share")
    one = F.coalesce(c("component_count"), F.lit(1))
    return {
        "component_dominance": F.when(s >= share[0], "pass").when(s >= share[1], "review").otherwise("fail"),
        "scene_reduction_ratio": F.when(c("face_ratio") > 0, "pass").otherwise("fail"),
        "component_count": F.when(one == 1, "pass").when(one <= max_components, "review").otherwise("fail"),
        "plane_contamination": F.when((c("plane_share") <= plane[0]) & (c("plane_vertex_ratio") <= plane[1]), "pass").otherwise("review"),
        "compactness": F.when(c("compactness") >= min_compactness, "pass").otherwise("review"),
        "selection_quality": F.when(c("selected_score") >= min_score, "pass").otherwise("review"),
        "isolation_quality": F.when(c("isolation_status") == "fail", "fail").when(c("isolation_status") == "review", "review").otherwise("pass"),
    }


def contamination_rules(assets: DataFrame, **thresholds) -> DataFrame:
    """`contamination`: map of check to verdict; empty where isolation statistics are absent."""
    checks = F.create_map(*(x for k, v in contamination_checks(**thresholds).items() for x in (F.lit(k), v)))
    none = F.create_map().cast("map<string,string>")
    return assets.withColumn("contamination", F.when(c("component_share").isNull(), none).otherwise(checks))


def decimation_check() -> Column:
    """Visual integrity first, then errors, a trusted texture, UV and material preservation."""
    s = F.lower(F.coalesce("decimation_status", F.lit("none")))
    uv_lost = ~F.coalesce("uv_preserved", F.lit(True)) | (s == "failed_uv_preservation")
    return (
        F.when(s == "failed_visual_integrity", "fail").when(s.contains("error"), "review").when(F.coalesce("texture_integrity_status", F.lit("missing")) == "complete", "pass")
        .when(uv_lost, "fail").when(~F.coalesce("material_preserved", F.lit(True)), "review").otherwise("pass")
    )


def accessor_delivery_checks(fragments=(2, 5)) -> dict[str, Column]:
    """Accessor, delivery, export, filtering and decimation checks; a null verdict means the check does not apply."""
    yes = lambda cond: F.when(true(cond), "pass").otherwise("fail")
    profile = F.lower(F.coalesce("delivery_profile", F.lit("raw_archive")))
    to_deliver = profile.isin(*DELIVERY)
    ready = F.coalesce(c("export_ready"), true(c("has_position")) & true(c("has_normal")))
    export = F.lower(F.coalesce("export_status", F.lit("unknown")))
    n, status = c("fragment_count"), F.lower("filtering_status")
    return {
        "accessor_position": yes(c("has_position")),
        "accessor_normal": yes(c("has_normal")),
        "accessor_uv": F.when(F.lower(F.coalesce("material_semantic_status", F.lit("geometry_only"))) == "geometry_only", "pass").otherwise(yes(c("has_texcoord"))),
        "delivery_geometry": F.when(c("geometry_count").isNotNull(), yes(c("geometry_count") > 0)),
        "delivery_fragmentation": F.when(n.isNotNull(), F.when(n <= fragments[0], "pass").when(n <= fragments[1], "review").otherwise("fail")),
        "export_status": F.when(export.isin("success", "unknown"), "pass").when(export.isin("failed_texture_application", "failed_texture_quality", "failed_validation"), "fail").otherwise("review"),
        "export_delivery_gate": F.when(to_deliver, yes(ready)).otherwise("pass"),
        "object_filtering": F.when(status.isNull(), F.when(to_deliver, "review").otherwise("pass")).when(status == "object_isolated", "pass").when(status == "failed", "fail").otherwise("review"),
        "decimation": decimation_check(),
    }


def accessor_delivery_rules(assets: DataFrame, **thresholds) -> DataFrame:
    """`checks`: map of the checks that apply to their verdicts."""
    every = F.create_map(*(x for k, v in accessor_delivery_checks(**thresholds).items() for x in (F.lit(k), v)))
    return assets.withColumn("checks", F.map_filter(every, lambda _, v: v.isNotNull()))


def texture_quality_check(allow_skip: bool = False) -> Column:
    """The stated texture quality; where absent, by whether the asset is textured and for delivery."""
    textured = ~F.coalesce("material_semantic_status", F.lit("geometry_only")).isin("geometry_only", "unknown")
    absent = F.when(F.lit(allow_skip) | ~textured | (c("delivery_profile") == "raw_archive"), "pass").when(c("delivery_profile").isin(*DELIVERY), "review").otherwise("fail")
    return F.when(c("texture_quality_status").isNotNull(), normalize_status(c("texture_quality_status"))).otherwise(absent)


def asset_validation(assets: DataFrame, allow_skip: bool = False, mobile_limit: int = 150_000) -> DataFrame:
    """All checks of an asset with blocking, warning and passed lists, decision, delivery status, scores, source and grades."""
    rows = contamination_rules(texture_integrity_rules(bbox_ground_gate(polycount_gate(assets))))
    named = {
        "polycount": c("polycount"), "bbox": c("bbox_check"), "ground_alignment": c("ground_check"), "texture_quality": texture_quality_check(allow_skip),
        "material_semantics": material_semantics(F.coalesce("material_semantic_status", F.lit("geometry_only"))),
        "texture_uv_integrity": c("uv_integrity"), "texture_application": c("application"), "texture_material_integrity": c("material_integrity"), "texture_material_semantics": c("semantics"),
        **accessor_delivery_checks(),
    }
    named = {(f"delivery_{k}" if k in ("delivery_geometry", "delivery_fragmentation") else k): v for k, v in named.items()}
    named |= {f"contamination_{k}": F.when(c("component_share").isNotNull(), v) for k, v in contamination_checks().items()}
    order = sorted(named)
    for i in range(0, len(order), 3):  # a few at once: methods that the JVM compiles
        rows = once(rows, **{f"__{k}": named[k] for k in order[i : i + 3]})
    for name, v in (("blocking", "fail"), ("warnings", "review"), ("passed", "pass")):
        rows = once(rows, **{name: F.array(*(F.when(c(f"__{k}") == v, F.lit(k)) for k in order))})
    rows = once(rows, **{name: F.array_compact(name) for name in ("blocking", "warnings", "passed")})
    every = F.array(*(F.struct(F.lit(k).alias("check"), c(f"__{k}").alias("verdict")) for k in order))
    rows = rows.withColumn("checks", F.map_from_entries(F.filter(every, lambda x: x["verdict"].isNotNull()))).drop(*(f"__{k}" for k in order))
    decision = F.when(F.size("blocking") > 0, "fail").when(F.size("warnings") > 0, "review").otherwise("pass")
    rows = rows.withColumn("decision", decision)
    raw = c("delivery_profile") == "raw_archive"
    status = F.when(raw, "archive_only").when(c("decision") == "pass", "delivery_ready").when(c("decision") == "review", "review").otherwise("failed")
    ready = ~raw & (c("decision") != "fail")
    over = ready & c("delivery_profile").isin("mobile_preview", "mobile_high") & (c("poly_count") > mobile_limit)
    geometry = (1 - F.coalesce("component_share", F.lit(1.0))) * 0.85 + F.when(c("component_share").isNotNull(), F.coalesce("plane_share", F.lit(0.0))).otherwise(0.0) * 0.15
    has = lambda word: F.exists("blocking", lambda x: x.contains(word))
    source = F.when(F.size("blocking") > 0, F.when(has("contamination"), "isolation").when(has("texture"), "texturing").when(F.array_contains("blocking", "polycount"), "reconstruction_density").otherwise("generic"))
    n, sem = c("poly_count"), F.lower(F.coalesce("material_semantic_status", F.lit("geometry_only")))
    return rows.withColumns({
        "delivery_status": status, "mobile_ready": ready & ~over,
        "warnings": F.when(over, F.concat("warnings", F.array(F.lit("mobile_limit_gate")))).otherwise(c("warnings")),
        "decision": F.when(over & (c("decision") == "pass"), "review").otherwise(c("decision")),
        "geometry_contamination": geometry, "contamination_score": geometry * 0.5 + F.when(c("texture_quality_status").isNotNull(), F.coalesce("background_ratio", F.lit(0.0))).otherwise(0.0) * 0.5,
        "failure_source": source,
        "performance_grade": F.when(n <= 25_000, "A").when(n <= 50_000, "B").when(n <= 150_000, "C").otherwise("D"),
        "material_grade": F.when(sem == "pbr_complete", "S").when(sem == "pbr_partial", "A").when(sem == "diffuse_textured", "B").when(sem == "uv_only", "C").otherwise("F"),
    })


def ar_publish_gate(assets: DataFrame) -> DataFrame:
    """Verdict of validator and optimiser statuses: errors reject, warnings and failures review, missing tools only tell."""
    v, o = c("validator_status"), c("optimizer_status")
    reasons = codes((v == "error", "validation_errors"), (v == "warning", "validation_warnings"), (v == "unavailable", "validator_unavailable"), (o == "failed", "optimization_failed"), (o == "unavailable", "optimizer_unavailable"))
    suggestions = codes((v == "error", "fix_validation_errors"), (v == "warning", "review_validation_warnings"), (o == "failed", "check_optimizer"))
    out = F.when(true(v == "error"), "reject").when(true(v == "warning") | true(o == "failed"), "review").otherwise("pass")
    return assets.withColumns({"ar_verdict": out, "ar_reasons": reasons, "ar_suggestions": suggestions})


def ar_readiness(assets: DataFrame, small_mb: float = 5.0, large_mb: float = 10.0) -> DataFrame:
    """AR score: cap 30 without provider success, then penalties for size, texture, counts, validation and review; no output is 0."""
    ok, mb, tex = true(c("provider_status") == "ok"), F.coalesce("size_mb", F.lit(0.0)), c("texture_resolution")
    invalid = true(~c("glb_valid"))
    penalty = (
        F.when(mb > large_mb, 30).when(mb > small_mb, 10).otherwise(0) + F.when(true(tex >= 2048), 10).otherwise(0) + F.when(true(c("vertex_count") > 50_000), 20).otherwise(0)
        + F.when(true(c("face_count") > 100_000), 10).otherwise(0) + F.when(invalid, 40).otherwise(0) + F.when(F.coalesce("review_required", F.lit(True)), 5).otherwise(0)
    )
    score = F.when(c("has_output"), F.greatest(F.lit(0), F.least(F.lit(100), F.when(ok, 100).otherwise(30) - penalty))).otherwise(0).cast("long")
    warnings = F.when(c("has_output"), codes(
        (~ok, "provider_status_not_ok"), (mb > large_mb, "file_size_too_large"), ((mb > small_mb) & (mb <= large_mb), "file_size_large"), (tex >= 2048, "texture_resolution_2048"),
        (c("vertex_count") > 50_000, "vertex_count_high"), (c("face_count") > 100_000, "face_count_high"), (invalid, "glb_validation_failed"))).otherwise(F.array(F.lit("glb_output_missing")))
    rows = assets.withColumns({"ar_score": score, "ar_warnings": warnings})
    out = F.when(~c("has_output"), "not_ready").when(ok & ~invalid & (c("ar_score") >= 80), "mobile_ready").when(c("ar_score") >= 50, "review").otherwise("not_ready")
    return rows.withColumn("ar_readiness", out)


#: Penalties and limits of the asset quality score.
QUALITY = {"invalid": 30, "mesh_failed": 25, "mesh_review": 10, "floating": 10, "degenerate": 5, "faces": 10, "no_materials": 15, "no_base_color": 10, "no_texture": 5, "production": 85, "mobile": 65, "review": 40}


def asset_quality_score(assets: DataFrame, p: dict[str, int] = QUALITY) -> DataFrame:
    """Penalty score with severity override and AR downgrade; columns cleanup_status, floating_parts, degenerate_faces, material_count, has_base_color, ar_readiness."""
    invalid, mesh = true(~c("glb_valid")), F.coalesce("cleanup_status", F.lit("ok"))
    none, base = true(c("no_materials")), true(~c("has_base_color"))
    take = lambda cond, key: F.when(true(cond), p[key]).otherwise(0)
    penalty = (
        take(invalid, "invalid") + F.when(mesh == "failed", p["mesh_failed"]).when(mesh == "review", p["mesh_review"]).otherwise(0) + take(c("floating_parts"), "floating") + take(c("degenerate_faces") > 100, "degenerate")
        + take(c("face_count") > 200_000, "faces") + F.when(none, p["no_materials"]).when(base, p["no_base_color"]).otherwise(0) + take((F.coalesce("texture_count", F.lit(0)) == 0) & (c("material_count") > 0), "no_texture")
    )
    rows = assets.withColumn("quality_score", F.when(c("has_output"), F.greatest(F.lit(0), 100 - penalty)).otherwise(0).cast("long"))
    s = c("quality_score")
    first = (
        F.when(~c("has_output"), "not_ready").when(invalid | (mesh == "failed"), "needs_review").when((s >= p["production"]) & (mesh == "ok"), "production_ready")
        .when(s >= p["mobile"], "mobile_ready").when(s >= p["review"], "needs_review").otherwise("not_ready")
    )
    rows = rows.withColumn("__v", first)
    down = (c("__v") == "mobile_ready") & true(c("ar_readiness") == "not_ready")
    found = F.when(c("has_output"), codes((invalid, "glb_validation_failed"), (mesh == "failed", "mesh_cleanup_failed"), (mesh == "review", "mesh_cleanup_review"), (c("floating_parts"), "floating_parts_detected"),
        (c("degenerate_faces") > 100, "degenerate_faces_detected"), (none | base, "pbr_review_required"), (down, "ar_readiness_not_ready_downgrade"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"quality_warnings": found, "quality_verdict": F.when(down, "needs_review").otherwise(c("__v"))}).drop("__v")
    status = F.when((c("quality_verdict") == "not_ready") | ~c("has_output"), "failed").when((c("quality_verdict") == "needs_review") | (F.size("quality_warnings") > 0), "review").otherwise("ok")
    return rows.withColumn("quality_status", status)


def mesh_audit_rules(meshes: DataFrame, faces=(200_000, 500_000), vertices: int = 200_000, bounds=(0.001, 1000.0), tiny: float = 0.05) -> DataFrame:
    """Issue and warning lists of mesh metrics and the status; no mesh at all is failed."""
    n = c("faces")
    issues = codes((c("vertices").isNull(), "no_mesh_found"), (n > faces[1], "excessive_face_count"), (c("degenerate_faces") > 100, "significant_degenerate_faces"), (c("span") < bounds[0], "suspiciously_small_bounds"), (c("span") > bounds[1], "suspiciously_large_bounds"))
    warnings = codes(
        ((n > faces[0]) & (n <= faces[1]), "high_face_count"), (c("vertices") > vertices, "high_vertex_count"), ((c("components") > 1) & (c("largest_ratio") < 1 - tiny), "floating_parts_detected"),
        (c("degenerate_faces").between(1, 100), "degenerate_faces"), (c("boundary") > 0, "open_mesh_boundary_edges"), (c("non_manifold") > 0, "non_manifold_geometry"), (c("components") > 3, "high_component_count"),
    )
    rows = meshes.withColumns({"issues": issues, "audit_warnings": warnings})
    status = F.when(F.array_contains("issues", "no_mesh_found"), "failed").when((F.size("issues") > 0) | (F.size("audit_warnings") > 0), "review").otherwise("ok")
    return rows.withColumn("audit_status", status)


def export_profile_readiness(assets: DataFrame) -> DataFrame:
    """One row for each asset and delivery profile with ready flag, blocking reasons and warnings."""
    none, invalid, mb, n, mesh = ~c("has_output"), true(~c("glb_valid")), F.coalesce("size_mb", F.lit(0.0)), c("face_count"), F.coalesce("cleanup_status", F.lit("ok"))
    common = [(none, "glb_missing"), (invalid, "glb_validation_failed")]
    review = (mesh.isin("review", "failed"), "mesh_cleanup_review")
    floating, manifold = (c("floating_parts"), "floating_parts_detected"), (c("non_manifold"), "non_manifold_geometry")
    profiles = {
        "raw": (codes((none, "glb_missing")), codes()),
        "web_preview": (codes(*common, (mb > 50, "file_size_too_large_for_web"), (n > 1_000_000, "face_count_too_high_for_web")), codes(review, floating, manifold)),
        "mobile_ar": (codes(*common, (mb > 10, "file_size_too_large_for_mobile"), (n > 100_000, "face_count_too_high_for_mobile"), (c("ar_readiness") == "not_ready", "ar_readiness_not_ready"), (mesh == "failed", "mesh_cleanup_failed"),
            (mesh == "review", "mesh_cleanup_required"), floating, manifold, (c("components") > 3, "high_component_count"), (c("ground_uncertain"), "ground_alignment_uncertain")), codes()),
        "desktop_high": (codes(*common), codes(review)),
    }
    empty = F.array().cast("array<string>")
    rows = F.array(*(F.struct(F.lit(k).alias("profile"), F.coalesce(b, empty).alias("blocking"), F.coalesce(w.cast("array<string>"), empty).alias("warnings")) for k, (b, w) in profiles.items()))
    return assets.select("asset_id", F.explode(rows).alias("p")).select("asset_id", "p.profile", (F.size("p.blocking") == 0).alias("ready"), "p.blocking", "p.warnings")


#: tier -> (target faces, recommended without need)
LOD_TIERS = (("preview", 10_000, True), ("mobile", 25_000, True), ("desktop", 75_000, False))


def lod_plan(meshes: DataFrame, tiers=LOD_TIERS) -> DataFrame:
    """One row for each mesh and tier: recommended by default or where the mesh has more faces than the target."""
    rows = F.array(*(F.struct(F.lit(n).alias("tier"), F.lit(f).cast("long").alias("target_faces"), F.lit(r).alias("default")) for n, f, r in tiers))
    out = meshes.select("asset_id", "face_count", F.explode(rows).alias("t"))
    return out.select("asset_id", "t.tier", "t.target_faces", (c("t.default") | true(c("face_count") > c("t.target_faces"))).alias("recommended"))


def generation_quality_gate(runs: DataFrame) -> DataFrame:
    """Verdict and reason of a generation run from provider status, output and review flag."""
    s, has = F.coalesce("provider_status", F.lit("failed")), c("has_output")
    out = F.when(s.isin("unavailable", "busy"), "unavailable").when((s != "ok") | ~has, "failed").when(c("review_required"), "review").otherwise("ok")
    reason = (
        F.when(s.isin("unavailable", "busy"), F.coalesce(c("error"), F.lit("provider_unavailable"))).when(s != "ok", F.coalesce(c("error"), F.lit("provider_failed")))
        .when(~has, "output_glb_missing").when(c("review_required"), "ai_generated_asset_requires_review")
    )
    return runs.withColumns({"gate": out, "gate_reason": reason})


def pipeline_routing(requests: DataFrame) -> DataFrame:
    """Pipeline, reason and fallback by intent, input type and capture quality, in that priority."""
    good = true(c("capture_quality").isin("good", "fair"))
    intent, kind = c("user_intent"), c("input_type")
    cases = (
        (intent == "debug", ("depth_studio", "debug_intent_requested", "ai_generated_3d")),
        (kind == "image", ("ai_generated_3d", "single_image_best_served_by_ai_generation", "depth_studio")),
        ((intent == "advanced") & good, ("real_reconstruction", "advanced_intent_with_good_video_capture", "ai_generated_3d")),
        (good & (intent != "fast"), ("ai_generated_3d", "video_default_ai_generation_first", "real_reconstruction")),
    )
    last = ("ai_generated_3d", "video_fast_or_low_quality_ai_generation", "depth_studio")
    pick = lambda i: reduce(lambda out, x: F.when(true(x[0]), x[1][i]).otherwise(out), reversed(cases), F.lit(last[i]))
    return requests.withColumns({"pipeline": pick(0), "reason": pick(1), "fallback": pick(2)})


def candidate_score(candidates: DataFrame) -> DataFrame:
    """Additive score of a generation candidate, 0 at least. Foreground ratios 0.03-0.05 and 0.85-0.90 score nothing."""
    give = lambda cond, n: F.when(true(cond), float(n)).otherwise(0.0)
    r, w = c("foreground_ratio"), F.coalesce("warning", F.lit(""))
    parts = {
        "provider_ok": give(c("provider_status") == "ok", 50), "output_exists": give(c("has_output"), 20),
        "output_size": F.when(true(c("has_output")), F.least(F.coalesce("size_kb", F.lit(0.0)) * 0.01, F.lit(15.0))).otherwise(0.0),
        "background_removed": give(c("background_removed"), 8), "rembg": give(c("mask_source") == "rembg", 5) + give(c("bbox_source") == "rembg_alpha", 4),
        "foreground": F.when(r.isNull(), 0.0).when(r.between(0.15, 0.70), 6.0).when(((r >= 0.05) & (r < 0.15)) | ((r > 0.70) & (r <= 0.85)), 3.0).when(r < 0.03, -8.0).when(r > 0.90, -6.0).otherwise(0.0),
        "fallback": give(c("crop_method") == "fallback_center_crop", -5) + F.when(w.contains("rembg_unavailable"), -4.0).when(w.contains("rembg_failed"), -6.0).when(w.contains("rembg_empty_alpha"), -8.0).otherwise(0.0),
        "bbox": F.when(true(c("has_bbox")), 3.0).otherwise(-5.0) + F.when(~true((c("crop_w") > 0) & (c("crop_h") > 0)), -5.0).when(c("crop_w") * c("crop_h") < c("image_area") * 0.02, -4.0).otherwise(0.0),
        "prepared": give(c("has_prepared"), 5), "error": give(c("has_errors"), -20),
        "warnings": give(w.contains("no_mask_or_bbox_using_center_crop"), -3) + give(w.rlike("(^|,)(input_video_best_frame_used|frame_selection_failed)"), -2),
    }
    total = reduce(lambda a, b: a + b, parts.values())
    return candidates.withColumns({"score": F.greatest(F.lit(0.0), F.bround(total, 2)), "breakdown": F.struct(*(v.alias(k) for k, v in parts.items()))})


def attempt_score(attempts: DataFrame, require_texture: bool = False) -> DataFrame:
    """Rank score of a reconstruction attempt from images, points, mesher, masks and texture."""
    textured = true(c("has_texture"))
    need = F.lit(require_texture) & (F.coalesce("engine", F.lit("")) != "colmap_dense")
    score = (
        F.coalesce("registered", F.lit(0)) * 100.0 + F.coalesce("points", F.lit(0)) * 0.5 + F.coalesce("dense_points", F.lit(0)) * 0.1
        + F.when(c("mesher") == "failed", -5000.0).when(c("mesher").isin("poisson", "delaunay", "simulated"), 2000.0).otherwise(0.0)
        - F.when(true(c("forced_unmasked")), 250.0).otherwise(0.0) - F.when(true(~c("dense_mask_valid")) & true(c("mask_mode") == "masked"), 500.0).otherwise(0.0)
        + F.when(textured, 3000.0).when(need, -4000.0).otherwise(0.0)
    )
    return attempts.withColumn("attempt_score", score)


def _face_score(faces: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(faces + 1) / 5.0)


def _flat(ratio: Column) -> Column:
    return F.when(ratio >= 0.10, 1.0).otherwise(ratio / 0.10)


def mesh_candidate_score(meshes: DataFrame) -> DataFrame:
    """0.30 faces + 0.20 compactness + 0.15 centrality + 0.25 flatness + 0.10 fragments; no faces is 0."""
    total = (
        _face_score(c("faces")) * 0.30 + F.least(F.lit(1.0), c("compactness") * 4.0) * 0.20 + F.exp(-c("center_distance") / 10.0) * 0.15
        + _flat(c("flatness")) * 0.25 + F.exp(-(F.when(c("faces") > 1_000_000, 1).otherwise(c("components")) - 1) / 4.0) * 0.10
    )
    return meshes.withColumn("total_score", F.when(c("faces") > 0, total).otherwise(0.0))


def component_score(components: DataFrame) -> DataFrame:
    """Geometry score of six terms, blended with mask support (halved if under 3 of over 10 views) and point support where present."""
    faces = F.greatest(c("faces"), F.lit(1))
    ratio = c("longest") / F.greatest(c("shortest"), F.lit(1e-8))
    penalty = lambda x, limit, low: F.when(x <= limit, 1.0).otherwise(F.greatest(F.lit(low), limit / x))
    geom = (
        _face_score(faces) * 0.30 + F.least(F.lit(1.0), c("compactness") * 4.0) * 0.20 + _flat(c("flatness")) * 0.20 + F.exp(-c("center_distance") / 5.0) * 0.15
        + penalty(ratio, 12.0, 0.2) * 0.10 + penalty(c("footprint"), 10.0, 0.15) * 0.05
    )
    rows = components.withColumns({"geom_score": geom, "mask_score": F.coalesce(c("avg_support") * 0.7 + c("hit_ratio") * 0.3, F.lit(0.0)), "pc_score": F.coalesce("point_support", F.lit(0.0))})
    masked = c("avg_support").isNotNull()
    few = F.when((c("supported_views") < 3) & (c("views") > 10), 0.5).otherwise(1.0)
    total = F.when(masked, (c("geom_score") * 0.4 + c("mask_score") * 0.6) * few).otherwise(c("geom_score"))
    blended = F.when(masked, total * 0.7 + c("pc_score") * 0.3).otherwise(total * 0.6 + c("pc_score") * 0.4)
    return rows.withColumn("component_score", F.when(c("point_support").isNotNull(), blended).otherwise(total))


def completion_policy(assets: DataFrame, completion: float = 0.50, production: float = 0.70, preview: float = 0.30, synth_review: float = 0.50, synth_production: float = 0.20) -> DataFrame:
    """Whether to complete an asset, the target status, and the final one after the synthesised share; a profile threshold of 0 counts as unset."""
    own = c("profile_production") if "profile_production" in assets.columns else F.lit(None).cast("double")
    limit = F.when(own.isNull() | (own == 0), production).otherwise(own)
    r = c("observed_ratio")
    target = (
        F.when(~c("completion_enabled"), "skipped_disabled").when(c("provider") == "none", "skipped_provider_none").when(r >= limit, "skipped_sufficient")
        .when(r >= completion, "review_ready").when(r >= preview, "preview_only").otherwise("failed")
    )
    rows = assets.withColumn("target_status", target)
    s = c("synthesized_ratio")
    final = F.when((c("target_status") == "review_ready") & (s > synth_review), "preview_only").when(
        (c("target_status") == "production_candidate") & (s > synth_production), F.when(s <= synth_review, "review_ready").otherwise("preview_only")).otherwise(c("target_status"))
    return rows.withColumns({"should_run": c("target_status").isin("review_ready", "preview_only"), "final_status": final})


def synthesized_ratio(before: Column, after: Column) -> Column:
    return F.when(after <= 0, 0.0).when(before <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0), after - before) / after))


def coverage_class(assets: DataFrame, completion_enabled: bool = True, depth_enabled: bool = True, min_iou: float = 0.85, max_leakage: float = 0.05, min_confidence: float = 0.75) -> DataFrame:
    """Coverage tier, whether completion may run, and whether depth priors may, with the reasons against them."""
    r = c("observed_ratio")
    status = F.when(r >= 0.70, "production_candidate").when(r >= 0.50, "review_ready").when(r >= 0.30, "preview_only").otherwise("failed")
    against = codes((c("iou") < min_iou, "iou"), (c("leakage") > max_leakage, "leakage"), (c("mask_confidence") < min_confidence, "confidence"), (F.lit(not depth_enabled), "disabled"))
    return assets.withColumns({"coverage_status": status, "completion_allowed": F.lit(completion_enabled) & (r >= 0.30) & (r < 0.70), "depth_reasons": against}).withColumn("depth_allowed", F.size("depth_reasons") == 0)


def geometry_grade(meshes: DataFrame) -> DataFrame:
    """Reasons and grade from share, holes, slivers, manifold ratio and winding; one harmless reason is B."""
    reasons = codes((c("largest_share") < 0.5, "primary_share"), (c("hole_area_ratio") > 0.30, "holes"), (c("aspect_p99") > 200, "slivers"), (c("manifold_ratio") < 0.85, "manifold"), (~c("winding_consistent"), "winding"))
    empty = (F.coalesce("faces", F.lit(0)) == 0) | (F.coalesce("vertices", F.lit(0)) == 0)
    rows = meshes.withColumn("reasons", F.when(empty, F.array(F.lit("empty_mesh"))).otherwise(reasons))
    mild = (F.size("reasons") == 1) & ~F.arrays_overlap("reasons", F.array(F.lit("manifold"), F.lit("winding")))
    grade = F.when(empty, "F").when(F.size("reasons") == 0, "A").when(mild, "B").when((c("faces") < 1000) | true(c("largest_share") < 0.30), "F").otherwise("C")
    return rows.withColumn("grade", grade)


def texture_repair_compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whether a repaired texture is better: a better grade, or 0.2 more colour match without 0.01 more neon."""
    rank = lambda g: F.instr(F.lit("FDCBA"), c(g))
    both = old.select("asset_id", *(c(x).alias(f"old_{x}") for x in ("grade", "color_match", "neon"))).join(new.select("asset_id", "grade", "color_match", "neon"), "asset_id")
    better = (rank("grade") > rank("old_grade")) | ((c("color_match") > c("old_color_match") + 0.2) & (c("neon") <= c("old_neon") + 0.01))
    return both.select("asset_id", better.alias("is_better"))
