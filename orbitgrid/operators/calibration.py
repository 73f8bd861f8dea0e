"""Heuristics against labelled fixtures, guidance, training labels, scorecards and benchmark runs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from orbitgrid.functions.text import grade_letter, grade_rank
from orbitgrid.operators.asset_rules import codes, true

c = F.col


def expected_vs_predicted(fixtures: DataFrame) -> DataFrame:
    """expected, predicted and correct from label, expected_action, coverage_status and decision (null: no validation report)."""
    expected = F.when(true(c("expected_action") == "accept") | true(F.lower("label") == "good"), "accept").otherwise("recapture")
    covered = true(c("coverage_status") == "sufficient")
    predicted = F.when(covered & ~true(c("decision") == "fail"), "accept").otherwise("recapture")
    return fixtures.withColumns({"expected": expected, "predicted": predicted}).withColumn("correct", c("expected") == c("predicted"))


def _counts() -> dict[str, Column]:
    e, p = c("expected") == "recapture", c("predicted") == "recapture"
    return {"tp": F.count_if(e & p), "tn": F.count_if(~e & ~p), "fp": F.count_if(~e & p), "fn": F.count_if(e & ~p)}


def _rates(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    total, div = c("tp") + c("tn") + c("fp") + c("fn"), lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    precision, recall = div(c("tp"), c("tp") + c("fp")), div(c("tp"), c("tp") + c("fn"))
    out = df.withColumns({"total": total, "correct": c("tp") + c("tn"), "accuracy": div(c("tp") + c("tn"), total), "precision": precision, "recall": recall, "f1": div(2 * precision * recall, precision + recall)})
    return out.withColumns({x: F.bround(x, 4) for x in ("accuracy", "precision", "recall", "f1")})


def confusion_metrics(results: DataFrame) -> DataFrame:
    """One row: confusion counts (recapture is positive) and rates, rounded to four digits; an empty denominator gives 0."""
    return _rates(results.agg(*(v.alias(k) for k, v in _counts().items())))


def confusion_breakdown(results: DataFrame, keys: tuple[str, str] = ("source", "product_type")) -> DataFrame:
    """The same by each value of each key, and in total, from one pass over grouping sets."""
    sets = results.groupingSets([[c(keys[0])], [c(keys[1])], []], *map(c, keys))
    out = sets.agg(F.grouping_id().alias("g"), *(v.alias(k) for k, v in _counts().items()))
    key = F.when(c("g") == 1, keys[0]).when(c("g") == 2, keys[1]).otherwise("all")
    value = F.when(c("g") == 1, c(keys[0])).when(c("g") == 2, c(keys[1]))
    return _rates(out.select(key.alias("key"), value.alias("value"), "tp", "tn", "fp", "fn"))


def issue_breakdown(results: DataFrame) -> DataFrame:
    """False positives and negatives of each issue class over wrong results."""
    wrong = results.filter(c("expected") != c("predicted")).select("expected", F.explode("issue_classes").alias("issue"))
    return wrong.groupBy("issue").agg(F.count_if(c("expected") == "accept").alias("fp"), F.count_if(c("expected") == "recapture").alias("fn"))


#: Issue class, which count must be positive, parameter, direction
RULES = (
    ("masking_fallback", "fp", "fallback_frames ratio", "relax"),
    ("low_diversity", "fp", "min_unique_views", "relax"),
    ("scale_flat", "fp", "min_scale_variation", "relax"),
    ("contamination_high", "fn", "contamination threshold", "tighten"),
)


def threshold_recommendations(results: DataFrame, rules=RULES, good: float = 0.90) -> DataFrame:
    """Parameters to relax or tighten by issue counts; general rows only where no rule speaks."""
    table = results.sparkSession.createDataFrame(list(rules), "issue string, side string, parameter string, direction string")
    scores = results.filter((c("expected") == "accept") & (c("predicted") == "recapture")).select("coverage_score", F.explode("issue_classes").alias("issue")).groupBy("issue").agg(F.avg("coverage_score").alias("average_score"))
    found = issue_breakdown(results).join(F.broadcast(table), "issue").withColumn("cases", F.when(c("side") == "fp", c("fp")).otherwise(c("fn"))).filter("cases > 0").join(scores, "issue", "left")
    spoken = found.select("parameter", "direction", "cases", F.when(c("side") == "fp", c("average_score")).alias("average_score"))
    n = spoken.agg(F.count("*").alias("n"))
    m = confusion_metrics(results).join(F.broadcast(n)).filter("n = 0")  # single rows
    none = F.lit(None).cast("double")
    recall = m.filter("fn > 0").select(F.lit("general recall").alias("parameter"), F.lit("tighten").alias("direction"), c("fn").alias("cases"), none.alias("average_score"))
    fine = m.filter((c("fn") == 0) & (c("accuracy") >= good)).select(F.lit("general").alias("parameter"), F.lit("none").alias("direction"), c("total").alias("cases"), none.alias("average_score"))
    return spoken.unionByName(recall).unionByName(fine)


def guidance_metrics(guidance: DataFrame, noisy: int = 5) -> DataFrame:
    """One row of action and severity accuracy, noise, overcaution and misses (expected_action, should_recapture, has_critical, messages); other actions do not count."""
    mild, hard = c("expected_action").isin("accept", "review"), c("expected_action").isin("recapture", "fail")
    match = F.when(mild, ~c("should_recapture")).when(hard, c("should_recapture"))
    severity = F.when(c("expected_action") == "accept", ~c("has_critical")).when(hard, c("has_critical")).otherwise(True)
    rows = guidance.withColumns({"match": match, "severity": severity})
    out = rows.agg(
        F.count("*").alias("total"), F.count_if("match").alias("action_correct"), F.count_if("severity").alias("severity_ok"), F.count_if(c("messages") > noisy).alias("noisy"),
        F.count_if(~c("match") & mild).alias("overcautious"), F.count_if(~c("match") & hard).alias("missed"), F.avg("messages").alias("avg_messages"),
    )
    return out.withColumns({"action_accuracy": F.bround(c("action_correct") / c("total"), 4), "severity_accuracy": F.bround(c("severity_ok") / c("total"), 4), "avg_messages": F.bround("avg_messages", 2)})


def baseline_distribution(evidence: DataFrame) -> DataFrame:
    """One row: statuses and methods with their counts (key=count, sorted), mean confidence, mask ratios where dense images exist, success rate."""
    def tally(col: str) -> Column:
        return F.expr(f"array_join(array_sort(collect_list(concat({col}, '=', n_{col}))), ',')").alias(f"{col}_counts")

    s = evidence.groupBy("status").agg(F.count("*").alias("n_status")).agg(tally("status"))
    m = evidence.groupBy("method").agg(F.count("*").alias("n_method")).agg(tally("method"))
    dense = c("dense") > 0
    ratio = lambda x: F.coalesce(F.avg(F.when(dense, x)), F.lit(0.0))
    one = evidence.agg(
        F.count("*").alias("jobs"), F.avg("confidence").alias("avg_confidence"), ratio(c("exact") / c("dense")).alias("avg_exact"), ratio(c("dim") / c("dense")).alias("avg_dim"), ratio(c("white_ratio")).alias("avg_white"),
        F.avg(c("status").isin("production_ready", "review_ready").cast("int")).alias("success_rate"),
    )
    return one.join(s).join(m)  # three single rows


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Runs, successes and seconds by mode and background flag, with totals by mode and over all (null keys)."""
    ok = true(c("status").isin("ok", "review")) & true(c("provider_status") == "ok") & true(c("has_output"))
    return runs.withColumn("ok", ok).rollup("mode", "bg").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("successes"), F.avg(F.when(c("ok"), c("seconds"))).alias("mean_s"), F.min(F.when(c("ok"), c("seconds"))).alias("min_s"), F.max(F.when(c("ok"), c("seconds"))).alias("max_s")
    )


def ablation_compare(variants: DataFrame, large: int = 2_000_000) -> DataFrame:
    """Point reduction from variant A1 to A3 of each workspace and what it says about the masks."""
    at = lambda v, col: F.max(F.when(c("variant") == v, c(col)))
    out = variants.groupBy("workspace").agg(at("A1", "points").alias("a1"), at("A3", "points").alias("a3"), at("A1", "status").alias("s1"), at("A3", "status").alias("s3"), at("A3", "matches").alias("matches"))
    both = true(c("s1") == "success") & true(c("s3") == "success")
    reduction = F.when(both, (c("a1") - c("a3")) / F.greatest(c("a1"), F.lit(1)))
    verdict = (
        F.when(both & (reduction < 0.05), "minimal_impact").when(both & (c("a3") > large), "still_large").when(both, "significant")
        .when(true(c("s3") == "failed"), F.when(F.coalesce("matches", F.lit(0)) == 0, "mask_path_broken").otherwise("fusion_failed"))
    )
    return out.select("workspace", reduction.alias("reduction"), verdict.alias("verdict"))


def density_compare(rates: DataFrame) -> DataFrame:
    """First against last sampling rate of each session: whether more frames help registration."""
    out = rates.groupBy("session_id").agg(*(f(x, "rate").alias(f"{p}_{x}") for p, f in (("first", F.min_by), ("last", F.max_by)) for x in ("registered", "status")))
    verdict = F.when(c("first_registered") > c("last_registered") + 5, "higher_density_helps").when((c("first_status") == "failed") & (c("last_status") == "failed"), "capture_error").otherwise("not_the_bottleneck")
    return out.select("session_id", verdict.alias("verdict"))


#: Text pattern, message code, severity, in order; the first that a reason holds (pattern or code, any case) wins.
PATTERNS = (
    ("not configured", "SYSTEM_FAILURE_CONFIG", "critical"),
    ("CUDA", "SYSTEM_FAILURE_CONFIG", "critical"),
    ("binary not found", "SYSTEM_FAILURE_CONFIG", "critical"),
    ("configuration or deterministic failure", "SYSTEM_FAILURE_CONFIG", "critical"),
    ("timed out", "SYSTEM_FAILURE_PIPELINE", "critical"),
    ("session timed out", "SYSTEM_FAILURE_PIPELINE", "critical"),
    ("gap_left", "ORBIT_GAP_LEFT", "critical"),
    ("gap_right", "ORBIT_GAP_RIGHT", "critical"),
    ("ORBIT_GAP_LEFT", "ORBIT_GAP_LEFT", "critical"),
    ("ORBIT_GAP_RIGHT", "ORBIT_GAP_RIGHT", "critical"),
    ("LOW_HORIZONTAL", "LOW_HORIZONTAL_COVERAGE", "critical"),
    ("COACHING", "ORBIT_GAP_LEFT", "warning"),
    ("CONTINUITY", "WEAK_ORBIT_CONTINUITY", "warning"),
    ("SPREAD", "INSUFFICIENT_VIEWPOINT_SPREAD", "warning"),
    ("viewpoint diversity", "RECAPTURE_LOW_DIVERSITY", "critical"),
    ("object motion", "RECAPTURE_NARROW_MOTION", "warning"),
    ("scale/shape", "RECAPTURE_SCALE_FLAT", "warning"),
    ("readable", "RECAPTURE_TOO_FEW_FRAMES", "warning"),
    ("heuristic fallback", "RECAPTURE_MASKING_FALLBACK", "warning"),
    ("insufficient size", "LOW_RECONSTRUCTABLE_OVERLAP", "critical"),
    ("model too small", "LOW_RECONSTRUCTABLE_OVERLAP", "critical"),
    ("registered_images", "LOW_RECONSTRUCTABLE_OVERLAP", "critical"),
    ("Validation Failed", "ASSET_VALIDATION_FAILED", "critical"),
    ("CONTAMINATION", "TEXTURE_ATLAS_CONTAMINATION", "warning"),
    ("BLACK_PATCH", "TEXTURE_ATLAS_CONTAMINATION", "warning"),
    ("BACKGROUND_COLOR", "TEXTURE_ATLAS_CONTAMINATION", "warning"),
)


def pattern_message(reason: Column, patterns=PATTERNS) -> Column:
    """struct(code, severity) of the first pattern that a reason holds; null if none."""
    low = F.lower(reason)
    hits = [F.when(low.contains(p.lower()) | low.contains(code.lower()), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for p, code, sev in patterns]
    return F.coalesce(*hits)


def guidance_messages(sessions: DataFrame) -> DataFrame:
    """Message codes with severities (first of each code in order), recapture flag and next action as codes.

    Columns: status, failure_reason, reasons (array), coverage_status (null: no report), top_down,
    ml_unavailable, contamination, uv_integrity, texture_quality_status, texture_reasons, decision
    (null: no validation), ground_aligned, performance_grade, registered, input_frames (null: none).
    """
    msg = lambda cond, code, sev: F.when(true(cond), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
    empty = F.array().cast("array<string>")
    each = lambda col: F.transform(F.coalesce(c(col), empty), lambda r: pattern_message(r))
    s, cov, val = c("status"), c("coverage_status").isNotNull(), c("decision").isNotNull()
    told = pattern_message(F.coalesce("failure_reason", F.lit("")))
    ratio = c("registered") / F.greatest(c("input_frames"), F.lit(1))
    overlap = c("registered").isNotNull() & ((s == "recapture_required") | (ratio < 0.6)) & (ratio < 0.5) & (c("registered") > 0)
    first = F.array(
        msg(s == "created", "AWAITING_UPLOAD", "info"), msg(s == "captured", "PROCESSING_RECONSTRUCTION", "info"), msg(s == "recapture_required", "RECAPTURE_NEEDED", "critical"), F.when(s.isin("recapture_required", "failed"), told),
        msg((s == "failed") & told.isNull(), "SYSTEM_FAILURE_PIPELINE", "critical"), msg(s == "validated", "READY_FOR_REVIEW", "info"),
    )
    coverage = F.when(cov, F.concat(each("reasons"), F.array(msg(~F.coalesce("top_down", F.lit(True)), "MISSING_TOP_VIEWS", "warning"), msg(c("ml_unavailable"), "MASKING_DEGRADED_ML", "warning"))))
    before = F.array(msg(c("contamination") >= 0.5, "CONTAMINATION_HIGH", "critical"), msg(c("uv_integrity") == "fail", "TEXTURE_UV_FAILURE", "warning"), msg(c("texture_quality_status").isin("contaminated", "invalid"), "TEXTURE_ATLAS_CONTAMINATION", "warning"))
    after = F.array(msg(c("decision") == "review", "VALIDATION_REVIEW_ADVICE", "warning"), msg(~c("ground_aligned"), "GROUND_ALIGNMENT_FAILED", "warning"), msg(c("performance_grade") == "D", "MOBILE_GRADE_LOW", "warning"))
    validation = F.when(val, F.concat(before, each("texture_reasons"), after))
    none = F.array().cast("array<struct<code:string,severity:string>>")
    all_ = F.filter(F.concat(first, F.coalesce(coverage, none), F.coalesce(validation, none), F.array(msg(overlap, "LOW_RECONSTRUCTABLE_OVERLAP", "critical"))), lambda m: m.isNotNull())
    kept = F.filter(all_, lambda m, i: F.array_position(F.transform(all_, lambda x: x["code"]), m["code"]) == i + 1)
    recapture = (s == "recapture_required") | (cov & (c("coverage_status") != "sufficient")) | true(overlap)
    action = (
        F.when(recapture, "recapture").when(s == "validated", "review_and_approve").when(s == "created", "upload_video").when(s == "captured", "wait").when(s == "failed", "retry_or_support").otherwise("wait")
    )
    return sessions.select("session_id", F.transform(kept, lambda m: m["code"]).alias("codes"), F.transform(kept, lambda m: m["severity"]).alias("severities"), recapture.alias("should_recapture"), action.alias("next_action"))


def issue_class_inference(sessions: DataFrame) -> DataFrame:
    """Issue classes from coverage reasons and validation numbers (none: ['none']), expected action and label."""
    text = F.lower(F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), " "))
    has, cov, val = lambda *w: cov_(text, w), c("coverage_status").isNotNull(), c("decision").isNotNull()
    found = codes(
        (cov & has("insufficient viewpoint diversity", "unique view"), "low_diversity"), (cov & has("narrow", "object motion"), "narrow_motion"), (cov & has("scale", "shape variation"), "scale_flat"), (cov & has("few readable", "too few"), "too_few_frames"),
        (cov & (F.coalesce("fallback_frames", F.lit(0)) > F.greatest(F.lit(1.0), F.coalesce("readable_frames", F.lit(1)) * 0.4)), "masking_fallback"), (cov & has("low semantic confidence", "low confidence"), "low_confidence"), (cov & c("ml_unavailable"), "ml_unavailable"),
        (val & (c("contamination") > 0.4), "contamination_high"), (val & (c("component_share") < 0.80) & (c("component_count") > 2), "contamination_fragmented"), (val & (c("uv_integrity") == "fail"), "texture_failure"),
    )
    s, d = c("status"), c("decision")
    sufficient = true(c("coverage_status") == "sufficient")
    action = (
        F.when(s == "recapture_required", "recapture").when(s == "failed", "fail").when(s == "published", "accept").when(d == "pass", "accept").when(d.isin("review", "fail"), d)
        .when(cov, F.when(sufficient, "accept").otherwise("recapture")).otherwise("review")
    )
    label = F.when(s == "published", "good").when(s.isin("failed", "recapture_required"), "recapture").when(sufficient, "good").otherwise("recapture")
    return sessions.select("session_id", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none"))).alias("issue_classes"), action.alias("expected_action"), label.alias("label"))


def cov_(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


#: Failure reasons that a label may name.
FAILURES = ("validation_failed", "texture_contaminated", "geometry_broken")


def training_labels(bundle: DataFrame, textured: str = "pbr_textured") -> DataFrame:
    """Asset labels, failure reasons and eligibility; unknown consent is never eligible. `textured` is the semantic status that counts as ready."""
    s = F.coalesce("material_semantic_status", F.lit("geometry_only"))
    passed = c("decision") == "pass"
    labels = codes(
        (s == "geometry_only", "geometry_only"), (s == "diffuse_textured", "draft_asset"), (s == textured, "customer_ready"), (c("texture_integrity_status") == "missing", "texture_missing"), (~F.coalesce("has_uv", F.lit(True)), "uv_missing"),
        (passed & (s != textured), "customer_ready"),
    )
    known = F.when(c("contamination_label").isin(*FAILURES), c("contamination_label")).otherwise("validation_failed")
    reasons = F.when(c("decision").isNotNull() & ~passed, F.array(known)).otherwise(F.array().cast("array<string>"))
    eligible = c("eligible") & (F.coalesce("consent", F.lit("unknown")) != "unknown")
    return bundle.withColumns({"asset_labels": labels, "failure_reasons": reasons, "eligible": eligible})


def scorecard(assets: DataFrame, texture_key: str = "status") -> DataFrame:
    """Grade (the least of the sections present), blockers, production_ready and review_required.

    `texture_key` names the texture column that counts: `status` (as reports carry it, null for
    analysed textures) or `texture_quality_status`. An observed ratio of 0 is unknown.
    """
    r, tex, gate = c("observed_ratio"), c(texture_key), c("gate")
    geometry = grade_rank(c("geometry_grade"))
    observed = F.when(r >= 0.70, 4).when(r >= 0.50, 3).when(r >= 0.30, 2).when(r > 0, 0)
    texture = F.when(tex.isin("pass", "success"), 4).when(tex == "review", 3).when(tex == "fail", 0)
    mesh = F.when(true(c("has_texture")) & true(c("uv_present")), 4).when(F.coalesce("face_count", F.lit(0)) > 1000, 2).otherwise(0)
    gated = F.when(gate == "reshoot", 0).when(gate == "review", 2)
    least = F.least(geometry, observed, texture, mesh, gated)
    sampled = c("sample_count") > 0
    blockers = codes(
        (grade_letter(geometry) == "F", "geometry"), ((r > 0) & (r < 0.30), "observed_surface"), ((c("azimuth_ratio") < 0.5) & sampled, "azimuth_coverage"), ((c("height_score") < 0.34) & sampled, "multi_height"),
        (tex == "fail", "texture"), (mesh == 0, "no_usable_mesh"), (gate == "reshoot", "capture_gate"),
    )
    out = assets.withColumns({"overall_grade": grade_letter(least), "blockers": blockers})
    return out.withColumns({"production_ready": (c("overall_grade") == "A") & (F.size("blockers") == 0), "review_required": c("overall_grade").isin("B", "C") | (F.size("blockers") > 0)})


def texture_status_grade(t: DataFrame, expected_color: str = "unknown") -> DataFrame:
    """Status by checks in order, later ones overwriting (low coverage turns an earlier fail into review), reasons and grade."""
    cream, dark = expected_color == "white_cream", expected_color == "dark"
    black, near, back = (0.20, 0.35, 0.25) if cream else (0.40, 0.60, 0.50)
    checks = (
        ((c("black_ratio") > black) & F.lit(not dark), "black", "fail"), ((c("near_black_ratio") > near) & F.lit(not dark), "near_black", "fail"), (c("flat_ratio") > 0.70, "flat", "fail"), (c("coverage_ratio") < 0.30, "low_coverage", "review"),
        (c("background_ratio") > back, "background", "fail"), (c("neon_ratio") > 0.05, "neon", "fail"), (F.lit(cream) & (c("match_score") < 0.5), "color_match", "fail"),
    )
    status = F.coalesce(*(F.when(cond, F.lit(s)) for cond, _, s in reversed(checks)), F.lit("success"))
    m, n, v = c("match_score"), c("neon_ratio"), c("coverage_ratio")
    rows = t.withColumns({"texture_status": status, "texture_reasons": codes(*((cond, k) for cond, k, _ in checks))})
    grade = F.when(c("texture_status") == "fail", "F").when(c("texture_status") == "review", "C").when((m > 0.9) & (n < 0.01) & (v > 0.6), "A").when((m > 0.8) & (n < 0.03) & (v > 0.4), "B").otherwise("C")
    return rows.withColumn("texture_grade", grade)


class Checks:
    """Table function for SQL users: every row's map of checks as rows, its other columns kept.

    `SELECT * FROM checks(TABLE(validated))`, or with the map's name, `checks(TABLE(validated), 'checks')`. Columns
    of the result are those of the table without the map, then `check` and `status`. A null or empty map gives no rows.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument | None = None) -> AnalyzeResult:
        name = "checks" if column is None else column.value
        if not table.isTable or not isinstance(table.dataType, T.StructType):
            raise ValueError("the first argument is a table: TABLE(name)")
        found = [f for f in table.dataType.fields if f.name == name]
        if not found or not isinstance(found[0].dataType, T.MapType):
            raise ValueError(f"the table has no map {name!r}")
        kept = [f for f in table.dataType.fields if f.name != name]
        clash = {f.name.lower() for f in kept} & {"check", "status"}
        if clash:
            raise ValueError(f"the table has columns named like the result: {sorted(clash)}")
        return AnalyzeResult(schema=T.StructType([*kept, T.StructField("check", T.StringType()), T.StructField("status", found[0].dataType.valueType)]))

    def eval(self, row: Row, column: str = "checks") -> Iterator[tuple]:
        rest = [v for k, v in row.asDict(False).items() if k != column]
        for check, status in (row[column] or {}).items():
            yield (*rest, check, status)


def register_checks(spark: SparkSession, name: str = "checks") -> None:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, F.udtf(Checks))


def checks_rows(assets: DataFrame, key: str = "asset_id", checks: str = "checks") -> DataFrame:
    """One row for each check of an asset's check map."""
    return assets.select(key, F.explode(checks).alias("check", "status"))
