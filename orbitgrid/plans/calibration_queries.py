"""Queries of calibration, guidance, labels and scorecards."""

from pyspark.sql import functions as F

from orbitgrid.operators import calibration as op
from orbitgrid.plans.registry import query
from orbitgrid.plans.rule_queries import ALL, TEX, joined, listed

c = F.col
CM = "count(*) FILTER (expected = 'recapture' AND predicted = 'recapture') AS tp, count(*) FILTER (expected = 'accept' AND predicted = 'accept') AS tn, count(*) FILTER (expected = 'accept' AND predicted = 'recapture') AS fp, count(*) FILTER (expected = 'recapture' AND predicted = 'accept') AS fn"
RATES = """tp, tn, fp, fn, tp + tn + fp + fn AS total, tp + tn AS correct, round_even((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round_even(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round_even(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
round_even(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 4) AS f1"""


def results(t):
    return t.fixtures.withColumn("issue_classes", F.array("issue"))


@query("expected_vs_predicted", """WITH f AS (SELECT fixture_id, CASE WHEN expected = 'accept' THEN 'Good' ELSE 'bad' END AS label, CASE fixture_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'fail' END AS action, CASE WHEN predicted = 'accept' THEN 'sufficient' END AS cs, CASE fixture_id % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'review' END AS d FROM fixtures),
e AS (SELECT fixture_id, CASE WHEN action = 'accept' OR label = 'Good' THEN 'accept' ELSE 'recapture' END AS expected, CASE WHEN cs = 'sufficient' AND coalesce(d, '') <> 'fail' THEN 'accept' ELSE 'recapture' END AS predicted FROM f) SELECT *, expected = predicted AS correct FROM e""")
def _(t):
    i = c("fixture_id")
    rows = t.fixtures.select("fixture_id", F.when(c("expected") == "accept", "Good").otherwise("bad").alias("label"), F.when(i % 4 == 0, "accept").when(i % 4 == 1, "fail").alias("expected_action"), F.when(c("predicted") == "accept", "sufficient").alias("coverage_status"), F.when(i % 3 == 0, "fail").when(i % 3 == 1, "review").alias("decision"))
    return op.expected_vs_predicted(rows).select("fixture_id", "expected", "predicted", "correct")


@query("confusion_metrics", f"WITH n AS (SELECT {CM} FROM fixtures) SELECT {RATES} FROM n")
def _(t):
    return op.confusion_metrics(results(t))


@query("confusion_breakdown", f"""WITH n AS (SELECT 'source' AS key, source AS value, {CM} FROM fixtures GROUP BY source UNION ALL SELECT 'product_type', product_type, {CM} FROM fixtures GROUP BY product_type UNION ALL SELECT 'all', NULL, {CM} FROM fixtures) SELECT key, value, {RATES} FROM n""")
def _(t):
    return op.confusion_breakdown(results(t))


@query("issue_breakdown", "SELECT issue, count(*) FILTER (expected = 'accept') AS fp, count(*) FILTER (expected = 'recapture') AS fn FROM fixtures WHERE expected <> predicted GROUP BY issue")
def _(t):
    return op.issue_breakdown(results(t))


@query("threshold_recommendations", """WITH b AS (SELECT issue, count(*) FILTER (expected = 'accept') AS fp, count(*) FILTER (expected = 'recapture') AS fn, avg(coverage_score) FILTER (expected = 'accept') AS s FROM fixtures WHERE expected <> predicted GROUP BY issue)
SELECT p AS parameter, d AS direction, CASE WHEN side = 'fp' THEN fp ELSE fn END AS cases, R[CASE WHEN side = 'fp' THEN s END] AS average_score FROM b JOIN (VALUES ('masking_fallback', 'fp', 'fallback_frames ratio', 'relax'), ('low_diversity', 'fp', 'min_unique_views', 'relax'), ('scale_flat', 'fp', 'min_scale_variation', 'relax'), ('contamination_high', 'fn', 'contamination threshold', 'tighten')) v(issue, side, p, d) USING (issue)
WHERE CASE WHEN side = 'fp' THEN fp ELSE fn END > 0""")
def _(t):
    return op.threshold_recommendations(results(t))


GUID = "SELECT fixture_id, CASE fixture_id % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'review' WHEN 2 THEN 'recapture' WHEN 3 THEN 'fail' ELSE 'odd' END AS expected_action, predicted = 'recapture' AS should_recapture, issue = 'low_diversity' AS has_critical, fixture_id % 9 AS messages FROM fixtures"


@query("guidance_metrics", f"""WITH g AS ({GUID}), m AS (SELECT *, expected_action IN ('accept', 'review') AS mild, expected_action IN ('recapture', 'fail') AS hard FROM g), x AS (SELECT *, CASE WHEN mild THEN NOT should_recapture WHEN hard THEN should_recapture END AS ok, CASE WHEN expected_action = 'accept' THEN NOT has_critical WHEN hard THEN has_critical ELSE true END AS sv FROM m),
a AS (SELECT count(*) AS total, count(*) FILTER (ok) AS action_correct, count(*) FILTER (sv) AS severity_ok, count(*) FILTER (messages > 5) AS noisy, count(*) FILTER (NOT ok AND mild) AS overcautious, count(*) FILTER (NOT ok AND hard) AS missed, round_even(avg(messages), 2) AS avg_messages FROM x)
SELECT *, round_even(action_correct / total, 4) AS action_accuracy, round_even(severity_ok / total, 4) AS severity_accuracy FROM a""")
def _(t):
    return op.guidance_metrics(t.spark.sql(GUID.replace("FROM fixtures", "FROM {f}"), f=t.fixtures))


DIST = "SELECT CASE asset_id % 4 WHEN 0 THEN 'production_ready' WHEN 1 THEN 'review_ready' WHEN 2 THEN 'failed' ELSE 'unknown' END AS status, CASE asset_id % 3 WHEN 0 THEN 'mask_guided' ELSE 'geometric_only' END AS method, (asset_id % 100) / 100e0 AS confidence, asset_id % 5 AS dense, asset_id % 4 AS exact, asset_id % 3 AS dim, (asset_id % 7) / 7e0 AS white_ratio FROM assets"


@query("baseline_distribution", f"""WITH e AS ({DIST}), s AS (SELECT string_agg(x, ',' ORDER BY x) AS status_counts FROM (SELECT status || '=' || count(*) AS x FROM e GROUP BY status)), m AS (SELECT string_agg(x, ',' ORDER BY x) AS method_counts FROM (SELECT method || '=' || count(*) AS x FROM e GROUP BY method))
SELECT count(*) AS jobs, R[avg(confidence)] AS avg_confidence, R[avg(exact / dense) FILTER (dense > 0)] AS avg_exact, R[avg(dim / dense) FILTER (dense > 0)] AS avg_dim, R[avg(white_ratio) FILTER (dense > 0)] AS avg_white, R[avg((status IN ('production_ready', 'review_ready'))::int)] AS success_rate, any_value(status_counts) AS status_counts, any_value(method_counts) AS method_counts FROM e, s, m""")
def _(t):
    return op.baseline_distribution(t.spark.sql(DIST.replace("FROM assets", "FROM {a}"), a=t.assets))


RUNS = "SELECT CASE asset_id % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'high' ELSE 'ultra' END AS mode, asset_id % 2 = 0 AS bg, provider_status, CASE WHEN asset_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, has_output, (asset_id % 300) / 10e0 AS seconds FROM graded_assets"


@query("benchmark_summary", f"""WITH r AS ({RUNS}), k AS (SELECT *, status = 'ok' AND provider_status = 'ok' AND has_output AS ok FROM r) SELECT mode, bg, count(*) AS n, count(*) FILTER (ok) AS successes, R[avg(seconds) FILTER (ok)] AS mean_s, R[min(seconds) FILTER (ok)] AS min_s, R[max(seconds) FILTER (ok)] AS max_s FROM k GROUP BY ROLLUP (mode, bg)""")
def _(t):
    return op.benchmark_summary(t.spark.sql(RUNS.replace("FROM graded_assets", "FROM {a}"), a=t.graded_assets))


VAR = "SELECT product_id AS workspace, CASE m WHEN 0 THEN 'A1' WHEN 1 THEN 'A3' ELSE 'A2' END AS variant, poly_count * 10 AS points, CASE WHEN asset_id % 9 = 0 THEN 'failed' ELSE 'success' END AS status, asset_id % 2 AS matches FROM assets"


@query("ablation_compare", f"""WITH v AS ({VAR}), g AS (SELECT workspace, max(points) FILTER (variant = 'A1') AS a1, max(points) FILTER (variant = 'A3') AS a3, max(status) FILTER (variant = 'A1') AS s1, max(status) FILTER (variant = 'A3') AS s3, max(matches) FILTER (variant = 'A3') AS mt FROM v GROUP BY 1), r AS (SELECT *, coalesce(s1 = 'success' AND s3 = 'success', false) AS bothok FROM g),
d AS (SELECT *, CASE WHEN bothok THEN (a1 - a3) / greatest(a1, 1) END AS red FROM r) SELECT workspace, R[red] AS reduction, CASE WHEN bothok AND red < 0.05 THEN 'minimal_impact' WHEN bothok AND a3 > 2000000 THEN 'still_large' WHEN bothok THEN 'significant' WHEN s3 = 'failed' THEN CASE WHEN mt = 0 THEN 'mask_path_broken' ELSE 'fusion_failed' END END AS verdict FROM d""")
def _(t):
    return op.ablation_compare(t.spark.sql(VAR.replace("FROM assets", "FROM {a}"), a=t.assets))


@query("density_compare", """WITH g AS (SELECT session_id, arg_min(registered, idx) AS f, arg_max(registered, idx) AS l, arg_min(flag, idx) AS fs, arg_max(flag, idx) AS ls FROM attempts GROUP BY 1) SELECT session_id, CASE WHEN f > l + 5 THEN 'higher_density_helps' WHEN fs = 'A' AND ls = 'A' THEN 'capture_error' ELSE 'not_the_bottleneck' END AS verdict FROM g""")
def _(t):
    return op.density_compare(t.attempts.select("session_id", c("idx").alias("rate"), "registered", F.when(c("flag") == "A", "failed").otherwise("ok").alias("status")))


TEXTS = ("Insufficient viewpoint diversity (3/5)", "Object motion and scale variation too narrow", "CUDA error", "ORBIT_GAP_LEFT_COACHING", "nothing", "Too few readable frames", "texture BLACK_PATCH", "low semantic confidence")
SESS = f"""SELECT asset_id AS session_id, CASE asset_id % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'captured' WHEN 2 THEN 'recapture_required' WHEN 3 THEN 'failed' WHEN 4 THEN 'validated' ELSE 'published' END AS status, CASE WHEN asset_id % 2 = 0 THEN array{list(TEXTS)!s}[asset_id % 8] END AS failure_reason,
array(array{list(TEXTS)!s}[asset_id % 8], array{list(TEXTS)!s}[asset_id * 3 % 8]) AS reasons, CASE asset_id % 3 WHEN 0 THEN 'sufficient' WHEN 1 THEN 'insufficient' END AS coverage_status, asset_id % 4 > 0 AS top_down, asset_id % 5 = 0 AS ml_unavailable, (asset_id % 10) / 10e0 AS contamination, CASE WHEN asset_id % 7 = 0 THEN 'fail' ELSE 'pass' END AS uv_integrity,
CASE WHEN asset_id % 8 = 0 THEN 'contaminated' END AS texture_quality_status, CASE WHEN asset_id % 9 = 0 THEN array('x', 'BACKGROUND_COLOR leak') END AS texture_reasons, CASE asset_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'review' WHEN 2 THEN 'fail' END AS decision, asset_id % 6 > 0 AS ground_aligned, CASE WHEN asset_id % 11 = 0 THEN 'D' ELSE 'A' END AS performance_grade,
CASE WHEN asset_id % 3 = 0 THEN asset_id % 20 END AS registered, 20 AS input_frames, asset_id % 9 AS fallback_frames, asset_id % 12 AS readable_frames, (asset_id % 20) / 20e0 AS component_share, asset_id % 5 AS component_count FROM assets"""


def sessions(t):
    return t.spark.sql(SESS.replace("array[", "array(").replace("'][", "')[").replace("FROM assets", "FROM {a}"), a=t.assets)


DUCK = SESS.replace("array[", "[").replace("[asset_id % 8]", "[asset_id % 8 + 1]").replace("[asset_id * 3 % 8]", "[asset_id * 3 % 8 + 1]").replace("array(", "list_value(")


def told(reason):
    """The first pattern that a reason holds, as SQL."""
    whens = " ".join(f"WHEN contains(lower({reason}), '{p.lower()}') OR contains(lower({reason}), '{code.lower()}') THEN {{'code': '{code}', 'severity': '{sev}'}}" for p, code, sev in op.PATTERNS)
    return f"CASE {whens} END"


def one(condition, code, severity):
    return f"CASE WHEN {condition} THEN {{'code': '{code}', 'severity': '{severity}'}} END"


GUIDED = ", ".join([
    one("status = 'created'", "AWAITING_UPLOAD", "info"), one("status = 'captured'", "PROCESSING_RECONSTRUCTION", "info"), one("status = 'recapture_required'", "RECAPTURE_NEEDED", "critical"),
    f"CASE WHEN status IN ('recapture_required', 'failed') THEN {told('failure_reason')} END", one(f"status = 'failed' AND ({told('failure_reason')}) IS NULL", "SYSTEM_FAILURE_PIPELINE", "critical"), one("status = 'validated'", "READY_FOR_REVIEW", "info"),
])
COVERED = f"CASE WHEN coverage_status IS NULL THEN [] ELSE list_concat(list_transform(reasons, lambda r: {told('r')}), [{one('NOT top_down', 'MISSING_TOP_VIEWS', 'warning')}, {one('ml_unavailable', 'MASKING_DEGRADED_ML', 'warning')}]) END"
VALIDATED = f"""CASE WHEN decision IS NULL THEN [] ELSE list_concat([{one("contamination >= 0.5", "CONTAMINATION_HIGH", "critical")}, {one("uv_integrity = 'fail'", "TEXTURE_UV_FAILURE", "warning")}, {one("texture_quality_status IN ('contaminated', 'invalid')", "TEXTURE_ATLAS_CONTAMINATION", "warning")}],
  list_transform(coalesce(texture_reasons, []), lambda r: {told('r')}), [{one("decision = 'review'", "VALIDATION_REVIEW_ADVICE", "warning")}, {one("NOT ground_aligned", "GROUND_ALIGNMENT_FAILED", "warning")}, {one("performance_grade = 'D'", "MOBILE_GRADE_LOW", "warning")}]) END"""
OVERLAP = "coalesce(registered IS NOT NULL AND (status = 'recapture_required' OR registered / input_frames < 0.6) AND registered / input_frames < 0.5 AND registered > 0, false)"


@query("guidance_messages", f"""WITH s AS ({DUCK}), m AS (SELECT *, {OVERLAP} AS overlap FROM s),
g AS (SELECT *, list_filter(list_concat([{GUIDED}], {COVERED}, {VALIDATED}, [{one("overlap", "LOW_RECONSTRUCTABLE_OVERLAP", "critical")}]), lambda x: x IS NOT NULL) AS every FROM m),
d AS (SELECT *, list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: y.code), x.code) = i) AS kept, status = 'recapture_required' OR coalesce(coverage_status <> 'sufficient', false) OR overlap AS again FROM g)
SELECT session_id, array_to_string(list_transform(kept, lambda x: x.code), ',') AS codes, array_to_string(list_transform(kept, lambda x: x.severity), ',') AS severities, again AS should_recapture,
CASE WHEN again THEN 'recapture' WHEN status = 'validated' THEN 'review_and_approve' WHEN status = 'created' THEN 'upload_video' WHEN status = 'captured' THEN 'wait' WHEN status = 'failed' THEN 'retry_or_support' ELSE 'wait' END AS next_action FROM d""")
def _(t):
    return joined(op.guidance_messages(sessions(t)), "codes", "severities")


@query("issue_class_inference", f"""WITH s AS ({DUCK}), x AS (SELECT *, lower(array_to_string(reasons, ' ')) AS r, coverage_status IS NOT NULL AS cv, decision IS NOT NULL AS vl FROM s),
i AS (SELECT *, {listed(("cv AND (contains(r, 'insufficient viewpoint diversity') OR contains(r, 'unique view'))", 'low_diversity'), ("cv AND (contains(r, 'narrow') OR contains(r, 'object motion'))", 'narrow_motion'), ("cv AND (contains(r, 'scale') OR contains(r, 'shape variation'))", 'scale_flat'), ("cv AND (contains(r, 'few readable') OR contains(r, 'too few'))", 'too_few_frames'),
('cv AND fallback_frames > greatest(1, readable_frames * 0.4)', 'masking_fallback'), ("cv AND (contains(r, 'low semantic confidence') OR contains(r, 'low confidence'))", 'low_confidence'), ('cv AND ml_unavailable', 'ml_unavailable'), ('vl AND contamination > 0.4', 'contamination_high'), ('vl AND component_share < 0.80 AND component_count > 2', 'contamination_fragmented'), ("vl AND uv_integrity = 'fail'", 'texture_failure'))} AS ic FROM x)
SELECT session_id, coalesce(nullif(ic, ''), 'none') AS issue_classes, CASE WHEN status = 'recapture_required' THEN 'recapture' WHEN status = 'failed' THEN 'fail' WHEN status = 'published' THEN 'accept' WHEN decision = 'pass' THEN 'accept' WHEN decision IN ('review', 'fail') THEN decision WHEN cv THEN CASE WHEN coverage_status = 'sufficient' THEN 'accept' ELSE 'recapture' END ELSE 'review' END AS expected_action,
CASE WHEN status = 'published' THEN 'good' WHEN status IN ('failed', 'recapture_required') THEN 'recapture' WHEN coverage_status = 'sufficient' THEN 'good' ELSE 'recapture' END AS label FROM i""")
def _(t):
    return joined(op.issue_class_inference(sessions(t)), "issue_classes")


LAB = "SELECT asset_id, CASE asset_id % 5 WHEN 0 THEN 'geometry_only' WHEN 1 THEN 'diffuse_textured' WHEN 2 THEN 'pbr_textured' WHEN 3 THEN 'pbr_complete' END AS material_semantic_status, texture_integrity_status, has_uv, CASE asset_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'review' WHEN 2 THEN 'fail' END AS decision, CASE asset_id % 3 WHEN 0 THEN 'geometry_broken' WHEN 1 THEN 'odd' END AS contamination_label, asset_id % 2 = 0 AS eligible, CASE asset_id % 3 WHEN 0 THEN 'granted' WHEN 1 THEN 'unknown' END AS consent FROM graded_assets"


@query("training_labels", f"""WITH l AS ({LAB}), s AS (SELECT *, coalesce(material_semantic_status, 'geometry_only') AS sm FROM l) SELECT asset_id, {listed(("sm = 'geometry_only'", 'geometry_only'), ("sm = 'diffuse_textured'", 'draft_asset'), ("sm = 'pbr_textured'", 'customer_ready'), ("texture_integrity_status = 'missing'", 'texture_missing'), ('NOT has_uv', 'uv_missing'), ("decision = 'pass' AND sm <> 'pbr_textured'", 'customer_ready'))} AS asset_labels,
CASE WHEN decision IN ('review', 'fail') THEN CASE WHEN contamination_label = 'geometry_broken' THEN 'geometry_broken' ELSE 'validation_failed' END ELSE '' END AS failure_reasons, eligible AND coalesce(consent, 'unknown') <> 'unknown' AS eligible FROM s""")
def _(t):
    rows = t.spark.sql(LAB.replace("FROM graded_assets", "FROM {a}"), a=t.graded_assets)
    return joined(op.training_labels(rows), "asset_labels", "failure_reasons").select("asset_id", "asset_labels", "failure_reasons", "eligible")


CARD = "SELECT asset_id, observed_ratio, CASE asset_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'F' END AS geometry_grade, CASE asset_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'review' WHEN 2 THEN 'fail' END AS status, asset_id % 2 = 0 AS has_texture, asset_id % 3 > 0 AS uv_present, face_count, CASE asset_id % 7 WHEN 0 THEN 'reshoot' WHEN 1 THEN 'review' WHEN 2 THEN 'pass' END AS gate, asset_id % 6 AS sample_count, (asset_id % 9) / 8e0 AS azimuth_ratio, (asset_id % 4) / 3e0 AS height_score FROM graded_assets"


@query("scorecard", f"""WITH d AS ({CARD}), g AS (SELECT *, CASE geometry_grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 0 END AS g1, CASE WHEN observed_ratio >= 0.7 THEN 4 WHEN observed_ratio >= 0.5 THEN 3 WHEN observed_ratio >= 0.3 THEN 2 WHEN observed_ratio > 0 THEN 0 END AS g2, CASE status WHEN 'pass' THEN 4 WHEN 'review' THEN 3 WHEN 'fail' THEN 0 END AS g3,
CASE WHEN has_texture AND uv_present THEN 4 WHEN face_count > 1000 THEN 2 ELSE 0 END AS g4, CASE gate WHEN 'reshoot' THEN 0 WHEN 'review' THEN 2 END AS g5 FROM d), l AS (SELECT *, CASE least(g1, g2, g3, g4, g5) WHEN 4 THEN 'A' WHEN 3 THEN 'B' WHEN 2 THEN 'C' ELSE 'F' END AS overall_grade,
{listed(("geometry_grade = 'F'", 'geometry'), ('observed_ratio > 0 AND observed_ratio < 0.3', 'observed_surface'), ('azimuth_ratio < 0.5 AND sample_count > 0', 'azimuth_coverage'), ('height_score < 0.34 AND sample_count > 0', 'multi_height'), ("status = 'fail'", 'texture'), ('g4 = 0', 'no_usable_mesh'), ("gate = 'reshoot'", 'capture_gate'))} AS blockers FROM g)
SELECT asset_id, overall_grade, blockers, overall_grade = 'A' AND blockers = '' AS production_ready, overall_grade IN ('B', 'C') OR blockers <> '' AS review_required FROM l""")
def _(t):
    rows = t.spark.sql(CARD.replace("FROM graded_assets", "FROM {a}"), a=t.graded_assets)
    return joined(op.scorecard(rows), "blockers").select("asset_id", "overall_grade", "blockers", "production_ready", "review_required")


TQ = "SELECT asset_id, (asset_id * 7 % 60) / 100e0 AS black_ratio, (asset_id * 11 % 80) / 100e0 AS near_black_ratio, (asset_id * 13 % 90) / 100e0 AS flat_ratio, (asset_id * 17 % 100) / 100e0 AS coverage_ratio, (asset_id * 19 % 70) / 100e0 AS background_ratio, (asset_id * 23 % 90) / 1000e0 AS neon_ratio, (asset_id * 29 % 101) / 100e0 AS match_score FROM assets"


@query("texture_status_grade", f"""WITH q AS ({TQ}), s AS (SELECT *, CASE WHEN match_score < 0.5 OR neon_ratio > 0.05 OR background_ratio > 0.25 THEN 'fail' WHEN coverage_ratio < 0.30 THEN 'review' WHEN flat_ratio > 0.70 OR near_black_ratio > 0.35 OR black_ratio > 0.20 THEN 'fail' ELSE 'success' END AS st,
{listed(('black_ratio > 0.20', 'black'), ('near_black_ratio > 0.35', 'near_black'), ('flat_ratio > 0.70', 'flat'), ('coverage_ratio < 0.30', 'low_coverage'), ('background_ratio > 0.25', 'background'), ('neon_ratio > 0.05', 'neon'), ('match_score < 0.5', 'color_match'))} AS r FROM q)
SELECT asset_id, st AS texture_status, r AS texture_reasons, CASE WHEN st = 'fail' THEN 'F' WHEN st = 'review' THEN 'C' WHEN match_score > 0.9 AND neon_ratio < 0.01 AND coverage_ratio > 0.6 THEN 'A' WHEN match_score > 0.8 AND neon_ratio < 0.03 AND coverage_ratio > 0.4 THEN 'B' ELSE 'C' END AS texture_grade FROM s""")
def _(t):
    rows = t.spark.sql(TQ.replace("FROM assets", "FROM {a}"), a=t.assets)
    return joined(op.texture_status_grade(rows, "white_cream"), "texture_reasons").select("asset_id", "texture_status", "texture_reasons", "texture_grade")


@query("checks_udtf", f"WITH {TEX}, k AS (SELECT asset_id, unnest([" + ", ".join(f"'{k}'" for k in ALL) + "]) AS \"check\", unnest([" + ", ".join(ALL.values()) + "]) AS status FROM tx) SELECT * FROM k WHERE status IS NOT NULL")
def _(t):
    from orbitgrid.operators.asset_rules import asset_validation

    op.register_checks(t.spark)
    return t.spark.sql("SELECT * FROM checks(TABLE(SELECT asset_id, checks FROM {validated}))", validated=asset_validation(t.graded_assets))
