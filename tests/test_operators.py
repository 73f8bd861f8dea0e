"""Edges of rules, folds, streams and files on small hand-made tables."""

import json
import math
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from orbitgrid.functions import geometry, scorers, text
from orbitgrid.operators import asset_rules, calibration, folds, frames, mesh, registry, session_rules
from orbitgrid.operators.retention import retention_plan
from orbitgrid.sources import checkpoints, files
from orbitgrid.streaming import streams


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def frame_table(spark, values, name="sharpness", session=1):
    return spark.createDataFrame([(session, i, float(v)) for i, v in enumerate(values)], f"session_id long, frame_idx long, {name} double")


def test_blur_burst_edges(spark):
    sharp = [10, 11, 10, 9, 1, 1, 1, 10, 11, 1, 1, 9]
    got = frames.blur_bursts(frame_table(spark, sharp)).collect()
    assert [(r.start_index, r.end_index, r.n) for r in got] == [(4, 6, 3)]  # the run of two is too short
    assert got[0].burst_ratio == pytest.approx(3 / 12)
    assert frames.blur_bursts(frame_table(spark, [5] * 10)).count() == 0  # no spread: no burst
    assert frames.blur_bursts(frame_table(spark, [])).count() == 0


@pytest.mark.parametrize("n, want", [(3, [0, 1, 2]), (10, list(range(10))), (25, [0, 2, 5, 7, 10, 12, 15, 17, 20, 22])])
def test_even_sample(spark, n, want):
    got = frames.even_sample(frame_table(spark, range(n)), "session_id", "frame_idx", 10)
    assert [r.frame_idx for r in got.orderBy("frame_idx").collect()] == want


def test_repartitioning_changes_nothing(spark):
    table = frame_table(spark, [(i * 37) % 17 for i in range(200)])
    assert rows(frames.blur_stats(table.repartition(1))) == rows(frames.blur_stats(table.repartition(64)))


def test_balanced_selection_equals_greedy(spark):
    items = [(1, i, float((i * 31) % 97), ((i * 53) % 100) / 100, ("low", "mid", "top", "unknown")[(i * 7) % 4]) for i in range(150)]
    table = spark.createDataFrame(items, "session_id long, frame_idx long, sharpness double, confidence double, bucket string")
    kept, cap, total = [], int(30 * 0.55), 30
    by = {b: sorted((x for x in items if x[4] == b), key=lambda x: (-x[2] * max(x[3], 0.1), x[1])) for b in ("low", "mid", "top", "unknown")}
    for b, least in (("low", 6), ("mid", 10), ("top", 6)):
        kept += by[b][:least]
        by[b] = by[b][least:]
    n = {b: sum(x[4] == b for x in kept) for b in by}
    for x in sorted((x for b in by for x in by[b]), key=lambda x: -x[2] * max(x[3], 0.1)):
        if len(kept) < total and (x[4] == "unknown" or n[x[4]] < cap):
            kept.append(x)
            n[x[4]] += 1
    assert rows(frames.balanced_selection(table, total=total), "frame_idx") == sorted((x[1],) for x in kept)


@pytest.mark.parametrize("profile, count, want", [("mobile_preview", 45_000, "pass"), ("mobile_preview", 45_001, "review"), ("mobile_preview", 50_001, "fail"), ("raw_archive", 10**9, "pass"), ("odd", 50_000, "pass"), ("odd", 150_001, "fail")])
def test_polycount_edges(spark, profile, count, want):
    table = spark.createDataFrame([(count, profile)], "poly_count long, delivery_profile string")
    assert asset_rules.polycount_gate(table).first().polycount == want


def test_bbox_first_dimension_wins_and_missing_fails(spark):
    table = spark.createDataFrame([(501.0, 0.0, 1.0, 1.0), (None, 1.0, 1.0, 1.01), (500.0, 1.0, 1.0, -1.0)], "width double, height double, depth double, ground_offset double")
    assert rows(asset_rules.bbox_ground_gate(table), "bbox_check", "ground_check") == [("fail", "review"), ("pass", "pass"), ("review", "pass")]


def test_contamination_without_statistics_has_no_checks(spark):
    table = spark.createDataFrame([(None,)], "component_share double").selectExpr("component_share", "1.0 face_ratio", "1 component_count", "0.0 plane_share", "0.0 plane_vertex_ratio", "1.0 compactness", "1.0 selected_score", "'pass' isolation_status")
    assert asset_rules.contamination_rules(table).first().contamination == {}


def test_candidate_score_gaps(spark):
    table = spark.createDataFrame([(r,) for r in (0.04, 0.87, 0.5, 0.02, 0.95)], "foreground_ratio double").selectExpr(
        "foreground_ratio", "'ok' provider_status", "true has_output", "0.0 size_kb", "false background_removed", "'' mask_source", "'' bbox_source", "'' crop_method", "true has_bbox", "10 crop_w", "10 crop_h", "100 image_area", "false has_errors", "false has_prepared", "'' warning")
    got = {r.foreground_ratio: r.score for r in asset_rules.candidate_score(table).collect()}
    assert got[0.04] == got[0.87] == 73.0 and got[0.5] == 79.0 and got[0.02] == 65.0 and got[0.95] == 67.0


def test_preflight_treats_zero_as_unknown(spark):
    table = spark.createDataFrame([(9, 0, 0.0, 0.0, 0.0, 0.0), (9, 0, 0.0, 0.1, 0.0, 0.0), (2, 0, 0.0, 0.5, 50.0, 0.0)], "selected int, missing int, mismatch_ratio double, coverage_ratio double, median_blur double, static_ratio double")
    assert [r.decision for r in session_rules.reconstruction_preflight(table).collect()] == ["pass", "reject", "reject"]


@pytest.mark.parametrize("key, want", [("large__mounted", ("large", "mounted")), (" Small_Freestanding ", ("small", "freestanding")), ("", ("small", "on_surface")), (None, ("small", "on_surface")), ("large_moon", ("small", "on_surface"))])
def test_profile_key(spark, key, want):
    row = session_rules.capture_profile_lookup(spark.createDataFrame([(key,)], "profile_key string")).first()
    assert (row["size"], row.scene) == want


def test_first_pattern_wins_and_codes_are_distinct(spark):
    table = spark.createDataFrame([(1, "failed", "CUDA error, timed out", ["ORBIT_GAP_LEFT_COACHING", "gap_left", "scale/shape"], "insufficient")], "session_id long, status string, failure_reason string, reasons array<string>, coverage_status string").selectExpr(
        "*", "true top_down", "false ml_unavailable", "0.0 contamination", "'pass' uv_integrity", "'ok' texture_quality_status", "array() texture_reasons", "cast(null as string) decision", "true ground_aligned", "'A' performance_grade", "cast(null as int) registered", "10 input_frames")
    row = calibration.guidance_messages(table.withColumn("texture_reasons", F.array().cast("array<string>"))).first()
    assert row.codes == ["SYSTEM_FAILURE_CONFIG", "ORBIT_GAP_LEFT", "RECAPTURE_SCALE_FLAT"] and row.should_recapture and row.next_action == "recapture"


def test_confusion_of_nothing_is_zero(spark):
    row = calibration.confusion_metrics(spark.createDataFrame([], "expected string, predicted string")).first()
    assert (row.total, row.accuracy, row.f1) == (0, 0.0, 0.0)


def test_scorecard_texture_key(spark):
    table = spark.createDataFrame([("A", 0.9, None, "fail")], "geometry_grade string, observed_ratio double, status string, texture_quality_status string").selectExpr("*", "true has_texture", "true uv_present", "5000 face_count", "'pass' gate", "5 sample_count", "1.0 azimuth_ratio", "1.0 height_score")
    assert calibration.scorecard(table).first().production_ready
    assert calibration.scorecard(table, "texture_quality_status").first().overall_grade == "F"


def test_rollback_cases(spark):
    assets = spark.createDataFrame([(p, a, a) for p in (1, 2, 3, 4) for a in (p * 10, p * 10 + 1, p * 10 + 2)] + [(5, 50, 50)], "product_id long, asset_id long, created_at long")
    active = spark.createDataFrame([(1, 12), (2, 20), (3, 99)], "product_id long, active_id long")
    assert rows(registry.rollback_target(assets, active).na.fill(-1)) == [(1, 11), (2, -1), (3, 31), (4, 42), (5, -1)]


def test_connected_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    sizes = mesh.component_sizes(mesh.connected_components(edges))
    assert rows(sizes) == [(0, 201), (1000, 2)]
    with pytest.raises(RuntimeError):
        mesh.connected_components(edges, max_rounds=1)


def test_nearest_point_is_strict(spark):
    e = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.0), (1, 2, 0, 0.5, 0.0, 0.0)], "job long, element long, component long, x double, y double, z double")
    p = spark.createDataFrame([(1, 0.25, 0.0, 0.0)], "job long, x double, y double, z double")
    assert mesh.nearest_point_support(e, p, 0.25).first().supported == 0
    assert mesh.nearest_point_support(e, p, 0.26).first().supported == 2


def test_quaternion_identity_and_zero_norm(spark):
    table = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0],), ([0.0, 0.0, 0.0, 0.0],)], "q array<double>").withColumn("t", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    got = table.select(geometry.quat_camera_center(F.col("q"), F.col("t")).alias("c")).select("c.*")
    assert set(rows(got)) == {(-1.0, -2.0, -3.0)}


def test_redaction_of_nested_values(spark):
    table = spark.sql("SELECT named_struct('a', array('Bearer abc', 'x'), 'm', map('k', 'api_key=zz&b'), 'n', 5) AS v")
    got = table.select(text.redact_nested(F.col("v"), table.schema["v"].dataType).alias("v")).first().v
    assert got.a == ["Bearer [REDACTED]", "x"] and got.m == {"k": "api_key=[REDACTED]&b"} and got.n == 5


def test_scorers_are_swapped_by_name(spark):
    scorers.register("mine", lambda x: x * 2)
    scorers.register("mine", lambda x: x * 3)
    assert scorers.scored(spark.createDataFrame([(2,)], "v int"), "mine", F.col("v")).first().score == 6
    with pytest.raises(KeyError):
        scorers.scored(spark.range(1), "unknown")


def fold_rows(n=120):
    return [(s, i, [float((i * s) % 5), 1.0, 2.0, float(i % 3)], i % 9, i % 7, 40, 40, float(i % 50), 50.0 + i % 40) for s in (1, 2) for i in range(n)]


SCHEMA = "session_id long, frame_idx long, hist array<double>, bx long, box_y long, bw long, bh long, flow double, sharp double"


@pytest.mark.parametrize("step", [folds.redundancy_step(most=20), folds.sampling_step()])
def test_fold_equals_a_plain_loop_on_any_partitioning(spark, step):
    items = fold_rows()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    want = []
    for s in (1, 2):
        state = {}
        for x in items:
            if x[0] == s:
                state, v = step(state, dict(zip(names, x, strict=True)))
                want.append((s, x[1], v))
    table = spark.createDataFrame(items, SCHEMA)
    for parts in (1, 16):
        got = folds.grouped_fold(table.repartition(parts), "session_id", ["frame_idx"], step)
        assert rows(got, "session_id", "frame_idx", "verdict") == sorted(want)


@pytest.mark.parametrize("native, step", [(folds.redundancy_filter, folds.redundancy_step()), (folds.adaptive_sampling, folds.sampling_step())])
def test_native_folds_equal_the_steps(spark, native, step):
    items = fold_rows() + [(3, 0, None, 1, 1, 40, 40, 1.0, 50.0), (3, 1, [1.0, 2.0, 3.0, 4.0], None, 1, 40, 40, None, 90.0), (3, 2, [1.0] * 4, 1, 1, 40, 40, 2.0, None), (3, 3, [2.0] * 4, 1, 1, 40, 40, 2.0, 90.0)]
    table = spark.createDataFrame(items, SCHEMA).withColumn("Verdict", F.lit("old"))
    want = folds.grouped_fold(table.drop("Verdict"), "session_id", ["frame_idx"], step)
    got = native(table)
    assert rows(got.select("session_id", "frame_idx", "verdict")) == rows(want.select("session_id", "frame_idx", "verdict"))
    assert [x.lower() for x in got.columns].count("verdict") == 1 and native(table.limit(0)).count() == 0


def test_view_representatives_are_not_transitive(spark):
    items = [(1, i, [1.0, 2.0, 3.0], 0.06 * i, 0.0, 0.1, 1.0, [0.0]) for i in range(4)] + [(1, 4, None, 0.0, 0.0, 0.1, 1.0, [0.0])]
    table = spark.createDataFrame(items, "session_id long, frame_idx long, hist array<double>, cx double, cy double, area double, aspect double, shape array<double>")
    got = folds.view_dedupe(table)
    assert rows(got, "frame_idx", "verdict") == [(0, "new_view"), (1, "known_view"), (2, "new_view"), (3, "known_view"), (4, "new_view")]


def plain_views(frames):
    """Indexes of frames that match no earlier representative, by comparing with each of them."""
    views, fresh = [], []
    for x in frames:
        known = any(
            None not in (x[3], x[4], v[3], v[4]) and math.hypot(v[3] - x[3], v[4] - x[4]) < 0.09 and abs(v[5] - x[5]) < 0.10 and abs(v[6] - x[6]) < 0.18
            and sum(abs(a - b) for a, b in zip(v[7], x[7], strict=True)) / len(x[7]) < 0.45 and folds.correlation(v[2], x[2]) > 0.92 for v in views
        )
        if not known:
            views.append(x)
            fresh.append(x[1])
    return fresh


def test_views_by_cells_equal_all_comparisons(spark):
    rng = random.Random(5)
    at = lambda: rng.choice([None, float("inf"), -0.09, 0.09 * rng.randint(-3, 3)] + [rng.uniform(-0.4, 0.4)] * 16)
    items = [(1, i, [rng.random(), 1.0, 2.0], at(), at(), rng.uniform(0, 0.3), rng.uniform(0.9, 1.2), [rng.random()]) for i in range(700)]
    table = spark.createDataFrame(items, "session_id long, frame_idx long, hist array<double>, cx double, cy double, area double, aspect double, shape array<double>")
    got = folds.view_dedupe(table).filter("verdict = 'new_view'")
    want = plain_views(items)
    assert sorted(r.frame_idx for r in got.collect()) == want and 100 < len(want) < 600


def plain_angles(frames, budget):
    known = sorted((x for x in frames if x[1] is not None), key=lambda x: (x[1], x[0]))
    used = []
    for k in range(min(budget, len(known))):
        ideal = -180 + 360 * k / min(budget, len(known))
        d = [min(abs(a - ideal), 360 - abs(a - ideal)) / max(0.1 if q is None else q, 0.01) for _, a, q in known]
        used.append(min((i for i in range(len(known)) if i not in used), key=lambda i: (d[i], i)))
    return [(known[i][0], k) for k, i in enumerate(used)]


def test_angle_selection_equals_greedy(spark):
    frames = [(f"f{i:02d}", None if i % 11 == 0 else float(i * 37 % 360 - 180), None if i % 5 == 0 else (i * 29 % 100) / 100) for i in range(60)]
    table = spark.createDataFrame([(1, *x) for x in frames] + [(2, "only", 3.0, None), (3, "none", None, 1.0)], "session_id long, name string, azimuth double, ranking_score double")
    got = folds.angle_selection(table, 12)
    assert rows(got.filter("session_id = 1"), "name", "pick") == sorted(plain_angles(frames, 12))
    assert rows(got.filter("session_id > 1"), "session_id", "name", "pick") == [(2, "only", 0)]


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 7, [0.0] * 40 + [1e9], [float(i * i % 101) for i in range(500)], [1e-3 * i for i in range(2000)] + [None]])
def test_exact_quantiles(spark, values):
    table = spark.createDataFrame([(1, v) for v in values] + [(2, 3.0)], "mesh long, v double")
    got = {r.mesh: r.q for r in mesh.exact_quantiles(table, ("mesh",), "v", (0.0, 0.5, 0.99, 1.0), blocks=16).collect()}
    known = sorted(v for v in values if v is not None)
    for q, x in zip((0.0, 0.5, 0.99, 1.0), got[1], strict=True):
        at = q * (len(known) - 1)
        low, high = known[math.floor(at)], known[math.ceil(at)]
        assert x == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-9, abs=1e-12)
    assert got[2] == [3.0] * 4


def test_large_meshes_have_the_same_quantiles(spark):
    vertices = spark.createDataFrame([(m, i, float(i * m % 7), float(i % 5), float(i % 3)) for m in (1, 2) for i in range(30)], "mesh long, v long, x double, y double, z double")
    faces = spark.createDataFrame([(m, i % 30, (i * 7 + m) % 30, (i * 11 + 3) % 30) for m in (1, 2) for i in range(90 * m)], "mesh long, v0 long, v1 long, v2 long")
    want = rows(mesh.edge_aspect_stats(vertices, faces))
    for held in (0, 100):
        assert all(a == pytest.approx(b, rel=1e-9) for a, b in zip(rows(mesh.edge_aspect_stats(vertices, faces, held)), want, strict=True))


def test_tasks_of_mesh_values_grow_with_the_faces(spark):
    def stats(n, **most):
        vertices = spark.range(50).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<long>")).alias("mesh")).select("mesh", "v", *((F.col("v") * k % 11).cast("double").alias(a) for a, k in (("x", 3), ("y", 5), ("z", 7))))
        faces = spark.range(n).select((F.col("id") % 20).alias("mesh"), *((F.col("id") * k % 50).alias(f"v{i}") for i, k in enumerate((3, 7, 11))))
        return mesh.edge_aspect_stats(vertices, faces, **most)

    few, many = stats(1_000, per_task=500), stats(4_000, per_task=500)
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (8, 32)
    assert rows(many) == rows(stats(4_000)) and len(rows(many)) == 20


def test_normalization_edges(spark):
    table = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 1e-4, 0.0, 0.0), (2, -2000.0, 5.0, 0.0), (2, 2000.0, 6.0, 9.0), (3, None, None, None)], "mesh long, x double, y double, z double")
    got = {r.mesh: (r.largest_axis, r.issues, r.warnings, r.flat_on_ground) for r in mesh.normalization_audit(table).collect()}
    assert got == {1: ("x", ["model_too_small"], [], True), 2: ("x", ["model_too_large"], ["model_not_centered", "ground_alignment_uncertain"], False), 3: (None, ["no_vertices_found"], [], None)}


def test_geometries_and_shares(spark):
    vertices = spark.createDataFrame([(1, i, float(i // 2), 0.0, 0.0, i % 2) for i in range(6)], "mesh long, v long, x double, y double, z double, geometry long")
    faces = spark.createDataFrame([(1, 0, 1, 2)], "mesh long, v0 long, v1 long, v2 long")
    row = mesh.mesh_metrics(vertices, faces).first()
    assert (row.vertices, row.geometries, row.duplicate_vertices, row.faces, row.degenerate_faces) == (6, 2, 0, 1, 1)
    assert mesh.mesh_metrics(vertices.drop("geometry"), faces).first().duplicate_vertices == 3
    labels = mesh.connected_components(spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a long, b long"))
    elements = spark.createDataFrame([(1, 0), (1, 1), (1, 4), (1, 9), (2, 5)], "mesh long, node long")
    assert rows(mesh.largest_share(labels, elements)) == [(1, 3, 0.5), (2, 1, 1.0)]


def stream_of(spark, tmp_path, parts, schema):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i >= 0
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_state_is_carried_over_batches(spark, tmp_path):
    base = "2024-01-01 00:00:"
    parts = [[(1, i, f"{base}{i:02d}") for i in range(a, b)] for a, b in ((0, 2), (2, 5), (5, 6))]
    stream = stream_of(spark, tmp_path, parts, "session_id long, event_id long, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    got = streams.run_available(streams.retries(stream, limit=3))
    assert rows(got, "event_id", "count", "escalated") == [(i, i + 1, i >= 3) for i in range(6)]


def test_latest_rows_by_bucket(spark, tmp_path):
    parts = [[(1, 1, "a"), (2, 1, "b"), (3, 5, "c")], [(1, 2, "d"), (4, 1, "e")], [(3, 4, "late"), (2, 9, "f")]]
    schema, folder = "session_id long, seq long, payload string", str(tmp_path / "out")
    streams.upsert_latest(stream_of(spark, tmp_path, parts, schema), folder, buckets=3)
    streams.upsert_latest(stream_of(spark, tmp_path, [[(4, 3, "g")]], schema), folder, buckets=3)  # goes on from its checkpoint
    empty = spark.createDataFrame([], schema).schema
    assert rows(streams.read_latest(spark, folder, empty)) == [(1, 2, "d"), (2, 9, "f"), (3, 5, "c"), (4, 3, "g")]
    assert streams.read_latest(spark, str(tmp_path / "none"), empty).count() == 0
    versions = streams._versions(spark, folder)
    assert streams._buckets(spark, folder, versions[-1]) != streams._buckets(spark, folder)


def test_stream_state_expires(spark, tmp_path):
    parts = [[(1, 0, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:00:00")], [(2, 2, "2024-01-09 00:00:00")], [(2, 3, "2024-01-09 01:00:00")], [(1, 4, "2024-01-09 02:00:00")]]
    stream = stream_of(spark, tmp_path, parts, "session_id long, event_id long, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    got = streams.run_available(folds.stream_fold(stream, "session_id", ["ts", "event_id"], folds.retry_step(), expire_hours=24 * 7.5))
    seen = dict(rows(got, "event_id", "verdict"))
    assert seen[3] == "3:retry" and seen[4] == "1:retry"  # session 1 was forgotten, session 2 was not


def test_late_rows_are_dropped_and_repeats_count_once(spark, tmp_path):
    schema = "event_id long, t string, component string"
    parts = [[(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 05:00:00", "a")], [(5, "2024-01-01 06:00:00", "a")], [(3, "2024-01-01 00:20:00", "a"), (4, "2024-01-01 09:00:00", "a")]]
    stream = stream_of(spark, tmp_path, parts, schema).withColumn("ts", F.to_timestamp("t"))
    got = streams.run_available(streams.windowed_counts(streams.without_repeats(stream), "tumbling", delay=None))
    assert [r.n for r in got.orderBy("start").collect()] == [1, 1, 1]  # the row of 00:20 came behind the watermark


def test_lifecycle_terminal_state(spark, tmp_path):
    steps = ["created", "captured", "published", "failed", "captured"]
    stream = stream_of(spark, tmp_path, [[(1, i, f"2024-01-01 00:00:{i:02d}", s) for i, s in enumerate(steps)]], "session_id long, event_id long, t string, status string")
    got = streams.run_available(streams.lifecycle(stream.withColumn("ts", F.to_timestamp("t")).drop("t")))
    assert [v for _, v in rows(got, "event_id", "verdict")] == ["ok", "ok", "illegal_from_captured", "ok", "after_terminal"]


def test_retention_protects_and_keeps_active(spark):
    table = spark.createDataFrame([("a", "raw", 1, "x.jpg", "2024-01-01"), ("b", "raw", 2, "x.jpg", "2024-01-01"), ("c", "scratch", 9, "x.jpg", "2024-01-01"), ("d", "scratch", 9, "run.log", "2024-01-01")], "folder string, kind string, owner long, name string, mtime string")
    sessions = spark.createDataFrame([(1, "captured", None, None), (2, "failed", None, None)], "owner long, status string, publish_state string, last_progress timestamp")
    plan = retention_plan(table.withColumn("mtime", F.to_timestamp("mtime")), sessions, F.lit("2024-02-01").cast("timestamp"))
    assert rows(plan, "folder", "action", "reason") == [("a", "keep", "active_session"), ("b", "prune", "status=failed"), ("c", "prune", "orphan"), ("d", "keep", "protected_files")]


def glb(doc, magic=files.MAGIC, extra=0):
    body = json.dumps(doc).encode()
    body += b" " * (-len(body) % 4)
    return struct.pack("<IIIII", magic, 2, 20 + len(body) + extra, len(body), files.JSON_CHUNK) + body


def test_glb_corpus(spark, tmp_path):
    good = {"scenes": [{}], "nodes": [{}], "meshes": [{}], "materials": [{"pbrMetallicRoughness": {"baseColorTexture": {"index": 0}}}], "textures": [{}]}
    for name, data in {"good": glb(good), "short": b"glTF", "magic": glb(good, 1), "length": glb(good, extra=3), "texture": glb({**good, "textures": []}), "empty": glb({})}.items():
        (tmp_path / f"{name}.glb").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in files.glb_inventory(spark, str(tmp_path)).collect()}
    assert got["good"].valid and got["good"].has_base_color
    assert got["short"].issues == ["file_too_small_for_header"] and got["magic"].issues == ["invalid_magic"] and got["length"].issues == ["length_mismatch"]
    assert got["texture"].issues == ["invalid_texture_ref"] and got["empty"].issues == ["no_scenes", "missing_meshes"]
    assert got["empty"].warnings == ["no_nodes", "no_materials"] and got["empty"].has_base_color is None and not got["good"].has_normal
    assert {r.issue for r in files.glb_issue_counts(files.glb_inventory(spark, str(tmp_path))).collect()} >= {"no_scenes", "invalid_magic"}


def test_glb_damage(spark):
    full = {"scenes": [{}], "nodes": [{}, {}], "meshes": [{}], "images": [{}], "buffers": [{}], "bufferViews": [{"buffer": 0}, {"buffer": 1}], "accessors": [{"bufferView": 1}, {}], "materials": [{"normalTexture": {"index": 0}}]}
    body = glb(full)
    chunk = lambda n, kind: struct.pack("<II", n, kind)
    fixed = lambda data: data[:8] + struct.pack("<I", len(data)) + data[12:]
    cases = {
        "refs.glb": (body, ["invalid_buffer_ref"]), "views.glb": (glb({**full, "bufferViews": [{}], "accessors": [{"bufferView": 4}]}), ["invalid_buffer_ref", "invalid_buffer_view_ref"]),
        "version.glb": (body[:4] + struct.pack("<I", 3) + body[8:], ["unsupported_version_3", "invalid_buffer_ref"]), "bin.glb": (fixed(body + chunk(99, files.BIN_CHUNK)), ["bin_chunk_overflows_file", "invalid_buffer_ref"]),
        "other.bin": (fixed(body + chunk(0, files.BIN_CHUNK)), ["unexpected_extension", "invalid_buffer_ref"]), "kind.glb": (body[:16] + b"ABCD" + body[20:], ["first_chunk_not_json"]), "over.glb": (fixed(body[:-8]), ["json_chunk_overflows_file"]),
        "head.glb": (fixed(body[:14]), ["file_too_small_for_json_chunk"]), "array.glb": (fixed(struct.pack("<IIIII", files.MAGIC, 2, 0, 4, files.JSON_CHUNK) + b"oops"), ["json_parse_failed"]), "none.glb": (b"", ["file_too_small_for_header"]),
    }
    got = {r.path: r for r in files.glb_report(spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in cases.items()], "path string, content binary")).collect()}
    assert {k: got[k].issues for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert (got["refs.glb"].nodes, got["refs.glb"].images, got["refs.glb"].has_normal, got["refs.glb"].has_base_color) == (2, 1, True, False) and got["over.glb"].nodes == 0


def test_blank_points_line_shifts_pairs(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    head = "{} 1 0 0 0 1 2 3 7 f{}.jpg"
    (tmp_path / "s1" / "images.txt").write_text("# c\n" + "\n".join([head.format(1, 1), "", head.format(2, 2), "1 2 3", head.format(3, 3), "4 5 6"]) + "\n")
    names = lambda pairing: [r.name for r in files.ingest_sparse_poses(spark, str(tmp_path), pairing).collect()]
    assert names("reference") == ["f1.jpg"] and names("raw_line") == ["f1.jpg", "f2.jpg", "f3.jpg"]


def test_session_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"session_id": "a", "status": "CREATED", "unknown": 1}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    good, bad = files.scan_sessions(spark, str(tmp_path))
    assert rows(good, "session_id", "status") == [("a", "created")] and bad.count() == 1


def test_benchmark_results_are_not_overwritten(spark, tmp_path):
    runs, out = spark.createDataFrame([(1, True)], "id long, ok boolean"), str(tmp_path / "out")
    assert files.write_benchmark_results(runs, out, F.col("ok"))
    assert not files.write_benchmark_results(runs.limit(0), out, F.col("ok"))
    assert spark.read.json(f"{out}/json").count() == 1


@pytest.mark.parametrize("feature, reason", [("occupancy", "temporal_occupancy_outlier"), ("cx", "temporal_centroid_jump"), ("cy", "temporal_centroid_jump")])
@pytest.mark.parametrize("hundredths, at", [([18, 23, 33, 13, 3], 33), ([32, 36, 14, 3, 20], 3), ([55, 19, 54, 28, 33, 51], 19)])
def test_mask_at_the_limit_is_no_outlier_in_any_order(spark, feature, reason, hundredths, at):
    """`at` lies exactly 1.5 deviations from the mean; one hundredth further out is over the limit."""
    further = at + (1 if at > sum(hundredths) / len(hundredths) else -1)
    orders = (hundredths, sorted(hundredths), sorted(hundredths, reverse=True))
    sessions = [[x if v == at else v for v in order] for x in (at, further) for order in orders]
    table = spark.createDataFrame([(i, v, v / 100) for i, values in enumerate(sessions) for v in values], "session_id long, hundredths long, value double").coalesce(1)
    scored = frames.temporal_zscore(table, ("value",)).withColumns({"border_largest": F.lit(False), "occupancy": F.lit(0.5)})
    judged = session_rules.mask_outlier_reject(scored.withColumns({f"{c}_z": F.col("value_z") if c == feature else F.lit(0.0) for c in ("occupancy", "cx", "cy")}), 1.5)
    got = {(r.session_id, r.hundredths): (r.rejection_reasons, r.accepted) for r in judged.collect()}
    assert [got[i, at] for i in (0, 1, 2)] == [([], True)] * 3
    assert [got[i, further] for i in (3, 4, 5)] == [([reason], False)] * 3


def test_log_lines_that_are_no_json(spark, tmp_path):
    (tmp_path / "x.log").write_text('{"level": "ERROR", "message": "m"}\nplain text\n\n{broken\n')
    got = rows(files.scan_log_lines(spark, str(tmp_path)), "level", "message")
    assert ("ERROR", "m") in got and ("INFO", "plain text") in got and ("INFO", "{broken") in got
    assert files.log_tail(files.scan_log_lines(spark, str(tmp_path)), 1).first().message == "{broken"


def test_log_tail_of_rotated_files(spark, tmp_path):
    for name, at, lines in (("factory.log", 300, ["e", "f"]), ("factory.log.1", 200, ["c", "d"]), ("factory.log.2", 100, ["a", "b"])):
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
        os.utime(tmp_path / name, (at, at))
    log = files.scan_log_lines(spark, str(tmp_path))
    assert [r.message for r in files.log_tail(log, 5, by="modified").collect()] == ["f", "e", "d", "c", "b"]
    assert [r.message for r in files.log_tail(log, 3).collect()] == ["b", "a", "d"]


def test_checkpoint_folder_is_demanded_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        checkpoints.shared_folder(Session())
