"""Queries of the registry, of attempts and of joins between capture tables."""

from pyspark.sql import functions as F

from orbitgrid.operators import registry as op
from orbitgrid.plans.function_queries import CENTER, MESSAGES
from orbitgrid.plans.registry import query
from orbitgrid.plans.rule_queries import SCORED, candidates, joined, listed

c = F.col
LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in op.TRANSITIONS.items() for b in bs)


@query("lifecycle_check", f"SELECT session_id, event_id, from_status, status, from_status IS NULL OR (from_status, status) IN ({LEGAL}) AS legal FROM history")
def _(t):
    return op.lifecycle_check(t.history).select("session_id", "event_id", "from_status", "status", "legal")


PUB = """CASE asset_id % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'review' ELSE 'pass' END AS decision, asset_id % 11 > 0 AS registered, asset_id % 13 = 0 AS ai_generated, asset_id % 5 = 0 AS requires_manual_review, CASE WHEN asset_id % 17 = 0 THEN 'synthetic' END AS geometry_source,
CASE WHEN asset_id % 19 = 0 THEN '' ELSE 'https://a/g.glb' END AS glb_url, 'u' AS usdz_url, CASE WHEN asset_id % 23 = 0 THEN ' HTTPS://missing' ELSE 'p' END AS poster_url, CASE WHEN asset_id % 29 = 0 THEN NULL ELSE 't' END AS thumb_url"""


@query("publish_eligibility", """WITH r AS (SELECT asset_id, CASE WHEN asset_id % 7 = 0 THEN 'failed_validation' WHEN asset_id % 11 = 0 THEN 'not_registered' WHEN asset_id % 13 = 0 THEN 'ai_generated' WHEN (asset_id % 7 = 1 OR asset_id % 5 = 0) AND NOT approved THEN 'unapproved_review' WHEN asset_id % 19 = 0 OR asset_id % 29 = 0 THEN 'missing_urls'
WHEN asset_id % 23 = 0 THEN 'placeholder_urls' WHEN asset_id % 17 = 0 THEN 'not_photogrammetry' END AS b FROM assets) SELECT asset_id, b AS block_reason, b IS NULL AS eligible FROM r""")
def _(t):
    rows = t.spark.sql(f"SELECT asset_id, approved, {PUB} FROM {{a}}", a=t.assets)
    return op.publish_eligibility(rows).select("asset_id", "block_reason", "eligible")


MASKS = "SELECT session_id, name || CASE WHEN k % 3 = 0 THEN '.png' ELSE '.jpg.png' END AS mask_name, area AS occupancy FROM frames WHERE k % 4 > 0"


@query("frame_mask_join", "SELECT event_id, CASE WHEN k % 4 = 0 THEN 'none' WHEN k % 3 = 0 THEN 'stem' ELSE 'legacy' END AS match_mode, CASE WHEN k % 4 > 0 THEN R[area] END AS occupancy FROM frames")
def _(t):
    frames = t.frames.select("session_id", "event_id", F.concat("name", F.lit(".jpg")).alias("name"))
    masks = t.spark.sql(MASKS.replace("FROM frames", "FROM {f}"), f=t.frames)
    return op.frame_mask_join(frames, masks).select("event_id", "match_mode", "occupancy")


FOLD = "SELECT session_id, 'd' || k % 4 AS folder, name AS file, CASE WHEN (k + frame_idx) % 7 < k % 4 + 2 THEN name ELSE 'other_' || name END AS stem, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS size FROM frames"


@query("mask_folder_choice", f"""WITH m AS ({FOLD}), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, folder ORDER BY file) AS rn FROM m), s AS (SELECT r.session_id, folder, avg((i.name IS NOT NULL)::int) AS mt, avg(coalesce(i.name IS NOT NULL AND r.size = 1, false)::int) AS dm FROM r LEFT JOIN frames i ON i.session_id = r.session_id AND i.name = r.stem WHERE rn <= 20 GROUP BY 1, 2),
b AS (SELECT session_id, folder, mt + dm * 0.1::double AS score, row_number() OVER (PARTITION BY session_id ORDER BY mt + dm * 0.1::double DESC, folder) AS rn FROM s WHERE mt > 0.5) SELECT session_id, folder, R[score] AS score FROM b WHERE rn = 1""")
def _(t):
    masks = t.spark.sql(FOLD.replace("FROM frames", "FROM {f}"), f=t.frames)
    return op.mask_folder_choice(t.frames.select("session_id", "name", F.lit(1).alias("size")), masks)


@query("frame_pose_join", f"WITH {CENTER} SELECT e.vec_id, CASE WHEN e.vec_id % 3 > 0 THEN R[degrees(atan2(x, z))] END AS azimuth FROM embeddings e JOIN cc ON cc.camera = e.vec_id")
def _(t):
    name = F.concat(F.lit("f"), c("camera").cast("string"))
    frames = t.poses.select("session_id", c("camera").alias("vec_id"), name.alias("name"))
    return op.frame_pose_join(frames, t.poses.filter("camera % 3 > 0").withColumn("name", name)).select("vec_id", "azimuth")


@query("report_bundle", """WITH s AS (SELECT DISTINCT session_id FROM frames), q AS (SELECT session_id, count(*) AS frame_count FROM frames WHERE session_id % 3 > 0 GROUP BY 1), v AS (SELECT session_id, max(k) AS score FROM frames WHERE session_id % 4 > 0 GROUP BY 1)
SELECT session_id, coalesce(frame_count, 0) AS frame_count, coalesce(score, -1) AS score FROM s LEFT JOIN q USING (session_id) LEFT JOIN v USING (session_id)""")
def _(t):
    f = t.frames
    quality = f.filter("session_id % 3 > 0").groupBy("session_id").agg(F.count("*").alias("frame_count"))
    validation = f.filter("session_id % 4 > 0").groupBy("session_id").agg(F.max("k").alias("score"))
    return op.report_bundle(f.select("session_id").distinct(), {"quality": (quality, {"frame_count": 0}), "validation": (validation, {"score": -1})})


@query("best_attempt_lookup", """WITH a AS (SELECT session_id, count(*) AS n, CASE WHEN session_id % 5 = 0 THEN NULL ELSE session_id % 6 END AS i FROM attempts GROUP BY 1)
SELECT a.session_id, t.points FROM a JOIN attempts t ON t.session_id = a.session_id AND t.idx = CASE WHEN i IS NOT NULL AND i < n THEN i ELSE n - 1 END""")
def _(t):
    rows = t.attempts.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "points"))), lambda x: x).alias("attempts"))
    rows = rows.withColumn("selected_best_index", F.when(c("session_id") % 5 != 0, c("session_id") % 6))
    return op.best_attempt_lookup(rows).select("session_id", "best.points")


ACTIVE = "SELECT product_id, max(asset_id) FILTER (WHERE m < 3) AS active_id FROM assets GROUP BY product_id HAVING count(*) FILTER (WHERE m < 3) > 0"
SESS = "SELECT user_id AS session_id, user_id * 3 AS product_id, CASE WHEN max(event_id) % 3 = 0 THEN 'published' ELSE 'captured' END AS status, max(ts) AS updated_at FROM events GROUP BY user_id"


def _active(t):
    return t.spark.sql(ACTIVE.replace("FROM assets", "FROM {a}"), a=t.assets)


def _sessions(t):
    return t.spark.sql(SESS.replace("FROM events", "FROM {e}"), e=t.events)


@query("product_listing", f"""WITH ac AS ({ACTIVE}), ss AS ({SESS}), a AS (SELECT product_id, count(*) AS n, max(created_at) AS u FROM assets GROUP BY 1), s AS (SELECT product_id, bool_or(status NOT IN ('published', 'failed')) AS busy, max(updated_at) AS u FROM ss GROUP BY 1)
SELECT product_id, active_id, coalesce(n, 0) AS asset_count, CASE WHEN busy THEN 'processing' ELSE 'registered' END AS status, coalesce(a.u, s.u) AS last_updated FROM a FULL JOIN s USING (product_id) LEFT JOIN ac USING (product_id)""")
def _(t):
    return op.product_listing(t.assets, _active(t), _sessions(t))


AUDIT = "SELECT asset_id, created_at AS ts, 0 AS seq, 'registered' AS action FROM assets UNION ALL SELECT asset_id, created_at, 1, 'approved' FROM assets WHERE approved UNION ALL SELECT asset_id, created_at, 2, 'published' FROM assets WHERE m = 1"
TRAIL = "'registered' || CASE WHEN approved THEN ',approved' ELSE '' END || CASE WHEN m = 1 THEN ',published' ELSE '' END"


def _audit(t):
    return t.spark.sql(AUDIT.replace("FROM assets", "FROM {a}"), a=t.assets)


@query("audit_trail", f"SELECT asset_id, {TRAIL} AS actions FROM assets")
def _(t):
    return joined(op.audit_trail(_audit(t)), "actions")


@query("product_history", f"""WITH ac AS ({ACTIVE}), ss AS ({SESS}) SELECT a.product_id, asset_id, 'v' || m AS version, coalesce(asset_id = active_id, false) AS is_active, {TRAIL} AS actions FROM assets a LEFT JOIN ac USING (product_id)
UNION ALL SELECT product_id, session_id, 'In-Progress', false, 'session_created' FROM ss WHERE product_id NOT IN (SELECT product_id FROM assets)""")
def _(t):
    assets = t.assets.withColumn("version", F.concat(F.lit("v"), c("m").cast("string")))
    return joined(op.product_history(assets, _active(t), _audit(t), _sessions(t)), "actions")


@query("pending_reviews", "SELECT asset_id, product_id FROM assets WHERE NOT approved")
def _(t):
    return op.pending_reviews(t.assets).select("asset_id", "product_id")


@query("mask_evaluation_join", "WITH p AS (SELECT DISTINCT image, x, y, truth, predicted FROM mask_pixels) SELECT a.image AS name, a.x, a.y, a.truth AS t, b.predicted AS p FROM p a JOIN p b ON a.image = b.image AND a.x = b.x AND a.y = b.y WHERE b.image % 4 > 0")
def _(t):
    p = t.mask_pixels.distinct()
    truth = p.select(c("image").alias("name"), "x", "y", c("truth").alias("t"))
    return op.mask_evaluation_join(truth, p.filter("image % 4 > 0").select(c("image").alias("name"), "x", "y", c("predicted").alias("p")))


@query("dataset_gaps", """SELECT session_id AS video, event_id AS frame, 'mask_missing' AS problem FROM frames WHERE k % 5 = 0 UNION ALL SELECT session_id, NULL, 'few_frames' FROM frames GROUP BY session_id HAVING count(*) < 60""")
def _(t):
    meta = t.frames.select(c("session_id").alias("video"), c("event_id").alias("frame"), c("name").alias("mask"))
    return op.dataset_gaps(meta, t.frames.filter("k % 5 > 0").select(c("name").alias("file")), 60)


@query("name_overlap", "SELECT session_id AS job, count(*) FILTER (k % 3 < 2) AS images, count(*) FILTER (k % 3 > 0) AS masks, count(*) FILTER (k % 3 = 1) AS matches FROM frames GROUP BY 1")
def _(t):
    f = t.frames.select(c("session_id").alias("job"), "name", "k")
    return op.name_overlap(f.filter("k % 3 < 2"), f.filter("k % 3 > 0"))


@query("dense_mask_integrity", "WITH f AS (SELECT session_id AS job, k % 30 > 0 OR session_id % 3 = 0 AS has, k % 40 > 0 OR session_id % 2 = 0 AS same FROM frames) SELECT job, count(*) AS images, count(*) FILTER (has) AS exact, count(*) FILTER (has AND same) AS dim, count(*) FILTER (has AND NOT same) AS mismatch, bool_and(has AND same) AS valid FROM f GROUP BY 1")
def _(t):
    f = t.frames.select(c("session_id").alias("job"), "name", "k", F.lit(10).alias("w"), F.lit(20).alias("h"))
    masks = f.filter((c("k") % 30 > 0) | (c("job") % 3 == 0)).withColumn("w", F.when((c("k") % 40 > 0) | (c("job") % 2 == 0), 10).otherwise(11))
    return op.dense_mask_integrity(f.drop("k"), masks.drop("k"))


BASE = "SELECT event_type AS mode, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS method, area AS iou, k % 7 > 0 AS valid FROM frames"


@query("baseline_gain", f"""WITH s AS ({BASE}), g AS (SELECT mode, avg(iou) FILTER (method = 'a') AS ar, avg(iou) FILTER (method = 'b') AS br, avg(iou) FILTER (method = 'a' AND valid) AS ac, avg(iou) FILTER (method = 'b' AND valid) AS bc FROM s GROUP BY 1)
SELECT mode, R[ar] AS a_raw, R[br] AS b_raw, R[ac] AS a_corrected, R[bc] AS b_corrected, R[bc - ac] AS gain, rank() OVER (ORDER BY bc DESC, mode) AS rank FROM g""")
def _(t):
    return op.baseline_gain(t.spark.sql(BASE.replace("FROM frames", "FROM {f}"), f=t.frames))


DEV = "SELECT session_id, frame_idx, event_id, CASE session_id % 7 WHEN 0 THEN 'Apple' WHEN 1 THEN 'Google' WHEN 2 THEN 'SAMSUNG' WHEN 3 THEN 'GoPro' WHEN 4 THEN 'Sony' END AS make, CASE session_id % 7 WHEN 0 THEN 'iPhone 15' WHEN 1 THEN 'Pixel 8' WHEN 2 THEN 'SM-G99' WHEN 3 THEN 'Hero' WHEN 4 THEN 'ILCE-7' END AS model, CASE WHEN session_id % 5 = 0 THEN NULL ELSE (k % 40) / 2e0 END AS focal_mm, CASE WHEN k % 3 = 0 THEN 'OPENCV_FISHEYE' END AS hint FROM frames"
MATCH = "CASE WHEN focal_mm > 0 THEN CASE " + " ".join(f"WHEN contains(lower(coalesce(make, '')), '{mk}') AND contains(lower(coalesce(model, '')), '{md}') AND focal_mm BETWEEN {lo} AND {hi} THEN '{cm}'" for mk, md, lo, hi, cm in op.DEVICES) + " END END"


def _devices(t):
    return t.spark.sql(DEV.replace("FROM frames", "FROM {f}"), f=t.frames)


@query("device_db_match", f"WITH d AS ({DEV}) SELECT event_id, {MATCH} AS device_model FROM d")
def _(t):
    return op.device_db_match(_devices(t)).select("event_id", "device_model")


@query("camera_model_vote", f"""WITH d AS ({DEV}), rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_idx) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM d), s AS (SELECT *, {MATCH} AS dm, CASE WHEN focal_mm > 0 THEN degrees(2 * atan(36 / (2 * focal_mm))) END AS fov FROM rk WHERE n <= 8 OR r IN (SELECT unnest([(i * rk.n) // 8 for i in range(8)]))),
dv AS (SELECT session_id, dm, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(frame_idx)) AS rn FROM s WHERE dm IS NOT NULL GROUP BY 1, 2), hv AS (SELECT session_id, hint, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(frame_idx)) AS rn FROM s WHERE dm IS NULL AND hint IS NOT NULL GROUP BY 1, 2),
f AS (SELECT session_id, avg(fov) AS hf, max(fov) - min(fov) AS rg FROM s GROUP BY 1)
SELECT f.session_id, coalesce(dm, CASE WHEN hf IS NOT NULL THEN CASE WHEN rg > 30 THEN 'OPENCV' WHEN hf < 75 THEN 'RADIAL' WHEN hf < 95 THEN 'OPENCV' ELSE 'OPENCV_FISHEYE' END END, hint, 'RADIAL') AS model, CASE WHEN dm IS NOT NULL THEN 'device_db' WHEN hf IS NOT NULL THEN 'exif_hfov' WHEN hint IS NOT NULL THEN 'filename_hint' ELSE 'default' END AS source, R[coalesce(hf, 0)] AS hfov
FROM f LEFT JOIN dv ON dv.session_id = f.session_id AND dv.rn = 1 LEFT JOIN hv ON hv.session_id = f.session_id AND hv.rn = 1""")
def _(t):
    return op.camera_model_vote(_devices(t))


@query("intrinsics_lookup", """SELECT event_id, CASE WHEN k % 2 = 0 THEN 'hit' ELSE 'miss' END AS status, R[CASE WHEN k % 2 = 0 THEN 1000 + k ELSE CASE WHEN k % 3 > 0 THEN k ELSE 26e0 END * 640 / 36 END] AS fx, R[CASE WHEN k % 2 = 0 THEN 320.5 ELSE 320 END::double] AS cx FROM events_k""")
def _(t):
    key = F.concat(F.lit("k"), c("k").cast("string"))
    req = t.events_k.select("event_id", key.alias("cache_key"), F.lit(640).alias("w"), F.lit(480).alias("h"), F.when(c("k") % 3 > 0, c("k").cast("double")).alias("focal_mm"))
    cache = t.events_k.filter("k % 2 = 0").select("k").distinct().select(key.alias("cache_key"), (1000.0 + c("k")).alias("fx"), (1000.0 + c("k")).alias("fy"), F.lit(320.5).alias("cx"), F.lit(240.5).alias("cy"))
    return op.intrinsics_lookup(req, cache).select("event_id", "status", "fx", "cx")


@query("license_tools", """WITH a AS (SELECT asset_id, CASE asset_id % 4 WHEN 0 THEN ['colmap', 'openmvs'] WHEN 1 THEN ['blender', 'odd'] WHEN 2 THEN ['gltf_validator', 'ffmpeg', 'colmap'] ELSE ['odd'] END AS l FROM assets), e AS (SELECT asset_id, unnest(l) AS tool, generate_subscripts(l, 1) AS i FROM a),
j AS (SELECT * FROM e JOIN (VALUES ('colmap', 'BSD-3-Clause'), ('openmvs', 'AGPL-3.0'), ('blender', 'GPL-2.0-or-later'), ('gltf_transform', 'MIT'), ('gltf_validator', 'Apache-2.0'), ('ffmpeg', 'LGPL-2.1 / GPL-2.0')) v(tool, lic) USING (tool)) SELECT asset_id, string_agg(tool || ':' || lic, ',' ORDER BY i) AS tools, bool_or(starts_with(lic, 'AGPL')) AS agpl_note FROM j GROUP BY 1""")
def _(t):
    arr = lambda *x: F.array(*map(F.lit, x))
    m = c("asset_id") % 4
    tools = F.when(m == 0, arr("colmap", "openmvs")).when(m == 1, arr("blender", "odd")).when(m == 2, arr("gltf_validator", "ffmpeg", "colmap")).otherwise(arr("odd"))
    return joined(op.license_tools(t.assets.select("asset_id", tools.alias("active_tools"))), "tools")


@query("latest_manifest", "SELECT session_id, seq, payload, k FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM manifests) WHERE rn = 1")
def _(t):
    return op.latest_manifest(t.manifests)


@query("next_version", "SELECT product_id, 'v' || (max(CASE WHEN m % 3 = 0 THEN 0 ELSE m * 4 END) + 1) AS next_version FROM assets GROUP BY 1")
def _(t):
    return op.next_version(t.assets.withColumn("version", F.when(c("m") % 3 != 0, F.concat(F.lit("V"), (c("m") * 4).cast("string"), F.lit(".9"))).otherwise("draft")))


@query("rollback_target", f"""WITH ac0 AS ({ACTIVE}), ac AS (SELECT product_id, CASE WHEN product_id % 5 = 0 THEN -1 ELSE active_id END AS active_id FROM ac0), r AS (SELECT product_id, asset_id, lag(asset_id) OVER w AS before, row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, asset_id DESC) AS rn, count(*) OVER (PARTITION BY product_id) AS n FROM assets WINDOW w AS (PARTITION BY product_id ORDER BY created_at, asset_id)),
g AS (SELECT product_id, max(n) AS n, max(asset_id) FILTER (rn = 1) AS newest, max(before) FILTER (rn = 1) AS second FROM r GROUP BY 1), k AS (SELECT r.product_id, before, true AS known FROM r JOIN ac ON ac.product_id = r.product_id AND ac.active_id = r.asset_id)
SELECT g.product_id, CASE WHEN n >= 2 THEN CASE WHEN active_id IS NULL THEN newest WHEN known THEN before ELSE second END END AS new_active FROM g LEFT JOIN ac ON ac.product_id = g.product_id LEFT JOIN k ON k.product_id = g.product_id""")
def _(t):
    active = _active(t).withColumn("active_id", F.when(c("product_id") % 5 == 0, F.lit(-1)).otherwise(c("active_id")))
    return op.rollback_target(t.assets, active)


@query("best_attempt", """WITH a AS (SELECT session_id, idx, registered * 1e0 AS score, points % 3 > 0 AS ok FROM attempts), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ok DESC, score DESC, idx) AS rn FROM a)
SELECT session_id, CASE WHEN ok THEN idx END AS idx, CASE WHEN ok THEN score END AS score, CASE WHEN ok THEN 'success' ELSE 'recapture_required' END AS final_status FROM r WHERE rn = 1""")
def _(t):
    return op.best_attempt(t.attempts.select("session_id", "idx", c("registered").cast("double").alias("score"), (c("points") % 3 > 0).alias("success")))


SPARSE = """SELECT session_id AS job, concat('m', cast(k % 3 AS string)) AS model, event_id * 2 AS line_no, CASE k % 5 WHEN 0 THEN concat('Registered images : ', cast(k % 4 AS string)) WHEN 1 THEN concat('Points: ', cast(k AS string)) WHEN 2 THEN 'Points in observations: 9' ELSE concat('Points3D : ', cast(k * 2 AS string)) END AS line FROM frames"""


@query("sparse_model_choice", """WITH l AS (SELECT session_id AS job, 'm' || k % 3 AS model, event_id, CASE WHEN k % 5 = 0 THEN k % 4 END AS im, CASE k % 5 WHEN 1 THEN k WHEN 3 THEN k * 2 WHEN 4 THEN k * 2 END AS pt FROM frames),
s AS (SELECT job, model, coalesce(arg_max(im, event_id) FILTER (im IS NOT NULL), 0)::bigint AS images, coalesce(arg_max(pt, event_id) FILTER (pt IS NOT NULL), 0)::bigint AS points FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY images DESC, points DESC, model) AS rn FROM s WHERE images > 0) SELECT job, model, images, points FROM r WHERE rn = 1""")
def _(t):
    return op.sparse_model_choice(t.spark.sql(SPARSE.replace("FROM frames", "FROM {f}"), f=t.frames))


@query("best_candidate", f"""WITH {SCORED}, r AS (SELECT product_id, asset_id, score, provider_status = 'ok' AND has_output AS ok FROM cs), w AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, asset_id) AS rank, row_number() OVER (PARTITION BY product_id, ok ORDER BY score DESC, asset_id) AS pos, bool_or(ok) OVER (PARTITION BY product_id) AS anyok FROM r)
SELECT product_id, asset_id, rank, ok AND pos = 1 AS selected, CASE WHEN NOT anyok THEN 'all_candidates_failed' WHEN ok AND pos = 1 THEN 'highest_score' END AS reason FROM w""")
def _(t):
    from orbitgrid.operators.asset_rules import candidate_score

    return op.best_candidate(candidate_score(candidates(t))).select("product_id", "asset_id", "rank", "selected", "reason")


@query("fallback_next", f"""WITH s AS (SELECT event_id, lower({list(MESSAGES)}[1 + k % 8]) AS e, (['profile_safe', 'safe_high_quality', 'safe_low_resolution', 'low_thread_texture', 'baseline'])[1:(k % 6)] AS used FROM events_k),
k AS (SELECT *, CASE WHEN contains(e, '3221226505') OR contains(e, 'native crash') THEN 'native_crash' WHEN contains(e, 'out of memory') THEN 'oom' WHEN contains(e, 'no such file') THEN 'missing_file' ELSE 'x' END AS c FROM s),
p AS (SELECT *, CASE WHEN c = 'native_crash' AND NOT list_contains(used, 'low_thread_texture') THEN 1 WHEN c = 'oom' AND NOT list_contains(used, 'safe_low_resolution') THEN 2 WHEN c = 'missing_file' OR len(used) = 5 THEN 0 ELSE 3 END AS m FROM k)
SELECT event_id, CASE m WHEN 1 THEN 'low_thread_texture' WHEN 2 THEN 'safe_low_resolution' WHEN 3 THEN ['profile_safe', 'safe_high_quality', 'safe_low_resolution', 'low_thread_texture', 'baseline'][len(used) + 1] END AS preset, CASE m WHEN 1 THEN 'retry_after_native_crash' WHEN 2 THEN 'retry_after_oom' WHEN 3 THEN CASE WHEN len(used) = 0 THEN 'initial' ELSE 'retry_after_runtime_error' END END AS trigger FROM p""")
def _(t):
    used = F.slice(F.array(*map(F.lit, op.LADDER)), F.lit(1), (c("k") % 6).cast("int"))
    error = F.get(F.array(*map(F.lit, MESSAGES)), (c("k") % 8).cast("int"))
    return op.fallback_next(t.events_k.select("event_id", used.alias("used"), error.alias("error"))).select("event_id", "preset", "trigger")


NOW = "epoch_us(timestamp '2024-02-01 00:00:00')"


@query("stage_progress", f"""WITH h AS (SELECT *, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS us, last_value(status) OVER f AS ls, last_value(ts) OVER f AS lt FROM history
  WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id), f AS (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT session_id, status AS stage, count(*) AS steps, round(sum(us) / 1e6, 3) AS duration_s, round(max(us) / 1e6, 3) AS longest_s, status = any_value(ls) AS current, ({NOW} - epoch_us(any_value(lt))) / 1e6 AS age FROM h GROUP BY session_id, status)
SELECT session_id, stage, steps, duration_s, longest_s, current, CASE WHEN current THEN round(age, 3) END AS stale_s, current AND stage IN ('created', 'captured', 'reconstructed', 'cleaned', 'exported', 'validated') AND age > 7200 AS stalled FROM g""", digits=3)
def _(t):
    return op.stage_progress(t.history, F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("fixture_union", "SELECT fixture_id, source, product_type FROM fixtures WHERE fixture_id % 2 = 0 UNION ALL SELECT fixture_id, source, NULL FROM fixtures WHERE fixture_id % 2 = 1")
def _(t):
    f = t.fixtures.select("fixture_id", "source", "product_type")
    return op.fixture_union(f.filter("fixture_id % 2 = 0"), f.filter("fixture_id % 2 = 1").drop("product_type"))


@query("fixture_upsert", "SELECT fixture_id, CASE WHEN fixture_id % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM fixtures")
def _(t):
    f = t.fixtures.select("fixture_id")
    return op.fixture_upsert(f.filter("fixture_id % 2 = 0").withColumn("origin", F.lit("old")), f.filter("fixture_id % 2 = 1 or fixture_id % 3 = 0").withColumn("origin", F.lit("new")))


EV = """asset_id, CASE asset_id % 4 WHEN 0 THEN 'sufficient' WHEN 1 THEN 'warn' WHEN 2 THEN 'PASS' ELSE 'bad' END AS capture, asset_id % 60 AS accepted, 20 + asset_id % 3 AS dense_images, 20 + asset_id % 3 AS mask_exact, 20 + asset_id % 9 % 3 AS mask_dim, (asset_id % 13) / 100e0 AS white_ratio, asset_id % 45 AS registered, asset_id * 7 % 40000 AS points,
CASE asset_id % 3 WHEN 0 THEN 'mask_guided' WHEN 1 THEN 'geometric_only' ELSE 'hybrid_pc_mask' END AS method, 0.5 + (asset_id % 50) / 100e0 AS confidence, asset_id % 20 AS textures, asset_id % 21 AS materials, asset_id % 22 > 0 AS texcoord, asset_id % 23 > 0 AS applied, CASE asset_id % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'fail' ELSE 'pass' END AS glb"""
ITEMS = (("capture_status", "capture IN ('sufficient', 'PASS')", "capture = 'warn'"), ("accepted_frames", "accepted >= 30", "accepted >= 15"), ("dense_masks_integrity", "mask_exact = dense_images AND mask_dim = dense_images", "false"), ("fallback_white_ratio", "white_ratio <= 0.05", "white_ratio <= 0.10"),
         ("registered_images", "registered >= 20 AND CASE WHEN accepted > 0 THEN registered / accepted ELSE 0 END >= 0.70", "registered >= 10"), ("fused_point_count", "points >= 25000", "points >= 10000"), ("object_isolation_method", "method <> 'geometric_only'", "true"), ("isolation_confidence", "confidence >= 0.75", "confidence >= 0.60"),
         ("texture_count", "textures > 0", "false"), ("material_count", "materials > 0", "false"), ("texcoord_0_exists", "texcoord", "false"), ("texture_applied", "applied", "false"), ("glb_validation", "glb = 'pass'", "glb = 'review'"))


@query("evidence_checklist", f"""WITH e AS (SELECT {EV} FROM assets), g AS (SELECT asset_id, {listed(*((f'NOT ({a}) AND NOT ({b})', n) for n, a, b in ITEMS))} AS failures, {listed(*((f'NOT ({a}) AND ({b})', n) for n, a, b in ITEMS))} AS warnings FROM e)
SELECT asset_id, failures, warnings, CASE WHEN failures <> '' THEN 'failed' WHEN warnings <> '' THEN 'review_ready' ELSE 'production_ready' END AS final_status FROM g""")
def _(t):
    rows = t.spark.sql(f"SELECT {EV} FROM {{a}}", a=t.assets)
    return joined(op.evidence_checklist(rows), "failures", "warnings").select("asset_id", "failures", "warnings", "final_status")


@query("quality_profile_clamp", """WITH r AS (SELECT asset_id, CASE asset_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'ultra' WHEN 2 THEN 'odd' WHEN 3 THEN '' END AS mode, CASE WHEN asset_id % 3 = 0 THEN 500 + asset_id % 1000 END AS os, CASE WHEN asset_id % 4 = 0 THEN asset_id % 4096 END AS ot, CASE WHEN asset_id % 6 = 0 THEN asset_id % 9 END AS oc FROM assets),
m AS (SELECT *, CASE mode WHEN 'HIGH' THEN 'high' WHEN 'ultra' THEN 'ultra' ELSE 'balanced' END AS q FROM r) SELECT asset_id, q AS quality_mode, coalesce(mode = 'odd', false) AS unknown_mode, least(coalesce(os, s), 1024)::bigint AS input_size, least(coalesce(ot, x), 2048)::bigint AS texture_resolution, least(coalesce(oc, k), 5)::bigint AS max_candidates, f::bigint AS topk_frames
FROM m JOIN (VALUES ('balanced', 768, 1024, 3, 3), ('high', 1024, 1024, 5, 5), ('ultra', 1024, 2048, 8, 8)) v(q, s, x, k, f) USING (q)""")
def _(t):
    a = c("asset_id")
    mode = F.when(a % 5 == 0, "HIGH").when(a % 5 == 1, "ultra").when(a % 5 == 2, "odd").when(a % 5 == 3, "")
    rows = t.assets.select("asset_id", mode.alias("mode"), F.when(a % 3 == 0, 500 + a % 1000).alias("o_size"), F.when(a % 4 == 0, a % 4096).alias("o_texture"), F.when(a % 6 == 0, a % 9).alias("o_candidates"), F.lit(None).cast("int").alias("o_frames"))
    return op.quality_profile_clamp(rows).select("asset_id", "quality_mode", "unknown_mode", "input_size", "texture_resolution", "max_candidates", "topk_frames")
