"""Queries of the column functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.functions import geometry as geo
from orbitgrid.functions import text as tx
from orbitgrid.plans.registry import query

c = F.col
QN = "sqrt(q[1]*q[1] + q[2]*q[2] + q[3]*q[3] + q[4]*q[4])"
CENTER = f"""pq AS (SELECT session_id, camera, qvec AS q, tvec AS v FROM poses), pn AS (SELECT *, {QN} AS n FROM pq),
pw AS (SELECT session_id, camera, v, CASE WHEN n < 1e-12 THEN 1 ELSE q[1] / n END AS w, CASE WHEN n < 1e-12 THEN 0 ELSE q[2] / n END AS x, CASE WHEN n < 1e-12 THEN 0 ELSE q[3] / n END AS y, CASE WHEN n < 1e-12 THEN 0 ELSE q[4] / n END AS z FROM pn),
cc AS (SELECT session_id, camera, -((1-2*(y*y+z*z))*v[1] + 2*(x*y+z*w)*v[2] + 2*(x*z-y*w)*v[3]) AS x, -(2*(x*y-z*w)*v[1] + (1-2*(x*x+z*z))*v[2] + 2*(y*z+x*w)*v[3]) AS y, -(2*(x*z+y*w)*v[1] + 2*(y*z-x*w)*v[2] + (1-2*(x*x+y*y))*v[3]) AS z FROM pw)"""
SPHERE = f"""{CENTER}, sp AS (SELECT *, sqrt(x*x+y*y+z*z) AS r, degrees(atan2(y, x)) AS az, degrees(asin(greatest(-1, least(1, z / sqrt(x*x+y*y+z*z))))) AS el FROM cc)"""


def centers(t):
    return t.poses.withColumn("c", geo.quat_camera_center(c("qvec"), c("tvec"))).select("session_id", "camera", "c.x", "c.y", "c.z")


@query("quat_camera_center", f"WITH {CENTER} SELECT session_id, camera, R[x] AS x, R[y] AS y, R[z] AS z FROM cc")
def _(t):
    return centers(t)


@query("spherical_angles", f"WITH {SPHERE} SELECT session_id, camera, R[r] AS r, R[az] AS az, R[el] AS el FROM sp")
def _(t):
    return centers(t).withColumn("s", geo.spherical_angles(c("x"), c("y"), c("z"))).select("session_id", "camera", "s.*")


@query("angle_bins", f"WITH {SPHERE} SELECT session_id, camera, CASE WHEN el < -15 THEN 0 WHEN el < 30 THEN 1 ELSE 2 END::bigint AS band, (floor(((az % 360) + 360) % 360 / 45) % 8)::bigint AS sector FROM sp")
def _(t):
    s = geo.spherical_angles(c("x"), c("y"), c("z"))
    return centers(t).withColumn("s", s).withColumn("b", geo.angle_bins(c("s.az"), c("s.el"))).select("session_id", "camera", "b.*")


@query("circular_distance", "WITH d AS (SELECT event_id, abs((k * 37) % 360 - (k * 91) % 360) AS d, confidence FROM frames) SELECT event_id, CASE WHEN d > 180 THEN 360 - d ELSE d END AS dist, R[CASE WHEN d > 180 THEN 360 - d ELSE d END / greatest(confidence, 0.01)] AS weighted FROM d")
def _(t):
    a, b = c("k") * 37 % 360, c("k") * 91 % 360
    return t.frames.select("event_id", geo.circular_distance(a, b).alias("dist"), geo.circular_distance(a, b, c("confidence")).alias("weighted"))


@query("bbox_iou", """WITH b AS (SELECT event_id, session_id, frame_idx, bx, box_y, lag(bx) OVER w AS px, lag(box_y) OVER w AS py FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx)),
i AS (SELECT event_id, greatest(0, least(bx, px) + 40 - greatest(bx, px)) * greatest(0, least(box_y, py) + 40 - greatest(box_y, py)) AS i, px FROM b) SELECT event_id, R[CASE WHEN px IS NULL THEN 0 ELSE i / (3200 - i) END] AS iou FROM i""")
def _(t):
    from pyspark.sql import Window

    box = F.struct(c("bx").alias("x"), c("box_y").alias("y"), c("bw").alias("w"), c("bh").alias("h"))
    rows = t.frames.withColumn("box", box).withColumn("last", F.lag("box").over(Window.partitionBy("session_id").orderBy("frame_idx")))
    return rows.select("event_id", geo.bbox_iou(c("box"), c("last")).alias("iou"))


@query("hist_correlation", """SELECT e.vec_id, R[corr_] AS corr FROM (SELECT a.vec_id, list_cosine_similarity([x - list_avg(a.embedding[1:16]) for x in a.embedding[1:16]], [x - list_avg(b.embedding[1:16]) for x in b.embedding[1:16]])::double AS corr_
FROM (SELECT vec_id, embedding::double[] AS embedding FROM embeddings) a JOIN (SELECT vec_id, embedding::double[] AS embedding FROM embeddings) b ON b.vec_id = a.vec_id + 1) e""")
def _(t):
    a = t.embeddings.select("vec_id", F.slice(c("embedding").cast("array<double>"), 1, 16).alias("a"))
    b = a.select((c("vec_id") - 1).alias("vec_id"), c("a").alias("b"))
    return a.join(b, "vec_id").select("vec_id", geo.hist_correlation(c("a"), c("b")).alias("corr"))


HSV = """mx AS (SELECT image, x, y, r, g, b, a, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM pixels),
hu AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60.0::double * (g - b) / d WHEN v = g THEN 120 + 60.0::double * (b - r) / d ELSE 240 + 60.0::double * (r - g) / d END AS hue FROM mx),
hh AS (SELECT *, floor(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2 + 0.5)::bigint AS half FROM hu),
hsv AS (SELECT image, x, y, r, g, b, a, v, half % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE floor(255.0::double * d / v + 0.5) END::bigint AS s, 0.2126::double * r + 0.7152::double * g + 0.0722::double * b AS lum FROM hh)"""


@query("rgb_to_hsv", f"WITH {HSV} SELECT image, r, g, b, h, s, v, R[lum] AS lum FROM hsv")
def _(t):
    return t.pixels.withColumn("hsv", geo.rgb_to_hsv(c("r"), c("g"), c("b"))).select("image", "r", "g", "b", "hsv.*")


@query("color_class", f"WITH {HSV} SELECT image, v, s, CASE WHEN v < 60 AND s < 60 THEN 'black' WHEN v < 120 AND s < 90 THEN 'dark' WHEN v > 205 AND s < 55 THEN 'white_cream' WHEN s > 105 THEN 'vibrant' ELSE 'mid' END AS class FROM hsv")
def _(t):
    return t.pixels.withColumn("hsv", geo.rgb_to_hsv(c("r"), c("g"), c("b"))).select("image", "hsv.v", "hsv.s", geo.color_class(c("hsv.v"), c("hsv.s")).alias("class"))


@query("camera_model_class", """WITH f AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE (k % 40) END::double AS mm FROM events_k), h AS (SELECT *, degrees(2 * atan(36.0 / (2 * nullif(mm, 0)))) AS fov FROM f)
SELECT event_id, CASE WHEN mm IS NULL OR mm <= 0 OR fov < 75 THEN 'RADIAL' WHEN fov < 95 THEN 'OPENCV' ELSE 'OPENCV_FISHEYE' END AS model FROM h""")
def _(t):
    mm = F.when(c("k") % 10 != 0, (c("k") % 40).cast("double"))
    return t.events_k.select("event_id", geo.camera_model_class(mm).alias("model"))


@query("normalize_status", """WITH s AS (SELECT event_id, lower(trim([' Pass', 'SUCCESS', 'clean ', 'review', 'Warning', 'degraded', 'fail', 'failed', 'contaminated', 'odd'][1 + k % 10])) AS s FROM events_k)
SELECT event_id, CASE WHEN s IN ('pass', 'success', 'clean') THEN 'pass' WHEN s IN ('review', 'warning', 'degraded') THEN 'review' ELSE 'fail' END AS status FROM s""")
def _(t):
    words = F.array(*map(F.lit, (" Pass", "SUCCESS", "clean ", "review", "Warning", "degraded", "fail", "failed", "contaminated", "odd")))
    return t.events_k.select("event_id", tx.normalize_status(F.get(words, (c("k") % 10).cast("int"))).alias("status"))


MESSAGES = ("TextureMesh exit 3221226505", "CUDA error: out of memory", "No such file: x.ply; native crash", "Timed out after 30 s", "RuntimeError: bad", "all good", "", "0xC0000005")


@query("failure_classify", f"""WITH m AS (SELECT event_id, lower({list(MESSAGES)}[1 + k % 8]) AS e FROM events_k)
SELECT event_id, CASE WHEN e = '' THEN 'unknown' WHEN contains(e, '3221226505') OR contains(e, 'native crash') OR (contains(e, 'texturemesh') AND contains(e, 'exit')) THEN 'native_crash' WHEN contains(e, 'out of memory') OR contains(e, 'oom') THEN 'oom'
WHEN contains(e, 'no such file') OR contains(e, 'file not found') THEN 'missing_file' WHEN contains(e, 'runtimeerror') OR contains(e, 'runtime error') THEN 'runtime' ELSE 'unknown' END AS ladder,
CASE WHEN contains(e, 'no such file') OR contains(e, 'file not found') OR contains(e, 'missing artifact') THEN 'missing_file' WHEN contains(e, '3221226505') OR contains(e, '0xc0000005') OR contains(e, 'native crash') THEN 'native_crash'
WHEN contains(e, 'out of memory') OR contains(e, 'memory allocation') OR contains(e, 'oom') THEN 'oom' WHEN contains(e, 'timeout') OR contains(e, 'timed out') THEN 'timeout' ELSE 'unknown' END AS runner FROM m""")
def _(t):
    m = F.get(F.array(*map(F.lit, MESSAGES)), (c("k") % 8).cast("int"))
    return t.events_k.select("event_id", tx.failure_classify(m).alias("ladder"), tx.failure_classify(m, "runner").alias("runner"))


@query("cache_key", """SELECT event_id, concat_ws('|', CASE WHEN k % 3 = 0 THEN 'any' ELSE 'phone_' || (k % 5) END, (k * 10) || 'x' || (k * 7), CASE WHEN k % 4 = 0 THEN 'fany' ELSE 'f' || printf('%.1f', round_even(k / 4e0 * 2, 0) / 2) END, CASE WHEN k % 2 = 0 THEN 'any' ELSE 'cam1' END) AS cache_key FROM events_k""")
def _(t):
    k = c("k")
    device = F.when(k % 3 != 0, F.concat(F.lit(" Phone "), (k % 5).cast("string")))
    return t.events_k.select("event_id", tx.cache_key(k * 10, k * 7, device, F.when(k % 4 != 0, k / 4), F.when(k % 2 == 0, "  ").otherwise("Cam1")).alias("cache_key"))


@query("config_hash", """SELECT event_id, md5('{"backend":"' || event_type || '","rate":' || k || ',"size":' || user_id || '}') AS config_hash, substr(sha256(user_id::varchar), 1, 16) AS product FROM events_k""")
def _(t):
    h = tx.config_hash({"size": c("user_id"), "rate": c("k"), "backend": c("event_type")})
    return t.events_k.select("event_id", h.alias("config_hash"), tx.product_id(c("user_id").cast("string")).alias("product"))


@query("path_parts", """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+:/', '/data') AS p FROM pages), n AS (SELECT page_id, p, regexp_extract(p, '([^/]*)$', 1) AS name FROM p), s AS (SELECT *, regexp_extract(name, '[^.](\\.[^.]*)$', 1) AS suffix FROM n)
SELECT page_id, name, substr(name, 1, length(name) - length(suffix)) AS stem, suffix, CASE WHEN starts_with(p, '/data/') THEN substr(p, 7) ELSE p END AS relative, CASE WHEN lower(suffix) IN ('.mp4', '.mov', '.avi', '.mkv', '.webm', '.m4v') THEN 'video' ELSE 'single_image' END AS mode FROM s""")
def _(t):
    path = F.regexp_replace("url", "^[a-z]+:/", "/data")
    return t.pages.select("page_id", tx.path_parts(path, "/data").alias("p")).select("page_id", "p.*")


@query("redact_secrets", r"""WITH t AS (SELECT event_id, 'Authorization: Bearer ' || props || ' api_key=' || k || '&token: t' || user_id || ' s3cr3t-' || event_type AS x FROM events_k)
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, 's3cr3t-view', '[REDACTED]'), '(?i)(Authorization:\s*Bearer\s+)[^\s]+', '\1[REDACTED]', 'g'), '(?i)(Bearer\s+)[^\s]+', '\1[REDACTED]', 'g'), '(?i)(api_key\s*[=:]\s*)[^\s&,}\]]+', '\1[REDACTED]', 'g'), '(?i)(token\s*[=:]\s*)[^\s&,}\]]+', '\1[REDACTED]', 'g') AS clean FROM t""")
def _(t):
    x = F.concat(F.lit("Authorization: Bearer "), c("props"), F.lit(" api_key="), c("k").cast("string"), F.lit("&token: t"), c("user_id").cast("string"), F.lit(" s3cr3t-"), c("event_type"))
    return t.events_k.select("event_id", tx.redact_secrets(x, ("s3cr3t-view",)).alias("clean"))


BBOX = ('[1, 2, {k}]', '{{"x": 1, "y": {k}, "z": 3}}', '{{"width": {k}, "height": 5, "depth": 6}}', '{{"size": [7, 8, {k}]}}', '[1, 2]', 'broken')


@query("coerce_bbox", "SELECT event_id, CASE k % 6 WHEN 0 THEN '1.0,2.0,' || k || '.0' WHEN 1 THEN '1.0,' || k || '.0,3.0' WHEN 2 THEN k || '.0,5.0,6.0' WHEN 3 THEN '7.0,8.0,' || k || '.0' END AS box FROM events_k")
def _(t):
    parts = [F.concat(*(p for i, x in enumerate(s.replace("{{", "{").replace("}}", "}").split("{k}")) for p in ([c("k").cast("string")] * (i > 0) + [F.lit(x)]))) for s in BBOX]
    box = tx.coerce_bbox(F.get(F.array(*parts), (c("k") % 6).cast("int")))
    return t.events_k.select("event_id", F.when(box.isNotNull(), F.array_join(box.cast("array<string>"), ",")).alias("box"))


@query("strip_unknown_fields", "SELECT event_id, k AS k, NULL::varchar AS name FROM events_k")
def _(t):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())])
    return t.events_k.select("event_id", tx.strip_unknown_fields(c("props"), schema).alias("s")).select("event_id", "s.k", "s.name")


@query("merge_precedence", "SELECT event_id, coalesce(CASE WHEN k % 5 = 0 THEN k END, CASE WHEN k % 3 = 0 THEN -k END, 0)::bigint AS poly, coalesce(CASE WHEN k % 2 = 0 THEN event_type END, 'raw_archive') AS profile, k % 4 > 0 AND k % 7 <> 1 AND k % 2 = 0 AS textured FROM events_k")
def _(t):
    k = c("k")
    merged = tx.merge_precedence({"poly": F.lit(0).cast("long"), "profile": F.lit("raw_archive")}, {"poly": F.when(k % 3 == 0, -k)}, {"poly": F.when(k % 5 == 0, k), "profile": F.when(k % 2 == 0, c("event_type"))})
    textured = tx.delivered_texture(k % 4, F.when(k % 7 == 1, F.lit(0)), k % 2 == 0)
    return t.events_k.select("event_id", *(v.alias(n) for n, v in merged.items()), textured.alias("textured"))


@query("provenance_steps", """WITH m AS (SELECT event_id, CASE WHEN k % 3 > 0 THEN 'm.obj' END AS mesh, CASE WHEN k % 2 = 0 THEN 't.png' END AS tex, CASE WHEN k % 5 = 0 THEN 'ok' END AS bl, CASE WHEN k % 7 = 0 THEN 'review' END AS op, CASE WHEN k % 4 = 0 THEN 'fail' END AS va FROM events_k)
SELECT event_id, 'reconstruction:' || CASE WHEN mesh IS NULL THEN 'failed' ELSE 'ok' END || CASE WHEN tex IS NULL THEN '' ELSE '|texturing:ok' END || coalesce('|blender_cleanup:' || bl, '') || coalesce('|gltf_optimization:' || op, '') || coalesce('|gltf_validation:' || va, '') AS steps FROM m""")
def _(t):
    k = c("k")
    manifest = {"mesh_path": F.when(k % 3 > 0, "m.obj"), "engine": F.lit("colmap"), "texture_path": F.when(k % 2 == 0, "t.png"), "texturing_engine": F.lit(None).cast("string"),
                "blender_cleanup": F.when(k % 5 == 0, "ok"), "gltf_optimization": F.when(k % 7 == 0, "review"), "gltf_validation": F.when(k % 4 == 0, "fail")}
    steps = F.transform(tx.provenance_steps(manifest), lambda s: F.concat_ws(":", s["step"], s["status"]))
    return t.events_k.select("event_id", F.array_join(steps, "|").alias("steps"))


@query("grade_rank", """WITH g AS (SELECT event_id, ['A', 'b', 'C', 'F', 'x'][1 + k % 5] AS g, ['pass', 'review', 'reshoot'][1 + k % 3] AS v, ['pass', 'review', 'reshoot', NULL][1 + k % 4] AS u FROM events_k)
SELECT event_id, CASE upper(g) WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 0 END::bigint AS rank, CASE upper(g) WHEN 'A' THEN 'A' WHEN 'B' THEN 'B' WHEN 'C' THEN 'C' ELSE 'F' END AS letter,
['pass', 'review', 'reshoot'][1 + greatest(list_position(['pass', 'review', 'reshoot'], v) - 1, coalesce(list_position(['pass', 'review', 'reshoot'], u) - 1, 0))] AS worst FROM g""")
def _(t):
    k = c("k")
    pick = lambda xs, n: F.get(F.array(*(F.lit(x).cast("string") for x in xs)), (k % n).cast("int"))
    rank = tx.grade_rank(pick(("A", "b", "C", "F", "x"), 5))
    worst = tx.worst_of(pick(("pass", "review", "reshoot"), 3), pick(("pass", "review", "reshoot", None), 4))
    return t.events_k.select("event_id", rank.alias("rank"), tx.grade_letter(rank).alias("letter"), worst.alias("worst"))


@query("ordered_distinct", """WITH x AS (SELECT event_id, [k % 3, k % 4, k % 5, k % 3, k % 2] AS l FROM events_k)
SELECT event_id, array_to_string([l[i] for i in range(1, 6) if list_position(l, l[i]) = i], ',') AS codes FROM x""")
def _(t):
    codes = F.array(*((c("k") % n).cast("string") for n in (3, 4, 5, 3, 2)))
    return t.events_k.select("event_id", F.array_join(tx.ordered_distinct(codes), ",").alias("codes"))
