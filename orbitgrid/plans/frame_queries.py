"""Queries of frame sequences."""

from pyspark.sql import functions as F

from orbitgrid.operators import frames as op
from orbitgrid.plans.registry import query

STATS = """s1 AS (SELECT *, median(sharpness) OVER (PARTITION BY session_id) AS med FROM frames),
s2 AS (SELECT *, median(abs(sharpness - med)) OVER (PARTITION BY session_id) AS mad FROM s1),
st AS (SELECT *, CASE WHEN mad < 1e-9 THEN 0.0 ELSE 0.6745 * (sharpness - med) / mad END AS z FROM s2)"""
NORM = """nx AS (SELECT *, CASE WHEN max(cx) OVER (PARTITION BY session_id) > 1.5 THEN cx / max(cx) OVER (PARTITION BY session_id) ELSE cx END AS x FROM frames),
stp AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY session_id ORDER BY frame_idx)) AS step FROM nx)"""
JUMPS = """jd AS (SELECT session_id, round(sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2), 12) AS d FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx)),
j AS (SELECT session_id, count(*) FILTER (d > 0.15) AS jumps, count(*) FILTER (d > 0.15) / greatest(1, count(*) - 1) AS jump_ratio FROM jd GROUP BY session_id)"""


@query("blur_stats", f"WITH {STATS} SELECT session_id, frame_idx, R[med] AS median, R[mad] AS mad, R[z] AS z FROM st")
def _(t):
    return op.blur_stats(t.frames).select("session_id", "frame_idx", "median", "mad", "z")


@query("blur_bursts", f"""WITH {STATS},
f AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n_all, frame_idx - row_number() OVER (PARTITION BY session_id, z < -1.5 ORDER BY frame_idx) AS g FROM st),
b AS (SELECT session_id, g, min(frame_idx) AS start_index, max(frame_idx) AS end_index, count(*) AS n, median(sharpness) AS m, max(n_all) AS n_all FROM f WHERE z < -1.5 GROUP BY session_id, g HAVING count(*) >= 3)
SELECT session_id, start_index, end_index, n, R[m] AS median_score, R[sum(n) OVER (PARTITION BY session_id) / n_all] AS burst_ratio FROM b""")
def _(t):
    return op.blur_bursts(t.frames)


@query("elevation_distribution", """WITH c AS (SELECT session_id, count(*) FILTER (cy < 0.40) AS low, count(*) FILTER (cy >= 0.40 AND cy <= 0.65) AS mid, count(*) FILTER (cy > 0.65) AS top, count(*) AS n FROM frames GROUP BY 1)
SELECT session_id, low, mid, top, R[low / n] AS low_ratio, R[mid / n] AS mid_ratio, R[top / n] AS top_ratio, R[((low > 0)::int + (mid > 0)::int + (top > 0)::int) / 3.0] AS multi_height_score FROM c""")
def _(t):
    return op.elevation_distribution(t.frames)


@query("orbit_progress", f"WITH {NORM} SELECT session_id, R[least(1.0, coalesce(sum(step), 0))] AS progress FROM stp GROUP BY session_id")
def _(t):
    return op.orbit_progress(t.frames)


@query("sign_changes", f"""WITH {NORM}, sg AS (SELECT session_id, frame_idx, sign(round(x - avg(x) OVER (PARTITION BY session_id), 12)) AS s FROM nx),
c AS (SELECT session_id, s <> lag(s) OVER (PARTITION BY session_id ORDER BY frame_idx) AS turn FROM sg), n AS (SELECT session_id, count(*) FILTER (turn) AS changes FROM c GROUP BY 1)
SELECT session_id, changes, least(8, greatest(1, changes + 1))::bigint AS buckets_filled, R[least(8, greatest(1, changes + 1)) / 8] AS coverage_ratio FROM n""")
def _(t):
    return op.sign_changes(t.frames)


@query("static_runs", f"""WITH {NORM}, f AS (SELECT session_id, frame_idx - row_number() OVER (PARTITION BY session_id, step < 0.01 ORDER BY frame_idx) AS g, step FROM stp WHERE step IS NOT NULL),
r AS (SELECT session_id, g, count(*) AS n FROM f WHERE step < 0.01 GROUP BY 1, 2)
SELECT s.session_id, coalesce(max(r.n), 0)::bigint AS longest FROM (SELECT DISTINCT session_id FROM frames) s LEFT JOIN r USING (session_id) GROUP BY 1""")
def _(t):
    return op.static_runs(t.frames)


@query("sequence_jumps", f"WITH {JUMPS} SELECT session_id, jumps, R[jump_ratio] AS jump_ratio, jump_ratio > 0.2 AS weak FROM j")
def _(t):
    return op.sequence_jumps(t.frames)


ORBIT = f"""{JUMPS}, u AS (SELECT DISTINCT session_id, cx FROM frames), p AS (SELECT session_id, cx, lead(cx) OVER (PARTITION BY session_id ORDER BY cx) AS nx FROM u),
q AS (SELECT session_id, cx, round(nx - cx, 12) AS g, round((nx + cx) / 2, 12) AS mid FROM p),
a AS (SELECT session_id, max(cx) - min(cx) AS span, coalesce(max(g), 0) AS gap, count(*) FILTER (g > 0.25) AS n, count(*) FILTER (g > 0.25 AND mid < 0.3) AS l, count(*) FILTER (g > 0.25 AND mid > 0.7) AS r, count(*) FILTER (g > 0.25 AND mid BETWEEN 0.3 AND 0.7) AS c FROM q GROUP BY 1),
orbit AS (SELECT session_id, span, gap, jump_ratio, CASE WHEN n > 2 THEN ['LOW_HORIZONTAL_COVERAGE'] ELSE list_filter([CASE WHEN l > 0 THEN 'ORBIT_GAP_LEFT' END, CASE WHEN r > 0 THEN 'ORBIT_GAP_RIGHT' END, CASE WHEN c > 0 THEN 'LOW_HORIZONTAL_COVERAGE' END], lambda x: x IS NOT NULL) END AS hard,
list_filter([CASE WHEN round(span, 12) < 0.25 THEN 'INSUFFICIENT_VIEWPOINT_SPREAD' END, CASE WHEN jump_ratio > 0.2 THEN 'WEAK_ORBIT_CONTINUITY' END], lambda x: x IS NOT NULL) AS soft FROM a JOIN j USING (session_id))"""


@query("geometric_orbit", f"WITH {ORBIT} SELECT session_id, R[span] AS span_x, R[gap] AS max_gap, R[jump_ratio] AS jump_ratio, array_to_string(hard, ',') AS hard_codes, array_to_string(soft, ',') AS soft_codes FROM orbit")
def _(t):
    return op.geometric_orbit(t.frames).withColumns({c: F.array_join(c, ",") for c in ("hard_codes", "soft_codes")})


@query("temporal_zscore", "SELECT session_id, frame_idx, " + ", ".join(
    f"R[CASE WHEN stddev_pop({c}) OVER w > 0.001 THEN abs({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END] AS {c}_z" for c in ("area", "aspect", "cx", "cy")) + " FROM frames WINDOW w AS (PARTITION BY session_id)")
def _(t):
    return op.temporal_zscore(t.frames, ("area", "aspect", "cx", "cy")).select("session_id", "frame_idx", "area_z", "aspect_z", "cx_z", "cy_z")


VERDICT = "CASE WHEN frame_idx % 15 <> 0 THEN 'sampling' WHEN sharpness < 2 THEN 'quality_or_mask' WHEN cx > 0.8 THEN 'redundant_similarity' ELSE 'kept' END"


@query("rejection_counts", f"""SELECT session_id, count(*) FILTER (v = 'kept') AS kept, count(*) FILTER (v = 'quality_or_mask') AS quality_or_mask, count(*) FILTER (v = 'redundant_similarity') AS redundant_similarity,
count(*) FILTER (v = 'sampling') AS sampling FROM (SELECT session_id, {VERDICT} AS v FROM frames) GROUP BY 1""")
def _(t):
    return op.rejection_counts(t.frames.withColumn("verdict", F.expr(VERDICT)), ("kept", "quality_or_mask", "redundant_similarity", "sampling"))


SAMPLED = """rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_idx) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM frames),
es AS (SELECT * FROM rk WHERE n <= 10 OR r IN (SELECT unnest([(i * rk.n) // 10 for i in range(10)])))"""


@query("even_sample", f"WITH {SAMPLED} SELECT session_id, frame_idx FROM es")
def _(t):
    return op.even_sample(t.frames, "session_id", "frame_idx").select("session_id", "frame_idx")


@query("shape_mismatch", f"""WITH {SAMPLED}, sh AS (SELECT session_id, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 5 = 0 THEN 720 ELSE 1080 END AS h, count(*) AS c FROM es GROUP BY 1, 2)
SELECT session_id, coalesce(sum(c) FILTER (h IS NULL), 0)::bigint AS missing, coalesce(sum(c) FILTER (h IS NOT NULL) - max(c) FILTER (h IS NOT NULL), 0)::bigint AS mismatch,
R[coalesce((sum(c) FILTER (h IS NOT NULL) - max(c) FILTER (h IS NOT NULL)) / sum(c) FILTER (h IS NOT NULL), 0)] AS mismatch_ratio FROM sh GROUP BY 1""")
def _(t):
    h = F.when(F.col("k") % 17 == 0, None).when(F.col("k") % 5 == 0, 720).otherwise(1080)
    return op.shape_mismatch(t.frames.withColumns({"h": h, "w": h}))


@query("extraction_summary", """WITH f AS (SELECT *, sharpness >= 2 AS ok FROM frames), g AS (SELECT *, CASE WHEN ok THEN frame_idx - lag(frame_idx) OVER (PARTITION BY session_id, ok ORDER BY frame_idx) END AS gap FROM f)
SELECT session_id, count(*) FILTER (ok) AS selected, count(*) FILTER (NOT ok) AS rejected, R[coalesce(avg(sharpness) FILTER (ok), 0)] AS mean_sharpness, coalesce(max(gap), 0) AS max_gap FROM g GROUP BY 1""")
def _(t):
    return op.extraction_summary(t.frames.withColumn("accepted", F.col("sharpness") >= 2))


@query("stride_sample", "SELECT session_id, frame_idx FROM frames WHERE frame_idx % 15 = 0")
def _(t):
    return op.stride_sample(t.frames).select("session_id", "frame_idx")


@query("topk_sharp_frames", """WITH n AS (SELECT *, greatest(15, count(*) OVER (PARTITION BY session_id) // 15) AS step FROM frames),
r AS (SELECT session_id, frame_idx, row_number() OVER (PARTITION BY session_id ORDER BY sharpness DESC, frame_idx) AS sharp_rank FROM n WHERE frame_idx % step = 0) SELECT session_id, frame_idx, sharp_rank FROM r WHERE sharp_rank <= 5""")
def _(t):
    return op.topk_sharp_frames(t.frames).select("session_id", "frame_idx", "sharp_rank")


@query("best_frame", """WITH n AS (SELECT *, sharpness + area AS score, greatest(1, count(*) OVER (PARTITION BY session_id) // 11) AS step FROM frames),
r AS (SELECT session_id, frame_idx, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, frame_idx) AS rn FROM n WHERE frame_idx % step = 0 AND frame_idx > 0 AND frame_idx <= 10 * step)
SELECT session_id, frame_idx, R[score] AS score FROM r WHERE rn = 1""")
def _(t):
    return op.best_frame(t.frames.withColumn("score", F.col("sharpness") + F.col("area")))


BUCKET = "CASE WHEN k % 9 = 0 THEN 'unknown' WHEN cy < 0.40 THEN 'low' WHEN cy > 0.65 THEN 'top' ELSE 'mid' END"
BALANCED = f"""bq AS (SELECT *, {BUCKET} AS bucket, sharpness * greatest(confidence, 0.1) AS quality FROM frames),
br AS (SELECT *, row_number() OVER (PARTITION BY session_id, bucket ORDER BY quality DESC, frame_idx) AS r, CASE bucket WHEN 'low' THEN 6 WHEN 'mid' THEN 10 WHEN 'top' THEN 6 ELSE 0 END AS least_n, CASE bucket WHEN 'low' THEN 1 WHEN 'mid' THEN 2 WHEN 'top' THEN 3 ELSE 4 END AS bo FROM bq),
bs AS (SELECT *, 30 - count(*) FILTER (r <= least_n) OVER (PARTITION BY session_id) AS slots, r > least_n AND (bucket = 'unknown' OR r <= 16) AS ok FROM br),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, ok ORDER BY quality DESC, bo, frame_idx) AS a FROM bs) WHERE r <= least_n OR (ok AND a <= slots))"""


@query("balanced_selection", f"WITH {BALANCED} SELECT session_id, frame_idx, bucket, R[quality] AS quality FROM bk")
def _(t):
    return op.balanced_selection(t.frames.withColumn("bucket", F.expr(BUCKET)), total=30).select("session_id", "frame_idx", "bucket", "quality")


@query("selection_diff", f"WITH {BALANCED} SELECT session_id, frame_idx FROM frames EXCEPT SELECT session_id, frame_idx FROM bk")
def _(t):
    frames = t.frames.withColumn("bucket", F.expr(BUCKET))
    return op.selection_diff(frames, op.balanced_selection(frames, total=30)).select("session_id", "frame_idx")


@query("texture_budget", """WITH f AS (SELECT *, sharpness > 2 AND session_id % 5 <> 0 AS ok FROM frames), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, ok ORDER BY confidence DESC, frame_idx) AS tp,
row_number() OVER (PARTITION BY session_id ORDER BY sharpness DESC, frame_idx) AS sp, bool_or(ok) OVER (PARTITION BY session_id) AS anyok FROM f),
s AS (SELECT *, CASE WHEN anyok THEN ok AND tp <= 20 ELSE sp <= 5 END AS taken FROM r)
SELECT session_id, frame_idx, taken AS selected, CASE WHEN ok AND NOT taken THEN 'budget_limit' WHEN NOT anyok AND taken THEN 'fallback' END AS budget_reason FROM s""")
def _(t):
    frames = t.frames.withColumns({"accepted": (F.col("sharpness") > 2) & (F.col("session_id") % 5 != 0), "ranking_score": F.col("confidence")})
    return op.texture_budget(frames).select("session_id", "frame_idx", "selected", "budget_reason")
