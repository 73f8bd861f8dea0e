"""Queries of poses, pixels, masks and meshes."""

from pyspark.sql import functions as F

from orbitgrid.operators import mesh as op
from orbitgrid.plans.function_queries import CENTER, HSV
from orbitgrid.plans.registry import query

c = F.col
REL = f"""{CENTER}, rel AS (SELECT session_id, camera, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM cc WINDOW w AS (PARTITION BY session_id)),
ang AS (SELECT session_id, camera, degrees(atan2(y, x)) AS az, degrees(asin(greatest(-1, least(1, z / sqrt(x*x+y*y+z*z))))) AS el, degrees(atan2(z, sqrt(x*x+y*y))) AS pitch, ((degrees(atan2(y, x)) % 360) + 360) % 360 AS yaw FROM rel WHERE sqrt(x*x+y*y+z*z) >= 1e-9),
cell AS (SELECT session_id, CASE WHEN el < -15 THEN 0 WHEN el < 30 THEN 1 ELSE 2 END AS band, (floor(yaw / 45) % 8)::bigint AS sector, count(*) AS n FROM ang GROUP BY 1, 2, 3),
gp AS (SELECT session_id, yaw, coalesce(lead(yaw) OVER (PARTITION BY session_id ORDER BY yaw) - yaw, min(yaw) OVER (PARTITION BY session_id) + 360 - yaw) AS g FROM ang),
gap AS (SELECT session_id, CASE WHEN count(*) > 1 THEN max(g) ELSE 360 END AS max_gap FROM gp GROUP BY 1)"""


@query("circular_gaps", f"WITH {REL} SELECT session_id, R[max_gap] AS max_gap, R[360 - max_gap] AS span FROM gap")
def _(t):
    return op.circular_gaps(op._pose_angles(t.poses).withColumnRenamed("az", "angle"))


@query("pose_coverage_matrix", f"""WITH {REL} SELECT s.session_id, b.band::bigint AS band, k.sector::bigint AS sector, coalesce(n, 0)::bigint AS n FROM (SELECT DISTINCT session_id FROM poses) s CROSS JOIN (SELECT unnest(range(3)) AS band) b CROSS JOIN (SELECT unnest(range(8)) AS sector) k
LEFT JOIN cell ON cell.session_id = s.session_id AND cell.band = b.band AND cell.sector = k.sector""")
def _(t):
    return op.pose_coverage_matrix(t.poses)


@query("pose_coverage_summary", f"""WITH {REL}, sp AS (SELECT session_id, max(el) - min(el) AS e FROM ang GROUP BY 1), cv AS (SELECT session_id, count(*) AS k FROM cell GROUP BY 1)
SELECT session_id, k AS covered, R[k / 24] AS coverage_ratio, R[360 - max_gap] AS azimuth_span, R[e] AS elevation_spread FROM cv JOIN gap USING (session_id) JOIN sp USING (session_id)""")
def _(t):
    return op.pose_coverage_summary(t.poses)


@query("view_coverage", f"""WITH {REL}, a AS (SELECT session_id, count(DISTINCT floor(yaw / 45)) AS azimuth_buckets, count(DISTINCT least(4, floor((greatest(-30, least(90, pitch)) + 30) / 24))) AS elevation_buckets,
count(*) FILTER (pitch < 30) AS low, count(*) FILTER (pitch >= 30 AND pitch < 60) AS mid, count(*) FILTER (pitch >= 60) AS top FROM ang GROUP BY 1)
SELECT session_id, azimuth_buckets, elevation_buckets, low, mid, top, R[max_gap] AS max_gap, R[((low > 0)::int + (mid > 0)::int + (top > 0)::int) / 3.0] AS multi_height, R[(azimuth_buckets / 8 + elevation_buckets / 5) / 3] AS diversity FROM a JOIN gap USING (session_id)""")
def _(t):
    return op.view_coverage(t.poses)


@query("pixel_ratios", f"""WITH {HSV}, n AS (SELECT image, count(*) AS total, count(*) FILTER (a > 0) AS vis, count(*) FILTER (a > 0 AND v < 25) AS k1, count(*) FILTER (a > 0 AND v < 45) AS k2, count(*) FILTER (a > 0 AND v > 180 AND s < 60) AS k3,
count(*) FILTER (a > 0 AND s < 12 AND v > 35 AND v < 220) AS k4, count(*) FILTER (a > 0 AND h BETWEEN 5 AND 25 AND s > 50 AND v > 50) AS k5, count(*) FILTER (a > 0 AND s > 40 AND v > 40 AND v < 240) AS k6, count(*) FILTER (a > 0 AND s > 230 AND v > 150) AS k7,
count(*) FILTER (a > 0 AND ((r = 245 AND g = 245 AND b = 220) OR v = 0)) AS k8, avg(lum) FILTER (a > 0) AS lum FROM hsv GROUP BY image)
SELECT image, R[k1 / vis] AS black_ratio, R[k2 / vis] AS near_black_ratio, R[k3 / vis] AS near_white_ratio, R[k4 / vis] AS flat_ratio, R[k5 / vis] AS orange_ratio, R[k7 / vis] AS neon_ratio, R[k8 / vis] AS leakage_ratio,
R[greatest(k5 / vis, k6 / vis * 0.7::double)] AS background_ratio, R[vis / total] AS coverage_ratio, R[1 - vis / total] AS alpha_empty_ratio, R[lum / 255] AS luminance FROM n WHERE vis > 0""")
def _(t):
    return op.pixel_ratios(t.pixels)


@query("dominant_hue", f"""WITH {HSV}, n AS (SELECT image, h, count(*) AS c FROM hsv WHERE a > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY c DESC, h) AS rn, sum(c) OVER (PARTITION BY image) AS n FROM n)
SELECT image, h AS hue, R[c / n] AS ratio FROM r WHERE rn = 1""")
def _(t):
    return op.dominant_hue(t.pixels)


@query("color_profile", """WITH p AS (SELECT image AS session_id, x % 2 = 0 AS inside, y % 4 > 0 AS masked, r, g, b FROM pixels),
m AS (SELECT session_id, floor(median(r) FILTER (inside))::bigint AS pr, floor(median(g) FILTER (inside))::bigint AS pg, floor(median(b) FILTER (inside))::bigint AS pb, floor(median(r) FILTER (NOT inside))::bigint AS br, floor(median(g) FILTER (NOT inside))::bigint AS bg, floor(median(b) FILTER (NOT inside))::bigint AS bb, avg(masked::int) AS sh FROM p GROUP BY 1),
h AS (SELECT *, greatest(pr, pg, pb) AS v, CASE WHEN greatest(pr, pg, pb) = 0 THEN 0 ELSE floor(255.0::double * (greatest(pr, pg, pb) - least(pr, pg, pb)) / greatest(pr, pg, pb) + 0.5) END AS s FROM m)
SELECT session_id, pr, pg, pb, br, bg, bb, CASE WHEN v < 60 AND s < 60 THEN 'black' WHEN v < 120 AND s < 90 THEN 'dark' WHEN v > 205 AND s < 55 THEN 'white_cream' WHEN s > 105 THEN 'vibrant' ELSE 'mid' END AS class, R[least(1.0, 0.4 + 0.6 * sh)] AS confidence FROM h""")
def _(t):
    return op.color_profile(t.pixels.select(c("image").alias("session_id"), (c("x") % 2 == 0).alias("product"), (c("y") % 4 > 0).alias("masked"), "r", "g", "b"))


@query("pixel_sharpness", """WITH g AS (SELECT image, x, y, avg(0.299::double * r + 0.587::double * g + 0.114::double * b) AS v FROM pixels GROUP BY 1, 2, 3), e AS (SELECT image, max(x) AS mx, max(y) AS my FROM pixels GROUP BY 1),
s AS (SELECT * FROM (VALUES (0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)) s(dx, dy, k)),
n AS (SELECT g.image, g.x, g.y, k, CASE WHEN g.x + dx < 0 THEN -(g.x + dx) WHEN g.x + dx > mx THEN 2 * mx - (g.x + dx) ELSE g.x + dx END AS nx, CASE WHEN g.y + dy < 0 THEN -(g.y + dy) WHEN g.y + dy > my THEN 2 * my - (g.y + dy) ELSE g.y + dy END AS ny FROM g JOIN e USING (image), s),
l AS (SELECT n.image, n.x, n.y, sum(k * coalesce(o.v, 0)) AS lap FROM n LEFT JOIN g o ON o.image = n.image AND o.x = n.nx AND o.y = n.ny GROUP BY 1, 2, 3) SELECT image, round(var_pop(lap), 4) AS sharpness FROM l GROUP BY 1""")
def _(t):
    return op.pixel_sharpness(t.pixels).withColumn("sharpness", F.round("sharpness", 4))


@query("mask_stats", """WITH m AS (SELECT DISTINCT image, x, y FROM mask_pixels WHERE truth) SELECT image, R[count(*) / 4096] AS occupancy, R[(max(x) - min(x)) * (max(y) - min(y)) / 4096] AS bbox_area_ratio, R[avg(x) / 64] AS centroid_x, R[avg(y) / 64] AS centroid_y,
R[(max((y = 0)::int) + max((y = 63)::int) + max((x = 0)::int) + max((x = 63)::int)) / 4] AS border_touch FROM m GROUP BY 1""")
def _(t):
    return op.mask_stats(t.mask_pixels.filter("truth"), 64, 64)


@query("mask_iou_leakage", """WITH n AS (SELECT image, count(*) FILTER (truth AND predicted) AS b, count(*) FILTER (truth OR predicted) AS e, count(*) FILTER (predicted AND NOT truth) AS o, count(*) FILTER (truth) AS t, count(*) FILTER (predicted) AS p FROM mask_pixels GROUP BY 1)
SELECT image, R[coalesce(b / nullif(e, 0), 0)] AS iou, R[CASE WHEN t = 0 THEN (p > 0)::int ELSE o / t END] AS leakage FROM n""")
def _(t):
    return op.mask_iou_leakage(t.mask_pixels)


@query("mask_means", """WITH n AS (SELECT image, count(*) FILTER (truth AND predicted) AS b, count(*) FILTER (truth OR predicted) AS e, count(*) FILTER (predicted AND NOT truth) AS o, count(*) FILTER (truth) AS t, count(*) FILTER (predicted) AS p FROM mask_pixels GROUP BY 1)
SELECT count(*) AS sample_count, R[avg(coalesce(b / nullif(e, 0), 0))] AS avg_iou, R[avg(CASE WHEN t = 0 THEN (p > 0)::int ELSE o / t END)] AS avg_leakage FROM n""")
def _(t):
    return op.mask_means(op.mask_iou_leakage(t.mask_pixels))


STABLE = "SELECT session_id, frame_idx, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS method, CASE WHEN k % 11 = 0 THEN 0 ELSE area END AS area, cx, cy, aspect AS bcx, confidence AS bcy FROM frames"


@query("temporal_stability", f"""WITH m AS ({STABLE}), s AS (SELECT *, area > 0 AND lag(area) OVER w > 0 AS ok, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) AS cs, sqrt((bcx - lag(bcx) OVER w) ** 2 + (bcy - lag(bcy) OVER w) ** 2) AS bs FROM m WINDOW w AS (PARTITION BY session_id, method ORDER BY frame_idx))
SELECT session_id, method, R[stddev_pop(area)] AS area_std, R[coalesce(avg(cs) FILTER (ok), 0)] AS centroid_jitter, R[coalesce(avg(bs) FILTER (ok), 0)] AS bbox_jitter, count(*) FILTER (area <= 0) AS empty_masks, count(*) AS frames FROM s GROUP BY 1, 2""")
def _(t):
    k = c("k")
    return op.temporal_stability(t.frames.select("session_id", "frame_idx", F.when(k % 2 == 0, "a").otherwise("b").alias("method"), F.when(k % 11 == 0, 0.0).otherwise(c("area")).alias("area"), "cx", "cy", c("aspect").alias("bcx"), c("confidence").alias("bcy")))


@query("mesh_bounds", "SELECT mesh, R[min(x)] AS min_x, R[max(x)] AS max_x, R[min(y)] AS min_y, R[max(y)] AS max_y, R[min(z)] AS min_z, R[max(z)] AS max_z, R[-avg(x)] AS pivot_x, R[-avg(y)] AS pivot_y, R[-min(z)] AS pivot_z FROM vertices GROUP BY mesh")
def _(t):
    return op.mesh_bounds(t.vertices)


TRI = "tri AS (SELECT f.mesh, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, d.x AS cx, d.y AS cy, d.z AS cz FROM faces f JOIN vertices a ON a.mesh = f.mesh AND a.v = f.v0 JOIN vertices b ON b.mesh = f.mesh AND b.v = f.v1 JOIN vertices d ON d.mesh = f.mesh AND d.v = f.v2)"
AREA = "sqrt(((by_-ay)*(cz-az)-(bz-az)*(cy-ay))**2 + ((bz-az)*(cx-ax)-(bx-ax)*(cz-az))**2 + ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))**2) / 2"


@query("mesh_metrics", f"""WITH {TRI}, f AS (SELECT mesh, count(*) AS faces, count(*) FILTER ({AREA} < 1e-12) AS degenerate_faces FROM tri GROUP BY 1), d AS (SELECT mesh, v % 3 AS g, count(*) AS n, count(DISTINCT (round(x, 6), round(y, 6), round(z, 6))) AS k FROM vertices GROUP BY 1, 2), v AS (SELECT mesh, sum(n)::bigint AS vertices, sum(n - k)::bigint AS duplicate_vertices, count(*) AS geometries FROM d GROUP BY 1)
SELECT mesh, vertices, duplicate_vertices, geometries, coalesce(faces, 0) AS faces, coalesce(degenerate_faces, 0) AS degenerate_faces FROM v LEFT JOIN f USING (mesh)""")
def _(t):
    return op.mesh_metrics(t.vertices.withColumn("geometry", c("v") % 3), t.faces)


FE = "fe AS (SELECT mesh, least(v0, v1) AS p, greatest(v0, v1) AS q FROM faces UNION ALL SELECT mesh, least(v1, v2), greatest(v1, v2) FROM faces UNION ALL SELECT mesh, least(v0, v2), greatest(v0, v2) FROM faces)"


@query("edge_manifold", f"""WITH {FE}, n AS (SELECT mesh, p, q, count(*) AS n FROM fe GROUP BY 1, 2, 3) SELECT mesh, count(*) AS edges, count(*) FILTER (n = 1) AS boundary, count(*) FILTER (n > 2) AS non_manifold, R[1 - count(*) FILTER (n > 2) / count(*)] AS manifold_ratio FROM n GROUP BY 1""")
def _(t):
    return op.edge_manifold(t.faces)


@query("edge_aspect_stats", f"""WITH {FE}, {TRI}, u AS (SELECT DISTINCT mesh, p, q FROM fe), l AS (SELECT u.mesh, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS l FROM u JOIN vertices a ON a.mesh = u.mesh AND a.v = u.p JOIN vertices b ON b.mesh = u.mesh AND b.v = u.q),
e AS (SELECT mesh, quantile_cont(l, 0.5) AS p50, quantile_cont(l, 0.99) AS p99, CASE WHEN avg(l) > 1e-12 THEN stddev_pop(l) / avg(l) ELSE 0 END AS cv FROM l GROUP BY 1),
s AS (SELECT mesh, sqrt((ax-bx)**2 + (ay-by_)**2 + (az-bz)**2) AS l1, sqrt((bx-cx)**2 + (by_-cy)**2 + (bz-cz)**2) AS l2, sqrt((cx-ax)**2 + (cy-ay)**2 + (cz-az)**2) AS l3 FROM tri),
a AS (SELECT mesh, quantile_cont(greatest(l1, l2, l3) / least(l1, l2, l3), 0.5) AS a50, quantile_cont(greatest(l1, l2, l3) / least(l1, l2, l3), 0.99) AS a99 FROM s WHERE least(l1, l2, l3) > 1e-9 GROUP BY 1)
SELECT mesh, R[p50] AS edge_p50, R[p99] AS edge_p99, R[cv] AS edge_cv, R[a50] AS aspect_p50, R[a99] AS aspect_p99 FROM e LEFT JOIN a USING (mesh)""")
def _(t):
    return op.edge_aspect_stats(t.vertices, t.faces)


#: Each round gives every node the least label of its neighbours.
LABELS = """e AS (SELECT DISTINCT a, b FROM edges UNION SELECT b, a FROM edges),
l(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM e GROUP BY a UNION SELECT e.b, min(l.component) FROM l JOIN e ON e.a = l.node JOIN recurring.l AS r ON r.node = e.b WHERE l.component < r.component GROUP BY e.b)"""


@query("connected_components", f"WITH RECURSIVE {LABELS} SELECT node, component, count(*) OVER (PARTITION BY component) AS nodes FROM l")
def _(t):
    return op.sized(op.connected_components(t.edges))


@query("largest_component_share", f"""WITH RECURSIVE {LABELS}, c AS (SELECT l_suppkey AS mesh, component, count(*) AS n FROM lineitem JOIN l ON node = l_partkey * 2 GROUP BY 1, 2)
SELECT mesh, count(*) AS components, R[max(n) / sum(n)] AS share FROM c GROUP BY 1""")
def _(t):
    elements = t.lineitem.select(c("l_suppkey").alias("mesh"), (c("l_partkey") * 2).alias("node"))
    return op.largest_share(op.connected_components(t.edges), elements)


@query("component_selection", """WITH a AS (SELECT session_id, idx, registered / 50e0 AS score, points AS faces FROM attempts), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, idx) AS rb, row_number() OVER (PARTITION BY session_id ORDER BY faces DESC, score DESC, idx) AS rl, sum(faces) OVER (PARTITION BY session_id) AS total FROM a),
b AS (SELECT session_id, max(total) AS total, max(idx) FILTER (rb = 1) AS bi, max(score) FILTER (rb = 1) AS bs, max(faces) FILTER (rb = 1) AS bf, max(idx) FILTER (rl = 1) AS li, max(score) FILTER (rl = 1) AS ls, max(faces) FILTER (rl = 1) AS lf FROM r GROUP BY 1),
p AS (SELECT session_id, CASE WHEN sw THEN li ELSE bi END AS i, CASE WHEN sw THEN ls ELSE bs END AS s, CASE WHEN sw THEN lf ELSE bf END AS f FROM (SELECT *, bf < 0.05 * total AND lf > 10 * bf AND ls > 0.40 AS sw FROM b))
SELECT session_id, idx, R[score] AS score, faces, CASE WHEN idx = i THEN 'kept_primary' WHEN score > 0.75::double * s AND faces > 0.05::double * f THEN 'kept' ELSE 'rejected_low_score' END AS decision FROM a JOIN p USING (session_id)""")
def _(t):
    return op.component_selection(t.attempts.select("session_id", "idx", (c("registered") / 50.0).alias("score"), c("points").alias("faces")))


@query("horizontal_plane_faces", """WITH f AS (SELECT mesh, v0, v1, v2, CASE WHEN v1 % 3 > 0 THEN 1.0 ELSE 0.5 END AS nz, (v2 % 100) / 1e3 AS cz FROM faces),
s1 AS (SELECT mesh, count(*) AS n, count(*) FILTER (nz > 0.92) AS fn, min(cz) FILTER (nz > 0.92) AS lo, max(cz) FILTER (nz > 0.92) AS hi FROM f GROUP BY 1),
p1 AS (SELECT f.*, n, nz > 0.92 AND fn >= greatest(20, floor(0.05 * n)) AND abs(cz - (lo + hi) / 2) <= greatest(0.01, 0.03 * (hi - lo)) AS pl FROM f JOIN s1 USING (mesh)),
t1 AS (SELECT *, pl AND count(*) FILTER (pl) OVER (PARTITION BY mesh) >= greatest(30, floor(0.08 * n)) AS take1 FROM p1),
q1 AS (SELECT *, bool_or(take1) OVER (PARTITION BY mesh) AS went FROM t1),
s2 AS (SELECT mesh, count(*) AS n2, count(*) FILTER (nz > 0.92) AS fn2, min(cz) FILTER (nz > 0.92) AS lo2, max(cz) FILTER (nz > 0.92) AS hi2 FROM q1 WHERE NOT take1 AND went GROUP BY 1),
p2 AS (SELECT q1.*, n2, coalesce(went AND NOT take1 AND nz > 0.92 AND fn2 >= greatest(20, floor(0.05 * n2)) AND abs(cz - (lo2 + hi2) / 2) <= greatest(0.01, 0.03 * (hi2 - lo2)), false) AS pl2 FROM q1 LEFT JOIN s2 USING (mesh)),
t2 AS (SELECT *, pl2 AND count(*) FILTER (pl2) OVER (PARTITION BY mesh) >= greatest(30, floor(0.08 * n2)) AS take2 FROM p2)
SELECT mesh, count(*) FILTER (take1) AS first_round, count(*) FILTER (take2) AS second_round, count(*) AS faces FROM t2 GROUP BY 1""")
def _(t):
    faces = t.faces.withColumns({"nz": F.when(c("v1") % 3 > 0, 1.0).otherwise(0.5), "cz": (c("v2") % 100) / 1000})
    out = op.horizontal_plane_faces(faces)
    return out.groupBy("mesh").agg(F.count_if(c("removed_in") == 1).alias("first_round"), F.count_if(c("removed_in") == 2).alias("second_round"), F.count("*").alias("faces"))


@query("chromatic_components", """WITH p AS (SELECT image AS mesh, y % 4 AS component, r, g, b, 400 + image % 3 * 100 AS faces FROM pixels), q AS (SELECT mesh, component, avg((greatest(abs(r - 120), abs(g - 120), abs(b - 40)) <= 60)::int) AS ratio, max(faces) AS faces FROM p GROUP BY 1, 2)
SELECT mesh, component, R[ratio] AS ratio, faces, (faces < 500 AND ratio > 0.40) OR ratio > 0.75 AS prune FROM q""")
def _(t):
    colors = t.pixels.select(c("image").alias("mesh"), (c("y") % 4).alias("component"), "r", "g", "b", (400 + c("image") % 3 * 100).alias("faces"))
    return op.chromatic_components(colors, (120, 120, 40), 60)


@query("nearest_point_support", """WITH e AS (SELECT * FROM cloud WHERE vec_id % 2 = 0), p AS (SELECT * FROM cloud WHERE vec_id % 2 = 1), s AS (SELECT e.job, e.vec_id, min((e.x-p.x)**2 + (e.y-p.y)**2 + (e.z-p.z)**2) AS d FROM e LEFT JOIN p USING (job) GROUP BY 1, 2)
SELECT job, vec_id % 5 AS component, count(*) FILTER (d < 0.05 * 0.05) AS supported, count(*) AS total, R[count(*) FILTER (d < 0.05 * 0.05) / count(*)] AS ratio FROM s GROUP BY 1, 2""")
def _(t):
    elements = t.cloud.filter("vec_id % 2 = 0").select("job", c("vec_id").alias("element"), (c("vec_id") % 5).alias("component"), "x", "y", "z")
    return op.nearest_point_support(elements, t.cloud.filter("vec_id % 2 = 1"))


@query("view_mask_support", """WITH p AS (SELECT job, vec_id % 3 AS component, x, y, z FROM cloud), k AS (SELECT unnest(range(6)) AS camera), s AS (SELECT job, component, camera, floor((40 * x + camera) / (z + 1.5) + 16)::bigint AS px, floor(40 * y / (z + 1.5) + 16)::bigint AS py FROM p, k WHERE z + 1.5 > 0.01),
v AS (SELECT job, component, camera, count(*) AS vis, count(*) FILTER ((px * 7 + py * 3 + camera) % 5 < 3) AS lit FROM s WHERE px BETWEEN 0 AND 31 AND py BETWEEN 0 AND 31 GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT job, component, R[avg(lit / vis)] AS avg_support, R[median(lit / vis)] AS median_support, R[sum(lit) / sum(vis)] AS hit_ratio, count(*) FILTER (lit / vis > 0.5) AS views FROM v GROUP BY 1, 2""")
def _(t):
    points = t.cloud.select("job", c("vec_id").alias("element"), (c("vec_id") % 3).alias("component"), "x", "y", "z")
    jobs = t.cloud.select("job").distinct()
    row = lambda *xs: F.array(*(x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in xs))
    camera = c("camera").cast("double")
    cameras = jobs.withColumn("camera", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).select(
        "job", "camera", row(40, 0, 16, camera + 24).alias("p0"), row(0, 40, 16, 24).alias("p1"), row(0, 0, 1, 1.5).alias("p2"), F.lit(32).alias("width"), F.lit(32).alias("height"))
    span = F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))
    masks = cameras.select("job", "camera", F.explode(span).alias("px")).select("*", F.explode(span).alias("py"))
    lit = (c("px") * 7 + c("py") * 3 + c("camera")) % 5 < 3
    return op.view_mask_support(points, cameras, masks.withColumn("value", F.when(lit, 255).otherwise(0)), n=None, min_visible=2)


@query("normalization_audit", """WITH s AS (SELECT mesh, x * CASE mesh % 4 WHEN 0 THEN 1e-5 WHEN 1 THEN 1e3 ELSE 1 END AS x, y * CASE mesh % 4 WHEN 0 THEN 1e-5 WHEN 1 THEN 1e3 ELSE 1 END AS y, CASE WHEN mesh % 7 = 0 THEN NULL ELSE z * CASE mesh % 4 WHEN 0 THEN 1e-5 WHEN 1 THEN 1e3 ELSE 1 END END AS z FROM vertices),
b AS (SELECT mesh, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM s GROUP BY 1), d AS (SELECT mesh, hx - lx AS dx, hy - ly AS dy, hz - lz AS dz, greatest(hx - lx, hy - ly, hz - lz) AS largest, sqrt(((hx + lx) / 2) ** 2 + ((hy + ly) / 2) ** 2 + ((hz + lz) / 2) ** 2) AS cd, ly FROM b)
SELECT mesh, R[dx] AS dx, R[dy] AS dy, R[dz] AS dz, R[largest] AS largest, CASE WHEN dx = largest THEN 'x' WHEN dy = largest THEN 'y' ELSE 'z' END AS largest_axis, R[cd] AS center_distance, R[ly] AS ground_offset, abs(ly) < 0.05 AS flat_on_ground,
CASE WHEN largest < 0.001 THEN 'model_too_small' WHEN largest > 1000 THEN 'model_too_large' ELSE '' END AS issues, array_to_string(list_filter([CASE WHEN cd > 1 THEN 'model_not_centered' END, CASE WHEN abs(ly) >= 0.05 THEN 'ground_alignment_uncertain' END], lambda x: x IS NOT NULL), ',') AS warnings FROM d""")
def _(t):
    k = F.when(c("mesh") % 4 == 0, 1e-5).when(c("mesh") % 4 == 1, 1e3).otherwise(1.0)
    scaled = t.vertices.select("mesh", *((c(a) * k).alias(a) for a in "xy"), F.when(c("mesh") % 7 != 0, c("z") * k).alias("z"))
    out = op.normalization_audit(scaled).select("mesh", "dx", "dy", "dz", "largest", "largest_axis", "center_distance", "ground_offset", "flat_on_ground", "issues", "warnings")
    return out.withColumns({x: F.array_join(x, ",") for x in ("issues", "warnings")})
