"""Meshes, point clouds, poses and pixels as tables of elements.

Counts and ratios are plain aggregates with partial sums before each shuffle, so a huge mesh
or image does not gather in one task. Neighbour search goes over a grid, components over the
edge table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitgrid.functions.geometry import angle_bins, color_class, quat_camera_center, rgb_to_hsv, spherical_angles, yaw_pitch
from orbitgrid.operators.asset_rules import codes
from orbitgrid.sources.checkpoints import materialize


def camera_centers(poses: DataFrame, key: str = "session_id") -> DataFrame:
    """Camera centres with rx, ry, rz relative to the mean of their session's centres."""
    c = poses.withColumn("__c", quat_camera_center(F.col("qvec"), F.col("tvec"))).select("*", "__c.x", "__c.y", "__c.z").drop("__c")
    mean = c.groupBy(key).agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"))
    return c.join(mean, key).withColumns({f"r{a}": F.col(a) - F.col(f"m{a}") for a in "xyz"}).drop("mx", "my", "mz")


def circular_gaps(angles: DataFrame, key: str = "session_id", col: str = "angle", single: float = 360.0) -> DataFrame:
    """Largest gap between sorted angles modulo 360 with wrap-around, and the span 360 - gap; a single angle has gap `single`."""
    a = F.pmod(F.col(col), F.lit(360.0))
    w = Window.partitionBy(key).orderBy("a")
    first = F.min("a").over(Window.partitionBy(key))
    gaps = angles.select(key, a.alias("a")).withColumn("g", F.coalesce(F.lead("a").over(w) - F.col("a"), first + 360 - F.col("a")))
    out = gaps.groupBy(key).agg(F.when(F.count("*") > 1, F.max("g")).otherwise(F.lit(single)).alias("max_gap"))
    return out.withColumn("span", 360 - F.col("max_gap"))


def _pose_angles(poses: DataFrame) -> DataFrame:
    rel = camera_centers(poses)
    return rel.withColumn("s", spherical_angles(F.col("rx"), F.col("ry"), F.col("rz"))).filter(F.col("s.r") >= 1e-9).select("session_id", "camera", "s.az", "s.el")


def pose_coverage_matrix(poses: DataFrame) -> DataFrame:
    """All 3 x 8 cells of elevation bands and azimuth sectors with their camera counts."""
    at = _pose_angles(poses).withColumn("b", angle_bins(F.col("az"), F.col("el"))).groupBy("session_id", "b.band", "b.sector").agg(F.count("*").alias("n"))
    grid = poses.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("band"))
    grid = grid.select("session_id", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("sector"))
    return grid.join(at, ["session_id", "band", "sector"], "left").na.fill(0, ["n"])


def pose_coverage_summary(poses: DataFrame) -> DataFrame:
    """Covered cells, coverage ratio, azimuth span and elevation spread of each session, from one pass over its angles."""
    w = Window.partitionBy("session_id").orderBy("a")
    first = F.min("a").over(Window.partitionBy("session_id"))
    at = _pose_angles(poses).withColumn("b", angle_bins(F.col("az"), F.col("el"))).withColumn("a", F.pmod("az", F.lit(360.0)))
    rows = at.withColumn("g", F.coalesce(F.lead("a").over(w) - F.col("a"), first + 360 - F.col("a")))
    out = rows.groupBy("session_id").agg(
        F.size(F.collect_set(F.col("b.band") * 8 + F.col("b.sector"))).cast("long").alias("covered"),  # 24 values at most
        F.when(F.count("*") > 1, 360 - F.max("g")).otherwise(0.0).alias("azimuth_span"), (F.max("el") - F.min("el")).alias("elevation_spread"),
    )
    out = poses.select("session_id").distinct().join(out, "session_id", "left").na.fill(0, ["covered"]).na.fill(0.0, ["azimuth_span", "elevation_spread"])
    return out.select("session_id", "covered", (F.col("covered") / 24).alias("coverage_ratio"), "azimuth_span", "elevation_spread")


def view_coverage(poses: DataFrame, buckets: int = 8, low: float = -30.0, high: float = 90.0, levels: int = 5, observed: Column | None = None) -> DataFrame:
    """Azimuth and elevation buckets filled, height bands (below 30, below 60, above), largest gap, view diversity."""
    rel = camera_centers(poses).withColumn("v", yaw_pitch(F.col("rx"), F.col("ry"), F.col("rz"))).filter("v is not null").select("session_id", "v.yaw", "v.pitch")
    at = F.floor(F.col("yaw") / (360.0 / buckets))
    level = F.least(F.lit(levels - 1), F.floor((F.greatest(F.lit(low), F.least(F.lit(high), F.col("pitch"))) - low) / ((high - low) / levels)))
    p = F.col("pitch")
    agg = rel.groupBy("session_id").agg(
        F.count_distinct(at).alias("azimuth_buckets"), F.count_distinct(level).alias("elevation_buckets"),
        F.count_if(p < 30).alias("low"), F.count_if((p >= 30) & (p < 60)).alias("mid"), F.count_if(p >= 60).alias("top"),
    )
    gap = circular_gaps(rel.withColumnRenamed("yaw", "angle")).select("session_id", "max_gap")
    parts = [F.col("azimuth_buckets") / buckets, F.col("elevation_buckets") / levels, F.lit(0.0) if observed is None else observed]
    heights = sum((F.col(b) > 0).cast("int") for b in ("low", "mid", "top")) / 3.0
    return agg.join(gap, "session_id").withColumns({"multi_height": heights, "diversity": sum(F.greatest(x, F.lit(0.0)) for x in parts) / 3.0})


def pixel_ratios(pixels: DataFrame, colorful: bool = False) -> DataFrame:
    """Shares of an image's visible pixels (alpha > 0) by colour, and coverage of the whole image."""
    hsv = rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    p = pixels.withColumn("hsv", hsv).select("*", "hsv.*").withColumns({"vis": F.col("a") > 0, "top": F.greatest("r", "g", "b")})
    h, s, v, vis = F.col("h"), F.col("s"), F.col("v"), F.col("vis")
    leak = ((F.col("r") == 245) & (F.col("g") == 245) & (F.col("b") == 220)) | (F.col("top") == 0)
    counts = p.groupBy("image").agg(
        F.count("*").alias("total"), F.count_if(vis).alias("visible"), F.count_if(vis & (F.col("top") < 25)).alias("black"), F.count_if(vis & (F.col("top") < 45)).alias("near_black"),
        F.count_if(vis & (v > 180) & (s < 60)).alias("near_white"), F.count_if(vis & (s < 12) & (v > 35) & (v < 220)).alias("flat"),
        F.count_if(vis & h.between(5, 25) & (s > 50) & (v > 50)).alias("orange"), F.count_if(vis & (s > 40) & (v > 40) & (v < 240)).alias("colored"),
        F.count_if(vis & (s > 230) & (v > 150)).alias("neon"), F.count_if(vis & leak).alias("leakage"), F.avg(F.when(vis, F.col("lum"))).alias("lum"),
    )
    n = F.col("visible")
    share = {f"{c}_ratio": F.col(c) / n for c in ("black", "near_black", "near_white", "flat", "orange", "neon", "leakage")}
    background = share["orange_ratio"] if colorful else F.greatest(F.col("orange") / n, F.col("colored") / n * 0.7)
    return counts.filter("visible > 0").select(
        "image", *(c.alias(k) for k, c in share.items()), background.alias("background_ratio"), (n / F.col("total")).alias("coverage_ratio"),
        (1 - n / F.col("total")).alias("alpha_empty_ratio"), (F.col("lum") / 255.0).alias("luminance"),
    )


def dominant_hue(pixels: DataFrame) -> DataFrame:
    """Most frequent hue among visible pixels (the smallest on ties) and its share."""
    hue = rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))["h"]
    counts = pixels.filter("a > 0").groupBy("image", hue.alias("hue")).count()
    out = counts.groupBy("image").agg(F.max_by("hue", F.struct("count", -F.col("hue"))).alias("hue"), F.max("count").alias("m"), F.sum("count").alias("n"))
    return out.select("image", "hue", (F.col("m") / F.col("n")).alias("ratio"))


def color_profile(pixels: DataFrame) -> DataFrame:
    """Median product and background colour of each session (truncated), colour class and confidence 0.4 + 0.6 * mask share.

    Medians come from counts by channel value, so no session's pixels meet in one task. The median is
    the mean of the two middle values.
    """
    channels = F.array(*(F.struct(F.lit(ch).alias("ch"), F.col(ch).alias("v")) for ch in "rgb"))
    bins = pixels.filter("product is not null").select("session_id", "product", F.explode(channels).alias("c")).filter("c.v is not null").groupBy("session_id", "product", "c.ch", "c.v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("session_id", "product", "ch")
    upto, total = F.sum("n").over(w.orderBy("v")), F.sum("n").over(w)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    inside = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
    ranked = bins.withColumns({"upto": upto, "total": total})
    middle = ranked.groupBy("session_id", "product", "ch").agg(F.floor((F.max(F.when(inside(low), F.col("v"))) + F.max(F.when(inside(high), F.col("v")))) / 2).cast("long").alias("m"))
    at = lambda p, ch: F.max(F.when((F.col("product") == p) & (F.col("ch") == ch), F.col("m")))
    medians = middle.groupBy("session_id").agg(*(at(True, ch).alias(f"p{ch}") for ch in "rgb"), *(at(False, ch).alias(f"b{ch}") for ch in "rgb"))
    share = pixels.groupBy("session_id").agg(F.avg(F.col("masked").cast("int")).alias("share"))
    out = share.join(medians, "session_id", "left")
    hsv = rgb_to_hsv(F.col("pr"), F.col("pg"), F.col("pb"))
    return out.withColumns({"class": color_class(hsv["v"], hsv["s"]), "confidence": F.least(F.lit(1.0), 0.4 + 0.6 * F.col("share"))}).drop("share")


def pixel_sharpness(pixels: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Population variance of the Laplacian of grey values, borders mirrored (101); absent neighbours of a sparse image count as 0."""
    at = [*keys, "x", "y"]
    edge = materialize(pixels.groupBy(*keys).agg(F.max("x").alias("mx"), F.max("y").alias("my")), "edges")  # of known size: joined without a shuffle of pixels where it is small
    grey = pixels.groupBy(*at).agg(F.avg(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).alias("v")).join(edge, list(keys))
    mirror = lambda i, top: F.when(i < 0, -i).when(i > top, 2 * top - i).otherwise(i)
    shifts = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for dx, dy, k in ((0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1))))
    want = grey.select(*keys, "x", "y", "mx", "my", F.explode(shifts).alias("s")).select(*keys, "x", "y", mirror(F.col("x") + F.col("s.dx"), F.col("mx")).alias("nx"), mirror(F.col("y") + F.col("s.dy"), F.col("my")).alias("ny"), "s.k")
    near = grey.select(*keys, F.col("x").alias("nx"), F.col("y").alias("ny"), "v")
    lap = want.join(near, [*keys, "nx", "ny"], "left").groupBy(*at).agg(F.sum(F.col("k") * F.coalesce("v", F.lit(0.0))).alias("lap"))
    return lap.groupBy(*keys).agg(F.var_pop("lap").alias("sharpness"))


def mask_stats(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Occupancy, box area ratio, centroid and border touch of each mask from its set pixels (distinct positions)."""
    on = pixels.select("image", "x", "y").distinct()
    size = width * height
    touch = lambda c: F.max(c.cast("int"))
    return on.groupBy("image").agg(
        (F.count("*") / size).alias("occupancy"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / size).alias("bbox_area_ratio"),
        (F.avg("x") / width).alias("centroid_x"), (F.avg("y") / height).alias("centroid_y"),
        ((touch(F.col("y") == 0) + touch(F.col("y") == height - 1) + touch(F.col("x") == 0) + touch(F.col("x") == width - 1)) / 4).alias("border_touch"),
    )


def mask_iou_leakage(joined: DataFrame, key: str = "image") -> DataFrame:
    """IoU and leakage of predicted masks (columns truth, predicted); an empty union gives 0, an empty truth 1 if anything is predicted."""
    t, p = F.col("truth"), F.col("predicted")
    n = joined.groupBy(key).agg(F.count_if(t & p).alias("both"), F.count_if(t | p).alias("either"), F.count_if(p & ~t).alias("out"), F.count_if(t).alias("truth"), F.count_if(p).alias("predicted"))
    leak = F.when(F.col("truth") == 0, F.when(F.col("predicted") > 0, 1.0).otherwise(0.0)).otherwise(F.col("out") / F.col("truth"))
    return n.select(key, F.coalesce(F.try_divide("both", "either"), F.lit(0.0)).alias("iou"), leak.alias("leakage"))


def mask_means(per_file: DataFrame) -> DataFrame:
    """One row: how many masks were compared, their mean IoU and leakage (null without any)."""
    return per_file.agg(F.count("*").alias("sample_count"), F.avg("iou").alias("avg_iou"), F.avg("leakage").alias("avg_leakage"))


def temporal_stability(masks: DataFrame) -> DataFrame:
    """Area deviation, mean centroid and box-centre steps and empty masks per session and method; a step with an empty side is skipped."""
    w = Window.partitionBy("session_id", "method").orderBy("frame_idx")
    full = F.col("area") > 0
    step = lambda x, y: F.when(full & (F.lag("area").over(w) > 0), F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2))
    moved = masks.withColumns({"cs": step("cx", "cy"), "bs": step("bcx", "bcy")})
    return moved.groupBy("session_id", "method").agg(
        F.stddev_pop("area").alias("area_std"), F.coalesce(F.avg("cs"), F.lit(0.0)).alias("centroid_jitter"), F.coalesce(F.avg("bs"), F.lit(0.0)).alias("bbox_jitter"),
        F.count_if(~full).alias("empty_masks"), F.count("*").alias("frames"),
    )


def mesh_bounds(vertices: DataFrame) -> DataFrame:
    """Corners of each mesh, and the shift that centres its vertices' mean and puts its lowest point on the ground."""
    return vertices.groupBy("mesh").agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))), (-F.avg("x")).alias("pivot_x"), (-F.avg("y")).alias("pivot_y"), (-F.min("z")).alias("pivot_z"))


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners a, b and c; a task holds its part of the vertices and sorts no faces."""
    out = faces
    for i, name in enumerate("abc"):
        v = vertices.select("mesh", F.col("v").alias(f"v{i}"), F.struct("x", "y", "z").alias(name))
        out = out.join(v.hint("shuffle_hash"), ["mesh", f"v{i}"])
    return out


def _length(p: str, q: str) -> Column:
    return F.sqrt(sum((F.col(f"{p}.{a}") - F.col(f"{q}.{a}")) ** 2 for a in "xyz"))


def _cross() -> list[Column]:
    d = lambda p, a: F.col(f"{p}.{a}") - F.col(f"a.{a}")
    return [d("b", "y") * d("c", "z") - d("b", "z") * d("c", "y"), d("b", "z") * d("c", "x") - d("b", "x") * d("c", "z"), d("b", "x") * d("c", "y") - d("b", "y") * d("c", "x")]


def mesh_metrics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertex, face and geometry counts, degenerate faces (area below 1e-12) and vertices equal after rounding to six digits.

    Geometries are told apart by the vertices' column `geometry`; without it a mesh is one.
    """
    part = F.col("geometry") if "geometry" in vertices.columns else F.lit(0)
    places = vertices.groupBy("mesh", part.alias("g"), *(F.round(a, 6).alias(a) for a in "xyz")).agg(F.count("*").alias("n"))  # partial sums before the shuffle
    v = places.groupBy("mesh", "g").agg(F.sum("n").alias("n"), F.count("*").alias("places"))
    v = v.groupBy("mesh").agg(F.sum("n").alias("vertices"), (F.sum("n") - F.sum("places")).alias("duplicate_vertices"), F.count("*").alias("geometries"))
    area = F.sqrt(sum(c * c for c in _cross())) / 2
    f = corners(vertices, faces).groupBy("mesh").agg(F.count("*").alias("faces"), F.count_if(area < 1e-12).alias("degenerate_faces"))
    return v.join(f, "mesh", "left").na.fill(0, ["faces", "degenerate_faces"])


def face_edges(faces: DataFrame) -> DataFrame:
    """The three edges of each face as (mesh, p < q)."""
    pair = lambda i, j: F.struct(F.least(f"v{i}", f"v{j}").alias("p"), F.greatest(f"v{i}", f"v{j}").alias("q"))
    return faces.select("mesh", F.explode(F.array(pair(0, 1), pair(1, 2), pair(0, 2))).alias("e")).select("mesh", "e.p", "e.q")


def edge_manifold(faces: DataFrame) -> DataFrame:
    """Edges of one face (boundary) and of more than two (non-manifold), and the manifold ratio."""
    n = face_edges(faces).groupBy("mesh", "p", "q").count()
    out = n.groupBy("mesh").agg(F.count("*").alias("edges"), F.count_if(F.col("count") == 1).alias("boundary"), F.count_if(F.col("count") > 2).alias("non_manifold"))
    return out.withColumn("manifold_ratio", 1 - F.col("non_manifold") / F.col("edges"))


def exact_quantiles(values: DataFrame, keys: tuple[str, ...], col: str, shares: tuple[float, ...], blocks: int = 1024, weight: str | None = None) -> DataFrame:
    """(keys, mean, sd, q: array) of each key's values, counted `weight` times: exact quantiles, interpolated between neighbours, mean and population deviation.

    Equal values are counted before the shuffle, and the counts written once. Values are dealt to
    `blocks` ranges of a key's span; cumulative counts of the ranges (`blocks` rows a key at most) tell
    which ranges hold the wanted ranks, and only those are ordered. So no task holds all values of a key.
    """
    keys = list(keys)
    counts = materialize(values.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("v")).agg((F.sum(weight) if weight else F.count("*")).alias("n")), "counts")
    n, v = F.col("n"), F.col("v")
    span = counts.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"), (F.sum(n * v) / F.sum("n")).alias("mean"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(blocks - 1), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * blocks))).otherwise(0)
    dealt = counts.join(span, keys).withColumn("block", at)
    w = Window.partitionBy(*keys).orderBy("block")
    far = v - F.col("mean")
    sums = dealt.groupBy(*keys, "block").agg(F.sum("n").alias("b_n"), F.sum(n * far * far).alias("b_far"), *(F.max(x).alias(x) for x in ("total", "mean")))
    sums = sums.withColumns({"before": F.sum("b_n").over(w) - F.col("b_n"), "far": F.sum("b_far").over(Window.partitionBy(*keys))})
    place = lambda q: F.lit(q) * (F.col("total") - 1)  # noqa: E731  of the sorted values, from 0
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares))))
    held = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("b_n")))
    wanted = sums.select(*keys, "block", "before", "far", held.alias("ranks")).filter(F.size("ranks") > 0)
    inner = Window.partitionBy(*keys, "block").orderBy("v")
    found = dealt.join(wanted, [*keys, "block"]).withColumn("end", F.col("before") + F.sum("n").over(inner)).withColumn("r", F.explode("ranks")).filter((F.col("r") < F.col("end")) & (F.col("r") >= F.col("end") - n))
    values_at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("r", "v"))).alias("m"), *(F.max(x).alias(x) for x in ("total", "mean", "far")))  # two ranks a share at most

    def value(q: float) -> Column:
        low, high = F.try_element_at("m", F.floor(place(q))), F.try_element_at("m", F.ceil(place(q)))
        return low + (high - low) * (place(q) - F.floor(place(q)))

    sd = F.sqrt(F.col("far") / F.col("total"))
    return values_at.select(*keys, "mean", sd.alias("sd"), F.array(*map(value, shares)).alias("q"))


#: Most faces of a mesh whose edges and ratios one task may hold.
HELD_FACES = 100_000
#: Edges and ratios that are dealt to a task, about.
TASK_VALUES = 250_000


def edge_aspect_stats(vertices: DataFrame, faces: DataFrame, held: int = HELD_FACES, per_task: int = TASK_VALUES) -> DataFrame:
    """Median, 99th percentile and variation of unique edge lengths; the same percentiles of longest over shortest edge of faces.

    Edge lengths come from the corners that the faces carry, so vertices are joined once for each corner.
    Meshes of up to `held` faces are dealt whole and take `percentile`, larger ones are dealt by edge and take
    `exact_quantiles`; both are exact. Tasks grow in number with the faces, so what each holds does not.
    """
    ab, bc, ca = _length("a", "b"), _length("b", "c"), _length("c", "a")
    sizes = materialize(faces.groupBy("mesh").agg(F.count("*").alias("n")), "sizes")
    large, n = sizes.filter(F.col("n") > held).select("mesh"), F.col("n")
    n_large, n_small = (x or 0 for x in sizes.agg(F.sum(F.when(n > held, n)), F.sum(F.when(n <= held, n))).first())
    least = faces.sparkSession.sparkContext.defaultParallelism

    def values(some: DataFrame, n_faces: int, whole: bool) -> DataFrame:
        """(mesh, kind, v, n): each edge once, each ratio as often as it occurs."""
        sides = corners(vertices, some).select("mesh", "v0", "v1", "v2", ab.alias("ab"), bc.alias("bc"), ca.alias("ca"))
        tasks = max(least, -(-4 * n_faces // per_task))
        sides = sides.repartition(tasks, "mesh") if whole else sides  # a third of the bytes of its edges
        shortest = F.least("ab", "bc", "ca")
        ratio = F.when(shortest > 1e-9, F.greatest("ab", "bc", "ca") / shortest)
        value = lambda kind, i, j, r, v: F.struct(F.lit(kind).alias("kind"), F.least(i, j).alias("p"), F.greatest(i, j).alias("q"), r.alias("r"), v.alias("v"))
        edge = lambda i, j, length: value("edge", i, j, F.lit(None).cast("double"), F.col(length))
        rows = sides.select("mesh", F.inline(F.array(edge("v0", "v1", "ab"), edge("v1", "v2", "bc"), edge("v0", "v2", "ca"), value("aspect", "v0", "v1", ratio, ratio))))
        rows = rows if whole else rows.repartition(tasks, "mesh", "p", "q")
        counts = rows.groupBy("mesh", "kind", "p", "q", "r").agg(F.min("v").alias("v"), F.count("*").alias("n"))
        return counts.select("mesh", "kind", "v", F.when(F.col("kind") == "edge", F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"))

    small = faces.join(large, "mesh", "left_anti") if n_large else faces
    both = values(small, n_small, True).groupBy("mesh", "kind").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.99)), F.col("n")).alias("q"))
    if n_large:
        both = both.unionByName(exact_quantiles(values(faces.join(large, "mesh", "left_semi"), n_large, False), ("mesh", "kind"), "v", (0.5, 0.99), weight="n"))
    of = lambda kind, x: F.max(F.when(F.col("kind") == kind, x))
    return both.groupBy("mesh").agg(
        of("edge", F.col("q")[0]).alias("edge_p50"), of("edge", F.col("q")[1]).alias("edge_p99"), of("edge", F.when(F.col("mean") > 1e-12, F.col("sd") / F.col("mean")).otherwise(0.0)).alias("edge_cv"),
        of("aspect", F.col("q")[0]).alias("aspect_p50"), of("aspect", F.col("q")[1]).alias("aspect_p99"),
    )


#: Rows of one key from which its partner is broadcast, so that they are not sorted in one task.
HUB_ROWS = 100_000


def _beside(rows: DataFrame, one: DataFrame, key: str, n: str, hub: int) -> DataFrame:
    """`rows` joined with `one` (a row for each key, with `n`, the rows it meets): keys of more than `hub` rows by broadcast, one for each `hub` rows at most, the others by shuffle."""
    hubs = one.filter(F.col(n) > hub)
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(one, key)
    return rows.join(F.broadcast(hubs), key).unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 30, hub: int = HUB_ROWS) -> DataFrame:
    """(node, component): the smallest node of each component of the edges (a, b), by large-star/small-star rounds.

    Each round, and the minima that it joins, is written to the checkpoint folder. A node with more than `hub`
    neighbours takes its minimum by broadcast (`_beside`), so that no task holds its edges: in the last rounds, every
    node of a component is a neighbour of its root. It raises after `max_rounds` rounds rather than return half-merged labels.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct())
    last = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = materialize(_beside(both.filter("b > a"), least, "a", "n", hub).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = _beside(large, low, "a", "n", hub).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = materialize(small.filter("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        last = state
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("nodes"))


def sized(labels: DataFrame, hub: int = HUB_ROWS) -> DataFrame:
    """Labels with the number of nodes of their component; no task holds a component of more than `hub` nodes."""
    return _beside(labels, materialize(component_sizes(labels), "sizes"), "component", "nodes", hub)


def largest_share(labels: DataFrame, elements: DataFrame) -> DataFrame:
    """(mesh, components, share): how many components a mesh has and the share of its elements, by their `node`, in the largest; elements without a component are one each."""
    at = elements.join(labels, "node", "left").groupBy("mesh", F.coalesce("component", "node").alias("component")).agg(F.count("*").alias("n"))
    return at.groupBy("mesh").agg(F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("share"))


def component_selection(components: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Components (session_id, idx, score, faces) with `decision`: the best by score, or the largest where the best is tiny; others above `ratio` of its score."""
    w = Window.partitionBy("session_id")
    first = lambda *order: F.first(F.struct("idx", "score", "faces")).over(w.orderBy(*order))
    best, largest = first(F.col("score").desc(), "idx"), first(F.col("faces").desc(), F.col("score").desc(), "idx")
    rows = components.withColumns({"best": best, "largest": largest, "all": F.sum("faces").over(w)})
    swap = (F.col("best.faces") < 0.05 * F.col("all")) & (F.col("largest.faces") > 10 * F.col("best.faces")) & (F.col("largest.score") > 0.40)
    rows = rows.withColumn("primary", F.when(swap, F.col("largest")).otherwise(F.col("best")))
    kept = (F.col("score") > ratio * F.col("primary.score")) & (F.col("faces") > 0.05 * F.col("primary.faces"))
    decision = F.when(F.col("idx") == F.col("primary.idx"), "kept_primary").when(kept, "kept").otherwise("rejected_low_score")
    return rows.withColumn("decision", decision).drop("best", "largest", "all", "primary")


def horizontal_plane_faces(faces: DataFrame, rounds: int = 2) -> DataFrame:
    """Faces (mesh, nz, cz, ...) with `removed_in`: the round that took them as part of a horizontal plane, null for kept ones.

    A round comes down to a height and a tolerance for each mesh. These are written, one row a mesh, so
    that Spark knows their size and joins them without a shuffle of the faces where they are small. A
    mesh whose round takes nothing stops.
    """
    flat, rows = F.abs("nz") > 0.92, faces
    removed = F.lit(None).cast("int")
    for i in range(1, rounds + 1):
        left = removed.isNull() & (F.col(f"__mid{i - 1}").isNotNull() if i > 1 else F.lit(True))
        cz = F.when(flat, F.col("cz"))
        stats = rows.filter(left).groupBy("mesh").agg(F.count("*").alias("n"), F.count_if(flat).alias("flat_n"), F.min(cz).alias("lo"), F.max(cz).alias("hi"))
        stats = stats.filter(F.col("flat_n") >= F.greatest(F.lit(20), F.floor(0.05 * F.col("n"))))
        middle, tolerance = (F.col("lo") + F.col("hi")) / 2, F.greatest(F.lit(0.01), 0.03 * (F.col("hi") - F.col("lo")))
        stats = materialize(stats.select("mesh", "n", middle.alias(f"__mid{i}"), tolerance.alias(f"__tol{i}")), "planes")
        plane = F.coalesce(flat & (F.abs(F.col("cz") - F.col(f"__mid{i}")) <= F.col(f"__tol{i}")), F.lit(False))
        enough = rows.filter(left).join(stats, "mesh").filter(plane).groupBy("mesh").agg(F.count("*").alias("plane_n"))
        taken = materialize(stats.join(enough, "mesh").filter(F.col("plane_n") >= F.greatest(F.lit(30), F.floor(0.08 * F.col("n")))).select("mesh", f"__mid{i}", f"__tol{i}"), "planes")
        rows = rows.join(taken, "mesh", "left")
        removed = F.coalesce(removed, F.when(plane, F.lit(i)))
    return rows.withColumn("removed_in", removed).drop(*(f"__{x}{i}" for i in range(1, rounds + 1) for x in ("mid", "tol")))


def chromatic_components(colors: DataFrame, background: tuple[int, int, int], tolerance: int = 35) -> DataFrame:
    """Share of each component's vertex colours near the background colour, and whether to prune it."""
    far = F.greatest(*(F.abs(F.col(c) - v) for c, v in zip("rgb", background, strict=True)))
    out = colors.groupBy("mesh", "component").agg(F.avg((far <= tolerance).cast("int")).alias("ratio"), F.max("faces").alias("faces"))
    prune = ((F.col("faces") < 500) & (F.col("ratio") > 0.40)) | (F.col("ratio") > 0.75)
    return out.withColumn("prune", prune)


#: Points of an octree cell above which it is split, and how often a cell of half the radius may be.
CELL_POINTS, CELL_SPLITS = 4096, 8


def nearest_point_support(elements: DataFrame, points: DataFrame, radius: float = 0.05, most: int = CELL_POINTS, splits: int = CELL_SPLITS) -> DataFrame:
    """Elements whose nearest cloud point is closer than `radius`, by component, over an octree of the cloud.

    Cells of half the radius are the octree's roots: a point in an element's own cell is close enough, which takes
    no points at all. Other elements look at the occupied cells within reach: a cell that lies inside their ball is
    enough, one with up to `most` points is looked into, and a denser one is split into octants and its children
    taken in its place. So no element meets more than `most` points of a cell, but for points that `splits` splits
    do not part.
    """
    axes, side, job = "xyz", radius / 2, ["job"]
    fine = lambda a: F.floor(F.col(a) / (side / 2**splits)).cast("long")
    at = lambda level: {f"c{a}": F.shiftright(f"g{a}", splits - level) for a in axes}
    cells = [f"c{a}" for a in axes]
    own = elements.select("job", "element", *axes, *(fine(a).alias(f"g{a}") for a in axes))
    cloud = points.select("job", *(F.col(a).alias(f"p{a}") for a in axes), *(fine(a).alias(f"g{a}") for a in axes))
    count = lambda rows, level: rows.select("job", *(v.alias(k) for k, v in at(level).items())).groupBy("job", *cells).agg(F.count("*").alias("n"))
    roots = materialize(count(cloud, 0), "cells")
    placed = own.select("job", "element", *axes, *(v.alias(k) for k, v in at(0).items()))
    hits = [placed.join(roots, job + cells, "left_semi").select("job", "element")]
    around = placed.join(roots, job + cells, "left_anti")
    for a in axes:
        around = around.withColumn("__d", F.explode(F.array(*map(F.lit, range(-2, 3))))).withColumn(f"c{a}", F.col(f"c{a}") + F.col("__d")).drop("__d")
    square = radius * radius

    def reach(size: float) -> tuple[Column, Column]:
        """Squared distances from an element to the nearest and farthest place of a cell."""
        low = {a: F.col(f"c{a}") * size for a in axes}
        gap = sum(F.greatest(low[a] - F.col(a), F.col(a) - low[a] - size, F.lit(0.0)) ** 2 for a in axes)
        return gap, sum(F.greatest(F.col(a) - low[a], low[a] + size - F.col(a)) ** 2 for a in axes)

    asked = around.filter(reach(side)[0] < square * (1 + 1e-9)).join(roots, job + cells)
    for level in range(splits + 1):
        gap, far = reach(side / 2**level)
        near = asked.filter(gap < square * (1 + 1e-9)).withColumn("sure", far < square * (1 - 1e-9))
        hits.append(near.filter("sure").select("job", "element"))
        dense = (F.col("n") > most) & F.lit(level < splits)
        inside = near.filter(~F.col("sure") & ~dense).join(cloud.select("job", *(f"p{a}" for a in axes), *(v.alias(k) for k, v in at(level).items())), job + cells)
        hits.append(inside.filter(sum((F.col(a) - F.col(f"p{a}")) ** 2 for a in axes) < square).select("job", "element"))
        if level == splits or roots.filter(dense).isEmpty():
            break
        # an element that a cell inside its ball has settled asks no further
        parents = materialize(near.filter(~F.col("sure") & dense).select("job", "element", *axes, *cells).join(hits[-2], ["job", "element"], "left_anti"), "parents")
        split = roots.filter(dense).select("job", *cells)
        members = cloud.select("job", *(f"g{a}" for a in axes), *(v.alias(k) for k, v in at(level).items())).join(split, job + cells, "left_semi")
        roots = materialize(count(members, level + 1), "octants")
        children = roots.select("job", "n", *(F.col(k).alias(f"k{k}") for k in cells), *(F.shiftright(k, 1).alias(k) for k in cells))
        asked = parents.join(children, job + cells).select("job", "element", *axes, *(F.col(f"k{k}").alias(k) for k in cells), "n")
    hit = hits[0]
    for more in hits[1:]:
        hit = hit.unionByName(more)
    hit = hit.distinct().withColumn("hit", F.lit(1))
    return elements.join(hit, ["job", "element"], "left").groupBy("job", "component").agg(F.count("hit").alias("supported"), F.count("*").alias("total")).withColumn("ratio", F.col("supported") / F.col("total"))


def view_mask_support(points: DataFrame, cameras: DataFrame, mask_pixels: DataFrame, n: int | None = 500, min_visible: int = 10) -> DataFrame:
    """Support of components by masks: points projected by each camera (rows p0, p1, p2 of four), kept in front and inside, looked up in the mask.

    The first n points of a component by hash stand for it, all of them if n is None. A view counts from `min_visible` visible points.
    """
    if n is not None:
        w = Window.partitionBy("job", "component").orderBy(F.xxhash64("job", "element"), "element")
        points = points.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
    seen = points.join(cameras, "job")
    dot = lambda row: F.col(row)[0] * F.col("x") + F.col(row)[1] * F.col("y") + F.col(row)[2] * F.col("z") + F.col(row)[3]
    seen = seen.withColumn("depth", dot("p2")).filter("depth > 0.01")
    seen = seen.withColumns({"px": F.floor(dot("p0") / F.col("depth")), "py": F.floor(dot("p1") / F.col("depth"))}).filter("px >= 0 and py >= 0 and px < width and py < height")
    lit = mask_pixels.filter("value > 127").select("job", "camera", "px", "py").distinct().withColumn("on", F.lit(1))
    views = seen.join(lit, ["job", "camera", "px", "py"], "left").groupBy("job", "component", "camera").agg(F.count("*").alias("visible"), F.count("on").alias("on_mask"))
    views = views.filter(F.col("visible") >= min_visible).withColumn("support", F.col("on_mask") / F.col("visible"))
    return views.groupBy("job", "component").agg(
        F.avg("support").alias("avg_support"), F.median("support").alias("median_support"), (F.sum("on_mask") / F.sum("visible")).alias("hit_ratio"), F.count_if(F.col("support") > 0.5).alias("views")
    )


#: Limits of the audit: least and greatest size, distance of the centre from the origin, height of the lowest point that counts as ground.
NORMAL = {"scale": (0.001, 1000.0), "center": 1.0, "ground": 0.05}


def normalization_audit(vertices: DataFrame, limits: dict = NORMAL) -> DataFrame:
    """Dimensions, centre, ground offset and largest axis (the first of equal ones) of each mesh with `issues`, `warnings` and whether it lies flat on the ground (y up).

    A mesh whose vertices have no coordinates has the issue no_vertices_found and nulls otherwise.
    """
    b = vertices.groupBy("mesh").agg(*(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    dims = {f"d{a}": F.col(f"hi{a}") - F.col(f"lo{a}") for a in "xyz"} | {f"c{a}": (F.col(f"hi{a}") + F.col(f"lo{a}")) / 2 for a in "xyz"}
    out = b.withColumns(dims).withColumns({"largest": F.greatest("dx", "dy", "dz"), "center_distance": F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2 + F.col("cz") ** 2), "ground_offset": F.col("loy")})
    out = out.withColumn("largest_axis", F.when(F.col("dx") == F.col("largest"), "x").when(F.col("dy") == F.col("largest"), "y").when(F.col("dz") == F.col("largest"), "z"))
    least, most = limits["scale"]
    flat = F.abs("ground_offset") < limits["ground"]
    return out.withColumns({
        "flat_on_ground": flat,
        "issues": codes((F.col("largest").isNull(), "no_vertices_found"), (F.col("largest") < least, "model_too_small"), (F.col("largest") > most, "model_too_large")),
        "warnings": codes((F.col("center_distance") > limits["center"], "model_not_centered"), (~flat, "ground_alignment_uncertain")),
    })
