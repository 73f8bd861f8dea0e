"""Products, versions, sessions, attempts and joins between capture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitgrid.functions.geometry import quat_camera_center
from orbitgrid.functions.text import failure_classify
from orbitgrid.operators.asset_rules import codes, true
from orbitgrid.operators.frames import even_sample

c = F.col
#: Legal transitions between states.
TRANSITIONS = {
    "created": ("captured", "recapture_required", "failed"),
    "captured": ("reconstructed", "captured", "recapture_required", "failed"),
    "recapture_required": ("captured", "failed"),
    "reconstructed": ("cleaned", "captured", "recapture_required", "processing_budget_exceeded", "failed"),
    "cleaned": ("exported", "reconstructed", "recapture_required", "failed"),
    "exported": ("validated", "cleaned", "recapture_required", "failed"),
    "validated": ("published", "exported", "recapture_required", "failed"),
    "published": ("validated",),
    "processing_budget_exceeded": ("reconstructed", "recapture_required", "failed"),
    "failed": (),
}
PROCESSING = ("created", "captured", "reconstructed", "cleaned", "exported", "validated")


def lifecycle_check(history: DataFrame, transitions: dict = TRANSITIONS) -> DataFrame:
    """History with `legal`: whether (from_status, status) is an allowed step; a first status is legal."""
    rows = [(a, b) for a, bs in transitions.items() for b in bs]
    table = history.sparkSession.createDataFrame(rows, "from_status string, status string").withColumn("__ok", F.lit(True))
    out = history.join(F.broadcast(table), ["from_status", "status"], "left")
    return out.withColumn("legal", c("from_status").isNull() | F.coalesce("__ok", F.lit(False))).drop("__ok")


def publish_eligibility(assets: DataFrame) -> DataFrame:
    """`block_reason` by precedence and `eligible`, from decision, registry flags, approval and the four urls."""
    urls = [F.coalesce(F.trim(u), F.lit("")) for u in ("glb_url", "usdz_url", "poster_url", "thumb_url")]
    missing = F.exists(F.array(*urls), lambda u: u == "")
    placeholder = F.exists(F.array(*urls), lambda u: F.lower(u).isin("http://missing", "https://missing", "missing"))
    reason = (
        F.when(c("decision") == "fail", "failed_validation").when(~c("registered"), "not_registered").when(true(c("ai_generated")), "ai_generated")
        .when((true(c("decision") == "review") | true(c("requires_manual_review"))) & ~true(c("approved")), "unapproved_review").when(missing, "missing_urls").when(placeholder, "placeholder_urls")
        .when(F.coalesce("geometry_source", F.lit("photogrammetry")) != "photogrammetry", "not_photogrammetry")
    )
    return assets.withColumn("block_reason", reason).withColumn("eligible", c("block_reason").isNull())


def frame_mask_join(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames with mask columns by stem, else by full name; `match_mode` stem, legacy or none. Masks: (session_id, mask_name, occupancy)."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    by = lambda p: masks.select("session_id", c("mask_name").alias(f"{p}_key"), F.struct("occupancy").alias(p))
    rows = frames.withColumns({"stem_key": F.concat(stem, F.lit(".png")), "legacy_key": F.concat("name", F.lit(".png"))})
    rows = rows.join(by("stem"), ["session_id", "stem_key"], "left").join(by("legacy"), ["session_id", "legacy_key"], "left")
    mode = F.when(c("stem").isNotNull(), "stem").when(c("legacy").isNotNull(), "legacy").otherwise("none")
    return rows.withColumns({"occupancy": F.coalesce("stem.occupancy", "legacy.occupancy"), "match_mode": mode}).drop("stem", "legacy", "stem_key", "legacy_key")


def mask_folder_choice(images: DataFrame, masks: DataFrame, sample: int = 20) -> DataFrame:
    """Best mask folder of each session: share of its first `sample` files whose stem names an image (over 0.5) plus 0.1 of those with its size."""
    first = masks.withColumn("__r", F.row_number().over(Window.partitionBy("session_id", "folder").orderBy("file"))).filter(c("__r") <= sample)
    keys = images.select("session_id", c("name").alias("stem"), c("size").alias("image_size"))
    rows = first.join(keys, ["session_id", "stem"], "left")
    score = rows.groupBy("session_id", "folder").agg(F.avg(c("image_size").isNotNull().cast("int")).alias("match"), F.avg(true(c("image_size") == c("size")).cast("int")).alias("dim"))
    score = score.filter("match > 0.5").withColumn("score", c("match") + c("dim") * 0.1)
    w = Window.partitionBy("session_id").orderBy(c("score").desc(), "folder")
    return score.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("session_id", "folder", "score")


def frame_pose_join(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Frames with the azimuth atan2(x, z) of their camera centre in degrees; null without a pose."""
    at = poses.withColumn("__c", quat_camera_center(c("qvec"), c("tvec"))).select("session_id", "name", F.degrees(F.atan2("__c.x", "__c.z")).alias("azimuth"))
    return frames.join(at, ["session_id", "name"], "left")


def report_bundle(sessions: DataFrame, defaults: dict[str, tuple[DataFrame, dict]]) -> DataFrame:
    """Sessions with columns of each report ((session_id, ...), defaults for missing ones)."""
    out = sessions
    for report, values in defaults.values():
        out = out.join(report, "session_id", "left").withColumns({k: F.coalesce(c(k), F.lit(v)) for k, v in values.items()})
    return out


def best_attempt_lookup(audits: DataFrame) -> DataFrame:
    """Audits with `best`: the attempt at selected_best_index, or the last one where that is out of range."""
    i = F.coalesce("selected_best_index", F.lit(-1))
    best = F.when((i >= 0) & (i < F.size("attempts")), F.get("attempts", i.cast("int"))).otherwise(F.try_element_at("attempts", F.lit(-1)))
    return audits.withColumn("best", best)


def product_listing(assets: DataFrame, active: DataFrame, sessions: DataFrame) -> DataFrame:
    """Products of the registry or of sessions: active asset, asset count, status and last update."""
    a = assets.groupBy("product_id").agg(F.count("*").alias("asset_count"), F.max("created_at").alias("a_updated"))
    s = sessions.groupBy("product_id").agg(F.bool_or(~c("status").isin("published", "failed")).alias("busy"), F.max("updated_at").alias("s_updated"))
    out = a.join(s, "product_id", "full").join(active, "product_id", "left")
    return out.select(
        "product_id", "active_id", F.coalesce("asset_count", F.lit(0)).alias("asset_count"), F.when(true(c("busy")), "processing").otherwise("registered").alias("status"), F.coalesce("a_updated", "s_updated").alias("last_updated")
    )


def product_history(assets: DataFrame, active: DataFrame, audit: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assets of each product with version, active flag and ordered actions; products without assets fall back to their sessions."""
    trail = audit_trail(audit)
    rows = assets.join(active, "product_id", "left").join(trail, "asset_id", "left")
    own = rows.select("product_id", "asset_id", "version", true(c("asset_id") == c("active_id")).alias("is_active"), F.coalesce("actions", F.array().cast("array<string>")).alias("actions"))
    other = sessions.join(assets.select("product_id").distinct(), "product_id", "left_anti")
    open_ = other.select("product_id", c("session_id").alias("asset_id"), F.lit("In-Progress").alias("version"), F.lit(False).alias("is_active"), F.array(F.lit("session_created")).alias("actions"))
    return own.unionByName(open_)


def audit_trail(audit: DataFrame) -> DataFrame:
    """Actions of each asset in order (ts, seq)."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "seq", "action")))
    return audit.groupBy("asset_id").agg(F.transform(steps, lambda s: s["action"]).alias("actions"))


def pending_reviews(assets: DataFrame) -> DataFrame:
    return assets.filter(~F.coalesce("approved", F.lit(False)))


def mask_evaluation_join(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pixels of truth and prediction of the same file; files without a prediction drop out."""
    return truth.join(predicted, ["name", "x", "y"])


def dataset_gaps(metadata: DataFrame, files: DataFrame, least_frames: int = 3) -> DataFrame:
    """Validation frames whose mask file is missing, and videos with too few frames."""
    missing = metadata.join(files, metadata.mask == files.file, "left_anti").select("video", "frame", F.lit("mask_missing").alias("problem"))
    few = metadata.groupBy("video").agg(F.count("*").alias("n")).filter(c("n") < least_frames).select("video", F.lit(None).cast("long").alias("frame"), F.lit("few_frames").alias("problem"))
    return missing.unionByName(few)


def name_overlap(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images, masks and images that have a mask of the same name, by job."""
    a, b = images.select("job", "name").distinct(), masks.select("job", "name").distinct()
    both = a.join(b, ["job", "name"], "left_semi").groupBy("job").agg(F.count("*").alias("matches"))
    out = a.groupBy("job").agg(F.count("*").alias("images")).join(b.groupBy("job").agg(F.count("*").alias("masks")), "job", "full").join(both, "job", "left")
    return out.na.fill(0, ["images", "masks", "matches"])


def dense_mask_integrity(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with a mask by name, those of the same size, and whether a job is valid (all match)."""
    m = masks.select("job", "name", c("w").alias("mw"), c("h").alias("mh"))
    rows = images.join(m, ["job", "name"], "left")
    same = true((c("w") == c("mw")) & (c("h") == c("mh")))
    out = rows.groupBy("job").agg(F.count("*").alias("images"), F.count("mw").alias("exact"), F.count_if(same).alias("dim"))
    return out.withColumns({"mismatch": c("exact") - c("dim"), "valid": (c("exact") == c("images")) & (c("dim") == c("images"))})


def baseline_gain(scores: DataFrame) -> DataFrame:
    """Mean IoU of two methods (columns mode, method a or b, iou, valid), raw and over valid frames, with gain and rank by the corrected score of b."""
    avg = lambda m, only: F.coalesce(F.avg(F.when((c("method") == m) & (c("valid") | F.lit(not only)), c("iou"))), F.lit(0.0))
    out = scores.groupBy("mode").agg(avg("a", False).alias("a_raw"), avg("b", False).alias("b_raw"), avg("a", True).alias("a_corrected"), avg("b", True).alias("b_corrected"))
    # one row for each mode
    return out.withColumns({"gain": c("b_corrected") - c("a_corrected"), "rank": F.rank().over(Window.orderBy(c("b_corrected").desc(), "mode")).cast("long")})


#: Make, model part, least and greatest focal length, camera model; the first row that fits wins.
DEVICES = (
    ("apple", "iphone", 5.0, 7.5, "RADIAL"),
    ("apple", "iphone", 1.5, 3.0, "OPENCV_FISHEYE"),
    ("google", "pixel", 5.0, 8.0, "RADIAL"),
    ("google", "pixel", 1.5, 3.5, "OPENCV"),
    ("samsung", "sm-", 5.0, 8.5, "RADIAL"),
    ("samsung", "sm-", 1.0, 3.0, "OPENCV"),
    ("gopro", "", 0.0, 99.0, "OPENCV_FISHEYE"),
    ("canon", "", 24.0, 999.0, "RADIAL"),
    ("nikon", "", 24.0, 999.0, "RADIAL"),
    ("sony", "ilc", 16.0, 999.0, "RADIAL"),
)


#: Letters of a gram of the device index, bins of a doubling of the focal length, and the doublings that have bins of their own.
GRAM, FOCAL_BINS, FOCAL_RANGE = 3, 2, (-4, 20)
DEVICE = "row_no int, make string, model string, focal_min double, focal_max double, camera_model string"


def device_table(spark: SparkSession, devices=DEVICES) -> DataFrame:
    """A device table (row_no, make, model, focal_min, focal_max, camera_model) from tuples in order."""
    return spark.createDataFrame([(i, *d) for i, d in enumerate(devices)], DEVICE)


def focal_bin(focal: Column) -> Column:
    low, high = FOCAL_RANGE
    return F.floor(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.log2(F.greatest(focal, F.lit(2.0**low))))) * FOCAL_BINS).cast("int")


def of_kind(kind: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))


def grams_of(text: Column, most: int = GRAM) -> Column:
    """All distinct substrings of up to `most` letters, and the empty one."""
    at = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *(at(n) for n in range(1, most + 1))))


def device_index(devices: DataFrame) -> DataFrame:
    """Device rows by (kind, gram, bin): under the rarest gram of their make or model part, once for each bin of their focal range.

    A part shorter than a gram stands under itself; a row with two empty parts under the empty gram of makes.
    """
    d = devices.withColumns({"make": F.coalesce("make", F.lit("")), "model": F.coalesce("model", F.lit(""))})
    own = lambda x: F.when(F.length(x) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(x) - (GRAM - 1)), lambda i: F.substring(x, i, F.lit(GRAM)))).otherwise(F.array(c(x)))
    places = F.array_distinct(F.concat(*(of_kind(x, own(x)) for x in ("make", "model"))))
    held = d.select("*", F.explode(places).alias("p")).select("*", "p.*").drop("p")
    common = held.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    # the longest gram, of those the rarest: a row stands in one list only
    rare = F.struct((-F.length("gram")).alias("l"), "n", "kind", "gram")
    picked = held.join(common, ["kind", "gram"]).groupBy("row_no").agg(F.min(rare).alias("p")).select("row_no", "p.kind", "p.gram")
    return d.join(picked, "row_no").withColumn("bin", F.explode(F.sequence(focal_bin(c("focal_min")), focal_bin(c("focal_max"))))).filter("focal_max >= focal_min")


def device_db_match(frames: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Frames (make, model, focal_mm) with the camera model of the first row of a device table that fits.

    A row fits if its make and model are part of the frame's, in lower case, and the focal length is within
    its bounds. Distinct combinations of frames meet the device index (`device_index`) by gram and focal bin, an
    equi-join at any size of the table. Frames without focal length have none.
    """
    index = device_index(device_table(frames.sparkSession) if devices is None else devices)
    key = {"__mk": F.lower(F.coalesce("make", F.lit(""))), "__md": F.lower(F.coalesce("model", F.lit(""))), "__f": c("focal_mm").cast("double")}
    rows = frames.drop("device_model").withColumns(key)
    kinds = F.concat(of_kind("make", grams_of(c("__mk"))), of_kind("model", grams_of(c("__md"))))
    asked = rows.filter("__f > 0").select("__mk", "__md", "__f").distinct().select("*", focal_bin(c("__f")).alias("bin"), F.explode(kinds).alias("p")).select("*", "p.*").drop("p")
    near = asked.join(index, ["kind", "gram", "bin"]).filter(c("__mk").contains(c("make")) & c("__md").contains(c("model")) & c("__f").between(c("focal_min"), c("focal_max")))
    first = near.groupBy("__mk", "__md", "__f").agg(F.min_by("camera_model", "row_no").alias("device_model"))
    return rows.join(first, list(key), "left").drop(*key)


def camera_model_vote(frames: DataFrame, samples: int = 8, fallback: str = "RADIAL", mixed: float = 30.0) -> DataFrame:
    """Camera model of each session from evenly spaced frames: device majority (first seen on ties), mean field of view, name hints (column hint), default."""
    rows = device_db_match(even_sample(frames, "session_id", "frame_idx", samples))
    fov = F.when(c("focal_mm") > 0, F.degrees(2 * F.atan(F.lit(36.0) / (2 * c("focal_mm")))))
    votes = rows.withColumns({"fov": fov, "hint": F.when(c("device_model").isNull(), c("hint"))})
    def most(col: str) -> DataFrame:
        n = votes.filter(c(col).isNotNull()).groupBy("session_id", col).agg(F.count("*").alias("n"), F.min("frame_idx").alias("at"))
        return n.groupBy("session_id").agg(F.max_by(col, F.struct("n", -c("at"))).alias(f"top_{col}"))

    fovs = votes.groupBy("session_id").agg(F.avg("fov").alias("hfov"), (F.max("fov") - F.min("fov")).alias("range"))
    out = fovs.join(most("device_model"), "session_id", "left").join(most("hint"), "session_id", "left")
    by_fov = F.when(c("range") > mixed, "OPENCV").otherwise(F.when(c("hfov") < 75, "RADIAL").when(c("hfov") < 95, "OPENCV").otherwise("OPENCV_FISHEYE"))
    model = F.coalesce(c("top_device_model"), F.when(c("hfov").isNotNull(), by_fov), c("top_hint"), F.lit(fallback))
    source = F.when(c("top_device_model").isNotNull(), "device_db").when(c("hfov").isNotNull(), "exif_hfov").when(c("top_hint").isNotNull(), "filename_hint").otherwise("default")
    return out.select("session_id", model.alias("model"), source.alias("source"), F.coalesce("hfov", F.lit(0.0)).alias("hfov"))


def intrinsics_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (cache_key, w, h, focal_mm) with cached intrinsics, else pinhole defaults of focal_mm or 26."""
    known = cache.select("cache_key", *(c(x).alias(f"__{x}") for x in ("fx", "fy", "cx", "cy")), F.lit(True).alias("__hit"))
    f = F.when(c("focal_mm") > 0, c("focal_mm")).otherwise(26.0) * c("w") / 36.0
    own = {"fx": f, "fy": f, "cx": c("w") / 2.0, "cy": c("h") / 2.0}
    out = requests.join(known, "cache_key", "left").withColumns({k: F.coalesce(c(f"__{k}"), v) for k, v in own.items()})
    return out.withColumn("status", F.when(c("__hit"), "hit").otherwise("miss")).drop("__fx", "__fy", "__cx", "__cy", "__hit")


#: Licence and whether a note goes with it, by tool.
TOOLS = (
    ("colmap", "BSD-3-Clause", False),
    ("openmvs", "AGPL-3.0", True),
    ("blender", "GPL-2.0-or-later", True),
    ("gltf_transform", "MIT", False),
    ("gltf_validator", "Apache-2.0", False),
    ("ffmpeg", "LGPL-2.1 / GPL-2.0", True),
)


def license_tools(assets: DataFrame, tools=TOOLS) -> DataFrame:
    """Known tools of each asset (array active_tools) as tool:licence in the asset's order, and whether an AGPL note applies; unknown keys drop out."""
    table = assets.sparkSession.createDataFrame(list(tools), "tool string, license string, note boolean")
    rows = assets.select("asset_id", F.posexplode("active_tools").alias("at", "tool")).join(F.broadcast(table), "tool")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "tool", "license"))), lambda x: F.concat_ws(":", x["tool"], x["license"]))
    return rows.groupBy("asset_id").agg(listed.alias("tools"), F.bool_or(c("license").startswith("AGPL")).alias("agpl_note"))


def latest_manifest(manifests: DataFrame) -> DataFrame:
    """The last appended row of each session."""
    others = [x for x in manifests.columns if x != "session_id"]
    return manifests.filter("session_id is not null").groupBy("session_id").agg(F.max_by(F.struct(*others), "seq").alias("m")).select("session_id", "m.*")


def next_version(assets: DataFrame) -> DataFrame:
    """'v' and one more than the greatest first run of digits among a product's versions."""
    n = F.try_to_number(F.regexp_extract(F.coalesce("version", F.lit("")), r"(\d{1,18})", 1), F.lit("999999999999999999")).cast("long")
    return assets.groupBy("product_id").agg(F.concat(F.lit("v"), (F.coalesce(F.max(n), F.lit(0)) + 1).cast("string")).alias("next_version"))


def rollback_target(assets: DataFrame, active: DataFrame) -> DataFrame:
    """Asset a product rolls back to: before the active one by created_at; none active: the newest; active unknown: the second newest; first or single: null."""
    w = Window.partitionBy("product_id").orderBy("created_at", "asset_id")
    rows = assets.join(active, "product_id", "left").withColumn("before", F.lag("asset_id").over(w))
    out = rows.groupBy("product_id").agg(
        F.count("*").alias("n"), F.max("active_id").alias("active_id"), F.max_by("asset_id", F.struct("created_at", "asset_id")).alias("newest"), F.max_by("before", F.struct("created_at", "asset_id")).alias("second"),
        F.bool_or(true(c("asset_id") == c("active_id"))).alias("known"), F.max(F.when(c("asset_id") == c("active_id"), c("before"))).alias("previous"),
    )
    target = F.when(c("n") >= 2, F.when(c("active_id").isNull(), c("newest")).when(c("known"), c("previous")).otherwise(c("second")))
    return out.select("product_id", target.alias("new_active"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Best successful attempt of each session, the first on ties; none: recapture_required."""
    ok = F.when(c("success"), F.struct("score", (-c("idx")).alias("i")))
    top = attempts.groupBy("session_id").agg(F.max(ok).alias("b"))
    return top.select("session_id", (-c("b.i")).alias("idx"), c("b.score").alias("score"), F.when(c("b").isNull(), "recapture_required").otherwise("success").alias("final_status"))


def sparse_model_choice(lines: DataFrame) -> DataFrame:
    """Best sparse model of each job from analyser output (job, model, line_no, line): most images, then points, then name."""
    img = F.regexp_extract("line", r"Registered\s+images\s*:\s*(\d+)", 1)
    pts = F.when(~c("line").contains("observations") & (img == ""), F.regexp_extract("line", r"Points(?:3D)?\s*:\s*(\d+)", 1))
    number = lambda x: F.max_by(F.when(x != "", x).try_cast("long"), F.when(x != "", c("line_no")))
    stats = lines.groupBy("job", "model").agg(F.coalesce(number(img), F.lit(0)).alias("images"), F.coalesce(number(pts), F.lit(0)).alias("points")).filter("images > 0")
    w = Window.partitionBy("job").orderBy(c("images").desc(), c("points").desc(), "model")
    return stats.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Candidates with rank, `selected` (the best successful one of its product, first on ties) and reason."""
    w = Window.partitionBy("product_id")
    ok = true(c("provider_status") == "ok") & true(c("has_output"))
    order = [c("score").desc(), c("asset_id")]
    rows = candidates.withColumns({"rank": F.row_number().over(w.orderBy(*order)).cast("long"), "__ok": ok})
    rows = rows.withColumns({"__at": F.row_number().over(Window.partitionBy("product_id", "__ok").orderBy(*order)), "__any": F.max(c("__ok").cast("int")).over(w)})
    chosen = c("__ok") & (c("__at") == 1)
    reason = F.when(c("__any") == 0, "all_candidates_failed").when(chosen, "highest_score")
    return rows.withColumns({"selected": chosen, "reason": reason}).drop("__ok", "__at", "__any")


#: Presets in the order in which they are tried.
LADDER = ("profile_safe", "safe_high_quality", "safe_low_resolution", "low_thread_texture", "baseline")


def fallback_next(sessions: DataFrame, ladder: tuple[str, ...] = LADDER) -> DataFrame:
    """Next preset of each session (used: array of presets, error): a crash-class jump, else the first unused one; none after a missing file."""
    cls = failure_classify(c("error"))
    used = lambda p: F.array_contains("used", p)
    left = F.filter(F.array(*map(F.lit, ladder)), lambda p: ~F.array_contains(c("used"), p))
    crash, oom = (cls == "native_crash") & ~used("low_thread_texture"), (cls == "oom") & ~used("safe_low_resolution")
    preset = F.when(crash, "low_thread_texture").when(oom, "safe_low_resolution").when(cls != "missing_file", F.get(left, F.lit(0)))
    trigger = F.when(crash, "retry_after_native_crash").when(oom, "retry_after_oom").when(F.size("used") == 0, "initial").otherwise("retry_after_runtime_error")
    return sessions.withColumn("preset", preset).withColumn("trigger", F.when(c("preset").isNotNull(), trigger))


def stage_progress(history: DataFrame, now: Column, timeout_hours: float = 2.0) -> DataFrame:
    """Each stage of each session: how often it was entered, its seconds until the next step in all and at most, and, for the session's last stage, seconds since its last step and whether it is stalled (processing states only).

    A stage that no step follows is open: its own time is not in `duration_s` (null if that is all).
    """
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    rows = history.withColumns({"us": micros(F.lead("ts").over(w)) - micros(c("ts")), "last": F.last("status").over(whole), "last_at": F.last("ts").over(whole)})
    out = rows.groupBy("session_id", c("status").alias("stage")).agg(F.count("*").alias("steps"), F.sum("us").alias("us"), F.max("us").alias("most"), F.max("last").alias("last"), F.max("last_at").alias("last_at"))
    current = c("stage").eqNullSafe(c("last"))
    out = out.withColumns({"duration_s": c("us") / 1e6, "longest_s": c("most") / 1e6, "current": current, "stale_s": F.when(current, (micros(now) - micros(c("last_at"))) / 1e6)})
    return out.withColumn("stalled", current & c("stage").isin(*PROCESSING) & (c("stale_s") > timeout_hours * 3600)).drop("us", "most", "last", "last_at")


def fixture_union(*fixtures: DataFrame) -> DataFrame:
    """All fixture sets; columns that a set lacks are null."""
    out = fixtures[0]
    for f in fixtures[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def fixture_upsert(existing: DataFrame, new: DataFrame, key: str = "fixture_id") -> DataFrame:
    """Existing rows and the new ones of unknown ids."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def evidence_checklist(jobs: DataFrame) -> DataFrame:
    """Graded items of each job, its final status (the worst) and the failed and weak items in order."""
    n, reg = F.coalesce("dense_images", F.lit(0)), F.coalesce("registered", F.lit(0))
    ratio = F.when(c("accepted") > 0, reg / c("accepted")).otherwise(0.0)
    masks = (c("mask_exact") == n) & (c("mask_dim") == n) & (n > 0)
    no = F.lit(False)
    items = (
        ("capture_status", c("capture").isin("sufficient", "PASS"), c("capture").isin("warn", "REVIEW")), ("accepted_frames", c("accepted") >= 30, c("accepted") >= 15), ("dense_masks_integrity", masks, no),
        ("fallback_white_ratio", c("white_ratio") <= 0.05, c("white_ratio") <= 0.10), ("registered_images", (reg >= 20) & (ratio >= 0.70), reg >= 10), ("fused_point_count", c("points") >= 25_000, c("points") >= 10_000),
        ("object_isolation_method", c("method").isin("mask_guided", "hybrid_pc_mask"), c("method") == "geometric_only"), ("isolation_confidence", c("confidence") >= 0.75, c("confidence") >= 0.60),
        ("texture_count", c("textures") > 0, no), ("material_count", c("materials") > 0, no), ("texcoord_0_exists", c("texcoord"), no), ("texture_applied", c("applied"), no), ("glb_validation", c("glb") == "pass", c("glb") == "review"),
    )
    failed = codes(*((~true(a) & ~true(b), name) for name, a, b in items))
    weak = codes(*((~true(a) & true(b), name) for name, a, b in items))
    rows = jobs.withColumns({"failures": failed, "warnings": weak})
    return rows.withColumn("final_status", F.when(F.size("failures") > 0, "failed").when(F.size("warnings") > 0, "review_ready").otherwise("production_ready"))


#: Mode -> (input size, texture resolution, candidates, frames)
GENERATION_MODES = {"balanced": (768, 1024, 3, 3), "high": (1024, 1024, 5, 5), "ultra": (1024, 2048, 8, 8)}


def quality_profile_clamp(requests: DataFrame, modes: dict = GENERATION_MODES, limit: int = 5) -> DataFrame:
    """Resolved generation parameters: the mode's (balanced where unknown), overrides (o_*) where given, then limits."""
    asked = F.lower(F.when(F.coalesce("mode", F.lit("")) == "", "balanced").otherwise(c("mode")))
    known = asked.isin(*modes)
    rows = requests.withColumns({"quality_mode": F.when(known, asked).otherwise("balanced"), "unknown_mode": ~known})
    table = requests.sparkSession.createDataFrame([(k, *v) for k, v in modes.items()], "quality_mode string, d_size int, d_texture int, d_candidates int, d_frames int")
    rows = rows.join(F.broadcast(table), "quality_mode")
    pick = lambda o, d: F.coalesce(c(o), c(d)).cast("long")
    return rows.withColumns({
        "input_size": F.least(pick("o_size", "d_size"), F.lit(1024)), "texture_resolution": F.least(pick("o_texture", "d_texture"), F.lit(2048)),
        "max_candidates": F.least(pick("o_candidates", "d_candidates"), F.lit(limit)), "topk_frames": pick("o_frames", "d_frames"),
    }).drop("d_size", "d_texture", "d_candidates", "d_frames")
