"""Frame sequences of capture sessions: statistics, runs, gaps and selections.

Frames are rows of (session_id, frame_idx, ...); every window partitions by session and orders
by frame_idx. A session is bounded by its longest video, so a window's partition fits a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION, ORDER = "session_id", "frame_idx"


def _ordered(*more: str):
    return Window.partitionBy(SESSION).orderBy(ORDER, *more)


def _whole():
    return Window.partitionBy(SESSION)


def _long(c: Column) -> Column:
    return c.cast("long")


def blur_stats(frames: DataFrame, col: str = "sharpness") -> DataFrame:
    """Frames with their session's median, MAD and modified z-score; a MAD below 1e-9 gives z = 0."""
    w = _whole()
    out = frames.withColumn("median", F.median(col).over(w))
    out = out.withColumn("mad", F.median(F.abs(F.col(col) - F.col("median"))).over(w))
    z = 0.6745 * (F.col(col) - F.col("median")) / F.col("mad")
    return out.withColumn("z", F.when(F.col("mad") < 1e-9, 0.0).otherwise(z))


def islands(frames: DataFrame, flag: Column, key: str = SESSION, order: str = ORDER) -> DataFrame:
    """Rows where `flag` holds, with `island` equal within a run of consecutive ones."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = frames.withColumns({"__flag": flag, "__n": F.row_number().over(w)})
    return numbered.filter("__flag").withColumn("island", F.col("__n") - F.row_number().over(w)).drop("__flag", "__n")


def blur_bursts(frames: DataFrame, z: float = -1.5, min_len: int = 3, col: str = "sharpness") -> DataFrame:
    """Runs of at least `min_len` frames whose z-score is below `z`, and their share of the session."""
    scored = blur_stats(frames, col)
    runs = islands(scored.withColumn("frames", F.count("*").over(_whole())), F.col("z") < z)
    bursts = runs.groupBy(SESSION, "island").agg(
        F.min(ORDER).alias("start_index"), F.max(ORDER).alias("end_index"), F.count("*").alias("n"), F.median(col).alias("median_score"), F.max("frames").alias("frames")
    )
    kept = bursts.filter(F.col("n") >= min_len)
    ratio = F.sum("n").over(Window.partitionBy(SESSION)) / F.col("frames")
    return kept.withColumn("burst_ratio", ratio).drop("island", "frames")


def elevation_bucket(cy: Column, low_below: float = 0.40, top_above: float = 0.65) -> Column:
    return F.when(cy < low_below, "low").when(cy > top_above, "top").otherwise("mid")


def elevation_distribution(frames: DataFrame) -> DataFrame:
    """Counts and shares of frames by image elevation band, and the share of the three bands seen."""
    bands = frames.groupBy(SESSION, elevation_bucket(F.col("cy")).alias("bucket")).count()
    out = bands.groupBy(SESSION).pivot("bucket", ["low", "mid", "top"]).agg(F.first("count")).na.fill(0)
    total = F.col("low") + F.col("mid") + F.col("top")
    seen = sum((F.col(b) > 0).cast("int") for b in ("low", "mid", "top"))
    return out.withColumns({f"{b}_ratio": F.col(b) / total for b in ("low", "mid", "top")} | {"multi_height_score": seen / 3.0})


def normalized_x(frames: DataFrame) -> DataFrame:
    """Frames with cx in 0-1: a missing one counts as 0.5; pixel values (over 1.5) are divided by their maximum."""
    x = F.coalesce("cx", F.lit(0.5))
    top = F.max(x).over(_whole())
    return frames.withColumn("x", F.when(top > 1.5, x / F.greatest(top, F.lit(1.0))).otherwise(x))


def _steps(frames: DataFrame) -> DataFrame:
    return normalized_x(frames).withColumn("step", F.abs(F.col("x") - F.lag("x").over(_ordered())))


def orbit_progress(frames: DataFrame) -> DataFrame:
    """Sum of horizontal centroid steps, 1 at most."""
    return _steps(frames).groupBy(SESSION).agg(F.least(F.lit(1.0), F.coalesce(F.sum("step"), F.lit(0.0))).alias("progress"))


def sign_changes(frames: DataFrame, buckets: int = 8) -> DataFrame:
    """How often the centroid crosses its mean (zero is a sign of its own), and azimuth buckets filled."""
    signed = normalized_x(frames).withColumn("s", F.signum(F.round(F.col("x") - F.avg("x").over(_whole()), 12)))
    turned = signed.withColumn("turn", F.col("s") != F.lag("s").over(_ordered()))
    out = turned.groupBy(SESSION).agg(F.count_if("turn").alias("changes"))
    filled = _long(F.least(F.lit(buckets), F.greatest(F.lit(1), F.col("changes") + 1)))
    return out.withColumn("buckets_filled", filled).withColumn("coverage_ratio", F.col("buckets_filled") / buckets)


def static_runs(frames: DataFrame, eps: float = 0.01) -> DataFrame:
    """Longest run of steps below `eps`; 0 without one."""
    steps = _steps(frames)
    runs = islands(steps.filter("step is not null"), F.col("step") < eps).groupBy(SESSION, "island").count()
    longest = runs.groupBy(SESSION).agg(F.max("count").alias("n"))
    return frames.select(SESSION).distinct().join(longest, SESSION, "left").select(SESSION, F.coalesce("n", F.lit(0)).cast("long").alias("longest"))


def sequence_jumps(frames: DataFrame, limit: float = 0.15, weak: float = 0.2) -> DataFrame:
    """Steps of the centroid longer than `limit`, their share of all steps, and whether continuity is weak."""
    w = _ordered()
    dist = F.sqrt((F.col("cx") - F.lag("cx").over(w)) ** 2 + (F.col("cy") - F.lag("cy").over(w)) ** 2)
    out = frames.withColumn("d", F.round(dist, 12)).groupBy(SESSION).agg(F.count_if(F.col("d") > limit).alias("jumps"), F.count("*").alias("n"))
    return out.select(SESSION, "jumps", (F.col("jumps") / F.greatest(F.lit(1), F.col("n") - 1)).alias("jump_ratio")).withColumn("weak", F.col("jump_ratio") > weak)


def geometric_orbit(frames: DataFrame, gap: float = 0.25, limit: float = 0.15, spread: float = 0.25) -> DataFrame:
    """Span and gaps of distinct centroid positions with hard and soft codes; more than two gaps are one code."""
    xs = frames.select(SESSION, "cx").distinct()
    w = Window.partitionBy(SESSION).orderBy("cx")
    pairs = xs.withColumn("next", F.lead("cx").over(w)).withColumns({"g": F.round(F.col("next") - F.col("cx"), 12), "mid": F.round((F.col("next") + F.col("cx")) / 2, 12)})
    wide = F.col("g") > gap
    gaps = pairs.groupBy(SESSION).agg(
        (F.max("cx") - F.min("cx")).alias("span_x"), F.coalesce(F.max("g"), F.lit(0.0)).alias("max_gap"), F.count_if(wide).alias("n"),
        F.count_if(wide & (F.col("mid") < 0.3)).alias("left"), F.count_if(wide & (F.col("mid") > 0.7)).alias("right"),
        F.count_if(wide & F.col("mid").between(0.3, 0.7)).alias("center"),
    )
    n = F.col("n")
    hard = F.when(n > 2, F.array(F.lit("LOW_HORIZONTAL_COVERAGE"))).otherwise(F.array_compact(F.array(
        F.when(F.col("left") > 0, "ORBIT_GAP_LEFT"), F.when(F.col("right") > 0, "ORBIT_GAP_RIGHT"), F.when(F.col("center") > 0, "LOW_HORIZONTAL_COVERAGE"))))
    joined = gaps.join(sequence_jumps(frames, limit).select(SESSION, "jump_ratio", "weak"), SESSION)
    soft = F.array_compact(F.array(F.when(F.round("span_x", 12) < spread, "INSUFFICIENT_VIEWPOINT_SPREAD"), F.when(F.col("weak"), "WEAK_ORBIT_CONTINUITY")))
    return joined.select(SESSION, "span_x", "max_gap", "jump_ratio", hard.alias("hard_codes"), soft.alias("soft_codes"))


def temporal_zscore(frames: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Distance of each feature from its session's mean in population deviations; 0 where they are 0.001 or less."""
    w = _whole()
    out = {}
    for c in cols:
        sd = F.stddev_pop(c).over(w)
        out[f"{c}_z"] = F.when(sd > 0.001, F.abs(F.col(c) - F.avg(c).over(w)) / sd).otherwise(0.0)
    return frames.withColumns(out)


def rejection_counts(frames: DataFrame, verdicts: tuple[str, ...]) -> DataFrame:
    """Frames of each session by verdict (column `verdict`)."""
    return frames.groupBy(SESSION).pivot("verdict", list(verdicts)).count().na.fill(0)


def even_sample(df: DataFrame, key: str, order: str, k: int = 10) -> DataFrame:
    """Items at floor(i n / k), i < k, of each key; all items where there are k or fewer."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    ranked = df.withColumns({"__r": r, "__n": F.count("*").over(Window.partitionBy(key))})
    i = F.ceil(F.col("__r") * k / F.col("__n"))
    return ranked.filter((F.col("__n") <= k) | ((i < k) & (F.floor(i * F.col("__n") / k) == F.col("__r")))).drop("__r", "__n")


def shape_mismatch(frames: DataFrame, k: int = 10) -> DataFrame:
    """Of k evenly spaced frames: missing ones (null height) and the share that is not of the most frequent shape."""
    sample = even_sample(frames, SESSION, ORDER, k)
    shapes = sample.groupBy(SESSION, "h", "w").agg(F.count("*").alias("n"))
    known = F.when(F.col("h").isNotNull(), F.col("n"))
    out = shapes.groupBy(SESSION).agg(F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.sum(known).alias("n"), F.max(known).alias("most"))
    mismatch = F.coalesce(F.col("n") - F.col("most"), F.lit(0))
    return out.select(SESSION, "missing", mismatch.alias("mismatch"), F.coalesce(mismatch / F.col("n"), F.lit(0.0)).alias("mismatch_ratio"))


def extraction_summary(frames: DataFrame) -> DataFrame:
    """Selected and rejected frames, mean sharpness of the selected ones and the widest gap between them."""
    w = Window.partitionBy(SESSION, "accepted").orderBy(ORDER)
    gap = F.when(F.col("accepted"), F.col(ORDER) - F.lag(ORDER).over(w))
    return frames.withColumn("gap", gap).groupBy(SESSION).agg(
        F.count_if("accepted").alias("selected"), F.count_if(~F.col("accepted")).alias("rejected"),
        F.coalesce(F.avg(F.when(F.col("accepted"), F.col("sharpness"))), F.lit(0.0)).alias("mean_sharpness"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"),
    )


def stride_sample(frames: DataFrame, rate: int = 15) -> DataFrame:
    return frames.filter(F.pmod(F.col(ORDER), F.lit(rate)) == 0)


def topk_sharp_frames(frames: DataFrame, k: int = 5, spacing: int = 15) -> DataFrame:
    """The k sharpest of frames sampled every max(spacing, n // max(3k, 15)); ties go to the earlier frame."""
    n = F.count("*").over(_whole())
    step = F.greatest(F.lit(max(1, spacing)), F.floor(n / max(3 * k, 15)))
    sampled = frames.withColumn("__step", step).filter(F.pmod(F.col(ORDER), F.col("__step")) == 0).drop("__step")
    rank = F.row_number().over(Window.partitionBy(SESSION).orderBy(F.col("sharpness").desc(), ORDER))
    return sampled.withColumn("sharp_rank", _long(rank)).filter(F.col("sharp_rank") <= k)


def best_frame(frames: DataFrame, n: int = 10) -> DataFrame:
    """The frame with the highest score among indices i * max(1, total // (n + 1)), i = 1..n; the first on ties."""
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(_whole()) / (n + 1)))
    picked = frames.withColumn("__s", step).filter((F.pmod(F.col(ORDER), F.col("__s")) == 0) & (F.col(ORDER) > 0) & (F.col(ORDER) <= n * F.col("__s")))
    best = picked.groupBy(SESSION).agg(F.max_by(F.struct(ORDER, "score"), F.struct("score", -F.col(ORDER))).alias("b"))
    return best.select(SESSION, f"b.{ORDER}", "b.score")


def balanced_selection(frames: DataFrame, minima: tuple[int, int, int] = (6, 10, 6), total: int = 80, cap_ratio: float = 0.55) -> DataFrame:
    """Frames kept by band quotas: minima first, then by quality up to `total`, no band over its cap (unknown has none)."""
    quality = F.col("sharpness") * F.greatest(F.col("confidence"), F.lit(0.1))
    band_order = F.expr("array_position(array('low', 'mid', 'top', 'unknown'), bucket)")
    cap = max(1, int(total * cap_ratio))
    least = F.when(F.col("bucket") == "low", minima[0]).when(F.col("bucket") == "mid", minima[1]).when(F.col("bucket") == "top", minima[2]).otherwise(0)
    in_band = F.row_number().over(Window.partitionBy(SESSION, "bucket").orderBy(F.col("quality").desc(), ORDER))
    ranked = frames.withColumn("quality", quality).withColumns({"__band": band_order, "__r": in_band}).withColumn("reserved", F.col("__r") <= least)
    slots = total - F.count_if("reserved").over(_whole())
    eligible = ~F.col("reserved") & ((F.col("bucket") == "unknown") | (F.col("__r") <= cap))
    ranked = ranked.withColumns({"__slots": slots, "__ok": eligible})
    at = F.row_number().over(Window.partitionBy(SESSION, "__ok").orderBy(F.col("quality").desc(), "__band", ORDER))
    return ranked.withColumn("__at", at).filter(F.col("reserved") | (F.col("__ok") & (F.col("__at") <= F.col("__slots")))).drop("__band", "__r", "__slots", "__ok", "__at")


def texture_budget(frames: DataFrame, n: int = 20, fallback: int = 5) -> DataFrame:
    """Accepted frames beyond the n best by ranking are rejected (budget_limit); with none accepted the sharpest few are taken."""
    top = F.row_number().over(Window.partitionBy(SESSION, "accepted").orderBy(F.col("ranking_score").desc(), ORDER))
    sharp = F.row_number().over(Window.partitionBy(SESSION).orderBy(F.col("sharpness").desc(), ORDER))
    out = frames.withColumns({"__top": top, "__sharp": sharp, "__any": F.max(F.col("accepted").cast("int")).over(_whole())})
    taken = F.when(F.col("__any") == 1, F.col("accepted") & (F.col("__top") <= n)).otherwise(F.col("__sharp") <= fallback)
    reason = F.when(F.col("accepted") & ~taken, "budget_limit").when((F.col("__any") == 0) & taken, "fallback")
    return out.withColumns({"selected": taken, "budget_reason": reason}).drop("__top", "__sharp", "__any")


def selection_diff(frames: DataFrame, kept: DataFrame, keys: tuple[str, ...] = (SESSION, ORDER)) -> DataFrame:
    """Frames that are not among the kept ones."""
    return frames.join(kept.select(*keys), list(keys), "left_anti")
