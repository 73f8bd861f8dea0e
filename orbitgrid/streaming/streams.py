"""Sessions, telemetry and manifests as streams.

`run_available` drives a stream over what is there now and gives the result as a table in
the folder that all executors share; a long-running job would use the same DataFrames with its
own sink. Results of windows appear once the watermark has passed their end; rows behind the
watermark are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.operators.folds import lifecycle_step, redundancy_step, retry_step, sampling_step
from orbitgrid.operators.registry import PROCESSING, TRANSITIONS
from orbitgrid.sources.checkpoints import shared_folder
from orbitgrid.streaming.keyed import Step, arrival_fold, ordered_fold, with_rocksdb

c = F.col


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet file, or a folder of them, as a stream. A pattern, for the source takes a plain path for a folder."""
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All results of a stream over its present input; a run with the `folder` of an earlier one goes on from there.

    A batch without rows follows, in which the watermark moves on, but for folds in processing time: they would
    ask for such batches without end.
    """
    spark = stream.sparkSession
    out = folder or shared_folder(spark, "stream")
    idle = not re.search("TransformWithState.*ProcessingTime", stream._jdf.queryExecution().analyzed().toString())
    with with_rocksdb(spark, idle):
        query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def lifecycle(events: DataFrame, transitions: dict = TRANSITIONS, ttl_hours: float | None = 24 * 60) -> DataFrame:
    """Each status event (session_id, event_id, ts, status) with `verdict`: ok, an illegal step, or after a terminal state.

    A session without events for `ttl_hours` of processing time is forgotten.
    """
    return arrival_fold(events, "session_id", ["ts", "event_id"], lifecycle_step(transitions), "status string", ttl_hours=ttl_hours)


def retries(errors: DataFrame, limit: int = 3, ttl_hours: float | None = 24 * 60) -> DataFrame:
    """Each recoverable error with its count and whether it is escalated; a session without errors for `ttl_hours` of processing time is forgotten."""
    out = arrival_fold(errors, "session_id", ["ts", "event_id"], retry_step(limit), "n long", ttl_hours=ttl_hours)
    return out.select("session_id", "event_id", F.substring_index("verdict", ":", 1).cast("long").alias("count"), (F.substring_index("verdict", ":", -1) == "escalated").alias("escalated"))


def _judged(frames: DataFrame, step: Step, state: str, delay: str | None) -> DataFrame:
    order = ["ts", "event_id"]
    return arrival_fold(frames, "session_id", order, step, state, ttl_hours=None) if delay is None else ordered_fold(frames, "session_id", order, step, state, delay=delay)


def adaptive_sampling(frames: DataFrame, delay: str | None = "10 minutes", **thresholds: float) -> DataFrame:
    """Frames with their sampling verdict in order of event time, once the watermark has passed them.

    Without a delay no frame waits: each micro-batch is judged whole, in order of event time, so that a stream over what
    is there now (`run_available`, one micro-batch) leaves no frame out.
    """
    return _judged(frames, sampling_step(**thresholds), "box array<double>, since long", delay)


def redundancy(frames: DataFrame, delay: str | None = "10 minutes", **thresholds: float) -> DataFrame:
    """Frames compared with the last kept one in order of event time, once the watermark has passed them; without a delay, as in `adaptive_sampling`."""
    return _judged(frames, redundancy_step(**thresholds), "hist array<double>, box array<double>, kept long", delay)


def timeouts(events: DataFrame, hours: float = 2.0, delay: str = "0 seconds") -> DataFrame:
    """(session_id, status, last_at) whenever a session in a processing state made no progress for more than `hours` of event time.

    Events that are no further apart form one session window, which shows with its last status when the watermark, whole
    milliseconds, has passed its end; windows merge in the JVM and a closed one is forgotten.
    """
    gap = f"{round(hours * 3_600_000_000)} microseconds"
    late = events.withWatermark("ts", f"{delay} 1 millisecond")  # an end that the watermark just reaches is not passed
    runs = late.groupBy("session_id", F.session_window("ts", gap))
    last = F.max(F.struct("ts", "event_id", "status"))
    return runs.agg(last.alias("last")).select("session_id", "last.status", c("last.ts").alias("last_at")).filter(c("status").isin(*PROCESSING))


def telemetry_counts(log: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Failures and actions by window, component and failure code."""
    w = F.window("ts", size)
    out = log.withWatermark("ts", delay).groupBy(w, "event", "component", "failure_code").agg(F.count("*").alias("n"))
    return out.select(c("window.start").alias("start"), "event", "component", "failure_code", "n")


def windowed_counts(log: DataFrame, kind: str = "tumbling", size: str = "1 hour", slide: str = "30 minutes", gap: str = "5 minutes", delay: str | None = "10 minutes", by: str = "component") -> DataFrame:
    """Counts over tumbling, sliding or session windows; no delay where the log has its watermark already."""
    window: dict[str, Column] = {"tumbling": F.window("ts", size), "sliding": F.window("ts", size, slide), "session": F.session_window("ts", gap)}
    column = window[kind].alias("w")
    out = (log.withWatermark("ts", delay) if delay else log).groupBy(column, by).agg(F.count("*").alias("n"))
    return out.select(F.lit(kind).alias("kind"), c("w.start").alias("start"), c("w.end").alias("end"), by, "n")


def without_repeats(log: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose table of buckets is complete, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/buckets/v*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)


def _buckets(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, int]:
    """The version that holds each bucket, as of the last version (before `below`)."""
    known = [v for v in _versions(spark, folder) if below is None or v < below]
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{folder}/buckets/v{known[-1]}").collect()} if known else {}


def _read_buckets(spark: SparkSession, folder: str, schema: T.StructType, at: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/data/v{v}/bucket={b}" for b, v in at.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, folder: str, keep: int = 10) -> int:
    """Delete what only versions before the last `keep` name; returns how many folders went.

    A reader that began with one of the last `keep` versions still finds all its buckets.
    """
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = jvm.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = _versions(spark, folder)
    kept = versions[-keep:]
    if len(versions) <= keep:
        return 0
    tables = spark.read.schema("bucket int, version long").parquet(*(f"{folder}/buckets/v{v}" for v in kept)).distinct().collect()  # buckets x keep at most
    used, gone = {(r.version, r.bucket) for r in tables}, 0
    for status in system.globStatus(jvm.Path(f"{folder}/data/v*/bucket=*")) or []:
        path = status.getPath()
        at = int(path.getParent().getName()[1:]), int(path.getName().split("=")[1])
        if at not in used and at[0] < kept[-1]:
            gone += bool(system.delete(path, True))
    held = {v for v, _ in used}
    for v in versions[:-keep]:
        gone += bool(system.delete(jvm.Path(f"{folder}/buckets/v{v}"), True))
    for status in system.globStatus(jvm.Path(f"{folder}/data/v*")) or []:
        v = int(status.getPath().getName()[1:])
        if v not in held and v < kept[0]:
            gone += bool(system.delete(status.getPath(), True))
    return gone


def upsert_latest(stream: DataFrame, folder: str, key: str = "session_id", order: str = "seq", buckets: int = 64, mode: str = "append", keep: int = 10) -> None:
    """Keep the newest row of each key in `folder`: a micro-batch rewrites only the buckets that its keys fall in.

    Each version is a folder with the buckets that it touched and a small table that names the version of
    every bucket. It is read after it is complete, so a repeated micro-batch, which starts from the version
    before it, doubles nothing, and a stopped stream goes on from its last version. Every `keep` micro-batches,
    what the last `keep` versions do not name is deleted (`vacuum`), so storage does not grow with the batches.
    """
    schema = stream.schema
    others = [f.name for f in schema.fields if f.name != key]

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = _buckets(spark, folder, epoch)
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` at most
        old = _read_buckets(spark, folder, schema, {b: v for b, v in at.items() if b in touched})
        rows = new.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        newest = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*others), order).alias("m")).select("bucket", key, "m.*")
        newest.select("bucket", *schema.names).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/v{epoch}")
        spark.createDataFrame(list((at | dict.fromkeys(touched, epoch)).items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets/v{epoch}")
        new.unpersist()
        if epoch % keep == keep - 1:
            vacuum(spark, folder, keep)

    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def read_latest(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The newest row of each key, as of the last complete version."""
    return _read_buckets(spark, folder, schema, _buckets(spark, folder))


def key_usage(lookups: DataFrame, key: str = "cache_key") -> DataFrame:
    """Uses, first and last time of each key, updated as lookups arrive: in update mode, a micro-batch gives the keys that it touched (`upsert_latest` by use_count keeps them)."""
    return lookups.groupBy(key).agg(F.count("*").alias("use_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_used"))
