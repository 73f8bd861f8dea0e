"""Ranged file sources, keyed stream folds, the device index, the octree and the checks table function."""

import bz2
import gzip
import hashlib
import json
import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from orbitgrid.operators import calibration, folds, mesh, registry
from orbitgrid.operators.retention import LENIENT, retention_plan
from orbitgrid.sources import files, ranges
from orbitgrid.streaming import streams
from orbitgrid.streaming.keyed import arrival_fold, ordered_fold, with_rocksdb

RND = random.Random(5)


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def glb(doc, tail=b""):
    body = json.dumps(doc).encode()
    body += b" " * (-len(body) % 4)
    return struct.pack("<IIIII", files.MAGIC, 2, 20 + len(body) + len(tail), len(body), files.JSON_CHUNK) + body + tail


GOOD = {"scenes": [{}], "nodes": [{}], "meshes": [{}], "materials": [{}]}


# files by range


def test_glb_heads_read_no_more_than_they_need(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.glb").write_bytes(glb(GOOD, struct.pack("<II", 4096, files.BIN_CHUNK) + b"x" * 4096))
    (tmp_path / "_hidden.glb").write_bytes(b"")
    (tmp_path / "short.glb").write_bytes(b"glTF")
    (tmp_path / "none.glb").write_bytes(b"")
    (tmp_path / "foreign.glb").write_bytes(b"y" * 100_000)
    large = tmp_path / "large.glb"
    with large.open("wb") as f:  # sparse, over the largest value of a row
        f.write(glb(GOOD, struct.pack("<II", (3 << 30) - 8, files.BIN_CHUNK)))
        f.truncate(3 << 30)
    heads = {r.path.rsplit("/", 1)[1]: r for r in ranges.glb_heads(spark, str(tmp_path)).collect()}
    assert set(heads) == {"a.glb", "short.glb", "none.glb", "foreign.glb", "large.glb"}
    body = len(glb(GOOD)) - 20
    assert (heads["a.glb"].bytes_read, heads["a.glb"].size) == (20 + body + 8, 20 + body + 8 + 4096)
    assert heads["large.glb"].bytes_read == 20 + body + 8 and heads["large.glb"].size == 3 << 30 and heads["foreign.glb"].bytes_read == 20
    told = {r.path.rsplit("/", 1)[1]: r for r in files.glb_inventory(spark, str(tmp_path)).collect()}
    assert told["a.glb"].valid and told["large.glb"].issues == ["length_mismatch", "bin_chunk_overflows_file"] and told["large.glb"].nodes == 1
    assert told["none.glb"].issues == ["file_too_small_for_header"] and told["foreign.glb"].issues == ["invalid_magic"]
    assert files.glb_inventory(spark, str(tmp_path / "nothing")).count() == 0


def test_digests_of_files_over_two_gigabytes(spark, tmp_path):
    large = tmp_path / "large.bin"
    with large.open("wb") as f:
        f.write(b"head")
        f.truncate((2 << 30) + 5)
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abc")
    want = hashlib.sha256(b"head")
    zeros = bytes(1 << 20)
    left = (2 << 30) + 1
    while left:
        want.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.copies) for r in files.file_checksums(spark, str(tmp_path)).collect()}
    assert got == {"large.bin": (want.hexdigest(), 1), "a.bin": (hashlib.sha256(b"abc").hexdigest(), 2), "b.bin": (hashlib.sha256(b"abc").hexdigest(), 2)}


@pytest.mark.parametrize("ends", ["\n", ""])
def test_last_lines_of_a_file(tmp_path, ends):
    lines = [f"line {i} " + "é" * (i % 50) for i in range(20_000)]
    path = tmp_path / "x.log"
    path.write_text("\n".join(lines) + ends)
    for n in (1, 7, 900, 30_000):
        got, read = ranges.last_lines(str(path), n)
        assert [x.decode() for x in got] == lines[-n:]
        assert read == path.stat().st_size if n > 20_000 else read <= n * 120 + 4 * ranges.TAIL_BLOCK
    (tmp_path / "long.log").write_text("x" * 5_000_000 + ends)
    assert len(ranges.last_lines(str(tmp_path / "long.log"), 3)[0][0]) == 5_000_000
    (tmp_path / "none.log").write_text("")
    assert ranges.last_lines(str(tmp_path / "none.log"), 3) == ([], 0) and ranges.last_lines(str(path), 0)[0] == []
    (tmp_path / "x.log.gz").write_bytes(gzip.compress(path.read_bytes()))
    (tmp_path / "x.log.bz2").write_bytes(bz2.compress(path.read_bytes()))
    for name in ("x.log.gz", "x.log.bz2"):
        assert [x.decode() for x in ranges.last_lines(str(tmp_path / name), 5)[0]] == lines[-5:]


def test_tail_opens_the_newest_files_only(spark, tmp_path):
    for i in range(12):
        path = tmp_path / f"app-{i:02d}.log"
        text = "".join(json.dumps({"ts": str(k), "level": "WARN", "message": f"{i}-{k}"}) + "\n" for k in range(10)) + ("plain\n" if i == 11 else "")
        path.write_text(text)
        os.utime(path, (1000 - i, 1000 - i))  # by time the other way round
    lines, opened = ranges.tail_lines(spark, str(tmp_path), 25)
    assert lines.count() == 25 and opened == 3
    got = [(r.level, r.message) for r in ranges.tail_log(spark, str(tmp_path), 12).collect()]
    assert got == [("INFO", "plain"), *(("WARN", f"11-{k}") for k in range(9, -1, -1)), ("WARN", "10-9")]
    assert [r.message for r in ranges.tail_log(spark, str(tmp_path), 2, by="modified").collect()] == ["0-9", "0-8"]
    assert ranges.tail_log(spark, str(tmp_path / "none"), 5).count() == 0 and ranges.tail_lines(spark, str(tmp_path), 10**6)[1] == 12


def test_a_missing_registry_is_empty(spark, tmp_path):
    assert [x.count() for x in files.scan_registry(spark, str(tmp_path / "none"))] == [0, 0, 0]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "p1.json").write_text(json.dumps({"assets": {"a1": {"metadata": {"version": "v1"}}}, "audit_logs": []}))
    assets, audit, active = files.scan_registry(spark, str(tmp_path))
    assert rows(assets, "product_id", "asset_id", "version") == [("p1", "a1", "v1")] and audit.count() == active.count() == 0


# streams

FRAMES = "session_id long, event_id long, t string, hist array<double>, bx long, box_y long, bw long, bh long, flow double, sharp double"


def frames(n):
    out = []
    for s in (1, 2):
        for i in range(n):
            hist = None if i % 17 == 5 else [float((i * s) % 5), 1.0, 2.0, float(i % 3)]
            out.append((s, s * 1000 + i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", hist, None if i % 19 == 3 else i % 9, i % 7, 40, 40, None if i % 13 == 1 else float(i % 50), 50.0 + i % 40))
    return out


def stream_of(spark, folder, parts, schema):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02 if i else 0)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.to_timestamp("t")).drop("t")


@pytest.mark.parametrize("name, step", [("redundancy", folds.redundancy_step()), ("adaptive_sampling", folds.sampling_step())])
def test_late_frames_are_folded_in_order(spark, tmp_path, name, step):
    data = frames(90)
    shuffled = [(RND.uniform(0, 20) + int(x[2][11:13]) * 60 + int(x[2][14:16]), x) for x in data]  # up to 20 minutes late
    order = [x for _, x in sorted(shuffled, key=lambda p: p[0])]
    behind = (1, 99, "2023-12-31 00:00:00", None, 1, 1, 40, 40, 9.0, 90.0)
    end = [(9, 9, "2024-01-02 00:00:00", None, 1, 1, 40, 40, 9.0, 90.0)]
    parts = [order[:40], order[40:90], [*order[90:140], behind], order[140:], end]
    stream = stream_of(spark, str(tmp_path / "in"), parts, FRAMES)
    got = streams.run_available(getattr(streams, name)(stream, delay="30 minutes"))
    batch = folds.grouped_fold(spark.createDataFrame(data, FRAMES).withColumn("ts", F.to_timestamp("t")), "session_id", ["ts", "event_id"], step)
    assert rows(got.filter("session_id < 9"), "event_id", "verdict") == rows(batch, "event_id", "verdict")


def test_ordered_folds_go_on_from_their_checkpoint_and_show_their_state(spark, tmp_path):
    schema = "session_id long, event_id long, t string"
    part = lambda ids: [(1, i, f"2024-01-01 00:{i:02d}:00") for i in ids]
    fold = lambda df: ordered_fold(df, "session_id", ["ts", "event_id"], folds.retry_step(3), "n long", delay="5 minutes")
    folder = str(tmp_path / "out")
    streams.run_available(fold(stream_of(spark, str(tmp_path / "in"), [part([1, 3]), part([2, 9])], schema)), folder=folder)
    with with_rocksdb(spark):
        state = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "state").load()
        assert [r.n for r in state.select("value.n").collect()] == [3]  # 1, 2, 3; the watermark has not passed 9
    got = streams.run_available(fold(stream_of(spark, str(tmp_path / "in"), [part([8, 30]), [(1, 5, "2024-01-01 00:03:00")]], schema)), folder=folder)
    assert rows(got, "event_id", "verdict") == [(1, "1:retry"), (2, "2:retry"), (3, "3:retry"), (8, "4:escalated"), (9, "5:escalated")]  # 5 came behind the watermark, 30 waits


def test_ordered_folds_forget_idle_keys(spark, tmp_path):
    schema = "session_id long, event_id long, t string"
    parts = [[(1, 1, "2024-01-01 00:00:00"), (2, 2, "2024-01-01 00:00:00")], [(2, 3, "2024-01-03 00:00:00")], [(2, 4, "2024-01-06 00:00:00")], [(1, 5, "2024-01-06 01:00:00"), (2, 6, "2024-01-06 01:00:00")], [(3, 7, "2024-01-07 00:00:00")]]
    fold = ordered_fold(stream_of(spark, str(tmp_path / "in"), parts, schema), "session_id", ["ts", "event_id"], folds.retry_step(), "n long", expire_hours=84)
    seen = dict(rows(streams.run_available(fold), "event_id", "verdict"))
    assert seen[5] == "1:retry" and seen[4] == "3:retry" and seen[6].startswith("4:")


def test_arrival_folds_expire_by_ttl_and_restart(spark, tmp_path):
    schema = "session_id long, event_id long, t string"
    make = lambda hours: lambda df: arrival_fold(df, "session_id", ["ts", "event_id"], folds.retry_step(), "n long", ttl_hours=hours)
    for hours, last in ((1 / 3600, "1:retry"), (None, "3:retry"), (24.0, "3:retry")):
        inside, out = str(tmp_path / f"in{hours}"), str(tmp_path / f"out{hours}")
        streams.run_available(make(hours)(stream_of(spark, inside, [[(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:00:01")]], schema)), folder=out)
        time.sleep(1.5)
        got = streams.run_available(make(hours)(stream_of(spark, inside, [[(1, 3, "2024-01-01 00:00:02")]], schema)), folder=out)
        assert dict(rows(got, "event_id", "verdict"))[3] == last


def test_old_versions_are_vacuumed(spark, tmp_path):
    folder, schema = str(tmp_path / "out"), "session_id long, seq long, payload string"
    shape = spark.createDataFrame([], schema).schema
    parts = [[(i % 5, i, f"p{i}")] for i in range(25)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01 * (i >= 0))
    reading = None
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.upsert_latest(stream, folder, buckets=4, keep=4)
    assert rows(streams.read_latest(spark, folder, shape)) == [(i, 20 + i, f"p{20 + i}") for i in range(5)]
    assert len(streams._versions(spark, folder)) <= 8
    assert len(os.listdir(f"{folder}/data")) <= 4 + 8  # a version for each bucket, and those since the last vacuum
    reading = streams.read_latest(spark, folder, shape)  # planned on the last version
    spark.createDataFrame([(0, 99, "new")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.upsert_latest(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), folder, buckets=4, keep=4)
    streams.vacuum(spark, folder, 4)
    assert rows(reading) == [(i, 20 + i, f"p{20 + i}") for i in range(5)] and (0, 99, "new") in rows(streams.read_latest(spark, folder, shape))


def test_usage_is_updated_by_key(spark, tmp_path):
    schema = "cache_key string, t string"
    parts = [[("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:01")], [("a", "2024-01-01 00:00:02")], [("c", "2024-01-01 00:00:09"), ("a", "2024-01-01 00:00:07")]]
    usage = streams.key_usage(stream_of(spark, str(tmp_path / "in"), parts, schema))
    streams.upsert_latest(usage, str(tmp_path / "out"), key="cache_key", order="use_count", mode="update")
    got = streams.read_latest(spark, str(tmp_path / "out"), usage.schema)
    assert rows(got.select("cache_key", "use_count", F.second("first_seen"), F.second("last_used"))) == [("a", 3, 2, 7), ("b", 1, 1, 1), ("c", 1, 9, 9)]


# folds


def test_long_sessions_fold_in_linear_time(spark):
    def took(n):
        df = spark.range(n).select(F.lit(1).alias("session_id"), F.col("id").alias("frame_idx"), (F.col("id") % 50).cast("double").alias("flow"), (50.0 + F.col("id") % 40).alias("sharp"), (F.col("id") % 9).alias("bx"), (F.col("id") % 7).alias("box_y"), F.lit(40).alias("bw"), F.lit(40).alias("bh"))
        began = time.perf_counter()
        out = folds.adaptive_sampling(df).groupBy("verdict").count().collect()
        return time.perf_counter() - began, sum(r["count"] for r in out)

    took(1000)
    (short, a), (long, b) = took(4_000), took(32_000)
    assert (a, b) == (4_000, 32_000) and long < 12 * max(short, 0.5)  # eight times the frames


def test_a_name_is_chosen_by_angle_once(spark):
    table = spark.createDataFrame([(1, "a", -180.0, 1.0), (1, "a", 0.0, 1.0), (1, "b", 10.0, 0.5), (1, "a", 90.0, 1.0)], "session_id long, name string, azimuth double, ranking_score double")
    assert rows(folds.angle_selection(table, 4), "name", "azimuth") == [("a", -180.0), ("b", 10.0)]


# joins and rules


def test_device_table_of_any_size_is_joined_by_grams(spark):
    makers, kinds = ["apple", "acme", "zz", "canon", ""], ["iphone", "pro", "x", "", "m-10", "9"]
    devices = [(i, RND.choice(makers), RND.choice(kinds), lo := RND.choice([0.0, 1.5, 5.0, 24.0]), lo + RND.choice([0.0, 2.5, 900.0]), f"m{i}") for i in range(60)]
    asked = [(i, RND.choice(["Apple Inc", "ACME", "zzz", "Canon", None, ""]), RND.choice(["iPhone 12 Pro", "X-9", "M-10", None, "pro"]), RND.choice([None, 0.0, -1.0, 1.5, 4.0, 5.0, 24.0, 26.5, 924.0, 5000.0])) for i in range(400)]
    got = registry.device_db_match(spark.createDataFrame(asked, "event_id long, make string, model string, focal_mm double"), spark.createDataFrame(devices, registry.DEVICE))

    def plain(make, model, focal):
        for _, mk, md, lo, hi, name in devices:
            if mk in (make or "").lower() and md in (model or "").lower() and lo <= focal <= hi:
                return name
        return None

    assert rows(got, "event_id", "device_model") == sorted(((i, plain(a, b, f) if f and f > 0 else None) for i, a, b, f in asked), key=repr)
    many = spark.range(100_000).select(F.col("id").cast("int").alias("row_no"), F.concat(F.lit("maker"), F.col("id") % 997).alias("make"), F.concat(F.lit("model"), F.col("id")).alias("model"), F.lit(1.0).alias("focal_min"), F.lit(9.0).alias("focal_max"), F.col("id").cast("string").alias("camera_model"))
    some = spark.createDataFrame([(1, f"Maker{4242 % 997}", "Model4242", 5.0)], "event_id long, make string, model string, focal_mm double")
    out = registry.device_db_match(some, many)
    assert out.first().device_model == "4242"  # the only row whose parts are both part of the frame's
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_job_folders_go_by_age_alone(spark):
    table = spark.createDataFrame([("j1", "job", 7, "manifest.json", "2024-01-17"), ("j2", "job", 7, "x", "2024-01-18"), ("j3", "job", 7, "x", "2024-01-01")], "folder string, kind string, owner long, name string, mtime string").withColumn("mtime", F.to_timestamp("mtime"))
    none = spark.createDataFrame([], "owner long, status string, publish_state string, last_progress timestamp")
    plan = lambda **k: rows(retention_plan(table, none, F.lit("2024-02-01").cast("timestamp"), **k), "folder", "action", "reason")
    assert plan() == [("j1", "prune", "old_job"), ("j2", "keep", "recent"), ("j3", "prune", "old_job")]
    assert plan(policy=LENIENT) == [("j1", "keep", "recent"), ("j2", "keep", "recent"), ("j3", "prune", "old_job")]


def test_stages_have_durations(spark):
    steps = [(1, 1, "created", 0), (1, 2, "captured", 10), (1, 3, "created", 25), (1, 4, "captured", 26), (2, 5, "failed", 0)]
    history = spark.createDataFrame(steps, "session_id long, event_id long, status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = registry.stage_progress(history, F.timestamp_seconds(F.lit(10_000)))
    assert rows(got, "session_id", "stage", "steps", "duration_s", "longest_s", "current", "stale_s", "stalled") == [
        (1, "captured", 2, 15.0, 15.0, True, 9974.0, True), (1, "created", 2, 11.0, 10.0, False, None, False), (2, "failed", 1, None, None, True, 10000.0, False),
    ]


@pytest.mark.parametrize("most, splits", [(4096, 8), (20, 6), (3, 1)])
def test_dense_clouds_are_split(spark, most, splits):
    near = lambda: [1.0 + RND.uniform(0, 0.024) for _ in range(3)]  # noqa: E731  one cell holds nine tenths
    cloud = [(1, *near()) for _ in range(900)] + [(1, *(RND.uniform(0.9, 1.2) for _ in range(3))) for _ in range(100)] + [(2, 0.0, 0.0, 0.0)] * 50
    asked = [(1, i, i % 3, *(RND.uniform(0.93, 1.1) for _ in range(3))) for i in range(400)] + [(2, i, 0, d, 0.0, 0.0) for i, d in enumerate((0.05, 0.049999, -0.05, -0.0499, 0.0))] + [(3, 1, 0, 0.0, 0.0, 0.0)]
    elements = spark.createDataFrame(asked, "job long, element long, component long, x double, y double, z double")
    want = {}
    for job, _, part, *xyz in asked:
        hit = any(j == job and sum((a - b) ** 2 for a, b in zip(xyz, p, strict=True)) < 0.05 * 0.05 for j, *p in cloud)
        n, m = want.get((job, part), (0, 0))
        want[(job, part)] = (n + hit, m + 1)
    got = mesh.nearest_point_support(elements, spark.createDataFrame(cloud, "job long, x double, y double, z double"), most=most, splits=splits)
    assert {(r.job, r.component): (r.supported, r.total) for r in got.collect()} == want


def test_deviation_of_large_values_does_not_cancel(spark):
    values = spark.createDataFrame([("m", 1e4 + 1e-5 * (i % 2)) for i in range(1000)], "mesh string, v double")
    got = mesh.exact_quantiles(values, ("mesh",), "v", (0.5,)).first()
    assert got.sd == pytest.approx(5e-6, rel=1e-3)


def test_checks_table_function(spark):
    table = spark.createDataFrame([(1, "x", {"a": "pass", "b": "fail"}), (2, "y", {}), (3, "z", None)], "asset_id long, kind string, checks map<string, string>")
    calibration.register_checks(spark, "checks")
    got = spark.sql("SELECT * FROM checks(TABLE({t}))", t=table)
    assert got.columns == ["asset_id", "kind", "check", "status"] and rows(got) == [(1, "x", "a", "pass"), (1, "x", "b", "fail")]
    assert rows(spark.sql("SELECT * FROM checks(TABLE({t}), 'checks')", t=table), "asset_id", "check", "status") == rows(calibration.checks_rows(table))
    with pytest.raises(Exception, match="no map"):
        spark.sql("SELECT * FROM checks(TABLE({t}), 'kind')", t=table).collect()


def test_small_files_are_written_by_their_tasks(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.col("id") % 7, F.lit("/key="), F.col("id"), F.lit("/data.txt")).alias("path"), F.when(F.col("id") > 0, F.concat(F.lit("é"), F.col("id"))).alias("value"))
    want = {f"{i % 7}/key={i}/data.txt": f"é{i}\n" if i else "\n" for i in range(300)}
    for _ in range(2):  # a task that runs again writes the same
        files.write_files(rows.coalesce(1), str(tmp_path))
        assert {str(p.relative_to(tmp_path)): p.read_text("utf-8") for p in tmp_path.rglob("*") if p.is_file()} == want
    read = spark.read.option("recursiveFileLookup", True).text(str(tmp_path))
    assert read.count() == 300 and files.scan_file_inventory(spark, f"file:{tmp_path}", "*.txt").count() == 300


def test_folders_of_registry_pointers_may_nest(spark, tmp_path):
    rows = [("meta/0/key=1/data.txt", '{"assets": {"a": {"is_approved": true}}, "audit_logs": []}'), ("active/3/key=1/data.txt", "a"), ("active/4/key=2/data.txt", "b")]
    files.write_files(spark.createDataFrame(rows, "path string, value string"), str(tmp_path))
    assets, _, active = files.scan_registry(spark, str(tmp_path), "*.txt", F.regexp_extract("path", r"key=([^/]*)/", 1))
    assert [(r.product_id, r.asset_id) for r in assets.collect()] == [("1", "a")] and sorted((r.product_id, r.active_id) for r in active.collect()) == [("1", "a"), ("2", "b")]


def test_hubs_of_components_are_joined_apart(spark):
    rng = random.Random(4)
    pairs = [(0, i) for i in range(1, 60)] + [(999, i) for i in range(100, 160)] + [(rng.randrange(200, 320), rng.randrange(200, 320)) for _ in range(70)] + [(59, 700), (700, 701)]
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(200):
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    for hub in (3, 1000):
        labels = mesh.connected_components(edges, hub=hub)
        got = mesh.sized(labels, hub=hub).collect()
        assert {r.node: r.component for r in got} == least and len(got) == len(least)
        assert all(r.nodes == sum(c == r.component for c in least.values()) for r in got)


def test_timeouts_are_session_windows_in_the_jvm(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", "created"), (1, 2, "2024-01-01 02:00:00", "captured"), (1, 3, "2024-01-01 04:00:00.000001", "validated"), (1, 4, "2024-01-01 04:00:00.000001", "failed"),
            (2, 5, "2024-01-01 01:00:00", "captured"), (3, 6, "2024-01-01 09:00:00", "created"), (3, 7, "2024-01-01 11:00:00", "created"), (4, 8, "2024-01-01 09:00:00", "created")]
    spark.createDataFrame(rows, "session_id long, event_id long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/events")
    schema = spark.read.parquet(f"{tmp_path}/events").schema
    out = streams.timeouts(streams.read_stream(spark, f"{tmp_path}/events", schema), hours=2.0)
    assert "Pandas" not in out._jdf.queryExecution().analyzed().toString()
    got = sorted(tuple(r) for r in streams.run_available(out.withColumn("last_at", F.col("last_at").cast("string"))).collect())
    assert got == [(1, "captured", "2024-01-01 02:00:00"), (2, "captured", "2024-01-01 01:00:00")]
