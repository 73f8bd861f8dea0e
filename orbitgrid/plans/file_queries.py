"""Queries of file sources and writers: each writes files of the given tables' rows with Spark and reads them back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.plans.registry import query
from orbitgrid.sources import files as src
from orbitgrid.sources import ranges
from orbitgrid.sources.checkpoints import shared_folder

c = F.col


def written(t, df, kind="text", label="files", **options):
    """A fresh shared folder with `df` written to it."""
    folder = shared_folder(t.spark, label)
    df.write.options(**options).format(kind).save(folder)
    return folder


def place(key, suffix=".txt", below=""):
    """Where the file of a key goes: a folder of its own, below one of 256 that are listed side by side."""
    key = F.coalesce(key, F.lit("__HIVE_DEFAULT_PARTITION__"))
    return F.concat(F.lit(below), F.pmod(F.xxhash64(key), F.lit(256)).cast("string"), F.lit("/key="), key, F.lit(f"/data{suffix}"))


def documents(t, df, label):
    """Write one file for each row of `df` (key, value)."""
    folder = shared_folder(t.spark, label)
    src.write_files(df.select(place(c("key").cast("string")).alias("path"), "value"), folder)
    return folder


STATUS = "CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'Captured' WHEN 'click' THEN 'reconstructed' WHEN 'purchase' THEN 'validated' ELSE 'failed' END"


@query("scan_sessions", """SELECT user_id::varchar AS session_id, lower(arg_max(CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'Captured' WHEN 'click' THEN 'reconstructed' WHEN 'purchase' THEN 'validated' ELSE 'failed' END, (ts, event_id))) AS status, count(*) AS steps FROM events WHERE user_id % 10 > 0 GROUP BY user_id""")
def _(t):
    step = F.struct("ts", "event_id", F.struct(c("ts").cast("string").alias("timestamp"), F.expr(STATUS).alias("to_status")).alias("e"))
    docs = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("h"))
    doc = F.to_json(F.struct(c("user_id").cast("string").alias("session_id"), F.element_at("h", -1)["e"]["to_status"].alias("status"), F.transform("h", lambda x: x["e"]).alias("history")))
    value = F.when(c("user_id") % 10 == 0, F.lit('{"session_id": ')).otherwise(doc)
    folder = documents(t, docs.select(c("user_id").alias("key"), value.alias("value")), "sessions")
    good, _ = src.scan_sessions(t.spark, folder, "*.txt")
    return good.select("session_id", "status", F.size("history").cast("long").alias("steps"))


def key_of(path="path"):
    """The key of a file that Spark wrote below key=<key>/."""
    return F.regexp_extract(path, r"key=([^/]*)/", 1)


def line(col, n):
    """The file that a row goes to: ids in ranges of n, so that files grow in number and not in size."""
    return F.floor(c(col) / n)


@query("scan_registry", "SELECT (product_id // 20)::varchar AS product_id, asset_id::varchar AS asset_id, 'v' || m AS version, approved AS is_approved, max(asset_id) OVER (PARTITION BY product_id // 20) = asset_id AS is_active, 1 AS logs FROM assets")
def _(t):
    rows = t.assets.withColumn("product_id", line("product_id", 20))  # a registry is one file for each product line
    info = F.struct(F.struct(F.concat(F.lit("v"), c("m").cast("string")).alias("version")).alias("metadata"), c("approved").alias("is_approved"), c("created_at"))
    entry = F.map_from_entries(F.collect_list(F.struct(c("asset_id").cast("string"), info)))
    logs = F.collect_list(F.struct(c("asset_id").cast("string").alias("asset_id"), c("created_at").alias("timestamp"), F.lit("registered").alias("action")))
    docs = rows.groupBy("product_id").agg(F.to_json(F.struct(entry.alias("assets"), logs.alias("audit_logs"))).alias("value"), F.max("asset_id").cast("string").alias("active"))
    folder, key = shared_folder(t.spark, "registry"), c("product_id").cast("string")
    both = F.array(F.struct(place(key, below="meta/").alias("path"), "value"), F.struct(place(key, below="active/").alias("path"), c("active").alias("value")))
    src.write_files(docs.select(F.inline(both)), folder)
    assets, audit, active = src.scan_registry(t.spark, folder, "*.txt", key_of())
    out = assets.join(active, "product_id").join(audit.groupBy("product_id", "asset_id").agg(F.count("*").alias("logs")), ["product_id", "asset_id"])
    return out.select("product_id", "asset_id", "version", "is_approved", (c("asset_id") == c("active_id")).alias("is_active"), "logs")


MANIFEST = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("payload", T.StringType())])


@query("append_manifest_log", "SELECT session_id, seq FROM manifests")
def _(t):
    folder, rows = shared_folder(t.spark, "manifests"), t.manifests.select("session_id", "seq", "payload", "k")
    for part in (rows.filter("k % 2 = 0"), rows.filter("k % 2 = 1")):
        src.append_manifest_log(part.drop("k"), folder)
    return src.scan_manifest_log(t.spark, folder, MANIFEST).select("session_id", "seq")


@query("scan_manifest_log", "SELECT session_id, seq, payload FROM manifests WHERE k % 7 > 2")
def _(t):
    good = F.to_json(F.struct("session_id", "seq", "payload"))
    value = F.when(c("k") % 7 == 0, "").when(c("k") % 7 == 1, '{"session_id": 5, "seq"').when(c("k") % 7 == 2, F.to_json(F.struct("seq", "payload"))).otherwise(good)
    return src.scan_manifest_log(t.spark, written(t, t.manifests.select(value.alias("value"))), MANIFEST)


LINE = "CASE WHEN k % 4 = 0 THEN concat('plain ', cast(event_id AS string)) ELSE to_json(named_struct('ts', cast(event_id AS string), 'level', upper(event_type), 'message', concat('m', cast(event_id AS string)))) END"


@query("scan_log_lines", "SELECT CASE WHEN k % 4 > 0 THEN event_id::varchar END AS ts, CASE WHEN k % 4 = 0 THEN 'INFO' ELSE upper(event_type) END AS level, CASE WHEN k % 4 = 0 THEN 'plain ' ELSE 'm' END || event_id AS message FROM events_k")
def _(t):
    return src.scan_log_lines(t.spark, written(t, t.events_k.select(F.expr(LINE).alias("value")))).select("ts", "level", "message")


@query("log_tail", "SELECT CASE WHEN k % 4 = 0 THEN 'plain ' ELSE 'm' END || event_id AS message FROM events_k ORDER BY event_id DESC LIMIT 50")
def _(t):
    ordered = t.events_k.repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.expr(LINE).alias("value"))  # log files in the order of their names
    return ranges.tail_log(t.spark, written(t, ordered), 50, pattern="*.txt").select("message")


@query("scan_evidence", "WITH p AS (SELECT asset_id // 1000 AS job, sum(m)::bigint % 7 AS m FROM assets GROUP BY 1) SELECT CASE m WHEN 0 THEN 'unknown' WHEN 1 THEN 'production_ready' ELSE 'failed' END AS status, count(*) AS jobs, sum(m)::bigint AS dense FROM p WHERE m <> 6 GROUP BY 1")
def _(t):
    rows = t.assets.groupBy(line("asset_id", 1000).alias("asset_id")).agg((F.sum("m") % 7).alias("m"))  # one report for each job
    status = F.when(c("m") == 0, None).when(c("m") == 1, "production_ready").otherwise("failed")
    doc = F.to_json(F.struct(F.struct(status.alias("final_status"), c("m").alias("dense_image_count")).alias("delivery_checklist")))
    folder = documents(t, rows.select(c("asset_id").alias("key"), F.when(c("m") == 6, "{bad").otherwise(doc).alias("value")), "evidence")
    return src.scan_evidence(t.spark, folder, "*.txt").groupBy("status").agg(F.count("*").alias("jobs"), F.sum("dense").alias("dense"))


@query("scan_fixtures", "SELECT fixture_id::varchar AS fixture_id, expected AS expected_action, R[coverage_score] AS coverage_score FROM fixtures")
def _(t):
    doc = F.struct(c("fixture_id").cast("string").alias("fixture_id"), c("expected").alias("expected_action"), F.struct("coverage_score").alias("coverage_report"))
    folders = []
    for part in (0, 1):
        rows = t.fixtures.filter(c("fixture_id") % 2 == part).groupBy(line("fixture_id", 200).alias("key")).agg(F.to_json(F.collect_list(doc)).alias("value"))
        folders.append(documents(t, rows, "fixtures"))
    out = src.scan_fixtures(t.spark, [*folders, f"{folders[0]}-absent"], "*.txt")
    return out.select("fixture_id", "expected_action", "coverage_report.coverage_score")


def small_files(t):
    """Texts of all documents, a file for every 100 ids."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: F.regexp_replace(x["text"], "[\\r\\n]", " ")), "|")
    return documents(t, t.documents.groupBy(line("doc_id", 100).alias("key")).agg(text.alias("value")), "files")


WHOLE = "WITH w AS (SELECT doc_id // 100 AS k, string_agg(regexp_replace(text, '[\\r\\n]', ' ', 'g'), '|' ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY 1)"


@query("scan_file_inventory", f"{WHOLE} SELECT k::varchar AS key, '.txt' AS suffix, strlen(t)::bigint AS size FROM w")
def _(t):
    return src.scan_file_inventory(t.spark, small_files(t), "*.txt").select(key_of().alias("key"), "suffix", "size")


@query("file_checksums", f"{WHOLE} SELECT k::varchar AS key, sha256(t) AS sha256, count(*) OVER (PARTITION BY sha256(t)) AS copies FROM w")
def _(t):
    return src.file_checksums(t.spark, small_files(t), "*.txt").select(key_of().alias("key"), "sha256", "copies")


@query("ingest_sparse_poses", "SELECT session_id || '-' || camera // 500 AS session_id, 'f' || camera AS name, camera AS camera, R[qvec[1]] AS qw, R[tvec[3]] AS tz FROM poses")
def _(t):
    one = F.concat_ws("\n", F.concat_ws(" ", c("camera").cast("string"), *(c("qvec")[i].cast("string") for i in range(4)), *(c("tvec")[i].cast("string") for i in range(3)), c("camera").cast("string"), F.concat(F.lit("f"), c("camera").cast("string"))), F.lit("1 2 3"))
    docs = t.poses.groupBy(F.concat_ws("-", c("session_id").cast("string"), line("camera", 500).cast("string")).alias("key")).agg(F.concat(F.lit("# images\n\n"), F.concat_ws("\n", F.collect_list(one))).alias("value"))
    poses = src.ingest_sparse_poses(t.spark, documents(t, docs, "poses"), pattern="*.txt")
    return poses.select(F.regexp_extract("session_id", "key=(.*)", 1).alias("session_id"), "name", "camera", c("qvec")[0].alias("qw"), c("tvec")[2].alias("tz"))


@query("mesh_text_counts", "SELECT mesh::varchar AS mesh, count(DISTINCT v) AS vertices, 2 AS faces FROM vertices GROUP BY mesh UNION ALL SELECT mesh || 'p', count(DISTINCT v), 7 FROM vertices GROUP BY mesh")
def _(t):
    lines = F.concat_ws("\n", F.collect_list(F.concat_ws(" ", F.lit("v"), c("x").cast("string"), c("y").cast("string"), c("z").cast("string"))), F.lit("vn 0 0 1\nf 1 2 3\nf 2 3 4"))
    ply = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.count("*").cast("string"), F.lit("\nproperty float x\nelement face 7\nend_header\n0 0 0"))
    docs = t.vertices.groupBy("mesh").agg(lines.alias("obj"), ply.alias("ply"))
    folder, key = shared_folder(t.spark, "meshes"), c("mesh").cast("string")
    both = F.array(F.struct(place(key, ".obj").alias("path"), c("obj").alias("value")), F.struct(place(F.concat(key, F.lit("p")), ".ply").alias("path"), c("ply").alias("value")))
    src.write_files(docs.select(F.inline(both)), folder)
    counts = src.mesh_text_counts(t.spark, folder)
    return counts.select(key_of("file").alias("mesh"), "vertices", "faces")


@query("glb_inventory", """WITH g AS (SELECT asset_id // 100 AS k, count(*) AS n FROM assets GROUP BY 1) SELECT k::varchar AS key, CASE k % 5 WHEN 0 THEN 'invalid_magic' WHEN 1 THEN 'length_mismatch' WHEN 2 THEN 'missing_meshes' WHEN 3 THEN 'json_parse_failed' ELSE '' END AS issues, k % 5 = 4 AS valid,
CASE WHEN k % 5 IN (0, 3) THEN 0 ELSE n END AS nodes, CASE WHEN k % 5 IN (0, 3) THEN NULL ELSE true END AS has_normal FROM g""")
def _(t):
    k = c("key") % 5
    docs = t.assets.groupBy(line("asset_id", 100).alias("key")).agg(F.count("*").cast("int").alias("n"))  # a file for every 100 assets, a node for each
    body = F.concat(F.lit('{"scenes":[{}],"nodes":['), F.array_join(F.array_repeat(F.lit("{}"), c("n")), ","), F.lit('],"meshes":['), F.when(k == 2, "").otherwise("{}"), F.lit('],"materials":[{"normalTexture":{"index":0}}],"textures":[{}]}'))
    body = F.when(k == 3, F.concat(F.lit("{oops"), body)).otherwise(body)
    # padded so that no byte of a length is beyond ASCII, since the files are written as text, with a line's end
    size = (F.floor(F.length("body") / 256) + 1) * 256 + 32
    little = lambda n: F.concat(*(F.char((F.floor(n / 256**i) % 256).cast("int")) for i in (0, 1)), F.lit("\0\0"))
    glb = F.concat(F.when(k == 0, "gltf").otherwise("glTF"), F.lit("\x02\0\0\0"), little(21 + c("size") + F.when(k == 1, 1).otherwise(0)), little(c("size")), F.lit("JSON"), F.rpad("body", c("size").cast("int"), F.lit(" ")))
    rows = docs.withColumn("body", body).withColumn("size", size).select("key", glb.alias("value"))
    out = src.glb_inventory(t.spark, documents(t, rows, "glb"), "*.txt")
    told = F.array_join(F.filter("issues", lambda x: x != "unexpected_extension"), ",")  # Spark's text files end in .txt
    return out.select(key_of().alias("key"), told.alias("issues"), (told == "").alias("valid"), "nodes", "has_normal")


@query("write_benchmark_results", "SELECT asset_id, provider_status, R[size_mb] AS size_mb FROM graded_assets")
def _(t):
    folder, runs = shared_folder(t.spark, "benchmark"), t.graded_assets.select("asset_id", "provider_status", "size_mb")
    assert not src.write_benchmark_results(runs, folder, F.lit(False))
    src.write_benchmark_results(runs, folder, c("provider_status") == "ok")
    return t.spark.read.schema(runs.schema).json(f"{folder}/json")
