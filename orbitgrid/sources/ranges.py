"""Files read by range: GLB heads, digests of files of any size, and the last lines of logs.

A file's bytes are asked for where they are needed, through pyarrow's file systems (local, HDFS, S3 and
others), on executors. So a file may be larger than a value of a row; at most one block, a GLB's JSON
chunk or n lines of a file are held. Names that begin with `_` or `.` are left out, as Spark does.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
import struct
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a block that is read or hashed at once; files of a task; largest JSON chunk that is read.
BLOCK, TASK_FILES, MOST_JSON = 1 << 20, 64, 1 << 30
#: First blocks of backward reading are small: most tails are short.
TAIL_BLOCK = 1 << 14


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it, and the path within."""
    local = re.match(r"file:/*(/.*)", path)
    if local or ":/" not in path:
        return fs.LocalFileSystem(), local[1] if local else path
    return fs.FileSystem.from_uri(path)


def listed(root: str, pattern: str) -> list[fs.FileInfo]:
    """Files below a folder (or the file itself) whose name fits the pattern, by path; none if it is not there."""
    system, path = opened(root.rstrip("/") or "/")
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    base = len(path.rstrip("/")) + 1
    seen = lambda p: not any(x.startswith(("_", ".")) for x in p[base:].split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) and seen(f.path)), key=lambda f: f.path)


def uri(root: str, path: str) -> str:
    """A listed path with the scheme of the folder it was listed in."""
    scheme = re.match(r"([a-z0-9+.-]+:/*)(?=/)", root)
    return f"{scheme[1].rstrip('/')}{path}" if scheme and scheme[1].startswith("file:") else path if not scheme else f"{root.split(':/', 1)[0]}://{path.lstrip('/')}"


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class GlbHeads(DataSource):
    """Format `glb_heads`: path, size, content (header, JSON chunk and the head of the next chunk) and bytes_read of GLB files.

    Options: path, pattern (`*.glb`). Only these bytes are read: 20, the JSON chunk and 8. What ends before,
    is foreign, or has a JSON chunk beyond the file or over `MOST_JSON` is read up to there.
    """

    @classmethod
    def name(cls) -> str:
        return "glb_heads"

    def schema(self) -> str:
        return "path string, size long, content binary, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return GlbHeadReader(self.options)


class GlbHeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.glb")

    def partitions(self) -> list[Files]:
        files = [(uri(self.root, f.path), f.size) for f in listed(self.root, self.pattern)]
        return [Files(files[i : i + TASK_FILES]) for i in range(0, len(files), TASK_FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size in partition.files:
            system, inner = opened(path)
            with system.open_input_file(inner) as f:
                content = f.read_at(min(20, size), 0)
                if len(content) == 20:
                    magic, _, _, n, _ = struct.unpack("<5I", content)
                    if magic == struct.unpack("<I", b"glTF")[0] and n <= min(size - 20, MOST_JSON):
                        content += f.read_at(min(n + 8, size - 20), 20)
            yield path, size, content, len(content)


def glb_heads(spark: SparkSession, root: str, pattern: str = "*.glb") -> DataFrame:
    spark.dataSource.register(GlbHeads)
    return spark.read.format("glb_heads").option("path", root).option("pattern", pattern).load()


def digests(files: DataFrame, kind: str = "sha256", block: int = BLOCK) -> DataFrame:
    """path and digest (hex) of each file of `files` (path), from blocks: no file is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                system, inner = opened(path)
                made = hashlib.new(kind)
                with system.open_input_stream(inner, compression=None) as f:
                    while data := f.read(block):
                        made.update(data)
                out.append(made.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", kind])

    return files.select("path").mapInArrow(run, f"path string, {kind} string")


def last_lines(path: str, n: int) -> tuple[list[bytes], int]:
    """The last n lines of a file and the bytes read for them: block by block from its end, or as a stream if it is compressed."""
    system, inner = opened(path)
    if re.search(r"\.(gz|bz2|zst|lz4)$", inner):
        held: deque[bytes] = deque(maxlen=n)
        rest, read = b"", 0
        with system.open_input_stream(inner, compression="detect") as f:
            while data := f.read(BLOCK):
                read += len(data)
                *lines, rest = (rest + data).split(b"\n")
                held.extend(lines)
        held.extend([rest] if rest else [])
        return list(held), read
    with system.open_input_file(inner) as f:
        at, step, parts, breaks = f.size(), TAIL_BLOCK, [], 0
        end = at
        while at and breaks <= n:
            size = min(step, at)
            at, step = at - size, min(step * 4, BLOCK)
            parts.append(f.read_at(size, at))
            breaks += parts[-1].count(b"\n")
    lines = b"".join(reversed(parts)).split(b"\n")
    lines = lines if lines[-1] else lines[:-1]
    return lines[-n:] if n else [], end - at


def tail_lines(spark: SparkSession, root: str, n: int = 50, by: str = "file", pattern: str = "*") -> tuple[DataFrame, int]:
    """The last n lines below a folder as (file, modified, seq, value), and how many files were opened.

    Files follow each other by name, or as they were `modified`. The newest are read first, twice as many in each
    round, until there are n lines; older ones are not opened.
    """
    order = (lambda f: f.path) if by == "file" else (lambda f: (f.mtime_ns, f.path))
    files = sorted(listed(root, pattern), key=order, reverse=True)
    kept, opened_files = None, 0
    schema = "rank int, file string, modified long, seq long, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, path, modified in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, _ = last_lines(path, n)
                k = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rank] * k, pa.int32()), pa.array([path] * k, pa.string()), pa.array([modified] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array([x.decode("utf-8", "replace").removesuffix("\r") for x in lines], pa.string())],
                    names=["rank", "file", "modified", "seq", "value"],
                )

    found, at, step = 0, 0, 1
    while at < len(files) and found < n:
        some = [(at + i, uri(root, f.path), f.mtime_ns // 1000) for i, f in enumerate(files[at : at + step])]
        rows = spark.createDataFrame(some, "rank int, file string, modified long").repartition(len(some), "rank").mapInArrow(run, schema)
        rows = spark.createDataFrame(rows.orderBy("rank", F.col("seq").desc()).limit(n - found).collect(), schema)  # n lines at most
        found += rows.count()
        kept = rows if kept is None else kept.unionByName(rows)
        at, opened_files, step = at + len(some), opened_files + len(some), step * 2
    kept = spark.createDataFrame([], schema) if kept is None else kept
    return kept.select("rank", "file", F.timestamp_micros("modified").alias("modified"), "seq", "value"), opened_files


def parsed_line(value: Column) -> list[Column]:
    """ts, level and message of a log line; a line that is no JSON object is an INFO message of its own."""
    entry = F.from_json(value, "ts string, level string, message string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    good = entry.isNotNull() & entry["_corrupt_record"].isNull() & value.startswith("{")
    return [F.when(good, entry["ts"]).alias("ts"), F.when(good, entry["level"]).otherwise("INFO").alias("level"), F.when(good, entry["message"]).otherwise(value).alias("message")]


def tail_log(spark: SparkSession, root: str, n: int = 50, by: str = "file", pattern: str = "*") -> DataFrame:
    """The last n lines of all log files below a folder, newest first, as (file, modified, ts, level, message)."""
    lines, _ = tail_lines(spark, root, n, by, pattern)
    value = F.trim("value")
    return lines.orderBy("rank", F.col("seq").desc()).select("file", "modified", *parsed_line(value))
