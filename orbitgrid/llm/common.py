"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Most rows and bytes of an Arrow batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine (also called on executors)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, deleted when the driver ends; on one machine, a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    folder = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(col: str = "text") -> Column:
    """A text column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def fold_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as decimal text, modulo `buckets`; a null id is in bucket 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % buckets, F.lit(0))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES at most: texts can be long."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.match(r"-?\d+", spark.conf.get(key, str(most + 1)))[0])
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def add_columns(
    df: DataFrame,
    inputs: list[Column],
    fields: T.StructType,
    start: Callable[[], Callable[..., list[pa.Array]]],
    gather: int = 1,
) -> DataFrame:
    """`df` with `fields` computed from Arrow batches of `inputs`.

    `start()` runs once in each task and returns a function of the input arrays that gives
    one array for each field; it gets `gather` batches at a time. Columns of `df` named like a new field are replaced; all
    others pass through unchanged.
    """
    bound_batches(df.sparkSession)
    taken = {n.lower() for n in fields.names}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    names = [f"__in{i}" for i in range(len(inputs))]
    wide = df.select(*kept, *(c.alias(n) for c, n in zip(inputs, names, strict=True)))
    schema = T.StructType([f for f in wide.schema.fields if f.name not in names] + fields.fields)
    n = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        full = (b for b in batches if b.num_rows)
        while held := list(islice(full, gather)):
            batch = held[0] if len(held) == 1 else pa.concat_batches(held)
            del held
            made = step(*batch.columns[-n:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-n], *made], names=schema.names)

    return wide.mapInArrow(run, schema)


def sub_batches(texts: list[bytes], limit: int = 4 << 20) -> Iterator[list[bytes]]:
    """Consecutive runs of texts of about `limit` bytes each (one longer text stands alone)."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run
