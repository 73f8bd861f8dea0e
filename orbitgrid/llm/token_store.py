"""Token ids in packs of separately compressed documents (operator 10).

One zstandard dictionary is trained on the serialized id arrays of a bounded sample of whole
documents: the first `DICT_SAMPLE` by hash of the id, without those that would take their texts
beyond `DICT_SAMPLE_BYTES` in that order (it is a model, like any zstandard dictionary). Each document is a frame of
its own. A store is a folder with three tables that Spark writes, so that it lives in any
file system Spark reaches and task retries leave no half-written file:

- `packs`: shard, pack, first (ids of the shard before the pack), dict_hash, id_bytes (2 or 4 each), doc_ids, offsets (index of n+1 positions), n_tokens, payload;
  documents in ascending id order within a shard, shards in ascending order;
- `dictionary`: dict_hash, dictionary;
- `shards`: shard, tokens, start (ids of all shards before it).

A short document is read by its pack's index: slice the payload, decompress one frame.

Null texts are empty documents: they hold the end id alone. Null ids come first. Rows with
equal ids are ordered by their ids' bytes. An empty table gives an empty store. Texts of any
length are one frame each. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.llm.bpe import LETTERS, Memo, PairIndex
from orbitgrid.llm.common import add_columns, materialize, shared_dir, sub_batches, text_bytes, tokenizer_path

DICT_SAMPLE, DICT_SAMPLE_BYTES, DICT_BYTES, LEVEL = 2000, 32 << 20, 64 << 10, 1
#: Bytes of compressed payload and documents after which a pack is closed.
PACK_BYTES, PACK_DOCS = 1 << 20, 1024


#: Compressed bytes of a shard, which one task sorts, where the data give more shards than the session's shuffle partitions.
SHARD_BYTES = 128 << 20
#: Punctuation that may stand in a run after a word and is one pre-token then.
MARKS = b".,;:!?#*$%&|"
#: Of each word of a line: its LETTERS and the marks after them, both empty where it is no such word.
WIDE = re.compile(rf"^(?:({LETTERS.pattern})([{re.escape(MARKS.decode())}]*)|[^\n]+)$", re.MULTILINE)
#: Of each byte: 0 an ASCII letter, 1 one of MARKS, 2 any other.
KIND = np.array([0 if bytes((b,)).isalpha() else 1 if b in MARKS else 2 for b in range(256)], np.uint8)
#: What a file must say for words to be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """The tokenizers library's ids, with each word (a run without ASCII white space) encoded once.

    White space is dropped by the tokenizer, so no token, normalization or split crosses it; a file
    that says otherwise is refused. Words that are letters, with a run of marks after them or not,
    go to the pair index of operator 1, all new ones of a batch together; the library encodes every
    other word. On words of letters the library takes about 13 microseconds each, several times as long.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER:
            raise ValueError(f"not a lower-case BPE file that drops white space: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.index = PairIndex(spec["model"])
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.memo = Memo(200_000)

    def library(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def learned(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: those of its letters and of the marks after them, or of the whole where it is no such word."""
        made = np.empty(len(words), object)
        if not words:
            return []
        raw = np.frombuffer(b"".join(words).lower(), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        kind = KIND[raw]
        odd = kind == 2
        odd[1:] |= (kind[1:] == 0) & (kind[:-1] == 1)  # a letter after a mark
        odd[starts] = kind[starts] != 0
        fits = ~np.logical_or.reduceat(odd, starts)  # ASCII letters and marks
        n_marks = np.add.reduceat(kind == 1, starts, dtype=np.int64)[fits]
        n_letters = lengths[fits] - n_marks
        other = np.flatnonzero(~fits)
        found = WIDE.findall(b"\n".join([words[i] for i in other.tolist()]).decode()) if len(other) else []
        is_wide = np.fromiter((bool(x) for x, _ in found), bool, len(other))
        wide, whole = other[is_wide], other[~is_wide].tolist()
        lower = "\n".join([x for x, _ in found if x]).lower().encode().split(b"\n") if len(wide) else []
        parts = list(chain.from_iterable(zip(lower, [m.encode() for x, m in found if x], strict=True)))
        if whole:
            made[whole] = self.library([words[i] for i in whole])
        raw = np.concatenate((raw[np.repeat(fits, lengths)], np.frombuffer(b"".join(parts), np.uint8)))
        cut = np.concatenate((np.stack((n_letters, n_marks), 1), np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 2)))
        if len(cut):
            ids, stop = self.index.encode_bytes(raw, cut[cut > 0])
            stop = stop[np.cumsum((cut > 0).sum(1)) - 1].tolist()  # of whole words
            made[np.r_[np.flatnonzero(fits), wide]] = [ids[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]
        return made.tolist()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for run in sub_batches(texts, 8 << 20):
            words = [t.split() for t in run]
            with self.memo.holding(set().union(*words), self.learned) as known:
                get = known.__getitem__
                out += [b"".join(map(get, w)) for w in words]
        return out


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_ids(docs: DataFrame, end_id: int, path: str | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with `raw`: ids of the whole text and `end_id`, as little-endian uint32."""
    path = path or tokenizer_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def start():
        enc = word_encoder(path)
        return lambda text: [pa.array([x + end for x in enc.encode(text.to_pylist())], pa.binary())]

    return add_columns(docs, [text_bytes(text_col)], T.StructType([T.StructField("raw", T.BinaryType())]), start)


def serial_type(path: str | None) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    return "<u2" if word_encoder(path or tokenizer_path("word_bpe_49k.json")).size <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, end_id: int, path: str | None = None) -> bytes:
    """A dictionary from the id arrays of a bounded sample of whole documents; empty if they are too few."""
    first = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).orderBy("h", "doc_id", "size").limit(DICT_SAMPLE)
    so_far = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))  # of DICT_SAMPLE rows
    picked = first.withColumn("so_far", so_far).filter(F.col("so_far") <= DICT_SAMPLE_BYTES).select("doc_id", "size").distinct()
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    texts = sized.join(F.broadcast(picked), ["doc_id", "size"], "left_semi").select("doc_id", "text").limit(DICT_SAMPLE)
    samples = [np.frombuffer(bytes(r.raw), "<u4").astype(serial_type(path)).tobytes() for r in encode_ids(texts, end_id, path).select("raw").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""  # too few or too short samples: frames stand alone


def dict_hash(dictionary: bytes) -> int:
    return zlib.crc32(dictionary)


def _packed(batches: Iterator[pa.RecordBatch], hashed: int, width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Packs of consecutive documents of one partition."""
    shard, pack, first, held, size = 0, 0, 0, [], 0

    def close() -> pa.RecordBatch:
        rows = {
            "shard": [shard], "pack": [pack], "first": [first], "dict_hash": [hashed], "id_bytes": [width], "doc_ids": [[r[0] for r in held]],
            "offsets": [list(accumulate((len(r[2]) for r in held), initial=0))],
            "n_tokens": [[r[1] for r in held]], "payload": [b"".join(r[2] for r in held)],
        }
        return pa.RecordBatch.from_pydict(rows, schema)

    for batch in batches:
        for s, doc_id, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shard = s
            held.append((doc_id, n, frame))
            size += len(frame)
            if size >= PACK_BYTES or len(held) >= PACK_DOCS:
                yield close()
                pack, first, held, size = pack + 1, first + sum(r[1] for r in held), [], 0
    if held:
        yield close()


PACKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("pack", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("dict_hash", T.LongType()), T.StructField("id_bytes", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())),
    T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
])
SHARDS = "shard int, tokens long, start long"


def write_store(docs: DataFrame, folder: str, end_id: int = 2, path: str | None = None) -> None:
    """Encode, compress and write every document of `docs` (doc_id, text) in ascending id order."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, end_id, path)
    hashed = dict_hash(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # DICT_BYTES at most

    path = path or tokenizer_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    kind = serial_type(path)

    def start():
        enc = word_encoder(path)
        data = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True).compress

        def step(text: pa.Array) -> list[pa.Array]:
            rows = [np.frombuffer(x + end, "<u4") for x in enc.encode(text.to_pylist())]
            return [pa.array([len(r) for r in rows], pa.int64()), pa.array([press(r.astype(kind)) for r in rows], pa.binary())]

        return step

    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("frame", T.BinaryType())])
    frames = add_columns(docs.select("doc_id", "text"), [text_bytes()], fields, start, gather=3)
    frames = materialize(frames.select("doc_id", "n_tokens", "frame"), "frames")  # the range sample below reads it again
    size = frames.agg(F.sum(F.octet_length("frame").cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1, -(-size // SHARD_BYTES))
    ordered = frames.withColumn("tie", F.xxhash64("frame")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    width = np.dtype(kind).itemsize
    schema = pa.schema([
        ("shard", pa.int32()), ("pack", pa.int32()), ("first", pa.int64()), ("dict_hash", pa.int64()), ("id_bytes", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary()),
    ])
    rows = ordered.select(F.spark_partition_id().alias("shard"), F.col("doc_id").cast("long"), "n_tokens", "frame")
    rows.mapInArrow(lambda it: _packed(it, hashed, width, schema), PACKS).write.parquet(f"{folder}/packs")
    spark.createDataFrame([(hashed, dictionary)], "dict_hash long, dictionary binary").write.parquet(f"{folder}/dictionary")
    sums = spark.read.schema(PACKS).parquet(f"{folder}/packs").groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    totals = sorted((r.shard, r.tokens) for r in sums.collect())  # one row for each shard
    begin = accumulate((t for _, t in totals), initial=0)
    spark.createDataFrame([(s, t, b) for (s, t), b in zip(totals, begin, strict=False)], SHARDS).write.parquet(f"{folder}/shards")


def read_store(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens and raw (ids as little-endian uint32) of the store's documents.

    `wanted` (doc_id): only these, found by the index; other frames are not decompressed.
    """
    (row,) = spark.read.schema("dict_hash long, dictionary binary").parquet(f"{folder}/dictionary").collect()
    shared = spark.sparkContext.broadcast((row.dict_hash, bytes(row.dictionary)))  # DICT_BYTES at most
    packs = spark.read.schema(PACKS).parquet(f"{folder}/packs")
    if wanted is None:
        packs = packs.withColumn("picked", F.lit(None).cast("array<int>"))
    else:
        index = packs.select("shard", "pack", F.posexplode("doc_ids").alias("at", "doc_id"))
        found = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        packs = packs.join(found.groupBy("shard", "pack").agg(F.collect_set("at").alias("picked")), ["shard", "pack"])
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards").select("shard", "start")
    rows = packs.join(shards, "shard").select((F.col("start") + F.col("first")).alias("first"), "dict_hash", "id_bytes", "doc_ids", "offsets", "n_tokens", "payload", "picked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, dictionary = shared.value
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unpress = zstandard.ZstdDecompressor(dict_data=data).decompress
        for batch in batches:
            for pack in batch.to_pylist():
                if pack["dict_hash"] != hashed:
                    raise ValueError("a pack was compressed with another dictionary")
                kind = f"<u{pack['id_bytes']}"
                starts = list(accumulate(pack["n_tokens"], initial=pack["first"]))
                take = range(len(pack["doc_ids"])) if pack["picked"] is None else sorted(pack["picked"])
                cut = pack["offsets"]
                made = {
                    "doc_id": [pack["doc_ids"][i] for i in take],
                    "start": [starts[i] for i in take],
                    "n_tokens": [pack["n_tokens"][i] for i in take],
                    "raw": [np.frombuffer(unpress(pack["payload"][cut[i] : cut[i + 1]]), kind).astype("<u4").tobytes() for i in take],
                }
                yield pa.RecordBatch.from_pydict(made, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("raw", pa.binary())]))

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, raw binary")


def stored(docs: DataFrame) -> DataFrame:
    """Write all documents to a new store in the shared folder and read them back with their crc32."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "token-store")
    write_store(docs, folder)
    return read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("raw").alias("ids_crc32"))
