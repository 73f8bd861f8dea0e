"""Best-fit packing by patterns fitted with non-negative least squares (operator 12).

Documents are cut into pieces of at most `size` tokens. What is planned is only the histogram of piece
lengths (`size` numbers, whatever the input): patterns of two or three lengths that fill a sequence
exactly are enumerated, their repeat counts are fitted to the histogram by least squares without
negative counts, rounded to what the histogram has, and the rest is packed best fit first, many equal
sequences at a time. A plan is a bounded table of runs: the pieces of one length, by rank, go to
consecutive sequences at one offset. Spark ranks the pieces within their length by counts of each
partition and gives each its place.

Null texts are empty documents: one piece of the end id. Rows that repeat are packed each. An empty
table gives no rows. Texts of any length are encoded whole. `place` keeps all columns of its input but
those named like its results, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.llm.common import bound_batches, materialize, text_bytes, tokenizer_path
from orbitgrid.llm.token_store import word_encoder

#: Tokens of a sequence, id that ends a document.
SIZE, END_ID = 2048, 0
#: Rounds of the fit at most; the fit ends earlier when a round explains less than this share of the histogram.
ROUNDS, LEAST_GAIN = 120, 2e-4
#: Patterns looked at in a round of the fit; pieces of an Arrow batch; batches of texts whose words are encoded together.
AT_ONCE, AT_MOST, GATHER = 4096, 500, 3

PIECES = "doc_id long, piece int, start long, length long, raw binary"


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and raw (ids as little-endian uint32) of every piece of every document."""
    path = path or tokenizer_path("word_bpe_49k.json")
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path).encode
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        made: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "raw"])

        while held := list(islice(batches, GATHER)):
            rows = pa.Table.from_batches(held)
            for doc_id, x in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                x += end
                for k, a in enumerate(range(0, len(x), step)):
                    raw = x[a : a + step]
                    made.append((doc_id, k, k * size, len(raw) // 4, raw))
                    if len(made) >= AT_MOST:
                        yield out()
                        made.clear()
        if made:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, PIECES)


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Every pair (its third length is 0) and triple of these lengths whose sum is `size`, in ascending order within a row."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    a = lengths[lengths <= size // 2]
    a = a[have[size - a]]
    out = [np.column_stack([np.zeros_like(a), a, size - a])]
    for first in lengths[lengths <= size // 3].tolist():
        b = lengths[(lengths >= first) & (2 * lengths <= size - first)]
        b = b[have[size - first - b]]
        out.append(np.column_stack([np.full(len(b), first), b, size - first - b]))
    return np.concatenate(out)


def fit(cols: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of patterns that make sum (tokens of a length - those used)^2 small: block coordinate descent.

    A round takes patterns by gradient, none of which share a length, and sets each to its own best
    count; so that few patterns carry the fit and rounding loses little. Lengths weigh by their tokens:
    left over, long pieces cost more than short ones, which fill any gap.
    """
    weight = np.arange(len(histogram), dtype=float) / len(histogram)  # the missing third length of a pair weighs nothing
    x, rest = np.zeros(len(cols)), histogram * weight
    a, b, c = cols.T
    wa, wb, wc = weight[a], weight[b], weight[c]
    # squared norm of a pattern's column, where a length may occur twice or three times
    norm = wa * wa + wb * wb + wc * wc + 2 * (wa * wb * (a == b) + wb * wc * (b == c) + wa * wc * (a == c))
    total = max(1.0, float(rest.sum()))
    for _ in range(ROUNDS):
        step = np.maximum((wa * rest[a] + wb * rest[b] + wc * rest[c]) / norm, -x)
        score = step * step * norm
        k = min(AT_ONCE, len(score))
        order = np.argpartition(score, -k)[-k:]
        order = order[np.argsort(-score[order], kind="stable")]
        used, gain = {0}, 0.0
        for j, abc in zip(order.tolist(), cols[order].tolist(), strict=True):
            own = {length for length in abc if length}
            if score[j] > 0 and used.isdisjoint(own):
                used |= own
                x[j] += step[j]
                for length in abc:
                    rest[length] -= step[j] * weight[length]
                    gain += abs(step[j]) * weight[length]
        if gain <= LEAST_GAIN * total:
            break
    return x


def rounded(cols: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole counts, none over what is left of its lengths: whole parts first, then fractions of a half or more."""
    left, out = histogram.copy(), np.zeros(len(cols), np.int64)
    some = np.flatnonzero(x >= 0.5)
    for want in (np.floor, lambda v: np.floor(v + 0.5)):
        for j in some[np.argsort(-x[some], kind="stable")].tolist():
            own, times = np.unique(cols[j][cols[j] > 0], return_counts=True)
            more = min(int(want(x[j])) - int(out[j]), int((left[own] // times).min()))
            if more > 0:
                out[j] += more
                left[own] -= more * times
    return out


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, how many)]) groups: longest first, each into the fullest sequences that have room, all equal ones at once."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by room left
    rooms = 0  # a bit for each room that is there

    def add(room: int, count: int, held: list[tuple[int, int]]) -> None:
        nonlocal rooms
        open_.setdefault(room, []).append((count, held))
        rooms |= 1 << room

    for length in np.flatnonzero(histogram)[::-1].tolist():
        todo = int(histogram[length])
        while todo:
            fits = rooms >> length
            if not fits:
                each = size // length
                if todo >= each:
                    add(size - each * length, todo // each, [(length, each)])
                if todo % each:
                    add(size - todo % each * length, 1, [(length, todo % each)])
                break
            room = length + (fits & -fits).bit_length() - 1
            count, held = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms &= ~(1 << room)
            each = min(room // length, todo)
            take = min(count, todo // each)
            if take < count:
                add(room, count - take, held)
            add(room - each * length, take, [*held, (length, each)])
            todo -= take * each
    return [group for groups in open_.values() for group in groups]


def plan(histogram: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Runs (length, rank, sequence, offset, each): pieces of that length from that rank on go to this and the next sequences, `each` to a sequence.

    `histogram[l]`: pieces of length l, for l from 0 to `size`. The runs are sorted by length and rank;
    their number depends on `size`, not on the pieces.
    """
    left = histogram.astype(np.int64).copy()
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    if left[size]:
        groups.append((int(left[size]), [(size, 1)]))
        left[size] = 0
    cols = patterns(np.flatnonzero(left), size)
    if len(cols):
        times = rounded(cols, fit(cols, left), left)
        for j in np.flatnonzero(times).tolist():
            own, n = np.unique(cols[j][cols[j] > 0], return_counts=True)
            groups.append((int(times[j]), list(zip(own.tolist(), n.tolist(), strict=True))))
            left[own] -= times[j] * n
    groups += best_fit(left, size)
    runs, rank, sequence = [], np.zeros(size + 1, np.int64), 0
    for count, held in groups:
        offset = 0
        for length, each in held:
            runs.append((length, int(rank[length]), sequence, offset, each))
            rank[length] += count * each
            offset += length * each
        sequence += count
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _ranked(batches: Iterator[pa.RecordBatch], size: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each piece's partition and its number among the partition's pieces of its length."""
    part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    for batch in batches:
        lengths = batch.column(batch.num_columns - 1).to_numpy()
        if len(lengths) and not 1 <= lengths.min() <= lengths.max() <= size:
            raise ValueError(f"a piece of {lengths.min()} or {lengths.max()} tokens does not fit sequences of {size}")
        order = np.argsort(lengths, kind="stable")
        own, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
        local = np.empty(len(lengths), np.int64)
        local[order] = np.arange(len(lengths)) - np.repeat(first, n) + np.repeat(seen[own], n)
        seen[own] += n
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.full(len(lengths), part, np.int32)), pa.array(local)], names=names)


def place(cut: DataFrame, size: int = SIZE, length_col: str = "length") -> DataFrame:
    """`cut` with sequence_id and offset of each row; `length_col` holds 1 to `size`."""
    spark = cut.sparkSession
    bound_batches(spark)
    cut = cut.drop(*(c for c in cut.columns if c.lower() in ("sequence_id", "offset")))
    wide = cut.withColumn("__length", F.col(length_col).cast("long"))
    schema = T.StructType([*cut.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType())])
    ranked = materialize(wide.mapInArrow(lambda it: _ranked(it, size, schema.names), schema), "pieces").withColumn("__length", F.col(length_col).cast("long"))
    counts = materialize(ranked.groupBy("__part", "__length").agg(F.count("*").alias("__n")), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("__length").agg(F.sum("__n").alias("n")).collect():  # `size` rows at most
        histogram[r["__length"]] = r.n
    runs = spark.sparkContext.broadcast(plan(histogram, size))
    earlier = Window.partitionBy("__length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__part", "__length", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    whole = ranked.join(base, ["__part", "__length"]).select(*(F.col(f"`{c}`") for c in cut.columns), "__length", (F.col("__base") + F.col("__local")).alias("__rank"))
    names = [*cut.columns, "sequence_id", "offset"]
    placed = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, sequence, offset, each = runs.value.T
        key = (length << 40) + rank  # a length's runs lie together
        for batch in batches:
            own, at = (batch.column(batch.num_columns - k).to_numpy() for k in (2, 1))
            found = np.searchsorted(key, (own << 40) + at, "right") - 1
            nth = at - rank[found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence[found] + nth // each[found]), pa.array(offset[found] + nth % each[found] * own)], names=names)

    return whole.mapInArrow(run, placed)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian uint32) and pieces (doc_id, piece, offset, length) of every sequence of placed pieces with `raw`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "raw")))  # `size` tokens at most
    rows = placed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["raw"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"),
    )


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("raw").alias("ids_crc32"))
    # written before it is ranked: else two Python workers of a task stand at once
    return place(materialize(cut, "cut")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
