"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 2).

A 64-bit fingerprint is cut into segments A (23 bits), B (23) and C (18, zero-padded). The
binary Golay code [23,12,7] is perfect: every segment lies within three bits of one codeword.
Its *near* keys are the 12-bit indices of all codewords within four bits: one key, or six
where the nearest codeword is three bits away. Two segments that differ in at most two bits
share a near key.

Of four differing bits, by the pigeonhole principle, either
- one segment has none and another has two at most: key = that segment's bits and a near key
  of the other (six ordered pairs of segments), or
- every segment has one or two: key = a near key of A and one of B.
So every linked pair meets in some bucket. Buckets hold distinct fingerprints only; a bucket
of up to `BUCKET` fingerprints is compared as a whole. A larger one of the second kind is first
cut by the near keys of C, where its pairs differ in two bits at most; what is still larger is
compared in all pairs of its blocks of about BUCKET/2, so no task holds more than BUCKET
fingerprints. A comparison is exact (XOR and bit count) and emits a spanning forest of the
bucket's links, not all of its pairs. Components then come from large-star/small-star rounds
over the forests' edges.

Null and empty texts have fingerprint zero and link like any other. Null ids take no part as a
smallest id; a component of null ids alone has a null id. Repeated rows repeat in the result; an
empty table gives an empty one. Texts of any length are read whole. `near_duplicates` reads
doc_id and text only, so other columns, whatever their names, do not matter; `survivors` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.llm.common import add_columns, materialize, text_bytes

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Most fingerprints of a bucket that one comparison holds.
BUCKET = 4096
#: Width and shift of the segments.
SEGMENTS = ((23, 0), (23, 23), (18, 46))
#: Tag, above the 40th bit of a key, of buckets with near keys of both A and B; the six below have one segment's bits.
TWO_NEAR = 6
#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes) -> int:
    """SimHash of a text's word shingles, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    begin = np.r_[0, ends[:-1] + 1][: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[i:j], SEED) for i, j in zip(begin, ends[k - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """`docs` with the fingerprint as a signed 64-bit integer."""

    def start():
        return lambda text: [pa.array(np.array([fingerprint(t) for t in text.to_pylist()], np.uint64).view(np.int64))]

    return add_columns(docs, [text_bytes(text_col)], T.StructType([T.StructField(out_col, T.LongType())]), start)


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each byte-wise part, coset leaders, and for cosets of weight three all patterns of weight four."""
    bit = np.arange(23)
    syndrome_of_bit = np.zeros(23, np.int64)
    for i in bit:
        x = 1 << int(i)
        while x.bit_length() > 11:
            x ^= GENERATOR << (x.bit_length() - 12)
        syndrome_of_bit[i] = x
    table = np.zeros((3, 256), np.int64)
    for part in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and part * 8 + i < 23:
                    table[part, v] ^= syndrome_of_bit[part * 8 + i]
    leader = np.full(2048, -1, np.int64)
    four: list[list[int]] = [[] for _ in range(2048)]
    b = [1 << int(i) for i in bit]
    s = syndrome_of_bit.tolist()
    leader[0] = 0
    for i in range(23):
        leader[s[i]] = b[i]
        for j in range(i):
            leader[s[i] ^ s[j]] = b[i] | b[j]
            for k in range(j):
                leader[s[i] ^ s[j] ^ s[k]] = b[i] | b[j] | b[k]
                for m in range(k):
                    four[s[i] ^ s[j] ^ s[k] ^ s[m]].append(b[i] | b[j] | b[k] | b[m])
    weight = np.array([int(x).bit_count() for x in leader])
    patterns = np.zeros((2048, 6), np.int64)
    patterns[:] = leader[:, None]
    for x in np.flatnonzero(weight == 3):
        patterns[x, 1:] = four[x]
    return table, leader, weight, patterns


def near_keys(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within four bits; rows with one key repeat it."""
    table, _, _, patterns = golay()
    syndrome = table[0, segment & 255] ^ table[1, segment >> 8 & 255] ^ table[2, segment >> 16]
    return (segment[:, None] ^ patterns[syndrome]) >> 11  # cyclic code: the upper 12 bits name the codeword


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all buckets of each fingerprint: (position, key), repeats removed."""
    u = fp.view(np.uint64)
    bits = [(u >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1) for width, shift in SEGMENTS]
    near = [near_keys(b) for b in bits]
    at, out = [], []
    row = np.repeat(np.arange(len(fp)), 6).reshape(-1, 6)
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                out.append((tag << 40 | bits[i][:, None] << 12 | near[j]).ravel())
                at.append(row.ravel())
                tag += 1
    out.append((tag << 40 | near[0][:, :, None] << 12 | near[1][:, None, :]).reshape(-1))
    at.append(np.repeat(np.arange(len(fp)), 36))
    place, key = np.concatenate(at), np.concatenate(out)
    order = np.lexsort((key, place))
    place, key = place[order], key[order]
    new = np.r_[True, (place[1:] != place[:-1]) | (key[1:] != key[:-1])] if len(key) else np.zeros(0, bool)
    return place[new], key[new]


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp) of every bucket of every fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            place, key = bucket_keys(fp)
            for i in range(0, len(key), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 17)]), pa.array(fp[place[i : i + (1 << 17)]])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges that connect, within a bucket, all that links connect: at most len(fp) - 1."""
    u = fp.view(np.uint64)
    if len(u) == 2:
        return [(0, 1)] if int(u[0] ^ u[1]).bit_count() <= distance else []
    edges: list[tuple[int, int]] = []
    left = np.arange(len(u))
    while len(left):  # breadth-first: each fingerprint is compared with those not reached yet
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            step = max(1, (1 << 20) // len(left))
            for i in range(0, len(front), step):
                part = front[i : i + step]
                close = np.bitwise_count(u[part][:, None] ^ u[left][None, :]) <= distance
                hit = close.any(0) & (parent < 0)
                parent[hit] = part[close[:, hit].argmax(0)]
            reached = parent >= 0
            edges += zip(parent[reached].tolist(), left[reached].tolist(), strict=True)
            front, left = left[reached], left[~reached]
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        a, b = [], []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            fp = values[i:j]
            for x, y in forest(fp):
                a.append(fp[x])
                b.append(fp[y])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()) if a else pa.array([], pa.int64()), pa.array(np.maximum(a, b), pa.int64()) if a else pa.array([], pa.int64())], names=["a", "b"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, fp) of rows in large buckets: one row for each near key of C in buckets of two near keys, else one with part -1."""
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        width, shift = SEGMENTS[2]
        part = np.sort(near_keys((fp.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)), axis=1)
        new = np.c_[np.ones(len(fp), bool), part[:, 1:] != part[:, :-1]]
        exact = key >> 40 < TWO_NEAR
        part[exact], new[exact, 1:] = -1, False
        row, at = np.nonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(part[row, at]), pa.array(fp[row])], names=["key", "part", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a < b) between distinct fingerprints: in every bucket, a spanning forest of its links."""
    rows = materialize(keyed(fps), "keys")
    large = rows.groupBy("key").count().filter(F.col("count") > BUCKET).select("key", F.lit(True).alias("large"))
    parted = rows.join(large, "key", "left")
    small = parted.filter("large is null").groupBy("key").agg(F.collect_list("fp").alias("fps"))
    wide = parted.filter("large").select("key", "fp").mapInArrow(_cut, "key long, part long, fp long")
    # Rows of a key are spread over blocks by their fingerprint; most have one block.
    sizes = wide.groupBy("key", "part").agg(F.greatest(F.lit(1), F.when(F.count("*") > BUCKET, F.ceil(F.count("*") * 2 / BUCKET))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    wide = wide.join(sizes, ["key", "part"]).select("key", "part", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    wide = wide.groupBy("key", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))
    compared = small.select("fps").unionByName(wide.select("fps")).filter(F.size("fps") > 1)
    return compared.mapInArrow(_forests, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of each connected component, by large-star/small-star.

    A star sends each node's neighbours to its smallest one with `min` over (node), a partial
    aggregate, and equi joins. The minima are written before they are joined: both sides of the join
    are then plain shuffles, so that AQE splits a node with many neighbours as a skewed join.
    """
    edges = materialize(edges.filter("a <> b"), "edges")
    last = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large")
        # small-star: from each node to its smaller neighbours
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = materialize(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def labelled(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, first, root) of each distinct fingerprint of `marked` (doc_id, fp), and (root, component_id, best: a fingerprint that the id has) of each group."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes))
    nodes = materialize(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "labelled")
    least = nodes.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("b"))
    return nodes, materialize(least.select("root", F.col("b.first").alias("component_id"), F.col("b.fp").alias("best")), "groups")


def fingerprint_groups(marked: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of `marked` (doc_id, fp)."""
    nodes, groups = labelled(marked)
    return nodes.join(groups, "root").select("fp", "component_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row, written to the shared folder."""
    marked = with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return materialize(marked.select("doc_id", "fp"), "fingerprints")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id of all that links reach)."""
    marked = fingerprints(docs)
    out = marked.join(fingerprint_groups(marked), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group: that of its smallest id; of a group of null ids, any one row.

    An id that is the smallest of several groups, its rows having different texts, stays once for each.

    Of rows that share the surviving id and fingerprint, that stays whose text, and then whose other
    columns, have the smallest hash: whatever the order of rows. What stays is decided from ids, fingerprints
    and hashes alone; texts meet the decisions once, where Spark may broadcast these, and only rows that repeat
    as a whole are grouped.
    """
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    own = {"__id": F.col("doc_id").cast("long"), "__text": F.xxhash64(F.col("text")), "__others": F.xxhash64(others)}
    marked = with_fingerprint(docs.select(*(v.alias(k) for k, v in own.items()), "text"), out_col="__fp")
    marked = materialize(marked.select(*own, "__fp"), "marked")
    best = labelled(marked.select(F.col("__id").alias("doc_id"), F.col("__fp").alias("fp")))[1]
    best = best.select(F.col("component_id").alias("__first"), F.col("best").alias("__best"))
    rows = marked.join(best, F.col("__id").eqNullSafe(F.col("__first")) & (F.col("__fp") == F.col("__best")))
    rows = rows.groupBy("__id", "__fp", "__text", "__others").agg(F.count("*").alias("__n"))
    least = rows.groupBy("__id", "__fp").agg(F.min(F.struct("__text", "__others", "__n")).alias("__least"))
    stay = materialize(least.select("__id", "__least.*"), "stay")
    once, again = stay.filter("__n = 1").drop("__n"), stay.filter("__n > 1").drop("__n")

    def met(side: DataFrame) -> DataFrame:
        """Rows of `docs` that are named by `side`, with what names them."""
        names = {k: f"{k}_named" for k in own}
        named = side.withColumnsRenamed(names)
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
        return docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(v.alias(k) for k, v in own.items())).join(named, same, "left_semi")

    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = met(again).groupBy(*own).agg(F.first(F.struct(*columns)).alias("__row")).select("__row.*")
    return met(once).select(*columns).unionByName(one)
