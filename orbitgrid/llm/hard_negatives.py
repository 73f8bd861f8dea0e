"""Hard negatives by an STR-packed R-tree (operator 13).

Vectors are sorted into tiles (label, then the widest coordinates) and cut into shards of bounded
size; each shard is an R-tree whose boxes hold the least and largest label and value of each coordinate. A
box bounds its vectors' inner products with an anchor, coordinate by coordinate. A best-first queue
takes boxes by upper bound, drops those outside every score window and stops at boxes strictly below
the last score kept: ties stay, since a smaller id may win them.

Anchors are packed into blocks and meet the shards in an equi-join of the shards' parts: a stated set of
queries against all rows, in blocks. Two searches, each merged over shards by rank: rows of an anchor's
label (positives), then rows of other labels within the positives' windows.

Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of
different lengths are compared as if padded with zeros; an empty one scores 0. A null id is no anchor
and comes last among ties. Rows that repeat are rows of their own: each is an anchor, and others'
candidate. Other columns, whatever their names, are not read. An empty table gives no rows. Scores
beyond 64 bits are compared exactly within a shard and returned as the largest or smallest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitgrid.llm.common import bound_batches, materialize

#: Most rows of a shard, of a leaf, children of an inner box, anchors of a block, coordinates of tiles.
SHARD_ROWS, LEAF_ROWS, FANOUT, BLOCK_ANCHORS, TILE_COORDS = 8192, 128, 8, 256, 3
#: Coordinates of which the widest is the first tile's; the shards' own tiles look at all.
KEY_COORDS = 256
#: Fixed values of the task: a component's scale, share of relabelled rows, positives, negatives, window in hundredths.
SCALE, TOP, WINDOW_LOW, WINDOW_HIGH = 256, 5, 80, 100
#: Below this, hundredfold scores are exact in doubles.
EXACT = float(1 << 46)
LONG = np.iinfo(np.int64)

SHARDS = "part int, shard int, n int, dim int, low_label long, high_label long, row binary, vec_id binary, label binary, matrix binary, leaf binary"
BLOCKS = "block long, block_label long, anchors binary, anchor_dim int, anchor_matrix binary, windows array<array<long>>"
#: Stands for a null id: after every other.
NO_ID = LONG.max


def scaled(vectors: list) -> np.ndarray:
    """floor(SCALE * x) of every component, as doubles, shorter vectors padded with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * SCALE)


def tiles(matrix: np.ndarray, labels: np.ndarray, coords: list[int], leaf: int = LEAF_ROWS) -> np.ndarray:
    """Sort-tile-recursive order: slabs of the label, each cut into slabs of the next coordinate."""

    def sorted_by(rows: np.ndarray, left: list[int]) -> list[np.ndarray]:
        if not left or len(rows) <= leaf:
            return [rows]
        rows = rows[np.argsort(matrix[rows, left[0]], kind="stable")]
        leaves = -(-len(rows) // leaf)
        slab = leaf * -(-leaves // max(1, round(leaves ** (1 / len(left)))))
        return [x for i in range(0, len(rows), slab) for x in sorted_by(rows[i : i + slab], left[1:])]

    out = []
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    for run in np.split(order, cuts):
        out += sorted_by(run, coords)
    return np.concatenate(out) if out else order


def _shards(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Shards of consecutive rows of one partition."""
    part, shard, held = 0, 0, []

    def close() -> pa.RecordBatch:
        matrix = scaled([h[3] for h in held])
        labels = np.array([h[2] for h in held], np.int64)
        wide = np.argsort(-matrix.std(0), kind="stable")[:TILE_COORDS].tolist() if matrix.size else []
        order = tiles(matrix, labels, wide)
        labels = labels[order]
        change = np.flatnonzero(np.diff(labels)) + 1
        # a leaf holds one label where that has LEAF_ROWS rows or more; smaller runs share leaves
        edges = np.unique(np.r_[np.arange(0, len(held), LEAF_ROWS), change[np.diff(np.r_[change, len(held)]) >= LEAF_ROWS]])
        ids = np.array([NO_ID if held[i][1] is None else held[i][1] for i in order], np.int64)
        row = {
            "part": [part], "shard": [shard], "n": [len(held)], "dim": [matrix.shape[1]], "low_label": [int(labels.min())], "high_label": [int(labels.max())],
            "row": [np.array([held[i][0] for i in order], np.int64).tobytes()], "vec_id": [ids.tobytes()], "label": [labels.tobytes()],
            "matrix": [matrix[order].tobytes()], "leaf": [edges.astype(np.int64).tobytes()],
        }
        return pa.RecordBatch.from_pydict(row, schema)

    for batch in batches:
        for p, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = p
            held.append(rest)
            if len(held) >= SHARD_ROWS:
                yield close()
                shard, held = shard + 1, []
    if held:
        yield close()


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive anchors of one label."""
    part, made, label, held = 0, 0, None, []

    def close() -> pa.RecordBatch:
        matrix = scaled([h[1] for h in held])
        row = {
            "block": [part << 32 | made], "block_label": [label], "anchors": [np.array([h[0] for h in held], np.int64).tobytes()],
            "anchor_dim": [matrix.shape[1]], "anchor_matrix": [matrix.tobytes()], "windows": [[h[2] for h in held]],
        }
        return pa.RecordBatch.from_pydict(row, schema)

    for batch in batches:
        for p, row, of, vector, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (of != label or len(held) >= BLOCK_ANCHORS):
                yield close()
                made, held = made + 1, []
            part, label = p, of
            held.append((row, vector, windows))
    if held:
        yield close()


class Tree:
    """A shard's vectors in tile order, with boxes level by level; boxes of a level are consecutive."""

    def __init__(self, n: int, dim: int, row: bytes, vec_id: bytes, label: bytes, matrix: bytes, leaf: bytes):
        self.rows, self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (row, vec_id, label))
        self.matrix = np.frombuffer(matrix).reshape(n, dim)
        first = np.frombuffer(leaf, np.int64)
        self.leaf_start, self.leaf_stop = first, np.r_[first[1:], n]
        low, high = np.minimum.reduceat(self.matrix, first), np.maximum.reduceat(self.matrix, first)
        least, most = np.minimum.reduceat(self.labels, first), np.maximum.reduceat(self.labels, first)
        levels = [(low, high, least, most)]
        while len(levels[-1][0]) > FANOUT:
            low, high, least, most = levels[-1]
            at = np.arange(0, len(low), FANOUT)
            levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))
        self.sizes = [len(x[0]) for x in levels]
        #: boxes of all levels in one array, leaves first; box i of level l is at base[l] + i
        self.base = np.cumsum([0, *self.sizes]).tolist()
        self.low, self.high, self.least, self.most = (np.concatenate([x[k] for x in levels]) for k in range(4))
        self.largest = float(np.abs(self.matrix).max(initial=0))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible inner product of each anchor with each box."""
        d = min(anchors.shape[1], self.low.shape[1])
        up, down = np.maximum(anchors[:, :d], 0), np.minimum(anchors[:, :d], 0)
        low, high = self.low[:, :d], self.high[:, :d]
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        if self.largest * np.abs(anchors).max(initial=0) * max(d, 1) >= EXACT:  # doubles round: widen
            slack = 1e-9 * (np.abs(least) + np.abs(most)) + 1e-12 * self.largest * np.abs(anchors).max(initial=0) * d
            least, most = least - slack, most + slack
        return least, most

    def scores(self, anchor: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Exact inner products: doubles where they are exact, else Python's integers."""
        d = min(len(anchor), self.matrix.shape[1])
        if self.largest * np.abs(anchor).max(initial=0) * max(d, 1) < EXACT:
            return self.matrix[start:stop, :d] @ anchor[:d]
        whole = [int(x) for x in anchor[:d]]
        return np.array([sum(int(x) * y for x, y in zip(r, whole, strict=True)) for r in self.matrix[start:stop, :d]], object)

    def search(self, anchor: np.ndarray, least: np.ndarray, most: np.ndarray, wanted: np.ndarray, row: int, label: int, same: bool, windows: list[tuple]) -> list[list[tuple]]:
        """The first TOP (-score, id, row) of each window (lowest, highest score), by a best-first queue.

        `least`, `most`, `wanted`: of each box, for this anchor. `same`: rows of the anchor's label but itself, else of others.
        """
        best: list[list[tuple]] = [[] for _ in windows]
        floor = [w[0] for w in windows]
        top = len(self.sizes) - 1
        queue = []

        def push(level: int, i: int) -> None:
            k = self.base[level] + i
            if wanted[k] and any(most[k] >= f and least[k] <= w[1] for f, w in zip(floor, windows, strict=True)):
                heapq.heappush(queue, (-most[k], level, i))

        for i in range(self.sizes[top]):
            push(top, i)
        while queue:
            bound, level, i = heapq.heappop(queue)
            if -bound < min(floor):
                break
            if level:
                for child in range(i * FANOUT, min((i + 1) * FANOUT, self.sizes[level - 1])):
                    push(level - 1, child)
                continue
            a, b = int(self.leaf_start[i]), int(self.leaf_stop[i])
            s = self.scores(anchor, a, b)
            of = self.labels[a:b] == label
            allowed = (of & (self.rows[a:b] != row) if same else ~of) & (s >= min(floor)).astype(bool)
            if not allowed.any():
                continue
            at = np.flatnonzero(allowed)
            found = [(-x, int(self.ids[a + j]), int(self.rows[a + j])) for j, x in zip(at.tolist(), s[at].tolist(), strict=True)]
            for w, (lowest, highest) in enumerate(windows):
                kept = sorted(best[w] + [f for f in found if lowest <= -f[0] <= highest])[:TOP]
                best[w] = kept
                if len(kept) == TOP:
                    floor[w] = max(lowest, -kept[-1][0])
        return best


def long(x) -> int:
    return int(max(LONG.min, min(LONG.max, x)))


def _found(batches: Iterator[pa.RecordBatch], same: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(anchor_row, window, row, vec_id, score) of each (shard, block)."""
    for batch in batches:
        for r in batch.to_pylist():
            tree = Tree(*(r[k] for k in ("n", "dim", "row", "vec_id", "label", "matrix", "leaf")))
            anchors = np.frombuffer(r["anchors"], np.int64)
            matrix, label = np.frombuffer(r["anchor_matrix"]).reshape(len(anchors), r["anchor_dim"]), r["block_label"]
            least, most = tree.bounds(matrix)
            wanted = (tree.least <= label) & (tree.most >= label) if same else (tree.least != label) | (tree.most != label)
            out: list[tuple] = []
            for i, a in enumerate(anchors.tolist()):
                # the least score of a window: 80 * p <= 100 * n
                windows = [(-float("inf"), float("inf"))] if same else [(-(-WINDOW_LOW * p // WINDOW_HIGH), p) for p in r["windows"][i]]
                for w, kept in enumerate(tree.search(matrix[i], least[i], most[i], wanted, a, label, same, windows)):
                    out += [(a, w, row, None if vec_id == NO_ID else vec_id, long(-s)) for s, vec_id, row in kept]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)


def prepared(vectors: DataFrame) -> DataFrame:
    """row (unique), vec_id, label (long, relabelled) and vector (doubles) of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.col("label").cast("long")
    return (
        vectors.select("vec_id", "label", "embedding").filter(F.col("label").isNotNull() & x.isNotNull() & ~bad)
        .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), x.cast("array<double>").alias("vector"))
    )


def pack(points: DataFrame) -> DataFrame:
    """The R-tree: a written table with one row for each shard."""
    stats = points.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    dims = range(min(stats.d or 0, KEY_COORDS))
    spread = points.agg(*(F.coalesce(F.stddev_pop(F.coalesce(F.get("vector", F.lit(i)), F.lit(0.0))), F.lit(0.0)).alias(f"s{i}") for i in dims)).first() if stats.d else []
    widest = max(dims, key=lambda i: spread[i], default=0)
    parts = max(1, -(-stats.n // SHARD_ROWS))
    tiled = points.withColumn("key", F.coalesce(F.get("vector", F.lit(widest)), F.lit(0.0))).repartitionByRange(parts, "label", "key", "row").sortWithinPartitions("label", "key", "row")
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("low_label", pa.int64()), ("high_label", pa.int64()), *((k, pa.binary()) for k in ("row", "vec_id", "label", "matrix", "leaf"))])
    rows = tiled.select(F.spark_partition_id().alias("part"), "row", "vec_id", "label", "vector")
    return materialize(rows.mapInArrow(lambda it: _shards(it, schema), SHARDS), "rtree")


def searched(tree: DataFrame, anchors: DataFrame, same: bool) -> DataFrame:
    """For each anchor (row, label, vector, windows) and window, its first TOP rows: anchor_row, window, row, vec_id, score, rank."""
    bound_batches(tree.sparkSession)
    schema = pa.schema([("block", pa.int64()), ("block_label", pa.int64()), ("anchors", pa.binary()), ("anchor_dim", pa.int32()), ("anchor_matrix", pa.binary()), ("windows", pa.list_(pa.list_(pa.int64())))])
    near = anchors.repartitionByRange("label", "row").sortWithinPartitions("label", "row").select(F.spark_partition_id().alias("part"), "row", "label", "vector", "windows")
    blocks = materialize(near.mapInArrow(lambda it: _blocks(it, schema), BLOCKS), "anchor-blocks")
    parts = tree.agg(F.max("part")).first()[0]
    if parts is None:
        return tree.sparkSession.createDataFrame([], "anchor_row long, window int, row long, vec_id long, score long, rank int")
    fits = F.col("block_label").between(F.col("low_label"), F.col("high_label"))
    if not same:
        fits = (F.col("low_label") != F.col("block_label")) | (F.col("high_label") != F.col("block_label"))
    heads = blocks.select("block", "block_label", F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("part"))
    pairs = heads.join(tree.select("part", "shard", "low_label", "high_label"), "part").filter(fits).select("block", "part", "shard")
    met = pairs.join(blocks, "block").join(tree.drop("low_label", "high_label"), ["part", "shard"]).drop("part", "shard", "block")
    out = pa.schema([("anchor_row", pa.int64()), ("window", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    found = met.mapInArrow(lambda it: _found(it, same, out), "anchor_row long, window int, row long, vec_id long, score long")
    first = Window.partitionBy("anchor_row", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= TOP)


def mined(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; anchors are rows whose id `every` divides."""
    points = materialize(prepared(vectors), "points")
    tree = pack(points)
    anchors = points.filter(F.col("vec_id") % every == 0)
    none = F.array().cast("array<long>")
    positives = materialize(searched(tree, anchors.withColumn("windows", none), same=True), "positives")
    scores = positives.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("windows"))  # TOP of each
    negatives = searched(tree, anchors.join(scores, anchors.row == scores.anchor_row).drop("anchor_row"), same=False)
    named = positives.select("anchor_row", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (
        negatives.join(named, ["anchor_row", "window"]).join(ids, "anchor_row")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


ORACLE_SQL = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.rid AS ar, a.vec_id AS anchor_id, a.label = r.label AS same, r.rid, r.vec_id, list_inner_product(a.v, r.v)::bigint AS score
  FROM r AS a JOIN r ON a.rid <> r.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, rid) AS j FROM s WHERE same QUALIFY j <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.ar, j ORDER BY score DESC, vec_id, rid))::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""
