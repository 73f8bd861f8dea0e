"""LM scoring by context-tree weighting over binary-decomposed bytes (operator 9).

Every byte is eight binary decisions, each a node of the byte tree. For every node and every
context of 0 to D preceding bytes, training counts give a Krichevsky-Trofimov estimate. The
weighting is CTW's: P_w(s) = (P_kt(s) + prod over longer contexts P_w(cs)) / 2, from all counts
of the training fold, and the posterior weights of all depths mix the estimates into one
conditional probability of each next byte. A node that a context has never met is predicted
by the deepest context that has. A text is its bytes, A-Z lower-cased, and an end byte (0);
before it stand D zero bytes.

D is `DEPTH` at every size. Byte counts of all depths are sums of the counts of D+1 bytes,
gathered from every document in training; this table stays in Spark. Dealt by their last three
bytes, contexts of three and four bytes are weighted group by group (a group has 256 contexts at
most) and pass log P_w up as sums by context of two bytes, node. Contexts of up to two bytes (65,793
at most) are weighted on the driver and broadcast, and the groups are gone through again, down.
The `HOT_CONTEXTS` most frequent contexts of four bytes are broadcast with their probabilities;
bytes after all others, met in training or not, meet theirs in a shuffle join. The number of hot
contexts decides only which way a probability takes, not its value.

The base score needs each word's count over a vocabulary without bound: the `HOT_WORDS` most
frequent words are broadcast, which also takes the skewed keys out; rarer words meet their
counts in a shuffle join.

Null texts are empty: they score their end. With an empty training fold the model is uniform
over bits and the base counts are 0. Repeated rows are scored, and taught from, each; an empty table
gives an empty one. Texts of any length are read whole. A NUL byte in a text is the same symbol as
the end. Only doc_id and text are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitgrid.llm.common import bound_batches, fold_bucket, materialize, sub_batches, text_bytes

FOLDS, DEPTH, HOT_CONTEXTS, HOT_WORDS = 10, 4, 100_000, 100_000
#: Rows of the gram table that are weighted at once, apart from the rest of a group.
BLOCK = 4096
FLUSH_WORDS = 400_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting small arguments; good to about 1e-10."""
    y, out = x.astype(np.float64), np.zeros(x.shape)
    for _ in range(7):
        low = y < 7
        if not low.any():
            break
        out[low] -= np.log(y[low])
        y[low] += 1
    i = 1 / y
    return out + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + i / 12 - i**3 / 360 + i**5 / 1260


def log_kt(t: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability at the 255 nodes of each row of node counts."""
    a, b = t[:, 2::2], t[:, 3::2]
    out = np.zeros(a.shape)
    met = a + b > 0
    a, b = a[met], b[met]
    out[met] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)
    return out


def packed(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """Each byte of the text and its end with the bytes before it, as one integer."""
    a = np.frombuffer(bytes(depth) + text.lower() + b"\0", np.uint8).astype(np.int64)
    n = len(a) - depth
    out = np.zeros(n, np.int64)
    for i in range(depth + 1):
        out = out << 8 | a[i : i + n]
    return out


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = [np.zeros(0, np.int64)]
    counts: list[np.ndarray] = [np.zeros(0, np.int64)]
    for batch in batches:
        for run in sub_batches(batch.column(0).to_pylist()):
            k, n = np.unique(np.concatenate([packed(t) for t in run]), return_counts=True)
            k, n = merged([keys[0], k], [counts[0], n.astype(np.int64)])
            keys, counts = [k], [n]
            if len(k) > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["gram", "n"])
                keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(keys[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(keys[0][i : i + (1 << 17)]), pa.array(counts[0][i : i + (1 << 17)])], names=["gram", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words, n = list(total.keys()), list(total.values())
        for i in range(0, len(words), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + (1 << 16)], pa.binary()), pa.array(n[i : i + (1 << 16)], pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            total.update(text.lower().split())
            if len(total) > FLUSH_WORDS:
                yield from rows()
                total.clear()
    yield from rows()


class ContextTree:
    """log10 probabilities of the next byte in every context, and how contexts are found.

    All contexts are in memory. `longer` gives for the contexts of the greatest depth the sums over
    contexts that are one byte longer of log P_w by node, (context << 8 | node, sum), where those are kept elsewhere.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, chunk: int = 2048, longer: tuple[np.ndarray, np.ndarray] | None = None):
        self.depth = depth
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        level = []  # of each depth: contexts in ascending order, byte counts by (context, byte)
        for d in range(depth + 1):
            k, n = merged([grams & ((1 << 8 * (d + 1)) - 1)], [counts])
            context, at = np.unique(k >> 8, return_inverse=True)
            level.append((context, at, (k & 255), n))
        self.classes(level[0])
        parent = [None] + [np.searchsorted(level[d - 1][0], level[d][0] & ((1 << 8 * (d - 1)) - 1)) for d in range(1, depth + 1)]
        deep = None
        if longer:
            deep = np.zeros((len(level[depth][0]), 255))
            deep[np.searchsorted(level[depth][0], longer[0] >> 8), (longer[0] & 255) - 1] = longer[1]
        weight = self.weights(level, parent, chunk, deep)
        self.fill(level, parent, weight, chunk)
        self.contexts = [x[0] for x in level]
        self.link(level)

    def classes(self, root) -> None:
        """Bytes never met share a column with those that leave the known byte tree at the same node."""
        met = np.zeros(512, bool)
        met[256 + root[2]] = True
        for j in range(255, 0, -1):
            met[j] = met[2 * j] or met[2 * j + 1]
        node = np.arange(256, 512)
        while not met[node].all() and met[1]:
            up = ~met[node] & ~met[node >> 1]
            if not up.any():
                break
            node[up] >>= 1
        _, example, self.column = np.unique(node, return_index=True, return_inverse=True)
        self.example = example

    @staticmethod
    def nodes(level, lo: int, hi: int) -> np.ndarray:
        """Counts at all nodes of the byte tree for contexts lo to hi: node j has children 2j and 2j + 1."""
        context, at, byte, n = level
        i, j = np.searchsorted(at, [lo, hi])
        out = np.zeros((hi - lo, 512))
        out[at[i:j] - lo, 256 + byte[i:j]] = n[i:j]
        for k in range(255, 0, -1):
            out[:, k] = out[:, 2 * k] + out[:, 2 * k + 1]
        return out

    def weights(self, level, parent, chunk: int, longer: np.ndarray | None) -> list[np.ndarray | None]:
        """Posterior weight of each context's own estimate, by node; 1 (None) where no context is longer.

        `longer` is the sum over longer contexts of log P_w.
        """
        out: list[np.ndarray | None] = [None] * (self.depth + 1)
        for d in range(self.depth, -1, -1):
            n = len(level[d][0])
            above = np.zeros((len(level[d - 1][0]), 255)) if d else None
            own_weight = np.ones((n, 255), np.float32) if longer is not None else None
            for lo in range(0, n, chunk):
                hi = min(n, lo + chunk)
                log_w = log_kt(self.nodes(level[d], lo, hi))
                if longer is not None:
                    both = np.logaddexp(log_w, longer[lo:hi]) - math.log(2)
                    own_weight[lo:hi] = np.exp(log_w - math.log(2) - both)
                    log_w = both
                if d:
                    np.add.at(above, parent[d][lo:hi], log_w)
            out[d], longer = own_weight, above
        return out

    def fill(self, level, parent, weight, chunk: int) -> None:
        """Rows of all contexts of all depths, from depth 0 down: sum of weight * estimate along the path."""
        sizes = [len(x[0]) for x in level]
        self.first = np.r_[0, np.cumsum(sizes)]
        self.table = np.zeros((int(self.first[-1]) or 1, len(self.example)), np.float32)
        self.states = []  # of each depth: by context and node what its longer contexts need
        if not self.first[-1]:
            self.table[:] = -8 * math.log10(2)
            return
        above = None
        for d in range(self.depth + 1):
            last = weight[d] is None
            keep = [np.zeros((sizes[d], 255), np.float32) for _ in range(3)] if not last else None
            for lo in range(0, sizes[d], chunk):
                hi = min(sizes[d], lo + chunk)
                t = self.nodes(level[d], lo, hi)
                a, b = t[:, 2::2], t[:, 3::2]
                kt = (b + 0.5) / (a + b + 1)
                if d:
                    mixed, rest, guess = (x[parent[d][lo:hi]].astype(np.float64) for x in above)
                else:
                    mixed, rest, guess = np.zeros((hi - lo, 255)), np.ones((hi - lo, 255)), np.full((hi - lo, 255), 0.5)
                p = np.where(a + b > 0, mixed + rest * kt, guess)
                if not last:
                    w = weight[d][lo:hi]
                    for into, x in zip(keep, (mixed + rest * w * kt, rest * (1 - w), p), strict=True):
                        into[lo:hi] = x
                self.table[self.first[d] + lo : self.first[d] + hi] = self.bytes_of_bits(np.clip(p, 1e-12, 1 - 1e-12))[:, self.example]
            above = keep
            self.states.append(keep)

    @staticmethod
    def bytes_of_bits(p: np.ndarray) -> np.ndarray:
        """log10 probability of each byte from the probability of a 1 at each node."""
        out = np.zeros((len(p), 512))
        one, zero = np.log10(p), np.log10(1 - p)
        for j in range(1, 256):
            out[:, 2 * j] = out[:, j] + zero[:, j - 1]
            out[:, 2 * j + 1] = out[:, j] + one[:, j - 1]
        return out[:, 256:]

    def link(self, level) -> None:
        """Per depth: from a context's place and the byte before it to the longer context's place, or -1."""
        self.steps = []
        for d in range(self.depth):
            table = np.full(len(level[d][0]) * 256 or 1, -1, np.int32)
            longer = level[d + 1][0]
            shorter = np.searchsorted(level[d][0], longer & ((1 << 8 * d) - 1))
            table[shorter * 256 + (longer >> 8 * d)] = np.arange(len(longer))
            self.steps.append(table)

    def score(self, text: bytes) -> float:
        """log10 probability of the text and its end."""
        a = np.frombuffer(bytes(self.depth) + text.lower() + b"\0", np.uint8).astype(np.int64)
        n, total = len(a) - self.depth, 0.0
        for lo in range(0, n, 1 << 20):
            hi = min(n, lo + (1 << 20))
            place = np.zeros(hi - lo, np.int64)
            row = np.zeros(hi - lo, np.int64)
            live = None
            for d, table in enumerate(self.steps):
                before = a[lo + self.depth - 1 - d : hi + self.depth - 1 - d]
                place = table[place * 256 + before]
                if live is None and (place >= 0).all():
                    row = self.first[d + 1] + place
                    continue
                live = (place >= 0) if live is None else live & (place >= 0)
                place = np.where(live, place, 0)
                row = np.where(live, self.first[d + 1] + place, row)
            total += float(self.table[row, self.column[a[lo + self.depth : hi + self.depth]]].sum(dtype=np.float64))
        return total


def fit_tree(texts: DataFrame, depth: int = DEPTH) -> ContextTree:
    """A tree from all `texts` (text: binary) in the driver's memory: for small texts."""
    mask = (1 << 8 * (depth + 1)) - 1
    grams = texts.select("text").mapInArrow(_count_bytes, "gram long, n long").groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("n").alias("n"))
    rows = grams.toArrow()
    return ContextTree(rows.column("gram").to_numpy(), rows.column("n").to_numpy(), depth)


class Block:
    """Contexts of four bytes in whole groups, a group being all that end in the same three."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        key, self.at = np.unique((gram >> 8 & 0xFFFFFF) << 8 | gram >> 32, return_inverse=True)
        self.context = (key & 255) << 24 | key >> 8
        first = np.r_[True, key[1:] >> 8 != key[:-1] >> 8]
        self.parent, begin = np.cumsum(first) - 1, np.flatnonzero(first)
        self.near = key[begin] >> 8
        self.counts = np.zeros((len(key), 512))
        self.counts[self.at, 256 + (gram & 255)] = n
        for k in range(255, 0, -1):
            self.counts[:, k] = self.counts[:, 2 * k] + self.counts[:, 2 * k + 1]
        self.near_counts = np.add.reduceat(self.counts, begin, axis=0)
        own = log_kt(self.near_counts)
        self.log_w = np.logaddexp(own, np.add.reduceat(log_kt(self.counts), begin, axis=0)) - math.log(2)
        self.weight = np.exp(own - math.log(2) - self.log_w)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(context of two bytes << 8 | node, sum of log P_w over the groups that end in it)."""
        group, node = np.nonzero((self.near_counts[:, 2::2] + self.near_counts[:, 3::2]) > 0)
        k, at = np.unique((self.near[group] & 0xFFFF) << 8 | (node + 1), return_inverse=True)
        return k, np.bincount(at, self.log_w[group, node], len(k))

    def bits(self, rows: np.ndarray, place: np.ndarray, mixed: np.ndarray, rest: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """Probability of a 1 at each node in the contexts `rows`, from the state of their shorter contexts."""
        group, of = np.unique(self.parent[rows], return_inverse=True)
        at = place[self.near[group] & 0xFFFF]
        m, r, p = (x[at].astype(np.float64) for x in (mixed, rest, guess))
        a, b = self.near_counts[group, 2::2], self.near_counts[group, 3::2]
        kt, w = (b + 0.5) / (a + b + 1), self.weight[group]
        p = np.where(a + b > 0, m + r * kt, p)
        m, r = (m + r * w * kt)[of], (r * (1 - w))[of]
        a, b = self.counts[rows, 2::2], self.counts[rows, 3::2]
        p = np.where(a + b > 0, m + r * ((b + 0.5) / (a + b + 1)), p[of])
        return np.clip(p, 1e-12, 1 - 1e-12)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in whole groups, from rows (gram first) in the order of `grouped`."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) < BLOCK:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        near = columns[0] >> 8 & 0xFFFFFF
        whole = int(np.flatnonzero(near != near[-1])[-1]) + 1 if near[0] != near[-1] else 0
        if whole:
            yield [c[:whole] for c in columns]
        held = [[c[whole:] for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def grouped(rows: DataFrame) -> DataFrame:
    """`rows` (gram and others) with the rows of each group side by side."""
    near = F.shiftright("gram", 8).bitwiseAND(0xFFFFFF)
    return rows.withColumn("near", near).repartition("near").sortWithinPartitions(F.col("near").bitwiseAND(0xFFFF), "near").drop("near")


def _group_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for gram, n in blocks(batches):
        k, w = Block(gram, n).sums()
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(w)], names=["key", "w"])


class HotContexts:
    """log10 probabilities of the next byte in the most frequent contexts of four bytes; place 0 is every other context."""

    def __init__(self, context: np.ndarray, table: np.ndarray, column: np.ndarray):
        order = np.argsort(context)
        context = context[order]
        self.table = np.concatenate([np.zeros((1, table.shape[1]), np.float32), table[order]])
        self.column = column
        two, three = np.unique(context & 0xFFFF), np.unique(context & 0xFFFFFF)
        self.first = np.zeros(1 << 16, np.int32)
        self.first[two] = np.arange(1, len(two) + 1)
        self.second = np.zeros((len(two) + 1) * 256, np.int32)
        self.second[self.first[three & 0xFFFF] * 256 + (three >> 16)] = np.arange(1, len(three) + 1)
        self.third = np.zeros((len(three) + 1) * 256, np.int32)
        self.third[(np.searchsorted(three, context & 0xFFFFFF) + 1) * 256 + (context >> 24)] = np.arange(1, len(context) + 1)

    def score(self, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """log10 probability of the bytes after hot contexts, the grams of all others and how often each occurs."""
        a = np.frombuffer(bytes(DEPTH) + text.lower() + b"\0", np.uint8).astype(np.int64)
        n, total = len(a) - DEPTH, 0.0
        grams, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, n, 1 << 20):
            hi = min(n, lo + (1 << 20))
            c1, c2, c3, c4, x = (a[lo + i : hi + i] for i in range(DEPTH + 1))
            place = self.third[self.second[self.first[c3 << 8 | c4] * 256 + c2] * 256 + c1]
            total += float(self.table[place, self.column[x]].sum(dtype=np.float64))
            i = np.flatnonzero(place == 0)
            if len(i):
                k, m = np.unique(c1[i] << 32 | c2[i] << 24 | c3[i] << 16 | c4[i] << 8 | x[i], return_counts=True)
                grams.append(k)
                counts.append(m)
        return total, *merged(grams, counts)


class Model:
    """The tree over all contexts: gram counts in Spark, the contexts of up to two bytes and the hot ones in memory."""

    def __init__(self, texts: DataFrame):
        """A model from all `texts` (text: binary)."""
        spark = texts.sparkSession
        counted = texts.select("text").mapInArrow(_count_bytes, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        self.grams = materialize(counted, "grams")
        sums = grouped(self.grams).mapInArrow(_group_sums, "key long, w double").groupBy("key").agg(F.sum("w").alias("w")).toArrow()  # 255 * 65,536 rows at most
        short = self.grams.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # 256 * 65,536 rows at most
        tree = ContextTree(short.column("gram").to_numpy(), short.column("n").to_numpy(), 2, longer=(sums.column("key").to_numpy(), sums.column("w").to_numpy()))
        # rows: what holds before any context, then all contexts of no byte, one and two; the deepest one met stands for a context
        one = np.ones((1, 255), np.float32)
        state = [np.concatenate(x) for x in zip((one * 0, one, one / 2), *tree.states, strict=True)]
        place, begin, two = np.zeros(1 << 16, np.int32), 1, np.arange(1 << 16)
        for d, known in enumerate(tree.contexts):
            i = np.searchsorted(known, two & ((1 << 8 * d) - 1))
            met = np.isin(two & ((1 << 8 * d) - 1), known)
            place[met] = begin + i[met]
            begin += len(known)
        self.state = spark.sparkContext.broadcast((place, *state))
        self.column, self.example = tree.column, tree.example
        self.hot = self.most_frequent()

    def most_frequent(self) -> HotContexts:
        by_context = self.grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("n"))
        hot = np.sort(by_context.orderBy(F.col("n").desc(), "context").limit(HOT_CONTEXTS).select("context").toArrow().column(0).to_numpy())
        shared, example = self.state, self.example
        spark = self.grams.sparkSession
        named = spark.sparkContext.broadcast(hot)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for gram, n in blocks(batches):
                near = np.isin(gram >> 8 & 0xFFFFFF, (named.value & 0xFFFFFF)[np.isin(named.value & 0xFFFFFF, gram >> 8 & 0xFFFFFF)])
                if not near.any():
                    continue
                block = Block(gram[near], n[near])
                rows = np.flatnonzero(np.isin(block.context, named.value))
                table = ContextTree.bytes_of_bits(block.bits(rows, *shared.value))[:, example].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(block.context[rows]), pa.array([r.tobytes() for r in table], pa.binary())], names=["context", "row"])

        rows = grouped(self.grams).mapInArrow(run, "context long, row binary").toArrow()  # HOT_CONTEXTS rows
        table = np.frombuffer(b"".join(rows.column("row").to_pylist()), np.float32).reshape(-1, len(example))
        return HotContexts(rows.column("context").to_numpy(), table, self.column)

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """gram and log10 probability `p` of its last byte after the others, for distinct `grams`, met in training or not."""
        shared = self.state

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for gram, n, asked in blocks(batches):
                near = np.isin(gram >> 8 & 0xFFFFFF, gram[asked] >> 8 & 0xFFFFFF)
                if not near.any():
                    continue
                gram, n, asked = gram[near], n[near], asked[near]
                block = Block(gram, n)
                rows, at = np.unique(block.at[asked], return_inverse=True)
                p = block.bits(rows, *shared.value)
                gram = gram[asked]
                byte, total = 256 | gram & 255, np.zeros(len(gram))
                for k in range(8):
                    one = p[at, (byte >> 8 - k) - 1]
                    total += np.log10(np.where(byte >> 7 - k & 1, one, 1 - one))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(total)], names=["gram", "p"])

        both = self.grams.select("gram", "n", F.lit(False).alias("asked")).unionByName(grams.select("gram", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
        both = both.groupBy("gram").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
        return grouped(both).mapInArrow(run, "gram long, p double")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select("doc_id", text_bytes().alias("text"), (fold_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    counts = materialize(train.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = train.select("doc_id").count()
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, distinct = size[0] + ends, size[1] + (1 if ends else 0)
    base = 0.1 * (distinct + 1) + n_all
    hot_rows = counts.orderBy(F.col("n").desc(), "word").limit(HOT_WORDS)
    table = hot_rows.toArrow()  # HOT_WORDS rows
    hot = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
    floor = min(hot.values(), default=0)
    del table
    log = lambda c: math.log10((c + 0.1) / base)
    model = Model(train)
    shared = spark.sparkContext.broadcast((model.hot, hot, log(ends), int(ends > 0), base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, hot, end, end_known, base = shared.value
        known = {w: math.log10((c + 0.1) / base) for w, c in hot.items()}
        for batch in batches:
            doc_id, text, held = batch.columns
            out: list[list] = [[], [], [], [], [], [], [], [], []]
            for t in text.to_pylist():
                low = t.lower()
                words = low.split()
                got = [known.get(w) for w in words]
                rare = Counter(w for w, g in zip(words, got, strict=True) if g is None)
                common = [g for g in got if g is not None]
                for into, x in zip(out, (len(words) + 1, len(common) + end_known, math.fsum(common) + end, *tree.score(low), len(t), list(rare.keys()), list(rare.values())), strict=True):
                    into.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            names = ["doc_id", "held_out", "n_tokens", "hot_known", "hot_score", "tree_score", "cold", "cold_n", "n_bytes", "rare", "rare_n"]
            yield pa.RecordBatch.from_arrays([doc_id, held, *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, hot_known long, hot_score double, tree_score double, cold array<long>, cold_n array<long>, n_bytes long, rare array<binary>, rare_n array<long>"
    part = rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    part = materialize(part, "scores")  # `row` is fixed from here on
    rare = part.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("tf"))
    cold = counts.filter(F.col("n") <= floor) if floor else counts
    met = rare.join(cold, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    after = part.select("row", F.explode(F.arrays_zip("cold", "cold_n")).alias("x")).select("row", F.col("x.cold").alias("gram"), F.col("x.cold_n").alias("tf"))
    told = after.join(model.probabilities(after.select("gram").distinct()), "gram")
    none = F.lit(None)
    of_words = met.select("row", (F.col("tf") * F.log10((F.col("c") + 0.1) / base)).alias("base"), F.when(F.col("c") > 0, F.col("tf")).alias("known"), none.cast("double").alias("tree"))
    of_bytes = told.select("row", none.cast("double").alias("base"), none.cast("long").alias("known"), (F.col("tf") * F.col("p")).alias("tree"))
    sums = of_words.unionByName(of_bytes).groupBy("row").agg(F.sum("base").alias("rare_score"), F.sum("known").alias("rare_known"), F.sum("tree").alias("cold_score"))
    zero, score = F.lit(0), F.col("tree_score") + F.coalesce("cold_score", F.lit(0.0))
    return part.drop("rare", "rare_n", "cold", "cold_n").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), score.alias("score"),
        (score * -math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
