"""Spelling variants by k-d trees over letter counts (operator 11).

A word is a point: how often each letter occurs. A replaced letter moves the point by 2 in L1, an inserted
or deleted one by 1. Words of one length are dealt to the cells of a k-d tree whose splits come from
a bounded sample; a word is looked up in the cells of its length within 2 and in those of the next smaller length
within 1. In a cell a k-d tree of its own cuts the points down to leaves; boxes that are too far from a
query drop it. The letters of what is left are compared in order.

Cells with more words than `CELL_WORDS` are dealt into blocks, each searched by all queries of the cell: no
word is left out, at any size. A pair of words is found once.

Null texts have no words. A null doc_id is hashed as an empty one. Rows that repeat count each, texts of any length
whole. Other columns, whatever their names, are not read. An empty table gives no rows. The most frequent near word is a
word's form if it is at least `RATIO` times as frequent; ties go to the smallest in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitgrid.llm.common import bound_batches, materialize, text_bytes

#: Fixed values of the task: code points of a word and its occurrences at least, share of runs that lose a letter, how much more frequent a form is.
MIN_LETTERS, MIN_COUNT, DROPPED, RATIO = 5, 3, 97, 2
#: Most words that the splits are taken from; words of a cell; points of a leaf.
SAMPLE_WORDS, CELL_WORDS, LEAF = 100_000, 4096, 24
#: Distinct words that a task counts before it hands them on; bytes of a text looked at at once.
HELD_WORDS, SLICE = 300_000, 4 << 20
#: Longest word whose letters are compared as rows of a matrix.
MATRIX_LETTERS = 64
#: Bytes of letters stay, all others become spaces: a-z, and C3 with what follows it (U+00C0 to U+00FF).
BLANKED = bytes(b if 97 <= b <= 122 or 0x80 <= b <= 0xBF or b == 0xC3 else 32 for b in range(256))
#: Code points beyond ASCII that are no letters here.
WIDE = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
ASCII_BLANKED = bytes(b if 97 <= b <= 122 else 32 for b in range(256))
#: Dimensions: a to z, then U+00C0 to U+00FF.
LETTERS = 26 + 64


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The letter runs of a text, A-Z in lower case, some megabytes at a time."""
    text = text.lower()  # of bytes: A-Z only
    if text.isascii():
        text = text.translate(ASCII_BLANKED)
    else:
        text = WIDE.sub(b" ", text.decode("utf-8", "replace").encode()).translate(BLANKED)
    start = 0
    while start < len(text):
        stop = text.find(b" ", start + SLICE)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


def without(run: bytes, h: int) -> bytes:
    """The run without the code point at h % length."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def count_runs(doc_id: str, text: bytes, counts: Counter) -> None:
    """Add the words of a document to `counts`."""
    seed = zlib.crc32(f"{doc_id}:".encode())
    crc32 = zlib.crc32
    for runs in slices(text):
        counts.update(runs)
        own = Counter(runs)
        for run in [r for r in own if not crc32(r, seed) % DROPPED]:
            n = own[run]
            counts[run] -= n
            counts[without(run, crc32(run, seed))] += n


def words(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of every word of `docs` that is long and frequent enough."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if n and len(w) >= min_letters]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count_runs(doc_id, text, counts)
                if len(counts) > HELD_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_bytes().alias("text"))
    counted = rows.mapInArrow(run, "word binary, n long").select(F.col("word").cast("string").alias("word"), "n")
    return counted.filter(F.char_length("word") >= min_letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def letters(batch: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each."""
    return np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32).reshape(len(batch), -1)


def points(batch: list[str]) -> np.ndarray:
    """Letter counts of words of one length."""
    codes = letters(batch).astype(np.int64)
    dims = np.where(codes < 128, codes - 97, codes - 0xC0 + 26)
    n, length = dims.shape
    flat = np.bincount((dims + np.arange(n)[:, None] * LETTERS).ravel(), minlength=n * LETTERS).reshape(n, LETTERS)
    return flat.astype(np.int16 if length < 1 << 14 else np.int64)


#: (dimension, threshold, left, right): counts up to the threshold go left; a leaf is a cell number.
Node = tuple | int


def splits(sample: np.ndarray, words_each: float, next_cell: int) -> tuple[Node, int]:
    """A k-d tree over a sample in which a point stands for `words_each` words; cells get numbers from `next_cell` on."""
    if len(sample) * words_each > CELL_WORDS:
        spread = sample.var(0)
        for d in np.argsort(-spread, kind="stable")[: np.count_nonzero(spread)].tolist():
            at = int(np.median(sample[:, d]))
            at = at if (sample[:, d] > at).any() else at - 1
            left = sample[:, d] <= at
            if left.any() and not left.all():
                a, next_cell = splits(sample[left], words_each, next_cell)
                b, next_cell = splits(sample[~left], words_each, next_cell)
                return (d, at, a, b), next_cell
    return next_cell, next_cell + 1


def home(node: Node, at: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    out = np.empty(len(at), np.int64)

    def descend(node: Node, mine: np.ndarray) -> None:
        if isinstance(node, int):
            out[mine] = node
        elif len(mine):
            left = at[mine, node[0]] <= node[1]
            descend(node[2], mine[left])
            descend(node[3], mine[~left])

    descend(node, np.arange(len(at)))
    return out


def reached(node: Node, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of a point, cell) of all cells within `radius` in L1."""
    who: list[np.ndarray] = []
    cell: list[np.ndarray] = []

    def descend(node: Node, mine: np.ndarray, far: np.ndarray, sides: dict) -> None:
        near = far <= radius
        mine, far = mine[near], far[near]
        if not len(mine):
            return
        if isinstance(node, int):
            who.append(mine)
            cell.append(np.full(len(mine), node))
            return
        d, t, left, right = node
        low, high = sides.get(d, (0, 1 << 40))
        x = at[mine, d].astype(np.int64)
        was = np.maximum(low - x, 0) + np.maximum(x - high, 0)
        for child, side in ((left, (low, min(high, t))), (right, (max(low, t + 1), high))):
            now = np.maximum(side[0] - x, 0) + np.maximum(x - side[1], 0)
            descend(child, mine, far - was + now, {**sides, d: side})

    descend(node, np.arange(len(at)), np.zeros(len(at), np.int64), {})
    none = np.empty(0, np.int64)
    return np.concatenate(who or [none]), np.concatenate(cell or [none])


def candidates(at: np.ndarray, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, query) index pairs within `radius`, by a k-d tree whose tight boxes drop queries that are too far."""
    used = np.flatnonzero(at.any(0))
    # letters that no point has only add to a query's distance
    beyond = query.sum(1) - query[:, used].sum(1)
    at, query = np.ascontiguousarray(at[:, used]), np.ascontiguousarray(query[:, used])
    todo = [(np.arange(len(at)), np.flatnonzero(beyond <= radius))]
    while todo:
        mine, asked = todo.pop()
        box = at[mine]
        low, high = box.min(0), box.max(0)
        for k in range(0, len(asked), 8192):
            some = query[asked[k : k + 8192]]
            far = np.maximum(np.maximum(low - some, some - high), 0).sum(1) + beyond[asked[k : k + 8192]]
            asked[k : k + 8192][far > radius] = -1
        asked = asked[asked >= 0]
        if not len(asked):
            continue
        if len(mine) <= LEAF or (low == high).all():
            for k in range(0, len(asked), max(1, (1 << 15) // len(mine))):
                some = asked[k : k + max(1, (1 << 15) // len(mine))]
                far = np.abs(query[some][:, None, :] - box[None, :, :]).sum(2) + beyond[some][:, None]
                q, p = np.nonzero(far <= radius)
                if len(q):
                    yield mine[p], some[q]
            continue
        d = int(np.argmax(box.var(0)))
        t = np.median(box[:, d])
        left = box[:, d] <= t if (box[:, d] > t).any() else box[:, d] < t
        todo += [(mine[left], asked.copy()), (mine[~left], asked)]


def one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of `a` become those of `b` by exactly one replaced letter or, if `b` is longer by one, one inserted letter."""
    n, length = a.shape
    if b.shape[1] == length:
        return (a != b).sum(1) == 1
    differ = np.column_stack([a != b[:, :-1], np.ones(n, bool)])
    head = differ.argmax(1)  # letters that agree from the front
    differ = np.column_stack([(a != b[:, 1:])[:, ::-1], np.ones(n, bool)])
    return head + differ.argmax(1) >= length


def near(inside: list[str], asking: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of an inside word, of an asking word) one edit apart; `asking` has the same length or one letter more."""
    if not inside or not asking:
        return
    longer = len(asking[0]) - len(inside[0])
    small = len(asking[0]) <= MATRIX_LETTERS
    a, b = (letters(inside), letters(asking)) if small else (None, None)
    for p, q in candidates(points(inside), points(asking), 1 if longer else 2):
        if small:
            good = one_apart(a[p], b[q])
        else:
            good = np.array([bool(one_apart(letters([inside[i]]), letters([asking[j]]))[0]) for i, j in zip(p.tolist(), q.tolist(), strict=True)], bool)
        yield p[good], q[good]


def trees(vocabulary: DataFrame) -> tuple[dict[int, Node], dict[int, int]]:
    """Splits for each length, and blocks of each cell: from a bounded sample, by counts of all words."""
    length = F.char_length("word").alias("length")
    sizes = {r.length: r.n for r in vocabulary.groupBy(length).agg(F.count("*").alias("n")).collect()}  # one row for each length
    total = sum(sizes.values())
    share = min(1.0, SAMPLE_WORDS / max(1, total))
    picked = vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else vocabulary
    # words longer than this are few and make one cell for each length
    by_length: dict[int, list[str]] = {}
    for r in picked.filter(F.char_length("word") <= MATRIX_LETTERS).select("word").collect():  # SAMPLE_WORDS in the mean
        by_length.setdefault(len(r.word), []).append(r.word)
    out, next_cell = {}, 0
    for n in sorted(sizes):
        sample = sorted(by_length.get(n, []))
        if sample:
            out[n], next_cell = splits(points(sample), sizes[n] / len(sample), next_cell)
        else:
            out[n], next_cell = next_cell, next_cell + 1
    return out


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a and b of all pairs of words one edit apart, each pair once, with their n (n_a, n_b)."""
    spark = vocabulary.sparkSession
    bound_batches(spark)
    of = spark.sparkContext.broadcast(trees(vocabulary))  # splits of a bounded sample

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in texts])
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                at = points([texts[i] for i in rows.tolist()])
                own = home(of.value[n], at)
                who, cell = reached(of.value[n], at, 2)
                lower = cell < own[who]  # the other cell's words are not sent here: a pair meets once
                who, cell, role = [np.arange(len(rows)), who[lower]], [own, cell[lower]], [np.zeros(len(rows), np.int8), np.ones(int(lower.sum()), np.int8)]
                if n - 1 in of.value:
                    w, c = reached(of.value[n - 1], at, 1)
                    who, cell, role = [*who, w], [*cell, c], [*role, np.ones(len(w), np.int8)]
                at_rows = rows[np.concatenate(who)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(cell).astype(np.int64)), pa.array(np.concatenate(role)), batch.column(0).take(pa.array(at_rows)), pa.array(counts[at_rows]),
                ], names=["cell", "asks", "word", "n"])

    sent = materialize(vocabulary.select("word", "n").mapInArrow(dealt, "cell long, asks byte, word string, n long"), "cells")
    # a cell with more words than CELL_WORDS is searched block by block: words by hash, queries in every block
    large = sent.filter("asks = 0").groupBy("cell").agg(F.ceil(F.count("*") / CELL_WORDS).cast("int").alias("blocks"))
    sent = sent.join(large, "cell")
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = sent.select("cell", "asks", "word", "n", F.explode(F.when(F.col("asks") == 0, F.array(block)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("block"))
    # words of a large cell also ask in the cell's earlier blocks
    own = sent.filter("asks = 0 and blocks > 1").select("cell", F.lit(1).cast("byte").alias("asks"), "word", "n", F.explode(F.sequence(F.lit(0), block)).alias("block"), block.alias("mine")).filter("block < mine").drop("mine")
    schema = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        asks, texts, n = table.column("asks").to_numpy(), table.column("word").to_pylist(), table.column("n").to_numpy()
        lengths = np.array([len(w) for w in texts])
        inside = np.flatnonzero(asks == 0)
        if not len(inside):
            return schema.empty_table()
        length, found = int(lengths[inside[0]]), []
        held = [texts[i] for i in inside.tolist()]
        for more, who in ((0, inside), (0, np.flatnonzero((asks == 1) & (lengths == length))), (1, np.flatnonzero((asks == 1) & (lengths == length + 1)))):
            for p, q in near(held, [texts[i] for i in who.tolist()]):
                if who is inside:
                    p, q = p[p < q], q[p < q]
                found.append(np.column_stack([inside[p], who[q]]))
        a, b = np.concatenate(found).T if found else (np.empty(0, np.int64),) * 2
        word = table.column("word")
        return pa.Table.from_arrays([word.take(pa.array(a)), pa.array(n[a]), word.take(pa.array(b)), pa.array(n[b])], schema=schema)

    return rows.unionByName(own).groupBy("cell", "block").applyInArrow(search, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form), by pointers that double their reach; a form's n doubles at least, so 64 steps reach any root."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(7):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `vocabulary` (word, n; words distinct)."""
    vocabulary = materialize(vocabulary.select("word", "n"), "words")
    pairs = near_pairs(vocabulary)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"), F.first("n").alias("n"))
    judged = best.select("word", "n_near", F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f"))
    judged = materialize(judged.select("word", "n_near", "f.form", "f.form_n"), "near-words")
    out = vocabulary.join(judged, "word", "left").join(roots(judged.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def grouped(docs: DataFrame) -> DataFrame:
    return variants(words(docs))
