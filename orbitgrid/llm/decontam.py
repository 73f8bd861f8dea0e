"""Benchmark decontamination by a prefix-filtered set join (operator 5).

A window is `WINDOW` consecutive words of a benchmark item (a shorter item is one window).
Its tokens are word shingles, ordered by how often they occur in all documents. Exact
containment needs every token of a window, so its prefix is one token, the rarest. A document
position with that token is a candidate for the window that holds it at an offset; the
window must lie within the document (positional and length bound), and its words are then
compared exactly.

Documents stay whole in their rows and never shuffle; what is broadcast is an index of at most
`MAX_WINDOWS` windows. A larger benchmark is taken in as many blocks, each a further pass over
the rows that adds to their hits.

Null texts have no words. Items without words, a null text or a null id have no windows.
Equal item ids are one item. An empty benchmark leaves every document clean. Repeated documents
are judged each, texts of any length whole; an empty table gives an empty one. Columns of the
documents that are named like a result, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.llm.common import add_columns, bound_batches, sub_batches, text_bytes

WINDOW, SHINGLE, MAX_WINDOWS = 13, 4, 200_000
#: A-Z to lower case, word bytes to themselves, all others to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
SLOTS, CANDIDATES = 20, 1 << 16


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows_of(words: list[bytes]) -> list[list[bytes]]:
    if len(words) <= WINDOW:
        return [words] if words else []
    return [words[i : i + WINDOW] for i in range(len(words) - WINDOW + 1)]


def codes(ids: np.ndarray, width: int) -> np.ndarray:
    """One number for each run of `width` word ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    u = ids.astype(np.uint64)
    out = u[:n].copy()
    for i in range(1, width):
        out = out * MIX + u[i : i + n]
    return out


class TokenSet:
    """Sorted codes with a bitmap that answers most absences."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << SLOTS, bool)
        self.bits[self.slot(self.values)] = True

    @staticmethod
    def slot(values: np.ndarray) -> np.ndarray:
        return (values * MIX) >> np.uint64(64 - SLOTS)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `values` that are members, and which member each is."""
        at = np.flatnonzero(self.bits[self.slot(values)])
        i = np.minimum(np.searchsorted(self.values, values[at]), max(0, len(self.values) - 1))
        hit = self.values[i] == values[at] if len(self.values) else np.zeros(0, bool)
        return at[hit], i[hit]


class Words:
    """Word ids of a block of windows; 0 stands for every other word and between documents."""

    def __init__(self, windows: list[list[bytes]]):
        self.vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for x in windows for w in x))}
        self.widths = sorted({min(SHINGLE, len(x)) for x in windows})
        self.rows = [np.array([self.vocab[w] for w in x], np.int64) for x in windows]

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of texts laid end to end with a 0 after each, and each text's first position."""
        parts = [words_of(t) for t in texts]
        starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1, out=starts[1:])
        ids = np.zeros(int(starts[-1]), np.int64)
        get = self.vocab.get
        for part, s in zip(parts, starts.tolist(), strict=False):
            ids[s : s + len(part)] = np.fromiter(map(get, part, repeat(0)), np.int64, len(part))
        return ids, starts


class Rarity:
    """Counts, over documents, of the shingles of a block's windows."""

    def __init__(self, words: Words):
        self.words = words
        self.sets = {w: TokenSet(np.concatenate([codes(r, w) for r in words.rows if min(SHINGLE, len(r)) == w])) for w in words.widths}

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {w: np.zeros(len(s.values), np.int64) for w, s in self.sets.items()}
        for batch in batches:
            for texts in sub_batches(batch.column(0).to_pylist()):
                ids, _ = self.words.ids(texts)
                for w, s in self.sets.items():
                    _, which = s.find(codes(ids, w))
                    total[w] += np.bincount(which, minlength=len(s.values))
        for w, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"width": pa.array(np.full(len(some), w)), "token": pa.array(some), "n": pa.array(n[some])})


class Index:
    """The prefix token of each window, with what is needed to verify it."""

    def __init__(self, rarity: Rarity, counts: dict[tuple[int, int], int], items: list[list[int]]):
        self.words, self.items = rarity.words, items
        self.groups = []
        by_length: dict[int, list[int]] = {}
        for i, row in enumerate(self.words.rows):
            by_length.setdefault(len(row), []).append(i)
        for length, members in sorted(by_length.items()):
            width = min(SHINGLE, length)
            known = rarity.sets[width].values
            often = np.array([counts.get((width, t), 0) for t in range(len(known))], np.int64)
            matrix = np.array([self.words.rows[i] for i in members])
            tokens = np.array([codes(r, width) for r in matrix])
            offset = often[np.searchsorted(known, tokens)].argmin(1)
            prefix = tokens[np.arange(len(members)), offset]
            tokens_used = TokenSet(prefix)
            which = np.searchsorted(tokens_used.values, prefix)
            order = np.argsort(which, kind="stable")
            first = np.searchsorted(which[order], np.arange(len(tokens_used.values) + 1))
            self.groups.append((length, width, matrix, np.array(members), offset, tokens_used, order, first))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and window of every occurrence."""
        starts, lengths, found = [], [], []
        by_width: dict[int, np.ndarray] = {}
        for length, width, matrix, members, offset, tokens, order, first in self.groups:
            if width not in by_width:
                by_width[width] = codes(ids, width)
            at, which = tokens.find(by_width[width])
            n = first[which + 1] - first[which]
            ends = np.cumsum(n)
            total, done = int(ends[-1]) if len(ends) else 0, 0
            while done < total:  # CANDIDATES pairs of a position and a window at once
                pair = np.arange(done, min(done + CANDIDATES, total))
                done += len(pair)
                i = np.searchsorted(ends, pair, side="right")
                member = order[first[which[i]] + pair - (ends[i] - n[i])]
                start = at[i] - offset[member]
                inside = (start >= 0) & (start + length <= len(ids))
                s, m = start[inside], member[inside]
                same = (ids[s[:, None] + np.arange(length)] == matrix[m]).all(1)
                starts.append(s[same])
                found.append(members[m[same]])
                lengths.append(np.full(int(same.sum()), length))
        if not starts:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)

    def judge(self, texts: list[bytes], spans: list, items: list) -> tuple[list, list, list]:
        """Words, merged spans of hit words, and item ids of each text, added to those of earlier blocks."""
        ids, begin = self.words.ids(texts)
        start, length, window = self.hits(ids)
        delta = np.zeros(len(ids) + 1, np.int64)
        np.add.at(delta, start, 1)
        np.add.at(delta, start + length, -1)
        doc = np.searchsorted(begin, start, side="right") - 1
        out_spans, out_items = [], []
        met: dict[int, set[int]] = {}
        for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
            met.setdefault(d, set()).update(self.items[w])
        for d, (s, e) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            if d not in met:
                out_spans.append(spans[d] or [])
                out_items.append(items[d] or [])
                continue
            change = delta[s:e].copy()
            for x in spans[d] or []:
                change[x["begin"]] += 1
                change[x["end"]] -= 1
            hit = np.cumsum(change) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            out_spans.append([{"begin": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            out_items.append(sorted(met[d].union(items[d] or [])))
        return (begin[1:] - begin[:-1] - 1).tolist(), out_spans, out_items


SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPAN), T.StructField("item_ids", T.ArrayType(T.LongType()))])
ARROW_SPAN = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """window (words joined by spaces) and the sorted ids of the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [b" ".join(w) for w in windows_of(words_of(text))]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["item_id", "window"])

    named = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long"), text_bytes().alias("text"))
    return named.mapInArrow(run, "item_id long, window binary").groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` with n_words, hit_spans (word positions, end exclusive) and item_ids of each whole text."""
    sc = docs.sparkSession.sparkContext
    bound_batches(docs.sparkSession)
    windows = benchmark_windows(benchmark).persist()
    blocks = max(1, -(-windows.count() // max_windows))
    texts = docs.select(text_bytes(text_col).alias("text"))
    empty = [F.lit(None).cast(SPAN).alias("hit_spans"), F.lit(None).cast("array<bigint>").alias("item_ids")]
    out = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in FIELDS.names), *empty)
    for block in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()  # about max_windows rows
        words = Words([bytes(r.window).split() for r in rows])
        if not rows:
            index = sc.broadcast(Index(Rarity(words), {}, []))
        else:
            rarity = Rarity(words)
            tokens = sc.broadcast(rarity)
            counted = texts.mapInArrow(lambda it, tokens=tokens: tokens.value.count(it), "width long, token long, n long")
            counts = {(r.width, r.token): r.n for r in counted.groupBy("width", "token").agg(F.sum("n").alias("n")).collect()}
            index = sc.broadcast(Index(rarity, counts, [list(r["items"]) for r in rows]))

        def start(index=index):
            def step(text: pa.Array, spans: pa.Array, items: pa.Array) -> list[pa.Array]:
                all_texts, all_spans, all_items = text.to_pylist(), spans.to_pylist(), items.to_pylist()
                n: list = []
                hit: list = []
                met: list = []
                for run in sub_batches(all_texts):
                    i, j = len(n), len(n) + len(run)
                    for into, got in zip((n, hit, met), index.value.judge(run, all_spans[i:j], all_items[i:j]), strict=True):
                        into += got
                return [pa.array(n, pa.int64()), pa.array(hit, ARROW_SPAN), pa.array(met, pa.list_(pa.int64()))]

            return step

        out = add_columns(out, [text_bytes(text_col), F.col("hit_spans"), F.col("item_ids")], FIELDS, start)
    windows.unpersist()
    return out


def hit_words():
    """Words inside hit_spans."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    out = matches(docs.select("doc_id", "text"), benchmark).withColumn("n_hit", hit_words())
    ids = F.array_sort(F.col("item_ids").cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH lower_docs AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_docs),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
dx AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM dw),
hits AS (SELECT doc_id, n, i, item_id FROM dx JOIN win USING (n, x)),
spans AS (SELECT DISTINCT doc_id, n, i FROM hits),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM spans),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
