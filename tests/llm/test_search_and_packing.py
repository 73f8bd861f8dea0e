"""Spelling variants, packing and hard negatives against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbitgrid.llm import hard_negatives, packing, spelling
from orbitgrid.llm.common import read_table, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
RND = random.Random(11)
DOCS = "doc_id long, text string, word string, n long, length long, sequence_id string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "w", 1, 2, "s") for i, t in texts], DOCS)


# spelling variants


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def edits(w, alphabet):
    for i in range(len(w)):
        yield w[:i] + w[i + 1 :]
        yield from (w[:i] + c + w[i + 1 :] for c in alphabet if c != w[i])
    for i in range(len(w) + 1):
        yield from (w[:i] + c + w[i:] for c in alphabet)


def brute_variants(words):
    alphabet, form, near = sorted(set("".join(words))), {}, {}
    for w, n in words.items():
        near[w] = {e for e in edits(w, alphabet)} & words.keys() - {w}
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def got_variants(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_of_the_tables_equal_brute_force(spark):
    if not Path(FOLDER).exists():
        pytest.skip("no test tables here")
    docs = read_table(spark, FOLDER, "documents")
    got = got_variants(spelling.grouped(docs))
    assert len(got) == len(set(got)) and set(got) == brute_variants(brute_words([(r.doc_id, r.text) for r in docs.collect()]))


def test_variants_in_many_small_cells_and_blocks(spark, monkeypatch):
    letters = "abcéÿÉ"
    words = {"".join(RND.choice(letters) for _ in range(RND.randint(5, 8))): RND.randint(3, 40) for _ in range(1500)}
    words |= {"aaaab": 3, "aaaaba": 3, "aaaabab": 3, "x" * 70: 9, "x" * 71: 3, "x" * 69 + "y": 2000, "abcabcabc": 3, "cbacbacba": 8, "bacbacbac": 8}
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_variants(words)
    assert set(got_variants(spelling.variants(vocabulary))) == want
    cells = spelling.CELL_WORDS
    monkeypatch.setattr(spelling, "CELL_WORDS", 40)
    monkeypatch.setattr(spelling, "LEAF", 5)
    assert set(got_variants(spelling.variants(vocabulary))) == want
    # splits from a sample of a few words: their cells are dealt into blocks
    monkeypatch.setattr(spelling, "SAMPLE_WORDS", 30)
    assert set(got_variants(spelling.variants(vocabulary))) == want
    assert cells > 40


def test_a_chain_of_forms_has_one_root(spark):
    chain = ["abcde" + "f" * k for k in range(30)]
    vocabulary = spark.createDataFrame([(w, 3 << k) for k, w in enumerate(chain)], "word string, n long")
    rows = {r.word: r for r in spelling.variants(vocabulary).collect()}
    assert {r.root for r in rows.values()} == {chain[-1]} and rows[chain[0]].form == chain[1] and rows[chain[-1]].form is None


def test_words_of_odd_texts(spark):
    long = " ".join(RND.choice(["Àlphabet", "Betärung", "gamma×rays", "deltaāomega", "müller", "straße"]) for _ in range(30_000))
    texts = [(0, None), (1, ""), (2, "short no Words"), (3, long), (3, long), (None, "nobody nobody nobody"), (4, "nobody’s NOBODY nobody\U0001f600nobody"), (5, "a" * 3_000_000 + " tail tails tails tails")]
    docs = docs_of(spark, texts)
    got = {r.word: r.n for r in spelling.words(docs).collect()}
    assert got == brute_words(texts)


def test_slices_cut_at_blanks_only(monkeypatch):
    text = ("café naïve 中文word " * 500).encode()
    want = [r.encode() for r in re.findall("[a-zÀ-ÿ]+", text.decode())]
    monkeypatch.setattr(spelling, "SLICE", 7)
    assert [r for s in spelling.slices(text) for r in s] == want


def test_no_documents_no_variants(spark):
    none = docs_of(spark, [])
    assert spelling.grouped(none).count() == 0


# packing


def library_ids(text):
    t = library_ids.tokenizer
    return t.encode(text or "", add_special_tokens=False).ids + [0]


library_ids.tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
library_ids.tokenizer.no_truncation()
library_ids.tokenizer.no_padding()


def check_places(rows, size):
    """Sequences filled without gaps, none over `size`; their number."""
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(of)


def test_packing_equals_the_library_and_wastes_little(spark):
    texts = [(0, None), (1, ""), (2, "word " * 2047), (3, "word " * 2048), (4, "word " * 5000), (4, "word " * 5000), (None, "of nobody"), (7, "x" * 200_000)]
    texts += [(10 + i, " ".join(RND.choice(["alpha", "beta", "gamma"]) for _ in range(int(RND.paretovariate(0.7)) % 3000))) for i in range(700)]
    rows = packing.packed(docs_of(spark, texts)).collect()
    want = Counter()
    for i, t in texts:
        ids = library_ids(t)
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            want[(i, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(r.length for r in rows)
    assert check_places(rows, 2048) <= -(-total // 2048) + 1


def test_sequences_hold_the_ids_of_their_pieces(spark):
    texts = [(i, " ".join(["alpha"] * RND.randint(0, 60))) for i in range(200)]
    cut = packing.pieces(docs_of(spark, texts), size=50)
    placed = packing.place(cut.withColumn("Offset", F.lit("old")), size=50)
    assert placed.columns == ["doc_id", "piece", "start", "length", "raw", "sequence_id", "offset"]
    ids = dict(texts)
    for r in packing.sequences(placed).collect():
        flat = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(flat) == r.n_tokens <= 50
        for p in r.pieces:
            whole = library_ids(ids[p.doc_id])
            assert flat[p.offset : p.offset + p.length] == whole[p.piece * 50 : p.piece * 50 + p.length]


def _next(runs, length, first, histogram):
    later = runs[(runs[:, 0] == length) & (runs[:, 1] > first), 1]
    return int(later.min()) if len(later) else int(histogram[length])


@pytest.mark.parametrize("size", [1, 2, 7, 64, 512])
def test_plans_place_every_piece_once(size):
    rng = np.random.default_rng(size)
    for scale in (0, 1, 3, 1000):
        histogram = rng.integers(0, scale + 1, size + 1)
        histogram[0] = 0
        runs, of = packing.plan(histogram, size), defaultdict(list)
        for length in range(1, size + 1):
            mine = runs[runs[:, 0] == length]
            if scale <= 3:
                for rank in range(histogram[length]):
                    _, first, sequence, offset, each = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                    of[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
        for places in of.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size
        if scale == 1000:
            # the last run of a sequence tells how many there are; best fit alone is the measure
            made = max((s + -(-(n - first) // each) for length, first, s, _, each in runs for n in [_next(runs, length, first, histogram)]), default=0)
            assert made <= 1.01 * sum(count for count, _ in packing.best_fit(histogram, size)) + 1
        assert len(runs) <= 40 * size + 10


def test_patterns_carry_most_of_a_histogram():
    rng = np.random.default_rng(3)
    histogram = np.zeros(257, np.int64)
    a = rng.integers(20, 237, 40_000)
    np.add.at(histogram, a, 1)
    np.add.at(histogram, 256 - a, 1)
    cols = packing.patterns(np.flatnonzero(histogram), 256)
    assert set(cols.sum(1).tolist()) == {256} and len(np.unique(cols, axis=0)) == len(cols)
    times = packing.rounded(cols, packing.fit(cols, histogram), histogram)
    used = np.zeros_like(histogram)
    np.add.at(used, cols.ravel(), np.repeat(times, 3))
    assert (used[1:] <= histogram[1:]).all() and used[1:].sum() > 0.9 * histogram.sum()


def test_places_of_no_or_unfit_pieces(spark):
    assert packing.packed(docs_of(spark, [])).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        packing.place(spark.createDataFrame([(60,)], "length long"), size=50)


# hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, row long, score string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, y, 0, "s") for i, v, y in rows], VECTORS)


def brute_negatives(rows):
    held = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        if i is not None and i % 7 == 0:
            y = (y + 1) % 10
        held.append((i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = Counter()
    last = 1 << 70
    for a, (i, y, v) in enumerate(held):
        if i is None or i % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), last if j is None else j, j, z) for b, (j, z, w) in enumerate(held) if b != a]  # noqa: B905  shorter vectors end in zeros
        for p, _, j, _ in sorted((s for s in scored if s[3] == y), key=lambda s: s[:2])[:5]:
            fits = sorted((s for s in scored if s[3] != y and 80 * -p <= 100 * -s[0] <= 100 * -p), key=lambda s: s[:2])[:5]
            for rank, (n, _, k, _) in enumerate(fits, 1):
                out[(i, j, rank, k, -p, -n)] += 1
    return out


def got_negatives(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def random_vectors(n, dim, labels, near=0.3):
    centres = [[RND.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + RND.gauss(0, near) for c in RND.choice(centres)], RND.randrange(labels)) for i in range(n)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = random_vectors(900, 6, 10)
    want = brute_negatives(rows)
    assert sum(want.values()) > 50
    assert got_negatives(hard_negatives.mined(vectors_of(spark, rows))) == want
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    assert got_negatives(hard_negatives.mined(vectors_of(spark, rows).repartition(7))) == want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [RND.choice([0.0, 0.25, 0.5]), RND.choice([0.0, 0.25]), 0.5], RND.randrange(3)) for i in range(420)]  # many ties
    rows += rows[100:201:50]  # repeated rows, anchors too
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [nan], 1), (800, [inf, 1.0, 1.0], 1), (900, [1.0, 1.0, 1.0], None), (1000, [], 1), (1100, [0.5], 2), (1200, [0.5, 0.5, 0.5, 9.0], 1)]
    rows += [(None, [0.5, 0.25, 0.5], 0), (None, [0.5, 0.25, 0.5], 1), (1300, [-1.0, -1.0, -1.0], 5), (1400, [0.5, 0.5, 0.5], -3), (1500, [1.0, 1.0, 1.0], 77)]
    assert got_negatives(hard_negatives.mined(vectors_of(spark, rows))) == brute_negatives(rows)


def test_negatives_of_large_components(spark):
    rows = [(i, [RND.uniform(-1e6, 1e6) for _ in range(3)], RND.randrange(2)) for i in range(201)]
    assert got_negatives(hard_negatives.mined(vectors_of(spark, rows))) == brute_negatives(rows)
    huge = [(i, [1e30, float(i)], i % 2) for i in range(101)]
    assert {r.positive_score for r in hard_negatives.mined(vectors_of(spark, huge)).collect()} <= {hard_negatives.LONG.max}


def test_no_vectors_no_negatives(spark):
    assert hard_negatives.mined(vectors_of(spark, [])).count() == 0
    assert hard_negatives.mined(vectors_of(spark, [(100, None, 1)])).count() == 0


def test_boxes_bound_their_vectors_and_drop_leaves():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 8, (12, 4))
    held = [[r, r, int(k), (centres[k] + rng.normal(0, 0.1, 4)).tolist()] for r, k in enumerate(rng.integers(0, 12, 2000))]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0] * 2000), pa.array([h[0] for h in held]), pa.array([h[1] for h in held]), pa.array([h[2] for h in held]), pa.array([h[3] for h in held])], names=list("prilv"))
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("low_label", pa.int64()), ("high_label", pa.int64()), *((k, pa.binary()) for k in ("row", "vec_id", "label", "matrix", "leaf"))])
    (row,) = [r for b in hard_negatives._shards(iter([batch]), schema) for r in b.to_pylist()]
    tree = hard_negatives.Tree(*(row[k] for k in ("n", "dim", "row", "vec_id", "label", "matrix", "leaf")))
    anchor = tree.matrix[:1]
    least, most = tree.bounds(anchor)
    for i, (a, b) in enumerate(zip(tree.leaf_start, tree.leaf_stop, strict=True)):
        s = tree.matrix[a:b] @ anchor[0]
        assert least[0][i] <= s.min() and s.max() <= most[0][i] and tree.least[i] <= tree.labels[a:b].min() and tree.labels[a:b].max() <= tree.most[i]
    looked = []
    scores = tree.scores
    tree.scores = lambda *x: looked.append(x[1]) or scores(*x)
    tree.search(anchor[0], least[0], most[0], np.ones(len(most[0]), bool), -1, int(tree.labels[0]), False, [(0, 1 << 40)])
    assert 0 < len(looked) < len(tree.leaf_start) / 2
