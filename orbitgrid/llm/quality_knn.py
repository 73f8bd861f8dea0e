"""Quality scores by nearest-neighbour voting in a latent-semantic space (operator 3).

A text's terms are its byte-class trigrams (shape, not vocabulary, so that every language
shares them) and graded repetition terms. Labelled texts give a tf-idf matrix whose leading
right singular vectors span the latent space. The labelled vectors are broadcast: at most
`2 * per_label` of `RANK` floats. Each document's exact cosines with all of them come from
blocked matrix products; the `NEIGHBOURS` closest vote, weighted by similarity, with all others
that are exactly as close as the last of them.

The model is fitted on at most `per_label` rows of each label, taken by hash order of the id
from rows outside the held-out fold. It is a bounded sample and the bound is a parameter; the
driver gets their term vectors, not their texts. Of rows with one id that of the least text hash counts.
Labels, language, source and id are no inputs of a score. A label row without a quality, or
an id whose labels differ, is not used. Null and empty texts get a score like any other;
without any usable label each score is 0.5. Repeated rows are scored each, texts of any length
whole; an empty table gives an empty one. A column named like the score is replaced, others stay.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.llm.common import add_columns, fold_bucket, text_bytes

PER_LABEL, RANK, NEIGHBOURS, BLOCK = 2000, 48, 25, 1024
FOLDS, THRESHOLD = 5, 0.3
KINDS = 13
#: Weight of repetition terms against unit-length trigram terms, and their steps.
REPEAT_WEIGHT, STEPS = 0.12, np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def _kinds() -> np.ndarray:
    kind = np.full(256, 9, np.int16)
    kind[128:] = 10
    kind[:32] = 11
    for k, chars in ((0, "abcdefghijklmnopqrstuvwxyz"), (1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, " "), (4, "\n\r"), (5, ".,"), (6, "!?"), (7, "#*$%&"), (8, "|"), (12, "@:/<>")):
        kind[[ord(c) for c in chars]] = k
    return kind


KIND = _kinds()
TRIGRAMS = KINDS**3
MEASURES = 6
TERMS = TRIGRAMS + MEASURES * len(STEPS)


def measures(text: bytes) -> list[float]:
    """Shares between 0 and 1 that tell repetition and boilerplate from prose."""
    words = text.split()
    if not words:
        return [0.0] * MEASURES
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    return [
        1 - len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, 5 / n),
        min(1.0, 100 / max(1, len(text))),
    ]


def terms(texts: list[bytes]) -> np.ndarray:
    """Unscaled term weights (float32) of each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        kind = KIND[np.frombuffer(b" " + text + b" ", np.uint8)]
        if len(kind) > 2:
            tri = kind[:-2] * (KINDS * KINDS) + kind[1:-1] * KINDS + kind[2:]
            out[i, :TRIGRAMS] = np.bincount(tri, minlength=TRIGRAMS)
        out[i, TRIGRAMS:] = (np.array(measures(text))[:, None] > STEPS).ravel()
    return out


def scaled(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(raw[:, :TRIGRAMS]) * idf[:TRIGRAMS]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.hstack([x, raw[:, TRIGRAMS:] * REPEAT_WEIGHT])


class Model:
    """idf weights, latent axes and the labelled vectors."""

    def __init__(self, raw: np.ndarray, labels: list[int]):
        """A model from the `terms` of labelled texts."""
        self.idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))).astype(np.float32) + 0.1
        x = scaled(raw, self.idf)
        used = np.flatnonzero(raw.any(0))  # the Gram matrix of terms that occur
        _, axes = np.linalg.eigh(x[:, used].T @ x[:, used])
        self.axes = np.zeros((TERMS, min(RANK, len(used))), np.float32)
        self.axes[used] = axes[:, ::-1][:, :RANK]
        self.points = self.latent(x)
        self.labels = np.array(labels, np.float32)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def vote(cosines: np.ndarray, labels: np.ndarray) -> np.ndarray:
        weight = np.exp(20 * (cosines - cosines.max(1, keepdims=True))) + 1e-9
        return (weight * labels).sum(1) / weight.sum(1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.points))
        for i in range(0, len(texts), BLOCK):
            z = self.latent(scaled(terms(texts[i : i + BLOCK]), self.idf))
            cos = z @ self.points.T
            top = np.argpartition(cos, -k, axis=1)[:, -k:]
            near = np.take_along_axis(cos, top, 1)
            out[i : i + BLOCK] = self.vote(near, self.labels[top])
            last = near.min(1, keepdims=True)
            for j in np.flatnonzero((cos == last).sum(1) > (near == last).sum(1)):  # ties beyond the last
                voters = cos[j] >= last[j]
                out[i + j] = self.vote(cos[j][voters][None], self.labels[voters][None])[0]
        return np.clip(out, 0.0, 1.0)


def labelled(labels: DataFrame, value: str = "quality") -> DataFrame:
    """doc_id and label (0 or 1) of ids whose labels agree."""
    per = labels.filter(F.col(value).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(value).alias("label"), F.max(value).alias("other"))
    return per.filter("label = other and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """A model from labelled rows outside the held-out fold; None where there are none."""
    known = labelled(labels).filter(fold_bucket(F.col("doc_id"), FOLDS) != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.filter(F.col("label") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_label rows at most
    texts = docs.select("doc_id", text_bytes().alias("text")).join(sample, "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def start():
        return lambda text: [pa.array([zlib.compress(t.tobytes(), 1) for t in terms(text.to_pylist())], pa.binary())]  # mostly zeros

    vectors = add_columns(one, [F.col("text")], T.StructType([T.StructField("terms", T.BinaryType())]), start).select("doc_id", "label", "terms")
    rows = vectors.orderBy(*order).limit(2 * per_label).toArrow()  # TERMS floats each, compressed
    if not rows.num_rows:
        return None
    return Model(np.array([np.frombuffer(zlib.decompress(t), np.float32) for t in rows.column("terms").to_pylist()]), rows.column("label").to_pylist())


def with_score(docs: DataFrame, model: Model | None, out_col: str = "score") -> DataFrame:
    """`docs` with the score of each whole text."""
    if model is None:
        return docs.withColumn(out_col, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by PER_LABEL, RANK and TERMS

    def start():
        return lambda text: [pa.array(shared.value.score(text.to_pylist()))]

    return add_columns(docs, [text_bytes()], T.StructType([T.StructField(out_col, T.DoubleType())]), start)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
