"""A training corpus from raw documents: five stages, each over all that the one before kept.

1. quality classifier: documents scored below the threshold go;
2. quality rules: documents that the base rule or a learned rule rejects go;
3. near-duplicates: one document of each group stays, the one of the smallest id;
4. benchmark decontamination: contaminated documents go;
5. encoding: token ids of what remains.

A null id is no smallest id: within a group of null ids one row stays. Empty tables pass through as
empty; without labels nothing is rejected by score or learned rule, without a benchmark nothing is
contaminated. All stages but the last keep every column of their input, whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitgrid.llm import bpe, decision_list, decontam, quality_knn, simhash
from orbitgrid.llm.common import materialize, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_knn.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_knn.with_score(docs, model, "__score")
    return scored.filter(F.col("__score") >= quality_knn.THRESHOLD).select(*docs.columns)


def apart(docs: DataFrame, names: tuple[str, ...] | list[str]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns that are called like one of `names` renamed, and how to name them back."""
    taken = {n.lower() for n in names}
    back = {f"__own_{c}": c for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    docs, back = apart(docs, decision_list.STATISTICS)
    # texts and their statistics are written once: rules are learned from them and then applied to them
    stats = materialize(decision_list.with_statistics(docs, keep=docs.columns), "statistics")
    measured = stats.select("doc_id", *decision_list.STATISTICS)
    rules = decision_list.learn(decision_list.labelled(measured, read_table(spark, sf_dir, "labels")))
    return stats.filter(decision_list.kept(rules)).select(*docs.columns).withColumnsRenamed(back).select(*columns)


def by_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs).select(*docs.columns)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    docs, back = apart(docs, decontam.FIELDS.names)
    judged = decontam.matches(docs, read_table(spark, sf_dir, "benchmark"))
    clean = judged.filter(~decontam.contaminated(decontam.hit_words(), F.col("n_words")))
    return clean.select(*docs.columns).withColumnsRenamed(back).select(*columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", by_quality),
    ("quality_rules", by_rules),
    ("near_duplicates", by_group),
    ("decontamination", by_benchmark),
    ("encoding", encoded),
]
#: SQL can't express the classifier, the fingerprints or the encoding; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
