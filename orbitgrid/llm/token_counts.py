"""Token counts from an exact length histogram (operator 6).

Documents are aggregated by encoded length once. Suffix sums over the histogram then give
totals, quantiles and truncated totals for every context limit, without another pass.

Null and empty texts have length 0. An empty table gives an empty histogram. Repeated rows count
each, texts of any length whole. A column named like the length is replaced, others stay. The library
fails on runs of white space of about a million characters, so a run over `LONG_RUN` is handed over in parts: ids
are the library's, but for merges across a part's edge.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitgrid.llm.common import add_columns, materialize, tokenizer_path

#: Lengths in a block of the two-level suffix sum.
BLOCK = 256
#: White space of a run that is encoded at once, and runs that are longer, with what the library's pattern counts as white space.
LONG_RUN = 100_000
LONG_SPACE = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN + 1},}}")


@cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> Iterator[str]:
    """The text in parts with no run of white space over LONG_RUN; each part but the last ends within such a run."""
    at = 0
    if len(text) > LONG_RUN:
        for run in LONG_SPACE.finditer(text):
            cut = run.start()
            while run.end() - cut > LONG_RUN:
                cut += LONG_RUN
                yield text[at:cut]
                at = cut
    yield text[at:]


def with_lengths(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """`docs` with the number of tokens of each whole text."""
    path = path or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def start():
        encode = encoding(path).encode_ordinary
        return lambda text: [pa.array([sum(len(encode(p)) for p in parts(t)) for t in text.to_pylist()], pa.int64())]

    return add_columns(docs, [F.coalesce(F.col(text_col), F.lit(""))], T.StructType([T.StructField(out_col, T.LongType())]), start)


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row for each length: its documents, and what suffix sums say at that context limit.

    Columns: n_tokens, n_docs, docs_over and tokens_over (documents longer than the limit and
    their tokens), total_docs, total_tokens, truncated_tokens (kept if every document is cut at
    the limit), share_at_or_below (the limit's quantile).
    """
    hist = lengths.groupBy(F.col(col).alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    hist = materialize(hist, "lengths")  # one row for each length; the two branches below read it
    hist = hist.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each block of lengths: the longest text / BLOCK rows at most
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    outer = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(outer), zero).alias("later_docs"),
        F.coalesce(F.sum("b_tokens").over(outer), zero).alias("later_tokens"),
        F.sum("b_docs").over(whole).alias("total_docs"),
        F.sum("b_tokens").over(whole).alias("total_tokens"),
    )
    out = (
        hist.withColumns({"i_docs": F.coalesce(F.sum("n_docs").over(inner), zero), "i_tokens": F.coalesce(F.sum("tokens").over(inner), zero)})
        .join(blocks, "block")
        .withColumns({"docs_over": F.col("i_docs") + F.col("later_docs"), "tokens_over": F.col("i_tokens") + F.col("later_tokens")})
    )
    return out.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("share_at_or_below"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """Totals for any context limit, also one that no document's length equals: one row (null totals if empty).

    They are the suffix sums of the longest length within the limit.
    """
    within = F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))
    row = hist.agg(
        F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"),
        F.coalesce(F.max_by("docs_over", within), F.max("total_docs")).alias("docs_over"), F.coalesce(F.max_by("tokens_over", within), F.max("total_tokens")).alias("tokens_over"),
    )
    return row.select("total_docs", "total_tokens", "docs_over", (F.col("total_tokens") - F.col("tokens_over") + limit * F.col("docs_over")).alias("truncated_tokens"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The smallest length whose share of documents at or below it is at least `q`: one row (null if empty)."""
    return hist.agg(F.min(F.when(F.col("share_at_or_below") >= q, F.col("n_tokens"))).alias("n_tokens"))
