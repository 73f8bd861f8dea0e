"""Quality rules as a learned decision list (operator 8), in DataFrame functions only.

Statistics of each whole text come from one scan, without a shuffle. Sequential covering
learns ordered rules that reject: a rule grows, condition by condition, by information gain on
the growing rows, loses trailing conditions that do not help on the pruning rows, and is kept
while its precision there is high. Rows that a rule covers leave before the next one grows.
Counts come from Spark aggregates over binned statistics of all labelled documents. The
list is emitted as ordered conditional expressions.

Null texts have no words: all counts are 0 and the base rule fails them. An id with differing
labels or none teaches nothing. Without labelled rows the base rule alone decides. Repeated rows
are judged, and teach, each; texts of any length are read whole; an empty table gives an empty one.
Kept columns that are named like a statistic, in any case, give way to it.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitgrid.llm.common import fold_bucket, materialize

WINDOW = 8
MAX_RULES, MAX_CONDITIONS, CUTS = 8, 3, 24
#: A rule must be this sure on the pruning rows (its share of label 0), and reject so many rows.
MIN_PRECISION, MIN_COVER = 0.95, 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Runs without ASCII white space."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of eight words, by doubling: 1, 2, 4, then 8 words."""
    def doubled(width: int) -> Callable[[Column], Column]:
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + width)))

    out = F.transform(words, lambda w: F.xxhash64(w))
    for width in (1, 2, 4):
        out = let(out, doubled(width))
    return let(out, lambda h: F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(h) - (WINDOW - 1))))


def covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(at: Column) -> Column:
        other = lambda i, step: F.get(at, i + step)["h"]
        twin = lambda x, i: F.coalesce(x["h"] == other(i, 1), F.lit(False)) | F.coalesce((i > 0) & (x["h"] == other(F.greatest(i - 1, F.lit(0)), 0)), F.lit(False))
        return F.sort_array(F.transform(F.filter(at, twin), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.coalesce(F.least(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g)

    return let(let(ordered, repeated), covered)


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the statistics of each whole text; kept columns named like one are replaced."""
    keep = [c for c in keep if c.lower() not in STATISTICS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long = lambda c: c.cast("long")

    def repeats(words: Column) -> Column:
        hashes = F.when(F.size(words) > WINDOW, window_hashes(words)).otherwise(F.array().cast("array<bigint>"))
        twice = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered_words(h)).otherwise(F.lit(0).cast("long"))
        return F.struct(long(F.size(words)).alias("n"), let(hashes, twice).alias("repeated"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # one struct of all counts, each array inside bound once
    counts = F.struct(
        let(words_of(text), repeats).alias("w"),
        long(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("n_upper"),
        long(F.regexp_count(text, F.lit("[!?]"))).alias("n_marks"),
        let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
    )
    rows = docs.select(*keep, F.explode(F.array(counts)).alias("__s"))  # a generator: its value is not recomputed above
    s = lambda name: F.col(f"__s.{name}")
    return rows.select(
        *keep, s("w.n").alias("n_words"), s("word_chars"), s("n_symbols"), s("l.dup").alias("n_dup_lines"), s("w.repeated").alias("n_repeat_words"), s("n_upper"), s("n_marks"), s("l.n").alias("n_lines")
    )


#: Interpretable measures that rules may test.
MEASURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def fires(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def kept(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: true unless a rule rejects."""
    out = F.when(base_failed(F.col("n_words"), F.col("n_repeat_words")), False)
    for rule in rules:
        out = out.when(fires(rule), False)
    return out.otherwise(True)


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each measure in either class, exact on values of three digits, rounded up.

    They come from counts by value, so they do not depend on the order in which tasks end.
    """
    pairs = ", ".join(f"'{m}', {e}" for m, e in MEASURES.items())
    value = F.col("value")
    step = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 2)
    values = rows.select("label", F.expr(f"stack({len(MEASURES)}, {pairs}) as (measure, value)"))
    counts = values.select("label", "measure", F.when(value > 0, F.ceil(value / step) * step).otherwise(0.0).alias("value")).groupBy("label", "measure", "value").agg(F.count("*").alias("n"))
    held: dict[tuple, list[tuple[float, int]]] = {}
    for row in counts.collect():  # 900 values for each power of ten, measure and label at most
        held.setdefault((row.measure, row.label), []).append((row.value, row.n))
    out: dict[str, set[float]] = {m: set() for m in MEASURES}
    for (m, _), table in held.items():
        ends = list(accumulate(n for _, n in sorted(table)))
        out[m].update(sorted(table)[bisect_left(ends, (i + 0.5) / CUTS * ends[-1])][0] for i in range(CUTS))
    return {m: sorted(v) for m, v in out.items()}


def _bin(measure: str, cuts: list[float]) -> Column:
    """How many of the cuts lie below the measure: bin b means cuts[b-1] < value <= cuts[b]."""
    value = F.expr(MEASURES[measure])
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)


def _binned(cells: DataFrame, rule: Rule, cuts: dict[str, list[float]]) -> DataFrame:
    for c in rule:
        at = cuts[c.measure].index(c.cut)
        cells = cells.filter(F.col(c.measure) > at if c.above else F.col(c.measure) <= at)
    return cells


def _counts(cells: DataFrame) -> tuple[int, int]:
    row = cells.agg(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.sum(F.when(F.col("label") == 1, F.col("n")))).first()
    return row[0] or 0, row[1] or 0


def _best(cells: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, int, int] | None:
    """The condition with the most information gain, from one histogram of all measures."""
    pairs = ", ".join(f"'{m}', {m}" for m in MEASURES)
    hist = cells.select("label", "n", F.expr(f"stack({len(MEASURES)}, {pairs}) as (measure, bin)")).groupBy("measure", "bin", "label").agg(F.sum("n").alias("n"))
    table: dict[str, dict[int, list[int]]] = {m: {} for m in MEASURES}
    for row in hist.collect():  # measures x bins x labels
        table[row.measure].setdefault(row.bin, [0, 0])[row.label] += row.n
    bad = sum(v[0] for v in table["n_words"].values())
    good = sum(v[1] for v in table["n_words"].values())
    if not bad or not good:
        return None
    best = None
    for m, bins in table.items():
        p = n = 0
        for i, cut in enumerate(cuts[m]):
            p += bins.get(i, [0, 0])[0]
            n += bins.get(i, [0, 0])[1]
            for above, q, r in ((False, p, n), (True, bad - p, good - n)):
                if q and (q, r) != (bad, good):
                    gain = q * (math.log2(q / (q + r)) - math.log2(bad / (bad + good)))
                    if best is None or gain > best[0]:
                        best = gain, Condition(m, above, cut), q, r
    return best[1:] if best and best[0] > 0 else None


def learn(rows: DataFrame) -> list[Rule]:
    """Ordered rejecting rules from statistics with `label` (0 reject, 1 keep) and `doc_id`."""
    cuts = _cuts(rows)
    keys = ["grow", "label", *MEASURES]
    binned = rows.select((fold_bucket(F.col("doc_id"), 3) != 0).alias("grow"), "label", *(_bin(m, c).alias(m) for m, c in cuts.items()))
    cells = materialize(binned.groupBy(*keys).agg(F.count("*").alias("n")), "cells")
    rules: list[Rule] = []
    left = cells
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        part = left.filter("grow")
        while len(rule) < MAX_CONDITIONS and (found := _best(part, cuts)):
            rule += (found[0],)
            part = _binned(part, (found[0],), cuts)
            if not found[2]:
                break
        if not rule:
            break
        # prune: the prefix of conditions with the best (p - n) / (p + n) on the pruning rows
        held = left.filter("not grow")
        scores = []
        for size in range(1, len(rule) + 1):
            p, n = _counts(_binned(held, rule[:size], cuts))
            scores.append(((p - n) / (p + n) if p + n else -1.0, -size, p, n))
        worth, size, p, n = max(scores)
        rule = rule[:-size]
        if p + n == 0 or p / (p + n) < MIN_PRECISION or p < MIN_COVER:
            break
        rules.append(rule)
        covered = F.lit(True)
        for c in rule:
            at = cuts[c.measure].index(c.cut)
            covered = covered & (F.col(c.measure) > at if c.above else F.col(c.measure) <= at)
        left = left.filter(~covered)
    return rules


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of documents whose quality labels agree, base failures aside."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    known = known.filter("label = most").select("doc_id", F.col("label").cast("int").alias("label"))
    return stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(known, "doc_id")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document."""
    stats = materialize(with_statistics(docs), "statistics")
    rules = learn(labelled(stats, labels))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), kept(rules).alias("kept"),
    )
