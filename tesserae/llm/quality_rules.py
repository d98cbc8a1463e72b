"""Quality rules whose cutoffs are certified, all rules of a stratum together, on labelled documents.

``statistics`` counts words, symbols, repeated lines and repeated words of whole texts.  ``certified_cutoffs`` splits
the labelled texts by a hash of the text.  On the first part, for each rule and stratum, it designs a path of ever
stricter cutoffs: at each step a rule may lose no more than that step's share of the good documents there, and takes
of the cutoffs within it the one that catches the most bad documents, each good one costing ``PRICE`` of them.  The
other part, the holdout, judges the path: a step rejects a document if any of its rules does, and from the first step
on, each is certified if the exact binomial test shows that fewer than ``risk`` of the stratum's good documents are
rejected; the walk ends at the first that isn't, and the last certified step holds.  The path owes nothing to the
holdout, so the steps are hypotheses in fixed order, which needs no correction among them; over strata the error
``delta`` is divided (Bonferroni).  So with probability 1 - ``delta`` no stratum loses ``risk`` of its good documents
to the cutoffs, as far as labelled texts are drawn like the others.  The base rule stands outside of this.

Copies of a text count once, as do repeated labels; ids with contradictory labels, and texts whose copies have
contradictory labels, don't count.  Null labels, null ids and labels of no document don't count either; without enough
labels no cutoff is certified and only the base rule rejects.  Null texts count as empty (no words, hence rejected).
Rows that repeat are judged alike, null ids stay null, texts are read whole, further columns aren't read, an empty
table gives no rows.  Only histograms over fixed bins reach the driver, whatever the size of the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import clash_free, single_labels, small, utf8, written
from tesserae.llm.textstats import base_statistics
from tesserae.llm.wordgrid import chunks

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each rule rejects values over its cutoff: numerator, denominator, bins, width of a bin.
RULES = {
    "symbols": ("n_symbols", "word_chars", 200, 0.005),
    "repeats": ("n_repeat_words", "n_words", 100, 0.01),
    "dup_lines": ("n_dup_lines", "n_words", 100, 0.002),
    "word_length": ("word_chars", "n_words", 200, 0.25),
    "short_words": ("n_words", "word_chars", 100, 0.01),
}
#: Strata are bands of word counts; a band begins at each of these.
BANDS = (0, 50, 200, 1000)
RISK, DELTA = 0.005, 0.05
#: Bad documents that must be caught for each good one that is lost.
PRICE = 20
#: Of the labelled texts one in so many designs the path; the others are the holdout.
DESIGN = 3
#: Shares of the good documents that each rule may lose in the design, step by step.
STEPS = (0.0, 0.0005, 0.001, 0.002, 0.004)


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, the statistics, and ``content``, a digest of the text by which copies are told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = utf8(batch.column(1))
            for a, b in chunks(texts):
                s = base_statistics(texts[a:b])
                content = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(s[c].astype("int64")) for c in BASE), content], ["id", *BASE, "content"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = clash_free(docs, [id_column, text_column]).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in BASE) + ", content binary")
    return out.withColumnRenamed("id", id_column)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum() -> F.Column:
    out = F.lit(0)
    for k, least in enumerate(BANDS[1:], 1):
        out = F.when(F.col("n_words") >= least, k).otherwise(out)
    return out


def bin_of(rule: str) -> F.Column:
    """The bin of a rule's value: integers throughout, so that no rounding moves a document."""
    over, under, bins, width = RULES[rule]
    scale = round(1 / width)
    return F.least(F.lit(bins - 1).cast("bigint"), F.coalesce(F.expr(f"({over} * {scale}) div nullif({under}, 0)"), F.lit(0)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value, m = d, 0
    while True:
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15 or m > 10_000_000:
            return value


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count, as a regularised incomplete beta function: some sqrt(k) steps, whatever n is."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-p) + b * math.log(p))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, p) / b


def designed_path(good: list[int], bad: list[int], steps: tuple[float, ...] = STEPS) -> list[int]:
    """For each step the bin over which a rule rejects; the last bin rejects nothing.  Cutoffs never rise."""
    n, out, best = sum(good), [], 0
    b = cut = len(good) - 1
    over_good = over_bad = 0
    for share in steps:
        while n and b > 0 and over_good + good[b] <= share * n:
            over_good, over_bad, b = over_good + good[b], over_bad + bad[b], b - 1
            if over_bad - PRICE * over_good > best:
                cut, best = b, over_bad - PRICE * over_good
        out.append(cut)
    return out


def certified_step(false: list[int], n: int, risk: float, level: float) -> int | None:
    """The last step before the first that isn't certified; ``false`` has the good documents that each step rejects."""
    last = None
    for k, rejected in enumerate(false):
        if not n or rejected > risk * n or at_most(rejected, n, risk) > level:
            break
        last = k
    return last


def labelled_texts(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> DataFrame:
    """One row per labelled text that passes the base rule: the statistics, label, and whether it is of the design."""
    joined = stats.filter(~base_failed()).join(single_labels(labels, id_column, label_column), F.col(id_column) == F.col("label_id"))
    texts = joined.groupBy("content").agg(F.min("label").alias("label"), F.max("label").alias("other"), *[F.first(c).alias(c) for c in BASE]).filter("label = other")
    return texts.select(*BASE, F.col("label").cast("int").alias("label"), (F.pmod(F.xxhash64("content"), F.lit(DESIGN)) == 0).alias("design"))


def certified_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_column: str = "doc_id", label_column: str = "quality") -> dict[tuple[str, int], int]:
    """The certified bins per rule and stratum; ``labels`` has ``id_column`` and a label of 1 (good) or 0."""
    judged = written(labelled_texts(stats, labels, id_column, label_column), "quality-judged")
    cells = F.array(*[F.struct(F.lit(rule).alias("rule"), bin_of(rule).alias("bin")) for rule in RULES])
    histogram = judged.filter("design").select(stratum().alias("stratum"), "label", F.explode(cells).alias("c")).groupBy("stratum", "label", "c.rule", "c.bin").count()
    counts: dict[tuple[str, int, int], list[int]] = {}
    for row in histogram.collect():  # at most rules x strata x bins x labels rows
        counts.setdefault((row["rule"], row["stratum"], row["label"]), [0] * RULES[row["rule"]][2])[row["bin"]] += row["count"]
    paths = {}
    for rule, (_, _, bins, _) in RULES.items():
        for band in range(len(BANDS)):
            path = designed_path(counts.get((rule, band, 1), [0] * bins), counts.get((rule, band, 0), [0] * bins))
            if path[-1] < bins - 1:
                paths[rule, band] = path
    if not paths:
        return {}

    survived = F.lit(len(STEPS))  # how many steps a document survives: cutoffs never rise, so these are the first ones
    for band in range(len(BANDS)):
        of_rules = [sum((F.when(bin_of(rule) <= cut, 1).otherwise(0) for cut in path), F.lit(0)) for (rule, at), path in paths.items() if at == band]
        if of_rules:
            survived = F.when(stratum() == band, F.least(F.lit(len(STEPS)), *of_rules)).otherwise(survived)
    holdout = judged.filter("label = 1 and not design").groupBy(stratum().alias("stratum"), survived.alias("survived")).count()
    lost = [[0] * (len(STEPS) + 1) for _ in BANDS]
    for row in holdout.collect():  # at most strata x steps rows
        lost[row["stratum"]][row["survived"]] += row["count"]
    out = {}
    for band, by_step in enumerate(lost):
        false = [sum(by_step[: k + 1]) for k in range(len(STEPS))]
        step = certified_step(false, sum(by_step), risk, delta / len(BANDS))
        if step is not None:
            out |= {(rule, at): path[step] for (rule, at), path in paths.items() if at == band and path[step] < RULES[rule][2] - 1}
    return out


def verdicts(stats: DataFrame, cutoffs: dict[tuple[str, int], int]) -> DataFrame:
    """Adds base_failed and kept."""
    rejected = F.lit(False)
    for (rule, band), cut in sorted(cutoffs.items()):
        rejected = rejected | ((stratum() == band) & (bin_of(rule) > cut))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
