"""Language identification by multilingual mixture inference.

``learn`` counts character trigrams of letters per language.  ``identify`` treats every word of a whole text as drawn
from one of a set of languages: expectation-maximisation gives the languages' shares, and the set is the one with the
best penalised likelihood (half the logarithm of the number of words for each further language).  Sets are looked for
along one ranking, that of the shares of all languages together: the first language, the first two, and so on, as long
as a larger set gains more than it costs.  Expectation-maximisation runs ``ROUNDS`` rounds, which ends before the last
digits of shares have settled.  The language of a
document is the one with the largest share in the chosen set, and its score that share.  ``accepted`` also asks how
well the mixture fits the text at all, as shares among the learned languages can't tell that a text is in none of them.

Languages with less than ``LEAST_LANGUAGE`` of the labelled rows aren't learned, so there are no more than
1 / ``LEAST_LANGUAGE`` of them, however many values the label column has.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing could be learned; rows
without a label aren't learned from.  Ties go to the language that sorts first.  Texts are read whole, whatever their
length.  Rows that repeat, null ids and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.bpe import LETTER, character_classes
from tesserae.llm.shared import clash_free, small
from tesserae.llm.wordgrid import chunks, mix64

#: Trigrams are hashed to 2 ** BITS cells.
BITS = 16
#: The bound of the sample that is learned from: about so many labelled documents of each language.
SAMPLE_PER_LANGUAGE = 1500
#: Labels of a smaller share of the labelled rows than this aren't taken for languages.
LEAST_LANGUAGE = 0.001
SMOOTHING = 0.5
ROUNDS = 8
#: A word says no more than this for one language over the best of the others, so that one odd word can't decide.
WORD_LIMIT = 12.0
#: A document of which no learned language has so large a share is rejected by ``accepted``.
LEAST_SHARE = 0.35
#: So does one whose trigrams are this much less likely (natural logarithm a trigram) under its mixture than the learned
#: texts are under their languages, and beyond DEVIATIONS standard errors, neighbouring trigrams counting as one.
LEAST_FIT, DEVIATIONS, NEIGHBOURS = 2.5, 4.0, 3
#: A language learned from fewer trigrams doesn't tell what is usual; nothing is measured against it.
ENOUGH_TRIGRAMS = 20_000

_fold: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Every letter's lower case, 0 for what is no letter; made once in a process."""
    global _fold
    if _fold is None:
        table = np.arange(0x110000, dtype=np.uint32)
        table[character_classes() != LETTER] = 0
        for c in range(0x20000):  # the cased scripts
            if table[c] and len(low := chr(c).lower()) == 1:
                table[c] = ord(low)
        _fold = table
    return _fold


class Trigrams(NamedTuple):
    cells: np.ndarray  # of each letter
    word: np.ndarray  # first letter of each word, and the end
    text: np.ndarray  # first word of each text, and the end


def trigrams(texts: list[str]) -> Trigrams:
    """One trigram around every letter, words being runs of letters."""
    whole = "\n".join(["", *texts, ""])
    points = _letters()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    at = np.flatnonzero(points)
    key = (points[at - 1] << np.uint64(42)) | (points[at] << np.uint64(21)) | points[at + 1]
    cells = (mix64(key) >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.flatnonzero(points[at - 1] == 0)
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Trigrams(cells, np.append(first, len(at)), np.searchsorted(at[first], begin))


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # cell x language
    usual: np.ndarray = np.zeros(0)  # mean of log_p over the learned trigrams of each language, -inf if they are few
    spread: np.ndarray = np.zeros(0)  # and its variance


def learn(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> Model:
    """Learns from whole texts of a sample bounded by ``sample`` per language, drawn by a hash of the id."""
    rows = clash_free(labelled, [id_column, text_column, language_column]).toDF("id", "text", "lang").filter("lang is not null")
    counted = rows.groupBy("lang").count()  # reads that column only
    total = counted.agg(F.sum("count")).first()[0] or 0
    totals = {r["lang"]: r["count"] for r in counted.filter(F.col("count") >= LEAST_LANGUAGE * total).collect()}  # 1 / LEAST_LANGUAGE rows at most
    if not totals:
        return Model([], np.zeros((1 << BITS, 0)))
    languages = sorted(totals)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, sample / totals[lang])).otherwise(share)
    rows = rows.filter(F.col("lang").isin(languages))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < share * (1 << 20)
    cells = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), cells), np.int64)
        for batch in small(batches, 0):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, lang in enumerate(languages):
                some = [t or "" for t, x in zip(texts, langs, strict=True) if x == lang]
                for a, b in chunks(some):
                    total[k] += np.bincount(trigrams(some[a:b]).cells, minlength=cells)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], ["cell", "n"])

    found = rows.filter(drawn).select("text", "lang").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(languages) * cells)
    table = found.toArrow()  # languages x 2 ** BITS rows at most
    counts[np.asarray(table["cell"])] = np.asarray(table["n"])
    counts = counts.reshape(len(languages), cells).T + SMOOTHING
    log_p, seen = np.log(counts / counts.sum(axis=0)), counts - SMOOTHING
    n = np.maximum(seen.sum(axis=0), 1)
    usual = (seen * log_p).sum(axis=0) / n
    spread = (seen * (log_p - usual) ** 2).sum(axis=0) / n
    return Model(languages, log_p, np.where(n >= ENOUGH_TRIGRAMS, usual, -np.inf), spread)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``; empty ranges give 0."""
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)))
    return total[first[1:]] - total[first[:-1]]


def _mixture(odds: np.ndarray, allowed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages per text, and the log likelihood, by expectation-maximisation."""
    n = np.maximum(np.diff(first), 1)[:, None]
    doc = np.repeat(np.arange(len(allowed)), np.diff(first))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        weight = odds * share[doc]
        weight /= weight.sum(axis=1, keepdims=True)
        share = np.where(allowed, np.maximum(_sums(weight, first) / n, 1e-9), 0)
        share /= share.sum(axis=1, keepdims=True)
    likelihood = _sums(np.log((odds * share[doc]).sum(axis=1, keepdims=True)), first)[:, 0]
    return share, likelihood


def infer(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the shares of all languages (0 outside the chosen set), and whether it has a letter."""
    grams = trigrams(texts)
    return _infer(model, grams, _per_word(model, grams))


def _per_word(model: Model, grams: Trigrams) -> np.ndarray:
    """Log likelihoods, word x language."""
    return np.add.reduceat(model.log_p[grams.cells], grams.word[:-1], axis=0) if len(grams.cells) else np.zeros((0, len(model.languages)))


def _infer(model: Model, grams: Trigrams, per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = len(model.languages)
    has = np.diff(grams.text) > 0
    shares = np.zeros((len(has), width))
    if not width or not has.any():
        return shares, has
    odds = np.exp(np.maximum(per_word - per_word.max(axis=1, keepdims=True), -WORD_LIMIT))
    first = grams.text
    n = np.diff(first)
    full, most = _mixture(odds, np.ones((len(has), width)), first)
    order = np.argsort(-full, axis=1, kind="stable")
    single = np.zeros((len(has), width))
    single[np.arange(len(has)), order[:, 0]] = 1
    best_share, best = single.copy(), _sums(np.log(odds), first)[np.arange(len(has)), order[:, 0]]
    # no set is likelier than all languages together: where even that gains less than one more language costs, the
    # single language stays (with a unit of slack, as the rounds end before they have settled)
    todo = np.flatnonzero(has & (most + 1 > best + 0.5 * np.log(np.maximum(n, 1))))
    for size in range(2, width + 1):
        if not len(todo):
            break
        allowed = np.zeros((len(todo), width))
        np.put_along_axis(allowed, order[todo, :size], 1, axis=1)
        picked = np.concatenate([np.arange(first[t], first[t + 1]) for t in todo])
        bounds = np.concatenate(([0], np.cumsum(n[todo])))
        share, likelihood = _mixture(odds[picked], allowed, bounds)
        gain = likelihood - 0.5 * (size - 1) * np.log(n[todo]) > best[todo] - 0.5 * (np.count_nonzero(best_share[todo], axis=1) - 1) * np.log(n[todo])
        best_share[todo[gain]], best[todo[gain]] = share[gain], likelihood[gain]
        todo = todo[gain]  # a larger set can only help where this one did
    shares[has] = best_share[has]
    return shares, has


def judge(model: Model, texts: list[str], least: float = LEAST_SHARE) -> np.ndarray:
    """Whether each text is in a learned language, or a mixture with a share of ``least`` of one, by the test of fit too."""
    grams = trigrams(texts)
    per_word = _per_word(model, grams)
    shares, has = _infer(model, grams, per_word)
    good = has & (shares.max(axis=1, initial=0.0) >= least)
    if not good.any():
        return good
    top = per_word.max(axis=1, keepdims=True)
    mixed = (np.exp(per_word - top) * np.repeat(shares, np.diff(grams.text), axis=0)).sum(axis=1, keepdims=True)
    n = np.maximum(np.diff(grams.word[grams.text]), 1)
    fit = _sums(np.log(np.maximum(mixed, 1e-300)) + top, grams.text)[:, 0] / n
    usual = np.where(shares > 0, shares * np.where(shares > 0, model.usual, 0), 0).sum(axis=1)
    return good & (fit >= usual - LEAST_FIT - DEVIATIONS * np.sqrt(NEIGHBOURS * (shares @ model.spread) / n))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``lang_pred``, ``score`` and ``shares map<string,double>`` (the chosen set) per row."""
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                shares, has = infer(model, texts[a:b])
                top = shares.argmax(axis=1) if names else np.zeros(b - a, int)
                known = has & bool(names)
                lang = [names[t] if k else "und" for t, k in zip(top, known, strict=True)]
                score = np.where(known, shares[np.arange(b - a), top], 0.0) if names else np.zeros(b - a)
                sets = [[(names[j], float(s[j])) for j in np.flatnonzero(s)] for s in shares]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(sets, pa.map_(pa.string(), pa.float64()))], ["id", "lang_pred", "score", "shares"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = clash_free(docs, [id_column, text_column]).mapInArrow(run, f"id {kind}, lang_pred string, score double, shares map<string,double>")
    return out.withColumnRenamed("id", id_column)


def accepted(docs: DataFrame, model: Model, least: float = LEAST_SHARE, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are in learned languages: see ``judge``."""

    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, place):
            texts = [x or "" for x in batch.column(place).to_pylist()]
            for a, b in chunks(texts):
                yield batch.slice(a, b - a).filter(pa.array(judge(model, texts[a:b], least)))

    return docs.mapInArrow(run, docs.schema)
