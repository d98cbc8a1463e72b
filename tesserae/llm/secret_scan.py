"""Secret scans through a trigram inverted index, with DataFrame functions only.

``trigram_query`` derives from a rule's regex a Boolean query: what trigrams of lower-cased text any match must
bring along.  ``postings`` lists, for the trigrams that the rules ask for, the texts that have them.  ``candidates``
intersects and unites postings per rule.  ``scan`` verifies candidates with the regexes; rules without a mandatory
trigram scan all texts in full.  Spans are in code points, end exclusive, leftmost and non-overlapping per kind.

Null texts count as empty and have no spans; equal rows get equal results; spans that start together go in the order of
the rules; texts are read whole; an empty table gives no rows; null ids and extra columns are kept apart from the
operator's own columns by name.  Postings are keyed by id and content, so rows that share an id but not a
text aren't mixed up.
"""

from __future__ import annotations

import functools
import itertools
import re._constants as rc  # type: ignore[import-not-found]
import re._parser as rp  # type: ignore[import-not-found]
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import clash_free, whole_text, written


class Rule(NamedTuple):
    kind: str
    regex: str
    #: Matches whose group of this number (0: the whole match) is shorter than ``least`` are dropped.
    group: int = 0
    least: int = 0


#: The base kinds, in the order in which ties of start are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # a maximal run either way, so the length can stand in the regex
)
#: Kinds that are found besides.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"https?://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE_RULES + MORE_RULES

#: A Boolean query: a trigram, ("and", parts) or ("or", parts); None asks for nothing.
Query = str | tuple | None
#: Sets of alternative strings are followed up to this size.
_SETS = 64


def _every(kind: str, parts: list[Query]) -> Query:
    """Joins queries; None is true, so it is dropped from a conjunction and makes a disjunction true."""
    if kind == "or" and None in parts:
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    if kind == "or":  # a part that asks for all that another asks for, and more, adds nothing
        asks = [frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts]
        parts = [p for p, a in zip(parts, asks, strict=True) if not any(b < a for b in asks)]
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    return _every("or", [_every("and", [s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(op: object, value: object) -> set[str] | None:
    """All strings that a node matches, if they are few, in lower case."""
    if op is rc.LITERAL:
        return {chr(value).lower()}
    if op is rc.IN:
        out: set[str] = set()
        for kind, x in value:
            if kind is rc.LITERAL:
                out.add(chr(x).lower())
            elif kind is rc.RANGE and x[1] - x[0] < _SETS:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is rc.SUBPATTERN:
        return _sequence_strings(value[-1])
    if op is rc.BRANCH:
        found = [_sequence_strings(p) for p in value[1]]
        return None if any(x is None for x in found) else set().union(*found)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[1] <= 3:
        one = _sequence_strings(value[2])
        if one is None:
            return None
        out = {"".join(p) for n in range(value[0], value[1] + 1) for p in itertools.product(sorted(one), repeat=n)}
        return out if len(out) <= _SETS else None
    return None


def _sequence_strings(nodes: rp.SubPattern) -> set[str] | None:
    out = {""}
    for op, value in nodes:
        more = _strings(op, value)
        if more is None or len(out) * len(more) > _SETS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes: rp.SubPattern) -> Query:
    parts: list[Query] = []
    run = {""}  # what the nodes since the last open one can spell
    for op, value in nodes:
        more = _strings(op, value)
        if more is not None and len(run) * len(more) <= _SETS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(_of_strings(run))
        run = more or {""}
        if more is None:
            if op is rc.SUBPATTERN:
                parts.append(_query(value[-1]))
            elif op is rc.BRANCH:
                parts.append(_every("or", [_query(p) for p in value[1]]))
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] > 0:
                parts.append(_query(value[2]))
    return _every("and", [*parts, _of_strings(run)])


def trigram_query(regex: str) -> Query:
    """The query over trigrams of lower-cased text that every match of ``regex`` satisfies; None if there is none."""
    return _query(rp.parse(regex))


def trigrams_of(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index for ``grams``: (gram, id, content) for each text that has the trigram.

    ``docs`` has columns id, content and text.  Nothing is shuffled here.
    """
    low = F.lower("text")
    present = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]), lambda x: x.isNotNull())
    return docs.select("id", "content", low.alias("low")).select("id", "content", F.explode(present).alias("gram"))


def _holds(query: Query, number: dict[str, int]) -> Column:
    if isinstance(query, str):
        k = number[query]
        return F.col(f"bits{k // 60}").bitwiseAND(F.lit(1 << k % 60)) != 0
    parts = [_holds(q, number) for q in query[1]]
    return functools.reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def candidates(index: DataFrame, queries: dict[str, Query], grams: list[str]) -> DataFrame:
    """Texts whose postings satisfy a rule's query: id, content and ``rules array<string>``.

    Postings meet by text as bit sets, added up before the shuffle, so a text gathers a few numbers.
    """
    number = {g: k for k, g in enumerate(grams)}
    words = range(-(-len(grams) // 60))
    bits = [F.bit_or(F.when(F.floor(F.col("gram") / 60) == w, F.expr("shiftleft(1L, cast(pmod(gram, 60) as int))")).otherwise(F.lit(0).cast("bigint"))).alias(f"bits{w}") for w in words]
    met = index.groupBy("id", "content").agg(*bits)
    rules = F.filter(F.array(*[F.when(_holds(q, number), F.lit(kind)) for kind, q in queries.items()]), lambda x: x.isNotNull())
    return met.select("id", "content", rules.alias("rules")).filter(F.size("rules") > 0)


def _spans(rule: Rule, order: int) -> Column:
    """An array of (start, order, end) for the rule's matches in ``text``."""
    match = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0))
    sized = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)) if rule.group else match
    between = F.split("text", rule.regex, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("found"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        found = F.when(F.length(x["sized"]) >= rule.least, F.concat(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    # the last gap has no match after it: zipped with null, it adds nothing that counts
    steps = F.arrays_zip(F.slice(between, 1, F.size(match)).alias("gap"), match.alias("match"), sized.alias("sized"))
    return F.aggregate(steps, begin, add, lambda s: s["found"])


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], id_column: str, text_column: str, keep: list[str]) -> DataFrame:
    """id, text, spans, and the ``keep`` columns as keep_0, keep_1 and so on, so that no name of theirs clashes."""
    named = clash_free(docs, [id_column, text_column, *keep]).toDF("id", "text", *[f"keep_{k}" for k in range(len(keep))]).withColumn("text", whole_text())
    named = named.withColumn("content", F.xxhash64("text"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    asked = {kind: q for kind, q in queries.items() if q is not None}
    grams = sorted(set().union(*map(trigrams_of, asked.values()))) if asked else []
    if grams:
        # candidates are few; as a written table their size is known, and Spark broadcasts them only under its own
        # threshold, otherwise it shuffles by id and content
        found = written(candidates(postings(named, grams), asked, grams), "secret-candidates")
        found = found.toDF("found_id", "found_content", "rules")
        looked = named.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("content") == F.col("found_content")), "left")
    else:
        looked = named.withColumn("rules", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for k, rule in enumerate(rules):
        to_verify = F.array_contains("rules", rule.kind) if rule.kind in asked else F.lit(True)
        each.append(F.when(F.coalesce(to_verify, F.lit(False)) & F.col("text").rlike(rule.regex), _spans(rule, k)).otherwise(empty))
    spans = F.array_sort(F.flatten(F.array(*each)))
    return looked.select("id", "text", spans.alias("spans"), *[f"keep_{k}" for k in range(len(keep))])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``text``, ``spans array<struct<start,kind,end>>`` (kind is a rule's number) per row."""
    return _scanned(docs, rules, id_column, text_column, []).withColumnRenamed("id", id_column)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as ``kind:start:end`` joined with commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(rules: tuple[Rule, ...] = RULES) -> Column:
    """``text`` with every span replaced by its kind in brackets; a span inside an earlier one goes with it."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        fresh = F.concat(state["out"], gap, F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    whole = F.aggregate("spans", begin, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """``docs`` with the same columns, secrets in the text replaced by their kinds, and the length column renewed."""
    keep = [c for c in docs.columns if c not in (id_column, text_column)]
    found = _scanned(docs, rules, id_column, text_column, keep).withColumn("text", redacted(rules))
    named = {id_column: F.col("id"), text_column: F.col("text")} | {c: F.col(f"keep_{k}") for k, c in enumerate(keep)}
    if length_column is not None:
        named[length_column] = F.length("text").cast(docs.schema[length_column].dataType)
    return found.select(*[named[c].alias(c) for c in docs.columns])
