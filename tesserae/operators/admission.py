"""Admission of content and prompts, tabular claims, and records described as compositions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.ident import composite_id, content_id, record_id
from tesserae.operators.closure import compositions
from tesserae.operators.resolve import classify_presence


def composed(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(*keep, id, pieces, witness) of the rows whose text has words, each word digested once.

    Rows are chosen by their text, as a test of the id would make all digests anew; so would a test for null that a join
    infers, which is why the id is declared never to be null.
    """
    words = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), content_id)
    once = F.element_at(F.transform(F.array(words), lambda w: F.struct(composite_id(w).alias("id"), F.size(w).alias("pieces"))), 1)
    held = rows.filter(F.ltrim(text) != "").select(*[F.col(k) for k in keep], once.alias("_c"), F.sha2(text, 256).alias("witness"))
    return held.select(*keep, F.coalesce("_c.id", F.lit("")).alias("id"), "_c.pieces", "witness")


def admitted_content(rows: DataFrame, key: str, text: Column, stored: DataFrame) -> DataFrame:
    """(key, id, pieces, class): each text decomposed into words, composed to an id, and classed against what is stored.

    ``stored`` has id and witness; the witness of a text is the digest of its bytes.  A text without words has no id, and
    isn't classed.  Words of a text never leave its row.
    """
    return classify_presence(composed(rows, text, key), stored, "id", "witness").select(key, "id", "pieces", "class")


def admitted_prompt(rows: DataFrame, key: str, text: Column, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A prompt is ordinary content with an occurrence (key, entity) of its own; it attests nothing."""
    content = admitted_content(rows, key, text, stored)
    return content, content.select(key, F.col("id").alias("entity"), F.lit(0).alias("attestations"))


class Reference(NamedTuple):
    """A column whose values name things: the namespace, and what its occurrence declares (bits of ``rule_flag``)."""

    column: str
    namespace: str
    flags: int


class Mapping(NamedTuple):
    """Two reference columns of a record that are mapped to each other."""

    left: Reference
    right: Reference
    relation: str
    symmetric: bool = False


def claims(records: DataFrame, columns: list[str]) -> DataFrame:
    """``records`` with the id of the claim that each record is; equal records make equal claims."""
    return records.withColumn("claim", record_id("claim", *[F.col(f"`{c}`") for c in columns]))


def reference_occurrences(claimed: DataFrame, rules: list[Reference]) -> DataFrame:
    """(claim, namespace, local_id, rule_flags): one row per record and rule whose column isn't empty."""
    each = F.array(*[F.struct(F.lit(r.namespace).alias("namespace"), F.col(f"`{r.column}`").cast("string").alias("local_id"), F.lit(r.flags).alias("rule_flags")) for r in rules])
    return claimed.select("claim", F.explode(each).alias("r")).select("claim", "r.*").filter("local_id is not null and local_id <> ''")


def mapping_occurrences(claimed: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """(claim, relation, left_id, right_id, symmetric): one row per record and mapping of which both columns have values.

    The ends of symmetric mappings are in canonical order, so that either way of writing one is the same.
    """
    parts = []
    for m in mappings:
        left, right = (record_id("reference", F.lit(r.namespace), F.col(f"`{r.column}`")) for r in m[:2])
        low, high = (F.least(left, right), F.greatest(left, right)) if m.symmetric else (left, right)
        named = [F.coalesce(F.col(f"`{r.column}`").cast("string"), F.lit("")) != "" for r in m[:2]]
        parts.append(claimed.filter(named[0] & named[1]).select("claim", F.lit(m.relation).alias("relation"), low.alias("left_id"), high.alias("right_id"), F.lit(m.symmetric).alias("symmetric")))
    return reduce(DataFrame.unionByName, parts)


def reflected(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, id): each record itself as a composition of its fields, a field being one of its name and its value.

    Null values have a name and no value, so a field of them is the name alone.
    """
    request = F.concat_ws("/", F.lit("record"), F.col(key).cast("string"))
    field = lambda c: F.concat_ws("/", request, F.lit(c))
    known, prior = F.lit(None).cast("string"), F.lit(None).cast("string")
    row = lambda r, ordinal, entity, before: F.struct(r.alias("request"), F.lit(ordinal).alias("ordinal"), entity.alias("entity"), before.alias("prior"))
    rows = []
    for k, c in enumerate(columns, 1):
        rows += [row(field(c), 1, content_id(F.lit(c)), prior), F.when(F.col(c).isNotNull(), row(field(c), 2, content_id(F.col(c).cast("string")), prior)), row(request, k, known, field(c))]
    requests = records.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r")).select("r.*")
    made = compositions(requests).select("request", "id")
    return records.select(key, request.alias("_request")).join(made, F.col("_request") == F.col("request")).select(key, "id")
