"""What must not grow faster than the input: orders of joins, keys of joins, sizes of tasks, and rows written twice."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.operators import closure, interpret, occurrence, search, semantic
from tesserae.plans import admission as plans_admission
from tesserae.plans import star, substrate, text
from tesserae.sources import providers


def test_joins_start_with_the_finer_key(spark):
    """Three rows of ``lines`` an order against a hundred suppliers a nation: the smaller relation multiplies more."""
    orders = spark.range(300).select(F.col("id").alias("order"), (F.col("id") % 2).alias("nation"), F.col("id").alias("row_id"))
    suppliers = spark.range(200).select(F.col("id").alias("supplier"), (F.col("id") % 2).alias("nation"), F.col("id").alias("row_id"))
    lines = spark.range(900).select((F.col("id") % 300).alias("order"), (F.col("id") % 200).alias("supplier"), F.col("id").alias("row_id"))
    f = interpret.Factor
    factors = [f("orders", orders, ("order", "nation"), 1), f("suppliers", suppliers, ("supplier", "nation"), 2), f("lines", lines, ("order", "supplier"), 3)]
    assert [x.name for x in interpret.order_of(factors)] == ["orders", "lines", "suppliers"]
    assert interpret.interpretations(factors).count() == sum((k % 300) % 2 == (k % 200) % 2 for k in range(900))


def test_evidence_meets_occurrences_by_row(spark):
    """One profile of many rows: no join pairs all its occurrences with all its testimony."""
    rows = spark.range(40)
    occurrences = rows.select(F.col("id").alias("occurrence"), F.lit(1).alias("boundary"), (F.col("id") % 1 + 7).alias("profile"), F.col("id").alias("row"), F.lit(1).alias("left_id"), (F.col("id") + 100).alias("right_id"), F.col("id").alias("proposition"), F.lit(1).alias("relation"), F.lit(False).alias("symmetric"), F.lit(semantic.RESOLVED).alias("disposition"))
    testimony = rows.select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("testimony"), (F.col("id") % 1 + 7).alias("profile"), F.col("id").alias("node"), F.lit(0).alias("uncertainty_numerator"), F.lit(1).alias("uncertainty_denominator"))
    nodes, roots = rows.select(F.col("id").alias("node"), F.col("id").alias("row")), rows.select(F.col("id").alias("node"), (F.col("id") % 5).alias("root"))
    members = testimony.join(roots, "node").filter("node != 3").select(F.lit(1).alias("boundary"), "profile", "node", "root", "testimony")
    members = members.unionByName(members.select(F.lit(2).alias("boundary"), "profile", F.lit(3).cast("bigint").alias("node"), "root", "testimony"))
    edges = semantic.evidenced_edges(spark.createDataFrame([(1,)], "id int"), occurrences, testimony, nodes, roots, members, 1)
    assert sorted((r["target"], r["root"]) for r in edges.collect()) == [(k + 100, k % 5) for k in range(40) if k != 3]
    joins = [line for line in re.findall(r"Join Inner, (.*)", edges._jdf.queryExecution().optimizedPlan().toString()) if "profile" in line]
    assert joins and all("row#" in line for line in joins)


def test_tasks_of_texts_follow_the_size_of_texts(spark, monkeypatch):
    """Texts are dealt before they are taken apart, so tokens never move and a task holds so much text."""
    monkeypatch.setattr(occurrence, "TASK_TEXT", 1000)
    monkeypatch.setattr(text, "ANCHOR", "b")
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a B b c " * 10 + "b").alias("text"))
    monkeypatch.setattr(text, "table", lambda *_: docs)
    assert text.document_runs(spark, "").rdd.getNumPartitions() == 1 + 8100 // 1000
    assert dict(docs.transform(lambda _: text.document_occurrences(spark, "")).select("container", "runs").collect()) == dict.fromkeys(range(100), 31)
    near = text.successors(spark, "")
    assert [tuple(r) for r in near.orderBy("target").collect()] == [("b", 1000, 1000), ("c", 1000, 1000)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity" not in plan and "SortMergeJoin" not in plan


def test_searches_read_their_edges_written(spark):
    """The graph of lines is made once, not in every round."""
    edges = substrate._bipartite(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString()
    some = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 5), ("c", "d", 1)], "source string, target string, cost bigint")
    state = lambda s: spark.createDataFrame([(s,)], "state string")
    found = search.cheapest_paths(some, state("a"), some.select(F.col("target").alias("state")), 3, None).paths
    assert sorted((r["state"], int(r["cost"]), r["depth"]) for r in found.collect()) == [("b", 1, 1), ("c", 2, 2), ("c", 5, 1), ("d", 3, 3), ("d", 6, 2)]


def test_range_join_deals_out_large_groups(spark, monkeypatch):
    """Pairs of one group are made by several tasks, each once."""
    monkeypatch.setattr(star, "PAIRS", 500)
    parts = spark.range(300).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), (F.col("id") % 3).cast("int").alias("p_size"))
    monkeypatch.setattr(star, "table", lambda *_: parts)
    got = star.range_join(spark, "")
    want = sorted((a, b) for a in range(300) for b in range(300) if 1 <= b % 3 - a % 3 <= 2)
    assert sorted(map(tuple, got.collect())) == want
    assert max(map(len, got.rdd.glom().collect())) < len(want) / 6


def test_vocabulary_is_written_before_it_meets_pieces(spark, monkeypatch):
    made = []
    monkeypatch.setattr(closure, "written", lambda df, old=closure.written: made.append(df) or old(df))
    children = spark.createDataFrame([("s", 2, "w"), ("s", 1, "v")], "container string, ordinal bigint, entity string")
    atoms = spark.createDataFrame([("w", "there"), ("v", "hi ")], "entity string, text string")
    assert closure.expanded_text(children.select(F.col("container").alias("entity")).distinct(), children, atoms).first()["text"] == "hi there"
    assert ["_atom", "text"] in [df.columns for df in made]
    assert all("SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for df in made if "_atom" in df.columns and "root" in df.columns)


def test_providers_give_spans_piecemeal():
    """A batch of pages isn't held with all its spans: what is given at once follows the bytes of content."""

    class Spans:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    page = b"<p>" + b"word " * 20_000 + b"</p>"
    columns = {"artifact": ["a"] * 50, "media": ["text/html"] * 50, "start": [0] * 50, "content": [page] * 50}
    out = list(providers._apply(Spans())(iter([pa.RecordBatch.from_pydict(columns)])))
    assert sum(b.num_rows for b in out) == 150 and max(b.num_rows for b in out) <= 3 * (providers.HELD // len(page) + 1)


def test_words_are_digested_once(spark):
    """Neither the id of a text nor the number of its words makes the digests of all words anew."""
    plan = plans_admission.admitted_content(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(text", plan)) == 2  # the documents, and the third that is stored


def test_levels_broadcast_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(closure, "written", lambda df, old=closure.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or old(df))
    edges = spark.range(2, 64).select(F.col("id").alias("container"), F.expr("id div 2").alias("entity"))
    assert dict(closure.levels(edges).collect()) == {k: k.bit_length() - 1 for k in range(1, 64)}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_readback_keeps_texts_of_one_id_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (1, "c  d"), (2, "e f"), (2, "e f"), (None, "g h"), (3, None), (4, "")], "doc_id bigint, text string")
    monkeypatch.setattr(text, "table", lambda *_: docs)
    assert [r["exact"] for r in text.readback_exact(spark, "").collect()] == [True] * 7
