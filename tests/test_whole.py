"""Queries that must read all of their input, held against plain Python over the smallest tables or a small fixture."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from tesserae.operators import cognition
from tesserae.plans import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def rows(columns: str, d: str = SMALL) -> list[tuple]:
    """Rows of "table: column, column"."""
    name, _, wanted = columns.partition(":")
    return duckdb.connect().execute(f"SELECT {wanted} FROM '{Path(d) / name}.parquet'").fetchall()


def found(spark, name: str, d: str = SMALL) -> list[tuple]:
    return [tuple(r) for r in QUERIES[name](spark, d).collect()]


def test_joint_interpretations_of_all_orders(spark):
    nation, home = dict(rows("customer: c_custkey, c_nationkey")), dict(rows("supplier: s_suppkey, s_nationkey"))
    buyer = dict(rows("orders: o_orderkey, o_custkey"))
    want = [(o, home[s], s) for o, s in rows("lineitem: l_orderkey, l_suppkey") if o in buyer and s in home and nation.get(buyer[o]) == home[s]]
    assert len({o % 10 for o, _, _ in want}) == 10
    assert Counter(found(spark, "joint_interpretations")) == Counter(want)


def test_supplier_and_part_graph_is_not_folded(spark, tmp_path):
    """Keys beyond any fold; supplier 0 sells parts 7 and 61, and reaches 45 by part 61 only, 90 in four edges, 99 never."""
    sold = [(0, 7, 2), (0, 7, 1), (0, 61, 3), (45, 61, 1), (45, 300, 1), (90, 300, 4), (90, 500, 1), (99, 500, 1)]
    columns = "l_suppkey bigint, l_partkey bigint, l_linenumber int"
    spark.createDataFrame(sold, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    d = str(tmp_path)
    assert dict(found(spark, "response_scan", d)) == {0: 0, 15: 1, 123: 1, 90: 2, 601: 3, 180: 4}
    assert [(s, int(c)) for s, c in found(spark, "cheapest_states", d)] == [(0, 0), (90, 10 + 4), (180, 14 + 4 + 13)]


def test_supplier_and_part_graph_of_the_tables(spark):
    cost: dict[tuple, int] = {}
    for s, p, n in rows("lineitem: l_suppkey, l_partkey, l_linenumber"):
        for edge in ((2 * s, 2 * p + 1), (2 * p + 1, 2 * s)):
            cost[edge] = min(cost.get(edge, 1 << 60), 3 * n + 1)
    best, depth = {0: 0}, {0: 0}
    for level in range(1, 5):
        new = dict(best)
        for (a, b), c in cost.items():
            if a in best:
                new[b] = min(new.get(b, 1 << 60), best[a] + c)
                depth.setdefault(b, level)
        best = new
    assert len(cost) == 2 * 1905
    assert dict(found(spark, "response_scan")) == depth
    assert [(s, int(c)) for s, c in found(spark, "cheapest_states")] == sorted(((s, c) for s, c in best.items() if s % 2 == 0), key=lambda x: x[::-1])[:10]


def test_forward_passes_of_all_customers(spark):
    states: dict[int, str] = {}
    for goal, status in rows("orders: o_custkey, o_orderstatus"):
        states[goal] = "blocked" if status == "P" or states.get(goal) == "blocked" else "complete"
    assert len(states) > 100 and set(states.values()) == {"blocked", "complete"}
    assert dict(found(spark, "forward_passes")) == states


def test_goals_block_by_themselves_inside_the_pass(spark):
    """Goal 1 completes in two layers, 2 is blocked and keeps its open item, 3 is never resolved, 4 blocks later, 5 has nothing to do."""
    given = [(10, 1, 1), (11, 1, 1), (20, 2, 1), (21, 2, 3), (30, 3, 1), (40, 4, 1), (50, 5, 2)]
    duties = spark.createDataFrame([(i, g, x, True, False) for i, g, x in given], "item int, goal int, disposition int, required boolean, unresolved_allowed boolean")
    asked = []

    def offer(open_):
        asked.append({r["goal"] for r in open_.collect()})
        some = open_.filter("item not in (11, 30)") if len(asked) == 1 else open_.filter("item != 30")
        return some.select("item", F.lit(1).alias("operation"), F.lit(1).alias("kind"), F.lit(1).alias("reduction"), F.lit(0).alias("information"), F.lit(1).alias("cost"))

    solve = lambda chosen: chosen.select("item", F.when(F.col("item") == 40, 3).otherwise(2).alias("disposition"))
    left, ends = cognition.forward_passes(duties, offer, solve, "goal", ["item"])
    assert dict(ends.collect()) == {1: "complete", 2: "blocked", 3: "no_operation", 4: "blocked", 5: "complete"}
    assert dict(left.select("item", "disposition").collect()) == {10: 2, 11: 2, 20: 1, 21: 3, 30: 1, 40: 3, 50: 2}
    assert asked == [{1, 3, 4}, {1}]
    assert dict(cognition.forward_passes(duties, offer, solve, "goal", ["item"], layers=0)[1].collect())[1] == "layer_limit"


def test_collation_order_gives_every_word(spark, tmp_path):
    """Letters, then marks, then case, then the ignored punctuation; and more words than any page of a report."""
    ordered = ["aa", "coop", "co-op", "Coop", "coôp", "Coôp", "coops", "Zebra", "zebras"]
    many = [f"zz{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(1500)]
    texts = [(1, "Zebra coop\tCoop  co-op coôp"), (2, "zebras Coôp coops\naa coop "), (3, " ".join(reversed(many))), (4, None), (5, "")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = found(spark, "collation_order", str(tmp_path))
    assert [w for w, _ in got] == ordered + many
    assert [k for _, k in got] == sorted(k for _, k in got)
    assert dict(got)["coop"] != dict(got)["co-op"]
    key = lambda *points: "".join(f"{ord(c):06x}" for c in points)
    assert dict(got)["coôp"] == key(*"coop") + "!0" + "0003" + f"{0x302:06x}" + "!0" + "0000!0!"


def test_collation_order_of_the_tables(spark):
    want = {w for (text,) in rows("documents: text") for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w}
    assert len(want) > 1000 and {w for w, _ in found(spark, "collation_order")} == want


def test_every_incoming_row_is_looked_at(spark):
    """Only the stored side or the witness is altered: customers by 3 and 21, probes by 10."""
    asked = {c for (c,) in rows("orders: o_custkey")}
    missing = {c for c in asked if c % 3 or c >= 150}
    assert {c % 4 for c in missing} == {0, 1, 2, 3} and sorted(found(spark, "append_missing")) == sorted((c,) for c in missing)
    customers = rows("customer: c_custkey")
    assert found(spark, "verified_rows") == [(sum(c % 21 != 0 for (c,) in customers),)]
    docs = [(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in rows("documents: doc_id, text") if t is not None]
    first: dict[str, int] = {}
    for d, w in sorted(docs):
        first.setdefault(w, d)
    probes = Counter(w for d, w in docs if d % 10)
    assert any(d % 5 for d, _ in docs)
    assert sorted(found(spark, "reverse_lookup")) == sorted((w[:32], first[w], n) for w, n in probes.items())
