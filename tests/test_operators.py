"""Operators on small tables, with the wrong variants that each must be told from."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import closure, guidance, interpret, latest, linear, occurrence, relations, resolve, response, search, standing


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_deep_graphs_are_no_cycles(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(12)], "child int, parent int")
    assert closure.cyclic(chain).isEmpty()
    nodes = spark.range(13).select(F.col("id").cast("int").alias("node"))
    assert rows(closure.root_projection(nodes, chain), "node") == [(k, 0, k) for k in range(13)]
    assert rows(closure.levels(chain.toDF("container", "entity")), "node") == [(k, k) for k in range(13)]
    loop = chain.unionByName(spark.createDataFrame([(5, 9), (20, 9)], chain.schema))
    with pytest.raises(closure.CycleError) as found:
        closure.root_projection(nodes.union(spark.createDataFrame([(20,)], "node int")), loop)
    path = closure.cycle_path(found.value.nodes)
    assert path[0] == path[-1] and sorted(path[1:]) == [5, 6, 7, 8, 9] and all(b in {p for c, p in [*((k + 1, k) for k in range(12)), (5, 9)] if c == a} for a, b in zip(path, path[1:], strict=False))
    with pytest.raises(closure.CycleError):
        closure.levels(loop.toDF("container", "entity"))


def test_compositions_of_prior_results(spark):
    import hashlib

    made = lambda *ids: hashlib.sha256(("01" + "".join(ids)).encode()).hexdigest()[:32]
    a, b = "a" * 32, "b" * 32
    columns = "request string, ordinal int, entity string, prior string"
    asked = [("x", 1, a, None), ("x", 2, b, None), ("y", 2, a, None), ("y", 1, None, "x"), ("one", 1, None, "y"), ("z", 1, None, "one"), ("z", 2, None, "x")]
    got = {r["request"]: (r["id"], r["level"]) for r in closure.compositions(spark.createDataFrame(asked, columns)).collect()}
    x = made(a, b)
    assert got == {"x": (x, 0), "y": (made(x, a), 1), "one": (made(x, a), 2), "z": (made(made(x, a), x), 3)}
    for wrong in (("w", 1, None, "w"), ("w", 1, None, "nothing")):
        with pytest.raises(closure.CycleError):
            closure.compositions(spark.createDataFrame([*asked, wrong], columns))
    assert closure.compositions(spark.createDataFrame([], columns)).isEmpty()


def test_cooccurrence_sums_are_those_of_the_pairs(spark):
    import random

    rng = random.Random(9)
    text = spark.createDataFrame([(k, " ".join(rng.choice("aabcd ") for _ in range(rng.randint(0, 40)))) for k in range(60)], "d int, t string")
    run_table = occurrence.runs(occurrence.tokens(text, "d", F.col("t"))).cache()
    for anchors in (["a"], ["a", "c"], ["z"]):
        wanted = spark.createDataFrame([(x,) for x in anchors], "entity string")
        slow = response.response_field(relations.cooccurrences(run_table, wanted))
        fast = response.response_field(relations.cooccurrences(run_table, wanted).limit(0), relations.cooccurrence_sums(run_table, wanted))
        assert rows(fast, "target") == rows(slow, "target")
        near = [relations.containers(run_table, wanted), relations.neighbours(run_table, wanted, relations.SUCCESSOR), relations.neighbours(run_table, wanted, relations.PREDECESSOR), relations.cooccurrences(run_table, wanted)]
        pairs = near[0].unionByName(near[1]).unionByName(near[2]).unionByName(near[3])
        assert rows(response.response_field(None, relations.anchor_sums(run_table, wanted)), "target") == rows(response.response_field(pairs), "target")


@pytest.fixture(scope="module")
def run_table(spark):
    text = spark.createDataFrame([(1, "a b b b c"), (2, "b a  a b"), (3, "")], "d int, t string")
    return occurrence.runs(occurrence.tokens(text, "d", F.col("t"))).cache()


def test_runs_keep_ordinals_and_holes(run_table):
    assert rows(run_table.select("container", "ordinal", "entity", "run"), "container", "ordinal") == [(1, 1, "a", 1), (1, 2, "b", 3), (1, 5, "c", 1), (2, 1, "b", 1), (2, 2, "a", 1), (2, 4, "a", 1), (2, 5, "b", 1)]
    assert occurrence.expanded(run_table).count() == 9


def test_runs_dont_depend_on_partitions(spark, run_table):
    text = spark.createDataFrame([(1, "a b b b c"), (2, "b a  a b"), (3, "")], "d int, t string").repartition(3)
    again = occurrence.runs(occurrence.tokens(text, "d", F.col("t")).repartition(4, "ordinal"))
    assert rows(again, "container", "ordinal") == rows(run_table, "container", "ordinal")


def test_neighbours_have_inner_edges_and_meet_without_gap(spark, run_table):
    b = spark.createDataFrame([("b",)], "entity string")
    after = relations.neighbours(run_table, b, relations.SUCCESSOR)
    assert rows(after.select("container", "target", "multiplicity"), "container", "target") == [(1, "b", 2), (1, "c", 1), (2, "a", 1)]
    a = spark.createDataFrame([("a",)], "entity string")
    before = relations.neighbours(run_table, a, relations.PREDECESSOR)
    assert rows(before.select("container", "target"), "container") == [(2, "b")]  # the hole at 3 parts the two


def test_cooccurrence_and_field(spark, run_table):
    b = spark.createDataFrame([("b",)], "entity string")
    co = relations.cooccurrences(run_table, b)
    assert rows(co.filter("container = 1").select("target", "multiplicity", "gap"), "target") == [("a", 1, 1), ("b", 2, 1), ("c", 1, 3)]
    field = {r["target"]: r for r in response.response_field(co.union(relations.containers(run_table, b))).collect()}
    assert field["a"]["candidate_count"] == 5 and field["a"]["min_gap"] == 1 and field["1"]["mass_container"] == 3 and field["1"]["relation_mask"] == 1
    assert relations.union_of(co, co).count() == co.distinct().count()
    assert relations.bounded(co, 2)[1] == "exhausted" and relations.bounded(co, 2)[0].count() == 0 and relations.bounded(co, 100)[1] == "complete"


def test_tiling(spark):
    good, gap, overlap = [(1, 1, 2, 5), (1, 3, 5, 5)], [(2, 1, 2, 5), (2, 4, 5, 5)], [(3, 1, 3, 5), (3, 3, 5, 5)]
    short = [(4, 1, 2, 5)]
    found = occurrence.tiling_faults(spark.createDataFrame(good + gap + overlap + short, "parent int, first int, last int, logical_count int"))
    assert [r[0] for r in rows(found.select("parent"), "parent")] == [2, 3, 4]


def test_fold_counts_roots_not_copies(spark):
    seen = spark.createDataFrame([("p", "r1", 1)] * 1000 + [("p", "r1", -1), ("p", "r2", 1)], "k string, root string, polarity int")
    assert rows(response.evidence_fold(seen, ["k"]), "k") == [("p", 1002, 2, 2, 1, 1)]


def test_closure_takes_least_depth_and_rejects_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("d", "x")], "child string, parent string")
    nodes = spark.createDataFrame([(n,) for n in "abcdx"], "node string")
    got = {(n, r): d for n, r, d in closure.root_projection(nodes, edges).collect()}
    assert got == {("a", "a"): 0, ("x", "x"): 0, ("b", "a"): 1, ("c", "a"): 1, ("d", "a"): 2, ("d", "x"): 1}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    with pytest.raises(closure.CycleError):
        closure.root_projection(spark.createDataFrame([(n,) for n in "abcd"], "node string"), ring)
    with pytest.raises(closure.CycleError):
        closure.root_projection(nodes, spark.createDataFrame([("a", "a")], "child string, parent string"))
    with pytest.raises(ValueError, match="unknown"):
        closure.root_projection(nodes, spark.createDataFrame([("a", "z")], "child string, parent string"))


def test_readback_through_tiers(spark):
    children = spark.createDataFrame([("w", 1, "h"), ("w", 2, "i"), ("s", 1, "w"), ("s", 2, "_"), ("s", 3, "w")], "container string, ordinal bigint, entity string")
    atoms = spark.createDataFrame([("h", "h"), ("i", "i"), ("_", " ")], "entity string, text string")
    roots = spark.createDataFrame([("s",), ("h",)], "entity string")
    assert dict(closure.expanded_text(roots, children, atoms).collect()) == {"s": "hi hi", "h": "h"}
    assert dict(closure.levels(children).collect())["s"] == 2
    with pytest.raises(ValueError):
        closure.expanded_text(roots, children, atoms.filter("entity != 'i'"))


def test_topology_present_wins_and_conflicts_show(spark):
    c = spark.createDataFrame([("a", 1), ("a", 2), ("b", 4), ("b", 1), ("c", 1), ("d", 2), ("d", 4)], "key string, rule_flags int")
    got = resolve.topology(c, ["key"]).groupBy("key").agg(F.max("disposition"), F.max("conflict"))
    assert rows(got, "key") == [("a", 1, False), ("b", 2, False), ("c", 6, False), ("d", 1, True)]


def test_mapping_rules(spark):
    table = spark.createDataFrame([(1, 1), (2, 6), (6, 6), (6, 1), (1, 6)], "l int, r int")
    assert [r[0] for r in table.select(resolve.mapping_disposition(F.col("l"), F.col("r"))).collect()] == [1, 5, 4, 2, 3]
    low, high = resolve.proposition_ends(F.lit(9), F.lit(3), F.col("s"))
    assert rows(spark.createDataFrame([(True,), (False,)], "s boolean").select(low.alias("l"), high.alias("h")), "l") == [(3, 9), (9, 3)]


def test_presence_and_replay(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "k string, w int")
    incoming = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "k string, w int")
    assert rows(resolve.classify_presence(incoming, stored, "k", "w").select("k", "class"), "k") == [("a", 1), ("b", 2), ("c", 0)]
    assert rows(resolve.missing(incoming, stored, ["k"]), "k") == [("c", None)]
    assert resolve.verified_count(incoming, incoming) == 3 and resolve.verified_count(incoming, stored) == 1


def test_search_takes_cheaper_label_over_shallower(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 5), ("c", "d", 1), ("a", "d", 9)], "source string, target string, cost int").withColumn("cost", F.col("cost").cast("decimal(38,0)"))
    a, d = spark.createDataFrame([("a",)], "state string"), spark.createDataFrame([("d",)], "state string")
    found = search.cheapest_paths(edges, a, d, 5, 3)
    assert found.disposition == "complete" and [(int(r["cost"]), r["path"]) for r in found.paths.collect()] == [(3, ["a", "b", "c", "d"]), (6, ["a", "c", "d"]), (9, ["a", "d"])]
    assert search.cheapest_paths(edges, a, d, 1, 3).disposition == "upper_bound"
    assert search.cheapest_paths(edges, d, a, 5, 1).disposition == "no_admissible_path"
    assert dict(search.reach(edges, a, 2).collect()) == {"a": 0, "b": 1, "c": 1, "d": 1}


def test_best_first_dispositions(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 5), ("c", "d", 1), ("a", "d", 9)], "source string, target string, cost int").withColumn("cost", F.col("cost").cast("decimal(38,0)"))
    a, d = spark.createDataFrame([("a",)], "state string"), spark.createDataFrame([("d",)], "state string")
    budget = search.Budget(5)
    kept = lambda r: [(int(p["cost"]), p["path"]) for p in r.paths.collect()]
    one = search.best_first(edges, a, d, budget)
    assert kept(one) == [(3, ["a", "b", "c", "d"])] and one.disposition == "complete" and one.optimal and one.expanded == 3
    assert kept(search.best_first(edges, a, d, budget, paths=3)) == [(3, ["a", "b", "c", "d"]), (6, ["a", "c", "d"]), (9, ["a", "d"])]
    partial = search.best_first(edges, a, d, budget, paths=4)
    assert partial.disposition == "partial" and not partial.optimal and len(kept(partial)) == 3
    assert search.best_first(edges, a, d, budget, whole=False).disposition == "upper_bound"
    assert search.best_first(edges, d, a, budget).disposition == "no_admissible_path"
    assert search.best_first(edges, d, a, budget, provider="denied").disposition == "denied"
    assert search.best_first(edges, d, a, budget, whole=False).disposition == "incomplete_boundary"
    assert search.best_first(edges, a, d, search.Budget(5, expanded=1)).disposition == "exhausted"
    assert search.best_first(edges, a, d, search.Budget(5, open=0)).disposition == "exhausted"
    assert kept(search.best_first(edges, a, d, search.Budget(1))) == [(9, ["a", "d"])]
    assert kept(search.best_first(edges.limit(0), a, a, budget)) == [(0, ["a"])]


def test_best_first_reopens_where_the_estimate_is_not_consistent(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 3), ("c", "d", 6)], "source string, target string, cost int").withColumn("cost", F.col("cost").cast("decimal(38,0)"))
    a, d = spark.createDataFrame([("a",)], "state string"), spark.createDataFrame([("d",)], "state string")
    estimate = spark.createDataFrame([("b", 7), ("c", 0)], "state string, estimate int")
    assert [int(r["cost"]) for r in search.best_first(edges, a, d, search.Budget(5), heuristic=estimate).paths.collect()] == [8]
    assert [int(r["cost"]) for r in search.best_first(edges, a, d, search.Budget(5), heuristic=estimate, reopen=False).paths.collect()] == [9]


def test_best_first_against_all_paths(spark):
    draw = random.Random(5)
    links = sorted({(draw.randrange(7), draw.randrange(7), draw.randrange(1, 6)) for _ in range(24)})
    edges = spark.createDataFrame(links, "source int, target int, cost int").withColumn("cost", F.col("cost").cast("decimal(38,0)"))
    every, ahead = [], [(0, [0])]
    while ahead:
        cost, path = ahead.pop()
        if path[-1] in (5, 6):
            every.append((cost, len(path) - 1, path[-1]))
        elif len(path) <= 4:
            ahead += [(cost + c, [*path, t]) for s, t, c in links if s == path[-1] and t not in path]
    every = set(every)
    want = sorted(x for x in every if not any(y != x and y[2] == x[2] and y[0] <= x[0] and y[1] <= x[1] for y in every))
    state = lambda ids: spark.createDataFrame([(i,) for i in ids], "state int")
    for paths in (2, 20):
        got = search.best_first(edges, state([0]), state([5, 6]), search.Budget(4), paths=paths)
        assert [(int(r["cost"]), r["depth"], r["state"]) for r in got.paths.collect()] == want[:paths]


def test_glicko_reference_example(spark):
    states = spark.createDataFrame([("p", 1500.0, 200.0, 0.06), ("x", 1400.0, 30.0, 0.06), ("y", 1550.0, 100.0, 0.06), ("z", 1700.0, 300.0, 0.06), ("idle", 1500.0, 50.0, 0.06)], "lane string, rating double, deviation double, volatility double")
    games = spark.createDataFrame([("p", "x", 1.0), ("p", "y", 0.0), ("p", "z", 0.0)], "lane string, opponent string, score double")
    got = {r["lane"]: r for r in standing.rate_period(states, games).collect()}
    assert abs(got["p"]["rating"] - 1464.06) < 0.01 and abs(got["p"]["deviation"] - 151.52) < 0.01 and abs(got["p"]["volatility"] - 0.05999) < 1e-5
    assert got["idle"]["rating"] == 1500.0 and got["idle"]["deviation"] > 50 and got["x"]["rating"] == 1400.0
    assert standing.onboard(states).first()["deviation"] == 350.0


def test_operator_forms_agree_and_solve(spark):
    rng = np.random.default_rng(1)
    data = [(k, int(rng.integers(6)), int(rng.integers(6)), float(rng.normal()), float(rng.normal()), float(rng.normal()), float(rng.uniform(0.5, 2))) for k in range(30)]
    constraints = spark.createDataFrame(data + data[:5], "evidence int, i int, j int, a double, b double, c double, w double")
    unique = linear.deduplicated(constraints)
    assert unique.count() == 30
    dense = np.zeros((6, 6))
    for r in linear.matrix(unique).collect():
        dense[r["row"], r["col"]] += r["value"]
    x = rng.normal(size=6)
    got = dict(linear.apply(unique, spark.createDataFrame(list(enumerate(x.tolist())), "k int, value double")).collect())
    assert np.allclose([got.get(k, 0) for k in range(6)], dense @ x)
    boundary = spark.createDataFrame([(0, 1.0, 5.0)], "k int, value double, weight double")
    one = linear.solve(unique, boundary)
    assert one.disposition == "converged"
    right = np.zeros(6)
    for r in linear.right_side(unique).collect():
        right[r["k"]] += r["value"]
    right[0] += 5
    full = dense + np.eye(6) * 1e-6
    full[0, 0] += 5
    assert np.allclose([dict(one.x.collect())[k] for k in range(6)], np.linalg.solve(full, right), atol=1e-6)
    linear.DRIVER_UNKNOWNS, kept = 0, linear.DRIVER_UNKNOWNS
    try:
        two = linear.solve(unique, boundary, tolerance=1e-9, rounds=40)
    finally:
        linear.DRIVER_UNKNOWNS = kept
    assert np.allclose([dict(two.x.collect())[k] for k in range(6)], [dict(one.x.collect())[k] for k in range(6)], atol=1e-5)
    with pytest.raises(ValueError):
        linear.deduplicated(spark.createDataFrame([(1, 0, 1, 1.0, 1.0, 1.0, 1.0), (1, 0, 1, 1.0, 1.0, 2.0, 1.0)], constraints.schema))


def test_factors_have_one_gauge():
    m = np.arange(12.0).reshape(3, 4)
    u, v = linear.factored(m)
    assert np.allclose(u @ v.T, m) and all(u[np.abs(u[:, k]).argmax(), k] >= 0 for k in range(2))


def test_guidance(spark):
    o = spark.createDataFrame([("a", 1, True, False), ("a", 2, True, False), ("b", 3, True, False), ("b", 1, True, False), ("c", 3, True, True), ("d", 1, False, False)], "goal string, disposition int, required boolean, unresolved_allowed boolean")
    assert rows(guidance.completion(o, "goal").select("goal", "completion"), "goal") == [("a", 1), ("b", 3), ("c", 2), ("d", 2)]
    s = guidance.resolved(o, spark.createDataFrame([("a", 2)], "goal string, disposition int"), ["goal"])
    assert rows(s.filter("goal = 'a'").select("disposition"), "disposition") == [(2,), (2,)]


def test_latest_and_as_of(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, t int, v string")
    assert rows(latest.latest(r, ["k"], [F.desc("t")]), "k") == [("a", 3, "y"), ("b", 2, "z")]
    left = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 9), ("c", 5)], "k string, at int")
    assert rows(latest.as_of(left, r, "k", "at", "t", "v").select("k", "at", "v"), "k", "at") == [("a", 0, None), ("a", 1, "x"), ("a", 2, "x"), ("a", 9, "y"), ("c", 5, None)]
    tied = spark.createDataFrame([("a", 1, "p"), ("a", 1, "q"), ("b", 1, "p"), ("b", 2, "q")], "k string, r int, c string")
    assert rows(latest.best_with_ties(tied, ["k"], [F.col("r")], "c"), "k") == [("a", "p", True), ("b", "p", False)]


def test_joint_interpretation_keeps_derivations(spark):
    f = interpret.Factor
    a = spark.createDataFrame([(1, 2, 10), (1, 2, 11)], "x int, y int, row_id int")
    b = spark.createDataFrame([(2, 3, 20)], "y int, z int, row_id int")
    got = interpret.interpretations([f("a", a, ("x", "y"), 2), f("b", b, ("y", "z"), 1)])
    assert rows(got.select("x", "y", "z", "row_a", "row_b"), "row_a") == [(1, 2, 3, 10, 20), (1, 2, 3, 11, 20)]
    with pytest.raises(ValueError):
        interpret.interpretations([f("a", a, ("x",), 2), f("b", b, ("z",), 1)])


def test_centroid_is_weighted(spark):
    r = linear.centroids(spark.createDataFrame([(1, 0.0, 3.0, 1), (1, 4.0, 3.0, 3)], "g int, x double, y double, m int"), "g", ["x", "y"], "m").first()
    assert (r["x"], r["y"]) == (3.0, 3.0) and math.isclose(r["radius"], math.sqrt(18))
