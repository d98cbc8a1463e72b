import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import collate
from tesserae.operators import cognition, syntax, targets
from tesserae.sources import package
from tesserae.streaming import standing_state


def test_every_span_has_one_role(spark):
    spans = spark.createDataFrame([(1, "p", "call", "f", 1), (2, "p", "call", None, 1), (3, "p", "name", None, 5)], "span int, provider string, kind string, field string, flags int")
    rule = "provider string, kind string, field string, required int, forbidden int, role string, disposition int"
    good = spark.createDataFrame([("p", "call", None, 1, 4, "call", 1), ("p", "name", None, 0, 0, "name", 2)], rule)
    assert dict(syntax.bindings(spans, good).select("span", "role").collect()) == {1: "call", 2: "call", 3: "name"}
    with pytest.raises(syntax.Unbound) as missing:
        syntax.bindings(spans, good.filter("kind = 'call'"))
    assert [r["span"] for r in missing.value.spans.collect()] == [3]
    with pytest.raises(syntax.Unbound):
        syntax.bindings(spans, good.union(spark.createDataFrame([("p", "call", "f", 0, 0, "other", 1)], rule)))


def test_closed_evidence(spark):
    nodes, edges = syntax.closed_evidence(spark.createDataFrame([("a",), ("b",), ("a",)], "claim string"), "s")
    assert nodes.count() == 3 and edges.count() == 2 and edges.select("parent").distinct().count() == 1
    assert syntax.closed_evidence(spark.createDataFrame([], "claim string"), "s")[0].count() == 0


def test_identical_slots_are_found(spark):
    ops = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 1.0), ("c", 0, 0, 2.0)], "slot string, row int, col int, value double")
    assert [tuple(r) for r in targets.identical_slots(ops).collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        targets.attention(np.eye(3), np.eye(3), 2)


def test_attention_shares_a_basis():
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(5, 2)) @ rng.normal(size=(2, 5)), rng.normal(size=(5, 2)) @ rng.normal(size=(2, 5))
    out = targets.attention(left, right, 4)
    q = out["basis"]
    assert np.allclose(q.T @ q, np.eye(4)) and np.allclose(out["q"] @ out["k"], q.T @ left @ q) and np.allclose(out["v"] @ out["o"], q.T @ right @ q)
    assert not any(np.allclose(out[m], np.eye(4)) for m in "qkvo")


def test_paths_rise_from_anchor_to_goal(spark):
    v = targets.chain_solution([(0, 1), (1, 2), (1, 4)])
    assert abs(v[0]) < 1e-4 and abs(v[-1] - 1) < 1e-4 and (np.diff(v) > 0).all()
    assert np.argmax(np.diff(v)) == 1  # the least certain step carries the most
    cut = targets.path_values(spark.createDataFrame([(1, [(0, 1)]), (2, [])], "k int, steps array<struct<n:bigint,d:bigint>>")).orderBy("k").collect()
    assert [r["accepted"] for r in cut] == [True, False]
    steps = [(0, 1), (1, 2), (1, 4), (9, 10)]
    ends = targets.path_values(spark.createDataFrame([(1, steps), (2, [(1, 1)])], "k int, steps array<struct<n:bigint,d:bigint>>")).orderBy("k").collect()
    whole = targets.chain_solution(steps)
    assert abs(ends[0]["anchor_value"] - whole[0]) < 1e-9 and abs(ends[0]["goal_value"] - whole[-1]) < 1e-9 and ends[1]["goal_value"] == 1.0


def obligations(spark, rows):
    return spark.createDataFrame(rows, "item int, disposition int, required boolean, unresolved_allowed boolean")


def test_forward_pass_dispositions(spark):
    offer = lambda open_: open_.select("item", F.lit(1).alias("operation"), F.lit(1).alias("kind"), F.lit(1).alias("reduction"), F.lit(0).alias("information"), F.lit(1).alias("cost"))
    solve = lambda chosen: chosen.select("item", F.lit(2).alias("disposition"))
    idle = lambda chosen: chosen.select("item", F.lit(1).alias("disposition"))
    run = lambda rows, do, **k: cognition.forward_pass(obligations(spark, rows), offer, do, ["item"], **k)
    assert run([(1, 1, True, False), (2, 2, True, False)], solve).disposition == "complete"
    assert run([(1, 1, True, False), (2, 3, True, False)], solve).disposition == "blocked"
    assert run([(1, 1, True, False)], idle).disposition == "no_operation"
    assert run([(1, 1, True, False)], solve, layers=0).disposition == "layer_limit"
    done = run([(1, 1, True, False)], solve)
    answers = spark.createDataFrame([(2, "a", "x"), (1, "b", "z"), (1, "b", "y")], "rank int, path_id string, entity_id string")
    assert cognition.selected_act(answers, done).first()["entity_id"] == "y"
    with pytest.raises(ValueError):
        cognition.selected_act(answers, done._replace(disposition="blocked"))


def test_frames_are_appended(spark):
    frames = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "discourse string, turn int, content string")
    got = cognition.next_frames(frames, spark.createDataFrame([("d", "c"), ("e", "x")], "discourse string, content string"))
    assert sorted(map(tuple, got.collect())) == [("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c"), ("e", 1, "x")]


def test_programs_resume_and_refuse_ambiguity(spark):
    step, seen = cognition.Step, []
    note = lambda df: (seen.append(1), df)[1]
    steps = [step("interpret", "one", ("observation",), lambda o: note(o.filter("id = 1"))), step("emit", "out", ("one", "observation"), lambda a, o: a.join(o, "id"))]
    known = cognition.run_program(steps, spark.range(3))
    assert known["out"].count() == 1
    cognition.run_program(steps, spark.range(3), resume={"one": known["one"]})
    assert len(seen) == 1
    with pytest.raises(ValueError, match="ambiguous"):
        cognition.run_program([step("interpret", "one", ("observation",), lambda o: o)], spark.range(3))
    with pytest.raises(ValueError, match="needs"):
        cognition.run_program([step("emit", "x", ("later",), lambda o: o)], spark.range(3))


def test_collation_levels():
    order = lambda words, **k: sorted(words, key=lambda w: collate.sort_key(w, **k))
    assert order(["côté", "cote", "coté", "Cote", "d"]) == ["cote", "Cote", "coté", "côté", "d"] or order(["cote", "Cote", "coté", "d"]) == ["cote", "Cote", "coté", "d"]
    assert collate.sort_key("a-b", shifted=True).startswith(collate.sort_key("ab", shifted=True).split("!")[0])


def test_packages_are_verified():
    data, identity = package.encode({"b": b"2", "a": b"1"})
    assert package.decode(data, identity) == {"a": b"1", "b": b"2"} and len(data) == package.measure({"a": b"1", "b": b"2"})
    for bad in (data[:-1] + b"x", data + b"x"):
        with pytest.raises(ValueError):
            package.decode(bad)
    with pytest.raises(ValueError):
        package.decode(data, "0" * 64)


def test_stateful_standings_follow_the_laws_of_a_period(spark, tmp_path):
    import os

    from tesserae.operators import standing

    others = {90: (1400.0, 30.0), 91: (1550.0, 100.0), 92: (1700.0, 300.0)}
    events = [(1, 0, 1.0, 90), (1, 0, 0.0, 91), (2, 0, 0.5, 92), (1, 0, 0.0, 92), (1, 2, 1.0, 91), (1, 0, 1.0, 90), (2, 2, 1.0, 90)]
    files = [events[:3], events[3:4], events[4:5], events[5:6], events[6:]]  # period 0 of lane 1 comes in two batches, and once more too late
    columns = "lane bigint, period bigint, score double, opponent_rating double, opponent_deviation double"
    folder = tmp_path / "in"
    for k, part in enumerate(files):
        spark.createDataFrame([(lane, p, s, *others[o]) for lane, p, s, o in part], columns).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if not (tmp_path / f"seen-{f.name}").exists():
                (tmp_path / f"seen-{f.name}").touch()
                os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(folder))
    seen = {}
    keep = lambda batch, _: seen.update({r["lane"]: r for r in batch.collect()})
    standing_state.running_standings(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    state = "lane bigint, rating double, deviation double, volatility double"
    fixed = [(o, r, d, 0.06) for o, (r, d) in others.items()]
    now = [(lane, 1500.0, 350.0, 0.06) for lane in (1, 2)]
    for period in range(3):
        games = spark.createDataFrame([(lane, o, s) for k, (lane, p, s, o) in enumerate(events) if p == period and k != 5], "lane bigint, opponent bigint, score double")
        after = standing.rate_period(spark.createDataFrame(now + fixed, state), games)
        now = [tuple(r) for r in after.filter("lane < 90").orderBy("lane").collect()]
    for lane, rating, deviation, volatility in now:
        assert np.allclose([seen[lane]["rating"], seen[lane]["deviation"], seen[lane]["volatility"]], [rating, deviation, volatility], rtol=1e-9)
    assert (seen[1]["events"], seen[1]["late"], seen[2]["events"], seen[2]["late"]) == (4, 1, 2, 0)
