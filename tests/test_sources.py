import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.plans import adhoc, registry
from tesserae.sources import bundle, providers, store, tabular, tensors
from tesserae.streaming import canonical


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder)


def test_delimited_is_strict(spark, tmp_path):
    form = tabular.Delimited(("a", "b"), "\t", "lf", header=True)
    good = write(tmp_path / "good", "x.tab", b'a\tb\n1\t"q\n\t\n')
    assert [tuple(r) for r in tabular.scan_delimited(spark, good, form).select("a", "b").collect()] == [("1", '"q'), ("", "")]
    spans = tabular.field_spans(spark, good, form).orderBy("start", "column").collect()
    assert [(s["start"], s["end"], s["value"]) for s in spans][:4] == [(0, 1, "a"), (2, 3, "b"), (4, 5, "1"), (6, 8, '"q')]
    for name, data in (("last", b"a\tb\n1\t2"), ("cr", b"a\tb\r\n1\t2\r\n"), ("count", b"a\tb\n1\n"), ("header", b"b\ta\n1\t2\n"), ("utf", b"a\tb\n\xff\t2\n")):
        with pytest.raises(tabular.MalformedArtifact):
            tabular.scan_delimited(spark, write(tmp_path / name, "x.tab", data), form).count()
    more = write(tmp_path / "more", "x.tab", b"a\tb\na\tb\n1\t2\na\tb\n")
    write(tmp_path / "more", "y.tab", b"a\tb\n3\t4\n")
    assert sorted(tuple(r) for r in tabular.scan_delimited(spark, more, form).select("a", "b").collect()) == [("1", "2"), ("3", "4"), ("a", "b"), ("a", "b")]
    with pytest.raises(tabular.MalformedArtifact):
        tabular.scan_delimited(spark, write(tmp_path / "later", "x.tab", b"1\t2\na\tb\n"), form).count()
    crlf = write(tmp_path / "crlf", "x.tab", b"a\tb\r\n1\t2\r\n")
    assert tabular.scan_delimited(spark, crlf, form._replace(terminator="crlf")).count() == 1


def test_fixed_width_overflow_is_witnessed(spark, tmp_path):
    fields = (tabular.Field("id", 4, "left"), tabular.Field("name", 5), tabular.Field("flag", 1, "none"))
    path = write(tmp_path / "fw", "x.txt", b"  12Bob  y\n   3Robertson n\n")
    with pytest.raises(tabular.MalformedArtifact):
        tabular.scan_fixed_width(spark, path, fields).count()
    got = tabular.scan_fixed_width(spark, path, fields, overflow="name", extra=6).select("id", "name", "flag", "overflow_excess").collect()
    assert sorted(map(tuple, got)) == [("12", "Bob", "y", 0), ("3", "Robertson", "n", 5)]
    # widths are bytes: two of them for one letter, and a field may not end inside it
    wide = write(tmp_path / "wide", "x.txt", "   4Zo\u00eb y\n".encode())
    assert [tuple(r)[1:4] for r in tabular.scan_fixed_width(spark, wide, fields).collect()] == [("4", "Zo\u00eb", "y")]
    for name, data in (("cut", "   5Zooo\u00eb\n".encode()), ("end", b"  12Bob  y"), ("long", b"  12Bobby yz\n")):
        with pytest.raises(tabular.MalformedArtifact):
            tabular.scan_fixed_width(spark, write(tmp_path / name, "x.txt", data), fields).count()


def test_bundle(spark, tmp_path):
    path = write(tmp_path / "b", "one.bin", b"\0\1")
    write(tmp_path / "b", "two.bin", b"x")
    found = bundle.artifacts(spark, path)
    one = found.filter("name = 'one.bin'").first()
    manifest = spark.createDataFrame([("one.bin", 2, one["digest"]), ("two.bin", 1, "0"), ("gone.bin", 1, "0")], "name string, bytes bigint, digest string")
    assert dict(bundle.verification(found, manifest).collect()) == {"one.bin": "exact", "two.bin": "digest", "gone.bin": "missing"}
    spans = spark.createDataFrame([("a", 2, b"lo"), ("a", 0, b"he")], "artifact string, start int, content binary")
    assert bytes(bundle.recomposed(spans).first()["content"]) == b"helo"


def test_providers():
    xml = b"<?xml version='1.0'?><a x='1'>t&amp;u<!--c--><b/></a>"
    kinds = [s.kind for s in providers.xml_events(xml)]
    assert kinds[:2] == ["declaration", "start"] and "comment" in kinds and kinds.count("end") == 2
    spans = list(providers.xml_events(xml))
    assert all(a.end == b.start for a, b in zip(spans, spans[1:], strict=False)) and spans[-1].end == len(xml)
    assert [s.kind for s in providers.html_elements(b"<p>a<br>b</p>")] == ["<p>", "text", "<br>", "text", "</p>"]
    assert any(s.kind == "FunctionDef" for s in providers.python_syntax(b"def f():\n    return 1\n"))
    text = "It's 3.5 km. Next one!".encode()
    words = [text[s.start : s.end].decode() for s in providers.text_segments(text) if s.kind == "word"]
    assert "".join(words) == text.decode() and "It's" in words and "3.5" in words
    assert [text[s.start : s.end] for s in providers.text_segments(text) if s.kind == "sentence"] == [b"It's 3.5 km. ", b"Next one!"]


@pytest.mark.parametrize("bad", [b'[Event "x]\n1. e4 *', b"1. e4 {open", b"1. e4 ) *", b"1. e4 (1. d4 *", b"1. e4 * \x01"])
def test_truncated_games_are_refused(bad):
    with pytest.raises(providers.GameError):
        list(providers.game_record(bad))


def test_game_record():
    data = b'[Event "A"]\n\n1. e4 {good} e5 (1... c5 $1) 2. Nf3 1-0\n'
    assert [s.kind for s in providers.game_record(data)] == ["tag", "number", "move", "comment", "move", "variation", "number", "move", "glyph", "variation_end", "number", "move", "result"]


def test_decomposition_follows_exposed_spans(spark):
    roots = spark.createDataFrame([("p", "text/html", bytearray(b"<p>Hi you.</p>"))], "artifact string, media string, content binary")
    got = providers.decompose(roots).collect()
    assert {r["provider"] for r in got} == {"html", "text"} and sum(r["kind"] == "word" for r in got) == 4


def test_inherited_attributes(spark):
    groups = spark.createDataFrame([("g", "Lu", "X-#")], "grp string, gc string, na string")
    children = spark.createDataFrame([(65, "g", None, None), (66, "g", "Ll", "own")], "cp int, grp string, gc string, na string")
    got = providers.inherited(groups, children, "grp", ["gc", "na"], "cp")
    assert sorted(map(tuple, got.select("cp", "gc", "na").collect())) == [(65, "Lu", "X-0041"), (66, "Ll", "own")]


def test_tensor_files_are_deterministic():
    t = {"b": np.arange(6.0).reshape(2, 3), "a": np.array([1, 2], np.int64)}
    data = tensors.encode(t, {"k": "v"})
    assert data == tensors.encode(dict(reversed(t.items())), {"k": "v"}) and (tensors.decode(data)["b"] == t["b"]).all()
    with pytest.raises(ValueError):
        tensors.decode(data + b"\0")


def test_versions_are_pinned_and_swapped(spark, tmp_path):
    v = store.VersionedTable(spark, str(tmp_path / "v"))
    a = v.stage(spark.range(3).toDF("k"))
    assert v.current()["version"] is None
    assert v.activate(a, 0) == 1
    pinned = v.read()
    b = v.stage(spark.range(5).toDF("k"))
    with pytest.raises(store.StaleEpoch):
        v.activate(b, 0)
    assert v.activate(b, 1) == 2 and v.read().count() == 5 and pinned.count() == 3
    assert v.append_missing(spark.range(7).toDF("k"), ["k"]) == 3 and v.append_missing(spark.range(7).toDF("k"), ["k"]) == 3 and v.read().count() == 7
    c = v.stage(spark.range(1).toDF("k"))
    v.abort(c)
    assert v.read().count() == 7
    # an append writes its own rows only, another writer of the same epoch loses, and old epochs go when told
    assert v.read(2).count() == 5 and len(v.current()["version"]) == 2
    late = v.stage(spark.range(1).toDF("k"))
    v.epoch = lambda: 2  # a writer that hasn't seen epoch 3
    with pytest.raises(store.StaleEpoch):
        v.activate(late, 2)
    del v.epoch
    v.abort(late)
    v.expire()
    assert v.read().count() == 7 and v.epoch() == 3 and len(list((tmp_path / "v").glob("_EPOCH-*"))) == 1


def test_producer_resumes(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    spark.range(4).toDF("k").coalesce(1).write.mode("append").parquet(str(folder))
    source = lambda: canonical.folder_stream(spark, str(folder), spark.range(1).toDF("k").schema)
    sink = lambda batch, number: seen.append((number, batch.count()))
    canonical.run_producer(source(), [sink, canonical.parquet_sink(str(tmp_path / "out"))], str(tmp_path / "c"))
    canonical.run_producer(source(), [sink], str(tmp_path / "c"))
    assert seen == [(0, 4)]
    spark.range(4, 6).toDF("k").coalesce(1).write.mode("append").parquet(str(folder))
    canonical.run_producer(source(), [sink], str(tmp_path / "c"))
    assert seen == [(0, 4), (1, 2)] and spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_watermarked_stream_equals_the_table(spark, tmp_path):
    data = spark.createDataFrame([("2024-01-01 00:05:00", 1), ("2024-01-01 00:55:00", 2), ("2024-01-01 02:10:00", 3), ("2024-01-02 00:00:00", 4)], "ts string, v int").select(F.col("ts").cast("timestamp").alias("ts"), "v")
    data.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = canonical.windowed(canonical.folder_stream(spark, str(tmp_path / "s"), data.schema), "ts", "1 hour", None, "10 minutes", [], "v")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, canonical.windowed(data, "ts", "1 hour", None, "10 minutes", [], "v").collect()))


@pytest.mark.parametrize("text", ["DELETE FROM t", "SELECT 1; SELECT 2", "", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SELECT " + "1," * 40_000 + "1", "DROP TABLE t"])
def test_statements_that_may_not_run(spark, text):
    with pytest.raises(adhoc.Refused):
        adhoc.checked(spark, text)


def test_only_plans_over_registered_views_run(spark):
    spark.range(5).selectExpr("id AS a", "id AS `set`", "id AS `use`").createOrReplaceTempView("numbers")
    for text in (
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT a, reflect('java.lang.System', 'getProperty', 'user.home') FROM numbers", "SELECT * FROM text.`/etc/hostname`", "SELECT try_reflect('java.lang.System', 'exit')",
        "SELECT a FROM numbers WHERE a IN (SELECT value FROM text.`/etc/hostname`)", "WITH x AS (SELECT * FROM parquet.`/tmp/x`) SELECT 1 FROM x", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "SET a = 1", "SHOW TABLES", "EXPLAIN SELECT 1",
        "FROM numbers INSERT INTO x SELECT a", "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM numbers", "CREATE TEMPORARY VIEW y AS SELECT 1", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'DROP TABLE x'", "SELECT * FROM unknown", "SELECT * FROM spark_catalog.default.numbers",
        "SELECT a FROM numbers LATERAL VIEW explode(array(reflect('java.lang.System', 'getProperty', 'x'))) AS b",
    ):
        with pytest.raises(adhoc.Refused):
            adhoc.checked(spark, text)
    for text, n in (
        ("SELECT `set`, `use` FROM numbers", 5), ("WITH x AS (SELECT a FROM numbers WHERE a > 1) SELECT count(*) AS n FROM x JOIN numbers USING (a) GROUP BY a HAVING n > 0 ORDER BY n LIMIT 2", 2), ("VALUES (1), (2)", 2), ("SELECT * FROM range(3)", 3),
        ("SELECT a FROM numbers WHERE a IN (SELECT a + 1 FROM numbers) UNION ALL SELECT 1", 5), ("SELECT a, row_number() OVER (PARTITION BY a % 2 ORDER BY a) AS k FROM numbers", 5), ("SELECT 'drop; delete' AS update", 1), ("SELECT explode(array(1, 2)) AS x", 2),
        ("SELECT n.a FROM numbers n LATERAL VIEW explode(array(1, 2)) e AS x", 10), ("SELECT * FROM (SELECT a, a % 2 AS b FROM numbers) PIVOT (sum(a) FOR b IN (0, 1))", 1), ("SELECT DISTINCT CASE WHEN a > 2 THEN 'x' END FROM numbers EXCEPT SELECT 'y'", 2),
    ):
        assert adhoc.read_only(spark, text).count() == n, text


def test_ad_hoc_results(spark):
    assert adhoc.as_csv(spark, "SELECT 1 AS a, 'x; drop \"q' AS b;") == 'a,b\n"1","x; drop ""q"\n'
    with pytest.raises(adhoc.Refused):
        adhoc.as_csv(spark, "SELECT repeat('x', 100) AS a FROM range(100)", limit=1000)
    with pytest.raises(adhoc.Refused):
        adhoc.collection(spark.range(3), "id", 0)
    assert adhoc.collection(spark.range(3), "id", wanted="2").first()[0] == 2


def test_registry_rejects_whole_batches(spark):
    good = spark.createDataFrame([(65,), (0x10FFFF,)], "position int")
    out, receipt = registry.execute("identity_codepoint_batch", good)
    again = registry.execute("identity_codepoint_batch", good.repartition(3))[1]
    assert out.count() == 2 and receipt.first() == again.first() and receipt.first()["opcode"] == 0x20001
    with pytest.raises(registry.InvalidBatch):
        registry.execute("identity_codepoint_batch", spark.createDataFrame([(65,), (0x110000,)], "position int"))
    with pytest.raises(registry.InvalidBatch):
        registry.execute("nothing", good)


def test_every_operation_is_registered_and_rejects_bad_batches(spark):
    assert set(registry.OPERATIONS) == set(registry.OPCODES) and len(registry.OPCODES) == 14
    nine = [f"{k + 1:064x}" for k in range(9)]
    world = "admission string, occurrences int, claims int, testimony int, receipts array<string>"
    tree = "artifact string, span string, parent string, kind string, role string"
    games = "lane bigint, rating double, deviation double, volatility double, opponent bigint, score double"
    packet = "i bigint, j bigint, a double, b double, c double, w double, evidence bigint"
    cases = {
        "world_admission_close_batch": (world, [("a", 2, 2, 2, nine), ("b", 5, 0, 0, nine)], [("c", 2, 2, 1, nine), ("d", 1, 0, 1, nine), ("e", 2, 2, 2, nine[:8]), ("f", 2, 2, 2, [*nine[:8], "0" * 64]), ("g", 3, 2, 2, nine), ("h", 2, 2, None, nine)]),
        "universal_ast_apply_packet": (tree, [("t", "1", None, "root", "whole"), ("t", "2", "1", "leaf", "part")], [("t", "3", "1", "leaf", None), ("t", "4", "9", "leaf", "part"), ("t", "1", None, "root", "whole"), ("u", "5", "1", "leaf", "part")]),
        "evidence_calculate_standing_batch": (games, [(1, 1500.0, 200.0, 0.06, 2, 1.0), (2, 1400.0, 30.0, 0.06, 1, 0.0)], [(3, 1500.0, 200.0, 0.06, 9, 1.0), (1, 1501.0, 200.0, 0.06, 2, 1.0), (1, 1500.0, 200.0, 0.06, 2, 0.7)]),
        "cognition_solve_packet": (packet, [(0, 1, 1.0, -1.0, 2.0, 1.0, 1), (1, 2, 1.0, -1.0, 1.0, 1.0, 2)], [(0, 1, 1.0, None, 2.0, 1.0, 3), (0, 1, 1.0, -1.0, 2.0, 0.0, 4)]),
        "highway_registry_materialize_batch": ("registry string", [("direction",), ("scope_kind",)], [("unheard_of",), (None,)]),
    }
    for name, (schema, good, bad) in cases.items():
        out, receipt = registry.execute(name, spark.createDataFrame(good, schema))
        sealed, again = receipt.first(), registry.execute(name, spark.createDataFrame(good[::-1], schema))[1].first()
        assert out.count() == sealed["rows_out"] > 0 and sealed["receipt_id"] and sealed["opcode"] == registry.OPCODES[name] and sealed["input"] == again["input"]
        for row in bad:
            with pytest.raises(registry.InvalidBatch):
                registry.execute(name, spark.createDataFrame([*good, row], schema))
    rated = {r["lane"]: r["rating"] for r in registry.execute("evidence_calculate_standing_batch", spark.createDataFrame(cases["evidence_calculate_standing_batch"][1], games))[0].collect()}
    assert rated[1] > 1500 > 1400 > rated[2]
