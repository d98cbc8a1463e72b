"""Queries for admission, semantic neighbourhoods, compositions, receipts of operations and small projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import ident, scalars
from tesserae.operators import admission, closure, relations, search, semantic, standing, syntax
from tesserae.plans import registry
from tesserae.plans.catalog import registered, table
from tesserae.sources import bundle


def _id_sql(domain: str, *columns: str) -> str:
    """The SQL of ``ident.record_id``."""
    parts = "".join(f" || coalesce(CAST({c} AS VARCHAR), chr(0)) || chr(31)" for c in columns)
    return f"substr(sha256('{domain}' || chr(31){parts}), 1, 32)"


def _sum_sql(i: str) -> str:
    """The SQL of ``ident.set_fingerprint``."""
    part = lambda at, size: f"sum(CAST('0x' || substr({i}, {at}, {size}) AS HUGEINT))"
    return f"sha256(concat_ws(':', count({i}), {part(1, 15)}, {part(16, 15)}, {part(31, 2)}))"


# --- compositions ---------------------------------------------------------------------------------------------------


def _composed_sql(rows: str, group: str, child: str, order: str) -> str:
    joined = f"substr(sha256('01' || string_agg({child}, '' ORDER BY {order})), 1, 32)"
    return f"SELECT {group}, CASE WHEN count(*) = 1 THEN min({child}) ELSE {joined} END AS id FROM {rows} GROUP BY {group}"


@registered(f"""
WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL), w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM t),
a AS (SELECT conv_id, turn, k, substr(sha256(w), 1, 32) AS a FROM w), b AS ({_composed_sql("a", "conv_id, turn", "a", "k")}), c AS ({_composed_sql("b", "conv_id", "id", "turn")})
SELECT 't/' || conv_id || '/' || turn AS request, id, 0 AS level FROM b UNION ALL SELECT 'c/' || conv_id, id, 1 FROM c""")
def composition_ids(spark: SparkSession, d: str) -> DataFrame:
    """Conversations composed of turns, which are composed of words; turns are prior results of the conversations."""
    turns = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    turn = F.concat_ws("/", F.lit("t"), "conv_id", "turn")
    empty = F.lit(None).cast("string")
    inner = turns.select(turn.alias("request"), F.posexplode(F.transform(F.split("text", " "), ident.content_id)).alias("ordinal", "entity")).withColumn("prior", empty)
    outer = turns.select(F.concat_ws("/", F.lit("c"), "conv_id").alias("request"), F.col("turn").cast("int").alias("ordinal"), empty.alias("entity"), turn.alias("prior"))
    return closure.compositions(inner.unionByName(outer))


_FIELDS = ("s_name", "s_nationkey")


@registered(f"""
WITH f AS (SELECT s_suppkey, 1 AS k, substr(sha256('01' || substr(sha256('s_name'), 1, 32) || substr(sha256(s_name), 1, 32)), 1, 32) AS f FROM supplier
 UNION ALL SELECT s_suppkey, 2, substr(sha256('01' || substr(sha256('s_nationkey'), 1, 32) || substr(sha256(CAST(s_nationkey AS VARCHAR)), 1, 32)), 1, 32) FROM supplier)
{_composed_sql("f", "s_suppkey", "f", "k")}""")
def reflected_records(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' records themselves as compositions of their fields."""
    return admission.reflected(table(spark, d, "supplier"), "s_suppkey", list(_FIELDS))


@registered("""
WITH RECURSIVE e AS (SELECT p_partkey AS parent, p_partkey // 2 AS child FROM part WHERE p_partkey >= 2), r AS (SELECT p_partkey AS state, 0 AS depth FROM part WHERE p_size = 50 UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.state WHERE r.depth < 40)
SELECT state, min(depth) AS depth FROM r GROUP BY state""")
def reference_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that the parts of one size need, directly or by what they need, at the least depth."""
    parts = table(spark, d, "part")
    edges = parts.filter("p_partkey >= 2").select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 2").alias("target"))
    return search.reach(edges, parts.filter("p_size = 50").select(F.col("p_partkey").alias("state")), 40)


@registered("SELECT l_orderkey AS path, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS roots, CAST(count(*) AS INTEGER) AS steps FROM lineitem GROUP BY l_orderkey")
def path_root_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as paths of lines: how many distinct roots of evidence each one rests on."""
    paths = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("ordinal"), F.col("l_suppkey").alias("root"))).alias("steps"))
    return paths.select("path", search.path_roots(F.col("steps")).alias("roots"), F.size("steps").alias("steps"))


# --- admission ------------------------------------------------------------------------------------------------------

_WORDS = "list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: substr(sha256(w), 1, 32))"


def _admitted_sql(rows: str, key: str) -> str:
    return f"""w AS (SELECT {key}, text, {_WORDS} AS w FROM {rows} WHERE text IS NOT NULL), i AS (SELECT {key}, sha256(text) AS witness, CAST(len(w) AS INTEGER) AS pieces, CASE WHEN len(w) = 1 THEN w[1] ELSE substr(sha256('01' || array_to_string(w, '')), 1, 32) END AS id FROM w WHERE len(w) > 0),
k AS (SELECT {key}, i.id, pieces, CASE WHEN s.id IS NULL THEN 0 WHEN s.witness = i.witness THEN 1 ELSE 2 END AS class FROM i LEFT JOIN s ON s.id = i.id)"""


_STORED = f"s AS (SELECT id, min(witness) AS witness FROM (SELECT sha256(text) AS witness, CASE WHEN len(w) = 1 THEN w[1] ELSE substr(sha256('01' || array_to_string(w, '')), 1, 32) END AS id FROM (SELECT text, {_WORDS} AS w FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) WHERE len(w) > 0) GROUP BY id)"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """What is stored already: a third of the documents."""
    docs = table(spark, d, "documents").filter("doc_id % 3 = 0")
    return admission.composed(docs, F.col("text")).groupBy("id").agg(F.min("witness").alias("witness"))


@registered("WITH " + _STORED + ", " + _admitted_sql("documents", "doc_id") + " SELECT doc_id, id, pieces, class FROM k")
def admitted_content(spark: SparkSession, d: str) -> DataFrame:
    """Documents decomposed, composed and told novel, exact or in conflict with what is stored."""
    return admission.admitted_content(table(spark, d, "documents"), "doc_id", F.col("text"), _stored(spark, d))


@registered("WITH p AS (SELECT conv_id * 1000 + turn AS prompt, text FROM conversations WHERE role = 'user'), " + _STORED + ", " + _admitted_sql("p", "prompt") + " SELECT prompt, id AS entity, 0 AS attestations FROM k")
def admitted_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Users' turns admitted as prompts: ordinary content and occurrences, which attest nothing."""
    prompts = table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt"), "text")
    return admission.admitted_prompt(prompts, "prompt", F.col("text"), _stored(spark, d))[1]


_CLAIM = _id_sql("claim", "c_custkey", "c_nationkey", "c_mktsegment")
_COLUMNS = ["c_custkey", "c_nationkey", "c_mktsegment"]
_CUSTOMER, _NATION, _SEGMENT = admission.Reference("c_custkey", "customer", 3), admission.Reference("c_nationkey", "nation", 1), admission.Reference("c_mktsegment", "segment", 5)


@registered(f"""
WITH c AS (SELECT *, {_CLAIM} AS claim FROM customer) SELECT claim, 'customer' AS namespace, CAST(c_custkey AS VARCHAR) AS local_id, 3 AS rule_flags FROM c UNION ALL SELECT claim, 'nation', CAST(c_nationkey AS VARCHAR), 1 FROM c UNION ALL SELECT claim, 'segment', c_mktsegment, 5 FROM c WHERE c_mktsegment <> ''""")
def tabular_claims(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records: a claim each, and the references that its columns hold by rule."""
    claimed = admission.claims(table(spark, d, "customer"), _COLUMNS)
    return admission.reference_occurrences(claimed, [_CUSTOMER, _NATION, _SEGMENT])


_LEFT, _MIDDLE, _RIGHT = _id_sql("reference", "'customer'", "c_custkey"), _id_sql("reference", "'nation'", "c_nationkey"), _id_sql("reference", "'segment'", "c_mktsegment")


@registered(f"""
WITH c AS (SELECT {_CLAIM} AS claim, {_LEFT} AS a, {_MIDDLE} AS b, {_RIGHT} AS s, c_mktsegment FROM customer) SELECT claim, 'lives_in' AS relation, a AS left_id, b AS right_id, false AS symmetric FROM c
UNION ALL SELECT claim, 'goes_with', least(b, s), greatest(b, s), true FROM c WHERE c_mktsegment <> ''""")
def mapping_occurrences(spark: SparkSession, d: str) -> DataFrame:
    claimed = admission.claims(table(spark, d, "customer"), _COLUMNS)
    return admission.mapping_occurrences(claimed, [admission.Mapping(_CUSTOMER, _NATION, "lives_in"), admission.Mapping(_NATION, _SEGMENT, "goes_with", True)])


# --- the semantic neighbourhood -------------------------------------------------------------------------------------

_SEMANTIC = """
o AS (SELECT l_orderkey * 8 + l_linenumber AS occurrence, l_suppkey AS profile, l_orderkey AS row, l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b, l_partkey * 100000 + l_suppkey AS proposition, l_linenumber AS relation, l_linenumber % 2 = 0 AS both_ways FROM lineitem WHERE l_returnflag <> 'R'),
x AS (SELECT a AS source, b AS target, CASE WHEN both_ways THEN 3 ELSE 1 END AS direction, * FROM o), t AS (SELECT DISTINCT l_suppkey AS profile, l_orderkey AS row, (l_suppkey + l_orderkey) % 3 AS n FROM lineitem WHERE l_quantity > 10),
j AS (SELECT x.*, t.n, o_custkey AS root FROM x JOIN t ON t.profile = x.profile AND t.row = x.row JOIN orders ON o_orderkey = x.row WHERE o_orderstatus <> 'P'),
e AS (SELECT source, target, proposition, root, min(occurrence) AS occurrence, arg_min(relation, occurrence) AS relation, arg_min(direction, occurrence) AS direction, arg_min(n, occurrence) AS n FROM j GROUP BY ALL),
s AS (SELECT user_id AS lane, arg_max(cents, (ts, -event_id)) AS cents FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) GROUP BY user_id),
c AS (SELECT source, target, occurrence, relation, direction, 2 AS plane, n, CAST(NULL AS BIGINT) AS lane, CAST(NULL AS BIGINT) AS cents FROM e
 UNION ALL SELECT DISTINCT source, target, occurrence, relation, direction, 16, NULL, s.lane, s.cents FROM e JOIN s ON s.lane = e.root)"""


@registered("WITH " + _SEMANTIC + """
SELECT source, direction, plane, count(*) AS candidates, count(DISTINCT target) AS targets, CAST(coalesce(sum(n), 0) AS BIGINT) AS uncertain, count(lane) AS lanes, CAST(coalesce(sum(cents), 0) AS BIGINT) AS rating, CAST(sum(occurrence % 1000003) AS BIGINT) AS witnesses FROM c GROUP BY ALL""")
def semantic_frontier(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers' evidenced neighbours among parts, with the testimony and the current standings behind them.

    Lines are mapping occurrences, suppliers profiles, orders rows, nodes and evidence, customers roots and lanes, events
    successive states of lanes.  Returned lines aren't resolved, small lines attest nothing, pending orders aren't admitted.
    """
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    occurrences = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("occurrence"), F.lit(1).alias("boundary"), F.col("l_suppkey").alias("profile"), F.col("l_orderkey").alias("row"), (F.col("l_suppkey") * 2).alias("left_id"), (F.col("l_partkey") * 2 + 1).alias("right_id"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("proposition"), F.col("l_linenumber").alias("relation"), (F.col("l_linenumber") % 2 == 0).alias("symmetric"), F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("disposition"),
    )
    said = lines.filter("l_quantity > 10").select(F.col("l_suppkey").alias("profile"), F.col("l_orderkey").alias("node")).distinct()
    testimony = said.select(ident.record_id("testimony", F.col("profile"), F.col("node")).alias("testimony"), "profile", "node", ((F.col("profile") + F.col("node")) % 3).alias("uncertainty_numerator"), F.lit(3).alias("uncertainty_denominator"))
    nodes, roots = orders.select(F.col("o_orderkey").alias("node"), F.col("o_orderkey").alias("row")), orders.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("root"))
    members = testimony.select(F.lit(1).alias("boundary"), "profile", "node", "testimony").join(orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("root")), "node")
    events = table(spark, d, "events")
    states = events.select(F.col("user_id").alias("lane"), F.col("ts").alias("period"), F.col("event_id").alias("state"), F.round(F.col("value") * 100).alias("rating"))
    frontier = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("id"))
    edges = closure.written(semantic.evidenced_edges(frontier, occurrences, testimony, nodes, roots, members, 1))
    matches = edges.select("root").distinct().select("root", F.col("root").alias("lane"))
    found = semantic.semantic_expand(edges, matches, states)
    sums = [F.count("*").alias("candidates"), F.countDistinct("target").alias("targets"), F.coalesce(F.sum("uncertainty_numerator"), F.lit(0)).cast("bigint").alias("uncertain"), F.count("lane").alias("lanes"), F.coalesce(F.sum(F.col("rating").cast("bigint")), F.lit(0)).alias("rating"), F.sum(F.col("occurrence") % 1000003).alias("witnesses")]
    return found.groupBy("source", "direction", "plane").agg(*sums)


# --- receipts of operations -----------------------------------------------------------------------------------------

_RECEIPTS = "list_transform(range(9), lambda k: sha256('r' || k || ':' || c_custkey))"
#: Per operation: the SQL of its input and of its output, and their columns in the order of their names.
_OPERATIONS = {
    "world_admission_close_batch": (
        f"SELECT 'w' || c_custkey AS admission, c_nationkey AS claims, c_nationkey AS occurrences, '[\"' || array_to_string({_RECEIPTS}, '\",\"') || '\"]' AS receipts, array_to_string({_RECEIPTS}, ':') AS joined, c_nationkey AS testimony FROM customer", ["admission", "claims", "occurrences", "receipts", "testimony"],
        f"SELECT admission, claims, occurrences, {_id_sql('world', 'admission', 'occurrences', 'claims', 'testimony', 'joined')} AS receipt FROM b", ["admission", "claims", "occurrences", "receipt"],
    ),
    "universal_ast_apply_packet": (
        "SELECT 'world' AS artifact, 'nation' AS kind, 'r' || n_regionkey AS parent, 'leaf' AS role, 'n' || n_nationkey AS span FROM nation UNION ALL SELECT 'world', 'region', NULL, 'branch', 'r' || r_regionkey FROM region", ["artifact", "kind", "parent", "role", "span"],
        f"SELECT artifact, {_id_sql('binding', 'artifact', 'span', 'parent', 'kind', 'role')} AS binding, role, span FROM b", ["artifact", "binding", "role", "span"],
    ),
    "evidence_record_lineage_batch": (
        "SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation", ["child", "parent"],
        "SELECT 1 AS depth, child AS node, parent AS root FROM b UNION ALL SELECT DISTINCT 0, parent, parent FROM b", ["depth", "node", "root"],
    ),
    "reference_mapping_resolve_batch": (
        "SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS \"left\", CASE WHEN l_suppkey % 9 = 0 THEN 2 WHEN l_suppkey % 4 = 0 THEN 6 ELSE 1 END AS left_disposition, l_partkey AS \"right\", CASE WHEN l_partkey % 7 = 0 THEN 2 WHEN l_partkey % 5 = 0 THEN 6 ELSE 1 END AS right_disposition FROM lineitem",
        ["id", '"left"', "left_disposition", '"right"', "right_disposition"],
        'SELECT CASE WHEN left_disposition = 2 OR right_disposition = 2 THEN 5 WHEN left_disposition = 6 AND right_disposition = 6 THEN 4 WHEN left_disposition = 6 THEN 2 WHEN right_disposition = 6 THEN 3 ELSE 1 END AS disposition, * FROM b', ["disposition", "id", '"left"', "left_disposition", '"right"', "right_disposition"],
    ),
}


def _receipt_sql(name: str) -> str:
    given, inside, made, outside = _OPERATIONS[name]
    rows = lambda source, columns: f"SELECT count(*) AS n, {_sum_sql('i')} AS digest FROM (SELECT {_id_sql('row', *columns)} AS i FROM ({source}))"
    both = f"(WITH b AS ({given}), x AS ({rows('SELECT * FROM b', inside)}), y AS ({rows(made, outside)}) SELECT '{name}' AS operation, {registry.OPCODES[name]} AS opcode, x.n AS rows_in, x.digest AS input, y.n AS rows_out, y.digest AS output FROM x, y)"
    return f"SELECT *, {_id_sql('receipt', 'operation', 'input', 'output')} AS receipt_id FROM {both}"


@registered(" UNION ALL ".join(map(_receipt_sql, _OPERATIONS)))
def operation_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of executed operations, digests of their inputs and outputs included."""
    customers, lines = table(spark, d, "customer"), table(spark, d, "lineitem")
    receipts = F.array(*[F.sha2(F.concat(F.lit(f"r{k}:"), F.col("c_custkey").cast("string")), 256) for k in range(registry.RECEIPTS)])
    key = lambda c, retired, open_: F.when(F.col(c) % retired == 0, 2).when(F.col(c) % open_ == 0, 6).otherwise(1)
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    tree = nations.select(F.lit("world").alias("artifact"), name("n", "n_nationkey").alias("span"), name("r", "n_regionkey").alias("parent"), F.lit("nation").alias("kind"), F.lit("leaf").alias("role"))
    tree = tree.unionByName(regions.select(F.lit("world").alias("artifact"), name("r", "r_regionkey").alias("span"), F.lit(None).cast("string").alias("parent"), F.lit("region").alias("kind"), F.lit("branch").alias("role")))
    batches = {
        "world_admission_close_batch": customers.select(name("w", "c_custkey").alias("admission"), *[F.col("c_nationkey").alias(c) for c in ("occurrences", "claims", "testimony")], receipts.alias("receipts")),
        "universal_ast_apply_packet": tree,
        "evidence_record_lineage_batch": nations.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")),
        "reference_mapping_resolve_batch": lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("left"), key("l_suppkey", 9, 4).alias("left_disposition"), F.col("l_partkey").alias("right"), key("l_partkey", 7, 5).alias("right_disposition")),
    }
    return reduce(DataFrame.unionByName, [registry.execute(op, batch)[1] for op, batch in batches.items()])


# --- small projections ----------------------------------------------------------------------------------------------


@registered(f"SELECT c_custkey, {_id_sql('world_semantics', 'c_custkey', 'c_nationkey', 'c_mktsegment')} AS semantics FROM customer")
def admission_semantics(spark: SparkSession, d: str) -> DataFrame:
    """What an admission means: its identity without the receipts of how it came about (here balance and name)."""
    return table(spark, d, "customer").select("c_custkey", ident.record_id("world_semantics", *map(F.col, _COLUMNS)).alias("semantics"))


@registered("SELECT c AS letter, lower(hex(c)) AS octets, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL")
def encoded_points(spark: SparkSession, d: str) -> DataFrame:
    """Every character of the documents, its encoded octets, and how often it occurs."""
    letters = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    return letters.select("letter", F.lower(F.hex(F.encode("letter", "UTF-8"))).alias("octets"), "n")


@registered("SELECT CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) & 63 AS part, CAST('0x' || substr(sha256(text), 31, 2) AS INTEGER) AS last, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def write_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the partition that their ids are written to, and by their ids' last octet."""
    ids = table(spark, d, "documents").filter("text is not null").select(ident.content_id(F.col("text")).alias("id"))
    return ids.groupBy(scalars.write_partition(F.col("id")).alias("part"), scalars.byte_at(F.col("id"), 15).alias("last")).agg(F.count("*").alias("n"))


@registered("SELECT c_custkey AS lane, 1500.0::DOUBLE AS rating, 350.0::DOUBLE AS deviation, 0.06::DOUBLE AS volatility FROM customer")
def onboarded_lanes(spark: SparkSession, d: str) -> DataFrame:
    return standing.onboard(table(spark, d, "customer").select(F.col("c_custkey").alias("lane")))


@registered("SELECT DISTINCT k AS node FROM (SELECT CAST(l_suppkey + 3 AS BIGINT) AS k FROM lineitem UNION ALL SELECT CAST(s_suppkey AS BIGINT) FROM supplier) WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that shifted lines name and that aren't there."""
    known = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("node"))
    edges = table(spark, d, "lineitem").select((F.col("l_suppkey") + 3).cast("bigint").alias("child"), F.lit(None).cast("bigint").alias("parent")).unionByName(known.select(F.col("node").alias("child"), F.col("node").alias("parent")))
    return closure.dangling(known, edges).filter("node is not null")


@registered("SELECT page_id, octet_length(encode(html)) AS octets, sha256(html) AS digest FROM pages WHERE html <> ''")
def recomposed_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Pages cut into spans of 100 characters and put together again, whatever the order of the spans."""
    pages = table(spark, d, "pages").filter("html <> ''").select(F.col("page_id").alias("artifact"), "html")
    starts = F.sequence(F.lit(0), F.length("html") - 1, F.lit(100))
    spans = pages.select("artifact", "html", F.explode(starts).alias("start")).select("artifact", "start", F.encode(F.substring("html", F.col("start") + 1, F.lit(100)), "UTF-8").alias("content"))
    whole = bundle.recomposed(spans)
    return whole.select(F.col("artifact").alias("page_id"), F.octet_length("content").cast("bigint").alias("octets"), F.sha2("content", 256).alias("digest"))


@registered("SELECT 'exhausted' AS state, 0 AS published FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'complete', (SELECT count(*) FROM nation) FROM region WHERE r_regionkey = 0")
def bounded_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Two bounded fetches: one over its limit, which publishes nothing, and one within it."""
    rows = []
    for name, limit in (("customer", 10), ("nation", 1000)):
        found, state = relations.bounded(table(spark, d, name), limit)
        rows.append(found.agg(F.count("*").alias("published")).select(F.lit(state).alias("state"), "published"))
    return rows[0].unionByName(rows[1])


@registered("SELECT count(DISTINCT c_mktsegment) + 1 AS nodes, count(DISTINCT c_mktsegment) AS edges FROM customer")
def closed_evidence(spark: SparkSession, d: str) -> DataFrame:
    """One root of a source, a node of testimony for each distinct claim, and an edge to each."""
    nodes, edges = syntax.closed_evidence(table(spark, d, "customer").select(F.col("c_mktsegment").alias("claim")), "customers")
    return nodes.agg(F.count("*").alias("nodes")).withColumn("one", F.lit(1)).join(edges.agg(F.count("*").alias("edges")).withColumn("one", F.lit(1)), "one").drop("one")
