"""Near-duplicate detection by b-bit MinHash, with every link confirmed on the words of full texts.

1. Each document's distinct word shingles give ``BANDS * ROWS`` minima.  Bands of minima are hashed into bucket keys;
   of each minimum ``BITS`` low bits are kept and packed into 64-bit words.
2. Documents with equal sequences of words form a class; only its representative (least id) goes on, so copies never
   meet.
3. In every bucket the members are paired with one pivot, drawn by a hash of bucket and member.  Pairs whose
   similarity, estimated by bit counts and corrected for chance agreement, can't reach the limit are dropped.  The
   others are confirmed pivot by pivot: a task reads a pivot's text once and streams those of its partners past it,
   and pivots with many partners are salted.  So the pairs grow with the members of buckets, not with their square.
4. Components are formed.  Buckets whose members lie in one component are settled.  From the others, members are
   dropped that by an exact bound can't be linked: a shingle that no other of these documents has is in no
   intersection, which bounds a document's partners in size.  What is left is compared exhaustively inside tasks, in
   pairs of blocks, of which only links leave a task.  Blocks are bounded by documents and by shingles, lie in one
   layer of sizes (a partner is in the same or the next one), and pairs of blocks of one and the same component are
   left out.

So all pairs that share a bucket are either in one component, or found unlinked; a pair of similarity 0.75 misses all
buckets with probability (1 - 0.75 ** ROWS) ** BANDS, 5e-6.  Hashes only propose pairs: links and sizes rest on words.

Texts without words, null ones too, have the empty set: n_shingles 0, linked with nothing, kept.  A null id has a null
component, is linked with nothing and kept.  Rows that repeat share their verdict.  Ties go to the least id.  Texts are
read whole, whatever their length; further columns aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import components
from tesserae.llm.shared import checkpointed, clash_free, small, utf8, whole_text, written
from tesserae.llm.wordgrid import chunks, mix64, shingle_numbers, shingle_values

BANDS, ROWS = 32, 4
BITS = 4
#: Links have at least this many hundredths of Jaccard similarity.
LIMIT = 75
#: Candidates are confirmed down to this estimate: five standard deviations under the limit.
LEAST_ESTIMATE = 0.55
#: Documents, and about how many shingles, in a block of the exhaustive comparison.
BLOCK, BLOCK_SHINGLES = 256, 200_000
#: Partners, and about how many shingles of theirs, that are confirmed with one pivot at a time.
PIVOT_DOCS, PIVOT_SHINGLES = 512, 500_000

_MINIMA = BANDS * ROWS
_FACTOR = mix64(np.arange(1, _MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = mix64(np.arange(1 << 20, (1 << 20) + _MINIMA, dtype=np.uint64))
_WORDS = _MINIMA * BITS // 64


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a non-empty set."""
    out = np.full(_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(out, (np.multiply.outer(_FACTOR, shingles[k : k + 4096]) + _SHIFT[:, None]).min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """Per row of minima, one key for each band; keys of different bands differ."""
    rows = low.reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """Per row of minima, the ``BITS`` low bits of each (after mixing), packed into 64-bit words."""
    bits = (mix64(low) & np.uint64((1 << BITS) - 1)).reshape(len(low), _WORDS, 64 // BITS)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(bits << shifts, axis=2).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) to id, content (digest of the text), n_shingles, class (digest of the words, null without any), bands and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = utf8(batch.column(1))
            for a, b in chunks(texts):
                sets, count = shingle_values(texts[a:b])
                full = [s for s in sets if len(s)]
                low = np.array([minima(s) for s in full], np.uint64).reshape(len(full), _MINIMA)
                at = np.cumsum([0, *(bool(len(s)) for s in sets)]).astype(np.int32)
                lists = lambda x, n: pa.ListArray.from_arrays(pa.array(at * n), pa.array(x.ravel()))  # noqa: B023, E731
                words = [b" ".join(t.lower().split()) for t in texts[a:b]]
                classes = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in words]
                content = [hashlib.sha256(t).digest()[:16] for t in texts[a:b]]
                columns = [batch.column(0).slice(a, b - a), pa.array(content, pa.binary()), pa.array(count), pa.array(classes, pa.binary()), lists(band_keys(low), BANDS), lists(packed_bits(low), _WORDS)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "content", "n_shingles", "class", "bands", "bits"])

    return docs.mapInArrow(run, "id bigint, content binary, n_shingles bigint, class binary, bands array<bigint>, bits array<bigint>")


def content_of(text: Column) -> Column:
    """The digest by which texts are told apart, the same as ``signatures`` gives."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: the share of equal lanes, less what chance alone makes equal."""
    lanes = sum(1 << k for k in range(0, 64, BITS))
    lanes -= (1 << 64) * (lanes >> 63)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        folded = z
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(folded.bitwiseAND(F.lit(lanes)))

    differ = sum((differing(a[k], b[k]) for k in range(_WORDS)), F.lit(0))
    chance = 1 / (1 << BITS)
    return (1 - differ / _MINIMA - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < LIMIT * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= LIMIT * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (pivot, rep, n shingles of rep) whose full sets are similar enough, as u and v; ``texts`` has rep and text."""
    hubs = written(pairs.groupBy("pivot").agg(F.ceil(F.greatest(F.sum("n") / PIVOT_SHINGLES, F.count("*") / PIVOT_DOCS)).cast("int").alias("salts")), "near-dup-pivots")
    salted = pairs.join(hubs, "pivot").select("pivot", F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), "rep")
    first = hubs.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("pivot").alias("rep"))
    # a pivot's text comes before those of its partners
    read = salted.unionByName(first).join(texts, "rep").select("pivot", "salt", "role", "rep", "text").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = b""  # the text of the pivot at hand
        for batch in small(batches, 4):
            texts = [held, *utf8(batch.column(4))]
            sets, at, u, v = shingle_numbers(texts), 0, [], []
            for k, (pivot, role, rep) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True), 1):
                if role == 0:
                    at = k
                elif linked(sets[at], sets[k]):
                    u.append(min(pivot, rep))
                    v.append(max(pivot, rep))
            held = texts[at]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return read.mapInArrow(run, "u bigint, v bigint")


def block_links(reps: np.ndarray, owner: np.ndarray, block: np.ndarray, texts: list[bytes]) -> list[tuple[int, int]]:
    """All links between documents of different ``owner`` (component), inside one block or between two.

    Intersections are counted at once, as products of 0/1 matrices over the shingles that occur twice or more.
    """
    sets = shingle_numbers(texts)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    where = place[column]
    row = np.repeat(np.arange(len(sets)), size)[where >= 0]
    where = where[where >= 0]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    step = 4096
    for k in range(0, len(shared), step):
        a, b = np.searchsorted(where, [k, k + step])
        matrix = np.zeros((len(sets), step), np.float32)
        matrix[row[a:b], where[a:b] - k] = 1
        common += matrix @ matrix.T
    enough = 100 * common >= LIMIT * (size[:, None] + size - common)
    enough &= (owner[:, None] != owner) & (np.arange(len(sets))[:, None] < np.arange(len(sets)))
    if block.min() != block.max():
        enough &= block[:, None] != block
    return [(int(reps[i]), int(reps[j])) for i, j in zip(*np.nonzero(enough), strict=True)]


def _blocks(left: DataFrame) -> DataFrame:
    """``left`` (bucket, rep, n, owner) with layer, name and part of a block.

    An owner with more than a block's worth in a layer has blocks of its own; the others are pooled, owner by owner.
    """
    layered = left.withColumn("layer", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / LIMIT * 1.0001))).cast("int"))
    parts = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK)).cast("int")
    each = layered.groupBy("bucket", "layer", "owner").agg(parts.alias("parts"), F.sum("n").alias("held"), F.count("*").alias("docs"))
    pooled = F.ceil(F.greatest(F.sum("held") / BLOCK_SHINGLES, F.sum("docs") / BLOCK)).cast("int")
    pools = each.filter("parts = 1").groupBy("bucket", "layer").agg(pooled.alias("pooled"))
    placed = layered.join(each.select("bucket", "layer", "owner", "parts"), ["bucket", "layer", "owner"]).join(pools, ["bucket", "layer"], "left")
    own = F.col("parts") > 1
    part = F.when(own, F.pmod(F.xxhash64("rep"), "parts")).otherwise(F.pmod(F.xxhash64("owner"), "pooled")).cast("int")
    return placed.select("bucket", "layer", "rep", "owner", F.when(own, F.col("owner")).alias("of"), part.alias("part"))


def remaining_links(members: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components that share a bucket; ``members`` has bucket, rep and n, ``first`` node, component."""
    owned = members.join(first, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("owner"))

    def mixed(rows: DataFrame) -> DataFrame:
        open_ = rows.groupBy("bucket").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.min("n").alias("least")).filter("low != high")
        # written first: a join whose sides are both plain exchanges can have its hot buckets split
        return rows.join(checkpointed(open_.select("bucket", "least")), "bucket")

    rest = written(mixed(owned), "near-dup-open")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            held = utf8(batch.column(1))
            for a, b in chunks(held):
                sets, _ = shingle_values(held[a:b])
                ids = np.repeat(np.asarray(batch.column(0).slice(a, b - a)), list(map(len, sets)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "shingle"])

    open_texts = texts.join(rest.select("rep").distinct(), "rep", "left_semi")
    singles = open_texts.select("rep", "text").mapInArrow(exploded, "rep bigint, shingle bigint").groupBy("shingle").agg(F.min("rep").alias("only"), F.max("rep").alias("last")).filter("only = last")
    alone = singles.groupBy("only").agg(F.count("*").alias("alone"))
    # an intersection i with a partner of size m has i <= n - alone and 100 * i >= LIMIT * (n + m - i)
    bounded = rest.join(alone, F.col("rep") == F.col("only"), "left").withColumn("most", F.expr(f"({100 + LIMIT} * (n - coalesce(alone, 0))) div {LIMIT} - n"))
    able = checkpointed(bounded.filter(f"100 * most >= {LIMIT} * n and most >= least").select("bucket", "rep", "n", "owner"))
    placed = written(_blocks(mixed(able).drop("least")), "near-dup-blocks")

    block = ["bucket", "layer", "of", "part"]
    blocks = checkpointed(placed.groupBy(*block).agg(F.min("owner").alias("low"), F.max("owner").alias("high")).withColumn("block", F.xxhash64(F.struct("layer", "of", "part"))))
    # a block meets those of its layer that come after it, itself, and those of the next layer
    one = blocks.select("bucket", F.col("layer").alias("met"), F.col("layer").alias("layer_a"), F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    two = blocks.select("bucket", F.explode(F.array("layer", F.col("layer") - 1)).alias("met"), F.col("layer").alias("layer_b"), F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    met = one.join(two, ["bucket", "met"]).filter("(layer_a < layer_b or a <= b) and least(low_a, low_b) != greatest(high_a, high_b)").select("bucket", "a", "b")
    sides = met.select("bucket", "a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).unionByName(met.filter("a != b").select("bucket", "a", "b", F.lit(1).alias("side"), F.col("b").alias("block")))
    keyed = placed.withColumn("block", F.xxhash64(F.struct("layer", "of", "part"))).select("bucket", "block", "rep", "owner").join(sides, ["bucket", "block"]).join(texts, "rep")

    def compare(table: pa.Table) -> pa.Table:
        columns = [np.asarray(table[c]) for c in ("rep", "owner", "side")]
        found = block_links(*columns, utf8(table["text"]))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return keyed.groupBy("bucket", "a", "b").applyInArrow(compare, "u bigint, v bigint").distinct()


def _judged(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, content, n_shingles, component) of every row; the component of a null id is null."""
    named = clash_free(docs, [id_column, text_column]).toDF("id", "text").select(F.col("id").cast("bigint").alias("id"), whole_text().alias("text"))
    signed = written(signatures(named), "near-dup-signatures")
    first = F.min(F.struct("id", "content"))
    classes = signed.filter("class is not null and id is not null").groupBy("class").agg(first.alias("of"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    # an id may be that of several texts, so inside the operator a class has a number of its own
    reps = written(classes.select("class", F.col("of.id").alias("least"), F.col("of.content").alias("content"), "n", "bands", "bits", F.monotonically_increasing_id().alias("rep")), "near-dup-classes")

    rows = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    stars = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min_by("rep", F.xxhash64("bucket", "rep")).alias("pivot")).filter("size > 1")
    # the few keys of buckets with company are written first: a join of plain exchanges can have hot buckets split
    members = written(rows.join(written(stars, "near-dup-stars"), "bucket").select("bucket", "rep", "n", "pivot"), "near-dup-members")

    ends = F.struct(F.least("rep", "pivot").alias("u"), F.greatest("rep", "pivot").alias("v"))
    pairs = members.filter("rep != pivot").groupBy(ends.alias("ends")).agg(F.min(F.struct("pivot", "rep", "n")).alias("p")).select("p.*")
    bits = reps.select("rep", "bits")
    met = pairs.join(bits.toDF("rep", "rep_bits"), "rep").join(bits.toDF("pivot", "pivot_bits"), "pivot")
    likely = checkpointed(met.filter(estimate(F.col("rep_bits"), F.col("pivot_bits")) >= LEAST_ESTIMATE).select("pivot", "rep", "n"))
    wanted = reps.select("rep", "least", "content").join(members.select("rep").distinct(), "rep", "left_semi")
    hashed = named.select("id", content_of(F.col("text")).alias("content"), "text")
    texts = written(hashed.join(wanted, (F.col("id") == F.col("least")) & (hashed["content"] == wanted["content"])).select("rep", "text"), "near-dup-texts")
    links = checkpointed(confirmed(likely, texts))
    settled = components(links)
    more = checkpointed(remaining_links(members, settled, texts))
    joined = components(links.unionByName(more)) if not more.isEmpty() else settled

    # a component goes by its least id
    linked_reps = reps.select("rep", "least").join(joined, F.col("rep") == F.col("node")).select("rep", "component", "least")
    # the few names are written first: a join of plain exchanges can have a hot component split
    names = checkpointed(linked_reps.groupBy("component").agg(F.min("least").alias("name")))
    named_reps = linked_reps.join(names, "component").select(F.col("rep").alias("node"), "name")
    found = reps.select("class", "rep", "least").join(named_reps, F.col("rep") == F.col("node"), "left").select(F.col("class").alias("of_class"), F.coalesce("name", "least").alias("of_component"))
    out = signed.select("id", "content", "n_shingles", "class").join(found, F.col("class") == F.col("of_class"), "left")
    return out.select("id", "content", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("of_component", "id")).alias("component"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, n_shingles, component_id (the least id reachable) and kept, one row per row of ``docs``."""
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return _judged(docs, id_column, text_column).select(F.col("id").alias(id_column), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component stays.

    It is the row of the least id, and of several texts under that id the one with the least digest; of rows that
    repeat both id and text the one whose columns come first as JSON.  Documents are told apart by id and text, so
    that a row isn't taken for another one that shares its id.  Rows with a null id, and every document without words,
    stay.
    """
    judged = written(_judged(docs, id_column, text_column).filter("id is not null"), "near-dup-judged")
    each = judged.groupBy("id", "content").agg(F.first("component").alias("component"), F.first("n_shingles").alias("n"), F.count("*").alias("times"))
    # a component goes by its least id, so rows of that id alone can stay for it: no join by component, which may be hot
    chosen = each.filter("n > 0 and id = component").groupBy(F.col("id").alias("head")).agg(F.min("content").alias("best"))
    kept = (F.col("n") == 0) | (F.col("id") == F.col("component")) & (F.col("content") == F.col("best"))
    fates = each.join(chosen, F.col("id") == F.col("head"), "left").select(F.col("id").alias("_id"), F.col("content").alias("_content"), kept.alias("stays"), "times").filter("not stays or times > 1")
    # hashed: at no size are whole texts sorted, and the plan is the same at every size
    fates = written(fates, "near-dup-fates").hint("shuffle_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_column}`").cast("bigint").alias("_key"), content_of(whole_text(f"`{text_column}`")).alias("_digest"))
    met = rows.join(fates, (F.col("_key") == F.col("_id")) & (F.col("_digest") == F.col("_content")), "left")
    single = met.filter("_id is null").select("row")
    if fates.filter("stays").isEmpty():
        return single.select("row.*")
    repeated = met.filter("stays").groupBy("_id", "_content").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")
