"""The pipeline against a version that applies each stage plainly to rows in memory."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import quality_qda, secret_scan
from tesserae.llm.language_mixture import LEAST_SHARE, infer, learn
from tesserae.llm.queries import queries, remainder

from .test_llm import EXTRA, check_sequences, plain_components, plain_spans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, as the pipeline makes them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # rows that no stage may stumble over
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, None, None, None)], docs.schema)
    # a row that repeats, a text under the id of another one, and a copy of a document under the id of one that stays
    first, second, third = (r.asDict() for r in docs.filter("length(text) > 300 and lang = 'en'").orderBy("doc_id").limit(3).collect())
    twice = [first, {**first, "doc_id": -10, "text": first["text"]}, {**second, "doc_id": third["doc_id"]}]
    docs = docs.unionByName(odd).unionByName(spark.createDataFrame(twice, docs.schema))
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], SMALL).persist()))
    return dict(out)


def test_columns_stay(stages):
    want = stages["documents"].dtypes
    assert all(stages[n].dtypes == want for n in ("quality", "language", "near_duplicates", "secrets"))


def test_quality_keeps_what_scores_well(spark, stages):
    docs = stages["documents"]
    vectors = quality_qda.features(docs)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = quality_qda.score(vectors, quality_qda.fit(vectors.filter(remainder(4) != 2), labels))
    want = collections.Counter(r[0] for r in scored.filter("predicted = 1").collect())
    assert collections.Counter(r["doc_id"] for r in stages["quality"].collect()) == want
    judged = docs.join(labels, "doc_id")
    good = {r["doc_id"] for r in judged.filter("quality = 1").collect()}
    assert len(good & set(want)) >= 0.97 * len(good)


def test_language_keeps_documents_with_letters(stages):
    model = learn(stages["quality"].filter(remainder(5) != 0))
    rows = stages["quality"].collect()
    shares, has = infer(model, [r["text"] or "" for r in rows])
    want = sorted(str(r["doc_id"]) for r, s, h in zip(rows, shares, has, strict=True) if h and s.max() >= LEAST_SHARE)
    assert sorted(str(r["doc_id"]) for r in stages["language"].collect()) == want


def test_one_of_each_group_stays(stages):
    rows = sorted({(r["doc_id"], r["text"]) for r in stages["language"].collect() if r["doc_id"] is not None})
    groups = collections.defaultdict(list)
    for (i, text), (_, _, group) in zip(rows, plain_components([(k, t) for k, (_, t) in enumerate(rows)]), strict=True):
        groups[group].append((i, hashlib.sha256(text.encode()).digest(), text))
    want = sorted(min(members)[::2] for members in groups.values())
    assert sorted((r["doc_id"], r["text"]) for r in stages["near_duplicates"].collect()) == want


def test_secrets_go(stages):
    want = collections.Counter()
    for r in stages["near_duplicates"].collect():
        text, at = "", 0
        for start, kind, end in plain_spans(r["text"]):
            if start >= at:
                text += r["text"][at:start] + f"[{secret_scan.RULES[kind].kind}]"
            at = max(at, end)
        text += r["text"][at:]
        want[r["doc_id"], text, len(text)] += 1
    assert collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in stages["secrets"].collect()) == want


def test_packing_covers_the_rest(stages):
    pieces = stages["packing"].collect()
    check_sequences(pieces)
    total, tokens = collections.Counter(), collections.Counter()
    for p in pieces:
        total[p["doc_id"]] += p["length"]
        tokens[p["doc_id"]] += p["doc_tokens"] * (p["start"] == 0)
    assert total == tokens
    assert collections.Counter(p["doc_id"] for p in pieces if p["start"] == 0) == collections.Counter(r["doc_id"] for r in stages["secrets"].collect())


def test_empty_tables_pass_all_stages(spark, stages):
    docs = stages["documents"].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0, name


def test_run_leaves_its_result_only(spark):
    from tesserae.llm import shared

    mark = shared.folders_made()
    out = corpus_pipeline.run(spark, SMALL)
    assert shared.folders_made() == mark + 1 and out.count() > 0


def test_registered_queries_run_on_the_small_tables(spark):
    for name, query in queries().items():
        df = query(spark, SMALL)
        assert df.agg(F.count("*")).first()[0] > 0, name


def test_clashing_columns_pass_all_stages(spark):
    names = [*EXTRA, "gone", "label_of", "quality", "lang_pred", "keep_1", "found_id"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 40").select("*", *[F.lit(7).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns[5:] == names and {tuple(r)[5:] for r in docs.collect()} == {(7,) * len(names)}, name
    assert corpus_pipeline.pack(spark, docs, SMALL).count() > 0
