"""Each stage of the pipeline on its own input against brute force."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in p.STAGES:
        got = p.materialize(f(spark, docs, SF), "test-stage")
        out.append((docs, got))
        docs = got
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for docs, got in stages[:-1]:
        assert got.columns == p.COLUMNS and dict(got.dtypes) == dict(docs.select(p.COLUMNS).dtypes)
        assert got.join(docs, p.COLUMNS, "left_anti").count() == 0


def test_quality_keeps_what_labels_keep(spark, stages):
    docs, got = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(docs, "doc_id")
    kept = set(ids(got))
    right = [(r.doc_id in kept) == (r.quality == 1) for r in labels.collect()]
    assert sum(right) / len(right) > 0.97


def test_one_document_of_each_component(stages):
    from tests.llm.test_simhash import brute_fingerprint, brute_groups

    docs, got = stages[1]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    groups = brute_groups([brute_fingerprint(t) for _, t in rows])
    assert ids(got) == sorted(rows[g][0] for g in set(groups))


def test_contaminated_documents_go(spark, stages):
    from tests.llm.test_decontaminate import brute

    docs, got = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(got) == sorted(r[0] for r in brute([(d.doc_id, d.text) for d in docs.collect()], items) if not r[5])


def test_the_mix_follows_its_targets(stages):
    from tests.llm.test_mixing import brute

    docs, got = stages[3]
    want = [r for r in brute([(d.doc_id, d.text, d.source) for d in docs.collect()]) if r[4] > 0]
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.collect()) == sorted(want)


def test_run_equals_its_stages(spark, stages):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(p.run(spark, SF)) == rows(stages[-1][1])


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, row long, key string, digest string"
    more = (0.5, 1, 2, "k", "d")  # columns with names that the operators use
    long = " ".join(f"Word{i % 977}" for i in range(60_000)) + "."
    odd = [(None, None, None, None, None), (1, "", None, "a", 0), (1, "", None, "a", 0), (2, long, "en", None, 5), (2, long, "en", None, 5), (None, "y z", None, "b", 3)]
    odd = spark.createDataFrame([(*o, *more) for o in odd], schema)
    for docs in (odd, odd.where(F.lit(False))):
        for name, f in p.STAGES[:-1]:
            got = p.materialize(f(spark, docs, SF), "test-stage")
            assert got.columns == p.COLUMNS and got.count() <= docs.count(), name
            assert got.count() or docs.isEmpty() or name == "quality"
        p.mixing(spark, docs, SF).collect()
    assert p.near_duplicates(spark, odd, SF).where("doc_id = 2").count() == 1


def test_the_mix_places_every_copy(spark):
    docs = [(i, "a b", None, "a", 3) for i in range(4)] + [(i, "w " * 10, None, "hot", 20) for i in range(10, 110)]
    got = p.mixing(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert sorted(x for r in got.where("source = 'a'").collect() for x in r.positions) == [round(k / 12, 9) for k in range(12)]
