"""The pipeline on a small corpus, each stage against what it should do to its own input."""

import pytest

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, corpus, covered_words, split


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1) for r in corpus()[:60]], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = corpus_pipeline.rules(spark, docs, sf_dir)
    assert kept.columns == names
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert all(len(split(r["text"])) >= 10 for r in rows.values()) and 3 in rows
    one = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    assert one.columns == names
    left = {r["doc_id"] for r in one.collect()}
    assert len(left) == one.count() and left < set(rows)
    texts = {}
    for i in sorted(rows):
        texts.setdefault(rows[i]["text"], i)
    assert set(rows) - left >= set(rows) - set(texts.values())  # of equal texts the first stays
    cut = corpus_pipeline.repeats(spark, one, sf_dir)
    assert cut.columns == names
    gone = covered_words([(i, rows[i]["text"]) for i in left])
    got = {r["doc_id"]: r for r in cut.collect()}
    for i in left:
        w = split(rows[i]["text"])
        assert split(got[i]["text"]) == [x for k, x in enumerate(w) if k not in gone[i]] and got[i]["n_chars"] == len(got[i]["text"])
    mixed = corpus_pipeline.mixing(spark, cut, sf_dir)
    assert mixed.columns == names and {r["doc_id"] for r in mixed.collect()} <= left


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    fill = out.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 2048 for r in fill)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram join", "substring dedup", "source mixing", "best-fit packing"]
