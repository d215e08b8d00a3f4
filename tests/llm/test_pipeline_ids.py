"""The pipeline's stages on null and reused ids, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from tests.llm.test_operators import SCHEMA


def words(p, n=40):
    return " ".join(f"{p}{i}" for i in range(n))


def test_null_and_reused_ids_keep_unlike_texts(spark):
    rows = [
        (None, words("a")), (None, words("b")), (None, words("c")), (None, words("c")), (7, words("d")), (7, words("e")), (8, words("a")),
        (9, words("e") + " more"), (None, ""), (None, ""), (3, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    want = [(None, words("a")), (None, words("b")), (None, words("c")), (7, words("d")), (7, words("e")), (None, ""), (None, ""), (3, None)]
    assert got == sorted(want, key=repr)


CLASH = SCHEMA + ", first_id long, key string, row_key string, component_id int, c0 int, c1 int, n_words int, n_removed int, kept_text string, `__doc` string, size int, `a.b` int, range int"


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("clash")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    rows = [(1, words("a")), (2, words("a") + " x"), (3, "own1 own2 " + words("b", 30)), (4, words("b", 30) + " own3 " + words("c", 20)), (None, words("d")), (4, None), (5, "")]
    extra = (7, "k", None, 3, 4, 5, 6, 7, "t", "d", 8, 9, 10)
    return str(d), spark.createDataFrame([(i, t, "en", None if i == 3 else "s", len(t or ""), *extra) for i, t in rows], CLASH), extra


def test_clashing_columns_survive(spark, clashing):
    sf, docs, extra = clashing
    names = docs.columns
    left = {
        "quality rules": {1, 2, 3, 4, None},
        "n-gram join": {1, 3, 4, None, 5},
        "substring dedup": {1, 2, 3, 4, None, 5},
        "source mixing": {1, 2, 3, 4, None},
    }
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = out.collect()
        assert all(tuple(r)[5:] == extra for r in rows), name
        if name != "source mixing":
            assert {r["doc_id"] for r in rows} == left[name], name
        else:
            assert {r["doc_id"] for r in rows} <= left[name] and rows
        if name == "substring dedup":
            texts = {r["text"] for r in rows if r["doc_id"] == 4}
            assert texts == {"own3 " + words("c", 20), None}
    assert corpus_pipeline.packed(spark, docs, sf).count() == 7


def test_empty_tables_stay_empty(spark, clashing):
    sf, docs, _ = clashing
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == docs.columns), name
