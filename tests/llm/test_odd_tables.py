"""Every operator on null, shared and repeated ids, null, blank and very long texts, ties, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from namelens.llm import chat_format, cotraining, fingerprints, licenses, ngram_join, packing, quality_rules, source_mixing, substring_dedup, toxicity
from namelens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 9000}" for i in range(30_000))
TIE = " ".join(f"t{i}" for i in range(40))
ROWS = [
    (None, "null id one " + TIE, "en", "a", 1), (None, "null id two", None, None, None), (1, TIE, "en", "a", 1), (1, "shared id, other text", "de", "b", 2),
    (2, TIE, "en", "a", 1), (2, TIE, "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", None, 0), (5, " \n\t ", None, "b", 4), (6, LONG, "en", "c", len(LONG)),
    (7, "x", "en", "c", 1), ((1 << 63) - 1, "far " + TIE, "en", "c", 1), (-(1 << 63) + 1, "é ЖЖ 🙂   a", "en", "c", 1),
]
#: Names that operators use inside.
CLASH = (
    "doc key c n y t m w h g s p token tokens component major left a b anchor content at tag spans span start end row_id block size length sequence sequence_id offset "
    "range first following before last t_h t_p source_no rank bucket shuffled w1 held_out passages score predicted kept base_failed n_words n_removed kept_text units hits ts cands "
    "found notices __h __s __m __k __c __doc __spans __keep0 __row c0 c1 c2 _sum _before view label times pass parts"
).split()
LABELS = [(1, 1, 0), (2, 0, 1), (6, 1, 0), (7, 0, 1), (None, 1, 1), (3, None, None), (4, 1, 0), (5, 0, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    plain = spark.createDataFrame(ROWS, SCHEMA).repartition(2).cache()
    clashing = plain.select("*", *[F.lit("clash").alias(c) for c in CLASH])
    return plain, clashing, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality_rules": lambda d, lab: quality_rules.quality_rules(d, lab).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept"),
    "cotraining": lambda d, lab: cotraining.quality(d, lab).select("doc_id", F.round("score", 6).alias("score")),
    "toxicity": lambda d, lab: toxicity.score(d, toxicity.train(d, lab)).select("doc_id", F.round("score", 6).alias("score")),
    "licenses": lambda d, lab: licenses.scan(d),
    "source_mixing": lambda d, lab: source_mixing.taken_words(d),
    "ngram_join": lambda d, lab: ngram_join.near_duplicates(d),
    "substring_dedup": lambda d, lab: substring_dedup.removed_digests(d),
    "packing": lambda d, lab: packing.pack(d, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "fingerprints": lambda d, lab: fingerprints.edited_fingerprints(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(tables, name):
    """Each row has its result, the same whatever other columns there are; rows alike have results alike; an empty table has none."""
    plain, clashing, labels = tables
    got = sorted(map(repr, OPERATORS[name](plain, labels).collect()))
    again = OPERATORS[name](clashing, labels).collect()
    assert sorted(map(repr, again)) == got
    ids = [r["doc_id"] for r in again if "piece" not in r or r["piece"] == 0]
    assert sorted(map(repr, ids)) == sorted(repr(r[0]) for r in ROWS)
    if name not in ("fingerprints", "packing"):  # a repeated row is its own next document
        two = [r for r in again if r["doc_id"] == 2]
        assert len(two) == 2 and two[0] == two[1]
    assert OPERATORS[name](plain.limit(0), labels).count() == 0


def test_all_null_columns(spark):
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name in ("quality_rules", "cotraining", "toxicity", "licenses", "substring_dedup", "fingerprints", "packing", "source_mixing"):
        out = OPERATORS[name](d, labels).collect()
        assert len(out) == 3 and all(r["doc_id"] is None for r in out), name


def test_odd_conversations(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (1, None, None, None), (1, 1, "assistant", ""), (2, 1, "assistant", LONG), (2, 1, "assistant", LONG), (3, 1, "user", "</s> \\ [INST]"), ((1 << 62) + 1, 1, "user", "far")]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn int, role string, text string, turns string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(d, tokenizer_path())).collect()}
    assert {i: r["n_turns"] for i, r in got.items()} == {None: 2, 1: 2, 2: 2, 3: 1, (1 << 62) + 1: 1}
    assert got[2]["loss_chars"] == 2 * len(LONG) and got[1]["loss_chars"] == 0 and got[3]["loss_chars"] == 0
    assert chat_format.digests(chat_format.format_chats(d.limit(0), tokenizer_path())).count() == 0
