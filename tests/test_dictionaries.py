"""The default dictionaries in full, and what the complete tables find."""

from pyspark.sql import functions as F

from namelens.functions import dims
from namelens.functions import text as t
from namelens.operators import institutions


def test_sizes():
    d = dims.DEFAULT
    assert (len(d.hanzi), sum(len(h) == 1 for h in d.hanzi), len(dims.TRADITIONAL)) == (401, 338, 82)
    assert {o: len(x) for o, x in dims.FOREIGN_SURNAMES.items()} == {"Japanese": 106, "Korean": 29, "European": 198, "Indian": 24}
    assert len(d.foreign_of("Japanese", "European", "Indian")) == 328
    assert [len(x) for x in institutions.KEYWORDS.values()] == [77, 20, 41, 8, 9, 6, 7, 4]


def test_institutions(spark):
    want = {
        "Tsinghua University, Beijing, China": (["beijing", "china", "tsinghua", "tsinghua university"], 0.9),
        "Fudan University, Shanghai": (["fudan", "fudan university", "shanghai"], 0.9),
        "Xiamen University": (["xiamen university"], 0.9),
        "Yunnan": (["yunnan"], 0.7),
        "Unknown University, China": (["china"], 0.65),
        "Oxford": ([], 0.0),
        None: ([], 0.0),
    }
    df = spark.createDataFrame([(x,) for x in want], "a string")
    got = df.select("a", institutions.matched(F.col("a")).alias("m"), institutions.confidence(F.col("a")).alias("c")).collect()
    assert {r["a"]: (r["m"], r["c"]) for r in got} == want


def test_surnames(spark):
    row = spark.range(1).select(
        t.surname_of(F.lit("赫连某")), t.hanzi_of(F.lit("rao")), t.is_surname_pinyin(F.lit("Linghu")), t.surname_origin(F.lit("Mizuno")), t.surname_origin(F.lit("van dijk")),
        t.traditional(F.lit("wan"))["hanzi"], t.traditional(F.lit("Cheung"))["pinyin"], t.is_foreign_surname(F.lit("Kim")),
    ).first()
    assert list(row) == ["赫连", ["饶"], True, "Japanese", "European", "温", "zhang", False]
