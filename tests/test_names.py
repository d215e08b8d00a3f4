"""Names: traced fixtures, edge cases, consensus, lists, files, labels, streams."""

import json

import pytest
from pyspark.sql import functions as F

from namelens.functions import dims, labels, pinyin
from namelens.functions import text as t
from namelens.operators import author_filter, author_lists, institutions, quality, surname_older, surname_v8
from namelens.sources import json_authors
from namelens.streaming.decisions import person_counts


@pytest.mark.parametrize(
    ("token", "want"),
    [("tianxiang", ["tian", "xiang"]), ("bo", ["bo"]), ("tian-xiang", ["tian", "xiang"]), ("xian", ["xian"]), ("fangan", ["fan", "gan"]),
     ("xiaodong", []), ("smith", []), ("savolainen", []), ("123", []), ("", []), (None, []), ("a" * 300, ["a"] * 300)],
)
def test_segmentation(spark, token, want):
    df = spark.createDataFrame([(token,)], "w string")
    assert pinyin.with_syllables(df, s="w").first()["s"] == want


V8 = [
    ("Liu W.", None, None, "family_first", 1.0, "ABBREVIATION: ABBREV_Liu_W."),
    ("Wang A. B.", None, None, "family_first", 1.0, "ABBREVIATION: ABBREV_Wang_+"),
    ("W. Liu", None, None, "given_first", 0.85, "ABBREVIATION: ABBREV_W._Liu_REVERSED"),
    ("", None, None, "unknown", 0.0, "MIXED: INVALID_FORMAT"),
    (None, None, None, "unknown", 0.0, "MIXED: INVALID_FORMAT"),
    ("Liu", None, None, "unknown", 0.0, "MIXED: INVALID_FORMAT"),
    ("Tianxiang Tang", "CROSSREF", None, "given_first", 0.750260, "MIXED: CN_SURNAME_LAST_ONLY_MIXED"),
    ("Tianxiang Tang", "CROSSREF", "Tsinghua University, Beijing, China", "given_first", 0.947846,
     "CHINESE: CN_SURNAME_LAST_ONLY, FIRST_VALID_PY_NAME(2syl), LAST_SINGLE_SYLLABLE, CN_AFFILIATION, TWO_TOKENS_CN_SURNAME_LAST_INTL"),
    ("Tang Tianxiang", "CROSSREF", None, "family_first", 0.930862, "CHINESE: CN_SURNAME_FIRST_ONLY, LAST_VALID_PY_NAME(2syl), FIRST_SINGLE_SYLLABLE"),
    ("David Smith", None, None, "given_first", 0.95, "WESTERN: WEST_SURNAME_LAST, NO_CN_EVIDENCE_DEFAULT_GIVEN"),
    ("Zhang Wang", "ISTINA", None, "family_first", 0.869892, "CHINESE: CN_SURNAME_DOUBLE_DEFAULT_FAM_ISTINA, FIRST_SINGLE_SYLLABLE, LAST_SINGLE_SYLLABLE"),
    ("Zhang Wang", "CROSSREF", None, "family_first", 0.845535, "CHINESE: CN_SURNAME_DOUBLE_FREQ_FIRST(3<57), FIRST_SINGLE_SYLLABLE, LAST_SINGLE_SYLLABLE"),
    ("Wei Liu", "CROSSREF", None, "given_first", 0.785835, "CHINESE: CN_SURNAME_DOUBLE_FREQ_LAST(4<60), FIRST_SINGLE_SYLLABLE, LAST_SINGLE_SYLLABLE"),
    ("Иванов Иван", None, None, "given_first", 0.622459, "MIXED: NO_MATCH_DEFAULT_GIVEN"),
]


def test_v8_decisions(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(V8)], "i int, name_raw string, source string, affiliation_raw string")
    got = surname_v8.explained(surname_v8.decide(df)).orderBy("i").collect()
    assert [(r["order"], round(r["confidence"], 6), r["reason"]) for r in got] == [(o, c, w) for *_, o, c, w in V8]


def test_consensus(spark):
    cols = "record_id string, source string, person_id string, publication_id string, name_raw string, affiliation_raw string"
    rows = [("1", None, "p", None, "Liu W.", None), ("2", None, "p", None, "Wang", None), ("3", None, None, "q", "Wang", None), ("4", None, "", "q", "Liu W.", None), ("5", None, None, "q", "Li B.", None), ("6", None, "", "r", "Wang", None), ("7", None, "", "r", "Liu W.", None)]
    got = {r["record_id"]: (r["order"], r["confidence"], r["reason_codes"]) for r in surname_v8.identify(spark.createDataFrame(rows, cols)).collect()}
    assert got["2"] == ("family_first", 0.7, ["INVALID_FORMAT", "PERSON_CONSISTENCY_OVERRIDE"])
    assert got["3"] == ("family_first", 0.65, ["INVALID_FORMAT", "PUB_PATTERN_OVERRIDE"])
    assert got["6"] == ("unknown", 0.0, ["INVALID_FORMAT"]) and got["1"][:2] == ("family_first", 1.0)


def test_older_generations(spark):
    df = spark.createDataFrame([("Wei Li", None), ("John Smith", None), ("", None), (None, None), ("Liu W.", None)], "name_raw string, affiliation_raw string")
    assert [r["order"] for r in surname_older.identify_v3(df).collect()] == ["family_first", "given_first", "unknown", "unknown", "given_first"]
    v7 = [(r["order"], r["confidence"]) for r in surname_older.identify_v7(df).collect()]
    assert v7[2] == v7[3] == ("unknown", 0.0) and v7[4] == ("family_first", 1.0) and v7[1][0] == "given_first"


def test_name_orders(spark):
    names = {"Zhang Ming": 1, "Zhang John": 1, "Ivanov Ivan": 1, "Ivanov Ivan Ivanovich": 1, "Smith J.": 1, "John Smith": -1, "": 0, None: 0, "Li-Ming Zhang": -1}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r for r in author_lists.details(df, "n").collect()}
    assert {n: got[n]["name_order"] for n in names} == names
    assert got["Li-Ming Zhang"]["name_parts"] == ["Li", "Ming", "Zhang"]
    without = author_lists.with_order(spark.createDataFrame([("Ming Zhang",)], "n string"), "n", dictionary=None).first()
    assert without["name_order"] == -1


def test_author_lists(spark):
    df = spark.createDataFrame([(1, "Zhang San; Li Wei; Wang Wu"), (2, "Zhang Ming, Li Wei"), (3, ""), (4, None)], "list_id int, authors string")
    got = author_lists.parse_lists(df).orderBy("list_id", "position").collect()
    assert [(r["list_id"], r["position"], r["is_first_author"]) for r in got] == [(1, 0, True), (1, 1, False), (1, 2, False), (2, 0, True), (2, 1, False)]


@pytest.mark.parametrize(
    ("name", "want"),
    [("Bo Ma(马博)", True), ("Shengzhong(Frank) Liu", True), ("Li(Smith) Wei", True), ("Wei Lee", True), ("Wei Hsu", True), ("Ming Wong", True), ("John Wong", False),
     ("David Chan", False), ("Ben Bond-Lamberty", False), ("John Smith", False), ("Liu", None), ("", None), (None, None)],
)
def test_author_filter(spark, name, want):
    df = spark.createDataFrame([(name, None)], "name_raw string, affiliation_raw string")
    assert author_filter.with_verdict(df).first()["is_chinese"] == want


def test_affiliations(spark):
    rows = ["Tsinghua University, Beijing, China", "University of Helsinki, Finland", "", None, "Tsinghua University, Moscow", "Duke University"]
    got = [r["a"] for r in t.with_affiliation(spark.createDataFrame([(r,) for r in rows], "x string"), "a", "x").collect()]
    assert [a and (a["is_chinese"], a["country"], round(a["confidence"], 6)) for a in got] == [(True, "China", 0.6), None, None, None, None, (False, "uk", 0.4)]


def test_lookups_and_transliteration(spark):
    row = spark.createDataFrame([("马林", "欧阳", "Müller", "Wong")], "a string, b string, c string, d string").select(
        F.array_join(pinyin.readings(F.col("a")), " "), pinyin.cyrillic(F.lit("张")), t.surname_of(F.lit("欧阳修")), t.strip_diacritics(F.col("c")),
        t.all_readings(F.col("d")), t.surname_origin(F.lit("Kim")), t.surname_rank(F.lit("nobody")), institutions.confidence(F.lit("Tsinghua, China")), labels.label(F.lit("total"), "ru"), labels.label(F.lit("?"), "en"),
    ).first()
    assert list(row) == ["MA LIN", "Чжан", "欧阳", "Muller", ["wong", "wang", "huang"], "Korean", 999, 0.9, "Всего", "?"]
    assert dims.cyrillic_of("ouyang") == "оуян" and len(dims.SYLLABLES) == 397
    with pytest.raises(ValueError, match="unsupported"):
        labels.label(F.lit("total"), "xx")


def test_reports(spark):
    df = spark.createDataFrame([("Wang Wei", "family_first", "Wang", True, "pinyin:Wang"), ("A B", "given_first", "Q", True, "x"), ("C D", "unknown", "", None, "no_surname")], "name_raw string, order string, lastname string, is_chinese boolean, reason string")
    assert tuple(quality.surname_accuracy(df).first()) == (1, 1, 1, 50.0)
    assert [r["name_raw"] for r in quality.false_positives(df).collect()] == ["A B"]
    assert quality.class_shares(df).count() == 1 and quality.class_shares(df, nulls_as_false=True).count() == 2
    assert quality.exclusion_reasons(df).first()["kind"] == "no_surname"


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"original_name": "Wang Wei", "lastname": "Wang"}, {"affiliation": "x"}]))
    assert [r["lastname"] for r in json_authors.read_authors(spark, str(tmp_path / "a.json")).collect()] == ["Wang", None]
    (tmp_path / "d.json").write_text(json.dumps({"all_authors": [{"original_name": "Li Na", "affiliation": ["P", "Q"]}], "orcid_authors": {"k": {"name": "N"}}}))
    authors, persons = json_authors.read_document(spark, str(tmp_path / "d.json"))
    assert json_authors.as_records(authors).first()["affiliation_raw"] == "P; Q" and persons.first()["name"] == "N"
    json_authors.write_results(authors, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_streaming_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "p", "Liu W.", None, None), ("2024-01-01 01:00:00", "p", "Wang A.", None, None), ("2024-01-01 01:00:00", "", "Wang A.", None, None)]
    df = spark.createDataFrame(rows, "ts string, person_id string, name_raw string, source string, affiliation_raw string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = person_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["person_id"], r["family_first"]) for r in spark.table("counts").collect()] == [("p", 2)]


def test_entry_imports_without_the_corpus_operators(tmp_path):
    """The entry module works where the llm folders and the pipeline have been taken away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "namelens", tmp_path / "namelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'v8_batch' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
