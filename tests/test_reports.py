"""Reports, labels, counts, the command line, dimension tables and votes of lists."""

import json

import pytest

from namelens import __main__ as cli
from namelens.functions import dims, labels
from namelens.operators import author_lists, processor, quality
from namelens.sources import json_authors


def test_labels():
    assert labels.formatted({"accuracy": 95.5, "total": 3, "other": 1}, "en") == {"Accuracy": 95.5, "Total tests": 3}
    assert labels.formatted({"failed": 0}, "zh") == {"失败": 0} and labels.separator(3, "-") == "---"
    assert labels.progress(1234, 5678, "en") == "  Progress: 1,234/5,678..."
    with pytest.raises(ValueError):
        labels.formatted({}, "fr")


def test_dimension_tables(spark):
    assert dims.surname_table(spark).select("hanzi").distinct().count() == 401
    assert dims.foreign_table(spark).filter("origin <> 'Korean'").count() == 328
    assert dims.palladius_table(spark).filter("pinyin = 'xiao'").first()["cyrillic"] == "сяо"


def test_grades(spark):
    d = spark.createDataFrame([(99.0,), (96.0,), (10.0,), (None,)], "p double")
    assert [r[0] for r in d.select(quality.grade(d["p"], 98, 95)).collect()] == ["excellent", "good", "needs work", "needs work"]


def test_command_line_writes_a_report(spark, tmp_path, capsys):
    rows = [
        {"original_name": "Wang Wei", "lastname": "Wang", "firstname": "Wei", "affiliation": "Tsinghua University, Beijing, China"},
        {"original_name": "John Smith", "lastname": "Smith", "firstname": "John", "affiliation": "MIT, USA"},
        {"original_name": None, "lastname": None, "firstname": None, "affiliation": None},
        {"original_name": "J. Li", "lastname": "Li", "firstname": "J.", "affiliation": ""},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows), encoding="utf-8")
    cli.main(["--data-path", str(tmp_path / "a.json"), "--output", str(tmp_path / "out"), "--language", "en"])
    assert "Total tests: 4" in capsys.readouterr().out
    got = spark.read.json(f"{tmp_path}/out/summary").first()
    assert got["total_authors"] == 4 and got["chinese_count"] + got["non_chinese_count"] == 4
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"summary", "exclusion_reasons", "wrongly_excluded_cases", "false_positive_cases"}
    with pytest.raises(SystemExit):
        cli.arguments(["--data-path", "x"])


def test_counts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"name": "王", "people_count": 95000000}, {"name": "李", "people_count": None}]), encoding="utf-8")
    assert [tuple(r) for r in json_authors.read_counts(spark, f"{tmp_path}/c.json").collect()] == [("王", 95000000), ("李", None)]


def test_lists_vote_for_themselves(spark):
    """Lists without an id, and two that share one."""
    chinese, western = "Smith John; Wang Wei; Li Ming", "Wang Wei; John Smith; Petr Ivanov"
    rows = [(None, chinese), (None, western), (7, chinese), (7, western)]
    got = author_lists.parse_lists(spark.createDataFrame(rows, "list_id long, authors string")).collect()
    alone = {t: [tuple(r)[1:] for r in author_lists.parse_lists(spark.createDataFrame([(1, t)], "list_id long, authors string")).collect()] for t in (chinese, western)}
    assert sorted(((r["list_id"], *tuple(r)[1:]) for r in got), key=repr) == sorted(((i, *r) for i, t in rows for r in alone[t]), key=repr)


def test_processor_on_odd_names(spark):
    d = spark.createDataFrame([(x,) for x in ("欧阳修", "王", "囧明", "wang  xiao+ming", "...", " ", None, "SMITH, John Q")], "name string")
    got = [tuple(r) for r in processor.process(d, "name").select("surname", "first_name", "confidence").collect()]
    assert got == [("欧阳", "修", 0.9), ("王", "", 0.9), ("囧", "明", 0.7), ("Wang", "Xiao ming", 0.7), ("", "", 0.7), ("", "", 0.7), ("", "", 0.7), ("Smith", "John q", 0.7)]
