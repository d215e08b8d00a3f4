"""Texts of reports in three languages, as a small table and a lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS = {
    "en": {"total": "Total", "chinese": "Chinese", "non_chinese": "Non-Chinese", "false_positives": "False positives", "accuracy": "Accuracy", "undetermined": "Undetermined", "total_tests": "Total tests", "passed": "Passed", "failed": "Failed", "chinese_authors": "Chinese authors", "non_chinese_authors": "Non-Chinese authors", "false_positive_rate": "False positive rate", "progress": "Progress"},
    "zh": {"total": "总数", "chinese": "中文", "non_chinese": "非中文", "false_positives": "误报", "accuracy": "准确率", "undetermined": "未确定", "total_tests": "总测试数", "passed": "通过", "failed": "失败", "chinese_authors": "中文作者", "non_chinese_authors": "非中文作者", "false_positive_rate": "误判率", "progress": "进度"},
    "ru": {"total": "Всего", "chinese": "Китайские", "non_chinese": "Не китайские", "false_positives": "Ложные срабатывания", "accuracy": "Точность", "undetermined": "Не определено", "total_tests": "Всего тестов", "passed": "Пройдено", "failed": "Не пройдено", "chinese_authors": "Китайские авторы", "non_chinese_authors": "Не китайские авторы", "false_positive_rate": "Доля ложных срабатываний", "progress": "Прогресс"},
}


def label(key: Column, lang: str = "en") -> Column:
    """The text of a key; the key itself if it has none."""
    if lang not in TEXTS:
        raise ValueError(f"unsupported language: {lang}")
    out = F
    for k, v in TEXTS[lang].items():
        out = out.when(key == k, v)
    return out.otherwise(key)


def renamed(df, lang: str = "en"):
    """df with its known column names in a language."""
    if lang not in TEXTS:
        raise ValueError(f"unsupported language: {lang}")
    return df.withColumnsRenamed({k: v for k, v in TEXTS[lang].items() if k in df.columns})


#: Which text names a key of a result.
RESULT_KEYS = {
    "accuracy": "accuracy", "total": "total_tests", "passed": "passed", "failed": "failed", "chinese_count": "chinese_authors",
    "non_chinese_count": "non_chinese_authors", "false_positive_rate": "false_positive_rate",
}


def formatted(result: dict, lang: str = "ru") -> dict:
    """The known keys of a result under their names in a language."""
    if lang not in TEXTS:
        raise ValueError(f"unsupported language: {lang}")
    return {TEXTS[lang].get(k, k): result[key] for key, k in RESULT_KEYS.items() if key in result}


def separator(length: int = 80, char: str = "=") -> str:
    return char * length


def progress(current: int, total: int, lang: str = "ru") -> str:
    return f"  {TEXTS[lang]['progress']}: {current:,}/{total:,}..."
