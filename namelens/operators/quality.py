"""Quality reports over judged authors: class shares, samples, checks against dictionaries, histograms, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelens.functions import dims
from namelens.functions import text as t


def class_shares(df: DataFrame, flag: str = "is_chinese", nulls_as_false: bool = False) -> DataFrame:
    """Number and percentage of each class; null rows are left out, or count as false."""
    c = F.coalesce(F.col(flag), F.lit(False)) if nulls_as_false else F.col(flag)
    n = df.select(c.alias(flag)).filter(F.col(flag).isNotNull()).groupBy(flag).agg(F.count("*").alias("n"))
    # a window over the classes' counts, of which there are two
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.select(flag, "n", F.round(100.0 * F.col("n") / total, 4).alias("percent"))


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same in each run: those with the least hashes of their keys."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def in_dictionaries(c: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    """Whether a surname is a traditional spelling or any of its readings is a surname."""
    return t.is_traditional(c) | F.coalesce(F.exists(t.all_readings(c), lambda x: t.is_surname_pinyin(x, d)), F.lit(False))


def is_false_positive(lastname: str = "lastname", flag: str = "is_chinese", count_empty: bool = False, d: dims.Dictionary = dims.DEFAULT) -> Column:
    """Whether a row is judged Chinese but no dictionary holds its last name."""
    name = F.coalesce(F.col(lastname), F.lit(""))
    return F.coalesce(F.col(flag), F.lit(False)) & ~in_dictionaries(name, d) & ((name != "") | F.lit(count_empty))


def is_wrongly_excluded(lastname: str = "lastname", flag: str = "is_chinese", d: dims.Dictionary = dims.DEFAULT) -> Column:
    """Whether a row is not judged Chinese but a dictionary holds its last name."""
    name = F.coalesce(F.col(lastname), F.lit(""))
    return ~F.coalesce(F.col(flag), F.lit(False)) & (name != "") & in_dictionaries(name, d)


def false_positives(df: DataFrame, **params) -> DataFrame:
    """Rows judged Chinese whose last name no dictionary holds."""
    return df.filter(is_false_positive(**params))


def wrongly_excluded(df: DataFrame, **params) -> DataFrame:
    """Rows not judged Chinese whose last name a dictionary holds."""
    return df.filter(is_wrongly_excluded(**params))


def exclusion_reasons(df: DataFrame, reason: str = "reason", flag: str = "is_chinese") -> DataFrame:
    """How often each kind of reason excluded, most frequent first."""
    kind = F.split(F.col(reason), ":")[0]
    return df.filter(~F.coalesce(F.col(flag), F.lit(False))).groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def _accuracy(name: str, order: str, lastname: str, last_is_family: bool) -> list[Column]:
    """Aggregates: how many predicted surname tokens are the last name, are not, and are not predicted."""
    tokens = t.name_tokens(F.col(name))
    first, last = F.get(tokens, F.lit(0)), F.get(tokens, F.size(tokens) - 1)
    family, given = (last, first) if last_is_family else (first, last)
    predicted = F.when(F.col(order) == "family_first", family).when(F.col(order) == "given_first", given)
    right = F.lower(predicted) == F.lower(F.col(lastname))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [n(F.coalesce(right, F.lit(False))).alias("correct"), n(F.coalesce(~right, F.lit(False))).alias("incorrect"), n(predicted.isNull()).alias("undetermined")]


def surname_accuracy(df: DataFrame, *, name: str = "name_raw", order: str = "order", lastname: str = "lastname", last_is_family: bool = False) -> DataFrame:
    """Counts and percentage of rows whose predicted surname token is the last name, without case."""
    out = df.agg(*_accuracy(name, order, lastname, last_is_family))
    share = F.round(100.0 * F.try_divide(F.col("correct"), F.col("correct") + F.col("incorrect")), 4)
    return out.withColumn("percent", share)


def grade(percent: Column, good: float, fair: float) -> Column:
    return F.when(percent > good, "excellent").when(percent > fair, "good").otherwise("needs work")


def summary(df: DataFrame, *, name: str = "name_raw", lastname: str = "lastname") -> DataFrame:
    """One row: authors of each class, likely errors, accuracy of surnames and grades. df has is_chinese and order."""
    n = lambda c: F.count(F.when(c, 1))
    chinese = F.coalesce(F.col("is_chinese"), F.lit(False))
    x = df.agg(
        F.count("*").alias("total_authors"), n(chinese).alias("chinese_count"), n(~chinese).alias("non_chinese_count"),
        n(is_wrongly_excluded(lastname)).alias("wrongly_excluded_count"), n(is_false_positive(lastname)).alias("false_positive_count"),
        *_accuracy(name, "order", lastname, False),
    )
    share = lambda a, b: F.try_divide(100.0 * F.col(a), b)
    judged = F.col("correct") + F.col("incorrect")
    x = x.withColumns({"surname_accuracy": F.round(share("correct", judged), 4), "excluded": share("wrongly_excluded_count", F.col("non_chinese_count"))})
    screening = F.when(F.col("excluded") < 2, "excellent").when(F.col("excluded") < 5, "good").otherwise("needs work")
    return x.select(
        "total_authors", "chinese_count", "non_chinese_count", "wrongly_excluded_count", "false_positive_count", "surname_accuracy",
        F.round(share("incorrect", judged), 4).alias("surname_error_rate"), screening.alias("screening_grade"), grade(F.col("surname_accuracy"), 98, 95).alias("surname_grade"),
    )
