"""Whether an author is Chinese: a surname is needed, foreign parts exclude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.functions import dims
from namelens.functions import text as t
from namelens.operators.surname_older import any_reading_is_surname


def with_verdict(df: DataFrame, *, name: str = "name_raw", affiliation: str = "affiliation_raw", dictionary: dims.Dictionary = dims.DEFAULT) -> DataFrame:
    """df with is_chinese (null: too little to go by), confidence, reason and surname_token.

    The reason names the first token that excludes, in order; its kinds are empty,
    incomplete, no_surname, foreign_surname, foreign_name, compound_surname,
    compound_name, traditional and pinyin.
    """
    d = dictionary
    x = df.withColumn("__t", F.filter(F.split(t.without_parentheses(F.coalesce(F.col(name), F.lit(""))), r"(?U)\s+"), lambda w: w != ""))
    fits = lambda w: (F.length(w) > 1) & ~t.is_foreign_surname(w, d) & (t.is_traditional(w) | any_reading_is_surname(w, d))
    x = x.withColumn("__s", F.get(F.filter("__t", fits), F.lit(0)))
    part = lambda kind, p: F.concat(F.lit(kind + ":"), p)

    def fault(w):
        """What excludes a token, or null."""
        inner = F.transform(F.split(w, "-"), lambda p: F.when(t.is_foreign_surname(p, d), part("compound_surname", p)).when(t.is_foreign_given(p) & (F.length(p) > 4), part("compound_name", p)))
        return (
            F.when(t.is_foreign_surname(w, d), part("foreign_surname", w))
            .when(~w.contains("-") & t.is_foreign_given(w), part("foreign_name", w))
            .when(w.contains("-"), F.get(F.array_compact(inner), F.lit(0)))
        )

    x = x.withColumn("__x", F.get(F.array_compact(F.transform("__t", fault)), F.lit(0)))
    full = F.coalesce(F.col(name), F.lit("")) != ""
    enough, has, bad = F.size("__t") >= 2, F.col("__s").isNotNull(), F.col("__x").isNotNull()
    sure = t.contains_any(F.lower(F.col(affiliation)), dims.FILTER_KEYWORDS)
    kind = F.when(t.is_traditional(F.col("__s")), part("traditional", F.col("__s"))).otherwise(part("pinyin", F.col("__s")))
    return x.withColumns(
        {
            "is_chinese": F.when(full & enough, has & ~bad),
            "confidence": F.when(~full | ~enough, 0.0).when(~has, 0.9).when(bad, 0.95).when(sure, 0.95).otherwise(0.85),
            "reason": F.when(~full, "empty").when(~enough, "incomplete").when(~has, "no_surname").when(bad, F.col("__x")).otherwise(kind),
            "surname_token": F.when(full & enough, F.col("__s")),
        }
    ).drop("__t", "__s", "__x")
