"""Names of any script taken apart into surname and first name, with the order of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.functions import dims
from namelens.functions import text as t
from namelens.operators import author_lists

#: Fixed value: what separates the parts of a name that is not all hanzi; a plus sign is one of them.
SEPARATORS = r"(?U)[.,;\s+]"
CONFIDENCE_OF_ORDER = 0.8


def separated(c: Column) -> Column:
    return F.filter(F.split(c, SEPARATORS), lambda x: x != "")


def components(name: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    """Struct of surname and first_name, both null for blank names.

    A name all in hanzi starts with a surname of two characters, or else with one
    of a single character. Any other one starts with its surname as a part.
    """
    s = t.strip_space(F.coalesce(name, F.lit("")))
    two = F.substring(s, 1, 2)
    n = F.when(t.is_in(two, [h for h in d.hanzi if len(h) == 2]), 2).otherwise(1)
    hanzi = F.struct(F.substring(s, F.lit(1), n).alias("surname"), F.substring(s, n + 1, F.length(s)).alias("first_name"))
    parts = separated(F.lower(s))
    rest = F.array_join(F.slice(parts, 2, 1 << 20), " ")
    latin = F.struct(t.capitalised(F.get(parts, F.lit(0))).alias("surname"), t.capitalised(rest).alias("first_name"))
    return F.when(s == "", None).when(t.all_hanzi(s), hanzi).when(F.size(parts) > 0, latin)


def process(df: DataFrame, name: str, *, dictionary: dims.Dictionary = dims.DEFAULT) -> DataFrame:
    """df with surname, first_name (empty for blank names) and confidence: more if the surname is one in hanzi."""
    c = components(F.col(name), dictionary)
    surname = F.coalesce(c["surname"], F.lit(""))
    sure = F.when(t.is_in(surname, list(dictionary.hanzi)), 0.9).otherwise(0.7)
    return df.withColumns({"surname": surname, "first_name": F.coalesce(c["first_name"], F.lit("")), "confidence": sure})


def detect_order(df: DataFrame, name: str, **params) -> DataFrame:
    """df with name_parts, name_order, detected_order and confidence."""
    x = author_lists.with_order(df, name, **params)
    o = F.col("name_order")
    label = F.when(o == 1, author_lists.LABELS[1]).when(o == -1, author_lists.LABELS[-1]).otherwise(author_lists.LABELS[0])
    parts = separated(t.strip_space(F.coalesce(F.col(name), F.lit(""))))
    return x.withColumns({"name_parts": parts, "detected_order": label, "confidence": F.lit(CONFIDENCE_OF_ORDER)})
