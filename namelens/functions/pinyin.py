"""Segmentation of Latin tokens into pinyin syllables, and transliteration, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.functions import dims
from namelens.functions.text import is_in

_LONGEST = max(map(len, dims.SYLLABLES))
_KNOWN = ", ".join(f"'{x}'" for x in dims.SYLLABLES)


def with_syllables(df: DataFrame, **columns: str) -> DataFrame:
    """df with, for each name=token column, the token's syllables; an empty array if it isn't valid pinyin.

    Hyphens and apostrophes are dropped. Dynamic programming over end positions:
    parent[j] is the least reachable i such that the letters between are a syllable
    (six at most), and the syllables are read back along the parents. Each step is
    a column of its own, so that no step makes the ones before it anew.
    """
    for name, token in columns.items():
        df = df.withColumn("__w", F.regexp_replace(F.lower(F.coalesce(F.col(token), F.lit(""))), "[-']", ""))
        df = df.withColumn("__w", F.when(F.col("__w").rlike("^[a-z]+$"), F.col("__w")))
        fits = f"filter(sequence(greatest(0, j - {_LONGEST}), j - 1), i -> get(p, i) >= 0 and substring(__w, i + 1, j - i) in ({_KNOWN}))"
        df = df.withColumn("__p", F.expr(f"aggregate(sequence(1, length(__w)), array(0), (p, j) -> concat(p, array(coalesce(get({fits}, 0), -1))))"))
        # starts of the syllables, last first: follow parents, at most as many times as there are letters
        chain = "aggregate(sequence(1, length(__w)), array(length(__w)), (a, k) -> CASE WHEN get(a, size(a) - 1) > 0 THEN concat(a, array(get(__p, get(a, size(a) - 1)))) ELSE a END)"
        df = df.withColumn("__c", F.when(F.get("__p", F.length("__w")) >= 0, F.reverse(F.expr(chain))))
        cut = "transform(slice(__c, 2, 2147483), (e, k) -> substring(__w, get(__c, k) + 1, e - get(__c, k)))"
        df = df.withColumn(name, F.coalesce(F.expr(cut), F.array().cast("array<string>"))).drop("__w", "__p", "__c")
    return df


def given_confidence(token: Column, syls: Column) -> Column:
    """How like a Chinese given name a token with these syllables is."""
    n = F.size(syls)
    common = F.arrays_overlap(syls, F.array(*map(F.lit, dims.GIVEN_SYLLABLES)))
    return (
        F.when(n == 0, 0.0)
        .when(n.between(2, 3), F.when(common, F.least(F.lit(0.8) + F.lit(0.1), F.lit(0.9))).otherwise(0.8))
        .when((n == 1) & (F.length(token) <= 4), 0.5)
        .when(n >= 4, 0.2)
        .otherwise(0.0)
    )


def given_pattern(token: Column) -> Column:
    """The older shape test of a Chinese given name."""
    low = F.lower(token)
    groups = F.size(F.regexp_extract_all(low, F.lit("[aeiou]+"), F.lit(0)))
    return (
        F.when(token.contains("-"), True)
        .when((F.length(token) >= 6) & (groups >= 2), True)
        .when((F.length(token) <= 4) & (groups <= 2), False)
        .otherwise(low.rlike("ing|ang|ong|eng|iao|ian|uan|uang"))
    )


def readings(text: Column, d: dims.Dictionary = dims.DEFAULT, upper: bool = True) -> Column:
    """The reading of each character; characters that the dictionary lacks stay as they are."""
    first: dict[str, str] = {}
    for h, p in d.surnames:
        if len(h) == 1:
            first.setdefault(h, p)
    known = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda x: x != "")
    shown = lambda x: F.upper(x) if upper else x
    return F.transform(chars, lambda x: shown(F.coalesce(F.try_element_at(known, x), x)))


def cyrillic(text: Column, d: dims.Dictionary = dims.DEFAULT, sep: str = "") -> Column:
    """The Palladius form of a hanzi text; only its first letter is in upper case."""
    known = F.create_map(*[F.lit(x) for kv in dims.PALLADIUS.items() for x in kv])
    parts = F.transform(readings(text, d, upper=False), lambda x: F.coalesce(F.try_element_at(known, x), x))
    s = F.array_join(parts, sep)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def cyrillic_surname(text: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    """The Palladius form of a surname: the first letter in upper case, all others in lower case."""
    s = cyrillic(text, d)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def is_syllable(c: Column) -> Column:
    return is_in(F.lower(c), dims.SYLLABLES)


def is_given_syllable(c: Column) -> Column:
    return is_in(F.lower(c), dims.GIVEN_SYLLABLES)
