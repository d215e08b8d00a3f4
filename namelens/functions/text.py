"""Tokenising, cleaning and dictionary tests of name strings, as Columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.functions import dims


def _accents() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and that letter."""
    spans = ((0xC0, 0x250), (0x400, 0x460), (0x1E00, 0x1F00))
    pairs = []
    for c in (chr(x) for a, b in spans for x in range(a, b)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def is_in(c: Column, words: list[str]) -> Column:
    """Whether c is one of words; false for null."""
    return F.coalesce(c.isin(words), F.lit(False)) if words else F.lit(False)


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def holds_any(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def strip_space(c: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_diacritics(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\p{M}+", ""), ACCENTED, PLAIN)


def script_of(c: Column) -> Column:
    return F.when(c.rlike(r"[一-鿿]"), "CJK").when(c.rlike(r"[Ѐ-ӿ]"), "CYRILLIC").otherwise("LATIN")


def is_initial(c: Column) -> Column:
    return c.rlike(r"^[A-Z](\.[A-Z])*\.?$")


def capitalised(c: Column) -> Column:
    """The first character in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def name_tokens(c: Column) -> Column:
    """Tokens of a raw name: commas and brackets are white space."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[,()\[\]]", " ")
    return F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")


def clean_name(c: Column) -> Column:
    """Without leading non-word characters; hyphens between parts of two and more characters are spaces."""
    s = F.regexp_replace(strip_space(c), r"(?U)^[^\w一-鿿]+", "")
    return F.regexp_replace(s, r"(?U)(\w{2,})-(\w{2,})", "$1 $2")


def without_parentheses(c: Column) -> Column:
    s = F.regexp_replace(c, r"[(（][^)）]*[)）]", "")
    return strip_space(F.regexp_replace(s, r"(?U)\s+", " "))


def has_hanzi(c: Column) -> Column:
    return holds_any(c, r"[一-鿿]")


def all_hanzi(c: Column) -> Column:
    """Whether a text is not empty and all its characters are hanzi."""
    return F.coalesce(c.rlike(r"^[一-鿿]+\z"), F.lit(False))


def is_hanzi_char(c: Column) -> Column:
    """Whether a text is one character of the basic block of ideographs."""
    return F.coalesce(c.rlike(r"^[一-鿾]\z"), F.lit(False))


def western_suffix(c: Column) -> Column:
    """Ends like a western surname, with two characters and more before the ending."""
    return holds_any(F.lower(c), "(?s)..(?:" + "|".join(dims.WESTERN_SUFFIXES) + r")\z")


def western_cluster(c: Column) -> Column:
    return holds_any(F.lower(c), "|".join(dims.WESTERN_CLUSTERS))


def latin_extended(c: Column) -> Column:
    return holds_any(F.lower(c), f"[{dims.LATIN_EXTENDED}]")


def likely_western(c: Column) -> Column:
    return western_suffix(c) | western_cluster(c) | latin_extended(c)


def western_surname(c: Column) -> Column:
    return is_in(F.lower(c), dims.WESTERN_SURNAMES)


def n_keywords(c: Column, words: list[str]) -> Column:
    """How many of the words a text contains, as substrings."""
    return F.size(F.filter(_words(words), lambda w: c.contains(w)))


def _words(words: list[str]) -> Column:
    """An array literal."""
    return F.expr("array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")")


def contains_any(c: Column, words: list[str]) -> Column:
    return holds_any(c, "|".join(map(re.escape, words)))


def surname_rank(c: Column) -> Column:
    """Frequency rank of a reading; 999 if it has none."""
    ranks = F.create_map(*[F.lit(x) for kv in dims.FREQUENCY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, strip_space(F.lower(c))), F.lit(dims.NO_RANK))


def compare_ranks(a: Column, b: Column) -> Column:
    """Struct: more_common (null on a tie), rank_a, rank_b, diff, confidence."""
    ra, rb = surname_rank(a), surname_rank(b)
    diff = F.abs(ra - rb)
    step = F.when(diff == 0, 0.0).when(diff >= 50, 0.9).when(diff >= 30, 0.8).when(diff >= 20, 0.7).when(diff >= 10, 0.6).otherwise(0.4)
    return F.struct(F.when(ra < rb, a).when(rb < ra, b).alias("more_common"), ra.alias("rank_a"), rb.alias("rank_b"), diff.alias("diff"), step.alias("confidence"))


def variant_readings(c: Column) -> Column:
    """Standard readings of a romanised surname: those of its variant, else itself in lower case."""
    low = strip_space(F.lower(c))
    known = F.create_map(*[x for k, v in dims.VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(known, low), F.array(low))


def is_variant(c: Column) -> Column:
    return is_in(strip_space(F.lower(c)), list(dims.VARIANTS))


def all_readings(c: Column) -> Column:
    """The spelling itself and its standard readings, each once, in this order."""
    return F.array_distinct(F.concat(F.array(strip_space(F.lower(c))), variant_readings(c)))


def is_traditional(c: Column) -> Column:
    return is_in(strip_space(F.lower(c)), list(dims.TRADITIONAL))


def traditional(c: Column) -> Column:
    """Struct of hanzi and reading of a traditional spelling, or null."""
    known = F.create_map(*[x for k, (h, p) in dims.TRADITIONAL.items() for x in (F.lit(k), F.struct(F.lit(h).alias("hanzi"), F.lit(p).alias("pinyin")))])
    return F.try_element_at(known, strip_space(F.lower(c)))


def is_ambiguous(c: Column) -> Column:
    """Whether a spelling stands for surnames of several languages, so that the given name must decide."""
    return is_in(strip_space(F.lower(c)), list(dims.AMBIGUOUS))


def is_surname_pinyin(c: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    return is_in(F.lower(c), d.pinyin)


def is_surname_hanzi(c: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    return surname_of(c, d) != ""


def surname_of(c: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    """The longest surname that a hanzi text starts with (4, 3, 2 characters, then 1), or ''."""
    out = F
    for n in (4, 3, 2, 1):
        head = F.substring(c, 1, n)
        out = out.when((F.length(head) == n) & is_in(head, [h for h in d.hanzi if len(h) == n]), head)
    return out.otherwise("")


def is_surname_cyrillic(c: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    return is_in(F.lower(c), list(d.by_cyrillic))


def is_known_surname(c: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    return is_surname_hanzi(F.coalesce(c, F.lit("")), d) | is_surname_pinyin(c, d) | is_surname_cyrillic(c, d)


def hanzi_of(c: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    """Sorted surnames that a reading or a Cyrillic form may stand for; empty if none."""
    known = F.create_map(*[x for k, v in {**d.by_pinyin, **d.by_cyrillic}.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(known, F.lower(c)), F.array().cast("array<string>"))


def is_foreign_surname(c: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    """Of the Japanese, European and Indian lists; Korean surnames are not excluded."""
    return is_in(strip_space(F.lower(c)), d.foreign_of("Japanese", "European", "Indian"))


def surname_origin(c: Column, d: dims.Dictionary = dims.DEFAULT) -> Column:
    low, out = strip_space(F.lower(c)), F
    for o in ("Japanese", "Korean", "European", "Indian"):
        out = out.when(is_in(low, d.foreign_of(o)), o)
    return out.otherwise("Unknown")


def is_foreign_given(c: Column) -> Column:
    return is_in(strip_space(F.lower(c)), dims.FOREIGN_GIVEN)


def with_affiliation(df: DataFrame, name: str, column: str) -> DataFrame:
    """df with a struct is_chinese, country, confidence of an affiliation, or null if it can't be told.

    Keywords count as substrings. The country of a foreign one is the first keyword in sorted order.
    """
    df = df.withColumn("__low", strip_space(F.lower(F.col(column))))
    low = F.col("__low")
    df = df.withColumns({"__cn": n_keywords(low, dims.CHINESE_KEYWORDS), "__other": F.filter(_words(sorted(dims.FOREIGN_KEYWORDS)), lambda w: low.contains(w))})
    cn, other = F.col("__cn"), F.size("__other")
    sure = lambda n: F.least(F.lit(0.3) + n * F.lit(0.1), F.lit(0.9))
    yes = F.when((cn > 0) & (other == 0), True).when((other > 0) & (cn == 0), False).when(cn > other, True).when(other > cn, False)
    conf = F.when((cn > 0) & (other == 0), sure(cn)).when((other > 0) & (cn == 0), sure(other)).otherwise(0.6)
    df = df.withColumn("__yes", F.when(F.coalesce(low, F.lit("")) != "", yes))
    country = F.when(F.col("__yes"), "China").otherwise(F.get("__other", F.lit(0)))
    made = F.struct(F.col("__yes").alias("is_chinese"), country.alias("country"), conf.alias("confidence"))
    return df.withColumn(name, F.when(F.col("__yes").isNotNull(), made)).drop("__low", "__cn", "__other", "__yes")
