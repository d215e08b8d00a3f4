"""The two earlier generations of surname position, kept as operators of their own.

They disagree with the current one; in v3 "family_first" means that the last
token is the surname. Each returns order and confidence (v7 also mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.functions import dims, pinyin
from namelens.functions import text as t
from namelens.operators.surname_v8 import summed

#: Affiliation keywords of v3.
V3_KEYWORDS = ["china", "chinese", "beijing", "shanghai", "guangzhou", "tsinghua", "peking university", "fudan"]


def _space_tokens(name: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(name), F.lit("")), r"(?U)\s+"), lambda x: x != "")


def any_reading_is_surname(c: Column, d: dims.Dictionary) -> Column:
    """Whether the spelling or any of its standard readings is a surname."""
    return F.coalesce(F.exists(t.all_readings(c), lambda x: t.is_surname_pinyin(x, d)), F.lit(False))


def identify_v3(df: DataFrame, *, name: str = "name_raw", affiliation: str | None = "affiliation_raw", dictionary: dims.Dictionary = dims.DEFAULT) -> DataFrame:
    d = dictionary
    x = df.withColumn("__t", _space_tokens(name))
    x = x.withColumns({"__a": F.get("__t", F.lit(0)), "__b": F.get("__t", F.size("__t") - 1)})
    a, b, n = F.col("__a"), F.col("__b"), F.size("__t")
    x = x.withColumns({"__sa": any_reading_is_surname(a, d), "__sb": any_reading_is_surname(b, d), "__cmp": t.compare_ranks(F.lower(a), F.lower(b)), "__pa": pinyin.given_pattern(a), "__pb": pinyin.given_pattern(b)})
    sa, sb, cmp = F.col("__sa"), F.col("__sb"), F.col("__cmp")
    sure = sa & sb & (cmp["confidence"] > 0.7)
    aff = t.contains_any(F.lower(F.col(affiliation)), V3_KEYWORDS) if affiliation else F.lit(False)
    conf = summed(F.lit(0.0), (sb, 0.6), (sa, 0.3), (sure & (cmp["more_common"] == F.lower(b)), 0.4), (sure & (cmp["more_common"] == F.lower(a)) & (cmp["more_common"] != F.lower(b)), 0.2), ((n == 2) & (F.col("__pa") != F.col("__pb")), 0.4), (aff, 0.3))
    x = x.withColumn("__c", conf)
    c = F.col("__c")
    out = lambda o, v: F.struct(F.lit(o).alias("order"), v.alias("confidence"))
    got = (
        F.when(n < 2, out("unknown", F.lit(0.0)))
        .when(t.is_foreign_surname(b, d), out("given_first", F.lit(0.95)))
        .when(t.is_foreign_surname(a, d), out("given_first", F.lit(0.9)))
        .when(sb & (c >= 0.6), out("family_first", c))
        .when(sa & ~sb, out("given_first", c * 0.7))
        .otherwise(out("unknown", c))
    )
    return x.withColumn("__r", got).select(*df.columns, F.col("__r.order").alias("order"), F.col("__r.confidence").alias("confidence"))


def identify_v7(df: DataFrame, *, name: str = "name_raw", affiliation: str = "affiliation_raw", mode_hint: str | None = None, dictionary: dims.Dictionary = dims.DEFAULT) -> DataFrame:
    d = dictionary
    x = df.withColumn("__t", t.name_tokens(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[()\[\]]", " ")))
    clean = F.filter("__t", lambda w: ~t.is_initial(w))
    x = x.withColumn("__k", clean).withColumn("__k", F.when(F.size("__k") < 2, F.col("__t")).otherwise(F.col("__k")))
    x = x.withColumns({"__a": F.get("__k", F.lit(0)), "__b": F.get("__k", F.size("__k") - 1)})
    x = t.with_affiliation(pinyin.with_syllables(x, __sa="__a", __sb="__b"), "__aff", affiliation)
    a, b = F.col("__a"), F.col("__b")
    x = x.withColumns(
        {
            "__ca": t.is_surname_pinyin(a, d), "__cb": t.is_surname_pinyin(b, d), "__wa": t.likely_western(a), "__wb": t.likely_western(b),
            "__ma": t.western_surname(a), "__mb": t.western_surname(b), "__ga": pinyin.given_confidence(a, F.col("__sa")), "__gb": pinyin.given_confidence(b, F.col("__sb")),
        }
    )
    col = F.col
    is_cn, is_other = F.coalesce(col("__aff.is_chinese"), F.lit(False)), F.coalesce(~col("__aff.is_chinese"), F.lit(False))
    size = lambda k: F.size(k).between(2, 3)
    cn = summed(F.lit(0.0), (col("__ca"), 0.6), (col("__cb"), 0.6), (size("__sa"), 0.2), (size("__sb"), 0.2), (is_cn, 0.3), (t.has_hanzi(col(name)), 0.8))
    west = summed(
        F.lit(0.0), (t.western_cluster(a), 0.3), (t.western_cluster(b), 0.3), (t.latin_extended(a), 0.3), (t.latin_extended(b), 0.3),
        (t.western_suffix(a), 0.3), (t.western_suffix(b), 0.3), (col("__ma"), 0.4), (col("__mb"), 0.4), (is_other, 0.2),
    )
    x = x.withColumns({"__cn": F.least(cn, F.lit(1.0)), "__west": F.least(west, F.lit(1.0))})
    cn, west = col("__cn"), col("__west")
    mode = F.when((cn >= 0.7) & (cn >= west + F.lit(0.2)), "Chinese").when((west >= 0.7) & (west >= cn + F.lit(0.2)), "Western").otherwise("Mixed")
    x = x.withColumn("__mode", F.lit(mode_hint) if mode_hint in ("Chinese", "Western") else mode)
    ca, cb, m = col("__ca"), col("__cb"), col("__mode")
    out = lambda o, v: F.struct(F.lit(o).alias("order"), (F.lit(v) if isinstance(v, float) else v).alias("confidence"))
    own = lambda given: F.least(summed(F.lit(0.6), (given > 0.5, 0.3), (is_cn, 0.2)), F.lit(1.0))
    west_a, west_b = col("__wa") | col("__ma"), col("__wb") | col("__mb")
    n, at = F.size("__t"), lambda i: F.coalesce(t.is_initial(F.get("__t", F.lit(i))), F.lit(False))
    rest = F.forall(F.slice("__t", F.lit(2), F.greatest(n - 1, F.lit(0))), t.is_initial)
    got = (
        F.when(n < 2, out("unknown", 0.0))
        .when(((n == 2) & at(1)) | ((n >= 3) & rest), out("family_first", 1.0))
        .when((m == "Chinese") & ca & ~cb, out("family_first", own(col("__gb"))))
        .when((m == "Chinese") & cb & ~ca, out("given_first", own(col("__ga"))))
        .when((m == "Chinese") & ca & cb, out("family_first", 0.7))
        .when((m == "Chinese") & (cn >= 0.5), out("unknown", 0.4))
        .when(m == "Chinese", out("unknown", 0.3))
        .when((m == "Western") & west_b, out("given_first", F.when(col("__wa"), F.lit(0.7)).otherwise(F.lit(0.8))))
        .when((m == "Western") & west_a, out("family_first", 0.6))
        .when((m == "Western") & (cn < 0.3), out("given_first", 0.6))
        .when((m == "Western") & (cn < 0.6), out("given_first", 0.5))
        .when(m == "Western", out("unknown", 0.4))
        .when(ca & ~cb, out("family_first", 0.6))
        .when(cb & ~ca, out("given_first", 0.6))
        .when(~ca & ~cb, out("given_first", 0.5))
        .otherwise(out("unknown", 0.4))
    )
    return x.withColumn("__r", got).select(*df.columns, col("__r.order").alias("order"), col("__r.confidence").alias("confidence"), col("__mode").alias("mode"))
