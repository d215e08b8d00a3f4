"""Which token of a name is the surname: scored evidence per record, then consensus of groups.

`decide` is a projection without a shuffle: the evidence of a row comes from its
own tokens, and dictionaries are literals. `by_person` and `by_publication` each
need one shuffle; counts are aggregated before they are joined back, so that a
group of any size is partially summed where its rows lie and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.functions import dims, pinyin
from namelens.functions import text as t
from namelens.functions.scratch import saved


def config(name: str, source: Column) -> Column:
    """A number of the configuration that a source's spelling selects, else of the default one."""
    i, out = dims.SOURCE_FIELDS.index(name), F
    for key in ("CROSSREF", "ORCID", "ISTINA"):
        out = out.when(source.isin([s for s, k in dims.SOURCE_SPELLINGS.items() if k == key]), F.lit(dims.SOURCE_CONFIGS[key][i]))
    return out.otherwise(F.lit(dims.SOURCE_CONFIGS["DEFAULT"][i]))


def with_features(df: DataFrame, name: str, affiliation: str, d: dims.Dictionary = dims.DEFAULT) -> DataFrame:
    """df with a struct f of everything that the scores look at."""
    x = df.withColumn("__t", t.name_tokens(F.col(name)))
    full = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__t") - 1, F.lit(0))), lambda i: ~F.coalesce(t.is_initial(F.get("__t", i)), F.lit(True)))
    x = x.withColumn("__full", full)
    two = F.size("__full") >= 2
    some = F.size("__t") >= 2
    x = x.withColumn("__a", F.when(two, F.get("__full", F.lit(0))).when(some, 0)).withColumn("__b", F.when(two, F.get("__full", F.size("__full") - 1)).when(some, F.size("__t") - 1))
    plain = lambda c: t.strip_diacritics(F.lower(c))
    x = x.withColumns({"__first": plain(F.get("__t", F.col("__a"))), "__last": plain(F.get("__t", F.col("__b")))})
    x = t.with_affiliation(pinyin.with_syllables(x, __sa="__first", __sb="__last"), "__aff", affiliation)
    first, last = F.col("__first"), F.col("__last")
    f = F.struct(
        F.col("__t").alias("tokens"),
        first.alias("first"),
        last.alias("last"),
        F.exists("__t", lambda c: t.script_of(c) == "CJK").alias("cjk"),
        F.exists("__t", lambda c: F.lower(c) != t.strip_diacritics(F.lower(c))).alias("diacritics"),
        t.is_surname_pinyin(first, d).alias("cn_first"),
        t.is_surname_pinyin(last, d).alias("cn_last"),
        (t.western_surname(first) | t.likely_western(first)).alias("west_first"),
        (t.western_surname(last) | t.likely_western(last)).alias("west_last"),
        t.western_surname(last).alias("common_last"),
        t.western_suffix(first).alias("suffix_first"),
        t.western_suffix(last).alias("suffix_last"),
        t.western_cluster(first).alias("cluster_first"),
        t.western_cluster(last).alias("cluster_last"),
        F.size("__sa").alias("syl_first"),
        F.size("__sb").alias("syl_last"),
        t.surname_rank(first).alias("rank_first"),
        t.surname_rank(last).alias("rank_last"),
        F.coalesce(F.col("__aff.is_chinese"), F.lit(False)).alias("cn_affiliation"),
    )
    return x.withColumn("f", f).drop("__t", "__full", "__a", "__b", "__first", "__last", "__sa", "__sb", "__aff")


def summed(start: Column, *terms: tuple[Column, float]) -> Column:
    """start plus the weights whose conditions hold, in this order; others add 0.0, which leaves a sum of doubles as it is."""
    for condition, weight in terms:
        start = start + F.when(condition, F.lit(float(weight))).otherwise(F.lit(0.0))
    return start


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in pairs]))


def _mode(source: Column) -> Column:
    g = lambda k: F.col(f"f.{k}")
    given = lambda k: g(k).between(2, 3)
    cn = summed(
        F.lit(0.0), (g("cjk"), 0.9), (g("cn_first"), 0.4), (g("cn_last"), 0.2), (given("syl_first"), 0.2), (given("syl_last"), 0.2),
        (g("cn_affiliation"), 0.4), (F.coalesce(source.isin(*dims.ISTINA), F.lit(False)), 0.2),
    )
    west = summed(
        F.lit(0.0), (g("suffix_first"), 0.5), (g("suffix_last"), 0.5), (g("diacritics"), 0.3), (g("common_last"), 0.5),
        (g("cluster_first"), 0.3), (g("cluster_last"), 0.3), (F.coalesce(source.isin(*dims.INTERNATIONAL), F.lit(False)), 0.2),
    )
    return F.struct(cn.alias("cn"), west.alias("west"))


def _decided(mode: str, delta: Column, threshold: Column, why: Column, tie: tuple[str, float, str], cap: float) -> Column:
    near = F.abs(delta) < threshold
    conf = F.least(1.0 / (1.0 + F.exp(-F.abs(delta))), F.lit(cap))
    return F.struct(
        F.when(near, tie[0]).when(delta > 0, "family_first").otherwise("given_first").alias("order"),
        F.when(near, F.lit(tie[1])).otherwise(conf).alias("confidence"),
        F.lit(mode).alias("mode"),
        F.when(near, F.concat(why, F.array(F.lit(tie[2])))).otherwise(why).alias("reason_codes"),
    )


def decide(df: DataFrame, *, name: str = "name_raw", affiliation: str = "affiliation_raw", source: str = "source", default_source: str | None = None, dictionary: dims.Dictionary = dims.DEFAULT) -> DataFrame:
    """df with order, confidence, mode and reason_codes of each row.

    Null and empty names, and names of one token, are unknown with INVALID_FORMAT.
    Rows without a source use the configuration of default_source.
    """
    src = F.when(F.coalesce(F.col(source), F.lit("")) == "", F.lit(default_source)).otherwise(F.col(source))
    x = with_features(df, name, affiliation, dictionary).withColumn("__src", F.coalesce(src, F.lit("DEFAULT")))
    s = F.col("__src")
    x = x.withColumn("__mode", _mode(F.col(source)))
    g = lambda k: F.col(f"f.{k}")
    cn_a, cn_b, aff = g("cn_first"), g("cn_last"), g("cn_affiliation")
    istina, international = F.coalesce(F.col(source).isin(*dims.ISTINA), F.lit(False)), F.coalesce(F.col(source).isin(*dims.INTERNATIONAL), F.lit(False))
    both, only_a, only_b = cn_a & cn_b, cn_a & ~cn_b, cn_b & ~cn_a
    far = both & ~istina & (F.abs(g("rank_first") - g("rank_last")) > 20)
    last_wins, first_wins = far & (g("rank_last") < g("rank_first")), far & ~(g("rank_last") < g("rank_first"))
    plain_double = both & ~istina & ~far
    sa, sb = g("syl_first"), g("syl_last")
    pair = (F.size(g("tokens")) == 2) & only_b
    text_of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    fam = summed(config("chinese_prior_fam", s), (only_a, 2.0), (both & (istina | ~far), 1.5), (first_wins, 1.5), (sb.between(2, 3), 0.8), (sb == 1, 0.4), (aff, 0.5))
    giv = summed(config("chinese_prior_giv", s), (only_b, 2.0), (last_wins, 1.5), (sa.between(2, 3), 0.8), (sa == 1, 0.4), (aff, 0.5), (pair & international, 0.7), (pair & ~international, 0.3))
    why = reasons(
        (only_a, "CN_SURNAME_FIRST_ONLY"), (only_b, "CN_SURNAME_LAST_ONLY"), (both & istina, "CN_SURNAME_DOUBLE_DEFAULT_FAM_ISTINA"),
        (last_wins, text_of("CN_SURNAME_DOUBLE_FREQ_LAST(", g("rank_last"), "<", g("rank_first"), ")")),
        (first_wins, text_of("CN_SURNAME_DOUBLE_FREQ_FIRST(", g("rank_first"), "<", g("rank_last"), ")")),
        (plain_double, "CN_SURNAME_DOUBLE_DEFAULT_FAM"),
        (sa.between(2, 3), text_of("FIRST_VALID_PY_NAME(", sa, "syl)")), (sb.between(2, 3), text_of("LAST_VALID_PY_NAME(", sb, "syl)")),
        (sa == 1, "FIRST_SINGLE_SYLLABLE"), (sb == 1, "LAST_SINGLE_SYLLABLE"), (aff, "CN_AFFILIATION"),
        (pair & international, "TWO_TOKENS_CN_SURNAME_LAST_INTL"), (pair & ~international, "TWO_TOKENS_CN_SURNAME_LAST_ISTINA"),
    )
    delta_cn = fam - giv
    chinese = _decided("CHINESE", F.col("__delta.cn"), config("threshold_cn", s), why, ("unknown", 0.5, "DELTA_SMALL_CN"), 0.95)

    west_a, west_b = g("west_first"), g("west_last")
    none = ~(cn_a | cn_b | aff)
    fam = summed(config("western_prior_fam", s), (west_a & ~west_b, 0.5), (cn_a & aff, 2.0))
    giv = summed(config("western_prior_giv", s), (west_b, 2.0), (cn_b & aff, 1.0), (none, 1.0))
    why = reasons(
        (west_b, "WEST_SURNAME_LAST"), (west_a & ~west_b, "WEST_SURNAME_FIRST"), (cn_a & aff, "CN_SURNAME_FIRST_WITH_CN_AFFIL"),
        (cn_b & aff, "CN_SURNAME_LAST_WITH_CN_AFFIL"), (none, "NO_CN_EVIDENCE_DEFAULT_GIVEN"),
    )
    delta_west = fam - giv
    western = _decided("WESTERN", F.col("__delta.west"), config("threshold_west", s), why, ("given_first", 0.55, "FORCED_GIVEN_ON_TIE"), 0.95)

    fam = summed(config("mixed_prior_fam", s), (cn_a & aff, 1.5), (only_a, 1.0))
    giv = summed(config("mixed_prior_giv", s), (cn_b & aff, 1.5), (only_b, 1.0), (~cn_a & ~cn_b, 0.5))
    why = reasons(
        (cn_a & aff, "CN_SURNAME_FIRST_CN_AFFIL_MIXED"), (cn_b & aff, "CN_SURNAME_LAST_CN_AFFIL_MIXED"), (only_a, "CN_SURNAME_FIRST_ONLY_MIXED"),
        (only_b, "CN_SURNAME_LAST_ONLY_MIXED"), (~cn_a & ~cn_b, "NO_MATCH_DEFAULT_GIVEN"),
    )
    delta_mixed = fam - giv
    mixed = _decided("MIXED", F.col("__delta.mixed"), config("threshold_mixed", s), why, ("unknown", 0.4, "DELTA_SMALL_MIXED"), 0.9)

    tokens = g("tokens")
    at = lambda i: F.get(tokens, F.lit(i))
    short = lambda i: F.coalesce(t.is_initial(at(i)), F.lit(False))
    fixed = lambda order, conf, mode, reason: F.struct(F.lit(order).alias("order"), F.lit(conf).alias("confidence"), F.lit(mode).alias("mode"), F.array(reason).alias("reason_codes"))
    rest_short = F.forall(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), t.is_initial)
    cn, west = F.col("__mode.cn"), F.col("__mode.west")
    n = F.size(tokens)
    decision = (
        F.when(n < 2, fixed("unknown", 0.0, "MIXED", F.lit("INVALID_FORMAT")))
        .when((n == 2) & short(1), fixed("family_first", 1.0, "ABBREVIATION", text_of("ABBREV_", at(0), "_", at(1))))
        .when((n == 2) & short(0), fixed("given_first", 0.85, "ABBREVIATION", text_of("ABBREV_", at(0), "_", at(1), "_REVERSED")))
        .when((n >= 3) & rest_short, fixed("family_first", 1.0, "ABBREVIATION", text_of("ABBREV_", at(0), "_+")))
        .when((cn >= west + F.lit(0.3)) & (cn >= 0.5), chinese)
        .when((west >= cn + F.lit(0.3)) & (west >= 0.5), western)
        .otherwise(mixed)
    )
    x = x.withColumn("__delta", F.struct(delta_cn.alias("cn"), delta_west.alias("west"), delta_mixed.alias("mixed")))
    return x.withColumn("__d", decision).select(*df.columns, "__d.order", "__d.confidence", "__d.mode", "__d.reason_codes")


def _counted(df: DataFrame, key: str, least: Column) -> DataFrame:
    """df with the numbers of confident rows of each order in the row's group; 0 for rows without a group, which are not shuffled."""
    sure = lambda o: F.sum(((F.col("order") == o) & (F.col("confidence") >= least)).cast("long"))
    grouped = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    counts = df.filter(grouped).groupBy(F.col(key).alias("__k"))
    counts = counts.agg(sure("family_first").alias("__fam"), sure("given_first").alias("__giv")).filter("__fam + __giv > 0")
    joined = df.filter(grouped).join(counts, F.col(key) == F.col("__k"), "left").drop("__k").fillna(0, ["__fam", "__giv"])
    none = F.lit(0).cast("long")
    return joined.unionByName(df.filter(~grouped).withColumns({"__fam": none, "__giv": none}))


def _overridden(df: DataFrame, rows: Column, target: Column, confidence: Column, reason: str) -> DataFrame:
    x = df.withColumn("__o", rows)
    return x.withColumns(
        {
            "order": F.when(F.col("__o"), target).otherwise(F.col("order")),
            "confidence": F.when(F.col("__o"), confidence).otherwise(F.col("confidence")),
            "reason_codes": F.when(F.col("__o"), F.concat("reason_codes", F.array(F.lit(reason)))).otherwise(F.col("reason_codes")),
        }
    ).drop("__o", "__fam", "__giv")


def by_person(df: DataFrame, *, person: str = "person_id", source: str | None = None) -> DataFrame:
    """Unsure rows take the order that most confident rows of the same person have; ties go to family_first."""
    c = lambda k: config(k, F.lit(source))
    x = _counted(df, person, c("person_conf"))
    rows = (F.col("__fam") + F.col("__giv") > 0) & ((F.col("order") == "unknown") | (F.col("confidence") < c("person_override")))
    target = F.when(F.col("__fam") >= F.col("__giv"), "family_first").otherwise("given_first")
    return _overridden(x, rows, target, F.greatest("confidence", c("person_override_conf")), "PERSON_CONSISTENCY_OVERRIDE")


def by_publication(df: DataFrame, *, publication: str = "publication_id", source: str | None = None) -> DataFrame:
    """Unknown rows take a publication's order if it leads by the least margin."""
    c = lambda k: config(k, F.lit(source))
    x = _counted(df, publication, c("pub_conf"))
    lead = (F.col("__fam") + F.col("__giv") > 0) & (F.abs(F.col("__fam") - F.col("__giv")) >= c("pub_min_diff"))
    rows = lead & (F.col("order") == "unknown") & (F.col("confidence") <= c("pub_override"))
    target = F.when(F.col("__fam") > F.col("__giv"), "family_first").otherwise("given_first")
    return _overridden(x, rows, target, c("pub_override_conf"), "PUB_PATTERN_OVERRIDE")


def identify(df: DataFrame, *, source: str | None = None, person_consistency: bool = True, publication_consistency: bool = True, **cols) -> DataFrame:
    """Decisions of all rows with both consensus passes; record ids are expected to be unique."""
    out = decide(df, default_source=source, **cols)
    if person_consistency or publication_consistency:
        # both passes count and then join the same rows: decide them once
        out = saved(out, "decisions")
    if person_consistency:
        out = by_person(out, source=source)
    if publication_consistency:
        out = by_publication(out, source=source)
    return out


def explained(df: DataFrame) -> DataFrame:
    """order, confidence and one reason text, as a caller of a single name sees them."""
    return df.withColumn("reason", F.concat(F.col("mode"), F.lit(": "), F.array_join("reason_codes", ", "))).drop("mode", "reason_codes")
