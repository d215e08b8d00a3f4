"""DuckDB forms of the queries, written apart from the operators; they share the dictionaries alone."""

from __future__ import annotations

from namelens.functions import dims
from namelens.operators import institutions
from namelens.plans.authors import AUTHORS_SQL

D = dims.DEFAULT


def lit(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def table(name: str, cols: str, rows) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{name}({cols}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


SYL = table("syl", "s", [(s,) for s in dims.SYLLABLES])
RANK = table("ranks", "p, r", dims.FREQUENCY_RANK.items())


def segments(source: str) -> str:
    """CTEs pt (tok) -> seg (tok, n, syls): least-parent segmentation of the distinct tokens of a query."""
    return f"""
pt AS (SELECT DISTINCT tok, regexp_replace(lower(tok), '[-'']', '', 'g') AS w FROM ({source}) WHERE tok IS NOT NULL),
ok AS (SELECT DISTINCT w, length(w) AS n FROM pt WHERE regexp_full_match(w, '[a-z]+')),
reach(w, j) AS (
  SELECT w, 0 FROM ok UNION
  SELECT r.w, r.j + k.k FROM reach r JOIN (SELECT unnest(range(1, 7)) AS k) k ON r.j + k.k <= length(r.w)
  WHERE substr(r.w, r.j + 1, k.k) IN (SELECT s FROM syl)),
par AS (SELECT r.w, e.j, min(r.j) AS i FROM reach r JOIN reach e ON r.w = e.w AND e.j > r.j AND e.j - r.j <= 6
        WHERE substr(r.w, r.j + 1, e.j - r.j) IN (SELECT s FROM syl) GROUP BY ALL),
walk(w, j, syls) AS (
  SELECT o.w, o.n, []::VARCHAR[] FROM ok o WHERE EXISTS (SELECT 1 FROM reach r WHERE r.w = o.w AND r.j = o.n)
  UNION ALL SELECT k.w, p.i, list_prepend(substr(k.w, p.i + 1, k.j - p.i), k.syls) FROM walk k JOIN par p ON p.w = k.w AND p.j = k.j WHERE k.j > 0),
seg AS (SELECT pt.tok, coalesce(len(k.syls), 0) AS n, coalesce(k.syls, []::VARCHAR[]) AS syls FROM pt LEFT JOIN walk k ON k.w = pt.w AND k.j = 0)"""


AFF = f"""
aff0 AS (SELECT DISTINCT affiliation_raw AS raw, trim(lower(affiliation_raw)) AS low FROM authors WHERE affiliation_raw IS NOT NULL),
aff1 AS (SELECT raw, low, len(list_filter({lit(dims.CHINESE_KEYWORDS)}, lambda k: contains(low, k))) AS c,
         list_sort(list_filter({lit(dims.FOREIGN_KEYWORDS)}, lambda k: contains(low, k))) AS o FROM aff0 WHERE low <> ''),
aff AS (SELECT raw, c > len(o) AS is_chinese, CASE WHEN c > len(o) THEN 'China' ELSE o[1] END AS country,
        CASE WHEN c > 0 AND len(o) > 0 THEN 0.6::DOUBLE ELSE least(0.3::DOUBLE + (c + len(o)) * 0.1::DOUBLE, 0.9::DOUBLE) END AS confidence
        FROM aff1 WHERE c <> len(o))"""

_SUFFIX = "..(" + "|".join(dims.WESTERN_SUFFIXES) + ")$"
_CLUSTER = "|".join(dims.WESTERN_CLUSTERS)
_SHORT = r"[A-Z](\.[A-Z])*\.?"
_CONF = "CASE source WHEN 'CROSSREF' THEN {0} WHEN 'ORCID' THEN {1} WHEN 'ISTINA' THEN {2} ELSE {3} END"


def conf(field: str) -> str:
    i = dims.SOURCE_FIELDS.index(field)
    return _CONF.format(*[f"{dims.SOURCE_CONFIGS[k][i]}::DOUBLE" for k in ("CROSSREF", "ORCID", "ISTINA", "DEFAULT")])


def total(first: str, *terms: tuple[str, float]) -> str:
    return first + "".join(f" + CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, w in terms)


V8 = f"""
WITH RECURSIVE {AUTHORS_SQL}, {SYL}, {RANK},
tk AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(name_raw, '[,()\\[\\]]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM authors),
fu AS (SELECT *, list_filter(t, lambda x: NOT regexp_full_match(x, '{_SHORT}')) AS k FROM tk),
fl AS (SELECT *, strip_accents(lower(CASE WHEN len(k) >= 2 THEN k[1] WHEN len(t) >= 2 THEN t[1] END)) AS a,
                 strip_accents(lower(CASE WHEN len(k) >= 2 THEN k[-1] WHEN len(t) >= 2 THEN t[-1] END)) AS b FROM fu),
{segments("SELECT a AS tok FROM fl UNION ALL SELECT b FROM fl")}, {AFF},
ft AS (
  SELECT fl.*, coalesce(aff.is_chinese, false) AS cna, coalesce(a IN {tuple(D.pinyin)}, false) AS ca, coalesce(b IN {tuple(D.pinyin)}, false) AS cb,
    coalesce(a IN {tuple(dims.WESTERN_SURNAMES)}, false) AS wa0, coalesce(b IN {tuple(dims.WESTERN_SURNAMES)}, false) AS wb0,
    coalesce(regexp_matches(a, '{_SUFFIX}'), false) AS xa, coalesce(regexp_matches(b, '{_SUFFIX}'), false) AS xb,
    coalesce(regexp_matches(a, '{_CLUSTER}'), false) AS ka, coalesce(regexp_matches(b, '{_CLUSTER}'), false) AS kb,
    coalesce(regexp_matches(a, '[{dims.LATIN_EXTENDED}]'), false) AS la, coalesce(regexp_matches(b, '[{dims.LATIN_EXTENDED}]'), false) AS lb,
    coalesce(sa.n, 0) AS na, coalesce(sb.n, 0) AS nb, coalesce(ra.r, 999) AS ra, coalesce(rb.r, 999) AS rb,
    len(list_filter(t, lambda x: strip_accents(lower(x)) <> lower(x))) > 0 AS dia,
    source = 'ISTINA' AS ist, source IN ('CROSSREF', 'ORCID') AS intl
  FROM fl LEFT JOIN aff ON aff.raw = fl.affiliation_raw LEFT JOIN seg sa ON sa.tok = fl.a LEFT JOIN seg sb ON sb.tok = fl.b
  LEFT JOIN ranks ra ON ra.p = fl.a LEFT JOIN ranks rb ON rb.p = fl.b),
sc AS (
  SELECT *, wa0 OR xa OR ka OR la AS wa, wb0 OR xb OR kb OR lb AS wb,
    ca AND cb AND NOT ist AND abs(ra - rb) > 20 AS far, len(t) = 2 AND cb AND NOT ca AS pair,
    {total("0.0::DOUBLE", ("ca", .4), ("cb", .2), ("na BETWEEN 2 AND 3", .2), ("nb BETWEEN 2 AND 3", .2), ("cna", .4), ("ist", .2))} AS cn,
    {total("0.0::DOUBLE", ("xa", .5), ("xb", .5), ("dia", .3), ("wb0", .5), ("ka", .3), ("kb", .3), ("intl", .2))} AS west
  FROM ft),
md AS (SELECT *, CASE WHEN cn >= west + 0.3::DOUBLE AND cn >= 0.5::DOUBLE THEN 'CHINESE' WHEN west >= cn + 0.3::DOUBLE AND west >= 0.5::DOUBLE THEN 'WESTERN' ELSE 'MIXED' END AS m FROM sc),
dl AS (
  SELECT *, CASE m WHEN 'CHINESE' THEN
      ({total(conf("chinese_prior_fam"), ("ca AND NOT cb", 2), ("ca AND cb AND NOT far", 1.5), ("far AND rb >= ra", 1.5), ("nb BETWEEN 2 AND 3", .8), ("nb = 1", .4), ("cna", .5))})
    - ({total(conf("chinese_prior_giv"), ("cb AND NOT ca", 2), ("far AND rb < ra", 1.5), ("na BETWEEN 2 AND 3", .8), ("na = 1", .4), ("cna", .5), ("pair AND intl", .7), ("pair AND NOT intl", .3))})
    WHEN 'WESTERN' THEN
      ({total(conf("western_prior_fam"), ("wa AND NOT wb", .5), ("ca AND cna", 2))})
    - ({total(conf("western_prior_giv"), ("wb", 2), ("cb AND cna", 1), ("NOT (ca OR cb OR cna)", 1))})
    ELSE ({total(conf("mixed_prior_fam"), ("ca AND cna", 1.5), ("ca AND NOT cb", 1))})
    - ({total(conf("mixed_prior_giv"), ("cb AND cna", 1.5), ("cb AND NOT ca", 1), ("NOT ca AND NOT cb", .5))}) END AS d,
    CASE m WHEN 'CHINESE' THEN {conf("threshold_cn")} WHEN 'WESTERN' THEN {conf("threshold_west")} ELSE {conf("threshold_mixed")} END AS th,
    CASE m WHEN 'CHINESE' THEN [
      CASE WHEN ca AND NOT cb THEN 'CN_SURNAME_FIRST_ONLY' END, CASE WHEN cb AND NOT ca THEN 'CN_SURNAME_LAST_ONLY' END,
      CASE WHEN ca AND cb THEN CASE WHEN ist THEN 'CN_SURNAME_DOUBLE_DEFAULT_FAM_ISTINA'
        WHEN far AND rb < ra THEN 'CN_SURNAME_DOUBLE_FREQ_LAST(' || rb || '<' || ra || ')'
        WHEN far THEN 'CN_SURNAME_DOUBLE_FREQ_FIRST(' || ra || '<' || rb || ')' ELSE 'CN_SURNAME_DOUBLE_DEFAULT_FAM' END END,
      CASE WHEN na BETWEEN 2 AND 3 THEN 'FIRST_VALID_PY_NAME(' || na || 'syl)' END, CASE WHEN nb BETWEEN 2 AND 3 THEN 'LAST_VALID_PY_NAME(' || nb || 'syl)' END,
      CASE WHEN na = 1 THEN 'FIRST_SINGLE_SYLLABLE' END, CASE WHEN nb = 1 THEN 'LAST_SINGLE_SYLLABLE' END, CASE WHEN cna THEN 'CN_AFFILIATION' END,
      CASE WHEN pair THEN CASE WHEN intl THEN 'TWO_TOKENS_CN_SURNAME_LAST_INTL' ELSE 'TWO_TOKENS_CN_SURNAME_LAST_ISTINA' END END]
    WHEN 'WESTERN' THEN [
      CASE WHEN wb THEN 'WEST_SURNAME_LAST' END, CASE WHEN wa AND NOT wb THEN 'WEST_SURNAME_FIRST' END, CASE WHEN ca AND cna THEN 'CN_SURNAME_FIRST_WITH_CN_AFFIL' END,
      CASE WHEN cb AND cna THEN 'CN_SURNAME_LAST_WITH_CN_AFFIL' END, CASE WHEN NOT (ca OR cb OR cna) THEN 'NO_CN_EVIDENCE_DEFAULT_GIVEN' END]
    ELSE [
      CASE WHEN ca AND cna THEN 'CN_SURNAME_FIRST_CN_AFFIL_MIXED' END, CASE WHEN cb AND cna THEN 'CN_SURNAME_LAST_CN_AFFIL_MIXED' END,
      CASE WHEN ca AND NOT cb THEN 'CN_SURNAME_FIRST_ONLY_MIXED' END, CASE WHEN cb AND NOT ca THEN 'CN_SURNAME_LAST_ONLY_MIXED' END,
      CASE WHEN NOT ca AND NOT cb THEN 'NO_MATCH_DEFAULT_GIVEN' END] END AS why
  FROM md),
local AS (
  SELECT record_id, source, person_id, publication_id, lastname, name_raw,
    CASE WHEN len(t) < 2 THEN {{'o': 'unknown', 'c': 0.0::DOUBLE, 'm': 'MIXED', 'r': ['INVALID_FORMAT']}}
      WHEN len(t) = 2 AND regexp_full_match(t[2], '{_SHORT}') THEN {{'o': 'family_first', 'c': 1.0::DOUBLE, 'm': 'ABBREVIATION', 'r': ['ABBREV_' || t[1] || '_' || t[2]]}}
      WHEN len(t) = 2 AND regexp_full_match(t[1], '{_SHORT}') THEN {{'o': 'given_first', 'c': 0.85::DOUBLE, 'm': 'ABBREVIATION', 'r': ['ABBREV_' || t[1] || '_' || t[2] || '_REVERSED']}}
      WHEN len(t) >= 3 AND len(list_filter(t[2:], lambda x: NOT regexp_full_match(x, '{_SHORT}'))) = 0 THEN {{'o': 'family_first', 'c': 1.0::DOUBLE, 'm': 'ABBREVIATION', 'r': ['ABBREV_' || t[1] || '_+']}}
      WHEN abs(d) < th THEN {{'o': CASE m WHEN 'WESTERN' THEN 'given_first' ELSE 'unknown' END, 'c': CASE m WHEN 'CHINESE' THEN 0.5::DOUBLE WHEN 'WESTERN' THEN 0.55::DOUBLE ELSE 0.4::DOUBLE END, 'm': m,
        'r': list_append(list_filter(why, lambda x: x IS NOT NULL), CASE m WHEN 'CHINESE' THEN 'DELTA_SMALL_CN' WHEN 'WESTERN' THEN 'FORCED_GIVEN_ON_TIE' ELSE 'DELTA_SMALL_MIXED' END)}}
      ELSE {{'o': CASE WHEN d > 0 THEN 'family_first' ELSE 'given_first' END, 'c': least(1.0::DOUBLE / (1.0::DOUBLE + exp(-abs(d))), CASE m WHEN 'MIXED' THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END), 'm': m, 'r': list_filter(why, lambda x: x IS NOT NULL)}} END AS z
  FROM dl),
p0 AS (SELECT *, z.o AS o, z.c AS c, z.m AS mo, z.r AS r FROM local),
p1 AS (SELECT *, sum((o = 'family_first' AND c >= 0.7::DOUBLE)::INT) OVER (PARTITION BY person_id) AS f, sum((o = 'given_first' AND c >= 0.7::DOUBLE)::INT) OVER (PARTITION BY person_id) AS g FROM p0),
p2 AS (SELECT *, coalesce(person_id, '') <> '' AND f + g > 0 AND (o = 'unknown' OR c < 0.6::DOUBLE) AS hit FROM p1),
q0 AS (SELECT record_id, source, publication_id, lastname, name_raw, mo, CASE WHEN hit THEN CASE WHEN f >= g THEN 'family_first' ELSE 'given_first' END ELSE o END AS o,
         CASE WHEN hit THEN greatest(c, 0.7::DOUBLE) ELSE c END AS c, CASE WHEN hit THEN list_append(r, 'PERSON_CONSISTENCY_OVERRIDE') ELSE r END AS r FROM p2),
q1 AS (SELECT *, sum((o = 'family_first' AND c >= 0.7::DOUBLE)::INT) OVER (PARTITION BY publication_id) AS f, sum((o = 'given_first' AND c >= 0.7::DOUBLE)::INT) OVER (PARTITION BY publication_id) AS g FROM q0),
q2 AS (SELECT *, coalesce(publication_id, '') <> '' AND abs(f - g) >= 2 AND o = 'unknown' AND c <= 0.5::DOUBLE AS hit FROM q1),
batch AS (SELECT record_id, source, lastname, name_raw, mo AS mode, CASE WHEN hit THEN CASE WHEN f > g THEN 'family_first' ELSE 'given_first' END ELSE o END AS ord,
         CASE WHEN hit THEN 0.65::DOUBLE ELSE c END AS confidence, CASE WHEN hit THEN list_append(r, 'PUB_PATTERN_OVERRIDE') ELSE r END AS r FROM q2)
"""

SQL = {
    "v8_local": V8 + "SELECT record_id, o AS name_order, round(c, 6) AS confidence, mo AS mode, array_to_string(r, ', ') AS reasons FROM p0",
    "v8_batch": V8 + "SELECT record_id, ord AS name_order, round(confidence, 6) AS confidence, mode, array_to_string(r, ', ') AS reasons FROM batch",
    "v8_summary": V8 + "SELECT source, ord AS name_order, mode, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM batch GROUP BY ALL",
    "v8_accuracy": V8
    + """, s AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(name_raw, '[,()\\[\\]]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM batch),
u AS (SELECT lastname, CASE ord WHEN 'family_first' THEN t[1] WHEN 'given_first' THEN t[-1] END AS guess FROM s),
v AS (SELECT sum((guess IS NOT NULL AND lower(guess) = lower(lastname))::INT)::BIGINT AS correct, sum((guess IS NOT NULL AND lower(guess) <> lower(lastname))::INT)::BIGINT AS incorrect,
        sum((guess IS NULL)::INT)::BIGINT AS undetermined FROM u)
SELECT *, round(100.0::DOUBLE * correct / (correct + incorrect), 4) AS percent FROM v""",
    "affiliations": f"WITH {AUTHORS_SQL}, {AFF} SELECT record_id, aff.is_chinese, aff.country, round(aff.confidence, 6) AS confidence FROM authors LEFT JOIN aff ON aff.raw = affiliation_raw",
    "pinyin_segments": f"""WITH RECURSIVE {SYL}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM documents), {segments("SELECT tok FROM w")}
SELECT tok AS token, n > 0 AS valid, n AS n_syllables, array_to_string(syls, ' ') AS syllables FROM seg""",
    "western_features": f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+')) AS token FROM documents)
SELECT token, regexp_matches(token, '{_SUFFIX}') AS suffix, regexp_matches(token, '{_CLUSTER}') AS cluster, regexp_matches(token, '[{dims.LATIN_EXTENDED}]') AS extended,
  token IN {tuple(dims.WESTERN_SURNAMES)} AS common, strip_accents(token) AS plain FROM w WHERE token <> ''""",
    "surname_lookups": f"""WITH {AUTHORS_SQL}, {RANK},
x AS (SELECT DISTINCT lower(lastname) AS l, lower(firstname) AS g FROM authors),
{table("va", "k, v", [(k, " ".join(v)) for k, v in dims.VARIANTS.items()])},
{table("tr", "k, h, p", [(k, *v) for k, v in dims.TRADITIONAL.items()])},
{table("fo", "k, o", D.foreign)},
{table("hz", "p, h", [(p, " ".join(h)) for p, h in D.by_pinyin.items()])}
SELECT x.l AS surname, x.g AS given, coalesce(r.r, 999) AS rank, coalesce(s.r, 999) AS given_rank,
  CASE WHEN coalesce(r.r, 999) < coalesce(s.r, 999) THEN x.l WHEN coalesce(s.r, 999) < coalesce(r.r, 999) THEN x.g END AS more_common,
  coalesce(va.v, x.l) AS readings, va.k IS NOT NULL AS is_variant, tr.h AS traditional_hanzi, tr.p AS traditional_pinyin,
  coalesce(fo.o, 'Unknown') AS origin, hz.p IS NOT NULL AS is_pinyin, coalesce(hz.h, '') AS hanzi
FROM x LEFT JOIN ranks r ON r.p = x.l LEFT JOIN ranks s ON s.p = x.g LEFT JOIN va ON va.k = x.l LEFT JOIN tr ON tr.k = x.l LEFT JOIN fo ON fo.k = x.l LEFT JOIN hz ON hz.p = x.l""",
}

# --- author filter and reports ---------------------------------------------------

_NOT_CHINESE = tuple(D.foreign_of("Japanese", "European", "Indian"))
_VARIANT = table("va", "k, v", [(k, v) for k, vs in dims.VARIANTS.items() for v in vs])
#: Whether a lower-case token {0} is a surname in its own spelling or by a standard reading.
_READS = "({0} IN " + str(tuple(D.pinyin)) + " OR {0} IN (SELECT k FROM va WHERE v IN " + str(tuple(D.pinyin)) + "))"
_TRAD = "{0} IN " + str(tuple(dims.TRADITIONAL))

VERDICT = f"""
WITH {AUTHORS_SQL}, {_VARIANT},
tk AS (SELECT *, list_filter(regexp_split_to_array(trim(regexp_replace(name_raw, '[(（][^)）]*[)）]', '', 'g')), '\\s+'), lambda x: x <> '') AS t FROM authors),
ex AS (SELECT record_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM tk),
lo AS (SELECT *, lower(w) AS l FROM ex),
jd AS (SELECT *, length(l) > 1 AND l NOT IN {_NOT_CHINESE} AND ({_TRAD.format("l")} OR {_READS.format("l")}) AS fits,
  CASE WHEN l IN {_NOT_CHINESE} THEN 'foreign_surname:' || w
       WHEN NOT contains(w, '-') AND l IN {tuple(dims.FOREIGN_GIVEN)} THEN 'foreign_name:' || w
       WHEN contains(w, '-') THEN list_filter(list_transform(string_split(w, '-'), lambda p: CASE WHEN lower(p) IN {_NOT_CHINESE} THEN 'compound_surname:' || p
         WHEN lower(p) IN {tuple(dims.FOREIGN_GIVEN)} AND length(p) > 4 THEN 'compound_name:' || p END), lambda p: p IS NOT NULL)[1] END AS bad FROM lo),
ag AS (SELECT record_id, arg_min(w, i) FILTER (WHERE fits) AS s, arg_min(bad, i) FILTER (WHERE bad IS NOT NULL) AS bad FROM jd GROUP BY 1),
verdict AS (
  SELECT tk.record_id, lastname, name_raw, CASE WHEN len(t) >= 2 THEN s IS NOT NULL AND bad IS NULL END AS is_chinese,
    CASE WHEN len(t) < 2 THEN 0.0::DOUBLE WHEN s IS NULL THEN 0.9::DOUBLE WHEN bad IS NOT NULL THEN 0.95::DOUBLE
      WHEN coalesce(len(list_filter({lit(dims.FILTER_KEYWORDS)}, lambda k: contains(lower(affiliation_raw), k))) > 0, false) THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS confidence,
    CASE WHEN name_raw = '' THEN 'empty' WHEN len(t) < 2 THEN 'incomplete' WHEN s IS NULL THEN 'no_surname' WHEN bad IS NOT NULL THEN bad
      WHEN {_TRAD.format("lower(s)")} THEN 'traditional:' || s ELSE 'pinyin:' || s END AS reason,
    CASE WHEN len(t) >= 2 THEN s END AS surname_token
  FROM tk LEFT JOIN ag USING (record_id))
"""
_KNOWN_LAST = f"({_TRAD.format('lower(lastname)')} OR {_READS.format('lower(lastname)')})"

SQL |= {
    "author_verdicts": VERDICT + "SELECT record_id, is_chinese, confidence, reason, surname_token FROM verdict",
    "class_shares": VERDICT + "SELECT is_chinese, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM verdict WHERE is_chinese IS NOT NULL GROUP BY 1",
    "exclusion_reasons": VERDICT + "SELECT string_split(reason, ':')[1] AS kind, count(*) AS n FROM verdict WHERE NOT coalesce(is_chinese, false) GROUP BY 1",
    "false_positives": VERDICT + f"SELECT record_id, lastname, name_raw, reason FROM verdict WHERE is_chinese AND lastname <> '' AND NOT {_KNOWN_LAST}",
    "wrongly_excluded": VERDICT + f"SELECT record_id, lastname, name_raw, reason FROM verdict WHERE NOT coalesce(is_chinese, false) AND lastname <> '' AND {_KNOWN_LAST}",
}

# --- the earlier generations -------------------------------------------------------

_PATTERN = """CASE WHEN contains({0}, '-') THEN true WHEN length({0}) >= 6 AND len(regexp_extract_all(lower({0}), '[aeiou]+')) >= 2 THEN true
  WHEN length({0}) <= 4 AND len(regexp_extract_all(lower({0}), '[aeiou]+')) <= 2 THEN false ELSE regexp_matches(lower({0}), 'ing|ang|ong|eng|iao|ian|uan|uang') END"""
SQL["v3"] = f"""
WITH {AUTHORS_SQL}, {_VARIANT}, {RANK},
tk AS (SELECT *, list_filter(regexp_split_to_array(name_raw, '\\s+'), lambda x: x <> '') AS t FROM authors),
ab AS (SELECT *, t[1] AS a, t[-1] AS b, lower(t[1]) AS la, lower(t[-1]) AS lb FROM tk),
sg AS (SELECT ab.*, {_READS.format("la")} AS sa, {_READS.format("lb")} AS sb, coalesce(r.r, 999) AS ra, coalesce(q.r, 999) AS rb, {_PATTERN.format("a")} AS pa, {_PATTERN.format("b")} AS pb,
  coalesce(len(list_filter(['china', 'chinese', 'beijing', 'shanghai', 'guangzhou', 'tsinghua', 'peking university', 'fudan'], lambda k: contains(lower(affiliation_raw), k))) > 0, false) AS aff
  FROM ab LEFT JOIN ranks r ON r.p = la LEFT JOIN ranks q ON q.p = lb),
cf AS (SELECT *, {total("0.0::DOUBLE", ("sb", .6), ("sa", .3), ("sa AND sb AND abs(ra - rb) >= 30 AND rb < ra", .4), ("sa AND sb AND abs(ra - rb) >= 30 AND ra < rb", .2), ("len(t) = 2 AND pa <> pb", .4), ("aff", .3))} AS c FROM sg)
SELECT record_id,
  CASE WHEN len(t) < 2 THEN 'unknown' WHEN lb IN {_NOT_CHINESE} OR la IN {_NOT_CHINESE} THEN 'given_first' WHEN sb AND c >= 0.6::DOUBLE THEN 'family_first' WHEN sa AND NOT sb THEN 'given_first' ELSE 'unknown' END AS name_order,
  round(CASE WHEN len(t) < 2 THEN 0.0::DOUBLE WHEN lb IN {_NOT_CHINESE} THEN 0.95::DOUBLE WHEN la IN {_NOT_CHINESE} THEN 0.9::DOUBLE WHEN sb AND c >= 0.6::DOUBLE THEN c WHEN sa AND NOT sb THEN c * 0.7::DOUBLE ELSE c END, 6) AS confidence
FROM cf"""

_COMMON = tuple(dims.WESTERN_SURNAMES)


def _west(c: str) -> str:
    return f"(regexp_matches(lower({c}), '{_SUFFIX}') OR regexp_matches(lower({c}), '{_CLUSTER}') OR regexp_matches(lower({c}), '[{dims.LATIN_EXTENDED}]'))"


SQL["v7"] = f"""
WITH RECURSIVE {AUTHORS_SQL}, {SYL},
tk AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(name_raw, '[,()\\[\\]]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM authors),
cl AS (SELECT *, list_filter(t, lambda x: NOT regexp_full_match(x, '{_SHORT}')) AS k FROM tk),
ab AS (SELECT *, CASE WHEN len(k) < 2 THEN t[1] ELSE k[1] END AS a, CASE WHEN len(k) < 2 THEN t[-1] ELSE k[-1] END AS b FROM cl),
{segments("SELECT a AS tok FROM ab UNION ALL SELECT b FROM ab")}, {AFF},
ft AS (SELECT ab.*, lower(a) IN {tuple(D.pinyin)} AS ca, lower(b) IN {tuple(D.pinyin)} AS cb, {_west("a")} AS wa, {_west("b")} AS wb, lower(a) IN {_COMMON} AS ma, lower(b) IN {_COMMON} AS mb,
  sa.n AS na, sb.n AS nb, coalesce(aff.is_chinese, false) AS cn_aff, coalesce(NOT aff.is_chinese, false) AS other,
  CASE WHEN sa.n = 0 THEN 0.0 WHEN sa.n BETWEEN 2 AND 3 THEN 0.8 WHEN sa.n = 1 AND length(a) <= 4 THEN 0.5 WHEN sa.n >= 4 THEN 0.2 ELSE 0.0 END AS ga,
  CASE WHEN sb.n = 0 THEN 0.0 WHEN sb.n BETWEEN 2 AND 3 THEN 0.8 WHEN sb.n = 1 AND length(b) <= 4 THEN 0.5 WHEN sb.n >= 4 THEN 0.2 ELSE 0.0 END AS gb
  FROM ab LEFT JOIN seg sa ON sa.tok = a LEFT JOIN seg sb ON sb.tok = b LEFT JOIN aff ON aff.raw = affiliation_raw),
sc AS (SELECT *, least({total("0.0::DOUBLE", ("ca", .6), ("cb", .6), ("na BETWEEN 2 AND 3", .2), ("nb BETWEEN 2 AND 3", .2), ("cn_aff", .3), ("regexp_matches(name_raw, '[一-鿿]')", .8))}, 1.0::DOUBLE) AS cn,
  least({total("0.0::DOUBLE", *[(f"regexp_matches(lower({c}), '{p}')", .3) for p in (_CLUSTER, f"[{dims.LATIN_EXTENDED}]", _SUFFIX) for c in "ab"], ("ma", .4), ("mb", .4), ("other", .2))}, 1.0::DOUBLE) AS west FROM ft),
md AS (SELECT *, CASE WHEN cn >= 0.7::DOUBLE AND cn >= west + 0.2::DOUBLE THEN 'Chinese' WHEN west >= 0.7::DOUBLE AND west >= cn + 0.2::DOUBLE THEN 'Western' ELSE 'Mixed' END AS m FROM sc),
rs AS (SELECT record_id, m, CASE
  WHEN len(t) < 2 THEN {{'o': 'unknown', 'c': 0.0::DOUBLE}}
  WHEN (len(t) = 2 AND regexp_full_match(t[2], '{_SHORT}')) OR (len(t) >= 3 AND len(list_filter(t[2:], lambda x: NOT regexp_full_match(x, '{_SHORT}'))) = 0) THEN {{'o': 'family_first', 'c': 1.0::DOUBLE}}
  WHEN m = 'Chinese' AND ca AND NOT cb THEN {{'o': 'family_first', 'c': least({total("0.6::DOUBLE", ("gb > 0.5", .3), ("cn_aff", .2))}, 1.0::DOUBLE)}}
  WHEN m = 'Chinese' AND cb AND NOT ca THEN {{'o': 'given_first', 'c': least({total("0.6::DOUBLE", ("ga > 0.5", .3), ("cn_aff", .2))}, 1.0::DOUBLE)}}
  WHEN m = 'Chinese' AND ca THEN {{'o': 'family_first', 'c': 0.7::DOUBLE}}
  WHEN m = 'Chinese' THEN {{'o': 'unknown', 'c': CASE WHEN cn >= 0.5::DOUBLE THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END}}
  WHEN m = 'Western' AND (wb OR mb) THEN {{'o': 'given_first', 'c': CASE WHEN wa THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END}}
  WHEN m = 'Western' AND (wa OR ma) THEN {{'o': 'family_first', 'c': 0.6::DOUBLE}}
  WHEN m = 'Western' AND cn < 0.6::DOUBLE THEN {{'o': 'given_first', 'c': CASE WHEN cn < 0.3::DOUBLE THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END}}
  WHEN m = 'Western' THEN {{'o': 'unknown', 'c': 0.4::DOUBLE}}
  WHEN ca AND NOT cb THEN {{'o': 'family_first', 'c': 0.6::DOUBLE}} WHEN cb AND NOT ca THEN {{'o': 'given_first', 'c': 0.6::DOUBLE}}
  WHEN NOT ca THEN {{'o': 'given_first', 'c': 0.5::DOUBLE}} ELSE {{'o': 'unknown', 'c': 0.4::DOUBLE}} END AS z FROM md)
SELECT record_id, z.o AS name_order, round(z.c, 6) AS confidence, m AS mode FROM rs"""


# --- institutions, index, sample ------------------------------------------------------

_INST = institutions.KEYWORDS
_ALL = lit(sorted({w for ws in _INST.values() for w in ws}))
SQL |= {
    "institutions_found": f"""WITH {AUTHORS_SQL}, k AS (SELECT record_id, lower(coalesce(affiliation_raw, '')) AS low FROM authors),
m AS (SELECT record_id, list_filter({_ALL}, lambda w: contains(low, w)) AS w FROM k)
SELECT record_id, len(w) > 0 AS found, array_to_string(w, '|') AS keywords,
  CASE WHEN len(w) = 0 THEN 0.0 WHEN list_has_any(w, {lit(_INST["top_university"])}) THEN 0.9 WHEN list_has_any(w, {lit(_INST["research"])}) THEN 0.85
    WHEN len(w) >= 3 THEN 0.8 WHEN len(w) = 2 THEN 0.75 WHEN list_has_all({lit(_INST["country"])}, w) THEN 0.65 ELSE 0.7 END::DOUBLE AS confidence FROM m""",
    "surname_index": f"WITH {table('s', 'hanzi, pinyin', D.surnames)} SELECT pinyin, array_to_string(list_sort(list_distinct(list(hanzi))), ' ') AS hanzi FROM s GROUP BY 1",
    "author_sample": f"WITH {AUTHORS_SQL} SELECT record_id, name_raw FROM authors ORDER BY md5(record_id), record_id LIMIT 100",
    "version_disagreement": f"""SELECT v3.name_order AS v3, v7.name_order AS v7, v8.name_order AS v8, count(*) AS n
FROM ({SQL["v3"]}) v3 JOIN ({SQL["v7"]}) v7 USING (record_id) JOIN ({SQL["v8_local"]}) v8 USING (record_id) GROUP BY ALL""",
}
