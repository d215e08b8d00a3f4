"""DuckDB forms of the queries over names of several scripts, lists and transliterations."""

from __future__ import annotations

from namelens.functions import dims
from namelens.plans.authors import AUTHORS_SQL, NAMES_SQL
from namelens.plans.sql import SQL as OLDER
from namelens.plans.sql import lit, table

D = dims.DEFAULT
#: A word character, and a character that is none, in Unicode.
W, N = r"[\p{L}\p{M}\p{Nd}\p{Pc}]", r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
HANZI = "一-鿿"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean(x: str) -> str:
    head = rf"regexp_replace({strip(x)}, '^[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}{HANZI}]+', '')"
    return rf"regexp_replace({head}, '({W}{{2,}})-({W}{{2,}})', '\1 \2', 'g')"


def parts(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({clean(f'coalesce({x}, {chr(39) * 2})')}, '[\s\-]+'), lambda p: p <> '')"


def given(x: str) -> str:
    frequent = lit([k for k, v in dims.GIVEN_FREQUENCY.items() if v >= 30])
    return (
        f"(list_contains({frequent}, {x}) OR regexp_matches({x}, '(?i)^({W}|[jy][aeiou]|s?ch|мл|jr|ts|[kpstz]h)({N}|$)') "
        f"OR regexp_matches({x}, '(?i){W}+(ич|вна|инична|ovich|evich|ovna|evna)({N}|$)') OR length(regexp_replace({x}, '{N}', '', 'g')) = 1)"
    )


KNOWN = f"""known(x) AS MATERIALIZED (
  SELECT x FROM tokens WHERE list_contains({lit(D.pinyin)}, lower(x)) OR list_contains({lit(D.by_cyrillic)}, lower(x))
    OR len(list_filter({lit(D.hanzi)}, lambda h: starts_with(x, h))) > 0)"""


def orders(source: str) -> str:
    """CTEs that end in ord (name, o, parts, ord): every distinct name of source with the order of its parts."""
    return rf"""
raw AS (SELECT DISTINCT name FROM ({source})),
cut AS (SELECT name, list_filter(regexp_split_to_array(coalesce(name, ''), '\s+'), lambda w: w <> '') AS o, {parts('name')} AS parts FROM raw),
up AS (SELECT *, list_transform(parts, lambda p: upper(p)) AS p, replace(upper(o[1]), '-', '') AS oa, replace(upper(o[-1]), '-', '') AS ob FROM cut),
tokens(x) AS (SELECT DISTINCT unnest(list_concat(p, [oa, ob], parts)) FROM up),
{KNOWN},
lst AS (SELECT list(x) AS k FROM known),
flag AS (SELECT *, list_transform(p, lambda x: {given('x')}) AS g, coalesce(contains(o[1], '-'), false) AS ha, coalesce(contains(o[-1], '-'), false) AS hb,
  coalesce(list_contains(k, p[1]), false) AS sa, coalesce(list_contains(k, p[-1]), false) AS sb, coalesce(list_contains(k, oa), false) AS ka, coalesce(list_contains(k, ob), false) AS kb FROM up, lst),
ord AS (SELECT *, CASE
  WHEN len(o) >= 2 AND ha AND NOT hb AND kb THEN -1 WHEN len(o) >= 2 AND NOT ha AND hb AND ka THEN 1 WHEN len(p) < 2 THEN 0
  WHEN len(p) = 2 AND length(p[2]) <= 3 AND ends_with(p[2], '.') AND regexp_matches(p[2], '^\p{{L}}') AND sa THEN 1
  WHEN sa AND NOT sb THEN 1 WHEN sb AND NOT sa THEN -1
  WHEN sa THEN CASE WHEN len(p) > 2 AND list_contains(g[2:len(p) - 1], true) THEN 1 WHEN g[2] THEN 1 ELSE 0 END
  WHEN NOT list_contains(g, true) THEN 0 WHEN g[1] THEN -1 ELSE 1 END AS ord FROM flag)"""


LABEL = "CASE ord WHEN 1 THEN 'SURNAME_FIRST' WHEN -1 THEN 'GIVEN_NAME_FIRST' ELSE 'UNDETERMINED' END"
DETAILS = f"""
det AS (SELECT *, len(parts) >= 2 AND ord = 0 AND NOT coalesce(list_contains(k, parts[1]), false) AND NOT coalesce(list_contains(k, parts[-1]), false) AS foreign_ FROM ord),
details AS (SELECT name, ord::INT AS name_order, {LABEL} AS detected_order, array_to_string(parts, '|') AS parts, foreign_ AS is_non_chinese,
  array_to_string(list_transform(g, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS given,
  CASE WHEN foreign_ THEN 0.3 WHEN list_contains(g, true) THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM det)"""


def lists(source: str) -> str:
    """CTEs over source (list_id, authors) that end in parsed, a row for each author."""
    return rf"""
src AS (SELECT row_number() OVER () AS l, list_id, {clean("coalesce(authors, '')")} AS s FROM ({source})),
one AS (SELECT l, list_id, list_filter(list_transform(regexp_split_to_array(s, CASE WHEN regexp_matches(s, '[;；]') THEN '[;；]' ELSE '[,，]' END), lambda x: {strip('x')}), lambda x: x <> '') AS a FROM src),
each AS (SELECT l, list_id, unnest(a) AS name, unnest(range(len(a))) AS position FROM one),
{orders('SELECT name FROM each')},
placed AS (SELECT each.*, ord, ord.parts AS p FROM each JOIN ord USING (name)),
vote AS (SELECT l, sign(sum(ord))::INT AS vote FROM placed WHERE position > 0 GROUP BY l),
used AS (SELECT placed.*, CASE WHEN position = 0 THEN ord ELSE coalesce(vote, 0) END AS used FROM placed LEFT JOIN vote USING (l)),
parsed AS (SELECT list_id, position::INT AS position, name AS author, used::INT AS used_order,
  CASE WHEN used >= 0 THEN p[1] ELSE p[-1] END AS surname, CASE WHEN used >= 0 THEN coalesce(p[2], '') WHEN len(p) > 1 THEN p[1] ELSE '' END AS given_name,
  array_to_string(CASE WHEN used >= 0 THEN p[3:] ELSE p[2:len(p) - 1] END, ' ') AS middle_name, position = 0 AS is_first_author FROM used WHERE len(p) > 0)"""


_FIRST: dict[str, str] = {}
for _h, _p in D.surnames:
    _FIRST.setdefault(_h, _p)
_MAPS = f"""
sur(h) AS (VALUES {", ".join(f"('{h}')" for h in D.hanzi)}),
{table("rd", "ch, reading", [(h, p) for h, p in _FIRST.items() if len(h) == 1])},
{table("pal", "py, cyr", dims.PALLADIUS.items())},
chars AS (SELECT h, unnest(string_split(h, '')) AS ch, unnest(range(length(h))) AS i FROM sur),
red AS (SELECT h, i, coalesce(reading, ch) AS r, coalesce(cyr, reading, ch) AS c FROM chars LEFT JOIN rd USING (ch) LEFT JOIN pal ON py = coalesce(reading, ch)),
tr AS (SELECT h, string_agg(upper(r), ' ' ORDER BY i) AS reading, string_agg(c, '' ORDER BY i) AS joined, string_agg(c, ' ' ORDER BY i) AS spaced FROM red GROUP BY h)"""
_CAP = "upper(left({0}, 1)) || substr({0}, 2)"
_LISTS = f"SELECT publication_id AS list_id, string_agg(replace(name_raw, ',', ''), '; ' ORDER BY record_id::BIGINT, replace(name_raw, ',', '')) AS authors FROM authors GROUP BY 1"
_MIXED = """SELECT CASE WHEN name_id % 3 <> 0 THEN CASE WHEN name_id % 7 = 0 THEN -1 ELSE name_id END END::BIGINT AS list_id,
  CASE WHEN name_id % 5 = 0 THEN concat_ws(', ', other, replace(name, ',', ' ')) ELSE concat_ws('; ', name, other, CASE WHEN name_id % 2 = 0 THEN name END) END AS authors FROM names"""
_PARSED = "list_id, position, author, used_order, surname, given_name, middle_name, is_first_author"
_SPLIT = rf"list_filter(regexp_split_to_array({{0}}, '[.,;\s+]'), lambda x: x <> '')"
_TWO = lit([h for h in D.hanzi if len(h) == 2])

SQL = {
    "name_orders": f"WITH {AUTHORS_SQL}, {orders('SELECT name_raw AS name FROM authors')}, {DETAILS} SELECT record_id, name_order, detected_order, parts, is_non_chinese, confidence FROM authors JOIN details ON name_raw IS NOT DISTINCT FROM name",
    "mixed_name_orders": f"WITH {NAMES_SQL}, {orders('SELECT name FROM names')}, {DETAILS} SELECT name_id, name_order, detected_order, parts, given, is_non_chinese, confidence FROM names JOIN details ON names.name IS NOT DISTINCT FROM details.name",
    "author_list_parsing": f"WITH {AUTHORS_SQL}, {lists(_LISTS)} SELECT {_PARSED} FROM parsed",
    "mixed_lists": f"WITH {NAMES_SQL}, {lists(_MIXED)} SELECT {_PARSED} FROM parsed",
    "processed_orders": f"""WITH {NAMES_SQL}, {orders('SELECT name FROM names')}
SELECT name_id, array_to_string({_SPLIT.format(strip("coalesce(names.name, '')"))}, '|') AS parts, ord::INT AS name_order, {LABEL} AS detected_order, 0.8::DOUBLE AS confidence
FROM names JOIN ord ON names.name IS NOT DISTINCT FROM ord.name""",
    "processed_names": f"""WITH {NAMES_SQL}, s AS (SELECT name_id, {strip("coalesce(name, '')")} AS s FROM names),
k AS (SELECT *, regexp_full_match(s, '[{HANZI}]+') AS hanzi, CASE WHEN list_contains({_TWO}, left(s, 2)) THEN 2 ELSE 1 END AS n, {_SPLIT.format("lower(s)")} AS p FROM s),
c AS (SELECT name_id, CASE WHEN hanzi THEN left(s, n) WHEN len(p) > 0 THEN {_CAP.format("p[1]")} ELSE '' END AS surname,
  CASE WHEN hanzi THEN substr(s, n + 1) WHEN len(p) > 0 THEN {_CAP.format("array_to_string(p[2:], ' ')")} ELSE '' END AS first_name FROM k)
SELECT name_id, surname, first_name, CASE WHEN list_contains({lit(D.hanzi)}, surname) THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM c""",
    "scripts": rf"""WITH {NAMES_SQL}, c AS (SELECT *, {clean('name')} AS clean, split_part({clean("coalesce(name, '')")}, ' ', 1) AS head FROM names),
tokens(x) AS (SELECT DISTINCT head FROM c), {KNOWN}
SELECT name_id, CASE WHEN regexp_matches(name, '[{HANZI}]') THEN 'CJK' WHEN regexp_matches(name, '[Ѐ-ӿ]') THEN 'CYRILLIC' ELSE 'LATIN' END AS script,
  coalesce(regexp_matches(name, '[{HANZI}]'), false) AS has_hanzi, coalesce(regexp_full_match(name, '[{HANZI}]+'), false) AS all_hanzi,
  regexp_full_match(left({strip("coalesce(name, '')")}, 1), '[一-鿾]') AS first_is_hanzi, clean,
  {strip(r"regexp_replace(regexp_replace(name, '[(（][^)）]*[)）]', '', 'g'), '\s+', ' ', 'g')")} AS without_parentheses,
  coalesce(list_contains({lit(dims.AMBIGUOUS)}, lower({strip('name')})), false) AS ambiguous, head IN (SELECT x FROM known) AS known_first FROM c""",
    "transliterations": f"""WITH {_MAPS}
SELECT h AS hanzi, reading, {_CAP.format("joined")} AS cyrillic, {_CAP.format("spaced")} AS cyrillic_spaced, upper(left(joined, 1)) || lower(substr(joined, 2)) AS cyrillic_surname,
  (SELECT max_by(s.h, length(s.h)) FROM sur s WHERE starts_with(tr.h || '某', s.h)) AS surname FROM tr""",
    "palladius_table": f"WITH {table('pal', 'pinyin, cyrillic', dims.PALLADIUS.items())} SELECT pinyin, cyrillic FROM pal",
    "surname_index_cyrillic": f"WITH {_MAPS} SELECT lower(joined) AS cyrillic, array_to_string(list_sort(list(h)), ' ') AS hanzi FROM tr GROUP BY 1",
    "syllables": f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)
SELECT token, list_contains({lit(dims.SYLLABLES)}, token) AS syllable, list_contains({lit(dims.GIVEN_SYLLABLES)}, token) AS given FROM t""",
    "validation_report": f"""WITH v AS ({OLDER["author_verdicts"]}), a AS ({OLDER["v8_accuracy"]}),
n AS (SELECT count(*) AS total_authors, count(*) FILTER (is_chinese) AS chinese_count, count(*) FILTER (NOT coalesce(is_chinese, false)) AS non_chinese_count,
  (SELECT count(*) FROM ({OLDER["wrongly_excluded"]})) AS wrongly_excluded_count, (SELECT count(*) FROM ({OLDER["false_positives"]})) AS false_positive_count FROM v)
SELECT n.*, percent AS surname_accuracy, round(100.0::DOUBLE * incorrect / (correct + incorrect), 4) AS surname_error_rate,
  CASE WHEN 100.0 * wrongly_excluded_count / non_chinese_count < 2 THEN 'excellent' WHEN 100.0 * wrongly_excluded_count / non_chinese_count < 5 THEN 'good' ELSE 'needs work' END AS screening_grade,
  CASE WHEN percent > 98 THEN 'excellent' WHEN percent > 95 THEN 'good' ELSE 'needs work' END AS surname_grade FROM n, a""",
}
