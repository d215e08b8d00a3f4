"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.llm.common import table
from namelens.llm.licenses import TEMPLATES


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm.quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm.cotraining import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm.source_mixing import taken_words

    return taken_words(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm.chat_format import digests, format_chats

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return digests(format_chats(rows.unionByName(extra), tokenizer_path()))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm.substring_dedup import removed_digests

    return removed_digests(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"), size=None)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_quality_classifier, op3_toxicity, op4_license_scan, op5_source_mixing,
        op6_ngram_join, op7_chat_format, op8_substring_dedup, op9_best_fit_packing, op10_fingerprints,
    )
}

def licence_sql(rows: list[tuple[str, str]]) -> str:
    """The licence scan over documents with these templates."""
    quoted = lambda x: "'" + " ".join(x.split()).replace("'", "''") + "'"
    values = ",\n  ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(rows))
    return rf"""
WITH t(id, licence, template) AS (VALUES
  {values}),
tw AS (SELECT id, licence, string_split(trim(regexp_replace(lower(template), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t),
tg AS (SELECT id, licence, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS grams FROM tw),
tb AS (SELECT *, len(grams) AS size, ceil(round(len(grams) * 0.85 / 1.15, 9)) AS low, floor(round(len(grams) * 1.15 / 0.85, 9)) AS high FROM tg),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT r, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS g FROM d),
u AS (SELECT r, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
h AS (SELECT r, id, i, x FROM u JOIN (SELECT id, unnest(grams) AS x FROM tb) USING (x)),
c AS (SELECT r, id FROM h JOIN tb USING (id) GROUP BY r, id, low HAVING count(DISTINCT x) >= min(ceil(round(0.85 * (size + low) / 2, 9)))),
k AS (SELECT r, id, i FROM h SEMI JOIN c USING (r, id)),
p AS (
  SELECT a.r AS r, a.i AS s, e.i AS e, licence, 2.0::DOUBLE * len(list_intersect(g[a.i:e.i], grams)) / (len(list_distinct(g[a.i:e.i])) + size) AS dice
  FROM k a JOIN k e ON a.r = e.r AND a.id = e.id AND e.i >= a.i JOIN tb ON tb.id = a.id JOIN g ON g.r = a.r
  WHERE e.i - a.i + 1 BETWEEN low AND high),
m AS (SELECT *, s > coalesce(max(e) OVER (PARTITION BY r ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM p WHERE dice >= 0.85::DOUBLE),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY r ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS notice FROM m),
b AS (SELECT r, notice, min({{'d': -dice, 'licence': licence}}) AS best FROM n GROUP BY r, notice),
o AS (SELECT r, min(best) AS best, count(*) AS n_matches, array_to_string(list_sort(list(DISTINCT best.licence)), ',') AS licences FROM b GROUP BY r)
SELECT doc_id, best.licence AS licence, round(-best.d, 6) AS dice, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licences, '') AS licences
FROM d LEFT JOIN o USING (r)
"""


ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": licence_sql(TEMPLATES),
    "op7_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length('<s>[INST] ') + length(' [/INST]') + length('</s>')
         + length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]'))
         + length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]')) AS chars
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, sum(chars)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""",
    "op8_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS k,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
x AS (SELECT r, k, unnest([{'i': i, 'g': array_to_string(w[i:i + 12], ' ')} FOR i IN range(1, len(w) - 11)]) AS x FROM d),
f AS (SELECT x.g AS g, min(k) AS first FROM x GROUP BY x.g),
late AS (SELECT r, x.i AS i FROM x JOIN f ON x.x.g = f.g WHERE k > first),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM late),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
""",
    "op6_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END)) AS g
  FROM w),
c AS (SELECT g, min(doc_id) AS least, row_number() OVER () AS c FROM g WHERE len(g) > 0 GROUP BY g),
t AS (SELECT c, len(g) AS n, unnest(g) AS t FROM c),
link AS (
  SELECT x.c AS a, y.c AS b FROM t x JOIN t y ON x.t = y.t AND x.c <> y.c
  GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS c, min(least) AS component_id FROM reach JOIN c ON reach.b = c.c GROUP BY a),
links AS (SELECT a AS c, count(*) AS n_links FROM link GROUP BY a)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, CASE WHEN len(g.g) > 0 THEN component_id ELSE g.doc_id END AS component_id,
       coalesce(n_links, 0)::BIGINT AS n_links
FROM g LEFT JOIN c USING (g) LEFT JOIN least USING (c) LEFT JOIN links USING (c)
""",
    "op5_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS shuffled
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
x AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM w),
y AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(n) FROM s)::DOUBLE
           - coalesce(sum(2.0::DOUBLE * n) OVER o, 0) AS left_over,
         (SELECT sum(weight) FROM x) - coalesce(sum(weight) OVER o, 0) AS left_weight
  FROM x WINDOW o AS (ORDER BY 2.0::DOUBLE * n / weight, weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, left_over / left_weight AS level, 2.0::DOUBLE * n <= left_over / left_weight * weight AS full_up FROM y),
l AS (SELECT min(level) AS level FROM z WHERE NOT full_up
        AND 2.0::DOUBLE * n / weight = (SELECT min(2.0::DOUBLE * n / weight) FROM z WHERE NOT full_up)),
t AS (SELECT source, n, i, CASE WHEN full_up THEN 2.0::DOUBLE * n ELSE l.level * weight END AS target FROM z LEFT JOIN l ON true),
tot AS (SELECT sum(target ORDER BY i) AS total, greatest(1, least(2048, floor(sum(target ORDER BY i) / 200000)::BIGINT)) AS block FROM t),
c AS (
  SELECT t.*, total, block, CASE WHEN i >= (SELECT max(i) FROM t WHERE target > 0) THEN 2147483648
         ELSE round_even(sum(target) OVER (ORDER BY i) / total * 2147483648.0, 0)::BIGINT END AS high
  FROM t, tot),
share AS (SELECT *, coalesce(lag(high) OVER (ORDER BY i), 0) AS low, ((n + block - 1) // block)::BIGINT AS blocks FROM c),
slot AS (SELECT k, (((k + 1) % 2147483648) * 1327217885) % 2147483648 AS point
         FROM (SELECT unnest(range(ceil((SELECT total / block FROM tot))::BIGINT)) AS k)),
r AS (SELECT i, blocks, row_number() OVER (PARTITION BY i ORDER BY k) - 1 AS rank
      FROM slot JOIN share ON point >= low AND point < high),
took AS (SELECT i, rank % blocks AS b, count(*) AS times FROM r WHERE blocks > 0 AND rank < 2 * blocks GROUP BY ALL),
pos AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffled, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
part AS (
  SELECT pos.doc_id, pos.source, pos.size, i, b.b AS b, least(start + size, (b.b + 1) * block) - greatest(start, b.b * block) AS len
  FROM pos JOIN share ON pos.source IS NOT DISTINCT FROM share.source,
       LATERAL (SELECT unnest(range(start // block, (start + size - 1) // block + 1)) AS b) b
  WHERE size > 0),
taken AS (SELECT doc_id, source, size, sum(len * times) AS taken FROM part JOIN took USING (i, b) GROUP BY ALL)
SELECT d.doc_id, d.size, share.n AS source_size, share.target, coalesce(taken.taken, 0)::BIGINT AS taken
FROM d JOIN share ON d.source IS NOT DISTINCT FROM share.source
LEFT JOIN taken ON taken.doc_id IS NOT DISTINCT FROM d.doc_id AND taken.source IS NOT DISTINCT FROM d.source AND taken.size = d.size
""",
}
