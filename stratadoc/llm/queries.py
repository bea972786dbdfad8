"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm import alignment, decontaminate, hard_negatives, hmm_lm, jaccard_join, licenses, line_dedup, media, mixing, simhash, substring_dedup, token_counts, toxicity
from stratadoc.session import saved, table

#: The tokenizer whose counts op10 returns, and the one that op11 aligns it with.
TOKENIZER = "byte_bpe_50k.json"
OTHER_TOKENIZER = "piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_rows(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_rows(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_rows(
        decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_rows(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots", "spans")


def op7_hmm_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.language_model_scores(table(spark, sf_dir, "documents"))


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "spans")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, then ten thousands and hundreds of ids; a row for each document."""
    docs, id_ = table(spark, sf_dir, "documents"), F.col("doc_id")
    part = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    path = F.concat_ws("/", part(F.col("source")), part(F.floor(id_ / 10000)), part(F.floor(id_ / 100)), part(id_))
    found = saved(licenses.license_scan(docs.select(path.alias("path"), "text")), "licenses")
    return docs.select("doc_id", path.alias("path")).join(found, "path").select("doc_id", *found.columns)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # The setting names a folder that outlives the run; without it the cache is this run's own.
    cache = spark.conf.get("spark.stratadoc.tokenCache", None)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(OTHER_TOKENIZER))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_line_dedup, op2_media_columns, op3_simhash_near_dedup, op4_benchmark_decontamination, op5_substring_dedup, op6_source_mixing,
        op7_hmm_lm_scoring, op8_crf_toxicity, op9_license_scan, op10_token_counts, op11_tokenizer_alignment,
        op12_jaccard_join, op13_hard_negatives,
    ]
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, coalesce('s' || source, '') AS site, i, ls[i] AS line,
         trim(regexp_replace(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
  FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)
), wide AS (
  SELECT k, min({'d': doc_id, 'i': i}) AS first FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.line, w.k IS NOT NULL AND {'d': l.doc_id, 'i': l.i} <> w.first AS gone
  FROM lines l LEFT JOIN wide w ON l.k = w.k
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

OP4_SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), listed AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM listed, sizes WHERE len(w) >= n)
), hits AS (
  SELECT d.doc_id, d.n, d.i, item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.win = b.win
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM listed l LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


OP5_SQL = r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM listed WHERE len(w) >= 20)
), firsts AS (SELECT win, min({'d': doc_id, 'i': i}) AS first FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p
  FROM windows JOIN firsts USING (win) WHERE first <> {'d': doc_id, 'i': i}
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM listed),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS text
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k USING (doc_id)
"""


OP9_SQL = rf"""
WITH templates(template, license, text) AS (VALUES {", ".join("(%d, '%s', '%s')" % (i, a, b.replace("'", "''")) for i, (a, b) in enumerate(licenses.TEMPLATES))}),
files AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(CAST(doc_id // 10000 AS VARCHAR), 'none') || '/'
         || coalesce(CAST(doc_id // 100 AS VARCHAR), 'none') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'none') AS path, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), template_terms AS (
  SELECT template, license, identifier, term, count(*) AS tf
  FROM (SELECT template, license, starts_with(text, '{licenses.IDENTIFIER}') AS identifier, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(low, '[a-z0-9]+'))) AS term FROM files)
  WHERE term IN (SELECT term FROM template_terms) GROUP BY term
), n AS (SELECT count(*) AS n FROM files),
raw AS (
  SELECT template, license, identifier, term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf, tf * idf AS r
  FROM template_terms LEFT JOIN df USING (term), n
), weights AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY template)) AS w FROM raw),
known AS (SELECT term, any_value(idf) AS idf FROM weights GROUP BY term), split AS (SELECT path, hash(text) AS key, length(text) AS total, string_split(low, chr(10)) AS ls FROM files WHERE low IS NOT NULL),
cued AS (
  SELECT DISTINCT path, key, total, i - 1 AS line_no, ls[i] AS line, ls[greatest(i - 1, 1):i + 1] AS near, array_to_string(ls[i:i + {licenses.PASSAGE_LINES - 1}], ' ') AS ahead
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM split) WHERE regexp_matches(ls[i], '{licenses.CUES}')
), headers AS (
  SELECT DISTINCT path, hash(text) AS key, length(text) AS total, string_split(low, chr(10) || chr(10))[1] AS header FROM files
  WHERE contains(low, chr(10) || chr(10)) AND regexp_matches(string_split(low, chr(10) || chr(10))[1], '{licenses.CUES}')
), units AS (
  SELECT path, key, 'line' AS kind, line_no, length(line) AS n_chars, total, line AS txt FROM cued
  UNION ALL SELECT path, key, 'neighbours', line_no, length(line), total, array_to_string(near, ' ') FROM cued
  UNION ALL SELECT path, key, 'passage', line_no, length(ahead), total, ahead FROM cued WHERE regexp_matches(line, '{licenses.PASSAGE_CUES}')
  UNION ALL SELECT path, key, 'header', 0, length(header), total, header FROM headers
), tf AS (
  SELECT path, key, kind, line_no, n_chars, total, term, count(*) AS tf
  FROM (SELECT * EXCLUDE txt, unnest(regexp_extract_all(txt, '[a-z0-9]+')) AS term FROM units) GROUP BY ALL
), weighed AS (SELECT tf.*, idf, tf * coalesce(idf, ln(n + 1) + 1) AS r FROM tf LEFT JOIN known USING (term), n),
norms AS (SELECT path, key, kind, line_no, sqrt(sum(CASE WHEN kind <> 'passage' OR idf IS NOT NULL THEN r * r END)) AS norm FROM weighed GROUP BY ALL),
cosines AS (
  SELECT path, key, kind, line_no, n_chars, total, license, round(sum(d.r * w.w) / any_value(norm), 6) AS score, any_value(w.identifier) AS identifier
  FROM weighed d JOIN weights w USING (term) JOIN norms USING (path, key, kind, line_no) GROUP BY path, key, kind, line_no, n_chars, total, template, license
), by_license AS (
  SELECT path, key, kind, line_no, n_chars, total, license, max(score) AS score FROM cosines
  WHERE score >= CASE WHEN identifier THEN {licenses.IDENTIFIER_COSINE} WHEN kind = 'passage' THEN {licenses.PASSAGE_COSINE} ELSE {licenses.MIN_COSINE} END GROUP BY ALL
), ranked AS (
  SELECT path, key, kind, line_no, n_chars, total, list_sort(list({{'o': -score, 'l': license}})) AS r FROM by_license GROUP BY path, key, kind, line_no, n_chars, total
), best AS (
  SELECT path, key, kind, line_no, n_chars, total, {{'p': CASE WHEN kind = 'passage' THEN 0 ELSE 1 END, 'o': r[1].o, 'l': r[1].l}} AS b FROM ranked WHERE len(r) = 1 OR r[2].o - r[1].o >= {licenses.MARGIN} - 1e-9
), by_line AS (
  SELECT path, key, count(*) AS n_lines, sum(n_chars) AS chars FROM (SELECT DISTINCT path, key, line_no, n_chars FROM best WHERE kind NOT IN ('header', 'passage')) GROUP BY ALL
), of_text AS (
  SELECT path, key, min(b) AS own, max(CASE WHEN kind IN ('header', 'passage') THEN n_chars END) AS whole, max(total) AS total FROM best GROUP BY ALL
), own AS (
  SELECT path, min(own) AS own, sum(coalesce(n_lines, 0)) AS n_notices, max(greatest(coalesce(chars, 0), coalesce(whole, 0)) / total) AS share
  FROM of_text LEFT JOIN by_line USING (path, key) GROUP BY path
), licensed AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, min(own) AS dir_own FROM own WHERE share >= {licenses.FILE_SHARE} GROUP BY ALL
), near AS (
  SELECT path, max({{'n': length(dir), 'd': dir, 'o': dir_own}}) AS near
  FROM files JOIN licensed ON starts_with(path, dir || '/') GROUP BY path
)
SELECT f.doc_id, f.path, coalesce(own.l, near.o.l) AS license,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       -coalesce(own.o, near.o.o) AS score, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices,
       CASE WHEN own IS NULL THEN near.d END AS licensed_dir
FROM files f LEFT JOIN own USING (path) LEFT JOIN near USING (path)
"""


OP12_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM listed
), named AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) > 0 THEN sha256(array_to_string(s, chr(10))) END AS k FROM shingled),
kinds AS (SELECT k, min(doc_id) AS d, any_value(n) AS n, any_value(s) AS s FROM named WHERE k IS NOT NULL GROUP BY k),
each AS (SELECT d, n, unnest(s) AS x FROM kinds),
links AS (
  SELECT a.d AS a, b.d AS b FROM each a JOIN each b ON a.x = b.x AND a.d <> b.d AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.d, b.d, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT d, d AS r FROM kinds UNION SELECT reach.d, links.b AS r FROM reach JOIN links ON reach.r = links.a
), least AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT doc_id, CAST(named.n AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM named LEFT JOIN kinds USING (k) LEFT JOIN least USING (d)
"""


OP13_SQL = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_benchmark_decontamination": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op9_license_scan": OP9_SQL, "op12_jaccard_join": OP12_SQL, "op13_hard_negatives": OP13_SQL}
