"""Registered queries of the operators, and SQL to check them by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seatpool.llm import (
    embeddings, exact_dedup, html_text, line_dedup, mixing, packing, phrases, quality, quality_rules, simhash, suffix_tree,
    toxicity, vector_codes,
)
from seatpool.llm.common import table, workers_find_package

Query = Callable[[SparkSession, str], DataFrame]


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op4_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.site_lines(table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pattern_packing, op2_simhash_dedup, op3_kneser_ney_quality, op4_site_line_dedup, op5_mix_sources,
        op6_toxic_segments, op7_embedding_dedup, op8_suffix_tree_scores, op9_main_text, op10_exact_dedup,
        op11_vector_codes, op12_quality_rules, op13_phrases, pipeline,
    )
}


def registered() -> dict[str, Query]:
    def ready(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_find_package(spark)
            return query(spark, sf_dir)

        return run

    return {name: ready(query) for name, query in QUERIES.items()}


# Assignment of all parts to codebook k, and a round of means after it.
_ASSIGN = """
, far{k} AS (
  SELECT vec_id, parts.p, parts.part, entry,
    list_sum(list_transform(list_zip(parts.part, book{k}.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
  FROM parts JOIN book{k} USING (p)
), near{k} AS MATERIALIZED (
  SELECT vec_id, p, any_value(part) AS part, min(far) AS far, arg_min(entry, far * 64 + entry) AS entry
  FROM far{k} GROUP BY vec_id, p
)"""
_ROUND = _ASSIGN.replace("{k}", "{old}") + """
, sums{new} AS (
  SELECT p, entry, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS mean
  FROM (SELECT p, entry, part, unnest(range(1, len(part) + 1)) AS i FROM near{old}) GROUP BY p, entry, i
), means{new} AS (
  SELECT p, entry, list(mean ORDER BY i) AS part FROM sums{new} GROUP BY p, entry
), book{new} AS MATERIALIZED (
  SELECT p, entry, coalesce(m.part, b.part) AS part FROM book{old} b LEFT JOIN means{new} m USING (p, entry)
)"""

_SPACE = "[ \\t\\n\\x0b\\f\\r]+"

SQL = {
    "op10_exact_dedup": f"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS norm FROM documents
), groups AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM texts JOIN groups USING (norm)
""",
    "op4_site_line_dedup": rf"""
WITH cut AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_SPACE}', ' ', 'g'), '{line_dedup.HIDDEN}', chr(10), 'g'),
      '{line_dedup.BREAKS}', chr(10), 'g') AS broken
  FROM pages
), page_lines AS (
  SELECT page_id, host, list_filter(string_split(trim(regexp_replace(regexp_replace(
    regexp_replace(broken, '{line_dedup.TAGS}', '', 'g'), ' *\n *', chr(10), 'g'), '  +', ' ', 'g'), ' '), chr(10)),
    lambda line: line <> '') AS lines
  FROM cut
), hosts AS (
  SELECT host, count(*) AS host_pages FROM page_lines GROUP BY host
), held AS (
  SELECT host, unnest(list_distinct(lines)) AS line FROM page_lines
), boilerplate AS (
  SELECT host, list(line) AS gone FROM (
    SELECT host, line, count(*) AS n FROM held GROUP BY host, line
  ) JOIN hosts USING (host) WHERE n >= {line_dedup.MIN_PAGES} AND n > host_pages * {line_dedup.RATIO} GROUP BY host
)
SELECT page_id, host, host_pages, len(lines) AS n_lines,
  len(lines) - len(list_filter(lines, lambda line: NOT list_contains(coalesce(gone, []), line))) AS n_dropped,
  array_to_string(list_filter(lines, lambda line: NOT list_contains(coalesce(gone, []), line)), chr(10)) AS text
FROM page_lines JOIN hosts USING (host) LEFT JOIN boilerplate USING (host)
""",
    "op11_vector_codes": """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % 16 = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS part FROM kept CROSS JOIN range(16) AS t(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, part FROM parts
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64
)""" + _ROUND.format(old=0, new=1) + _ROUND.format(old=1, new=2) + _ASSIGN.format(k=2) + """
, digest AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book2
), codes AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id) CROSS JOIN digest
""",
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece
  FROM documents WHERE text IS NOT NULL
), pieced AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS words FROM pieces
), grams AS (
  SELECT lang, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i : i + k - 1])) AS words
  FROM pieced CROSS JOIN range(1, 6) AS t(k) WHERE len(words) >= k
), counts AS MATERIALIZED (
  SELECT lang, words, count(*) AS f FROM grams GROUP BY lang, words
), sizes AS (
  SELECT lang, sum(f) AS n FROM counts WHERE len(words) = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT * FROM counts WHERE len(words) > 1 AND f >= 100
), inner_words AS (
  SELECT lang, f, unnest(flatten(list_transform(range(2, len(words)), lambda k:
    list_transform(range(1, len(words) - k + 2), lambda i: words[i : i + k - 1])))) AS words
  FROM candidates
), covered AS (
  SELECT lang, words, max(f) AS cover FROM inner_words GROUP BY lang, words
), cuts AS (
  SELECT c.lang, c.words, c.f AS a, n, k, c.words[1 : k] AS lead, c.words[k + 1 :] AS rest
  FROM candidates c JOIN sizes USING (lang) LEFT JOIN covered o ON c.lang = o.lang AND c.words = o.words
  CROSS JOIN range(1, 5) AS t(k)
  WHERE k < len(c.words) AND (cover IS NULL OR 100 * cover < 100 * c.f)
), scored AS (
  SELECT cuts.lang, cuts.words, a, CAST(n AS BIGINT) AS n, x.f AS l, y.f AS r, k,
    CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.words = lead JOIN counts y ON y.lang = cuts.lang AND y.words = rest
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.words ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank,
  array_to_string(words, ' ') AS phrase, a, l, r, n, score
FROM scored QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) <= 2000
""",
}
