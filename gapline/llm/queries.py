"""The queries over the driver's tables and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inner_product, jaccard, language, neardup_vectors, ngram_lm, toxicity
from .mixing import mix, taken
from .packing import pack_documents
from .preferences import preferences
from .shared import crc_fold, small_batches, table, written
from .url_filter import filter_urls

#: The url rules of the query: fixed values.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup_vectors.link(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.score(docs, crc_fold(F.col("doc_id"), 7) == 2).withColumnRenamed("id", "doc_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken(mix(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "start", "words", "bin", "capacity", "used", "slot", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 5)
    model = language.train(docs.filter(fold != 0).select("doc_id", "text", "lang"))
    judged = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return language.identify(judged, model).select("doc_id", "held_out", "lang_pred", "score")


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even conversation is chosen over the odd one after it."""
    turns = table(spark, sf_dir, "conversations").select(
        F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"),
        F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected").alias("side"),
        "turn", "role", "text",
    )
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return preferences(turns, "pair_id", "side").select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected",
        flat(F.col("chosen_spans")).alias("chosen_spans"), flat(F.col("rejected_spans")).alias("rejected_spans"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.duplicates(docs, size=4, num=85, den=100)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 3)
    labels = table(spark, sf_dir, "labels").filter(fold != 1)
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    judged = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    with small_batches(spark):
        return written(toxicity.score(judged, model).select("doc_id", "held_out", "score", "predicted"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_embedding_neardup": op2_embedding_neardup,
    "op3_inner_product_search": op3_inner_product_search,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_mix_sources": op5_mix_sources,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_preference_format": op8_preference_format,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
}

ORACLE: dict[str, str] = {
    "op1_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op2_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
many AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN many USING (vec_id)""",
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1),
many AS (SELECT a AS doc_id, count(*) AS k FROM links GROUP BY 1)
SELECT doc_id, n AS n_shingles, coalesce(k, 0)::BIGINT AS n_links, component_id FROM n JOIN least USING (doc_id) LEFT JOIN many USING (doc_id)""",
    "op8_preference_format": r"""
WITH turns AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
common AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id,
         min(CASE WHEN c.pos IS NULL OR r.pos IS NULL OR c.role <> r.role OR c.text <> r.text
                  THEN coalesce(c.pos, r.pos) END) AS differs, max(coalesce(c.pos, r.pos)) AS last,
         count(c.pos) AS n_c, count(r.pos) AS n_r
  FROM (SELECT * FROM turns WHERE side = 0) c FULL JOIN (SELECT * FROM turns WHERE side = 1) r
    ON c.pair_id = r.pair_id AND c.pos = r.pos
  GROUP BY 1 HAVING count(c.pos) > 0 AND count(r.pos) > 0),
rendered AS (
  SELECT t.*, coalesce(differs - 1, last) AS n_common, pos <= coalesce(differs - 1, last) AS shared,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM turns t JOIN common USING (pair_id)),
placed AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, shared ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM rendered)
SELECT pair_id, max(n_common)::BIGINT AS n_common,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 0 AND shared), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 0 AND NOT shared), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 1 AND NOT shared), '') AS rejected,
       coalesce(string_agg((place + 5 + length(role)) || '-' || (place + length(shown)), ',' ORDER BY pos)
                FILTER (side = 0 AND NOT shared AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((place + 5 + length(role)) || '-' || (place + length(shown)), ',' ORDER BY pos)
                FILTER (side = 1 AND NOT shared AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY pair_id""",
}
