"""Queries over text functions: documents as chunks."""

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans.registry import query
from quern.session import table

# DuckDB for the text functions of quern.functions.text.
NORMALISE = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
BIGRAMS = r"""(CASE WHEN length(p) > 1 THEN list_distinct(list_transform(range(1, length(p)), lambda i: substring(p, i, 2)))
                    WHEN length(p) = 1 THEN [p] ELSE [] END)"""


@query(f"SELECT doc_id, md5({NORMALISE}) AS signature, length({NORMALISE}) AS n_chars_normalised FROM documents")
def text_signature(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.signature(text).alias("signature"), F.length(T.normalise(text)).cast("long").alias("n_chars_normalised"))


@query(rf"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS token_digest FROM (
  SELECT doc_id, list_distinct(list_filter(string_split({NORMALISE}, ' '), lambda w: length(w) > 1 AND regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS t FROM documents)""")
def token_sets(spark, sf_dir):
    tokens = F.array_sort(T.token_set(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("token_digest"))


@query(rf"""SELECT doc_id, CAST(len(b) AS BIGINT) AS n_bigrams, md5(array_to_string(list_sort(b), ' ')) AS bigram_digest FROM (
  SELECT doc_id, {BIGRAMS} AS b FROM (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g') AS p FROM documents))""")
def char_bigrams(spark, sf_dir):
    pairs = F.array_sort(T.bigram_set(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(pairs).cast("long").alias("n_bigrams"), F.md5(F.array_join(pairs, " ")).alias("bigram_digest"))


@query(r"""
WITH n AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}]')) AS cjk, len(regexp_extract_all(text, '[A-Za-zäöüÄÖÜß]')) AS latin FROM documents),
named AS (SELECT doc_id, length(text) AS n, CASE WHEN cjk + latin = 0 OR (cjk >= 0.15 * (cjk + latin) AND latin >= 0.15 * (cjk + latin)) THEN 'mixed' WHEN cjk > 0.3 * (cjk + latin) THEN 'zh'
  WHEN regexp_matches(text, '[äöüÄÖÜß]') OR regexp_matches(substring(text, 1, 512), '(?i) (der|die|das|und|ist|nicht|mit|auf) ') THEN 'de' ELSE 'en' END AS language FROM n)
SELECT doc_id, language, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(floor(n / CASE language WHEN 'en' THEN 4.0 WHEN 'de' THEN 4.5 WHEN 'zh' THEN 1.7 ELSE 3.0 END + 0.5), 1) END AS BIGINT) AS tokens FROM named""")
def token_estimates(spark, sf_dir):
    language = T.guess_language(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", language.alias("language")).select("doc_id", "language", T.estimate_tokens(F.col("text"), F.col("language")).alias("tokens"))


@query("""SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w != '')[2] AS second_part,
  replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
  replace(replace(lower(url), '-', ''), '_', '') AS slug FROM pages""")
def url_terms(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.try_element_at(F.filter(F.split(F.regexp_replace(F.regexp_replace(url, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " "), " "), lambda w: w != ""), F.lit(2)).alias("second_part"),
        T.html_escape(url).alias("escaped"), T.slug_key(url).alias("slug"),
    )
