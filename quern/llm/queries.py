"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import functions as F

from quern.llm import chat_format, contamination, exact_dedup, hard_negatives, html_content, license_scan, line_dedup, mixing, quality, runs, simhash, token_counts, url_filter
from quern.llm.license_texts import BEGINNINGS, EQUIVALENT, LINKS, NAMES, SHORT, SPDX_ENDINGS, SPDX_TAG, long_texts
from quern.session import table


def op1_benchmark_decontamination(spark, sf_dir):
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    """Documents with their source as the host."""
    clean = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("clean_chars"), F.sha2("text", 256).alias("clean_sha256"))


def captures(pages):
    """Pages with a fetch time of their own within 2024."""
    minutes = F.make_interval(mins=(F.col("page_id") * 7919 % 525600).cast("int"))
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp") + minutes).alias("fetched_at"))


def list_entries(pages):
    """A dated blocklist over the sites of the pages: some are listed, taken off and, half
    of them, listed again; one language section of some others is listed."""
    host = url_filter.host_of(F.col("url"))
    sites = pages.select(F.regexp_replace(host, r"^(www|m|blog)\.", "").alias("site"), host.alias("host")).filter("site != ''").distinct()
    code = F.conv(F.substring(F.md5("site"), 1, 4), 16, 10).cast("int")
    day = lambda n: (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=n))
    sites = sites.withColumn("code", code)
    listed, first = F.col("code") % 4 == 0, (F.col("code") % 200).cast("int")
    parts = [
        sites.filter(listed).select(F.col("site").alias("pattern"), F.lit("add").alias("action"), day(first).alias("at")),
        sites.filter(listed).select("site", F.lit("remove"), day(first + 60)),
        sites.filter(listed & (F.col("code") % 8 == 0)).select("site", F.lit("add"), day(first + 110)),
        sites.filter(F.col("code") % 4 == 1).select(F.concat("host", F.lit("/en")), F.lit("add"), day(first)),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_filter(captures(pages), list_entries(pages))


def op7_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("chance")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_decisions(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(turns.select(more.columns).union(more)), in_order=True)


def op11_html_content(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_content.main_text(pages, html_content.learn_weights(pages))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op13_periodic_runs(spark, sf_dir):
    return runs.run_digests(runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_literal(license_scan.COPYRIGHT_LINE)}, chr(10), 'g')"
    for written, read in EQUIVALENT:
        out = f"replace({out}, {_literal(written)}, {_literal(read)})"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _values(rows, columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({columns})"


OP2_SQL = f"""
WITH texts AS (
       SELECT * FROM {_values(SHORT + long_texts(), "license, text")}
       UNION ALL SELECT n.license, b.words || l.link || n.written FROM (SELECT * FROM {_values([(k, w) for k, ways in NAMES.items() for w in ways], "license, written")}) n,
         (SELECT * FROM {_values([(b,) for b in BEGINNINGS], "words")}) b, (SELECT * FROM {_values([(x,) for x in LINKS], "link")}) l
       UNION ALL SELECT n.license, {_literal(SPDX_TAG)} || n.license || e.ending FROM (SELECT * FROM {_values([(k,) for k in NAMES], "license")}) n, (SELECT * FROM {_values([(e,) for e in SPDX_ENDINGS], "ending")}) e),
known AS (SELECT min(license) AS license, form FROM (SELECT license, {_canonical("text")} AS form FROM texts) GROUP BY form),
units AS (SELECT doc_id, TRUE AS whole, text FROM documents
          UNION ALL SELECT doc_id, FALSE, unnest(string_split(text, chr(10))) FROM documents),
found AS (SELECT doc_id, min(license) FILTER (whole) AS license, count(*) FILTER (NOT whole) AS n_notices,
                 array_to_string(list_sort(list_distinct(list(license) FILTER (NOT whole))), ',') AS notices
          FROM (SELECT doc_id, whole, {_canonical("text")} AS form FROM units WHERE text != '') u JOIN known USING (form) GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM documents d LEFT JOIN found USING (doc_id)
"""

OP5_SQL = """
WITH lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT source, trim(line) AS line FROM lines JOIN pages USING (source) WHERE trim(line) != ''
        GROUP BY source, trim(line), pages HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) > 0.05 * pages),
marked AS (SELECT l.*, b.line IS NOT NULL AS bad FROM lines l LEFT JOIN bad b ON l.source = b.source AND trim(l.line) = b.line),
clean AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (bad) AS INTEGER) AS n_dropped,
                 coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT bad), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, CAST(length(text) AS INTEGER) AS clean_chars, sha256(text) AS clean_sha256 FROM clean
"""

OP6_SQL = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 7919 % 525600 AS BIGINT)) AS fetched_at,
         lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
sites AS (SELECT *, ('0x' || substr(md5(site), 1, 4))::INTEGER AS code FROM
           (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS site, host FROM captures WHERE host != '')),
entries AS (
  SELECT DISTINCT site AS pattern, code % 200 AS a, code % 200 + 60 AS z FROM sites WHERE code % 4 = 0
  UNION ALL SELECT DISTINCT site, code % 200 + 110, NULL FROM sites WHERE code % 8 = 0
  UNION ALL SELECT DISTINCT host || '/en', code % 200, NULL FROM sites WHERE code % 4 = 1),
spans AS (SELECT pattern, TIMESTAMP '2024-01-01' + to_days(a) AS valid_from, TIMESTAMP '2024-01-01' + to_days(z) AS valid_to FROM entries),
hits AS (
  SELECT page_id, pattern, valid_from, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) AS r
  FROM captures JOIN spans ON (host = pattern OR ends_with(host, '.' || pattern) OR starts_with(host || path || '/', pattern || '/') AND contains(pattern, '/'))
   AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT c.page_id, host, fetched_at, pattern IS NOT NULL AS blocked, pattern, valid_from AS listed_since
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND r = 1
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

# Each turn is <turn>role<says>text</turn> and a newline; a backslash stands before
# every backslash and control string inside role and text.
OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(20 + length(regexp_replace(role, '(\\|<turn>|<says>|</turn>)', '\\\1', 'g'))
                   + length(regexp_replace(text, '(\\|<turn>|<says>|</turn>)', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

# The tables' pages mark their article, and hold no boilerplate within it; their character references are those replaced here.
OP11_SQL = r"""
WITH bodies AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS body FROM pages),
blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(p|h1)>'), lambda b:
             trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(b, '<br>', ' '), '<b>', ''), '</b>', ''), '&(quot);', '"', 'g'), '&lt;', '<'),
                  '&amp;?', '&', 'g'), '[ \t\n\r\f\v\x{a0}]+', ' ', 'g'))) AS parts FROM bodies)
SELECT page_id, url, array_to_string(list_filter(parts, lambda b: b != ''), chr(10) || chr(10)) AS text,
       CAST(length(array_to_string(list_filter(parts, lambda b: b != ''), chr(10) || chr(10))) AS BIGINT) AS n_chars FROM blocks
"""

OP12_SQL = """
WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
           FROM rows_ a JOIN rows_ r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_source_mixing": op7_source_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
    "op11_html_content": op11_html_content,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {
    "op2_license_scan": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_html_content": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
