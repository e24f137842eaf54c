"""Where texts and code are cut: splitters as table functions of SQL, and chunks of code."""

from pyspark.sql import functions as F

from quern.operators import chunking as C
from quern.operators import code_chunks as K
from quern.operators import sql_surface
from quern.operators.table_functions import TABLE_FUNCTIONS
from quern.plans.registry import query
from quern.session import materialise, table


def _cut(before: str, mark: str) -> str:
    """Pieces of `before` (doc_id, place, text) that are too long, cut after a mark where they have it before
    their last characters."""
    m, n = "'" + mark.replace("\n", "' || chr(10) || '") + "'", len(mark)
    tail = f"CASE WHEN len(p) > 1 AND length(p[-1]) < {n} THEN list_concat(list_transform(p[:-3], lambda x: x || {m}), [p[-2] || {m} || p[-1]]) ELSE list_concat(list_transform(p[:-2], lambda x: x || {m}), p[-1:]) END"
    cut = f"SELECT doc_id, place, unnest(q) AS text, generate_subscripts(q, 1) AS k FROM (SELECT doc_id, place, {tail} AS q FROM (SELECT *, string_split(text, {m}) AS p FROM {before} WHERE length(text) > {C.SIZE}))"
    placed = f"SELECT doc_id, CAST(place + coalesce(sum(length(text)) OVER (PARTITION BY doc_id, place ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place, text FROM ({cut})"
    return f"SELECT doc_id, place, text FROM {before} WHERE length(text) <= {C.SIZE} UNION ALL {placed}"


_WHOLE = C.PROTECTED.pattern.replace("\\Z", "\\z").replace("'", "''")
#: The recursive splitter's chunks: what is kept whole, and else units by one separator after the other; packed.
CHUNKS = f"""tx AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)({_WHOLE})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text != ''),
pt AS (SELECT *, k % 2 = 0 AND length(x) < {C.SIZE} AS whole FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM tx)),
gr AS (SELECT *, 2 * count(*) FILTER (whole) OVER (PARTITION BY doc_id ORDER BY k) - whole::INTEGER AS g FROM pt),
sg AS (SELECT doc_id, g, string_agg(x, '' ORDER BY k) AS text FROM gr GROUP BY doc_id, g),
c0 AS (SELECT doc_id, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place, text FROM sg WHERE text != ''),
{", ".join(f"c{k} AS MATERIALIZED ({_cut(f'c{k - 1}', mark)})" for k, mark in enumerate(C.SEPARATORS, 1))},
u AS MATERIALIZED (SELECT doc_id, place + o AS a, least(place + o + {C.SIZE}, place + length(text)) AS z FROM (SELECT *, unnest(range(0, length(text), {C.SIZE})) AS o FROM c{len(C.SEPARATORS)} WHERE text != '')),
ch AS (SELECT doc_id, 0 AS n, 0::BIGINT AS a, max(z) AS z FROM u WHERE z <= {C.SIZE} GROUP BY doc_id
  UNION ALL SELECT s.doc_id, s.n + 1, s.b, max(e.z) FROM (
    SELECT ch.doc_id, ch.n, ch.z, coalesce(min(back.a), ch.z) AS b FROM ch JOIN u stop ON stop.doc_id = ch.doc_id AND stop.a = ch.z
    LEFT JOIN u back ON back.doc_id = ch.doc_id AND back.a < ch.z AND back.a >= ch.z - {C.OVERLAP} AND back.a >= stop.z - {C.SIZE} AND back.a > ch.a GROUP BY ch.doc_id, ch.n, ch.z) s
  JOIN u e ON e.doc_id = s.doc_id AND e.z <= s.b + {C.SIZE} AND e.z > s.z GROUP BY s.doc_id, s.n, s.b)"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(n AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start_at, CAST(z AS INTEGER) AS end_at FROM ch")
def chunk_boundaries(spark, sf_dir):
    """Where the recursive splitter begins and ends each chunk."""
    return C.split_documents(table(spark, sf_dir, "documents"), tier="recursive").select("doc_id", "chunk_index", "start_at", "end_at")


@query(f"""WITH RECURSIVE {CHUNKS} SELECT lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, CAST(sum(z - a) AS BIGINT) AS n_chars, CAST(max(z - a) AS INTEGER) AS longest FROM ch JOIN documents USING (doc_id) GROUP BY lang""")
def sql_split_counts(spark, sf_dir):
    """One statement of the SQL surface that splits every document and counts by language."""
    sql = f"""SELECT d.lang, count(*) AS n_chunks, count(DISTINCT d.doc_id) AS n_docs, sum(length(c.content)) AS n_chars, max(c.end_at - c.start_at) AS longest
      FROM documents d, LATERAL split_recursive(d.text, {C.SIZE}, {C.OVERLAP}) c GROUP BY d.lang"""
    return sql_surface.run(spark, sql, {"documents": table(spark, sf_dir, "documents").select("doc_id", "lang", "text")}, functions=TABLE_FUNCTIONS)


CODE_SIZE = 1500
CODE = rf"""w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\r\n]{{1,200}}'), lambda x, i: '  if (a > ' || i || ') {{' || chr(10) || '    say("' || replace(replace(x, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '");' || chr(10) || '  }}' || chr(10)) AS b FROM documents),
f AS (SELECT doc_id, list_concat(list_concat(['// ' || doc_id || chr(10) || 'function d' || doc_id || '(a) {{' || chr(10)], b), ['}}' || chr(10)]) AS u FROM w),
u AS MATERIALIZED (SELECT doc_id, k, x, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS z FROM (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM f)),
ch AS (SELECT doc_id, 0 AS n, 0::BIGINT AS a, max(z) AS z FROM u WHERE z <= {CODE_SIZE} GROUP BY doc_id
  UNION ALL SELECT ch.doc_id, ch.n + 1, ch.z, max(u.z) FROM ch JOIN u ON u.doc_id = ch.doc_id AND u.z > ch.z AND u.z <= ch.z + {CODE_SIZE} GROUP BY ch.doc_id, ch.n, ch.z),
last AS (SELECT doc_id, max(n) AS last FROM ch GROUP BY doc_id)"""


def _code(spark, sf_dir):
    """Each document as a file of code: its lines, 200 characters at a time, as strings in conditions of one function."""
    lines = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\r\n]{1,200}"), F.lit(0))
    quoted = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    blocks = F.transform(lines, lambda x, i: F.concat(F.lit("  if (a > "), i + 1, F.lit(') {\n    say("'), quoted(x), F.lit('");\n  }\n')))
    body = F.concat(F.lit("// "), "doc_id", F.lit("\nfunction d"), "doc_id", F.lit("(a) {\n"), F.array_join(blocks, ""), F.lit("}\n"))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))


@query(f"""WITH RECURSIVE {CODE} SELECT doc_id, CAST(ch.n AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start_at, CAST(ch.z AS INTEGER) AS end_at, any_value(last) = 0 OR (ch.n > 0 AND ch.n < any_value(last)) AS balanced, FALSE AS forced,
md5(string_agg(x, '' ORDER BY k)) AS content_md5 FROM ch JOIN last USING (doc_id) JOIN u USING (doc_id) WHERE u.z > a AND u.z <= ch.z GROUP BY doc_id, ch.n, a, ch.z""")
def code_chunks(spark, sf_dir):
    """Documents as code, cut where conditions close; strings hold brackets and quotes of the texts."""
    made = K.chunk_code(_code(spark, sf_dir), CODE_SIZE, "doc_id", extension=F.lit("js"))
    return made.select("doc_id", "chunk_index", "start_at", "end_at", "balanced", "forced", F.md5("content").alias("content_md5"))


@query(f"""WITH RECURSIVE {CODE}, t AS (SELECT doc_id, string_agg(x, '' ORDER BY k) AS text FROM u GROUP BY doc_id) SELECT doc_id, md5(text) AS text_md5, CAST(len(string_split(text, chr(10))) - 1 AS INTEGER) AS last_line, last + 1 AS n_chunks FROM t JOIN last USING (doc_id)""")
def code_restored(spark, sf_dir):
    """Chunks of code tile their file, in characters and in lines."""
    made = materialise(K.chunk_code(_code(spark, sf_dir), CODE_SIZE, "doc_id", extension=F.lit("js")), "code-chunks")
    whole = C.restore(made).select("doc_id", F.md5("text").alias("text_md5"))
    return made.groupBy("doc_id").agg(F.max("last_line").alias("last_line"), F.count("*").cast("int").alias("n_chunks")).join(whole, "doc_id").select("doc_id", "text_md5", "last_line", "n_chunks")
