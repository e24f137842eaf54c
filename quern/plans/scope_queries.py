"""Scopes, states, owners, stores and pages of rows; texts made ready for models."""

from pyspark.sql import functions as F

from quern.functions import prepare as P
from quern.operators import scopes as S
from quern.plans.chunk_queries import lit
from quern.plans.registry import query
from quern.session import table

# --- what may be searched ---

STATES = """SELECT doc_id, toxic = 0 AS enabled, CASE lang WHEN 'de' THEN 'processing' WHEN 'fr' THEN 'failed' WHEN 'es' THEN NULL ELSE '' END AS index_status,
  CASE source WHEN 'src0' THEN 'parent_text' WHEN 'src1' THEN 'table_summary' WHEN 'src2' THEN 'faq' ELSE 'text' END AS chunk_type FROM documents LEFT JOIN labels USING (doc_id)"""


@query(f"""SELECT doc_id, chunk_type NOT IN ('table_summary', 'table_column') AS answerable FROM ({STATES}) WHERE coalesce(enabled, TRUE) AND coalesce(index_status, '') NOT IN ('processing', 'failed')
  AND chunk_type IN ('text', 'summary', 'table_column', 'table_summary', 'faq', 'image_ocr', 'image_caption')""")
def searchable_chunks(spark, sf_dir):
    lang, source = F.col("lang"), F.col("source")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", (F.col("toxic") == 0).alias("enabled"), F.when(lang == "de", "processing").when(lang == "fr", "failed").when(lang != "es", "").alias("index_status"),
        F.when(source == "src0", "parent_text").when(source == "src1", "table_summary").when(source == "src2", "faq").otherwise("text").alias("chunk_type"),
    )
    return docs.filter(S.searchable(F.col("enabled"), F.col("index_status"), F.col("chunk_type"))).select("doc_id", S.answerable(F.col("chunk_type")).alias("answerable"))


@query("""WITH t AS (SELECT doc_id, lang AS tag FROM documents UNION SELECT doc_id, 'good' FROM labels WHERE quality = 1)
SELECT doc_id, source FROM documents d WHERE source = 'src0' OR (source = 'src1' AND doc_id % 10 IN (1, 3) AND doc_id < 400 AND doc_id IN (1, 21, 41, 61, 81, 101, 121, 141, 161, 181))
  OR (source = 'src2' AND EXISTS (SELECT 1 FROM t WHERE t.doc_id = d.doc_id AND tag IN ('good', 'de'))) OR (source = 'src3' AND doc_id IN (3, 23, 43, 63) AND EXISTS (SELECT 1 FROM t WHERE t.doc_id = d.doc_id AND tag = 'en'))""")
def documents_in_scopes(spark, sf_dir):
    """A whole base, documents of one, tags of one, and both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    tags = docs.select("doc_id", F.col("lang").alias("tag")).union(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit("good")))
    scopes = [{"kb": "src0"}, {"kb": "src1", "docs": range(1, 200, 20)}, {"kb": "src2", "tags": ["good", "de"]}, {"kb": "src3", "docs": [3, 23, 43, 63], "tags": ["en"]}]
    return S.within_scopes(docs, scopes, tags, kb_col="source").select("doc_id", "source")


@query("SELECT page_id, contains(lower(html), '_') AS a, contains(lower(html), '100%') AS b, contains(lower(url), '://www') AS c, contains(lower(html), chr(92)) AS d FROM pages")
def literal_search(spark, sf_dir):
    html, url = F.col("html"), F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.holds(html, "_").alias("a"), S.holds(html, "100%").alias("b"), S.holds(url, "://WWW").alias("c"), S.holds(html, "\\").alias("d"))


@query("""SELECT page_id, n, n IN ('a.CSV', 'b.c.xlsx', '.xls') AS is_data FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a.CSV' WHEN 1 THEN 'b.c.xlsx' WHEN 2 THEN '.xls' WHEN 3 THEN 'csv' WHEN 4 THEN 'a.csv/b' ELSE url END AS n FROM pages)""")
def data_files(spark, sf_dir):
    k = F.col("page_id") % 6
    name = F.when(k == 0, "a.CSV").when(k == 1, "b.c.xlsx").when(k == 2, ".xls").when(k == 3, "csv").when(k == 4, "a.csv/b").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("n"), S.is_data_file(name).alias("is_data"))


@query("""SELECT event_id FROM events WHERE event_type != 'error' AND (event_id % 3 = 0 OR ts > TIMESTAMP '2024-01-15') AND user_id % 4 IN (0, 2) AND event_id % 5 != 0""")
def live_memories(spark, sf_dir):
    """Events as memories: errors are inactive, two in three expire at their time, every fifth has no vector of the size."""
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "archived").otherwise("active").alias("status"), F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp")).alias("expires_at"),
        F.concat(F.lit("k"), F.col("user_id") % 4).alias("kind"), F.array_repeat(F.lit(1.0), F.when(F.col("event_id") % 5 == 0, 3).otherwise(4)).alias("vector"),
    )
    return e.filter(S.live_memories(F.to_timestamp(F.lit("2024-01-15")), ("k0", "k2"), 4)).select("event_id")


@query("""WITH w AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_totalprice > 200000), own AS (SELECT c_custkey AS key, 'own' AS kind FROM customer WHERE c_acctbal > 5000)
SELECT key, kind FROM own WHERE key IN (SELECT key FROM w) UNION ALL SELECT c_custkey, 'shared' FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT key FROM w) AND c_custkey NOT IN (SELECT key FROM own)""")
def shared_fallback(spark, sf_dir):
    """Customers by their own list, else by a shared one."""
    c = table(spark, sf_dir, "customer")
    wanted = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("key"))
    rows = lambda least, kind: c.filter(F.col("c_acctbal") > least).select(F.col("c_custkey").alias("key"), F.lit(kind).alias("kind"))
    return S.own_then_shared(wanted, rows(5000, "own"), rows(0, "shared"), "key")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 = 1 AND conv_id % 7 != 0")
def messages_of_owner(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    sessions = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 3).alias("owner"), F.when(F.col("conv_id") % 7 == 0, True).alias("deleted"))
    return S.messages_of(turns, sessions, 1, "conv_id").select("conv_id", "turn", "role")


@query("""WITH h AS (SELECT event_id, user_id, value / 100 AS score, CASE WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'milvus' ELSE 'doris' END AS engine FROM events)
SELECT event_id, user_id, round(CASE WHEN count(DISTINCT engine) OVER (PARTITION BY user_id) > 1 THEN least(greatest(CASE engine WHEN 'milvus' THEN (score + 1) / 2 ELSE score END, 0), 1) ELSE score END, 6) AS score FROM h""")
def mixed_engine_scores(spark, sf_dir):
    """Scores of users whose events come from one kind of engine stay as they are."""
    from quern.operators.retrieval import normalise_score

    both = (F.col("user_id") % 2 == 0) & (F.col("event_id") % 3 == 0)
    hits = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 100).alias("score"), F.when(both, "milvus").otherwise("doris").alias("engine"))
    return S.normalise_if_mixed(hits, normalise_score(F.col("score"), F.col("engine")), "user_id").select("event_id", "user_id", F.round("score", 6).alias("score"))


@query("""SELECT user_id, doc_id, max(v) AS vector_score, max(k) AS keyword_score FROM (SELECT user_id, event_id % 50 AS doc_id, CASE WHEN event_type IN ('view', 'click') THEN value END AS v, CASE WHEN event_type = 'purchase' THEN value END AS k
  FROM events WHERE event_type IN ('view', 'click', 'purchase')) GROUP BY ALL""")
def hits_by_retriever(spark, sf_dir):
    """Views and clicks as vector hits, purchases as keyword hits; the best of each a chunk."""
    kind = F.when(F.col("event_type").isin("view", "click"), "vector").when(F.col("event_type") == "purchase", "keyword").otherwise("other")
    hits = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("doc_id"), F.col("value").alias("score"), kind.alias("retriever"))
    vector, keyword = S.split_by_retriever(hits)
    best = lambda df, name: df.groupBy("user_id", "doc_id").agg(F.max("score").alias(name))
    return best(vector, "vector_score").join(best(keyword, "keyword_score"), ["user_id", "doc_id"], "full_outer")


@query("SELECT s_suppkey AS kb_id, CASE WHEN s_nationkey % 3 = 0 THEN 'faq' ELSE 'document' END AS index, CASE WHEN s_nationkey % 3 = 0 THEN 'vector' ELSE 'vector,keyword' END AS retrievers FROM supplier")
def index_routes(spark, sf_dir):
    bases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("kb_id"), F.when(F.col("s_nationkey") % 3 == 0, "faq").otherwise("document").alias("kind"))
    return S.routes(bases).withColumn("retrievers", F.array_join("retrievers", ","))


@query("SELECT s_nationkey % 5 AS store, s_nationkey % 2 AS tenant, array_to_string(list_sort(list(DISTINCT s_suppkey)), ',') AS kb_ids, count(DISTINCT s_acctbal > 0) <= 1 AS one_model FROM supplier GROUP BY ALL")
def bases_by_store(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    bases = s.select(F.col("s_suppkey").alias("kb_id"), (F.col("s_nationkey") % 5).alias("store"), (F.col("s_nationkey") % 2).alias("tenant"), (F.col("s_acctbal") > 0).alias("model"))
    return S.by_store(bases).withColumn("kb_ids", F.array_join("kb_ids", ","))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, TRUE AS more FROM lineitem WHERE l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber > 2) ORDER BY l_orderkey, l_linenumber LIMIT 50""")
def keyset_with_more(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return S.page(rows, ["l_orderkey", "l_linenumber"], (100, 2), 50)


# --- texts ---


def _replaced(text: str, steps) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(to.replace('$', chr(92)))}, 'g')"
    return text


WORDS_OF_LINE = f"""CASE WHEN regexp_matches(line, {lit(P.TABLE_RULE)}) THEN '' WHEN regexp_matches(line, {lit(P.TABLE_LINE)})
  THEN array_to_string(list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c != ''), ', ') ELSE {_replaced("line", [(sign, "") for sign in P.LINE_SIGNS])} END"""
LINES_SQL = f"array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda line: NOT regexp_matches(line, {lit(P.FENCE)})), lambda line: {WORDS_OF_LINE}), chr(10))"
CLEAN_SQL = f"(SELECT id, regexp_replace(regexp_replace({_replaced('t', P.INLINE)}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM (SELECT id, {LINES_SQL} AS t FROM src))"


@query(f"WITH src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, html FROM pages) SELECT id, md5(clean) AS clean_md5, length(clean) AS n_chars FROM {CLEAN_SQL}")
def clean_passages(spark, sf_dir):
    """All documents and pages without their marks."""
    src = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(table(spark, sf_dir, "pages").select(-1 - F.col("page_id"), "html"))
    return src.select("id", P.clean_passage(F.col("text")).alias("clean")).select("id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("n_chars"))


@query(f"""WITH src AS (SELECT item_id AS id, text FROM benchmark) SELECT id, CASE WHEN id % 3 = 0 THEN clean ELSE clean || chr(10) || chr(10) || 'cap ' || id || CASE WHEN id % 2 = 0 THEN chr(10) || 'q1; q2' ELSE '' END END AS passage
FROM (SELECT id, clean FROM {CLEAN_SQL})""")
def enriched_passages(spark, sf_dir):
    """Items with a caption and generated questions, and without."""
    none = F.col("item_id") % 3 == 0
    image = F.array(F.struct(F.concat(F.lit("cap "), "item_id").alias("caption"), F.lit("").alias("ocr")))
    asked = F.when(~none & (F.col("item_id") % 2 == 0), F.array(F.lit("q1"), F.lit("q2"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), P.enriched_passage(F.col("text"), F.when(~none, image), asked).alias("passage"))


STOPS = ", ".join(map(lit, P.STOP_WORDS))


@query(rf"""WITH s AS (SELECT item_id, trim(CASE WHEN item_id % 2 = 0 THEN 'What is “' || substr(text, 1, 20) || '” and ' || text ELSE text END) AS q FROM benchmark),
w AS (SELECT *, list_filter(regexp_extract_all(q, '\p{{Han}}+|[\p{{L}}\p{{Nd}}]+'), lambda x: lower(x) NOT IN ({STOPS}) AND length(x) > 1) AS w,
  list_filter(list_transform(regexp_extract_all(q, {lit(P.SPANS)}), lambda x: CASE WHEN contains({lit(P.QUOTE_SIGNS)}, x[1]) THEN trim(x[2:-2]) WHEN strlen(x) > 5 THEN x END), lambda x: x IS NOT NULL) AS spans FROM s),
v AS (SELECT item_id, q, list_concat(list_concat(CASE WHEN len(w) > 1 THEN [array_to_string(w, ' ')] ELSE [] END, spans), [trim(regexp_replace(q, {lit(P.QUESTION_WORDS)}, ''))]) AS v FROM w)
SELECT item_id, array_to_string(list_filter(v, lambda x, k: strlen(x) > 2 AND lower(x) != lower(q) AND list_position(list_transform(v, lambda y: lower(y)), lower(x)) = k)[1:5], '|') AS variants FROM v""")
def query_expansion(spark, sf_dir):
    text = F.col("text")
    asked = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("What is “"), F.substr(text, F.lit(1), F.lit(20)), F.lit("” and "), text)).otherwise(text)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(P.expand_query(asked), "|").alias("variants"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 6 IN (0, 3) AS broken FROM events")
def repaired_json(spark, sf_dir):
    """Event properties broken in six ways, and read again."""
    props, way = F.col("props"), F.col("event_id") % 6
    head = F.regexp_extract("props", r"^(.*)\}$", 1)
    bad = (
        F.when(way == 0, head).when(way == 1, F.concat(head, F.lit(",}"))).when(way == 2, F.concat(props, F.lit('""'))).when(way == 3, F.concat(head, F.lit(', "a": ["x", "half')))
        .when(way == 4, F.concat(head, F.lit(r', "p": "\d+\.log"}'))).otherwise(F.regexp_replace(props, r"^\{|\}$", ""))
    )
    return table(spark, sf_dir, "events").select("event_id", P.repaired(bad).alias("r")).select("event_id", F.get_json_object("r.json", "$.k").cast("long").alias("k"), F.col("r.broken").alias("broken"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fenced_json(spark, sf_dir):
    """Event properties as a model says them, in a fence or among words."""
    props, way = F.col("props"), F.col("event_id") % 3
    said = F.when(way == 0, F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nDone."))).when(way == 1, F.concat(F.lit("So: "), props, F.lit(" is all."))).otherwise(F.concat(F.lit("```\n"), props, F.lit("```")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(P.fenced_json(said), "$.k").cast("long").alias("k"))


@query("SELECT event_id, event_id & 4 != 0 AS has, event_id | 4 AS added, event_id & ~4 AS cleared, xor(event_id, 4) AS turned FROM events")
def bit_flags(spark, sf_dir):
    f = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", P.flag(f, 2).alias("has"), P.with_flag(f, 2, True).alias("added"), P.with_flag(f, 2, False).alias("cleared"), P.with_flag(f, 2, None).alias("turned"))


@query("SELECT doc_id, 'lang: ' || lang || chr(10) || 'n: ' || n_chars || chr(10) || 'source: ' || source AS lines FROM documents")
def metadata_lines(spark, sf_dir):
    values = F.create_map(F.lit("source"), F.concat(F.lit(" "), "source"), F.lit("n"), F.col("n_chars").cast("string"), F.lit("blank"), F.lit("  "), F.lit("lang"), F.col("lang"), F.lit("none"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", P.map_lines(values).alias("lines"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS minute, ts < TIMESTAMP '2024-01-10' AS expired FROM events")
def event_times(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", P.rfc3339(ts).alias("at"), P.rfc3339(F.date_trunc("minute", ts)).alias("minute"), (ts < F.to_timestamp(F.lit("2024-01-10"))).alias("expired"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN trim(url) WHEN 3 THEN trim(url) || ' <b>' WHEN 4 THEN 'Number ' || page_id || ' says this much' ELSE 'a' || chr(10) || chr(10) || trim(url) END AS clean FROM pages""")
def recognised_texts(spark, sf_dir):
    """Replies that hold hardly more than tags, that say there is no text, that stand in a fence, that have a tag,
    that are HTML, and with wide gaps."""
    way, url, number = F.col("page_id") % 6, F.col("url"), F.col("page_id").cast("string")
    said = F.when(way == 0, "<html><body><div class='image'><img/></div> x</body></html>").when(way == 1, F.element_at(F.array(F.lit("No text content."), F.lit(" 无法识别。"), F.lit("empty")), (F.col("page_id") % 3 + 1).cast("int")))
    said = said.when(way == 2, F.concat(F.lit("```text\n"), url, F.lit("\n```"))).when(way == 3, F.concat(url, F.lit(" <b>")))
    said = said.when(way == 4, F.concat(F.lit("```html\n<div><p>Number "), number, F.lit(" says this much</p></div>\n```"))).otherwise(F.concat(F.lit("a\n\n\n\n\n"), url))
    return table(spark, sf_dir, "pages").select("page_id", P.clean_ocr(said).alias("clean"))
