"""Chunking and stitching of whole documents, parents, neighbours, and questions with answers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking as C
from quern.operators import faq as Q
from quern.operators import stitch as S
from quern.plans.registry import query
from quern.session import materialise, table


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(pattern: str, name: str) -> str:
    return f"count(*) FILTER (body AND regexp_matches(line, {lit(pattern)})) AS {name}"


LEVELS = ", ".join(rf"count(*) FILTER (regexp_matches(line, '^#{{{k}}}\s+\S')) AS h{k}" for k in range(1, 7))


@query(rf"""WITH d AS (SELECT doc_id, text, regexp_replace(text, {lit(C.FENCED)}, '', 'g') AS plain FROM documents),
l AS (SELECT *, NOT regexp_matches(line, {lit(C.HEADING)}) AS body FROM (SELECT doc_id, unnest(string_split(plain, chr(10))) AS line FROM d)),
s AS (SELECT doc_id, round(avg(length(line)), 6) AS mean_line, round(stddev_pop(length(line)), 6) AS std_line, {LEVELS}, count(*) FILTER (NOT body) AS n_headings,
  {_count(C.NUMBERED, "n_numbered")}, {_count(C.CHAPTER, "n_chapters")}, {_count(C.CAPITALS, "n_capitals")}, {_count(C.SEPARATOR, "n_separators")}, {_count(C.FOOTER, "n_footers")}, {_count(C.TABLE_ROW, "n_table_rows")}
  FROM l GROUP BY doc_id),
p AS (SELECT s.*, len(string_split(text, chr(10))) AS n_lines, len(string_split(text, chr(12))) - 1 AS n_form_feeds, len(regexp_extract_all(text, '\n\n\n')) AS n_breaks,
  length(text) != length(plain) AS has_code, round((length(text) - length(plain)) / length(text), 6) AS code_share FROM s JOIN d USING (doc_id))
SELECT * EXCLUDE (n_lines, n_form_feeds, n_breaks), CAST(n_lines AS BIGINT) AS n_lines, CAST(n_form_feeds AS BIGINT) AS n_form_feeds, CAST(n_breaks AS BIGINT) AS n_breaks,
  CASE WHEN h1 >= 3 THEN 1 WHEN h2 >= 3 THEN 2 WHEN h3 >= 3 THEN 3 WHEN h4 >= 3 THEN 4 WHEN h5 >= 3 THEN 5 WHEN h6 >= 3 THEN 6 WHEN h6 > 0 THEN 6 WHEN h5 > 0 THEN 5 WHEN h4 > 0 THEN 4 WHEN h3 > 0 THEN 3 WHEN h2 > 0 THEN 2 WHEN h1 > 0 THEN 1 ELSE 0 END AS level,
  CASE WHEN n_headings >= 3 AND n_headings / n_lines > 0.005 THEN 'headings,' ELSE '' END
    || CASE WHEN n_numbered + n_chapters + n_capitals + n_separators + n_form_feeds >= 5 OR n_form_feeds > 0 OR n_chapters > 0 THEN 'heuristic,' ELSE '' END || 'recursive' AS tiers FROM p""")
def document_profile(spark, sf_dir):
    """What a splitter is chosen by, the dominant heading level, and the splitters to try, of all texts that there are."""
    return C.profile(table(spark, sf_dir, "documents").filter("text IS NOT NULL")).withColumns({"level": C.dominant_level(), "tiers": F.array_join(C.tiers(), ",")})


PLAIN = r"regexp_replace(text, '\r\n?', chr(10), 'g')"


def _restored(chunks):
    """doc_id, digest of the text that chunks give back, whether spans and contents agree, and where the last one ends."""
    spans = chunks.groupBy("doc_id").agg(F.every(F.length("content") == F.col("end_at") - F.col("start_at")).alias("spans_hold"), F.max("end_at").cast("long").alias("n_chars"))
    return C.restore(chunks).select("doc_id", F.sha2("text", 256).alias("text_sha256")).join(spans, "doc_id")


@query(f"SELECT doc_id, sha256({PLAIN}) AS text_sha256, TRUE AS spans_hold, length({PLAIN}) AS n_chars FROM documents WHERE text != ''")
def chunked_documents(spark, sf_dir):
    """Every document split by the tiers that its profile allows, and restored."""
    return _restored(materialise(C.split_documents(table(spark, sf_dir, "documents")), "chunks"))


@query(f"SELECT tier, doc_id, sha256({PLAIN}) AS text_sha256, TRUE AS spans_hold, length({PLAIN}) AS n_chars FROM documents, (VALUES ('headings'), ('heuristic'), ('recursive')) t(tier) WHERE text != ''")
def chunks_by_tier(spark, sf_dir):
    """Every document by each of the splitters."""
    docs, out = table(spark, sf_dir, "documents"), None
    for tier in C.SPLITTERS:
        made = _restored(materialise(C.split_documents(docs, tier=tier), f"chunks-{tier}")).withColumn("tier", F.lit(tier))
        out = made if out is None else out.unionByName(made)
    return out


@query()
def chunk_verdicts(spark, sf_dir):
    """What the validator says of the recursive splitter's chunks."""
    return C.validate(C.split_documents(table(spark, sf_dir, "documents"), tier="recursive"))


@query(f"SELECT doc_id, sha256({PLAIN}) AS parents_sha256, sha256({PLAIN}) AS children_sha256, TRUE AS inside FROM documents WHERE text != ''")
def parent_child_chunks(spark, sf_dir):
    """Both levels restore the text, and children lie within their parents."""
    both = materialise(C.parent_child(table(spark, sf_dir, "documents")), "parent-child")
    parents, children = both.filter("parent_index IS NULL"), both.filter("parent_index IS NOT NULL")
    above = parents.select("doc_id", F.col("chunk_index").alias("parent_index"), F.col("start_at").alias("a"), F.col("end_at").alias("z"), F.col("content").alias("whole"))
    within = (F.col("start_at") >= F.col("a")) & (F.col("end_at") <= F.col("z")) & (F.substr("whole", F.col("start_at") - F.col("a") + 1, F.length("content")) == F.col("content"))
    inside = children.join(above, ["doc_id", "parent_index"]).groupBy("doc_id").agg(F.every(within).alias("inside"))
    digest = lambda rows, name: C.restore(rows).select("doc_id", F.sha2("text", 256).alias(name))
    return digest(parents, "parents_sha256").join(digest(children, "children_sha256"), "doc_id").join(inside, "doc_id")


@query(f"SELECT doc_id, sha256({PLAIN}) AS body_sha256, TRUE AS within_limit FROM documents WHERE text != ''")
def embedding_input(spark, sf_dir):
    """Chunks as they are embedded, under title and breadcrumb; without these they give back the text."""
    docs = table(spark, sf_dir, "documents")
    chunks = C.split_documents(docs).join(docs.select("doc_id", "source", "lang"), "doc_id")
    head = F.concat_ws("\n", "source", F.concat_ws(" / ", "lang", "source"))
    made = chunks.withColumn("input", T.embedding_text(F.col("source"), F.concat_ws(" / ", "lang", "source"), F.col("content")))
    made = materialise(made.select("doc_id", "chunk_index", "start_at", "end_at", F.length("input").alias("size"), F.substr("input", F.length(head) + 2).alias("content")), "embedded")
    sizes = made.groupBy("doc_id").agg((F.max("size") <= 20_000).alias("within_limit"))
    return C.restore(made).select("doc_id", F.sha2("text", 256).alias("body_sha256")).join(sizes, "doc_id")


# --- stitching ---


def _chunk_hits(spark, sf_dir):
    """All chunks of all documents as hits, of one query a source."""
    docs = table(spark, sf_dir, "documents")
    chunks = C.split_documents(docs, tier="recursive").join(docs.select("doc_id", F.col("source").alias("query_id")), "doc_id")
    return materialise(
        chunks.select(
            "query_id", "doc_id", F.lit("text").alias("chunk_type"), F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "chunk_index", "start_at", "end_at",
            (1 / (F.col("chunk_index") + 1)).alias("score"), "content", F.lit(False).alias("edited"), F.lit(None).cast("string").alias("images"),
        ),
        "chunk-hits",
    )


@query(f"SELECT source AS query_id, doc_id, sha256({PLAIN}) AS content_sha256, 0 AS start_at, CAST(length({PLAIN}) AS INTEGER) AS end_at, 1.0::DOUBLE AS score FROM documents WHERE text != ''")
def stitched_documents(spark, sf_dir):
    """All chunks of a document, joined by their places, are the document."""
    made = S.stitch(_chunk_hits(spark, sf_dir), ranked=False)
    return made.select("query_id", "doc_id", F.sha2("content", 256).alias("content_sha256"), "start_at", "end_at", "score")


@query()
def stitched_parts(spark, sf_dir):
    """Chunks with gaps, and some of them edited."""
    hits = _chunk_hits(spark, sf_dir).filter("chunk_index % 5 != 3").withColumn("edited", F.col("chunk_index") % 7 == 2)
    made = S.stitch(hits)
    return made.select("query_id", "doc_id", "chunk_index", "start_at", "end_at", F.size("parts").cast("long").alias("n_parts"), F.sha2("content", 256).alias("content_sha256"), "rank")


@query()
def widened_hits(spark, sf_dir):
    """Short chunks with their neighbours."""
    chunks = C.split_documents(table(spark, sf_dir, "documents"), 160, 20, tier="recursive").select("doc_id", "chunk_index", "content")
    return S.widen(F.col("chunk_index") % 4 == 1, chunks).select("doc_id", "chunk_index", "n_joined", F.sha2("content", 256).alias("content_sha256"))


PARENTS_CTE = """ch AS (SELECT conv_id * 1000 + turn AS chunk_id, CASE role WHEN 'system' THEN 'parent_text' WHEN 'user' THEN 'text' ELSE 'image_ocr' END AS chunk_type, text AS content,
  CASE role WHEN 'user' THEN conv_id * 1000 WHEN 'assistant' THEN conv_id * 1000 + turn - 1 END AS parent_id FROM conversations)"""


@query(f"""WITH {PARENTS_CTE} SELECT a.chunk_id,
  CASE WHEN a.chunk_type = 'image_ocr' AND b.chunk_type = 'text' AND b.content != '' AND c.chunk_type = 'parent_text' AND c.content != '' THEN c.chunk_id
       WHEN (a.chunk_type = 'image_ocr' AND b.chunk_type = 'text' OR a.chunk_type = 'text' AND b.chunk_type = 'parent_text') AND b.content != '' THEN b.chunk_id ELSE a.chunk_id END AS context_id
FROM ch a LEFT JOIN ch b ON a.parent_id = b.chunk_id LEFT JOIN ch c ON b.parent_id = c.chunk_id""")
def parent_contexts(spark, sf_dir):
    """Turns as chunks: a user's turn under the system's, an assistant's as an image's text under the turn before it."""
    role, base = F.col("role"), F.col("conv_id") * 1000
    chunks = table(spark, sf_dir, "conversations").select(
        (base + F.col("turn")).alias("chunk_id"), F.when(role == "system", "parent_text").when(role == "user", "text").otherwise("image_ocr").alias("chunk_type"), F.col("text").alias("content"),
        F.when(role == "user", base).when(role == "assistant", base + F.col("turn") - 1).alias("parent_id"),
    )
    return S.with_parents(chunks, chunks).select("chunk_id", "context_id")


@query("""SELECT page_id, len(list_filter(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)), lambda u: contains(u, 'e'))) AS n_within FROM pages""")
def images_in_content(spark, sf_dir):
    """Links of a page as images with and without an address in the content."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    images = F.to_json(F.transform(links, lambda u: F.struct(u.alias("url"), F.lit("c").alias("caption"), F.lit("o").alias("ocr"))))
    content = F.concat(F.lit("| "), F.array_join(F.filter(links, lambda u: F.contains(u, F.lit("e"))), " | "), F.lit(" |"))
    kept = F.from_json(S.images_within(images, content), "array<struct<url:string>>")
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.filter(kept, lambda i: F.contains(i["url"], F.lit("e")))).cast("long").alias("n_within"))


SHOWN = """im AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda u, i: CASE WHEN i % 2 = 0 THEN '![' || i || '](' || u || ')' ELSE '<IMG alt="" src="' || u || '">' END) AS shown, list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS urls FROM pages),
ct AS (SELECT *, array_to_string(shown, ' and ') AS content FROM im), wi AS (SELECT *, substr(content, CAST(length(content) // 4 + 1 AS BIGINT), CAST(length(content) // 2 AS BIGINT)) AS part FROM ct)"""


@query(rf"""WITH {SHOWN} SELECT page_id, md5(part) AS part_md5, array_to_string(list_sort(list_filter(urls, lambda u: list_contains(regexp_extract_all(part, '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1), u)
  OR list_contains(regexp_extract_all(part, 'src="([^"\s]+)"', 1), u))), ' ') AS urls FROM wi""")
def images_by_range(spark, sf_dir):
    """Links of a page as images, those that the middle half of the content shows; every second by its original address."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    shown = F.transform(links, lambda u, i: F.when((i + 1) % 2 == 0, F.concat(F.lit("!["), i + 1, F.lit("]("), u, F.lit(")"))).otherwise(F.concat(F.lit('<IMG alt="" src="'), u, F.lit('">'))))
    images = F.transform(F.array_distinct(links), lambda u, i: F.struct(F.when(i % 2 == 0, u).alias("url"), F.when(i % 2 == 1, u).alias("original_url"), F.lit("c").alias("caption")))
    at = table(spark, sf_dir, "pages").select("page_id", F.to_json(images).alias("images"), F.array_join(shown, " and ").alias("content"))
    first = F.lit(1000) + F.floor(F.length("content") / 4)
    span = first, first + F.floor(F.length("content") / 2)
    kept = F.from_json(S.images_in_range(F.col("images"), F.col("content"), F.lit(1000), *span), S.IMAGE_LIST)
    urls = F.transform(F.coalesce(kept, F.array().cast(S.IMAGE_LIST)), lambda i: F.coalesce(i["url"], i["original_url"]))
    return at.select("page_id", F.md5(S.within_range(F.col("content"), F.lit(1000), *span)).alias("part_md5"), F.array_join(F.array_sort(urls), " ").alias("urls"))


# --- questions and answers: a conversation's first user turn is the question, its other ones similar, the assistant's turns answers ---

FAQ_CTE = """faq AS (SELECT conv_id AS doc_id, min_by(text, turn) FILTER (role = 'user') AS question, list(text ORDER BY turn) FILTER (role = 'user') AS asked, list(text ORDER BY turn) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id)"""


def faqs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    texts = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda s: s["text"])
    at = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(texts("user").alias("asked"), texts("assistant").alias("answers"))
    return at.select("doc_id", F.try_element_at("asked", F.lit(1)).alias("question"), F.slice("asked", 2, F.greatest(F.size("asked") - 1, F.lit(0))).alias("similar"), "answers")


@query(f"""WITH {FAQ_CTE} SELECT doc_id, sha256(concat_ws(chr(10), 'Q: ' || nullif(trim(question), ''), CASE WHEN len(a) > 0 THEN 'Answer:' || chr(10) || '- ' || array_to_string(a, chr(10) || '- ') END)) AS body_sha256
FROM (SELECT *, coalesce(list_filter(list_transform(answers, lambda x: trim(x)), lambda x: x != ''), []) AS a FROM faq)""")
def faq_answer_bodies(spark, sf_dir):
    return faqs(spark, sf_dir).select("doc_id", F.sha2(Q.answer_body(F.col("question"), F.col("answers")), 256).alias("body_sha256"))


@query(f"""WITH {FAQ_CTE} SELECT doc_id, coalesce(list_filter(asked[2:], lambda s: regexp_matches(s, '(?i)[aeiou]{{2}}n'))[1], question) AS matched FROM faq""")
def faq_matched_questions(spark, sf_dir):
    return faqs(spark, sf_dir).select("doc_id", Q.matched_question("[aeiou]{2}n", F.col("question"), F.col("similar")).alias("matched"))


@query(f"""WITH {FAQ_CTE}, p AS (SELECT doc_id, trim(question) AS q, list_sort(list_distinct(list_filter(list_transform(coalesce(asked[2:], []), lambda x: trim(x)), lambda x: x != ''))) AS s,
  list_sort(list_distinct(list_filter(list_transform(coalesce(answers, []), lambda x: trim(x)), lambda x: x != ''))) AS a FROM faq)
SELECT doc_id, sha256(coalesce(q, '') || chr(31) || array_to_string(s, chr(30)) || chr(31) || chr(31) || array_to_string(a, chr(30))) AS digest, TRUE AS stable FROM p""")
def faq_digests(spark, sf_dir):
    """Content digests, and whether an entry with spaces, blanks, repeats and another order has the same."""
    at = faqs(spark, sf_dir)
    digest = Q.content_digest(F.col("question"), F.col("similar"), F.array(), F.col("answers"))
    untidy = Q.content_digest(
        F.concat(F.lit("  "), "question"), F.reverse(F.concat("similar", F.array(F.lit(" ")), "similar")), F.array(F.lit("")), F.transform(F.reverse("answers"), lambda a: F.concat(a, F.lit(" ")))
    )
    return at.select("doc_id", digest.alias("digest"), (digest == untidy).alias("stable"))


@query(f"""WITH {FAQ_CTE}, no AS (SELECT doc_id - 1 AS doc_id, lower(trim(question)) AS q FROM faq WHERE trim(question) != ''),
hits AS (SELECT a.doc_id AS query_id, a.question, b.doc_id FROM faq a JOIN faq b ON abs(a.doc_id - b.doc_id) <= 1)
SELECT query_id, doc_id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM no WHERE no.doc_id = h.doc_id AND no.q = lower(trim(h.question)))""")
def faq_negatives(spark, sf_dir):
    """Each entry bars the next one's question; queries are the questions, with spaces, on their entry and its neighbours."""
    at = materialise(faqs(spark, sf_dir), "faqs")
    barred = at.select((F.col("doc_id") - 1).alias("doc_id"), F.array(F.concat(F.lit(" "), "question"), F.lit(" ")).alias("negatives"))
    asked = at.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("  "), "question").alias("query"))
    hits = at.select(F.explode(F.sequence(F.col("doc_id") - 1, F.col("doc_id") + 1)).alias("query_id"), "doc_id").join(at.select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    return Q.without_negatives(hits, asked, barred)


@query("""WITH e AS (SELECT user_id, event_id % 40 AS doc_id, value AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events),
barred AS (SELECT DISTINCT user_id, event_id % 40 AS doc_id FROM events WHERE event_type = 'error'),
r AS (SELECT e.*, b.doc_id IS NULL AS ok FROM e LEFT JOIN barred b USING (user_id, doc_id)),
n AS (SELECT user_id, depth, count(DISTINCT doc_id) FILTER (ok AND rank <= depth) AS n, max(rank) AS found FROM r, (VALUES (30), (60), (120), (240), (480)) d(depth) GROUP BY ALL),
c AS (SELECT user_id, coalesce(min(depth) FILTER (n >= 10 OR found < depth), 480) AS depth FROM n GROUP BY user_id)
SELECT user_id, doc_id, max(score) AS score, any_value(depth) AS depth FROM r JOIN c USING (user_id) WHERE ok AND rank <= depth GROUP BY user_id, doc_id""")
def faq_deepened(spark, sf_dir):
    """Ten entries a user from ever deeper lists, without those that an error bars."""
    e = table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % 40)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    ranked = e.select("user_id", "doc_id", F.col("value").alias("score"), rank.alias("rank"))
    return Q.deepened(ranked, e.filter("event_type = 'error'").select("user_id", "doc_id").distinct(), 10, "user_id")


ESCAPED = "replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _tags(name: str, items: str) -> str:
    return f"list_transform({items}, lambda x: '<{name}>' || {ESCAPED} || '</{name}>')"


@query(f"""WITH {FAQ_CTE} SELECT doc_id, array_to_string(list_concat(list_concat(list_concat(['<faq faq_id="' || doc_id || '">'], CASE WHEN coalesce(question, '') != '' THEN {_tags("question", "[question]")} ELSE [] END),
  list_concat({_tags("similar_question", "coalesce(asked[2:][1:5], [])")}, CASE WHEN len(coalesce(asked[2:], [])) > 5 THEN ['<similar_questions_omitted count="' || (len(asked[2:]) - 5) || '" />'] ELSE [] END)),
  list_concat({_tags("answer", "list_filter(coalesce(answers, []), lambda a: trim(a) != '')")}, ['</faq>'])), chr(10)) AS entry FROM faq""")
def faq_entries(spark, sf_dir):
    """Entries as a model sees them."""
    return faqs(spark, sf_dir).select("doc_id", Q.rendered(F.col("doc_id"), F.col("question"), F.col("similar"), F.col("answers")).alias("entry"))
