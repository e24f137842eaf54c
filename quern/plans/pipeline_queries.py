"""Rerank, joins, metrics, graph, memory and mutation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph as G
from quern.operators import memory as M
from quern.operators import metrics as E
from quern.operators import relations as J
from quern.operators.containment import containing
from quern.operators import rerank as K
from quern.operators import retrieval as R
from quern.plans.registry import ORACLE_SQL, query
from quern.plans.retrieval_queries import BM25_CTE, COS_CTE, bench_queries, vector_queries
from quern.plans.text_queries import NORMALISE
from quern.session import materialise, table


def _candidates(spark, sf_dir, k=50):
    docs = table(spark, sf_dir, "documents")
    hits = R.bm25(docs, bench_queries(spark, sf_dir), k)
    return J.hydrate(hits.withColumn("score", F.round(F.col("score") / 100, 6)), docs.select("doc_id", "text", "source", "lang"))


@query()
def mmr_rerank(spark, sf_dir):
    return K.mmr(_candidates(spark, sf_dir), 10)


@query()
def partial_overlap_removal(spark, sf_dir):
    return K.drop_overlaps(_candidates(spark, sf_dir), source_col="source")


@query("""SELECT event_id, round(least(greatest(0.6 * value / 100 + 0.3 * (user_id % 10) / 10.0 + 0.1 * CASE WHEN event_type = 'view' THEN 0.95 ELSE 1.0 END, 0), 1), 6) AS composite,
  round(least(value / 100 * 1.2, 1), 6) AS faq, round(CASE WHEN user_id % 12 >= 1 THEN 1 + 0.15 * least(ln(1 + user_id % 12) / ln(9), 1) ELSE 1 END, 6) AS familiar FROM events""")
def composite_scores(spark, sf_dir):
    e, value = table(spark, sf_dir, "events"), F.col("value") / 100
    return e.select(
        "event_id", F.round(K.composite(value, F.col("user_id") % 10 / 10, F.col("event_type") == "view"), 6).alias("composite"),
        F.round(K.faq_boost(value, 1.2), 6).alias("faq"), F.round(K.familiar_boost(F.col("user_id") % 12), 6).alias("familiar"),
    )


@query("""WITH e AS (SELECT user_id, event_id AS doc_id, round(value / 1000, 6) AS score FROM events),
w AS (SELECT *, max(score) OVER (PARTITION BY user_id) AS best, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS r FROM e)
SELECT user_id, doc_id, score FROM w WHERE CASE WHEN best >= 0.5 THEN score >= 0.5 WHEN best >= 0.35 THEN score >= 0.35 ELSE r = 1 AND score >= 0.15 END""")
def threshold_degradation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("doc_id"), F.round(F.col("value") / 1000, 6).alias("score"))
    return K.threshold(e, "user_id")


@query(f"SELECT min(doc_id) AS doc_id, md5({NORMALISE}) AS signature, count(*) AS n_copies FROM documents GROUP BY 2")
def signature_dedup(spark, sf_dir):
    return K.first_by_signature(table(spark, sf_dir, "documents")).select("doc_id", "signature", "n_copies")


TOKENS = f"list_distinct(list_filter(string_split({NORMALISE}, ' '), lambda w: length(w) > 1 AND regexp_matches(w, '[\\p{{L}}\\p{{N}}]')))"


@query(f"""WITH t AS (SELECT page_id, {TOKENS.replace("text", "html")} AS t FROM pages),
h AS (SELECT q.page_id AS query_id, d.page_id AS doc_id, round(1.0 / (q.page_id - d.page_id) * 0.6, 6) AS score FROM t q JOIN t d ON d.page_id BETWEEN q.page_id - 6 AND q.page_id - 2
      WHERE len(list_distinct(list_concat(q.t, d.t))) > 0 AND len(list_intersect(q.t, d.t)) / len(list_distinct(list_concat(q.t, d.t))) >= 0.15),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM h)
SELECT * FROM r WHERE rank <= 3""")
def history_injection(spark, sf_dir):
    """For each page the six before it, the last of which is present already."""
    pages = table(spark, sf_dir, "pages")
    # A page's tokens are taken once, not once a pair that it is in.
    asked = materialise(pages.select(F.col("page_id").alias("query_id"), T.token_set(F.col("html")).alias("query")), "page-tokens")
    before = asked.withColumn("doc_id", F.explode(F.sequence(F.col("query_id") - 6, F.col("query_id") - 1)))
    history = before.join(asked.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text")), "doc_id").withColumn("score", 1 / (F.col("query_id") - F.col("doc_id")))
    out = K.inject_history(history, asked.select("query_id", (F.col("query_id") - 1).alias("doc_id")))
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {BM25_CTE} SELECT query_id, rank, doc_id, source, lang, n_chars FROM bm_ranked JOIN documents USING (doc_id) WHERE rank <= 10""")
def hydrated_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return J.hydrate(R.bm25(docs, bench_queries(spark, sf_dir), 10), docs.select("doc_id", "source", "lang", "n_chars")).select("query_id", "rank", "doc_id", "source", "lang", "n_chars")


@query("""WITH hit AS (SELECT conv_id, turn FROM conversations WHERE length(text) > 1500),
near AS (SELECT conv_id, turn - 1 AS turn FROM hit UNION SELECT conv_id, turn + 1 FROM hit), n AS (SELECT * FROM near EXCEPT SELECT * FROM hit)
SELECT conv_id, turn, role, 'hit' AS match_type FROM conversations JOIN hit USING (conv_id, turn)
UNION ALL SELECT conv_id, turn, role, 'neighbour' FROM conversations JOIN n USING (conv_id, turn)""")
def context_enrichment(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return J.with_neighbours(turns.filter(F.length("text") > 1500), turns, "conv_id", "turn").select("conv_id", "turn", "role", "match_type")


ENRICHED = """ch AS (SELECT conv_id * 1000 + turn AS chunk_id, role, length(text) AS n, CASE WHEN turn > 0 THEN conv_id * 1000 END AS parent, [conv_id * 1000 + 1000 + turn, conv_id * 1000 + turn + 2] AS related,
  CASE WHEN role != 'system' THEN conv_id * 1000 + turn + 1 END AS after, CASE WHEN role != 'system' THEN conv_id * 1000 + turn - 1 END AS before FROM conversations),
h AS (SELECT role AS query_id, *, row_number() OVER (PARTITION BY role ORDER BY n DESC, chunk_id) AS rank FROM ch WHERE n > 1500),
nm AS (SELECT query_id, rank, 1 AS o, 'parent' AS match_type, n::DOUBLE AS score, parent AS chunk_id FROM h UNION ALL SELECT query_id, rank, 2, 'related', 0, unnest(related) FROM h
  UNION ALL SELECT query_id, rank, 3, 'near', 0, after FROM h UNION ALL SELECT query_id, rank, 3, 'near', 0, before FROM h),
fi AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, o) AS r FROM nm WHERE chunk_id IN (SELECT chunk_id FROM ch))"""


@query(f"""WITH {ENRICHED} SELECT query_id, chunk_id, 'hit' AS match_type, n::DOUBLE AS score FROM h
UNION ALL SELECT query_id, chunk_id, match_type, score FROM fi WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = fi.query_id AND h.chunk_id = fi.chunk_id)""")
def related_context(spark, sf_dir):
    """Long turns of each role with their conversation's first turn, the turns that they are related to, and their neighbours."""
    base, turn, spoken = F.col("conv_id") * 1000, F.col("turn"), F.col("role") != "system"
    chunks = table(spark, sf_dir, "conversations").select(
        (base + turn).alias("chunk_id"), F.col("role").alias("query_id"), F.length("text").alias("score"), F.when(spoken, "text").otherwise("parent_text").alias("kind"), F.when(turn > 0, base).alias("parent_id"),
        F.array(base + 1000 + turn, base + turn + 2).alias("related"), (base + turn + 1).alias("after_id"), (base + turn - 1).alias("before_id"),
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return J.enriched(chunks.filter("score > 1500").withColumn("rank", rank), chunks)


CONTAINS = "SELECT d.doc_id, b.item_id AS passage_id FROM documents d, benchmark b WHERE d.text != '' AND (contains(d.text, b.text) OR contains(b.text, d.text))"


@query(CONTAINS)
def passage_containment(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return containing(table(spark, sf_dir, "documents"), passages)


@query(r"""WITH names AS (SELECT DISTINCT regexp_extract(html, '<title>([^<]*)</title>', 1) AS name FROM pages),
p AS (SELECT name, regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g') AS p FROM names),
g AS (SELECT name, CASE WHEN length(p) > 1 THEN list_distinct(list_transform(range(1, length(p)), lambda i: substring(p, i, 2))) WHEN length(p) = 1 THEN [p] ELSE [] END AS g FROM p),
s AS (SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON a.name < b.name AND len(a.g) > 0 AND len(b.g) > 0)
SELECT * FROM s WHERE similarity >= 0.6""")
def similar_titles(spark, sf_dir):
    names = table(spark, sf_dir, "pages").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"))
    return J.similar_surfaces(names, 0.6)


@query(f"""WITH {BM25_CTE.replace("WHERE item_id % 20 = 0", "")}, truth AS (SELECT b.item_id AS query_id, d.doc_id FROM documents d, benchmark b WHERE d.text != '' AND (contains(d.text, b.text) OR contains(b.text, d.text))),
h AS (SELECT query_id, doc_id, rank, t.doc_id IS NOT NULL AS hit FROM bm_ranked r LEFT JOIN truth t USING (query_id, doc_id) WHERE rank <= 10),
c AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM h),
m AS (SELECT query_id, count(*) AS n, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first, sum(so_far / rank) FILTER (hit) AS ps,
      sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 3) AS d3, sum(1 / log2(rank + 1)) FILTER (hit) AS d10 FROM c GROUP BY query_id),
w AS (SELECT query_id, count(*) AS wanted FROM truth GROUP BY query_id)
SELECT query_id, round(coalesce(hits / n, 0), 6) AS precision, round(coalesce(hits / wanted, 0), 6) AS recall,
  round(coalesce(d3 / list_sum(list_transform(range(1, least(wanted, n, 3) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg3,
  round(coalesce(d10 / list_sum(list_transform(range(1, least(wanted, n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg10,
  round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(ps / hits, 0), 6) AS map FROM w LEFT JOIN m USING (query_id)""")
def retrieval_metrics(spark, sf_dir):
    """The whole evaluation set: every benchmark item."""
    docs = table(spark, sf_dir, "documents")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    truth = containing(docs, asked.select(F.col("query_id").alias("passage_id"), F.col("query").alias("passage")))
    return E.retrieval_metrics(R.bm25(docs, asked, 10), truth.select(F.col("passage_id").alias("query_id"), "doc_id"))


def _said_pairs(spark, sf_dir):
    """Each assistant turn against the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("generated"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    return said.join(before, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("pair_id"), "generated", "truth")


PAIRS_CTE = r"""pairs AS (SELECT a.conv_id, a.turn, a.text AS h, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant'),
sides AS (SELECT conv_id, turn, 'h' AS side, h AS text FROM pairs UNION ALL SELECT conv_id, turn, 'r', r FROM pairs),
words AS (SELECT conv_id, turn, side, flatten(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[。.]'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p != ''),
            lambda p: regexp_extract_all(p, '[一-鿿㐀-䶿]+|[a-zA-Z0-9_.,!?]+|[^a-zA-Z0-9_\s]'))) AS w FROM sides)""".replace("\\", "\\")


@query("WITH " + PAIRS_CTE + (r""",
grams AS (SELECT conv_id, turn, side, kind, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(v[i:i + n - 1], ' '))) AS gram
          FROM (SELECT *, CASE WHEN kind = 'bleu' THEN list_transform(w, lambda x: lower(x)) ELSE w END AS v FROM words, (VALUES ('bleu', 1), ('bleu', 2), ('bleu', 3), ('bleu', 4), ('rouge', 1), ('rouge', 2)) k(kind, n)) WHERE len(w) >= n),
c AS (SELECT conv_id, turn, kind, n, gram, count(*) FILTER (side = 'h') AS a, count(*) FILTER (side = 'r') AS b FROM grams GROUP BY ALL),
s AS (SELECT conv_id, turn, kind, n, sum(a) AS total, sum(least(a, b)) AS clipped, count(*) FILTER (a > 0 AND b > 0) AS shared, count(*) FILTER (a > 0) AS own, count(*) FILTER (b > 0) AS other FROM c GROUP BY ALL),
t AS (SELECT conv_id, turn, exp(sum(CASE WHEN kind = 'bleu' AND n <= 1 AND total > 0 THEN ln((clipped + 1) / (total + 1)) END)) AS b1, exp(sum(CASE WHEN kind = 'bleu' AND n <= 2 AND total > 0 THEN ln((clipped + 1) / (total + 1)) / 2 END)) AS b2,
        exp(sum(CASE WHEN kind = 'bleu' AND total > 0 THEN ln((clipped + 1) / (total + 1)) / 4 END)) AS b4,
        max(CASE WHEN kind = 'rouge' AND n = 1 THEN 2.0 * shared / own * shared / other / (shared / own + shared / other + 1e-8) END) AS r1,
        max(CASE WHEN kind = 'rouge' AND n = 2 THEN 2.0 * shared / own * shared / other / (shared / own + shared / other + 1e-8) END) AS r2 FROM s GROUP BY ALL),
z AS (SELECT conv_id, turn, max(len(w)) FILTER (side = 'h') AS h, max(len(w)) FILTER (side = 'r') AS r FROM words GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(brevity * b1, 0), 6) AS bleu1, round(coalesce(brevity * b2, 0), 6) AS bleu2, round(coalesce(brevity * b4, 0), 6) AS bleu4, round(coalesce(r1, 0), 6) AS rouge1, round(coalesce(r2, 0), 6) AS rouge2
FROM (SELECT *, CASE WHEN h = 0 THEN 0 WHEN h > r THEN 1 ELSE exp(1 - r / h) END AS brevity FROM z) LEFT JOIN t USING (conv_id, turn)"""))
def generation_metrics(spark, sf_dir):
    scores = E.text_metrics(_said_pairs(spark, sf_dir))
    return scores.select("pair_id.conv_id", "pair_id.turn", *[F.round(m, 6).alias(m) for m in ("bleu1", "bleu2", "bleu4", "rouge1", "rouge2")])


@query()
def rouge_l_scores(spark, sf_dir):
    return E.rouge_l(_said_pairs(spark, sf_dir)).select("pair_id.conv_id", "pair_id.turn", F.round("rougel", 6).alias("rougel"))


@query()
def metric_means(spark, sf_dir):
    """The means of the text metrics over all pairs."""
    pairs = _said_pairs(spark, sf_dir)
    scores = E.text_metrics(pairs).join(E.rouge_l(pairs), "pair_id")
    return E.mean_metrics(scores).select("metric", F.round("mean", 6).alias("mean"), "n")


@query(r"""WITH p AS (SELECT item_id, a.text AS a, b.text AS b FROM benchmark a JOIN (SELECT item_id - 1 AS item_id, text FROM benchmark) b USING (item_id)),
w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(a), '[\p{L}\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(b), '[\p{L}\p{N}]+')) AS b FROM p)
SELECT item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS overlap FROM w""")
def set_similarity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    w = lambda df: df.select("item_id", F.array_distinct(T.words(F.col("text"))).alias("w"))
    pairs = w(b).join(w(b).select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v")), "item_id")
    return pairs.select("item_id", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"), F.round(T.overlap_coefficient(F.col("w"), F.col("v")), 6).alias("overlap"))


# --- graph ---


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT a, b FROM ways WHERE a IN (SELECT p_partkey FROM part WHERE contains(p_name, 'ring'))""")
def graph_pattern(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    return G.neighbours(nodes, edges, "ring")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem)
SELECT coalesce(a, b) AS node, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM (SELECT a, count(*) AS o FROM e GROUP BY a) x FULL JOIN (SELECT b, count(*) AS i FROM e GROUP BY b) y ON a = b""")
def entity_degrees(spark, sf_dir):
    return G.degrees(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")))


WIKI_CTE = r"""p AS (SELECT page_id, lower(regexp_extract(html, '<title>([^ <]*)', 1)) AS title, html FROM pages),
wp AS (SELECT title AS slug, min(html) AS text FROM p GROUP BY title),
wl AS (SELECT DISTINCT title AS slug, lower(unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1))) AS target FROM p),
lint AS (SELECT wp.slug, coalesce(nb, 0) AS n_broken, coalesce(no, 0) AS n_out, coalesce(ni, 0) AS n_in, coalesce(ni, 0) = 0 AS is_orphan, strlen(text) < 50 AS is_empty FROM wp
  LEFT JOIN (SELECT slug, count(*) AS nb FROM wl WHERE target NOT IN (SELECT slug FROM wp) GROUP BY slug) USING (slug)
  LEFT JOIN (SELECT slug, count(*) AS no FROM wl GROUP BY slug) USING (slug)
  LEFT JOIN (SELECT target AS slug, count(*) AS ni FROM wl WHERE slug != target GROUP BY target) USING (slug))"""


def _wiki(spark, sf_dir):
    """Pages as wiki pages: the title's first word is the slug, their menu the links."""
    p = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("html", "<title>([^ <]*)", 1)).alias("slug"), "html")
    links = p.select("slug", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("target"))
    return p.groupBy("slug").agg(F.min("html").alias("text")), links.select("slug", F.lower("target").alias("target"))


@query(f"WITH {WIKI_CTE} SELECT * FROM lint")
def wiki_lint(spark, sf_dir):
    return G.lint(*_wiki(spark, sf_dir))


@query(f"""WITH {WIKI_CTE} SELECT count(*) AS n_pages, count(*) FILTER (is_orphan) AS orphans, CAST(sum(n_broken) AS BIGINT) AS broken,
CAST(greatest(100 - floor(count(*) FILTER (is_orphan) * 100 / count(*)) - 5 * sum(n_broken) - CASE WHEN sum(n_out) = 0 THEN 15 ELSE 0 END - 3 * count(*) FILTER (is_empty), 0) AS BIGINT) AS score FROM lint""")
def wiki_health(spark, sf_dir):
    return G.health(G.lint(*_wiki(spark, sf_dir)))


def _grams(name: str) -> str:
    p = f"regexp_replace(lower({name}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    return f"(CASE WHEN length({p}) > 1 THEN list_distinct(list_transform(range(1, length({p})), lambda i: substring({p}, i, 2))) WHEN length({p}) = 1 THEN [{p}] ELSE [] END)"


@query(f"""WITH {WIKI_CTE}, dead AS (SELECT DISTINCT target AS slug FROM wl),
k AS (SELECT replace(replace(slug, '-', ''), '_', '') AS key, min(slug) AS slug FROM wp GROUP BY 1),
r AS (SELECT d.slug, e.slug AS exact, k.slug AS normalised FROM dead d LEFT JOIN wp e ON d.slug = e.slug LEFT JOIN k ON replace(replace(d.slug, '-', ''), '_', '') = k.key),
g AS (SELECT slug, {_grams("slug")} AS g FROM r WHERE exact IS NULL AND normalised IS NULL), h AS (SELECT slug AS page, {_grams("slug")} AS h FROM wp),
f AS (SELECT slug, page, row_number() OVER (PARTITION BY slug ORDER BY round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) DESC, page) AS n FROM g JOIN h ON len(g) > 0 AND len(h) > 0
      AND round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) >= 0.8)
SELECT r.slug, coalesce(exact, normalised, page) AS found, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN normalised IS NOT NULL THEN 'normalised' WHEN page IS NOT NULL THEN 'fuzzy' END AS how
FROM r LEFT JOIN f ON r.slug = f.slug AND f.n = 1""")
def dead_slugs(spark, sf_dir):
    pages, links = _wiki(spark, sf_dir)
    return G.resolve_slugs(links.select(F.col("target").alias("slug")).distinct(), pages.withColumn("title", F.lit(None).cast("string")))


@query(r"""WITH f AS (SELECT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS p FROM pages), s AS (SELECT list_filter(string_split(p, '/'), lambda x: x != '') AS parts FROM f),
a AS (SELECT array_to_string(parts, '/') AS own, unnest(list_transform(range(0, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS folder FROM s)
SELECT folder, count(*) FILTER (folder = own) AS n_direct, count(*) AS n_total FROM a GROUP BY folder""")
def folder_tree(spark, sf_dir):
    return G.folder_totals(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://|[?#].*$", "").alias("path"))).select("folder", F.col("n_direct").cast("long").alias("n_direct"), "n_total")


@query("""WITH RECURSIVE n AS (SELECT page_id AS id, CASE WHEN page_id > 0 THEN (page_id - 1) // 3 END AS parent FROM pages),
d AS (SELECT id AS root, id, 0 AS level FROM n WHERE id BETWEEN 1 AND 3 UNION ALL SELECT root, n.id, level + 1 FROM d JOIN n ON n.parent = d.id WHERE level < 4 AND n.id % 11 != 5)
SELECT root, id, level, level = 4 AND id IN (SELECT parent FROM n WHERE id % 11 != 5 AND parent IS NOT NULL) AS cut FROM d WHERE level > 0""")
def span_descendants(spark, sf_dir):
    """Pages as spans of a tree with three children a node, those that aren't done, four levels below the first three."""
    n = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") > 0, F.floor((F.col("page_id") - 1) / 3)).alias("parent"))
    return G.descendants(n, n.filter("id BETWEEN 1 AND 3"), 4, F.col("id") % 11 != 5)


# --- memory and conversations ---


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, n_chars % 5 AS importance FROM documents),
q AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id % 20 = 0),
qt AS (SELECT DISTINCT item_id AS query_id, term, weight FROM (SELECT item_id, unnest(list_filter(w, lambda x: length(x) > 1)) AS term, 1 AS weight FROM q
        UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM q)),
dt AS (SELECT DISTINCT doc_id, importance, term FROM (SELECT doc_id, importance, unnest(w) AS term FROM d
        UNION ALL SELECT doc_id, importance, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d) WHERE term IN (SELECT term FROM qt)),
s AS (SELECT query_id, doc_id AS item_id, round(sum(weight) / any_value(total) + 0.01 * any_value(importance), 6) AS score
      FROM dt JOIN qt USING (term) JOIN (SELECT query_id, sum(weight) AS total FROM qt GROUP BY query_id) USING (query_id) GROUP BY query_id, doc_id)
SELECT * FROM s WHERE score >= 0.15""")
def memory_recall(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"), (F.col("n_chars") % 5).alias("importance"))
    return M.recall(items, bench_queries(spark, sf_dir))


@query(ORACLE_SQL["memory_recall"].replace("SELECT * FROM s WHERE score >= 0.15", f""", {COS_CTE},
l AS (SELECT query_id, item_id AS doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s WHERE score >= 0.15),
every AS (SELECT query_id, doc_id, rank FROM l WHERE rank <= 20 UNION ALL SELECT query_id, vec_id, rank FROM cos_ranked WHERE rank <= 20 AND score >= 0.5 AND query_id IN (SELECT item_id FROM benchmark))
SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 9) AS score FROM every GROUP BY ALL"""))
def memory_hybrid_recall(spark, sf_dir):
    """Lexical recall and vectors of at least half the query's direction, fused by ranks."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"), (F.col("n_chars") % 5).alias("importance"))
    asked = bench_queries(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    lexical = M.recall(items, asked).select("query_id", F.col("item_id").alias("doc_id"), F.row_number().over(order).alias("rank")).filter("rank <= 20")
    vectors = vector_queries(spark, sf_dir).join(asked, "query_id", "left_semi")
    return R.plain_rrf([lexical, R.vector_search(table(spark, sf_dir, "embeddings"), vectors, 20, threshold=0.5).withColumnRenamed("vec_id", "doc_id")])


@query()
def memory_budget(spark, sf_dir):
    """At most 5 of 50 candidates a query, 4000 characters in all."""
    at = _candidates(spark, sf_dir).select("query_id", "doc_id", "rank", (F.length("text") + 3).alias("cost"))
    return M.within_budget(at, "query_id", 5, 4000)


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""")
def recent_turns(spark, sf_dir):
    return M.recent_turns(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS first_message, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def first_user_message(spark, sf_dir):
    user = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first_message"), F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"))


# --- mutations ---


@query("""WITH ch AS (SELECT doc_id + 500 AS doc_id, source, lang FROM documents)
SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ch) UNION ALL SELECT * FROM ch""")
def index_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return J.upsert(docs, docs.withColumn("doc_id", F.col("doc_id") + 500), ["doc_id"])


@query("""SELECT doc_id, source FROM documents UNION ALL SELECT doc_id + 500, 'new' FROM documents WHERE doc_id + 500 NOT IN (SELECT doc_id FROM documents)""")
def insert_or_ignore(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return J.insert_missing(docs, docs.select((F.col("doc_id") + 500).alias("doc_id"), F.lit("new").alias("source")), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def index_delete(spark, sf_dir):
    return J.delete(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("toxic = 1"), ["doc_id"])


@query("SELECT doc_id + 1000000 AS doc_id, source FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def index_copy(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") + 1000000).alias("new_id")).distinct()
    return J.copy_with_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), ids, "doc_id")


@query("SELECT doc_id, coalesce(toxic = 0, TRUE) AS enabled, CASE WHEN source = 'src3' THEN 'src4' ELSE source END AS source FROM documents LEFT JOIN labels USING (doc_id)")
def bulk_enable_and_move(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("enabled"), F.when(F.col("source") == "src3", "src4").otherwise(F.col("source")).alias("source"))
    return J.set_flags(docs, table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 0).alias("enabled")), "doc_id", "enabled")


@query("""WITH a AS (SELECT doc_id, md5(text) AS d FROM documents WHERE doc_id % 3 != 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN upper(text) ELSE text END) AS d FROM documents WHERE doc_id % 5 != 0)
SELECT doc_id, CASE WHEN b.d IS NULL THEN 'add' WHEN a.d IS NULL THEN 'delete' WHEN a.d = b.d THEN 'keep' ELSE 'update' END AS change FROM a FULL JOIN b USING (doc_id)""")
def knowledge_base_diff(spark, sf_dir):
    """Two snapshots of the documents by content digest."""
    docs = table(spark, sf_dir, "documents")
    a = docs.filter("doc_id % 3 != 0").select("doc_id", F.md5("text").alias("d"))
    b = docs.filter("doc_id % 5 != 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text"))).alias("d"))
    return J.diff(a, b, "doc_id", "d")


@query("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + 21600000000 AS z, value FROM events),
l AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT user_id, min(a) AS start_at, max(z) AS end_at, count(*) AS n_spans, max(value) AS score FROM i GROUP BY user_id, island""")
def merged_spans(spark, sf_dir):
    """Six-hour spans from each event, joined by user where they overlap."""
    a = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("user_id", a.alias("start_at"), (a + 21600000000).alias("end_at"), F.col("value").alias("score"))
    return J.merge_spans(spans, ["user_id"])
