"""Graphs from replies, code relations, folders, memories, topics, streams and evaluation sets."""

import uuid

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph as G
from quern.operators.clusters import clusters
from quern.operators import memory as M
from quern.operators import relations as J
from quern.operators.containment import containing
from quern.operators import rerank as K
from quern.operators import retrieval as R
from quern.plans.pipeline_queries import _grams
from quern.plans.registry import query
from quern.plans.text_queries import NORMALISE
from quern.session import materialise, shared_dir, table
from quern.sources import feed
from quern.streaming import ingest

# --- graphs ---


def _replies(spark, sf_dir):
    """For each order a model's reply: its parts as nodes, and relations from parts to suppliers and, now and then, to themselves."""
    part, supplier = F.concat(F.lit("part "), "l_partkey"), F.concat(F.lit(" supplier "), "l_suppkey", F.lit(" "))
    target = F.when(F.col("l_linenumber") == 4, part).otherwise(supplier)
    kind = F.when(F.col("l_returnflag") == "N", "sells").when(F.col("l_returnflag") == "A", "made_by").otherwise("odd")
    of = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list(F.struct(part.alias("name"))).alias("nodes"), F.collect_list(F.struct(part.alias("from"), target.alias("to"), kind.alias("type"))).alias("relations")
    )
    return of.select("id", F.concat(F.lit("Found:\n```json\n"), F.to_json(F.struct("nodes", "relations")), F.lit("\n```")).alias("text"))


EDGES_CTE = """e AS (SELECT DISTINCT l_orderkey AS id, 'part ' || l_partkey AS a, 'supplier ' || l_suppkey AS b, CASE l_returnflag WHEN 'N' THEN 'sells' WHEN 'A' THEN 'made_by' ELSE 'odd' END AS kind FROM lineitem WHERE l_linenumber != 4),
f AS (SELECT * FROM e WHERE kind IN ('sells', 'made_by'))"""


@query(f"WITH {EDGES_CTE} SELECT * FROM f")
def graph_edges_from_replies(spark, sf_dir):
    return G.parse_graph(_replies(spark, sf_dir), ["sells", "made_by"])[1]


@query(f"WITH {EDGES_CTE} SELECT l_orderkey AS id, 'part ' || l_partkey AS name FROM lineitem UNION SELECT id, b FROM f")
def graph_nodes_from_replies(spark, sf_dir):
    """Named nodes, and the ends of relations that no node names."""
    return G.parse_graph(_replies(spark, sf_dir), ["sells", "made_by"])[0]


@query("""WITH r AS (SELECT event_type AS namespace, 'user ' || user_id AS name, 'a' || event_id % 7 AS attribute, event_id AS chunk FROM events WHERE event_type != 'error')
SELECT namespace, name, array_to_string(list_sort(list(DISTINCT attribute)), ',') AS attributes, count(DISTINCT chunk) AS n_chunks FROM r GROUP BY ALL""")
def graph_upsert(spark, sf_dir):
    """Nodes merged by name within their namespace, after one namespace was deleted."""
    e = table(spark, sf_dir, "events")
    nodes = e.select(F.col("event_type").alias("namespace"), F.concat(F.lit("user "), "user_id").alias("name"), F.array(F.concat(F.lit("a"), F.col("event_id") % 7)).alias("attributes"), F.array("event_id").alias("chunks"))
    kept, _ = G.delete_namespaces(nodes, nodes, ["error"])
    half = F.element_at("chunks", 1) % 2 == 0
    made = G.merge_nodes(kept.filter(half), kept.filter(~half))
    return made.select("namespace", "name", F.array_join("attributes", ",").alias("attributes"), F.size("chunks").cast("long").alias("n_chunks"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem) SELECT a, b, CASE WHEN a = 7 THEN b ELSE a END AS other, a = 7 AS outgoing FROM e WHERE a = 7 OR b = 7""")
def opposite_ends(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct()
    return G.opposite(edges, 7)


@query("""WITH s AS (SELECT o_orderkey AS snapshot FROM orders WHERE o_orderstatus != 'P'), m AS (SELECT DISTINCT l_orderkey AS snapshot, l_partkey AS file FROM lineitem WHERE l_quantity > 5 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size != 7))
SELECT l_orderkey AS snapshot, l_linenumber AS line, l_partkey AS from_file FROM lineitem JOIN s ON l_orderkey = snapshot WHERE (l_orderkey, l_partkey) IN (SELECT snapshot, file FROM m)
  AND (l_linenumber % 3 = 0 OR (l_orderkey, l_partkey + 1) IN (SELECT snapshot, file FROM m))""")
def code_relations(spark, sf_dir):
    """Line items as relations of files (parts) within snapshots (orders); one in three leads outside."""
    li = table(spark, sf_dir, "lineitem")
    target = F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_partkey") + 1).cast("string")).otherwise("")
    relations = li.select(F.col("l_orderkey").alias("snapshot"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("from_file"), target.alias("to_file"))
    snapshots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("state"))
    members = li.select(F.col("l_orderkey").alias("snapshot"), F.col("l_partkey").cast("string").alias("file"), F.when(F.col("l_quantity") > 5, "parsed").otherwise("failed").alias("status"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.when(F.col("p_size") == 7, "gone").alias("deleted_at"))
    return G.visible_relations(relations, snapshots, members, files).select("snapshot", "line", F.col("from_file").cast("long").alias("from_file"))


@query("""WITH g AS (SELECT user_id AS graph, 'n' || event_id % 60 AS node, max(value) AS score FROM events GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY score DESC, node) AS r FROM g) WHERE r <= 10)
SELECT node, max(score) AS score, max_by(graph, (score, graph)) AS graph FROM t GROUP BY node""")
def multi_graph_query(spark, sf_dir):
    """The ten best nodes of each user's graph, each once."""
    scored = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("graph"), F.concat(F.lit("n"), F.col("event_id") % 60).alias("node")).agg(F.max("value").alias("score"))
    return G.top_nodes(scored, "graph", 10)


@query(r"""WITH p AS (SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(url, '^[a-z]+:', '')), '/+'), lambda x: trim(x)), lambda x: x != '' AND x != '.'), '/') AS path FROM pages)
SELECT page_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_extract(path, '[^/]*$') AS name FROM p""")
def folder_paths(spark, sf_dir):
    path = G.folder_path(F.regexp_replace("url", "^[a-z]+:", ""))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", "path", G.folder_parent(F.col("path")).alias("parent"), G.folder_name(F.col("path")).alias("name"))


PAGES_CTE = r"""wp AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, lower(html) AS text FROM pages WHERE page_id % 5 != 0)"""


@query(rf"""WITH {PAGES_CTE}, t AS (SELECT page_id, split_part(title, ' ', 1) AS word, text FROM wp), l AS (SELECT page_id AS a, (page_id * 7 + 3) % 50 AS b FROM t)
SELECT x.page_id AS slug, y.page_id AS target FROM t x JOIN t y ON x.page_id != y.page_id AND trim(y.word) != '' AND contains(x.text, y.word) WHERE (x.page_id, y.page_id) NOT IN (SELECT a, b FROM l)""")
def missing_cross_references(spark, sf_dir):
    """Pages whose text has the first title word of another page that they don't link to."""
    p = table(spark, sf_dir, "pages").filter("page_id % 5 != 0")
    title = F.substring_index(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), " ", 1)
    pages = p.select(F.col("page_id").alias("slug"), title.alias("title"), F.lower("html").alias("text"))
    links = p.select(F.col("page_id").alias("slug"), ((F.col("page_id") * 7 + 3) % 50).alias("target"))
    return G.missing_links(pages, links)


@query()
def wiki_links(spark, sf_dir):
    """Pages' visible texts with links to the pages whose first title word they have."""
    p = table(spark, sf_dir, "pages")
    title = F.substring_index(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ", 1)
    text = F.regexp_replace(F.regexp_replace("html", "(?s)<head>.*?</head>", ""), "<[^>]*>", " ")
    return G.linked_pages(p.select(F.col("page_id").alias("slug"), title.alias("title"), text.alias("text"))).select("slug", F.md5("text").alias("text_md5"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), hit AS (SELECT DISTINCT b AS chunk FROM w WHERE a IN (SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'al')))
SELECT chunk FROM hit WHERE chunk NOT IN (SELECT s_suppkey + 1000000 FROM supplier WHERE s_acctbal < 3000)""")
def unseen_graph_hits(spark, sf_dir):
    """Neighbours of parts whose names have any of two terms, without those that a search has shown already."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    hits = G.neighbours(nodes, edges, "ring", "al").select(F.col("b").alias("chunk")).distinct()
    seen = table(spark, sf_dir, "supplier").filter("s_acctbal < 3000").select((F.col("s_suppkey") + 1000000).alias("chunk"))
    return J.delete(hits, seen, ["chunk"])


# --- memories ---


@query("""WITH s AS (SELECT conv_id, turn, role, sum(ceil(length(text) / 4.0) + 3) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS suffix, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations),
c AS (SELECT conv_id, coalesce(min(turn) FILTER (suffix <= 100), max(turn)) AS cut FROM s GROUP BY conv_id)
SELECT conv_id, cut, CASE WHEN role != 'user' THEN asked END AS turn_start FROM c JOIN s ON c.conv_id = s.conv_id AND c.cut = s.turn""".replace("SELECT conv_id, cut, CASE", "SELECT c.conv_id, cut, CASE"))
def context_cut(spark, sf_dir):
    return M.context_cut(table(spark, sf_dir, "conversations"), 100)


@query("""WITH s AS (SELECT *, lead(role) OVER w AS next, lead(text) OVER w AS answer FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM s WHERE role = 'user' AND next = 'assistant')
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS round, text AS question, answer FROM p WHERE r <= 2""")
def recent_rounds(spark, sf_dir):
    return M.rounds(table(spark, sf_dir, "conversations"), 2)


@query("""WITH RECURSIVE c AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, doc_id, length(text) AS n FROM documents),
b AS (SELECT source, k, doc_id, 0 AS batch, n AS used FROM c WHERE k = 1
      UNION ALL SELECT c.source, c.k, c.doc_id, CASE WHEN used > 0 AND used + n > 12000 THEN batch + 1 ELSE batch END, CASE WHEN used > 0 AND used + n > 12000 THEN n ELSE used + n END FROM b JOIN c ON c.source = b.source AND c.k = b.k + 1)
SELECT source, doc_id, batch FROM b""")
def citation_batches(spark, sf_dir):
    """A source's documents in batches of 12,000 characters."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("content"))
    return M.batches(docs, "source", ["doc_id"], 12_000).select("source", "doc_id", "batch")


TOPIC_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"""WITH t AS (SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS topic FROM part WHERE p_partkey % 3 = 0),
s AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS surface FROM part),
n AS (SELECT topic, {TOPIC_KEY.format("topic")} AS key FROM t),
x AS (SELECT surface, max_by(topic, (topic = surface, topic)) AS topic FROM s JOIN n ON key = {TOPIC_KEY.format("surface")} OR key = surface WHERE key != '' GROUP BY surface),
g AS (SELECT surface, {_grams("surface")} AS g FROM s WHERE surface NOT IN (SELECT surface FROM x) AND length(surface) >= 4), h AS (SELECT topic, {_grams("topic")} AS h FROM t WHERE length(topic) >= 4),
f AS (SELECT surface, topic, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) AS v FROM g JOIN h ON len(g) > 0 AND len(h) > 0),
m AS (SELECT surface, arg_min(topic, (-v, topic)) AS near FROM f WHERE v >= 0.6 GROUP BY surface)
SELECT s.surface, coalesce(x.topic, near) AS topic, CASE WHEN x.topic = s.surface THEN 'reused' WHEN x.topic IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS tier
FROM s LEFT JOIN x ON s.surface = x.surface LEFT JOIN m ON s.surface = m.surface""")
def resolved_topics(spark, sf_dir):
    """Part names against topics: the first two words of every third."""
    p = table(spark, sf_dir, "part")
    topics = p.filter("p_partkey % 3 = 0").select(F.substring_index("p_name", " ", 2).alias("topic")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    return M.resolve_topics(p.select(F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("surface")), topics, 0.6)


@query()
def memory_clusters(spark, sf_dir):
    """Parts of a brand and type as memories that may say the same."""
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_brand").alias("owner"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"), F.array(F.col("p_size").cast("double"), F.lit(10.0)).alias("vector"))
    return clusters(items, 0.3, 0.999)


@query()
def memory_clusters_one_store(spark, sf_dir):
    """All parts as one store."""
    p = table(spark, sf_dir, "part")
    items = p.select(F.lit("all").alias("owner"), F.lit("part").alias("kind"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"), F.array(F.col("p_size").cast("double"), F.lit(10.0)).alias("vector"))
    return clusters(items, 0.3, 0.99999)


@query(r"""WITH m AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, text FROM conversations), tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM m),
n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM tok), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
a AS (SELECT doc_id AS query_id, conv_id AS own, text FROM m WHERE doc_id % 20 = 0), q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM a),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b),
k AS (SELECT r.query_id, r.doc_id, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) AS place, a.text AS asked FROM r JOIN a USING (query_id) WHERE rank <= 7 AND r.doc_id // 1000 != a.own)
SELECT query_id, CAST(place AS INTEGER) AS place, conv_id, turn, substring(text, CAST(greatest(strpos(lower(text), lower(split_part(asked, ' ', 2))) - 60, 1) AS INTEGER), 120) AS snippet FROM k JOIN m USING (doc_id) WHERE place <= 5""")
def past_conversations(spark, sf_dir):
    """Messages like every twentieth one, of other conversations, around its second word."""
    m = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    asked = m.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.col("conv_id").alias("own_conv"), F.try_element_at(F.split("text", " "), F.lit(2)).alias("word"))
    found = R.bm25(m, asked, 7)
    hits = found.select("query_id", F.floor(F.col("doc_id") / 1000).alias("conv_id"), (F.col("doc_id") % 1000).alias("turn"), "rank")
    return M.past_messages(hits, m, asked.select("query_id", "own_conv", F.coalesce("word", F.lit("")).alias("word")), 5)


# --- evaluation sets, tags and lists ---


@query("""SELECT o_orderkey AS query_id, o_orderpriority AS query, c_name AS answer, coalesce(p, '') AS passages FROM orders
LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 2 = 0 LEFT JOIN (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS p FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) ON l_orderkey = o_orderkey""")
def evaluation_set(spark, sf_dir):
    """Orders as questions, customers as answers of every other one, parts as relevant passages."""
    o = table(spark, sf_dir, "orders")
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("aid"), F.col("c_name").alias("answer"))
    qas = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("aid"))
    qrels = table(spark, sf_dir, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("pid"))
    made = J.assembled(o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("query")), qas, answers, qrels)
    return made.withColumn("passages", F.array_join("passages", ","))


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_orderkey LIMIT 50), w AS (SELECT DISTINCT l_partkey AS pid FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM t))
SELECT pid, TRUE AS wanted FROM w""")
def sampled_evaluation_set(spark, sf_dir):
    """The passages of the 50 questions with most of them; the random fifth of others is left to a test."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    qrels = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("pid"))
    chosen, corpus = J.sampled_set(o.select(F.col("o_orderkey").alias("query_id")), qrels, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid")), 50)
    wanted = qrels.join(chosen, "query_id", "left_semi").select("pid").distinct().withColumn("wanted", F.lit(True))
    return corpus.join(wanted, "pid")


@query("""WITH t AS (SELECT user_id, event_id % 40 AS other, max(value) AS score FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, other) AS k FROM t)
SELECT other, min(user_id) AS item, CAST(arg_min(k, user_id) AS INTEGER) AS at FROM r WHERE k <= 3 GROUP BY other""")
def top_of_every_item(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 40).alias("other")).agg(F.max("value").alias("score"))
    return J.top_per_item(pairs, "user_id", "other", 3)


@query("""WITH m AS (SELECT user_id AS doc_id, event_id % 9 AS tag, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN CAST(event_id % 101 AS DOUBLE) ELSE event_id % 101 / 100.0::DOUBLE END AS c FROM events),
s AS (SELECT doc_id, tag, max(CASE WHEN c IS NULL THEN 1 WHEN c > 1 THEN c / 100 ELSE c END) AS confidence FROM m WHERE tag BETWEEN 1 AND 6 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, tag) AS INTEGER) AS place FROM s WHERE confidence >= 0.75)
SELECT doc_id, tag, round(confidence, 6) AS confidence, place FROM r WHERE place <= 3""")
def accepted_tags(spark, sf_dir):
    way = F.col("event_id") % 7
    sure = F.when(way == 1, (F.col("event_id") % 101).cast("double")).when(way != 0, F.col("event_id") % 101 / 100)
    matches = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 9).alias("tag"), sure.alias("confidence"))
    return J.accepted_tags(matches, 6).withColumn("confidence", F.round("confidence", 6))


@query("SELECT r_name AS tag FROM region UNION SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def unused_tags(spark, sf_dir):
    """Names that neither rich customers nor suppliers use; regions are used by none."""
    nation = table(spark, sf_dir, "nation")
    used = lambda t, key, where: table(spark, sf_dir, t).filter(where).join(nation, F.col(key) == F.col("n_nationkey")).select("n_name")
    tags = nation.select(F.col("n_name").alias("tag")).union(table(spark, sf_dir, "region").select("r_name")).distinct()
    return J.unused(tags, "tag", used("customer", "c_nationkey", "c_acctbal > 9000"), used("supplier", "s_nationkey", "TRUE"))


@query("SELECT d.doc_id, min(b.item_id) AS passage_id FROM documents d JOIN benchmark b ON d.text != '' AND (contains(d.text, b.text) OR contains(b.text, d.text)) GROUP BY d.doc_id")
def first_passages(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return J.first_passage(containing(table(spark, sf_dir, "documents"), passages))


@query(f"""WITH h AS (SELECT lang AS query_id, doc_id, source, {NORMALISE} AS n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, md5(n) ORDER BY rank) AS r FROM h) SELECT query_id, doc_id, rank FROM k WHERE r = 1""")
def source_signature_dedup(spark, sf_dir):
    """Documents of a language, longest first; a text counts once a source."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "source", "n_chars", T.signature(F.col("text")).alias("signature"))
    hits = docs.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    doubled = hits.withColumnRenamed("lang", "query_id").select("query_id", "doc_id", "source", "signature", "rank")
    again = doubled.withColumn("rank", F.col("rank") + 1_000_000)  # every id a second time
    return K.first_by_id_and_signature(doubled.union(again), signature=F.col("signature")).select("query_id", "doc_id", "rank")


@query("""WITH h AS (SELECT user_id AS query_id, event_id AS doc_id, value AS score, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS old FROM events),
b AS (SELECT query_id, doc_id, round(CASE WHEN event_type = 'view' THEN score * 1.3 ELSE score END, 6) AS score, old FROM h) SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank FROM b""")
def wiki_boosted(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), F.col("value").alias("score"), "event_type", F.row_number().over(order).alias("rank"))
    return K.wiki_boost(hits, F.col("event_type") == "view").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# --- streams ---


@query("""WITH m AS (SELECT user_id, max(event_id) AS mark FROM events WHERE event_type = 'signup' GROUP BY 1), q AS (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 1 hour)
SELECT user_id, count(*) AS n, max(event_id) AS mark FROM events LEFT JOIN m USING (user_id) WHERE (mark IS NULL OR event_id > mark) AND user_id IN (SELECT user_id FROM q) GROUP BY user_id""")
def undistilled_messages(spark, sf_dir):
    """What users did after their last signup, once they have been quiet for an hour; and the marks from then on."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts"))
    marks = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("mark"))
    left = ingest.undistilled(e, marks, "user_id", "event_id", F.make_interval(hours=F.lit(1)), e.agg(F.max("ts")).first()[0])
    counts = left.groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.join(ingest.new_marks(left, marks, "user_id", "event_id"), "user_id")


@query("""SELECT user_id, event_id, CAST(r AS INTEGER) AS offset FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events) WHERE r >= 10""".replace("AS offset", 'AS "offset"'))
def event_log_from_offset(spark, sf_dir):
    return ingest.log_from(table(spark, sf_dir, "events"), "user_id", "event_id", 10).select("user_id", "event_id", "offset")


@query("""WITH l AS (SELECT user_id, max(ts) AS seen, arg_max(event_type, ts) AS kind FROM events GROUP BY 1) SELECT user_id FROM l WHERE kind IN ('view', 'click') AND seen < (SELECT max(ts) FROM events) - INTERVAL 60 minutes""")
def reclaimable_tasks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    claims = e.select("user_id", F.col("ts").alias("at"), F.when(F.col("event_type").isin("view", "click"), "running").otherwise("done").alias("state"))
    return ingest.reclaimable(claims, "user_id", e.agg(F.max("ts")).first()[0], 60)


@query("SELECT 'i' || event_id % 300 AS item_id, 'title ' || max(event_id) AS title FROM events GROUP BY 1")
def feed_increments(spark, sf_dir):
    """Events as items of a feed of four files, merged file by file: the last title of each item."""
    folder, out, at = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("feed", "merged", "progress"))
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("i"), F.col("event_id") % 300).alias("guid"), F.concat(F.lit("title "), "event_id").alias("title"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("updated"))
    e.repartition(4, "title").write.json(folder)
    ingest.ingest(spark, feed.stream_feed(spark, folder, 1), out, at, "item_id", "updated")
    return ingest.merged(spark, out).select("item_id", "title")


@query("""WITH e AS (SELECT user_id, event_id, event_type FROM events), f AS (SELECT user_id, min(event_id) FILTER (event_id % 2 = 0) AS a, max(event_id) FILTER (event_id % 2 = 1) AS b FROM e GROUP BY 1)
SELECT user_id, event_id FROM (SELECT user_id, coalesce((SELECT max(event_id) FROM e x WHERE x.user_id = f.user_id AND event_id % 2 = 0), b) AS event_id FROM f)""")
def kept_own_rows(spark, sf_dir):
    """Two batches under the strategy that keeps what is there: even events come first."""
    out = f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}"
    e = materialise(table(spark, sf_dir, "events").select("user_id", "event_id"), "events")
    merge = ingest.merge_into(out, "user_id", "event_id", keep_own=True)
    merge(e.filter("event_id % 2 = 0"), 0)
    merge(e.filter("event_id % 2 = 1"), 1)
    return ingest.merged(spark, out)
