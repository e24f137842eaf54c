"""Retrieval queries. The query set is stated: every row of the query table whose id is
divisible by 20, against all rows. embeddings.vec_id has no stated link to documents;
hybrid_search takes equal ids as the same chunk, an assumption."""

import uuid

from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import retrieval as R
from quern.operators.keyword_index import KeywordIndex
from quern.operators import vector_graph as N
from quern.operators import vector_index as I
from quern.plans.registry import query
from quern.session import discard, materialise, remove, shared_dir, table


def bench_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


BM25_CTE = r"""
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM tok),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
       FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY query_id, doc_id),
bm_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm)"""
COS_CTE = """
cos AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
cos_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM cos)"""


@query(f"WITH {BM25_CTE} SELECT query_id, doc_id, score, rank FROM bm_ranked WHERE rank <= 10")
def bm25_search(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), bench_queries(spark, sf_dir), 10)


def _from_index(spark, additions, asked, k):
    """Search an index that is made of these tables for the purpose, and deleted when it was searched."""
    index = KeywordIndex(spark, f"{shared_dir(spark)}/keywords-{uuid.uuid4().hex}")
    for docs in additions:
        index.add(docs)
    found = materialise(index.search(asked, k), "found")
    remove(spark, index.path)
    return found


@query(f"WITH {BM25_CTE} SELECT query_id, doc_id, score, rank FROM bm_ranked WHERE rank <= 10")
def keyword_index_search(spark, sf_dir):
    """The rows of bm25_search, by a stored index."""
    return _from_index(spark, [table(spark, sf_dir, "documents")], bench_queries(spark, sf_dir), 10)


@query(f"WITH {BM25_CTE} SELECT query_id, doc_id, score, rank FROM bm_ranked WHERE rank <= 25")
def keyword_index_additions(spark, sf_dir):
    """An index that grew by one language after the other."""
    docs = table(spark, sf_dir, "documents")
    return _from_index(spark, [docs.filter("lang = 'en'"), docs.filter("lang = 'de'"), docs.filter("coalesce(lang, '') NOT IN ('en', 'de')")], bench_queries(spark, sf_dir), 25)


@query(f"WITH {COS_CTE} SELECT query_id, vec_id, score, rank FROM cos_ranked WHERE rank <= 10")
def vector_search_cosine(spark, sf_dir):
    return R.vector_search(table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), 10)


@query(f"WITH {COS_CTE} SELECT query_id, vec_id, score, rank FROM cos_ranked WHERE rank <= 20 AND score >= 0.5")
def vector_search_threshold(spark, sf_dir):
    return R.vector_search(table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), 20, threshold=0.5)


@query("""WITH u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.v, CAST(b.embedding AS DOUBLE[])), 6) AS score FROM u a JOIN embeddings b ON a.vec_id % 20 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def vector_search_inner_product(spark, sf_dir):
    return R.vector_search(table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), 10, threshold=-1e9, metric="ip")


@query()
def vector_index_search(spark, sf_dir):
    """The ten nearest by an inverted-file index of as many lists as the root of the rows; how many of them are looked through is
    measured on up to 200 other vectors, for 95 % of their true neighbours."""
    index = table(spark, sf_dir, "embeddings")
    centres = I.fit(index, I.lists_for(index))
    built = I.build(index, centres, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    others = index.filter("vec_id % 20 = 7").orderBy(F.xxhash64("vec_id")).limit(200).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return I.search(built, centres, vector_queries(spark, sf_dir), 10, I.probes_for(built, centres, others))


@query()
def vector_graph_search(spark, sf_dir):
    """The ten nearest by a neighbour graph of all vectors, with the share of the true ten that each query found."""
    index, asked = table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir)
    graph = N.build(index)
    found = materialise(N.search(graph, asked, 10, 256), "graph-found")
    for part in (graph.nodes, graph.members):
        discard(part)
    true = R.vector_search(index, asked, 10, threshold=-1.0).select("query_id", F.col("vec_id").alias("true_id"))
    hit = found.join(true, (found.query_id == true.query_id) & (found.vec_id == true.true_id), "left_semi").groupBy("query_id").agg((F.count("*") / 10).alias("recall"))
    return found.join(hit, "query_id", "left").fillna(0.0, ["recall"])


@query("SELECT count(*) AS n, CAST(sum(len(embedding) * 4) AS BIGINT) AS vector_bytes, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS text_bytes FROM embeddings")
def storage_quota(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 4).alias("vector_bytes"))
    return vectors.join(F.broadcast(table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("text_bytes"))))


@query(f"""WITH {BM25_CTE}, {COS_CTE}, u AS (SELECT query_id, doc_id, score FROM bm_ranked WHERE rank <= 10 UNION ALL SELECT query_id, vec_id, score FROM cos_ranked WHERE rank <= 10 AND query_id IN (SELECT item_id FROM benchmark))
SELECT query_id, doc_id, max(score) AS score FROM u GROUP BY ALL""")
def unioned_results(spark, sf_dir):
    """Keyword and vector hits in one list, each chunk once with its best score."""
    asked = bench_queries(spark, sf_dir)
    vectors = vector_queries(spark, sf_dir).join(asked, "query_id", "left_semi")
    both = R.bm25(table(spark, sf_dir, "documents"), asked, 10).drop("rank").unionByName(R.vector_search(table(spark, sf_dir, "embeddings"), vectors, 10).select("query_id", F.col("vec_id").alias("doc_id"), "score"))
    return R.best_per_chunk(both, ["query_id", "doc_id"], [F.desc("score")])


@query(f"""WITH {BM25_CTE}, {COS_CTE},
v AS (SELECT query_id, vec_id AS doc_id, rank AS v_rank FROM cos_ranked WHERE rank <= 50 AND query_id IN (SELECT item_id FROM benchmark)),
k AS (SELECT query_id, doc_id, rank AS k_rank FROM bm_ranked WHERE rank <= 50),
f AS (SELECT query_id, doc_id, round(coalesce(0.7 / (60 + v_rank), 0) + coalesce(0.3 / (60 + k_rank), 0), 9) AS score FROM v FULL JOIN k USING (query_id, doc_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def hybrid_search(spark, sf_dir):
    """BM25 and cosine, fused by weighted reciprocal ranks: the flagship."""
    asked = bench_queries(spark, sf_dir)
    keyword = R.bm25(table(spark, sf_dir, "documents"), asked, 50)
    vectors = vector_queries(spark, sf_dir).join(asked, "query_id", "left_semi")
    vector = R.vector_search(table(spark, sf_dir, "embeddings"), vectors, 50).withColumnRenamed("vec_id", "doc_id")
    return R.weighted_rrf(vector, keyword).filter("rank <= 10")


@query(f"""WITH {BM25_CTE}, {COS_CTE},
every AS (SELECT query_id, doc_id, rank FROM bm_ranked WHERE rank <= 20
          UNION ALL SELECT query_id, vec_id, rank FROM cos_ranked WHERE rank <= 20 AND score >= 0.5 AND query_id IN (SELECT item_id FROM benchmark))
SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 9) AS score FROM every GROUP BY ALL""")
def memory_hybrid_rrf(spark, sf_dir):
    asked = bench_queries(spark, sf_dir)
    vectors = vector_queries(spark, sf_dir).join(asked, "query_id", "left_semi")
    vector = R.vector_search(table(spark, sf_dir, "embeddings"), vectors, 20, threshold=0.5).withColumnRenamed("vec_id", "doc_id")
    return R.plain_rrf([R.bm25(table(spark, sf_dir, "documents"), asked, 20), vector])


@query(f"""WITH {BM25_CTE}, h AS (SELECT query_id, doc_id, score, count(*) OVER (PARTITION BY query_id) AS n,
            row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) - 1 AS place FROM bm_ranked WHERE rank <= 50),
b AS (SELECT query_id, max(score) FILTER (place = CASE WHEN n >= 10 THEN n * 5 // 100 ELSE 0 END) AS low,
             max(score) FILTER (place = CASE WHEN n >= 10 THEN n * 95 // 100 ELSE n - 1 END) AS high FROM h GROUP BY query_id)
SELECT query_id, doc_id, round(CASE WHEN n = 1 OR high = low THEN 1.0 ELSE least(greatest((score - low) / (high - low), 0), 1) END, 6) AS normalised FROM h JOIN b USING (query_id)""")
def keyword_minmax(spark, sf_dir):
    hits = R.bm25(table(spark, sf_dir, "documents"), bench_queries(spark, sf_dir), 50)
    return R.minmax_keyword_scores(hits).select("query_id", "doc_id", F.round("normalised", 6).alias("normalised"))


@query(f"""WITH {BM25_CTE}, p AS (SELECT query_id, b.doc_id, score, source FROM bm_ranked b JOIN documents USING (doc_id) WHERE rank <= 100),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS in_file FROM p),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY in_file > 4, score DESC, doc_id) AS INTEGER) AS rank FROM f)
SELECT query_id, doc_id, source, CAST(in_file AS INTEGER) AS in_file, rank FROM r WHERE rank <= 50""")
def per_file_priority(spark, sf_dir):
    """A pool of 100 for 50 results, the four best of each source first."""
    docs = table(spark, sf_dir, "documents")
    pool = R.bm25(docs, bench_queries(spark, sf_dir), R.diversity_pool(50)).join(docs.select("doc_id", "source"), "doc_id")
    return R.per_file_priority(pool, "query_id", "source").filter("rank <= 50").select("query_id", "doc_id", "source", "in_file", "rank")


@query(r"""SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ['license', 'worthless', 'keiten'])""")
def match_any_keyword(spark, sf_dir):
    return R.match_any(table(spark, sf_dir, "documents"), ["license", "worthless", "keiten"])


@query("""SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de') AND doc_id NOT IN (1, 2, 3, 41) AND n_chars BETWEEN 500 AND 5000""")
def scoped_documents(spark, sf_dir):
    docs = R.base_filter(table(spark, sf_dir, "documents"), kb_ids=["src1", "src2", "src3"], tags=["en", "de"], not_docs=[1, 2, 3, 41], kb_col="source", tag_col="lang")
    return docs.filter(R.filter_tree({"and": [{"field": "n_chars", "op": "between", "value": [500, 5000]}]})).select("doc_id")


@query("""SELECT event_id FROM events WHERE (event_type = 'purchase' AND value > 100) OR (event_type NOT IN ('click', 'view') AND props LIKE '%1%' AND NOT (value <= 5))""")
def filter_tree_events(spark, sf_dir):
    tree = {"or": [
        {"and": [{"field": "event_type", "op": "eq", "value": "purchase"}, {"field": "value", "op": "gt", "value": 100}]},
        {"and": [{"field": "event_type", "op": "not_in", "value": ["click", "view"]}, {"field": "props", "op": "like", "value": "%1%"}, {"field": "value", "op": "gt", "value": 5}]},
    ]}
    return table(spark, sf_dir, "events").filter(R.filter_tree(tree)).select("event_id")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'milvus' ELSE 'doris' END AS engine,
  round(least(greatest(CASE WHEN event_id % 5 = 0 THEN (value / 100 + 1) / 2 ELSE value / 100 END, 0), 1), 6) AS score FROM events""")
def normalised_scores(spark, sf_dir):
    at = table(spark, sf_dir, "events").withColumn("engine", F.when(F.col("event_id") % 5 == 0, "milvus").otherwise("doris"))
    return at.select("event_id", "engine", F.round(R.normalise_score(F.col("value") / 100, F.col("engine")), 6).alias("score"))


@query("""WITH h AS (SELECT user_id, event_type, event_id, value, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS tier FROM events),
o AS (SELECT user_id, CAST(event_id % 50 AS BIGINT) AS doc_id, value AS score, coalesce(tier, 2) AS tier FROM h),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, doc_id ORDER BY tier, score DESC) AS r FROM o) WHERE r = 1)
SELECT user_id, doc_id, score, tier, CAST(row_number() OVER (PARTITION BY user_id ORDER BY tier, score DESC, doc_id) AS INTEGER) AS rank FROM d""")
def keyword_tiers(spark, sf_dir):
    tier = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") != "view", 1)
    hits = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("doc_id"), F.col("value").alias("score"), tier.alias("tier"))
    return R.tiered(hits, "user_id")


@query("""SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, len(embedding) AS dimension, TRUE AS finite FROM embeddings""")
def vector_checks(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(e), 5).alias("norm"), F.size(e).cast("long").alias("dimension"), V.is_finite(e).alias("finite"))
