"""Aggregations, windows, set operations, SQL surfaces, sources and streams over the tables."""

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import sql_surface as S
from quern.operators.chunking import rounded
from quern.plans.registry import query
from quern.session import materialise, remove, shared_dir, table
from quern.sources import files, html
from quern.streaming import absence, ingest

# --- aggregations ---


@query("""WITH t AS (SELECT DISTINCT tag FROM (SELECT lang AS tag FROM documents UNION SELECT source FROM documents UNION SELECT 'unused'))
SELECT tag, coalesce(a.n, 0) AS n_lang, coalesce(b.n, 0) AS n_source FROM t LEFT JOIN (SELECT lang AS tag, count(*) AS n FROM documents GROUP BY lang) a USING (tag)
LEFT JOIN (SELECT source AS tag, count(*) AS n FROM documents GROUP BY source) b USING (tag)""")
def tag_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    count = lambda c, name: docs.groupBy(F.col(c).alias("tag")).agg(F.count("*").alias(name))
    tags = docs.select(F.col("lang").alias("tag")).union(docs.select("source")).distinct().union(spark.range(1).select(F.lit("unused").alias("tag")))
    return tags.join(count("lang", "n_lang"), "tag", "left").join(count("source", "n_source"), "tag", "left").fillna(0, ["n_lang", "n_source"])


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?i)licen[sc]e|trash')) AS n_hits, source FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e|trash')""")
def grep_documents(spark, sf_dir):
    pattern = "(?i)licen[sc]e|trash"
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(pattern)).select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("long").alias("n_hits"), "source")


@query("""SELECT (SELECT count(*) FROM benchmark) AS n_queries, count(*) AS n_passages, count(DISTINCT item_id) AS n_covered,
  round(count(*) / (SELECT count(*) FROM benchmark), 6) AS passages_per_query, round(count(DISTINCT item_id) * 100 / (SELECT count(*) FROM benchmark), 6) AS coverage FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def dataset_statistics(spark, sf_dir):
    from quern.operators.containment import containing

    bench = table(spark, sf_dir, "benchmark")
    found = containing(table(spark, sf_dir, "documents"), bench.select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")), within=False)
    n = bench.agg(F.count("*").alias("n_queries"))
    at = found.agg(F.count("*").alias("n_passages"), F.countDistinct("passage_id").alias("n_covered"))
    return n.crossJoin(at).select("n_queries", "n_passages", "n_covered", F.round(F.col("n_passages") / F.col("n_queries"), 6).alias("passages_per_query"), F.round(F.col("n_covered") * 100 / F.col("n_queries"), 6).alias("coverage"))  # one row each


@query("SELECT user_id, max(ts) AS last_seen, count(*) AS n_beats FROM events GROUP BY user_id")
def heartbeats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n_beats"))


@query("""SELECT lang, count(*) FILTER (n_chars > 2000) AS n_long, count(DISTINCT nullif(source, 'src0')) AS n_sources, sum(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END)::BIGINT AS n_short,
  max(strlen(text)) AS longest_bytes, CAST(sum(strlen(text) + 200) AS BIGINT) AS storage_bytes FROM documents GROUP BY lang""")
def conditional_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count_if(F.col("n_chars") > 2000).alias("n_long"), F.countDistinct(F.nullif(F.col("source"), F.lit("src0"))).alias("n_sources"),
        F.sum(F.when(F.col("n_chars") < 500, 1).otherwise(0)).alias("n_short"), F.max(F.octet_length("text")).cast("long").alias("longest_bytes"),
        F.sum(F.octet_length("text") + 200).alias("storage_bytes"),
    )


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents GROUP BY source")
def distinct_lists(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_predicate(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k >= 50")


# --- windows, pages, sets ---


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type != 'error')
SELECT event_id, user_id FROM k WHERE r = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 120) ORDER BY event_id LIMIT 20""")
def claim_tasks(spark, sf_dir):
    """The oldest 20 keys' first waiting event, but for keys with a fresh claim."""
    e = table(spark, sf_dir, "events")
    first = e.filter("event_type != 'error'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    claimed = e.filter("event_type = 'error' AND value > 120").select("user_id")
    return first.join(claimed, "user_id", "left_anti").select("event_id", "user_id").orderBy("event_id").limit(20)


@query("SELECT event_id, ts FROM events WHERE (ts, event_id) > ((SELECT ts FROM events WHERE event_id = 500), 500) ORDER BY ts, event_id LIMIT 100")
def keyset_page(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = e.filter("event_id = 500").select("ts").first()[0]
    after = (F.col("ts") > F.lit(at)) | ((F.col("ts") == F.lit(at)) & (F.col("event_id") > 500))
    return e.filter(after).select("event_id", "ts").orderBy("ts", "event_id").limit(100)


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 20 OFFSET 40")
def offset_page(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("source", "doc_id").offset(40).limit(20)


@query("SELECT conv_id, turn, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_at FROM conversations")
def running_offsets(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length("text") + 1).over(order).alias("end_at"))


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS share,
  dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def window_functions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"),
        F.round(F.percent_rank().over(w), 6).alias("share"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("kind"),
    )


@query("""SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 1000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'""")
def set_operations(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = lambda df, name: df.select(F.col(name).alias("key"))
    both = key(o.filter("o_orderstatus = 'F'"), "o_custkey").intersect(key(c.filter("c_acctbal > 1000"), "c_custkey"))
    return both.subtract(key(o.filter("o_orderpriority = '5-LOW'"), "o_custkey"))


@query("""WITH q AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id), top AS (SELECT doc_id FROM documents JOIN q USING (doc_id) ORDER BY n_chars DESC, doc_id LIMIT 100)
SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM top) OR md5(CAST(doc_id AS VARCHAR)) < '33'""")
def dataset_sample(spark, sf_dir):
    """The 100 longest labelled documents and a fifth of all others, by a digest of the id."""
    docs = table(spark, sf_dir, "documents")
    top = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id")
    some = docs.filter(F.md5(F.col("doc_id").cast("string")) < "33").select("doc_id")
    return docs.join(top.union(some).distinct(), "doc_id", "left_semi").select("doc_id", "source")


# --- SQL surfaces ---

STAR = ["customer", "orders", "lineitem", "nation", "region", "supplier", "part"]


def _star(spark, sf_dir):
    return {t: table(spark, sf_dir, t) for t in STAR}


def _sql(name: str, text: str) -> None:
    """The same text for Spark, through the checked SQL surface, and for DuckDB."""
    query(text, name)(lambda spark, sf_dir: S.run(spark, text, _star(spark, sf_dir)))


_sql("sql_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
_sql("sql_revenue_by_nation", """SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
_sql("sql_grouping_sets", """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""")
_sql("sql_cube", "SELECT p_brand, p_type, count(*) AS n, max(p_size) AS largest FROM part GROUP BY CUBE (p_brand, p_type)")
_sql("sql_rollup", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
_sql("sql_exists", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
_sql("sql_correlated", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")


@query("""WITH yearly AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey, year(o_orderdate))
  SELECT o_custkey, CAST(y AS BIGINT) AS y, round(total, 2) AS total, row_number() OVER (PARTITION BY y ORDER BY total DESC, o_custkey) AS place FROM yearly""")
def sql_cte_window(spark, sf_dir):
    """A customer's years by their totals. The SQL orders by sums of doubles, whose last bits hang on the order of adding: here it is
    the order of keys, whatever the partitions, so that equal orders make equal totals and customers decide."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderkey", "o_totalprice")
    adding = Window.partitionBy("o_custkey", "y").orderBy("o_orderkey", "o_totalprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = orders.select("o_custkey", "y", F.sum("o_totalprice").over(adding).alias("total"), F.count("*").over(adding).alias("n"))
    yearly = added.groupBy("o_custkey", "y").agg(F.max_by("total", "n").alias("total"))
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.desc_nulls_last("total"), F.asc_nulls_last("o_custkey")))
    return yearly.select("o_custkey", F.col("y").cast("long").alias("y"), rounded(F.col("total"), 2).alias("total"), place.alias("place"))


_sql("sql_full_join", "SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, coalesce(n_s, 0) AS n_s, coalesce(n_c, 0) AS n_c FROM (SELECT s_nationkey, count(*) AS n_s FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) a FULL JOIN (SELECT c_nationkey, count(*) AS n_c FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) b ON s_nationkey = c_nationkey")
_sql("sql_distinct_from", "SELECT count(*) AS n FROM lineitem WHERE (CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linestatus END) IS DISTINCT FROM 'F'")


@query("""SELECT lang, count(*) AS row_count FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id) WHERE source = 'src1' AND (toxic IS NULL OR toxic = 0)) GROUP BY lang""")
def catalog_sql(spark, sf_dir):
    """User SQL over a view that holds one tenant's enabled rows only."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 0).alias("enabled")), "doc_id", "left")
    views = {"chunks": S.secured(docs, "src1", tenant_col="source", enabled_col="enabled")}
    return S.run(spark, "SELECT lang, count(*) AS row_count FROM chunks GROUP BY lang", views)


@query("""SELECT * FROM (VALUES ('event_id', 'bigint', 1), ('ts', 'timestamp_ntz', 2), ('user_id', 'bigint', 3), ('event_type', 'string', 4), ('value', 'double', 5), ('props', 'string', 6)) v(column_name, data_type, position)""")
def table_schema(spark, sf_dir):
    return S.describe(table(spark, sf_dir, "events"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 7")
def sampled_rows(spark, sf_dir):
    """The first rows of a table as JSON, read again."""
    rows = S.sample_rows(table(spark, sf_dir, "customer"), 7, ["c_custkey"])
    return rows.select(F.from_json("row", "c_custkey long, c_name string, c_acctbal double").alias("r")).select("r.*")


@query("""WITH j AS (SELECT user_id, '[' || string_agg(props, ',' ORDER BY event_id) || ']' AS j FROM events GROUP BY user_id)
SELECT user_id, CAST(json_array_length(j) AS INTEGER) AS n, (SELECT sum(CAST(json_extract(x, '$.k') AS BIGINT))::BIGINT FROM (SELECT unnest(CAST(json_extract(j, '$[*]') AS JSON[])) AS x)) AS total, json_type(j, '$[0]') = 'OBJECT' AS is_object, json_type(j, '$[0].k') IN ('UBIGINT', 'BIGINT') AS is_number FROM j""")
def json_functions(spark, sf_dir):
    """A user's properties as one JSON array: its length, its elements, and what kinds they are."""
    of = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("p"))
    j = of.select("user_id", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["props"]), ","), F.lit("]")).alias("j"))
    first = F.get_json_object("j", "$[0]")
    elements = F.from_json("j", "array<struct<k:bigint>>")
    return j.select(
        "user_id", F.json_array_length("j").alias("n"), F.aggregate(elements, F.lit(0).cast("long"), lambda s, x: s + x["k"]).alias("total"),
        first.rlike(r"^\{").alias("is_object"), F.get_json_object(first, "$.k").rlike(r"^-?\d+$").alias("is_number"),
    )


# --- sources ---


@query("""SELECT 'customer' AS sheet, count(*) AS n, count(c_custkey) AS n_customer, 0::BIGINT AS n_supplier FROM customer UNION ALL SELECT 'supplier', count(*), 0, count(s_suppkey) FROM supplier""")
def sheet_union(spark, sf_dir):
    """Two tables as sheets of a workbook, by column name."""
    whole = files.union_sheets({t: table(spark, sf_dir, t) for t in ("customer", "supplier")})
    return whole.groupBy(F.col("__sheet_name").alias("sheet")).agg(F.count("*").alias("n"), F.count("c_custkey").alias("n_customer"), F.count("s_suppkey").alias("n_supplier"))


@query("""SELECT p_partkey, 'p_partkey: ' || p_partkey || ',p_name: ' || p_name || ',p_size: ' || p_size AS text FROM part""")
def table_row_texts(spark, sf_dir):
    return files.row_texts(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey"])


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, sf_dir):
    """The orders written as CSV with a header and read again with detected types."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority").write.option("header", True).csv(path)
    return files.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, o_orderpriority string")


@query("""SELECT url, concat_ws(chr(10) || chr(10), nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(trim(url), '')) AS content, 0.6::DOUBLE AS score FROM pages""")
def web_search_results(spark, sf_dir):
    hits = table(spark, sf_dir, "pages").select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit(" ").alias("snippet"), F.col("url").alias("content"))
    return html.web_results(hits)


# --- streams ---


def _events_stream(spark, sf_dir):
    """The events as a stream of files."""
    at = table(spark, sf_dir, "events")
    copy = materialise(at.withColumn("ts", F.col("ts").cast("timestamp")), "events-feed")
    return spark.readStream.schema(copy.schema).parquet(copy._quern_path)


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return ingest.windowed(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("""SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 15 minutes, ts), time_bucket(INTERVAL 15 minutes, ts) - INTERVAL 15 minutes]) AS start FROM events) GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    return ingest.windowed(table(spark, sf_dir, "events"), "30 minutes", "15 minutes").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 hours THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 hours AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"), "2 hours")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 1 day <= (SELECT max(ts) - INTERVAL 1 hour FROM events)""")
def streamed_windows(spark, sf_dir):
    """Daily windows of the stream that the watermark has closed."""
    out, at = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}", f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    stream = ingest.windowed(_events_stream(spark, sf_dir), "1 day")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id HAVING max_by(event_type, event_id) != 'error'")
def incremental_ingest(spark, sf_dir):
    """The stream, in several batches, merged into a table: each user's latest event; a user whose latest is an error is deleted."""
    out, at = f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}", f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    copy = materialise(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("gone")).repartition(4, "event_id"), "events-feed")
    stream = spark.readStream.schema(copy.schema).option("maxFilesPerTrigger", 1).parquet(copy._quern_path)
    ingest.ingest(spark, stream, out, at, "user_id", "event_id")
    return ingest.merged(spark, out, "gone").select("user_id", "event_id", "event_type")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_recent FROM events""")
def requests_in_window(spark, sf_dir):
    return ingest.requests_in_window(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "n_recent")


@query("""SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 720 minutes""")
def stuck_tasks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ingest.stuck(e, "user_id", "ts", e.agg(F.max("ts")).first()[0], 720)


@query("""SELECT user_id FROM (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)
AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100) AND seen <= (SELECT max(ts) FROM events) - INTERVAL 1 hours""")
def absent_items(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    items = e.groupBy("user_id").agg(F.max("ts").alias("seen"))
    return ingest.absent(e.filter("event_type = 'error' AND value > 100"), e.filter("event_type = 'signup' AND value > 100"), items, "user_id", "seen", e.agg(F.max("ts")).first()[0], 1)


ABSENT_MS = 24 * absence.HOUR


@query(f"""WITH s AS (SELECT user_id AS item, epoch_us(ts) // 1000 AS t, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)
SELECT item, 'absent' AS change, t + {ABSENT_MS} AS at_ms FROM s WHERE n IS NULL OR n - t > {ABSENT_MS} UNION ALL SELECT item, 'back', n FROM s WHERE n - t > {ABSENT_MS}""")
def absent_in_stream(spark, sf_dir):
    """Users as items, their events as sightings: a stream in three deliveries, and a last scan long after
    them that has another item only, by which all timers run out."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("ts").cast("timestamp").alias("at"))
    first, last = e.agg(F.min("at"), F.max("at")).first()
    feed, out, mark = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("scans", "absences", "progress"))
    cuts = [first, first + (last - first) / 3, first + (last - first) * 2 / 3, last]
    parts = [e.filter((F.col("at") >= a) & ((F.col("at") <= z) if z == last else (F.col("at") < z))) for a, z in zip(cuts, cuts[1:])]
    later = [spark.createDataFrame([(-1, last + datetime.timedelta(days=d))], e.schema) for d in (60, 61)]
    for part in [*parts, *later]:
        part.write.mode("append").parquet(feed)
        absence.run_until_now(absence.absences(spark.readStream.schema(e.schema).parquet(feed), "item", "at"), out, mark)
    made = materialise(spark.read.schema("item long, change string, at_ms long").parquet(out).filter("item != -1"), "absences")
    for path in (feed, out, mark):
        remove(spark, path)
    return made


@query()
def rate_limited(spark, sf_dir):
    """At most three events of a user within six hours, in order of time."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    feed, out, mark = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("requests", "limited", "progress"))
    rows.write.parquet(feed)
    absence.run_until_now(absence.rate_limit(spark.readStream.schema(rows.schema).parquet(feed), "user_id", 3, 6 * 3600), out, mark)
    made = materialise(spark.read.schema("key long, event_id long, allowed boolean").parquet(out).select(F.col("key").alias("user_id"), "event_id", "allowed"), "limited")
    for path in (feed, out, mark):
        remove(spark, path)
    return made
