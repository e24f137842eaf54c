"""Pages, archives, tables and images as Markdown, and connectors' rows."""

import io
import json
import zipfile
from html import escape

import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans.registry import query
from quern.session import spread, table
from quern.sources import documents as D
from quern.sources import html

#: What a page says to readers: letters outside the head, scripts, comments and tags.
VISIBLE = r"array_to_string(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({}, '(?s)<head>.*?</head>|<script.*?</script>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\p{{L}}+'), ' ')"


def _words(markdown):
    return F.md5(F.array_join(F.regexp_extract_all(F.regexp_replace(markdown, r"\]\([^)]*\)", "]"), F.lit(r"\p{L}+"), F.lit(0)), " "))


@query(rf"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS raw_title, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links, md5({VISIBLE.format("html")}) AS words_md5,
  md5({VISIBLE.format("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")}) AS article_md5, len(regexp_extract_all(html, '<h1>')) > 0 AS has_heading FROM pages""")
def web_pages(spark, sf_dir):
    """Pages as Markdown: titles (entities as written), links, the words of the whole and of the article.
    A title that wasn't decoded right is null."""
    made = html.pages_to_markdown(table(spark, sf_dir, "pages"))
    read = F.col("raw_title")
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        read = F.replace(read, F.lit(reference), F.lit(sign))
    return made.select(
        "page_id", F.when(read == F.col("title"), F.col("raw_title")).alias("raw_title"), F.size("links").cast("long").alias("n_links"), _words(F.col("markdown")).alias("words_md5"), _words(F.col("article")).alias("article_md5"),
        F.col("markdown").rlike("(?m)^# ").alias("has_heading"),
    )


@query(rf"""SELECT page_id, md5({VISIBLE.format("html")}) AS words_md5, 1 AS n_images, TRUE AS names_image FROM pages""")
def web_archives(spark, sf_dir):
    """Pages as web archives with an advertisement, an image and links within the page."""
    p = table(spark, sf_dir, "pages")
    part = lambda kind, where, body: F.concat(F.lit("--b\r\nContent-Type: "), F.lit(kind), F.lit("\r\nContent-Location: "), where, F.lit("\r\n\r\n"), body, F.lit("\r\n"))
    page = F.concat("html", F.lit('<p><img src="http://i/x.png" alt=""><a href="#top">1</a></p>'))
    archive = F.concat(
        F.lit('MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="b"\r\n\r\n'),
        part("text/html; charset=utf-8", F.lit("http://googleads.example/x"), F.concat(F.lit("<p>"), F.repeat(F.lit("buy "), 20_000), F.lit("</p>"))),
        part("text/html; charset=utf-8", F.col("url"), page), part("image/png", F.lit("http://i/x.png"), F.lit("pixels")), F.lit("--b--\r\n"),
    )
    made = D.parse_documents(p.select(F.concat(F.lit("/a/"), "page_id", F.lit(".mhtml")).alias("path"), F.encode(archive, "UTF-8").alias("content")))
    return made.select(
        F.regexp_extract("path", r"(\d+)\.mhtml", 1).cast("long").alias("page_id"), _words(F.regexp_replace("markdown", r"!\[\]\([^)]*\)", "")).alias("words_md5"), F.size("images").alias("n_images"),
        F.contains("markdown", F.lit("![](images/1.png)")).alias("names_image"),
    )


@query("""SELECT p_partkey, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_size || ' |' || chr(10) || 'after' AS tidy FROM part""")
def tidy_tables(spark, sf_dir):
    """Tables with spare rows before the head, cells without spaces, and no line under the head."""
    row = F.concat(F.lit("|"), "p_name", F.lit("|  "), "p_size", F.lit("|"))
    odd, third = F.col("p_partkey") % 2 == 1, F.col("p_partkey") % 3 == 0
    untidy = F.concat(F.when(third, "|  | |\n|---|---|\n").otherwise(""), F.lit("|name|size |\n"), F.when(odd, "| --- | --- |\n").otherwise(""), row, F.lit("\nafter"))
    return table(spark, sf_dir, "part").select("p_partkey", D.tidy_tables(untidy).alias("tidy"))


@query("""SELECT p_partkey, 'see' || chr(10) || chr(10) || '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(p_name, '|', chr(92) || '|') || ' | ' || p_size || ' |' || chr(10) || chr(10) || 'end' AS md FROM part""")
def tables_from_html(spark, sf_dir):
    made = F.concat(F.lit("see<table style='x'><tr><th>name</th><th>size</th></tr><tr><td align=left>"), T.html_escape(F.col("p_name")), F.lit("</td><td>"), "p_size", F.lit("</td></tr></table>end"))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return rows.select("p_partkey", D.plain_tables(made).alias("md"))


@query("""SELECT page_id, 'a ![x](images/' || substr(sha256(to_base64(encode(url))), 1, 16) || '.png) b ![](images/' || substr(sha256(to_base64(encode('q' || url))), 1, 16) || '.gif)' AS plain, url AS first, 2 AS n FROM pages""")
def inline_images(spark, sf_dir):
    """Addresses as the bytes of images within a text."""
    b64 = lambda c: F.base64(F.encode(c, "UTF-8"))
    md = F.concat(F.lit("a ![x](data:image/png;base64,"), b64(F.col("url")), F.lit(") b ![](data:image/gif;base64,"), b64(F.concat(F.lit("q"), "url")), F.lit(")"))
    at = table(spark, sf_dir, "pages").select("page_id", md.alias("md"))
    return at.select("page_id", D.without_inline_images(F.col("md")).alias("plain"), F.decode(F.element_at(D.inline_images(F.col("md")), 1)["data"], "UTF-8").alias("first"), F.size(D.inline_images(F.col("md"))).alias("n"))


@query(r"""WITH r AS (SELECT page_id % 7 AS query_id, url, max(page_id / 100.0) AS score FROM pages GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS k FROM r)
SELECT query_id, url, k <= 3 AS fetched FROM k""")
def fetched_results(spark, sf_dir):
    """Web results of seven queries; the three best of each get what their pages say."""
    p = table(spark, sf_dir, "pages")
    results = p.groupBy((F.col("page_id") % 7).alias("query_id"), "url").agg(F.max(F.col("page_id") / 100).alias("score")).withColumn("content", F.lit("said"))
    once = p.groupBy("url").agg(F.min("html").alias("html"))
    out = html.with_fetched(results, once)
    return out.select("query_id", "url", (F.length("content") > 20).alias("fetched"))


def _lit(text):
    return "'" + text.replace("'", "''") + "'"


@query(rf"""WITH q AS (SELECT page_id, substr('where is ' || url || ' and fooBar2Baz or "plain" or my_var used', 1, 512) AS q FROM pages),
t AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(q, {_lit(T.BETWEEN_NAMES)}), lambda w: trim(w, './#:\-')), lambda w: regexp_matches(w, '[A-Za-z]')) AS t FROM q),
i AS (SELECT page_id, list_filter(t, lambda x, k: list_position(t, x) = k AND (x = 'plain' OR regexp_matches(x, {_lit(T.LIKE_CODE)}))) AS i FROM t),
p AS (SELECT page_id, i, flatten(list_transform(i, lambda x: regexp_split_to_array(x, '[^A-Za-z0-9]+'))) AS parts FROM i)
SELECT page_id, array_to_string(i[1:8], ' ') AS identifiers, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(parts,
  lambda p: list_concat([p], regexp_split_to_array(regexp_replace(regexp_replace(p, '([A-Z][a-z])', ' \1', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' +')))), lambda w: lower(w)), lambda w: length(w) > 1))), ' ') AS terms FROM p""")
def code_queries(spark, sf_dir):
    q = F.concat(F.lit("where is "), "url", F.lit(' and fooBar2Baz or "plain" or my_var used'))
    found = T.code_query(q)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found["identifiers"], " ").alias("identifiers"), F.array_join(F.array_sort(found["terms"]), " ").alias("terms"))


def _archives(rows, suffix, make):
    """Files (path, content): an archive for each row, made where the row lies."""

    def made(row):
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w") as archive:
            for name, body in make(row).items():
                archive.writestr(name, body)
        return file.getvalue()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([f"/f/{row['key']}.{suffix}" for row in part]), pa.array([made(row) for row in part], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _presentation(row):
    """Two slides, of which the second file is shown first; a table, notes and a slide number."""
    space = 'xmlns:a="urn:a" xmlns:p="urn:p" xmlns:r="urn:r"'
    text = lambda *lines: "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines)
    shape = lambda kind, *lines: f"<p:sp><p:nvPr><p:ph type='{kind}'/></p:nvPr><p:txBody>{text(*lines)}</p:txBody></p:sp>"
    slide = lambda body: f"<p:sld {space}><p:spTree>{body}</p:spTree></p:sld>"
    relations = lambda *rows: "<Relationships>" + "".join(f"<Relationship Id='{i}' Type='urn:x/{kind}' Target='{to}'/>" for i, kind, to in rows) + "</Relationships>"
    cells = "".join(f"<a:tc><a:txBody>{text(c)}</a:txBody></a:tc>" for c in ("size", str(row["size"])))
    return {
        "ppt/presentation.xml": f"<p:presentation {space}><p:sldIdLst><p:sldId id='1' r:id='r2'/><p:sldId id='2' r:id='r1'/></p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": relations(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "/ppt/slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape("sldNum", "7") + f"<p:graphicFrame><a:tbl><a:tr>{cells}</a:tr></a:tbl></p:graphicFrame>"),
        "ppt/slides/slide2.xml": slide(shape("title", row["name"]) + shape("body", "costs " + row["price"], row["brand"])),
        "ppt/slides/_rels/slide2.xml.rels": relations(("n", "notesSlide", "../notesSlides/notesSlide1.xml")),
        "ppt/notesSlides/notesSlide1.xml": slide(shape("body", "say " + row["name"]) + shape("sldNum", "1")),
    }


@query("""SELECT p_partkey AS key, '## ' || p_name || chr(10) || chr(10) || 'costs ' || CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR) || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || '> say ' || p_name
  || chr(10) || chr(10) || '## Slide 2' || chr(10) || chr(10) || '| size | ' || p_size || ' |' || chr(10) || '| --- | --- |' AS markdown FROM part""")
def presentations(spark, sf_dir):
    """Parts as presentations, read in the order in which their slides are shown."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("price"), F.col("p_brand").alias("brand"))
    made = D.parse_documents(_archives(spread(rows, "key"), "pptx", _presentation))
    return made.select(F.regexp_extract("path", r"(\d+)\.pptx", 1).cast("long").alias("key"), "markdown")


def _map_of(row):
    """A conversation as a mind map: every turn below the one before it. Odd ones in the older form."""
    if row["key"] % 2:
        below = ""
        for t in reversed(row["turns"]):
            below = f"<topic><title>{escape(t['role'])}</title><notes><plain>{escape(t['said'])}</plain></notes><children><topics type='attached'>{below}</topics></children></topic>"
        return {"content.xml": f"<xmap-content xmlns='urn:x'><sheet><topic><title>{row['key']}</title><children><topics type='attached'>{below}</topics></children></topic><title>Talk</title></sheet></xmap-content>"}
    below = []
    for t in reversed(row["turns"]):
        below = [{"title": t["role"], "notes": {"plain": {"content": t["said"]}}, "children": {"attached": below}}]
    return {"content.json": json.dumps([{"title": "Talk", "rootTopic": {"title": str(row["key"]), "children": {"attached": below}}}])}


@query("""WITH t AS (SELECT conv_id, turn, role, md5(coalesce(text, '')) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(coalesce(text, ''))) AS k FROM conversations)
SELECT conv_id AS key, '# Talk' || chr(10) || chr(10) || '- ' || conv_id || chr(10) || string_agg(repeat('  ', k) || '- ' || role || chr(10) || repeat('  ', k + 1) || '> ' || said, chr(10) ORDER BY k) AS markdown FROM t GROUP BY conv_id""")
def mind_maps(spark, sf_dir):
    """Conversations as mind maps in both forms, read as nested lists."""
    turn = F.struct("turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("said"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    made = D.parse_documents(_archives(rows, "xmind", _map_of))
    return made.select(F.regexp_extract("path", r"(\d+)\.xmind", 1).cast("long").alias("key"), "markdown")
