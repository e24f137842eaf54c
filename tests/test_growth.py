"""What keeps queries whole and quick on larger tables: work is dealt, slices stay in step, classes stand for pairs."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from quern.sources import documents

from .conftest import ROOT, SF

sys.path.insert(0, ROOT)


@pytest.mark.parametrize("name", ["presentations", "tables_from_html"])
def test_rows_of_one_file_are_several_tasks(spark, name):
    from quern.plans import catalog

    made = catalog.QUERIES[name](spark, SF)
    assert made.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_files_leave_a_task_in_slices(spark, monkeypatch):
    rows = spark.range(0, 700, 1, 1).select(F.format_string("/f/%d.%s", "id", F.when(F.col("id") % 3 == 0, "odd").otherwise("md")).alias("path"), F.encode(F.concat(F.lit("text "), "id"), "UTF-8").alias("content"))
    for size in (documents.SLICE_SIZE, 40):  # by the number of files, and by their size
        monkeypatch.setattr(documents, "SLICE_SIZE", size)
        got = {r.path: (r.extension, r.markdown, r.error) for r in documents.parse_documents(rows).collect()}
        assert len(got) == 700
        for n in range(700):
            assert got[f"/f/{n}.{'md' if n % 3 else 'odd'}"] == (("md", f"text {n}", None) if n % 3 else ("odd", None, "no parser for 'odd'"))


def test_clusters_list_no_pairs_of_items(spark, monkeypatch):
    """Tables on the way hold some rows an item, however many items are like each other."""
    from quern.operators import clusters

    sizes, write = {}, clusters.materialise

    def counted(df, name):
        made = write(df, name)
        sizes[name] = max(sizes.get(name, 0), made.count())
        return made

    monkeypatch.setattr(clusters, "materialise", counted)
    items = spark.range(1200).select(F.lit("a").alias("owner"), F.lit("x").alias("kind"), F.col("id").alias("item_id"), F.format_string("word%d common", F.col("id") % 4).alias("text"), F.array(F.col("id").cast("double") + 1, F.lit(10.0)).alias("vector"))
    got = {(r.item_id, r.seed) for r in clusters.clusters(items, 0.3, 1.0).collect()}
    assert got == {(n, 0) for n in range(1200)} and max(sizes.values()) <= 3 * 1200


def test_vectors_meet_again_for_fresh_ones_only(spark):
    """Nothing meets twice; where a neighbour is fresh, its pairs within reach are made and no others."""
    from quern.operators import vector_graph as N

    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "node long, vector array<float>")
    edges = spark.createDataFrame([(1, 2, 0.8), (2, 1, 0.8), (3, 2, 0.6)], "node long, other long, similarity double")
    first = N._members_of(edges, nodes, None, 1)
    again = N._members_of(edges, nodes, first, 1)
    assert first.filter("fresh").count() == first.count() == again.count() > 0 and N._met_at(again, edges, nodes, 1).isEmpty()
    made = {(r.node, r.other, r.similarity) for r in N._meet(N._met_at(first, edges, nodes, 1), 1).collect()}
    assert made == {(1, 2, 0.8), (2, 1, 0.8), (3, 2, 0.6)}  # 2 has nearer ones than 3


def test_replies_are_read_once(spark):
    """No second reading, no shuffle of rows that lie by id; odd replies and ids with several."""
    from quern.operators import graph

    said = ['{"nodes": [{"name": " p "}, {"name": "p"}, {}, {"name": ""}], "relations": [{"from": "p", "to": "q ", "type": "t"}, {"from": "p", "to": "q", "type": "t"}, {"from": "p", "to": "p", "type": "t"}, {"from": "z", "to": "p", "type": "u"}, {"from": "z"}]}',
            '{"nodes": [{"name": "p"}]}', '{"relations": [{"from": "a", "to": "p", "type": "t"}]}', "none", None, "{}"]
    rows = spark.createDataFrame([(n // 3, t) for n, t in enumerate(said)], "id long, text string")
    nodes, edges = graph.parse_graph(rows, ["t"])
    assert sorted(map(tuple, edges.collect())) == [(0, "a", "p", "t"), (0, "p", "q", "t")]
    assert sorted(map(tuple, nodes.collect())) == [(0, "a"), (0, "p"), (0, "q")]
    assert sorted(map(tuple, graph.parse_graph(rows)[1].collect())) == [(0, "a", "p", "t"), (0, "p", "q", "t"), (0, "z", "p", "u")]
    by_id = rows.groupBy("id").agg(F.max("text").alias("text"))
    for made in graph.parse_graph(by_id, ["t"]):
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("from_json") <= 2


def test_short_chunks_fetch_few_neighbours(spark):
    """One chunk of one letter doesn't make all others of its document fetch hundreds; where neighbours are shorter than most, more come."""
    from quern.operators import stitch

    texts = ["x" * 99] * 400 + ["y"] + ["z"] * 30 + ["w" * 99] * 400
    chunks = spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], "doc_id long, chunk_index int, content string")
    assert 90 < stitch._mean_lengths(chunks, "doc_id").first()["_mean"] < 99
    hits = chunks.select("doc_id", "chunk_index").filter("chunk_index IN (7, 415)")
    made = {r.chunk_index: (r.content, r.n_joined) for r in stitch.widen(hits, chunks, 350, 850).collect()}
    for n in (7, 415):
        content, joined, _ = stitch.widen_one({k - n: t for k, t in enumerate(texts)}, 350, 850, -n, len(texts) - 1 - n)
        assert made[n] == (content, joined)


def test_many_keyword_queries_share_a_pass(spark, monkeypatch):
    """Counts are gone through once for thousands of queries, with the scores that each pair has by itself."""
    import math
    import random

    from quern.operators import retrieval as R

    draw = random.Random(5)
    texts = {n: " ".join(draw.choices([f"w{int(draw.paretovariate(0.6))}" for _ in range(40)], k=draw.randint(0, 30))) for n in range(1500)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    asked = df.filter("doc_id < 600").selectExpr("doc_id AS query_id", "text AS query")
    counts = {n: t.split() for n, t in texts.items()}
    mean, seen = sum(map(len, counts.values())) / len(counts), {}
    for words in counts.values():
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1

    def score(q, d):
        own, idf = counts[d], lambda w: math.log(1 + (len(texts) - seen[w] + 0.5) / (seen[w] + 0.5))
        return round(sum(idf(w) * (n := own.count(w)) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in set(counts[q]) & set(own)), 6)

    want = {}
    for q in range(0, 600, 20):
        best = sorted((-s, d) for d in texts if (s := score(q, d)) > 0)[:4]
        want |= {(q, place + 1): (d, -s) for place, (s, d) in enumerate(best)}
    made = R.bm25(df, asked, 4)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for settings in ({}, {"GROUP": 100}, {"SHARED": 2}, {"SHARED": 0, "SLICE": 64}, {"KEPT": 1200, "SCORED": 70, "SLICE": 50}):
        with monkeypatch.context() as m:
            for name, value in settings.items():
                m.setattr(R, name, value)
            got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in R.bm25(df, asked, 4).collect() if r.query_id % 20 == 0}
        assert got.keys() == want.keys() and all(got[at][0] == d and abs(got[at][1] - s) < 2e-6 for at, (d, s) in want.items())


def test_keyword_index_rows_grow_by_segments(spark, tmp_path, monkeypatch):
    """An index has a row for each segment and folder, whatever the number of words, and a stretch ends by its words too."""
    from quern.operators import keyword_index as K
    from quern.operators import retrieval as R

    monkeypatch.setattr(K, "SEGMENT", 16)
    monkeypatch.setattr(K, "MOST_WORDS", 2000, raising=False)
    df = spark.range(0, 320, 1, 2).selectExpr("id AS doc_id", "CASE WHEN id % 50 = 7 THEN NULL ELSE concat_ws(' ', 'all', transform(sequence(0, 30 + id % 9), x -> concat('w', id * x % 997))) END AS text")
    asked = spark.createDataFrame([(1, "w12 w40 all"), (2, "w500 w3"), (3, "nowhere"), (4, None)], "query_id long, query string")
    index = K.KeywordIndex(spark, str(tmp_path / "i"), folders=4).add(df.filter("doc_id < 100")).add(df.filter("doc_id >= 100"))
    rows = [spark.read.parquet(str(f)).count() for f in (tmp_path / "i").iterdir() if f.name != "sizes"]
    assert sum(rows) <= 5 * (320 / 16 + 2 * 2 * 8) < df.selectExpr("explode(split(text, ' ')) AS w", "doc_id").count() / 10
    got, want = (sorted(map(tuple, found.collect())) for found in (index.search(asked, 6), R.bm25(df, asked, 6)))
    assert got == want and {g[0] for g in got} == {1, 2}


def test_drive_reads_in_slices(spark, tmp_path, monkeypatch):
    """What a task reads leaves it in slices by number and size, the same rows as before, and a scan is left after the last."""
    from quern.sources import drive

    items = spark.range(0, 300, 1, 2).selectExpr("concat('h/', id % 3, '/', id, '.txt') AS item_id", "CASE WHEN id = 7 THEN '' ELSE repeat('x', int(id)) END AS text")
    spark.dataSource.register(drive.Drive)
    items.write.format("drive").mode("append").option("path", str(tmp_path / "root")).save()
    want = {tuple(r) for r in items.collect()}
    options = {"path": str(tmp_path / "root"), "state": str(tmp_path / "state"), "buckets": "2"}
    monkeypatch.setattr(drive, "ROWS", 100, raising=False)
    monkeypatch.setattr(drive, "CHARS", 5000, raising=False)
    for reader in (drive.Drive(options).reader(None), drive.Drive(options).streamReader(None)):
        got = []
        for number, folders in reader.folders.dealt().items():
            for batch in reader.read(drive.Bucket(number, folders, 0, 1)):
                texts = batch.column("text").to_pylist()
                assert len(texts) <= 100 and sum(map(len, texts[:-1])) < 5000
                got += zip(batch.column("item_id").to_pylist(), texts, strict=True)
        assert len(got) == 300 and set(got) == want
    assert reader._scans() == [1] and not list(reader.read(drive.Bucket(0, reader.folders.dealt().get(0, []), 1, 2)))
    read = spark.read.format("drive").options(**options).load().select("item_id", "text")
    assert {tuple(r) for r in read.collect()} == want


def test_titles_that_pages_have_are_never_shuffled(spark):
    """Short titles are followed through the texts: what pages have of them, and the pairs, stay in the task that found them."""
    from quern.operators import graph

    words = [f"w{k}" for k in range(40)] + ["é", "a" * 70]
    texts = [(k, words[k % 42], " ".join(words[(k * j) % 42] for j in range(1, 30))) for k in range(300)]
    pages = spark.createDataFrame(texts, "slug long, title string, text string").repartition(2)
    links = spark.createDataFrame([(k, (k * 7 + 3) % 50) for k in range(300)], "slug long, target long")
    made = graph.missing_links(pages, links)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, made.collect())) == sorted({(k, s) for k, _, text in texts for s, t, _ in texts if s != k and t in text} - {(k, (k * 7 + 3) % 50) for k in range(300)})
    followed = graph._titles_within(pages, pages.filter("length(title) < 60"))
    steps = followed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in steps and steps.count("Exchange hashpartitioning") == 1  # the texts, once


def test_patterns_are_followed_or_anchored(spark, monkeypatch):
    """Few short patterns, many, and repeated ids: the same pairs by both ways."""
    from quern.operators import containment as C

    texts = spark.createDataFrame([(k % 50, ("abcab" * (k % 7) + f"x{k % 11}é" * (k % 3)) or None) for k in range(60)], "doc_id long, text string")
    parts = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "ab", "ab", "bca", "abcabcab", "x1", "éx1", "", "q", None, "abcab" * 6])] + [(None, "a"), (0, "b"), (1, "abcab" * 6)], "passage_id long, passage string")
    want = {(t, p) for t, x in texts.collect() for p, y in parts.collect() if x and y and p is not None and y in x}
    for held, longest in ((2_000_000, 64), (2_000_000, 3), (5, 64)):
        monkeypatch.setattr(C, "HELD", held, raising=False)
        monkeypatch.setattr(C, "LONGEST", longest, raising=False)
        got = [tuple(r) for r in C.containing(texts, parts, within=False, follow=True).collect()]
        assert len(got) == len(want) and set(got) == want


def test_linked_pages_read_texts_once(spark):
    """Titles, places and bearers meet in the texts' task: the same links as by joins, and no join but with titles without words."""
    from quern.operators import graph

    rng = random.Random(11)
    words = ["a", "a-", "-a", "b", "ab", "a b", "b,", "é b", "[[3|b]]", "`a`", "c" * 70, "a.b"]
    rows = [(k, rng.choice(words), " ".join(rng.choices(words, k=rng.randrange(30))) if k % 9 else None) for k in range(120)]
    pages = spark.createDataFrame(rows + [(5, "ab", "a b ab b a")], "slug long, title string, text string")
    joined = graph._linked_by_shuffles(pages, pages.filter("title != ''").selectExpr("title", "string(slug) AS bearer").distinct())
    made = graph.linked_pages(pages)
    assert sorted(map(repr, made.collect())) == sorted(map(repr, joined.collect()))
    plain = graph.linked_pages(pages.filter("length(title) < 60"))
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1 and plan.count("Repartition") == 1
    texts = ["", *(r.text for r in made.collect() if r.text)]
    known = graph.WordTitles([w for w in words if len(w) < 60])
    for text in texts:
        free = graph.free_text(text)
        assert known.places(free) == dict(graph.title_places(text, [w for w in words if len(w) < 60]))


def test_widened_contents_are_shuffled_once(spark, monkeypatch):
    """Chunks are dealt by document once and nothing else is; hits as a table, with columns of their own, or as a condition."""
    from quern.operators import stitch

    rng = random.Random(3)
    rows = [(d, n, None if rng.random() < 0.05 else rng.choice("xyz") * rng.choice([1, 30, 120, 400])) for d in range(30) for n in range(rng.choice([1, 5, 60])) if rng.random() < 0.95]
    chunks = spark.createDataFrame(rows + [(None, 1, "lost")], "doc_id long, chunk_index int, content string").repartition(3)
    hits = spark.createDataFrame([(d, n, f"{d}-{n}", {"k": n}) for d in range(32) for n in range(0, 60, 3)], "doc_id long, chunk_index long, name string, more map<string,int>")
    texts = {d: {n: t or "" for e, n, t in rows if e == d} for d in range(30)}
    plain = lambda d, n: stitch.widen_one({k - n: t for k, t in texts[d].items()}, 350, 850, min(texts[d]) - n, max(texts[d]) - n)[:2]
    want = sorted((d, n, *plain(d, n)) for d in texts for n in texts[d] if n % 3 == 0)
    monkeypatch.setattr(stitch, "OUTPUT", 900)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = stitch.widen(hits, chunks)
        assert made.columns == ["doc_id", "chunk_index", "name", "more", "content", "n_joined"]
        assert all(r.name == f"{r.doc_id}-{r.chunk_index}" and r.more == {"k": r.chunk_index} for r in made.collect())
        one = stitch.widen(F.col("chunk_index") % 3 == 0, chunks)
        for of in (made, one):
            assert sorted((r.doc_id, r.chunk_index, r.content, r.n_joined) for r in of.collect()) == want
            plan = of._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Repartition") - 1 == 1 and "Join" not in plan and "Aggregate" not in plan  # the rows, once; the other one made these chunks
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
