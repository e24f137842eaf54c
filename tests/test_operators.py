"""Operators that SQL can't express, and edge cases, against plain Python."""

import json
import random
import re
import shutil

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.functions import prepare
from quern.operators import chunking, clusters, code_chunks, containment, faq, graph, memory, metrics, relations, rerank, retrieval, sql_surface, stitch
from quern.operators.table_functions import TABLE_FUNCTIONS
from quern.session import fresh
from quern.sources import documents, feed, files, html
from quern.streaming import absence, ingest


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_mmr_is_the_naive_greedy_choice():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(1, 25)
        scores = [rng.random() for _ in range(n)]
        tokens = [{rng.choice("abcdefgh") for _ in range(rng.randrange(5))} for _ in range(n)]
        chosen = []
        while len(chosen) < min(8, n):
            values = [(0.7 * scores[i] - 0.3 * max([jaccard(tokens[i], tokens[j]) for j in chosen], default=0.0), -i) for i in range(n) if i not in chosen]
            chosen.append(-max(values)[1])
        assert rerank.choose_mmr(scores, tokens, 8) == chosen


def test_overlaps():
    texts = ["a b c d", "a b c d e", "x y", "x y", ""]
    tokens = [set(t.split()) for t in texts]
    one = lambda scores, sources=("s",) * 5: rerank.distinct_texts(texts, tokens, list(sources), scores)
    assert one([0.5, 0.5, 0.9, 0.1, 0.2]) == [1, 2, 4]
    assert one([0.9, 0.5, 0.1, 0.9, 0.2]) == [0, 3, 4]
    assert one([0.9, 0.5, 0.1, 0.9, 0.2], ["s", "t", "s", "t", "s"]) == [0, 1, 2, 3, 4]
    rng = random.Random(2)
    for _ in range(100):
        words = [[rng.choice("abcdef") for _ in range(rng.randrange(1, 7))] for _ in range(8)]
        texts, scores, sources = [" ".join(w) for w in words], [rng.choice([0.1, 0.5, 0.9]) for _ in words], [rng.choice("st") for _ in words]
        alike = lambda i, j: sources[i] == sources[j] and (texts[i] in texts[j] or texts[j] in texts[i] or len(set(words[i]) & set(words[j])) >= 0.85 * min(len(set(words[i])), len(set(words[j]))))  # noqa: B023, E731
        got = rerank.distinct_texts(texts, [set(w) for w in words], sources, scores)
        above = lambda i, j: (-scores[i], -len(texts[i]), i) < (-scores[j], -len(texts[j]), j)  # noqa: B023, E731
        assert not any(alike(i, j) for i in got for j in got if i != j)
        assert all(any(alike(i, j) and above(j, i) for j in got) for i in range(8) if i not in got)


def test_rerank_per_query(spark):
    rows = [(1, k, 1 - k / 10, f"word{k} shared text here") for k in range(6)] + [(2, 9, 0.4, None)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double, text string")
    out = rerank.mmr(df, 3).toPandas()
    assert out.groupby("query_id").size().to_dict() == {1: 3, 2: 1}
    assert set(out[out.query_id == 1]["rank"]) == {1, 2, 3}


PIECES = ["word ", "ab. ", "\n", "\n\n", "\n\n\n\n", "# Head\n", "## Sub here\n", "```\n# no head\n```\n", "| a | b |\n| --- | --- |\n", "| 1 | 2 |\n", "CHAPTER LINE\n", "1. Numbered\n", "Chapter 3. Go\n", "\f", "---\n", "$$x+y$$ ", "![i](u.png) ", "[t](http://x y)", "x" * 70, "é漢字。"]


@pytest.mark.parametrize("size,overlap", [(50, 0), (120, 30), (400, 80)])
@pytest.mark.parametrize("tier", ["headings", "heuristic", "recursive"])
def test_chunks_cover_the_text(size, overlap, tier):
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 60)))
        chunks = chunking.SPLITTERS[tier](text, size, overlap)
        assert all(0 <= a < b <= len(text) and b - a <= size for a, b, _, _ in chunks), (tier, text)
        reach = 0
        for a, b, _, _ in chunks:
            assert a <= reach <= b and reach - a <= 2 * overlap
            reach = b
        assert reach == len(text)


def test_protected_spans_stay_whole():
    table = "| h | k |\n| --- | --- |\n" + "".join(f"| row {k} | {k} |\n" for k in range(30))
    text = "before words here. " * 3 + "\n\n" + table + "\nand $$a + b = c$$ after [link text](http://x.y/z) " * 4
    chunks = chunking.split_recursive(text, 120, 0)
    for m in chunking.PROTECTED.finditer(text):
        assert any(a <= m.start() and m.end() <= b for a, b, _, _ in chunks)
    inside = [c for c in chunks if text[c[0] :].startswith("| row") and c[3]]
    assert len(inside) > 3 and all(c[3] == "| h | k |\n| --- | --- |\n" for c in inside)
    assert not [c for c in chunks if c[3] and not text[c[0] :].startswith("| row")]


def test_headings_give_breadcrumbs():
    text = "intro\n# A\nbody\n## B\nmore\n```\n# not one\n```\n# C\nend"
    crumbs = [c for _, _, c, _ in chunking.split_headings(text, 30, 0, 2)]
    assert crumbs[0] == "" and "# A" in crumbs and "# A\n## B" in crumbs and crumbs[-1] == "# C" and not any("not one" in c for c in crumbs)
    short = "# T\n" + "".join(f"## S{k}\nfew words\n" for k in range(6))
    joined = chunking.split_headings(short, 300, 0, 2)
    assert len(joined) == 1 and joined[0][2] == "# T"  # neighbours under one heading join


def test_verdicts(spark):
    rng = random.Random(4)
    cases = [[600] * 3, [2000], [20, 20, 20, 600], [20, 20, 20, 20, 600], [60] * 20, [1100, 600], [30], [30, 600]]
    cases += [[rng.choice([10, 40, 60, 130, 500, 1200]) for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    rows = [(d, k, sum(n[: k + 1]), "x" * n[k]) for d, n in enumerate(cases) for k in range(len(n))]
    got = {r.doc_id: r.verdict for r in chunking.validate(spark.createDataFrame(rows, "doc_id long, chunk_index int, end_at int, content string"), 512).collect()}
    assert got == {d: chunking.verdict(n, sum(n), 512) for d, n in enumerate(cases)}
    assert [got[k] for k in range(8)] == ["ok", "single_huge", "many_tiny", "many_tiny", "all_small", "too_long", "ok", "ok"]


def test_tier_chain_and_limits(spark):
    texts = {1: "# A\nx\n# B\ny\n# C\nz\n", 2: "one\fpage", 3: "plain words only", 4: "", 5: None, 6: "Kapitel 4: Los\ntext", 7: "第 3 章 开始\n内容", 8: "a\r\nb\rc"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tiers = {r.doc_id: r.t for r in chunking.profile(docs).select("doc_id", chunking.tiers().alias("t")).collect()}
    assert tiers[1] == ["headings", "recursive"] and tiers[2] == tiers[6] == tiers[7] == ["heuristic", "recursive"] and tiers[3] == tiers[4] == tiers[5] == ["recursive"]
    out = chunking.split_documents(docs).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 6, 7, 8} and [r.content for r in out if r.doc_id == 8] == ["a\nb\nc"]
    assert chunking.token_size(512, "zh", 100) == 153 and chunking.token_size(512, "en", None) == 512 and chunking.token_size(512, "en", 1000) == 512


def test_restored_with_gaps(spark):
    rows = [(1, 0, 0, 5, "abcde"), (1, 1, 3, 8, "defgh"), (1, 2, 10, 12, "kl"), (2, 0, 0, 2, "xy"), (2, 1, 0, 1, "x")]
    out = chunking.restore(spark.createDataFrame(rows, "doc_id long, chunk_index int, start_at int, end_at int, content string"), "~")
    assert {r.doc_id: r.text for r in out.collect()} == {1: "abcdefgh~kl", 2: "xy"}


def test_joining_texts():
    a, b = "the quick brown fox jumps", "brown fox jumps over it"
    assert stitch.join_texts(a, b) == "the quick brown fox jumps over it"
    assert stitch.join_texts(a, "quick brown fox") == a and stitch.join_texts("", b) == b
    assert stitch.join_texts("one", "two") == "one\n\ntwo" and stitch.join_texts("fox", "a fox ran", " ") == "fox a fox ran"
    assert stitch.append_exact("abcdef", "defgh", 3) == "abcdefgh" and stitch.append_exact("abc", "xbcd", 2) is None and stitch.append_exact("ab", "cd", 0) == "abcd"
    head = "| name | size |\n|---|---|\n"
    body = "| first row here | 1 |\n| second row here | 2 |\n"
    assert stitch.append_searched(head + body, head + "| second row here | 2 |\n| third | 3 |\n", 24) == head + body + "| third | 3 |\n"
    assert stitch.append_searched("same words again", "same words again", 0) == "same words againsame words again"
    rng = random.Random(7)
    for _ in range(300):
        x, y = ("".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(2))
        best = max([n for n in range(12, min(len(x), len(y)) + 1) if x[-n:] == y[:n]], default=0)
        assert stitch.shared_end(x, y) == best


def test_stitch(spark):
    text = "".join(f"sentence number {k} of the text. " for k in range(60))
    def chunk(k, a, b, content=None, edited=False, score=0.5, images=None):
        return (1, 9, "text", f"c{k}", k, a, b, score, text[a:b] if content is None else content, edited, images)

    image = '[{"url": "u1"}, {"url": "u2"}]'
    rows = [chunk(0, 0, 100), chunk(1, 80, 200, score=0.9, images=image), chunk(2, 120, 180, images='[{"url": "u2", "caption": "again"}, {"url": "u3"}]'), chunk(3, 300, 400), chunk(4, 390, 470, "an edited body, another length", True), chunk(8, 700, 760, "alone and edited", True)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, chunk_type string, chunk_id string, chunk_index int, start_at int, end_at int, score double, content string, edited boolean, images string")
    out = stitch.stitch(df).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.parts) for r in out] == [(0, ["c0", "c1", "c2"]), (3, ["c3", "c4"]), (8, ["c8"])]
    assert out[0].content == text[:200] and out[0].score == 0.9 and out[0].end_at == 200 and [i["url"] for i in json.loads(out[0].images)] == ["u1", "u2", "u3"]
    assert out[1].content == text[300:400] + "\n\n" + "an edited body, another length" and out[0]["rank"] == 1


def test_stitched_ranks_meet_in_no_task(spark):
    """Groups fold as rows of a scan, and ranks of one query come from ranges: neither from groups nor from a window of texts."""
    rng = random.Random(4)
    rows = [(q, d, "text", f"c{k}", k, 0, 3, rng.choice((0.5, 0.7, None)), f"abc{k}", True, None) for q in (1, 2, None) for d in range(200) for k in (0, 5)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, chunk_type string, chunk_id string, chunk_index int, start_at int, end_at int, score double, content string, edited boolean, images string")
    made = stitch.stitch(df.repartition(7))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
    got = sorted((r.query_id or 0, r["rank"], r.doc_id, r.chunk_index, r.score) for r in made.collect())
    want = []
    for q in (0, 1, 2):
        own = sorted((r for r in rows if (r[0] or 0) == q), key=lambda r: (-(r[7] or 0), r[1], r[4]))
        want += [(q, k + 1, r[1], r[4], r[7]) for k, r in enumerate(own)]
    assert got == want
    assert "rank" not in stitch.stitch(df, ranked=False).columns



def test_widen(spark):
    texts = [f"chunk {k} " + "w" * (20 + 30 * (k % 3)) for k in range(30)]
    chunks = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, "alone"), (3, 5, "long" * 100)], "doc_id long, chunk_index int, content string")
    hits = spark.createDataFrame([(1, 0), (1, 10), (1, 29), (2, 0), (3, 5), (9, 9)], "doc_id long, chunk_index int")
    got = {(r.doc_id, r.chunk_index): (r.content, r.n_joined) for r in stitch.widen(hits, chunks).collect()}
    for at in (0, 10, 29):
        lo, hi = max(0, at - 1), min(29, at + 1)
        while len("\n\n".join(texts[lo : hi + 1])) < 350 and (lo > 0 or hi < 29):
            if lo > 0:
                lo -= 1
            if len("\n\n".join(texts[lo : hi + 1])) < 350 and hi < 29:
                hi += 1
        assert got[1, at] == ("\n\n".join(texts[lo : hi + 1])[:850], hi - lo)
    assert got[2, 0] == ("alone", 0) and got[3, 5] == ("long" * 100, 0) and len(got) == 5


def test_text_metrics(spark):
    pairs = [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "", "the cat"), (3, "x", "y"), (4, "a b", "b c"), (5, None, None), (6, "a. b. c.", "a。b。c"), (7, "the the the", "the cat"), (8, "漢字文 OK", "漢字 ok")]
    df = spark.createDataFrame(pairs, "pair_id long, generated string, truth string")
    got = {r.pair_id: r for r in metrics.text_metrics(df).collect()}
    assert got[1].bleu1 == got[1].bleu4 == pytest.approx(1.0) and got[1].rouge2 == pytest.approx(1.0, abs=1e-6)
    assert got[2].bleu1 == got[2].rouge1 == got[5].bleu1 == 0 and got[3].bleu1 == pytest.approx(0.5) and got[4].rouge1 == pytest.approx(0.5, abs=1e-6)
    assert got[6].rouge1 == pytest.approx(1.0, abs=1e-6)  # every sentence counts
    assert got[7].bleu1 == pytest.approx((1 + 1) / (3 + 1)) and got[8].bleu1 == pytest.approx((2 + 1) / (3 + 1)) and got[8].rouge1 == pytest.approx(0.4, abs=1e-6)
    long = {r.pair_id: r.rougel for r in metrics.rouge_l(df).collect()}
    assert long[1] == pytest.approx(1.0, abs=1e-6) and long[4] == pytest.approx(0.5, abs=1e-6) and long[2] == long[5] == 0
    means = {r.metric: (r["mean"], r.n) for r in metrics.mean_metrics(metrics.text_metrics(df)).collect()}
    assert means["bleu1"] == (pytest.approx(sum(r.bleu1 for r in got.values()) / 8), 8)


def test_text_metrics_shuffle_no_grams(spark):
    """Grams are counted within their rows, which go to Python in slices."""
    rows = [(k, f"a b c{k % 7} a B. d", f"a b a b d{k % 5}") for k in range(2 * metrics.SLICE + 3)] + [(-1, None, "a"), (-2, "", None), (-3, "a b", "c")]
    df = spark.createDataFrame(rows, "pair_id long, generated string, truth string").coalesce(1)
    made = metrics.text_metrics(df)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.pair_id: r for r in made.collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    assert all(got[k][1:] == got[k + 35][1:] for k in range(35))
    assert got[-1][1:] == got[-2][1:] == (0.0,) * 5
    assert got[0].rouge1 == pytest.approx(2 * 2 / 5 * 2 / 3 / (2 / 5 + 2 / 3)) and got[0].bleu1 == pytest.approx(5 / 7)



def test_injected_history_takes_token_sets(spark):
    texts = ["aa bb cc", "aa bb dd", "aa ee ff gg hh ii jj", "aa bb", "", None]
    rows = [(q, d, 1.0 / (1 + d), texts[d], texts[q]) for q in range(6) for d in range(6) if d != q]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double, text string, query string")
    present = spark.createDataFrame([(0, 3)], "query_id long, doc_id long")
    sets = df.withColumns({c: T.token_set(F.col(c)) for c in ("text", "query")})
    got = [sorted(tuple(r) for r in rerank.inject_history(x, present).collect()) for x in (df, sets)]
    assert got[0] == got[1] and [(r[0], r[1]) for r in got[0]] == [(0, 1), (1, 0), (1, 3), (3, 0), (3, 1)]



def test_words_on_a_longest_common_subsequence():
    from itertools import combinations

    rng = random.Random(11)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(7))] for _ in range(2))
        every = lambda w: {tuple(w[i] for i in c) for n in range(len(w) + 1) for c in combinations(range(len(w)), n)}
        shared = every(x) & every(y)
        most = max(map(len, shared))
        assert metrics.on_a_longest(x, y) == {w for s in shared if len(s) == most for w in s}


def test_retrieval_metrics_of_missing_results(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    truth = spark.createDataFrame([(1, 11), (2, 5)], "query_id long, doc_id long")
    out = {r.query_id: r for r in metrics.retrieval_metrics(results, truth).collect()}
    assert (out[1].precision, out[1].recall, out[1].mrr, out[1].map) == (0.5, 1.0, 0.5, 0.5)
    assert out[2].recall == out[2].ndcg3 == 0.0


def test_text_functions(spark):
    row = spark.createDataFrame([("Hello  World x", "漢字文 ab", "<think>no</think> yes", "getHTTPName my_var", None)], "a string, b string, c string, d string, n string").select(
        T.normalise(F.col("a")).alias("norm"), T.token_set(F.col("a")).alias("set"), T.cjk_tokens(F.col("b")).alias("cjk"), T.strip_thinking(F.col("c")).alias("plain"),
        T.identifier_terms(F.col("d")).alias("ids"), T.bigram_set(F.lit("aXa!a")).alias("pairs"), T.bigram_set(F.lit("7")).alias("one"), T.bigram_set(F.lit("!")).alias("none"),
        T.signature(F.col("n")).alias("null"),
    ).first()
    assert row.norm == "hello world x" and row.set == ["hello", "world"] and row.cjk == ["漢字", "字文", "ab"] and row.plain == "yes"
    assert row.ids == ["get", "httpname", "my", "var"] and row.pairs == ["ax", "xa", "aa"] and row.one == ["7"] and row.none == [] and row.null is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0, 0.0]
    assert df.select(V.unit(F.col("a"))).first()[0] == [0.6, 0.8]


def test_vector_search_passes_over_bad_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [float("nan"), 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0]), (7, [1.0, 0.0])]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    out = [(r.vec_id, r.score) for r in retrieval.vector_search(index, asked, 3).orderBy("rank").collect()]
    assert out == [(1, 1.0), (7, 1.0), (2, 0.0)]
    assert retrieval.vector_search(index, asked.limit(0), 3).count() == 0
    for bad in ([(1, [1.0, 0.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0])], [(1, None)]):
        with pytest.raises(ValueError):
            retrieval.vector_search(index, spark.createDataFrame(bad, "query_id long, vector array<float>"), 3)
    with pytest.raises(ValueError):
        retrieval.vector_search(index, asked, 3, metric="nonsense")
    named = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, vector array<float>")
    big = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 0.0])], "vec_id string, embedding array<float>")
    score = lambda metric: {(r.query_id, r.vec_id): r.score for r in retrieval.vector_search(big, named, 3, metric=metric).collect()}
    assert score("ip") == {("q", "a"): 3.0, ("q", "b"): 1.0, ("z", "a"): 0.0, ("z", "b"): 0.0} and score("cosine")["q", "a"] == 0.6


def test_searches_in_small_slices_are_the_same(spark, monkeypatch):
    """Slices, groups and cuts of candidates change nothing; ties go to the smaller id."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["rain", "stone", "river", "cloud", "wind", "leaf"]) for _ in range(rng.randrange(9)))) for k in range(400)], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{k}", rng.choice(["rain river", "stone", "leaf wind cloud", "nothing"])) for k in range(12)], "query_id string, query string")
    vectors = spark.createDataFrame([(k, [float(rng.randrange(3)) for _ in range(3)]) for k in range(500)], "vec_id long, embedding array<float>")
    wanted = spark.createDataFrame([(k, [1.0, float(k), 0.5]) for k in range(9)], "query_id long, vector array<float>")
    run = lambda: (sorted(map(tuple, retrieval.bm25(docs, asked, 5).collect())), sorted(map(tuple, retrieval.vector_search(vectors, wanted, 5).collect())))
    whole = run()
    for name, value in (("GROUP", 5), ("SCORED", 2), ("SLICE", 7), ("BLOCK", 4), ("SCORES", 1)):
        monkeypatch.setattr(retrieval, name, value)
    assert run() == whole and len(whole[0]) > 30 and len(whole[1]) == 45


def test_search_words_in_chinese_text(spark):
    assert retrieval.search_words("漢字文 ab_Cd 一 x中文y") == ["漢字", "字文", "ab", "cd", "一", "x", "中文", "y"]
    docs = spark.createDataFrame([(1, "我喜歡中文書籍"), (2, "別的東西")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "中文")], "query_id long, query string")
    assert [r.doc_id for r in retrieval.bm25(docs, asked).collect()] == [1]


def test_bm25_without_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "any words")], "query_id long, query string")
    assert retrieval.bm25(docs, asked).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else "b", None if k == 3 else k != 4) for k in range(8)], "doc_id long, kb_id string, on boolean").withColumn("tag", F.lit("t"))
    assert {r.doc_id for r in retrieval.base_filter(df, kb_ids=["a"], not_docs=[5], enabled_col="on").collect()} == {1, 3, 7}
    assert {r.doc_id for r in retrieval.base_filter(df, doc_ids=range(2, 2000), enabled_col="on").collect()} == {2, 3, 5, 6, 7}
    tree = {"or": [{"field": "doc_id", "op": "lt", "value": 2}, {"and": [{"field": "kb_id", "op": "like", "value": "b%"}, {"field": "doc_id", "op": "not_in", "value": [4]}]}]}
    assert {r.doc_id for r in df.filter(retrieval.filter_tree(tree)).collect()} == {0, 1, 2, 6}
    with pytest.raises(ValueError):
        retrieval.filter_tree({"field": "a", "op": "near", "value": 1})
    assert (retrieval.retrieval_pool(10), retrieval.retrieval_pool(0, 9), retrieval.retrieval_pool(5, 2)) == (50, 500, 100)


def test_containing(spark):
    docs = spark.createDataFrame([(1, "xx abc yy bc"), (2, "b"), (3, ""), (4, None), (5, "none"), (None, "abc")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "abc"), (8, "bc"), (9, ""), (10, None)], "passage_id long, passage string")
    assert {tuple(r) for r in containment.containing(docs, passages).collect()} == {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert containment.containing(docs.limit(0), passages).count() == 0 == containment.containing(docs, passages.limit(0)).count()


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_containing_is_the_plain_search(spark, monkeypatch, most):
    """Passages of every length, in repetitive and in varied texts, with the keys broadcast and without."""
    monkeypatch.setattr(containment.found_in, "__defaults__", (most,))
    rng = random.Random(9)
    made = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    docs = [(k, made(rng.choice([3, 20, 60, 200, 900]), rng.choice(["ab", "abcdefgh é漢", "a"]))) for k in range(60)]
    cut = lambda t, n: (lambda a: t[a : a + n])(rng.randrange(max(1, len(t) - n)))
    passages = [(100 + k, cut(rng.choice(docs)[1], n) + rng.choice(["", "", "a"])) for k, n in enumerate([1, 2, 3, 5, 7, 8, 9, 20, 30, 31, 32, 50, 80, 120, 300] * 4)]
    passages += [(300 + k, made(10, "ab") + docs[k][1] + made(9, "é漢")) for k in range(0, 60, 4)] + [(400, "the same"), (401, "the same")]
    docs += [(500, "it is the same again"), (501, "the same")]
    want = {(i, j) for i, t in docs for j, p in passages if p in t or t in p}
    got = containment.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "passage_id long, passage string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 200


def plain_link_text(text, titles):
    """Titles one by one, each from the beginning."""
    parts = [(p, k % 2 == 0) for k, p in enumerate(re.split(f"({graph.UNLINKED.pattern})", text, flags=re.S))]
    linked = set(re.findall(r"\[\[([^\]|]+)", text))
    for slug, title in sorted(titles, key=lambda t: (-len(t[1]), t[1], t[0])):
        if not title or slug in linked:
            continue
        for k, (part, free) in enumerate(parts):
            edges = [r"(?<![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", title) else "", r"(?![A-Za-z0-9_])" if re.search(r"[A-Za-z0-9_]\Z", title) else ""]
            found = re.search(edges[0] + re.escape(title) + edges[1], part) if free else None
            if found:
                parts[k : k + 1] = [(part[: found.start()], True), (f"[[{slug}|{title}]]", False), (part[found.end() :], True)]
                linked.add(slug)
                break
    return "".join(p for p, _ in parts)


@pytest.mark.parametrize("twice", [False, True])
def test_pages_of_one_title(spark, monkeypatch, twice):
    """Titles are looked for once each, however many pages bear them; links are those of all pages, one by one."""
    rng = random.Random(5)
    words = ["a", "a-", "-a", "b", "ab", "é", "a b", "`b`", "[[3|b]]", "foohttp://a", "b,", "c"]
    pages = [(k, rng.choice(words[:7]), " ".join(rng.choices(words, k=rng.randrange(12)))) for k in range(60)]
    pages += [(k, rng.choice(words[:7]), "a b ab") for k in range(30)] if twice else []
    df, asked = spark.createDataFrame(pages, "slug long, title string, text string"), []
    plain = containment.containing
    monkeypatch.setattr(containment, "containing", lambda docs, passages, *a, **b: asked.append(passages.count()) or plain(docs, passages, *a, **b))
    monkeypatch.setattr(graph, "BLOCK", 3)
    made = sorted((r.slug, r.text) for r in graph.linked_pages(df).collect())
    has = lambda k, text: [(str(s), t) for s, t, _ in pages if s != k and any(t in x for j, _, x in pages if j == k)]
    assert made == sorted((k, plain_link_text(text, list(dict.fromkeys(has(k, text))))) for k, _, text in pages)
    links = [(k, (k * 7) % 60) for k in range(60)]
    missing = sorted(tuple(r) for r in graph.missing_links(df, spark.createDataFrame(links, "slug long, target long")).collect())
    assert missing == sorted({(k, s) for k, _, text in pages for s, t, _ in pages if s != k and t in text} - set(links))
    assert asked == [1, len({t for _, t, _ in pages})]  # links meet on words, but for the title without ASCII letters


def test_similar_surfaces_loses_no_pair(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(120)}
    grams = {n: ({n[i : i + 2] for i in range(len(n) - 1)} or {n}) for n in names}
    want = {(a, b) for a in names for b in names if a < b and round(jaccard(grams[a], grams[b]), 6) >= 0.5}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {(r.a, r.b) for r in relations.similar_surfaces(df, 0.5).collect()} == want and want


def test_similar_names_meet_in_cells(spark):
    """A pair of characters that all names have deals them into cells; long names fill the bits."""
    rng = random.Random(8)
    names = ["ab" + "".join(rng.choice("abcdeäß") for _ in range(rng.choice((3, 6, 400)))) for _ in range(60)]
    names = sorted({*names, *(n[:-1] + "x" for n in names)})
    grams = {n: {n[i : i + 2] for i in range(len(n) - 1)} for n in names}
    alike = {(a, b) for a in names for b in names if round(jaccard(grams[a], grams[b]), 6) >= 0.6}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    left, right = df.filter(F.length("name") % 2 == 0), df.filter(F.crc32("name") % 2 == 0)
    one, two = ({r.name for r in side.collect()} for side in (left, right))
    got = lambda *sides: {(r.a, r.b) for r in relations.similar_across(*sides, 0.6, cell=7).collect()}
    assert got(df, None) == {(a, b) for a, b in alike if a < b}
    assert got(left, right) == {(a, b) for a, b in alike if a in one and b in two} != set()


def test_budget(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 40), (1, 4, 10), (2, 1, 500)], "query_id long, rank int, cost int")
    out = memory.within_budget(df, "query_id", 3, 100)
    assert {(r.query_id, r["rank"]) for r in out.collect()} == {(1, 1), (1, 3), (1, 4)} - ({(1, 4)} if 50 + 40 + 10 > 100 else set())


def test_folder_totals_and_components_of_paths(spark):
    df = spark.createDataFrame([("/a/b/",), ("a",), ("a//b/c",), ("",)], "path string")
    got = {r.folder: (r.n_direct, r.n_total) for r in graph.folder_totals(df).collect()}
    assert got == {"": (1, 4), "a": (1, 3), "a/b": (1, 2), "a/b/c": (1, 1)}


SQL_BAD = [
    "DROP TABLE t", "SELECT * FROM t; SELECT 1", "INSERT INTO t VALUES (1)", "SELECT * FROM other", "SELECT * FROM parquet.`/etc`", "SELECT * FROM csv.`/tmp/x`",
    "SELECT * FROM t WHERE 1 = 1", "SELECT * FROM t WHERE a = 1 OR '1' = '1'", "SELECT * FROM t WHERE true", "SELECT * FROM t WHERE a IN (SELECT b FROM secret)",
    "SELECT reflect('java.lang.System', 'exit', '0') FROM t", "SELECT * FROM range(10)", "WITH x AS (SELECT * FROM secret) SELECT * FROM x", "SHOW TABLES", "SELECT (a FROM t",
    "SELECT (SELECT max(b) FROM secret) FROM t", "DESCRIBE t", "SELECT * FROM t WHERE a = 1 AND NOT (0 = 1)", "SELECT uuid() FROM t", "SELECT current_database() FROM t", "SELECT a FROM t GROUP BY a HAVING 1 = 1",
    "SELECT x.a FROM t x JOIN t y ON 1 = 1", "SELECT * FROM t WHERE a = a", "SELECT no_such_function(a) FROM t", "SELECT spark_catalog.f(a) FROM t", "SELECT * FROM t WHERE '' = ''", "SELECT * FROM t WHERE false",
]


@pytest.mark.parametrize("sql", SQL_BAD)
def test_sql_rejected(spark, sql):
    with pytest.raises(sql_surface.SqlRejected):
        sql_surface.check(spark, sql, {"t"})


def test_sql_surface(spark):
    t = spark.createDataFrame([(1, "x", 7, None), (2, "y", 7, None), (3, "z", 8, None), (4, "w", 7, "gone")], "a int, b string, tenant_id int, deleted_at string")
    views = {"t": sql_surface.secured(t, 7, deleted_col="deleted_at")}
    run = lambda sql: sorted(tuple(r) for r in sql_surface.run(spark, sql, views).collect())
    assert run("SELECT a FROM T") == [(1,), (2,)]
    assert run("WITH x AS (SELECT a FROM t WHERE b = 'x') SELECT count(*) FROM x") == [(1,)]
    assert run("SELECT a FROM t WHERE a = (SELECT max(a) FROM t) OR b LIKE 'x%'") == [(1,), (2,)]
    assert sql_surface.tables_of(spark, "WITH x AS (SELECT 1) SELECT * FROM x JOIN T USING (a) WHERE EXISTS (SELECT 1 FROM u)") == {"t", "u"}
    assert sql_surface.describe(t).count() == 4
    assert json.loads(sql_surface.sample_rows(t, 1, ["a"]).first()[0]) == {"a": 1, "b": "x", "tenant_id": 7, "deleted_at": None}
    assert not spark.catalog.tableExists("t") and not [v for v in spark.sql("SHOW VIEWS IN global_temp").collect() if v.viewName.startswith("quern_")]
    said = sql_surface.statement(spark, "SELECT a, upper(b) FROM t JOIN u USING (a) WHERE t.c > 1 AND d LIKE 'x%'")
    assert said["is_select"] and said["tables"] == ["t", "u"] and len(said["columns"]) == 2 and said["where_columns"] == ["d", "t.c"] and "LIKE" in said["where"]


def test_files(spark, tmp_path):
    assert files.header_labels(["a", "a", None, " ", "a"]) == ["a", "a_1", "C", "D", "a_2"]
    (tmp_path / "X.CSV").write_text("col1,col2\n1,x\n2,y\n")
    assert files.read_csv(spark, str(tmp_path)).dtypes == [("col1", "int"), ("col2", "string")]
    assert files.read_texts(spark, str(tmp_path)).first().extension == "csv"


def test_html():
    title, text, links = html.to_markdown("<html><head><title>T &amp; x</title><style>p{}</style></head><body><script>no()</script><h2>Head</h2><p>a <b>b</b> <a href='/u'>c</a></p><ul><li>one<li>two</ul>")
    assert title == "T & x" and "## Head" in text and "a **b** [c](/u)" in text and "- one" in text and "no()" not in text and links == ["/u"]
    assert html.to_markdown(None) == ("", "", [])
    rich = html.to_markdown("<ol><li>a<li>b<ul><li>c</ul></ol><pre>x  y\n  z</pre><table><tr><th>h|<th>k</tr><tr><td>1</tr></table><img src=u.png alt=A><hr><blockquote>q <em>e</em></blockquote>", {"u.png": "i/1.png"})[1]
    for part in ("1. a", "2. b", "  - c", "```\nx  y\n  z\n```", "| h\\| | k |\n| --- | --- |\n| 1 |  |", "![A](i/1.png)", "---", "> q *e*"):
        assert part in rich, (part, rich)
    assert html.article_markdown("<title>T</title><nav>menu</nav><main><p>Body</p></main>") == "Body"
    assert html.article_markdown("<title>T</title><p>" + "seen " * 20) == "# T\n\n" + ("seen " * 20).strip() and html.article_markdown("<p>few") is None


def test_html_references_need_their_semicolon(spark):
    assert html.to_markdown("<title>a &amp;&am</title><p>x &amp; y &amp</p><a href='/?a=1&copy=2'>l</a>") == ("a &&am", "x & y &amp\n[l](/?a=1&copy=2)", ["/?a=1&copy=2"])
    made = html.pages_to_markdown(spark.createDataFrame([(1, "<title> a &amp;&am</title>b"), (2, None)], "page_id long, html string"))
    assert sorted((r.page_id, r.title, r.raw_title) for r in made.collect()) == [(1, "a &&am", "a &amp;&am"), (2, "", "")]


def test_first_by_signature_without_texts(spark):
    rows = [(1, 1, "s", "x", 1), (1, 1, "s", "x", 5), (1, 2, "s", "x", 2), (1, 3, "t", "x", 3), (1, 4, "s", None, 4), (1, 5, "s", None, 6)]
    hits = spark.createDataFrame(rows, "query_id int, doc_id int, source string, signature string, rank int")
    made = rerank.first_by_id_and_signature(hits, signature=F.col("signature"))
    assert sorted((r.doc_id, r["rank"]) for r in made.collect()) == [(1, 1), (3, 3), (4, 4), (5, 6)]


def test_fetched_pages_are_cut_before_a_character(spark):
    results = spark.createDataFrame([(1, "u", 1.0, "said")], "query_id int, url string, score double, content string")
    pages = spark.createDataFrame([("u", "<article>" + "ä" * 60 + "</article>")], "url string, html string")
    assert html.with_fetched(results, pages, size=101).first().content == "said\n\n" + "ä" * 50


def test_wiki_boost_ranks_by_rounded_scores(spark):
    """0.9 * 1.3 is a little more than 1.17 in doubles: both count as equal, and the old rank decides."""
    hits = spark.createDataFrame([(1, 1, 13.0, 1, False), (1, 2, 1.17, 2, False), (1, 3, 10.0, 3, True), (1, 4, 0.9, 4, True)], "query_id int, doc_id int, score double, rank int, wiki boolean")
    made = rerank.wiki_boost(hits, F.col("wiki")).collect()
    assert sorted((r["rank"], r.doc_id, r.score) for r in made) == [(1, 1, 13.0), (2, 3, 13.0), (3, 2, 1.17), (4, 4, 1.17)]


def test_feed(spark, tmp_path):
    folder, out, at = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "at")
    folder.mkdir()
    (folder / "1.json").write_text('{"guid": "a", "title": "A", "updated": "1"}\n{"guid": " ", "link": "l", "title": "B", "updated": "1"}\n')
    assert {r.item_id for r in feed.read_feed(spark, str(folder)).collect()} == {"a", "l"}
    fetch = lambda: ingest.ingest(spark, feed.stream_feed(spark, str(folder)), out, at, "item_id", "updated")
    fetch()
    (folder / "2.json").write_text('{"guid": "a", "title": "A2", "updated": "2"}\n{"title": "C", "updated": "2"}\n')
    fetch()
    assert {(r.item_id, r.title) for r in ingest.merged(spark, out).collect()} == {("a", "A2"), ("l", "B"), ("C", "C")}


def test_merging_again_and_parts(spark, tmp_path):
    """A batch that runs again gives the same; only touched parts get a version; old ones can go."""
    out = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, at long, v string")
    merge = ingest.merge_into(out, "k", "at", parts=8)
    read = lambda: {(r.k, r.v) for r in ingest.merged(spark, out).collect()}
    merge(rows(*[(k, 1, "old") for k in range(40)]), 0)
    before = dict(ingest._newest(spark, out))
    for _ in range(2):
        merge(rows((3, 2, "new"), (3, 0, "late"), (None, 5, "no key")), 1)
        assert read() == {(k, "new" if k == 3 else "old") for k in range(40)}
    after = dict(ingest._newest(spark, out))
    assert sum(before[p] != v for p, v in after.items()) == 1 and len(after) == 8
    merge(rows((3, 1, "older")), 2)
    merge(rows((50, 1, "more")), 3)
    assert read() == {(k, "new" if k == 3 else "old") for k in range(40)} | {(50, "more")}
    assert ingest.compact(spark, out) >= 2 and read() == {(k, "new" if k == 3 else "old") for k in range(40)} | {(50, "more")}


def test_rate_limit_stream(spark, tmp_path):
    source, rng = str(tmp_path / "in"), random.Random(1)
    rows = [(k, rng.choice("ab"), t) for k, t in enumerate(sorted(rng.randrange(60_000) for _ in range(200)))]
    spark.createDataFrame(rows, "event_id long, user string, at_ms long").coalesce(1).write.parquet(source)
    stream = absence.rate_limit(spark.readStream.schema("event_id long, user string, at_ms long").parquet(source), "user", 3, 5)
    absence.run_until_now(stream, str(tmp_path / "out"), str(tmp_path / "at"))
    want, recent = {}, {"a": [], "b": []}
    for k, user, t in rows:
        recent[user] = [x for x in recent[user] if x > t - 5000]
        want[k] = len(recent[user]) < 3
        if want[k]:
            recent[user].append(t)
    assert {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_absences_late_and_back(spark, tmp_path):
    """Items that come back, sightings that come late, and state that is forgotten, over several runs."""
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "at"))
    hour = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    batches = [
        [("stays", 0), ("stays", 20), ("goes", 0), ("late", 0), ("edge", 0)], [("stays", 40), ("edge", 24)], [("late", 22), ("stays", 41)],
        [("stays", 64), ("goes", 63), (None, 60)], [("stays", 86), ("edge", 1)], [("stays", 800)], [("stays", 801)], [("goes", 802)],
    ]
    for batch in batches:
        values = ", ".join(f"({'NULL' if k is None else repr(k)}, timestamp'{hour(h) if h < 700 else '2024-02-0%d 00:00:00' % (h - 797)}')" for k, h in batch)
        spark.sql(f"SELECT * FROM VALUES {values} t(item, at)").selectExpr("CAST(item AS string) item", "at").coalesce(1).write.mode("append").parquet(source)
        absence.run_until_now(absence.absences(spark.readStream.schema("item string, at timestamp").parquet(source), "item", "at", delay="20 hours", forget_days=5), out, mark)
    got = sorted((r.item, r.change, r.at_ms // absence.HOUR - 473352) for r in spark.read.parquet(out).collect())
    day = lambda d: (d - 1) * 24
    assert [g for g in got if g[0] == "late"] == [("late", "absent", 46)]  # not before: the sighting at 22 came late, but in time
    assert [g for g in got if g[0] == "edge"] == [("edge", "absent", 48)]  # seen again exactly after the grace
    assert [g for g in got if g[0] == "goes"][:3] == [("goes", "absent", 24), ("goes", "absent", 87), ("goes", "back", 63)]
    assert [g for g in got if g[0] == "stays"] == [("stays", "absent", 110), ("stays", "back", day(34))]
    assert len([g for g in got if g[0] == "goes"]) == 3  # forgotten by then: it is new, not back


def test_new_items_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 01:00:00'), ('b', timestamp'2024-01-01 02:00:00') t(item, at)").coalesce(1).write.parquet(source)
    stream = ingest.new_items(spark.readStream.schema("item string, at timestamp").parquet(source), "item", "at")
    stream.writeStream.format("memory").queryName("items").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.item for r in spark.table("items").collect()) == ["a", "b"]


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "_quern_x int, _QUERN_Y int")
    assert fresh(df, "x", "y", "x") == ["_quern_x_", "_quern_y_", "_quern_x__"]


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_without(spark, monkeypatch, most):
    """By broadcast and by the filter, with nulls in either, both or none."""
    monkeypatch.setattr(relations, "MAP_SIDE", most)
    rng = random.Random(most)
    ids = [rng.randrange(500) for _ in range(800)] + [None, None]
    rows = spark.createDataFrame([(i, "x" * 50) for i in ids], "doc_id long, _quern_key string")
    for gone in (set(rng.sample(range(600), 200)), {None, *rng.sample(range(600), 100)}, {None}, set()):
        lost = spark.createDataFrame([(i,) for i in gone for _ in range(2)], "doc_id long")
        kept = relations.without(rows, lost, "doc_id")
        assert kept.columns == rows.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in ids if i not in gone)


def test_probably_among_loses_none(spark):
    rows = spark.createDataFrame([(f"k{k}",) for k in range(3000)] + [(None,)], "_quern_value string")
    values = spark.createDataFrame([(f"k{k}",) for k in range(0, 3000, 30)], "key string")
    got = {r[0] for r in relations.probably_among(rows, values, "_quern_value").collect()}
    assert {f"k{k}" for k in range(0, 3000, 30)} <= got and len(got) < 130 and None not in got


def test_scratch_tables_go(spark):
    import os

    from quern.session import materialise, scratch

    kept = materialise(spark.range(3), "kept")
    with scratch():
        inner = materialise(spark.range(4), "inner")
        assert inner.count() == 4
    assert os.path.isdir(kept._quern_path) and not os.path.exists(inner._quern_path)


def _zip(**parts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, body in parts.items():
            file.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def _workbook():
    rels = "<Relationships><Relationship Id='r1' Target='worksheets/sheet1.xml'/><Relationship Id='r2' Target='/xl/worksheets/sheet2.xml'/></Relationships>"
    book = "<workbook xmlns:r='urn:r'><sheets><sheet name=\"Q1'24\" r:id='r1'/><sheet name='Stock' r:id='r2'/></sheets></workbook>"
    one = (
        "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>0</v></c></row><row><c r='A2' t='inlineStr'><is><t>north</t></is></c><c r='B2'><v>5</v></c></row>"
        "<row><c r='B3' t='b'><v>1</v></c></row></sheetData><mergeCells><mergeCell ref='A2:A3'/></mergeCells></worksheet>"
    )
    two = "<worksheet><sheetData><row><c r='A1' t='inlineStr'><is><t>sku</t></is></c></row><row><c r='A3' t='str'><v>x-1</v></c></row><row><c r='A4' t='str'><v>=DISPIMG(1)</v></c></row></sheetData></worksheet>"
    return _zip(**{"xl__workbook_dot_xml": book, "xl___rels__workbook_dot_xml_dot_rels": rels, "xl__sharedStrings_dot_xml": "<sst><si><t>area</t></si></sst>", "xl__worksheets__sheet1_dot_xml": one, "xl__worksheets__sheet2_dot_xml": two})


def test_documents(spark, tmp_path):
    word = "<w:document xmlns:w='urn:w'><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t><w:t>words</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    package = "<package><manifest><item id='i1' href='one.xhtml'/><item id='i2' href='two.xhtml'/></manifest><spine><itemref idref='i2'/><itemref idref='i1'/></spine></package>"
    epub = _zip(**{"META-INF__container_dot_xml": "<container><rootfiles><rootfile full-path='OPS/p.opf'/></rootfiles></container>", "OPS__p_dot_opf": package, "OPS__one_dot_xhtml": "<h1>One</h1>", "OPS__two_dot_xhtml": "<p>Two</p>"})
    files_ = {"a.MD": b"# hi", "b.docx": _zip(**{"word__document_dot_xml": word}), "c.epub": epub, "d.xlsx": _workbook(), "e.html": b"<title>T</title><p>body</p>", "f.bin": b"\x00", "g.docx": b"broken", "h.txt": b"\xff ok", "i.mht": b"no archive, <b>text</b>"}
    for name, content in files_.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.MD"].markdown == "# hi" and got["b.docx"].markdown.startswith("# Top\n\nSome words\n\n| a |") and got["c.epub"].markdown == "Two\n\n# One" and got["e.html"].markdown == "# T\n\nbody"
    assert got["d.xlsx"].markdown == "## Q1'24\n\narea: north,area_1: 5\narea: north,area_1: true\n\n## Stock\n\nsku: x-1"
    assert "no parser" in got["f.bin"].error and got["g.docx"].error and got["g.docx"].markdown is None and got["h.txt"].markdown.endswith("ok") and "text" in got["i.mht"].markdown
    rows = documents.read_workbooks(spark, str(tmp_path / "d.xlsx")).orderBy("__sheet_name", "row").collect()
    assert [(r["__sheet_name"], r["row"], r["values"]) for r in rows][:2] == [("Q1'24", 2, {"area": "north", "area_1": "5"}), ("Q1'24", 3, {"area": "north", "area_1": "true"})]


def test_repaired_json():
    for text, want, broken in [
        ('{"a": 1,}', {"a": 1}, False), ('{"a": [1, 2,], "b": "x"}', {"a": [1, 2], "b": "x"}, False), (r'{"p": "\d+\.log$"}', {"p": r"\d+\.log$"}, False), ('{"a": 1}""', {"a": 1}, False), ('{"a": 1}{"a": 2}', {"a": 1}, False),
        ('"a": 1', {"a": 1}, False), ('{"a": "half', {"a": "half"}, True), ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}, True), ('{"a": [1}', {"a": [1]}, False), ("", {}, False), ('{"a": "b \\" c, }"}', {"a": 'b " c, }'}, False), ('{"a": "x\\\\"}', {"a": "x\\"}, False),
    ]:
        made, flag = prepare.repair_json(text)
        assert json.loads(made) == want and flag == broken, text
    assert prepare.repair_json("just words") == ("just words", False)
    rng = random.Random(1)
    for _ in range(300):  # what is whole stays
        value = {rng.choice("ab{,"): rng.choice([1, "x}", [1, {"k": "\\"}], {"z": ['"', ","]}]) for _ in range(3)}
        assert json.loads(prepare.repair_json(json.dumps(value))[0]) == value


@pytest.mark.parametrize("rest", [1_000_000, 3])
def test_clusters_are_the_greedy_ones(spark, rest):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice("xy"), k, " ".join(rng.choice("pqrst") for _ in range(4)), [rng.random(), rng.random()] if k % 3 else None) for k in range(80)]
    rows += [("c", "x", 100 + k, " ".join(f"w{j}" for j in range(k, k + 8)), None) for k in range(20)]  # a chain, each like the next
    rows += [("c", "x", 200 + k, rng.choice(["same words", "", "!"]), rng.choice([None, [1.0, 0.0]])) for k in range(20)]  # copies
    df = spark.createDataFrame(rows, "owner string, kind string, item_id long, text string, vector array<double>")
    made = clusters.clusters(df, rest=rest).collect()
    got = {(r.item_id, r.seed) for r in made}
    assert len(made) == len(got) and clusters.clusters(df.limit(0)).count() == 0
    want = set()
    for key in {r[:2] for r in rows}:
        own, taken = [r for r in rows if r[:2] == key], set()
        for n, a in enumerate(own):
            if a[2] in taken:
                continue
            same = []
            for b in own[n + 1 :]:
                x, y = set(re.findall(r"\w+", a[3])), set(re.findall(r"\w+", b[3]))
                near = a[4] and b[4] and sum(p * q for p, q in zip(a[4], b[4])) / (sum(p * p for p in a[4]) * sum(q * q for q in b[4])) ** 0.5 >= 0.86
                if b[2] not in taken and (len(x & y) / max(1, len(x | y)) >= 0.55 or near):
                    same.append(b[2])
            if same:
                taken |= {a[2], *same}
                want |= {(i, a[2]) for i in (a[2], *same)}
    assert got == want


def test_sampled_set(spark):
    qrels = spark.createDataFrame([(q, q * 10 + k) for q in range(20) for k in range(q % 5)], "query_id long, pid long")
    queries, corpus = spark.range(20).toDF("query_id"), spark.range(500).toDF("pid")
    chosen, kept = relations.sampled_set(queries, qrels, corpus, 3)
    assert {r.query_id for r in chosen.collect()} == {4, 9, 14}
    pids = {r.pid for r in kept.collect()}
    assert {q * 10 + k for q in (4, 9, 14) for k in range(4)} <= pids and 60 < len(pids) < 160


def test_deepening_stops(spark):
    assert faq.depths(10) == [30, 60, 120, 240, 480] and faq.depths(100) == [300, 500] and faq.depths(3) == [9, 18, 36, 72, 144]


def test_vector_index_finds_most(spark):
    """Every row is in a list; recall against brute force; hopeless vectors are passed over."""
    from quern.plans import retrieval_queries
    from tests.conftest import SF

    sf = SF.replace("0.001", "0.1")
    got = {(r.query_id, r.vec_id) for r in retrieval_queries.vector_index_search(spark, sf).collect()}
    want = {(r.query_id, r.vec_id) for r in retrieval_queries.vector_search_cosine(spark, sf).collect()}
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def test_vector_index_is_exact_with_all_lists(spark, tmp_path):
    from quern.operators import vector_index

    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(300)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 4), (903, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    centres = vector_index.fit(vectors, 10)
    built = vector_index.build(vectors, centres, str(tmp_path / "v"))
    assert built.count() == len(rows) and built.filter("list IS NULL").count() == 3 and len(centres) == 10
    asked = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(20)], "query_id long, vector array<float>")
    run = lambda df: sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in df.collect())
    assert run(vector_index.search(built, centres, asked, 7, 10)) == run(retrieval.vector_search(vectors, asked, 7))
    assert vector_index.search(built, centres, asked.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,clean",
    [
        ("plain words", "plain words"), ("a ![alt](http://x/i.png) b", "a  b"), ("see [the docs](https://d.x) there", "see the docs there"), ("go https://e.x/p?q=1&b=2 now", "go  now"),
        ("code:\n```python\nprint('x')\n```\nend", "code:\nprint('x')\nend"), ("so $$E=mc^2$$ is", "so E=mc^2 is"), ("| n | v |\n| --- | --- |\n| A | 1 |", "n, v\n\nA, 1"),
        ("## Two\n### 2.1 More", "Two\n2.1 More"), ("> a quote\n> goes on", "a quote\ngoes on"), ("is **bold** and *slanted* and ***both*** so", "is bold and slanted and both so"),
        ("- one\n- two\n1. three\n2. four", "one\ntwo\nthree\nfour"), ('a<br>b<div class="t">c</div>d', "abcd"), ("one\n\n\n\n\ntwo", "one\n\ntwo"), ("| --- | --- |", ""), ("  \n\n ", ""), (None, None),
        ("[![i](a.png)](http://x) **a *b* c** *** 2 * 3", "a b c *** 2 * 3"), ("[w](http://en.x/A_(b)) and `code`", "w and `code`"), ("> - [ ] item", "[ ] item"),
    ],
)
def test_clean_passage(spark, text, clean):
    from quern.functions import prepare

    assert spark.createDataFrame([(text,)], "t string").select(prepare.clean_passage(F.col("t"))).first()[0] == clean


def test_code_query(spark):
    from quern.functions import text as T

    asked = ["如何查询用户预约记录", "how to update the record", "find `demo.PushScheduleMapper#selectById` now", "find_by_reservation_id", "src/main/java/demo/UserMapper.xml.", 'the "order" of it', "UserMapper.findById " + "VeryLongIdentifier_" * 80, None]
    got = [r.c for r in spark.createDataFrame(list(enumerate(asked)), "k int, q string").orderBy("k").select(T.code_query(F.col("q")).alias("c")).collect()]
    assert not got[0]["identifiers"] and not got[1]["identifiers"] and not got[1]["terms"]
    assert got[2]["identifiers"] == ["demo.PushScheduleMapper#selectById"] and {"push", "schedule", "mapper", "select", "by", "id", "demo"} <= set(got[2]["terms"])
    assert got[3]["identifiers"] == ["find_by_reservation_id"] and {"find", "by", "reservation", "id"} <= set(got[3]["terms"])
    assert got[4]["identifiers"] == ["src/main/java/demo/UserMapper.xml"] and {"src", "main", "java", "demo", "user", "mapper", "xml"} <= set(got[4]["terms"])
    assert got[5]["identifiers"] == ["order"] and len(got[6]["identifiers"]) <= 8 and len(got[6]["terms"]) <= 32


def test_overlaps_that_places_promise():
    overlap = "shared boundary text"
    assert stitch.append_exact("before " + overlap, overlap + " after", len(overlap)) == "before " + overlap + " after"
    row = "| cell | cell |\n"
    assert stitch.append_exact("intro\n" + row + row, row * 3 + "end\n", 0) == "intro\n" + row * 5 + "end\n"
    assert stitch.append_exact("abcdefghijkl", "XYZdefghijkl", 6) is None and stitch.append_exact("short", "shorter", 99) is None and stitch.append_exact("short", "shorter", -1) is None
    assert stitch.append_searched("abcdefghijklmnopqrstuvwxyz0123", "klmnopqrstuvwxyz0123ABCDEFG", 20) == "abcdefghijklmnopqrstuvwxyz0123ABCDEFG"
    head, rows = "| c1 | c2 |\n|:---|:---|\n", "| r5 | content 5 |\n| r6 | content 6 |\n"
    assert stitch.append_searched(head + "| r4 | x |\n" + rows, head + rows + "| r7 | y |\n", len(rows)) == head + "| r4 | x |\n" + rows + "| r7 | y |\n"
    assert stitch.append_searched("a sentence said twice. ", "Now: a sentence said twice. And more", 10).endswith("twice. Now: a sentence said twice. And more")
    assert stitch.join_texts("prefix complete current body suffix", "complete current body") == "prefix complete current body suffix"


def test_keyword_index(spark, tmp_path, monkeypatch):
    """Equal to the scan, over additions, with fewer postings read than there are for its words."""
    from quern.operators import keyword_index

    monkeypatch.setattr(keyword_index, "SEGMENT", 16)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    text = lambda: " ".join(words[min(int(rng.paretovariate(0.6)) - 1, 399)] for _ in range(rng.randrange(0, 60)))
    docs = [(k, text()) for k in range(1500)] + [(2000, None), (2001, ""), (2002, "漢字 w5"), (2003, "w5 " * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w5 w17 w220"), (2, "w390 w0"), (3, "none of them"), (4, None), (5, "漢字"), (6, "w0 w1 w2 w3 w150 w151")], "query_id long, query string")
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "i"), folders=4).add(df.filter("doc_id < 700"))
    rows = lambda out: sorted(map(tuple, out.collect()))
    assert rows(index.search(asked, 5)) == rows(retrieval.bm25(df.filter("doc_id < 700"), asked, 5))
    index.add(df.filter("doc_id >= 700"))
    got, want = rows(index.search(asked, 7)), rows(retrieval.bm25(df, asked, 7))
    assert got == want and {r[0] for r in got} == {1, 2, 5, 6}
    rare = spark.createDataFrame([(1, "w1 w2 w150 w260 w333")], "query_id long, query string")
    assert rows(index.search(rare, 5)) == rows(retrieval.bm25(df, rare, 5)) and 0 < index.blocks_read < 0.7 * index.blocks_asked
    none = keyword_index.KeywordIndex(spark, str(tmp_path / "n")).add(df.limit(0))
    assert rows(none.search(asked, 5)) == []


def test_vector_graph(spark):
    """Every row is indexed, degrees are bounded, and nearly all true neighbours are found; copies, odd vectors and an empty table."""
    from quern.operators import vector_graph

    rng = np.random.default_rng(12)
    base = rng.normal(size=(600, 24))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)] + [(1000 + k, [float(x) for x in base[7] * 2]) for k in range(200)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (None, [1.0] * 24), (2004, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    graph = vector_graph.build(df)
    assert {r.vec_id for r in graph.members.collect()} == {*range(600), *range(1000, 1200), 2004}
    assert max(len(r.links) for r in graph.nodes.collect()) <= vector_graph.DEGREE
    asked = df.filter("vec_id % 20 = 0 AND vec_id < 600 OR vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(r.query_id, r.vec_id) for r in vector_graph.search(graph, asked, 10, 200).collect()}
    want = {(r.query_id, r.vec_id) for r in retrieval.vector_search(df.filter("vec_id < 2000"), asked, 10, threshold=-1.0).collect()}
    assert len(got & want) >= 0.95 * len(want) and {v for q, v in got if q == 7} == {7, *range(1000, 1009)}
    assert vector_graph.search(vector_graph.build(df.limit(0)), asked).count() == 0


# --- drives ---


def test_drive(spark, tmp_path):
    """List, whole and incremental fetches; restarts; what attempts disagree upon comes again; vanished folders; odd keys."""
    from quern.sources.drive import Bucket, Drive, DriveStreamReader

    spark.dataSource.register(Drive)
    root, state, out, mark = (str(tmp_path / n) for n in ("root", "state", "out", "mark"))
    put = lambda *rows: spark.createDataFrame(list(rows), "text string, item_id string, more int").write.format("drive").mode("append").option("path", root).save()
    read = lambda **o: spark.read.format("drive").options(path=root, buckets=3, **o).load()
    assert read().count() == 0  # no such folder
    put(("a", "x/1/a.txt", 1), ("", "x/1/deep/er/b.txt", 1), ("c", "x/c.txt", 1), ("d", "d.txt", 1), ("é\0", "y/2/e e.txt", 1))
    assert {(r.item_id, r.text) for r in read().collect()} == {("x/1/a.txt", "a"), ("x/1/deep/er/b.txt", ""), ("x/c.txt", "c"), ("d.txt", "d"), ("y/2/e e.txt", "é\0")}
    assert {r.text for r in read(contents=False).collect()} == {None} and read(contents=False).count() == 5
    for bad in ("../z", "/abs", "a//b", "", None, "a/"):
        with pytest.raises(Exception, match="not a path below"):
            put(("t", bad, 1))

    def fetch(**options):
        stream = spark.readStream.format("drive").options(**({"path": root, "state": state, "buckets": 3} | options)).load()
        before = spark.read.parquet(out).count() if (tmp_path / "out").exists() else 0
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out)
        last = rows.agg({"scan": "max"}).first()[0]
        return {(r.item_id, r.gone, r.text) for r in rows.filter(rows.scan == last).collect()} if rows.count() > before else set()

    assert len(fetch()) == 5 and fetch() == set()
    put(("a2", "x/1/a.txt", 1), (None, "d.txt", 1), (None, "never/was.txt", 1), ("new", "z/9/n.txt", 1))
    shutil.rmtree(tmp_path / "root" / "y")
    assert fetch() == {("x/1/a.txt", False, "a2"), ("d.txt", True, None), ("y/2/e e.txt", True, None), ("z/9/n.txt", False, "new")}
    assert fetch() == set()
    with pytest.raises(Exception, match="buckets"):
        fetch(buckets=4)
    with pytest.raises(Exception, match="state"):
        spark.readStream.format("drive").option("path", root).load().writeStream.format("noop").option("checkpointLocation", f"{mark}2").trigger(availableNow=True).start().awaitTermination()

    # two attempts of one task, between which an item changes, one comes and one goes
    reader = DriveStreamReader({"path": root, "state": f"{state}2", "buckets": "1"})
    folders = reader.folders.dealt()[0]
    first = list(reader.read(Bucket(0, folders, 0, 1)))
    put(("a3", "x/1/a.txt", 1), ("q", "q.txt", 1), (None, "x/c.txt", 1))
    second = list(reader.read(Bucket(0, reader.folders.dealt()[0], 0, 1)))
    again = {(r[0], r[3]) for r in reader.read(Bucket(0, reader.folders.dealt()[0], 1, 2))}
    assert len(first) == len(second) == 4 and again == {("x/1/a.txt", False), ("q.txt", False), ("x/c.txt", True)}
    reader.commit(reader._offset(2))
    assert reader._scans() == [2] and reader.latestOffset()["scan"] > 2
    with pytest.raises(FileNotFoundError, match="no snapshot"):
        list(reader.read(Bucket(0, folders, 1, 3)))


# --- code ---


def plain_code_state(text, mark):
    """Of every character, by a machine that goes sign by sign: depth before it, and whether it is within a string or comment."""
    out, depth, quote, k = [], 0, "", 0
    while k < len(text):
        step = 1
        if quote in ("line", "block"):
            inside, ends = True, text[k] == "\n" if quote == "line" else text.startswith("*/", k)
            if ends:
                inside, step, quote = quote == "block", 2 if quote == "block" else 1, ""
        elif quote:
            inside = True
            if text[k] == "\\" and k + 1 < len(text) and (quote == "`" or text[k + 1] != "\n"):
                step = 2
            elif text[k] == quote:
                quote = ""
            elif text[k] == "\n" and quote != "`":
                quote, inside = "", False
        elif text.startswith(mark, k):
            quote, inside = "line", True
        elif text.startswith("/*", k):
            quote, inside, step = "block", True, 2
        else:
            inside = text[k] in "\"'`"
            quote = text[k] if inside else ""
        for j in range(step):
            out.append((depth, inside, quote))
        if not inside:
            depth = depth + 1 if text[k] in "([{" else max(0, depth - 1) if text[k] in ")]}" else depth
        k += step
    return out


@given(st.text(st.sampled_from("ab{}()\"'`/*\\\n \n"), max_size=120), st.integers(1, 40))
@settings(max_examples=400, deadline=None)
def test_code_against_plain(text, size):
    """Points and their depths as a machine that goes sign by sign has them; pieces tile the text, and end
    at the best point in reach."""
    at, _ = code_chunks.scan(text, "braces")
    state = plain_code_state(text, "//")
    lines, place = [], 0
    for k, c in enumerate(text):
        if c == "\n" and not state[k][1]:
            own = text[place : k + 1]
            if own.strip():
                lines.append([k + 1, state[k][0]])
            elif lines and lines[-1][0] == place:
                lines[-1][0] = k + 1
            place = k + 1
    assert [(p[0], p[1]) for p in at] == [tuple(x) for x in lines if x[0] < len(text)]
    pieces = code_chunks.split_code(text, size)
    assert "".join(text[a:b] for a, b, _, _ in pieces) == text and all(0 < b - a <= size for a, b, _, _ in pieces)
    for a, b, balanced, forced in pieces:
        near = [p for p in at if a < p[0] <= a + size]
        if b < len(text):
            assert forced == (not near) and (forced or all((p[3], p[1], p[2], -p[0]) >= next((q[3], q[1], q[2], -q[0]) for q in near if q[0] == b) for p in near))
        signs = "".join(c for k, c in enumerate(text[a:b], a) if c in "()[]{}" and not state[k][1])
        while signs != (less := signs.replace("()", "").replace("{}", "").replace("[]", "")):
            signs = less
        assert not balanced or not signs


def test_code_families(spark):
    py = '@mark\ndef f(a):\n    """(\n    """\n    if a:\n        return (1,\n            2)\n    return 3\n\n\n# note\ndef g():\n    pass\n'
    texts = lambda text, size, kind: [text[a:b] for a, b, _, _ in code_chunks.split_code(text, size, kind)]
    assert texts(py, 100, "indent") == [py[: py.index("# note")], py[py.index("# note") :]]
    assert texts(py, 70, "indent")[0] == py[: py.index("    if a")]
    rust = "fn f<'a>(x: &'a str) {\n  g('{', \"}\n\");\n}\nfn h() {\n}\n"
    assert texts(rust, 46, "signs") == ["fn f<'a>(x: &'a str) {\n  g('{', \"}\n\");\n}\n", "fn h() {\n}\n"]
    sql = "SELECT 'it''s (' -- (\n;\nSELECT ( /* ) */ 1\n);\n"
    assert texts(sql, 30, "sql") == [sql[: sql.index("SELECT (")], sql[sql.index("SELECT (") :]]
    rows = [("a.py", py), ("b.JS", "x(\r\n1)\r\n"), ("c", None), (None, "y;\n"), ("e.go", ""), ("f.c", "z" * 50_000)]
    made = code_chunks.chunk_code(spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 AS chunk_index", "'e' AS ext", "2 AS _id"), 1000).collect()
    assert {(r.path, r.first_line, r.last_line, r.balanced) for r in made if r.path not in ("f.c",)} == {("a.py", 1, 13, True), ("b.JS", 1, 2, True), (None, 1, 1, True)}
    assert sum(len(r.content) for r in made if r.path == "f.c") == 50_000 and {(r.balanced, r.forced) for r in made if r.path == "f.c"} <= {(False, True), (False, False)}


def test_table_functions(spark):
    """Splitters in one SELECT give the chunks that they give to DataFrames; others can't be called."""
    text = "# A\n\n" + "words of it. " * 80 + "\r\n## B\n\n" + "more of it. " * 60 + "\n## C\n\nend\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    for tier in chunking.SPLITTERS:
        got = sql_surface.run(spark, f"SELECT d.id, c.start_at, c.end_at, c.context, c.content FROM docs d, LATERAL split_{tier}(d.text, 300, 50) c WHERE c.end_at > d.id", {"docs": docs}, functions=TABLE_FUNCTIONS)
        want = chunking.split_documents(docs, 300, 50, "id", tier=tier).select("doc_id", "start_at", "end_at", "context", "content")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 3
    got = sql_surface.run(spark, "SELECT c.balanced, count(*) AS n FROM docs, LATERAL split_code(text, 100, 'js') c GROUP BY ALL", {"docs": docs}, functions=TABLE_FUNCTIONS)
    assert got.count()
    for sql in ("SELECT * FROM range(5)", "SELECT * FROM docs, LATERAL explode(array(1))", "SELECT * FROM split_recursive((SELECT max(text) FROM other), 5, 1)", "SELECT * FROM docs, LATERAL (SELECT * FROM secret)"):
        with pytest.raises(sql_surface.SqlRejected):
            sql_surface.check(spark, sql, {"docs"}, TABLE_FUNCTIONS)


def test_enriched(spark):
    """The best hit that names a chunk counts; nulls, chunks that aren't there, and hits aren't named."""
    chunks = spark.createDataFrame(
        [(1, "text", 9, [3, None, 77], 2, None, "x"), (2, "text", 9, None, 3, 1, "x"), (3, "image", None, [1, 4], 4, 2, "x"), (4, "text", None, [], None, 3, None), (9, "parent_text", None, None, None, None, "x")],
        "chunk_id int, kind string, parent_id int, related array<int>, after_id int, before_id int, score string",
    )
    hits = spark.createDataFrame([("q", 1, 2, 0.5), ("q", 2, 1, 0.9), ("r", 3, 1, 0.4), ("s", 50, 1, 1.0)], "query_id string, chunk_id int, rank int, score double")
    chunks = chunks.drop("score")
    assert {tuple(r) for r in relations.enriched(hits, chunks).collect()} == {
        ("q", 1, "hit", 0.5), ("q", 2, "hit", 0.9), ("q", 9, "parent", 0.9), ("q", 3, "near", 0.0), ("r", 3, "hit", 0.4), ("r", 1, "related", 0.0), ("r", 4, "related", 0.0),
    }
    assert relations.enriched(hits.limit(0), chunks).count() == 0


def test_images_shown(spark):
    images = json.dumps([{"url": "a.png", "caption": "A"}, {"url": "x", "original_url": "b.png"}, {"url": "c.png"}, {"ocr": "none"}])
    content = 'é ![t](a.png "title") <img width=1 SRC=\'b.png\'> c.png [l](c.png)'
    rows = [(images, content, 10, 0, 999), (images, content, 10, 12, 32), (images, content, 10, 33, 99), (images, content, 10, 99, 120), ("no list", content, 0, 0, 99), (None, content, 0, 0, 99), (images, None, 0, 0, 9), (images, "", 0, 0, 9)]
    df = spark.createDataFrame(rows, "images string, content string, start int, a int, z int")
    made = df.select(stitch.images_in_range(*map(F.col, df.columns)).alias("i"), stitch.within_range(*map(F.col, df.columns[1:])).alias("part")).collect()
    urls = [[i.get("original_url") or i["url"] for i in json.loads(r.i)] if r.i else None for r in made]
    assert urls == [["a.png", "b.png"], ["a.png"], None, None, None, None, None, None]
    assert [r.part for r in made] == [content, content[2:22], content[23:], "", content, content, None, ""]


def test_merged_parts_split(spark, tmp_path):
    """Parts over their size become two, again and again; a batch that runs again, late rows and compact() change nothing."""
    out, want = str(tmp_path / "t"), {}
    merge = ingest.merge_into(out, "k", "at", parts=2, part_bytes=1)
    read = lambda: {r.k: r.v for r in ingest.merged(spark, out).collect()}
    for number in range(5):
        rows = [(k, number, f"{k} {number}") for k in range(number * 7, 40, number + 1)]
        want |= {k: v for k, _, v in rows}
        batch = spark.createDataFrame([*rows, (0, -1, "late")], "k long, at long, v string")
        for _ in range(1 + number % 2):
            merge(batch, number)
        assert read() == want and ingest.merged(spark, out).count() == len(want)
        parts = [p for p, _ in ingest._current(spark, out)]
        assert max(parts) // ingest._LEVEL == number and (number == 0 or len(parts) > 2)
        if number == 2:
            assert ingest.compact(spark, out) > 0 and read() == want
