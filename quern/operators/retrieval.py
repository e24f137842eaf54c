"""Retrieval: filters, keyword and vector search for sets of queries, score fusion."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.session import discard, materialise, spread

K1, B = 1.2, 0.75
BLOCK = 4096  # query vectors that one pass over the index broadcasts
SCORES = 1 << 21  # scores that a task holds at once
GROUP = 20_000  # keyword queries whose words one scan of the texts counts
SCORED, SLICE = 256, 1024  # keyword queries, and documents, that are scored at once
KEPT = 150_000  # candidates that a task keeps, over the keyword queries of one pass over the counts
SHARED, DENSE = 1 / 1000, 1 << 22  # share of pairs from which a word is a column of a dense product, and cells of such columns
LONG_LIST = 1000  # ids above which a filter becomes a join


def base_filter(
    rows: DataFrame, kb_ids: Iterable = (), doc_ids: Iterable = (), tags: Iterable = (), not_docs: Iterable = (),
    kb_col: str = "kb_id", doc_col: str = "doc_id", tag_col: str = "tag", enabled_col: str | None = None,
) -> DataFrame:
    """Enabled rows within the given scopes and without the excluded documents. An empty
    list is no condition; a null in the enabled column means enabled."""
    if enabled_col:
        rows = rows.filter(F.coalesce(F.col(enabled_col), F.lit(True)))
    for column, wanted in ((kb_col, list(kb_ids)), (doc_col, list(doc_ids)), (tag_col, list(tags))):
        if len(wanted) > LONG_LIST:
            ids = rows.sparkSession.createDataFrame([(x,) for x in wanted], [column])
            rows = rows.join(ids, column, "left_semi")
        elif wanted:
            rows = rows.filter(F.col(column).isin(wanted))
    excluded = list(not_docs)
    if len(excluded) > LONG_LIST:
        return rows.join(rows.sparkSession.createDataFrame([(x,) for x in excluded], [doc_col]), doc_col, "left_anti")
    return rows.filter(~F.col(doc_col).isin(excluded)) if excluded else rows


_COMPARE = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def filter_tree(node: dict) -> Column:
    """A Column from nested conditions: {"and": [...]}, {"or": [...]} or
    {"field", "op", "value"} with op eq, ne, gt, gte, lt, lte, in, not_in, like,
    not_like or between."""
    for word, unit, join in (("and", True, lambda a, b: a & b), ("or", False, lambda a, b: a | b)):
        if word in node:
            out = F.lit(unit)
            for k, part in enumerate(node[word]):
                out = filter_tree(part) if k == 0 else join(out, filter_tree(part))
            return out
    column, op, value = F.col(node["field"]), node["op"], node["value"]
    if op in _COMPARE:
        return getattr(column, _COMPARE[op])(value)
    if op in ("in", "not_in"):
        return column.isin(value) if op == "in" else ~column.isin(value)
    if op in ("like", "not_like"):
        return column.like(value) if op == "like" else ~column.like(value)
    if op == "between":
        return column.between(*value)
    raise ValueError(f"no condition {op!r}")


def _top(scored: DataFrame, k: int, by: str, order: list[Column]) -> DataFrame:
    """rank 1 to k within each `by`."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


_RUN, _HAN = re.compile(r"[^\W_]+"), re.compile(r"[\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def search_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, with Han runs as overlapping pairs (a single one stays)."""
    text = (text or "").lower()
    words = _RUN.findall(text)
    if text.isascii() or not _HAN.search(text):
        return words
    out = []
    for word in words:
        at = 0
        for m in _HAN.finditer(word):
            out += [word[at : m.start()]] if m.start() > at else []
            run, at = m[0], m.end()
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
        out += [word[at:]] if at < len(word) else []
    return out


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents by BM25 of each query
    (query_id, query); any shared word makes a candidate.

    One scan of the texts leaves the counts of words that some query has (queries come in
    groups of GROUP, a scan each; texts that are scanned again are dealt to tasks first).
    These narrow rows are scored where they lie, SCORED queries at a time, and every task
    passes on k candidates a query, so that a common word brings no documents and queries
    together. Words that many pairs of a query and a document share are multiplied as dense
    columns, all others are added pair by pair, and of the scores only those that may be among
    a query's k best so far are looked at. Ranks go by the score to six places, then the smaller id.
    """
    groups = max(1, math.ceil(queries.count() / GROUP))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if groups > 1:
        docs = materialise(spread(docs, "doc_id"), "bm25-texts")
    out = None
    for group in range(groups):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group).select("query_id", "query").orderBy("query_id").collect()
        found = _bm25_group(docs, [(r.query_id, sorted(set(search_words(r["query"])))) for r in part], queries.schema["query_id"].dataType, k) if part else None
        out = found if out is None or found is None else out.unionByName(found)
    if groups > 1:
        discard(docs)
    if out is None:
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, rank int"
        return docs.sparkSession.createDataFrame([], kinds)
    return _top(out, k, "query_id", [F.desc("score"), F.asc("doc_id")]).select("query_id", "doc_id", "score", "rank")


def _bm25_group(docs: DataFrame, asked: list[tuple], query_type, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    terms = {t: n for n, t in enumerate(dict.fromkeys(t for _, words in asked for t in words))}
    wanted = context.broadcast(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.mapInArrow(_count_words(wanted), f"doc_id {kind}, len int, term array<int>, tf array<int>")
    # Counts are narrow: dealt to tasks, few enough that the candidates of all of them are few.
    tasks = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(8, 2 * context.defaultParallelism))
    postings = materialise(counted.repartition(tasks, "doc_id"), "bm25-postings")
    n_docs, avg_len = postings.agg(F.count("*"), F.avg("len")).first()
    df = np.zeros(len(terms))
    for r in postings.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[r.t] = r.n
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    out = None
    most = max(SCORED, KEPT // max(1, k))
    for at in range(0, len(asked), most):
        some = asked[at : at + most]
        query = np.repeat(np.arange(len(some)), [len(words) for _, words in some])
        term = np.array([terms[t] for _, words in some for t in words], np.int64)
        sent = context.broadcast((pa.array([q for q, _ in some]), *_weights(query, term, len(some), df / max(1, n_docs), idf), avg_len or 1.0))
        found = postings.filter(F.size("term") > 0).mapInArrow(_score_words(sent, k), f"query_id {query_type.simpleString()}, doc_id {kind}, score double")
        out = found if out is None else out.unionByName(found)
    return out


def _weights(query: np.ndarray, term: np.ndarray, queries: int, share: np.ndarray, idf: np.ndarray) -> tuple:
    """Columns of terms that at least SHARED of the pairs share (-1: none), their weights (queries, columns), and for each
    SCORED queries the other terms: the terms, where each one's queries begin, and the queries by term."""
    pairs = np.bincount(term, minlength=len(share)) / max(1, queries) * share
    common = np.argsort(-pairs, kind="stable")[: max(1, DENSE // max(1, queries, SLICE))]
    common = common[pairs[common] >= SHARED]
    column = np.full(len(share), -1, np.int32)
    column[common] = np.arange(len(common))
    dense = np.zeros((queries, len(common)))
    of = column[term]
    dense[query[of >= 0], of[of >= 0]] = idf[term[of >= 0]]
    query, term = query[of < 0], term[of < 0]
    others = []
    for at in range(0, queries, SCORED):
        low, high = np.searchsorted(query, [at, at + SCORED])
        order = np.argsort(term[low:high], kind="stable")
        own, first = np.unique(term[low:high][order], return_index=True)
        others.append((own, np.append(first, high - low), query[low:high][order] - at))
    return column, dense, others, idf


def _count_words(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = wanted.value.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text"):
                words = search_words(text.as_py())
                found = Counter(map(number, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.append(list(found))
                counts.append(list(found.values()))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "len", "term", "tf"])

    return run


def _score_words(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, column, dense, others, idf, avg_len = sent.value
        best = Best(len(queries), k)
        local = np.full(len(column), -1, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists, n = part.column("term"), part.num_rows
                row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                term = lists.flatten().to_numpy()
                tf = part.column("tf").flatten().to_numpy().astype(float)
                length = part.column("len").to_numpy().astype(float)[row]
                made = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))
                of = column[term]
                common = np.zeros((dense.shape[1], n))
                common[of[of >= 0], row[of >= 0]] = made[of >= 0]
                row, term, made = row[of < 0], term[of < 0], (made * idf[term])[of < 0]
                for block, (own, first, query) in enumerate(others):
                    start = block * SCORED
                    scores = dense[start : start + SCORED] @ common
                    local[own] = np.arange(len(own))
                    found = local[term]
                    local[own] = -1
                    hit = np.flatnonzero(found >= 0)
                    found = found[hit]
                    times = first[found + 1] - first[found]
                    place = np.repeat(first[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    cell = (query * n)[place] + np.repeat(row[hit], times)
                    np.add.at(scores.reshape(-1), cell, np.repeat(made[hit], times))
                    best.add_near(start, scores, part.column("doc_id"))
        yield from best.rows(queries, "doc_id")

    return run


class Best:
    """The k best candidates of each query that a task has seen, by score and then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.query, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0), None
        self.queries = queries
        self.least = np.zeros(queries)  # a score that the k best of each query reach
        self.new, self.waiting = [], 0  # candidates that came since the last cut

    def add(self, scores: np.ndarray, ids: pa.Array, ok: np.ndarray) -> None:
        """Scores (queries, rows) of the rows of these ids, where `ok`."""
        k = min(self.k, scores.shape[1])
        if scores.shape[1] > 4 * k:  # what is below a query's k-th best can't stay
            least = np.partition(np.where(ok, scores, -np.inf), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            ok = ok & (scores >= least[:, None])
        query, row = np.nonzero(ok)
        self._wait(query, scores[query, row], ids.take(pa.array(row)))

    def add_near(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores above 0, to six places, of some queries from `first` on, and of the rows of these ids."""
        least = self.least[first : first + len(scores)]
        ok = scores > np.maximum(least - 1e-6, 0)[:, None]
        if np.count_nonzero(ok) > 4 * self.k * len(scores) and scores.shape[1] > 4 * self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            np.maximum(least, np.round(kth, 6), out=least)
            ok = scores > np.maximum(least - 1e-6, 0)[:, None]
        cell = np.flatnonzero(ok)
        score = np.round(scores.reshape(-1)[cell], 6)
        cell, score = cell[score > 0], score[score > 0]
        self._wait(cell // scores.shape[1] + first, score, ids.take(pa.array(cell % scores.shape[1])))

    def _wait(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.new.append((query, score, ids))
        self.waiting += len(query)
        if len(self.query) + self.waiting > 8 * self.k * max(1, self.queries):
            self._cut()

    def _cut(self) -> None:
        if self.new:
            query, score, ids = zip(*self.new, strict=True)
            self.query, self.score = np.concatenate([self.query, *query]), np.concatenate([self.score, *score])
            self.ids = pa.concat_arrays([*([] if self.ids is None else [self.ids]), *ids])
            self.new, self.waiting = [], 0
        by_id = pc.rank(self.ids, tiebreaker="dense").to_numpy()
        order = np.lexsort((by_id, -self.score, self.query))
        query = self.query[order]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        kth = order[place == self.k - 1]
        self.least[self.query[kth]] = np.maximum(self.least[self.query[kth]], self.score[kth])
        order = order[place < self.k]
        self.query, self.score, self.ids = self.query[order], self.score[order], self.ids.take(pa.array(order))

    def rows(self, queries: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
        if len(self.query) + self.waiting:
            self._cut()
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(self.query)), self.ids, pa.array(self.score)], ["query_id", name, "score"])


METRICS = ("cosine", "ip")


def vector_search(index: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest of each query (query_id, vector), exactly.

    metric is "cosine", or "ip": the inner product with the stored vectors as they are, for
    stores of unit vectors. Queries are made unit vectors; a zero vector stays one. Vectors
    that are null, of another length, or hold a null, NaN or infinity are no candidates.
    Queries whose vectors are null or not of one length, or not of the index's, raise
    ValueError. Scores below a positive threshold are left out. Queries are broadcast in
    blocks of BLOCK; every task keeps k candidates a query, so little is shuffled.
    """
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    rows = index.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {index.schema[id_col].dataType.simpleString()}, score double"
    n, least, most, known = queries.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector")), F.count("vector")).first()
    stored = rows.select(F.size("vector")).first()
    if n and (known < n or least != most or stored and stored[0] != most):
        raise ValueError(f"query vectors have {least} to {most} values, {n - known} are null; the index has {stored and stored[0]}")
    blocks = max(1, math.ceil(n / BLOCK))
    out = None
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()
        if not part:
            continue
        wanted = np.array([r.vector for r in part], np.float64)
        norms = np.linalg.norm(wanted, axis=1, keepdims=True)
        sent = index.sparkSession.sparkContext.broadcast((pa.array([r.query_id for r in part]), np.divide(wanted, norms, out=np.zeros_like(wanted), where=norms > 0)))
        found = rows.mapInArrow(_nearest(sent, k, threshold, metric), kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.sparkSession.createDataFrame([], f"{kinds}, rank int")
    return _top(out, k, "query_id", [F.desc("score"), F.asc("vec_id")])


def _nearest(sent, k: int, threshold: float, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted = sent.value
        best = Best(len(queries), k)
        rows = max(64, SCORES // max(1, len(queries)))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                vectors = batch.column("vector")
                same = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == wanted.shape[1])
                if not len(same):
                    continue
                flat = vectors.take(pa.array(same)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(same), -1)
                finite = np.isfinite(flat).all(axis=1)
                flat, ids = flat[finite], batch.column("vec_id").take(pa.array(same[finite]))
                if metric == "cosine":
                    norms = np.linalg.norm(flat, axis=1, keepdims=True)
                    flat = np.divide(flat, norms, out=np.zeros_like(flat), where=norms > 0)
                scores = np.round(wanted @ flat.T, 6)
                best.add(scores, ids, scores >= threshold if threshold > 0 else np.ones(scores.shape, bool))
        yield from best.rows(queries, "vec_id")

    return run


def match_any(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that share a word with `terms`, all with score 1."""
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    return docs.filter(F.arrays_overlap(T.words(F.col(text_col)), wanted)).select(F.col(id_col).alias("doc_id"), F.lit(1.0).alias("score"))


def normalise_score(score: Column, engine: Column) -> Column:
    """Vector scores of any store in [0, 1]: milvus gives -1 to 1; NaN and null are 0."""
    s = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(F.when(engine == "milvus", (score + 1) / 2).otherwise(score))
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def best_per_chunk(hits: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first hit of each group in the given order."""
    return hits.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_at = 1").drop("_at")


def tiered(hits: DataFrame, by: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Keyword hits by tier (null: 2), score and id; each chunk once, in its best place."""
    hits = hits.withColumn("tier", F.coalesce("tier", F.lit(2)))
    order = [F.asc("tier"), F.desc("score"), F.asc(id_col)]
    once = best_per_chunk(hits, [by, id_col], order)
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def weighted_rrf(vector: DataFrame, keyword: DataFrame, k: int = 60, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """query_id, doc_id, score: sum of weight / (k + rank) over the two lists (query_id,
    doc_id, rank from 1), best first by `rank`."""
    v = vector.select("query_id", "doc_id", F.col("rank").alias("v_rank"))
    w = keyword.select("query_id", "doc_id", F.col("rank").alias("k_rank"))
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))
    both = v.join(w, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round(part(vector_weight, "v_rank") + part(keyword_weight, "k_rank"), 9))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id")))).select(
        "query_id", "doc_id", "score", "rank"
    )


def plain_rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """query_id, doc_id, score: sum of 1 / (k + rank) with ranks from 0, unweighted."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "doc_id", "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank") - 1)), 9).alias("score"))


def minmax_keyword_scores(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """Scores in [0, 1] within each query: one hit, or hits without spread, count 1; ten or
    more are scaled between the scores at n * 5 / 100 and n * 95 / 100 of the sorted list
    (counted from 0) and clamped, fewer between least and greatest."""
    every, ordered = Window.partitionBy(by), Window.partitionBy(by).orderBy("score", "doc_id")
    n = F.count("*").over(every)
    at = hits.withColumns({"n": n, "place": F.row_number().over(ordered) - 1})
    pick = lambda index: F.max(F.when(F.col("place") == index, F.col("score"))).over(every)
    low_at = F.when(F.col("n") >= 10, F.floor(F.col("n") * 5 / 100)).otherwise(0)
    high_at = F.when(F.col("n") >= 10, F.floor(F.col("n") * 95 / 100)).otherwise(F.col("n") - 1)
    at = at.withColumns({"low": pick(low_at), "high": pick(high_at)})
    scaled = F.least(F.greatest((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.0)), F.lit(1.0))
    return at.withColumn("normalised", F.when((F.col("n") == 1) | (F.col("high") == F.col("low")), 1.0).otherwise(scaled)).drop("n", "place", "low", "high")


def diversity_pool(k: int) -> int:
    """How many hits per_file_priority() chooses k from."""
    return min(max(2 * k, 100), 200)


def per_file_priority(pool: DataFrame, by: str, file_col: str, first: int = 4) -> DataFrame:
    """Hits reordered so that the `first` best of every file stand before all others."""
    inside = Window.partitionBy(by, file_col).orderBy(F.desc("score"), F.asc("doc_id"))
    at = pool.withColumn("in_file", F.row_number().over(inside))
    order = Window.partitionBy(by).orderBy(F.asc((F.col("in_file") > first).cast("int")), F.desc("score"), F.asc("doc_id"))
    return at.withColumn("rank", F.row_number().over(order))


def retrieval_pool(k: int, bases: int = 1, most: int = 500) -> int:
    """How many candidates to fetch for k results from so many knowledge bases."""
    k = k if k > 0 else 50
    return min(max(5 * k, 50) * bases, most)
