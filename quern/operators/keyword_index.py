"""A stored keyword index: postings in segments of documents of similar length, with what bounds their scores.

A segment is SEGMENT documents that one task read, cut from a longer stretch that is sorted by length.
`segments` has a row for each segment and folder of words (by the word's hash) with all its words there (places,
counts, and the largest count and the shortest document, which bound the word's score there for any average
length), and one with the ids and lengths in a folder of its own; `sizes` has a row for each addition. A
search goes through the rows of its words' folders once, scores the segments with the highest bounds first,
and then those only whose summed bounds reach a query's k-th score so far. Scores are those of retrieval.bm25().
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.operators.retrieval import K1, SCORED, B, Best, _top, search_words
from quern.session import materialise

SEGMENT, STRETCH = 128, 4096  # documents of a segment, and of the stretch that is sorted by length
POSTING = "struct<word:string,places:array<int>,counts:array<int>,most:int,shortest:int>"
MOST_WORDS, WORDS = 1 << 22, 1 << 16  # words that end a stretch, and postings that leave a task at once
FOLDERS, WHOLE = 8, -1  # of words, by their hash, and the folder of ids and lengths
FIRST = 4  # of each query's segments, those with the highest bounds, that are scored first, and at least k documents'


class KeywordIndex:
    """An index in the folder `path` of any store; `folders` are chosen when it is begun (some thousands
    for billions of documents) and the same for every use."""

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path.rstrip("/"), folders
        self.blocks_read = 0  # postings that the last search read, of
        self.blocks_asked = 0  # those of its words

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> KeywordIndex:
        """Add documents; what the index has stays as it is. Rows are documents, repeated ids too; null
        texts are empty ones. An addition is seen when it is complete: its sizes are written last."""
        kind, mark = docs.schema[id_col].dataType.simpleString(), uuid.uuid4().hex
        shape = f"folder int, segment string, words array<{POSTING}>, ids array<{kind}>, lengths array<int>"
        made = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_segments(mark, self.folders, docs.schema[id_col].dataType), shape)
        # Files of Spark's advisory size: folders with common words in several tasks, small ones together.
        made = made.withColumn("addition", F.lit(mark)).hint("rebalance", F.col("folder"))
        made.sortWithinPartitions("folder").write.mode("append").partitionBy("addition", "folder").parquet(f"{self.path}/segments")
        whole = self._rows(kind).filter((F.col("addition") == mark) & (F.col("folder") == WHOLE))
        size = whole.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("n_words"))
        size.select("*", F.lit(kind).alias("id_type"), F.lit(mark).alias("addition")).coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")
        return self

    def _rows(self, kind: str) -> DataFrame:
        shape = f"segment string, words array<{POSTING}>, ids array<{kind}>, lengths array<int>, addition string, folder int"
        return self.spark.read.schema(shape).parquet(f"{self.path}/segments")

    def _sizes(self) -> tuple[int, int, str]:
        """How many documents and words there are, and the type of the ids."""
        return self.spark.read.parquet(f"{self.path}/sizes").agg(F.sum("n_docs"), F.sum("n_words"), F.max("id_type")).first()

    def _tables(self) -> tuple[DataFrame, DataFrame, int, float]:
        """postings and segments of complete additions, and how many documents and words a document there are."""
        sizes = self.spark.read.parquet(f"{self.path}/sizes")
        n_docs, n_words, kind = self._sizes()
        rows = self._rows(kind).join(F.broadcast(sizes.select("addition")), "addition", "left_semi")
        postings, segments = rows.filter(F.col("folder") != WHOLE), rows.filter(F.col("folder") == WHOLE)
        return postings, segments, n_docs or 0, (n_words or 0) / n_docs if n_docs else 0.0

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, doc_id, score, rank: the k best documents of each query (query_id, query), as
        retrieval.bm25() has them. Queries come in blocks of SCORED."""
        out = None
        self.blocks_read = self.blocks_asked = 0
        n_docs, _, id_type = self._sizes()
        if not n_docs:
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {id_type}, score double, rank int")
        block: list[tuple] = []
        for row in queries.filter("query_id IS NOT NULL").select("query_id", "query").orderBy("query_id").toLocalIterator():
            block.append((row.query_id, sorted(set(search_words(row["query"])))))
            if len(block) == SCORED:
                out, block = self._joined(out, block, queries, k), []
        out = self._joined(out, block, queries, k) if block or out is None else out
        return _top(out, k, "query_id", [F.desc("score"), F.asc("doc_id")]).select("query_id", "doc_id", "score", "rank")

    def _joined(self, out: DataFrame | None, asked: list[tuple], queries: DataFrame, k: int) -> DataFrame:
        found = self._search(asked, queries.schema["query_id"].dataType, k)
        return found if out is None else out.unionByName(found)

    def _search(self, asked: list[tuple], query_type, k: int) -> DataFrame:
        postings, segments, n_docs, mean = self._tables()
        kind = segments.schema["ids"].dataType.elementType.simpleString()
        words = list(dict.fromkeys(w for _, own in asked for w in own))
        table = self.spark.createDataFrame([(w, n) for n, w in enumerate(words)], "word string, term int")
        # Folders are pruned, and their rows are gone through once: only the queries' words leave them.
        wanted = F.filter("words", lambda p: p["word"].isin(words))
        own = postings.filter(F.col("folder").isin(sorted({_folder(w, self.folders) for w in words}))).select("segment", F.explode(wanted).alias("p")).select("segment", "p.*")
        own = materialise(own.join(F.broadcast(table), "word").drop("word"), "bounds")
        heads = own.select("term", "segment", F.size("places").alias("n"), "most", "shortest")
        seen = np.zeros(len(words))
        for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect():
            seen[r.term] = r.n
        idf = np.log(1 + (n_docs - seen + 0.5) / (seen + 0.5))
        number = {w: n for n, w in enumerate(words)}
        weight = np.zeros((len(words), len(asked)))
        for q, (_, mine) in enumerate(asked):
            at = [number[w] for w in mine]
            weight[at, q] = idf[at]
        sent = self.spark.sparkContext.broadcast((pa.array([q for q, _ in asked]), weight, mean or 1.0))

        # Bounds of queries in segments: one row for both, from a row a segment.
        bound = _saturated(F.col("most"), F.col("shortest"), mean or 1.0)
        by_segment = heads.groupBy("segment").agg(F.collect_list("term").alias("terms"), F.collect_list(bound).alias("bounds"))
        bounds = materialise(by_segment.mapInArrow(_sum_bounds(sent), "segment string, q int, bound double"), "segment-bounds")
        first = Window.partitionBy("q").orderBy(F.desc("bound"), "segment")
        most = FIRST + -(-k // SEGMENT)
        start = bounds.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).select("segment", "q")
        scores = materialise(self._scored(own, segments, start, sent, query_type, kind, k), "first-scores")
        kth = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        least = {r.query_id: r.score for r in scores.withColumn("place", F.row_number().over(kth)).filter(F.col("place") == k).collect()}
        reach = [(q, float(least.get(i, 0.0))) for q, (i, _) in enumerate(asked)]
        reach = F.broadcast(self.spark.createDataFrame(reach, "q int, reach double"))
        rest = bounds.join(reach, "q").filter(F.col("bound") >= F.col("reach") - 1e-6).select("segment", "q").join(start, ["segment", "q"], "left_anti")
        rest = materialise(rest, "segments-left")
        scored = scores.unionByName(self._scored(own, segments, rest, sent, query_type, kind, k))
        needed = start.select("segment").union(rest.select("segment")).distinct()
        self.blocks_read += heads.join(needed, "segment", "left_semi").count()
        self.blocks_asked += heads.count()
        return scored

    def _scored(self, own: DataFrame, segments: DataFrame, pairs: DataFrame, sent, query_type, kind: str, k: int) -> DataFrame:
        """query_id, doc_id, score: of each task the k best of each query in its segments."""
        of = pairs.groupBy("segment").agg(F.collect_set("q").alias("queries"))
        blocks = own.join(of.select("segment"), "segment", "left_semi").groupBy("segment").agg(F.collect_list(F.struct("term", "places", "counts")).alias("blocks"))
        rows = segments.select("segment", "ids", "lengths").join(of, "segment").join(blocks, "segment").select("ids", "lengths", "queries", "blocks")
        return rows.mapInArrow(_score_segments(sent, k), f"query_id {query_type.simpleString()}, doc_id {kind}, score double")


def _folder(word: str, folders: int) -> int:
    return zlib.crc32(word.encode()) % folders


def _saturated(count, length, mean: float):
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))


def _segments(mark: str, folders: int, id_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        id_kind, numbers = to_arrow_type(id_type), pa.list_(pa.int32())
        posting = pa.struct({"word": pa.string(), "places": numbers, "counts": numbers, "most": pa.int32(), "shortest": pa.int32()})

        def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"folder": pa.int32(), "segment": pa.string(), "words": pa.list_(posting), "ids": pa.list_(id_kind), "lengths": numbers}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

        def made(stretch: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            stretch.sort(key=lambda d: len(d[1]))
            lengths = np.array([len(words) for _, words in stretch], np.int32)
            starts = np.arange(0, len(stretch), SEGMENT)
            labels = pa.array([f"{mark}-{task}-{number + n}" for n in range(len(starts))])
            number += len(starts)
            ends = np.append(starts, len(stretch)).astype(np.int32)
            yield rows(len(starts), folder=pa.array([WHOLE] * len(starts), pa.int32()), segment=labels, ids=pa.ListArray.from_arrays(ends, pa.array([i for i, _ in stretch], id_kind)), lengths=pa.ListArray.from_arrays(ends, pa.array(lengths)))
            words = pa.concat_arrays([words for _, words in stretch]).dictionary_encode()
            known = words.dictionary
            if not len(known):
                return
            # Segment, folder, word and document in one number: its repeats are the word's count.
            folder = np.array([_folder(w, folders) for w in known.to_pylist()])
            doc, word = np.repeat(np.arange(len(stretch)), lengths), words.indices.to_numpy()
            key, count = np.unique((((doc // SEGMENT) * folders + folder[word]) * len(known) + word) * SEGMENT + doc % SEGMENT, return_counts=True)
            place, pair = (key % SEGMENT).astype(np.int32), key // SEGMENT
            count, first = count.astype(np.int32), _starts(pair)
            part, word = np.divmod(pair[first], len(known))
            most, shortest = np.maximum.reduceat(count, first), lengths[part // folders * SEGMENT + place[first]]
            lists = (pa.ListArray.from_arrays(np.append(first, len(key)).astype(np.int32), pa.array(x)) for x in (place, count))
            postings = pa.StructArray.from_arrays([known.take(pa.array(word)), *lists, pa.array(most), pa.array(shortest)], fields=list(posting))
            row = _starts(part)
            packed = pa.ListArray.from_arrays(np.append(row, len(part)).astype(np.int32), postings, type=pa.list_(posting))
            segment, folder = labels.take(pa.array(part[row] // folders)), pa.array((part[row] % folders).astype(np.int32))
            cuts = np.unique(np.append(np.searchsorted(row, np.arange(0, len(part), WORDS)), len(row)))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                yield rows(high - low, folder=folder[low:high], segment=segment[low:high], words=packed[low:high])

        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                words = pa.array(search_words(text.as_py()), pa.string())
                held.append((i.as_py(), words))
                size += len(words)
                if len(held) == STRETCH or size >= MOST_WORDS:
                    yield from made(held)
                    held, size = [], 0
        if held:
            yield from made(held)

    return run


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of the same value begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def _sum_bounds(sent):
    """Rows (segment, terms, bounds) to (segment, q, bound) of the queries with any of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, weight, _ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("terms")
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                has = np.zeros((part.num_rows, len(weight)))
                has[row, lists.flatten().to_numpy()] = part.column("bounds").flatten().to_numpy()
                total = has @ weight
                r, q = np.nonzero(total > 0)
                yield pa.RecordBatch.from_arrays([part.column("segment").take(pa.array(r)), pa.array(q.astype(np.int32)), pa.array(total[r, q])], ["segment", "q", "bound"])

    return run


def _score_segments(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, mean = sent.value
        best = Best(len(queries), k)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                lengths = batch.column("lengths")[row].values.to_numpy().astype(float)
                asked, blocks = batch.column("queries")[row].values.to_numpy(), batch.column("blocks")[row].values
                terms, places = blocks.field("term").to_numpy(), blocks.field("places")
                term = np.repeat(np.arange(len(terms)), places.value_lengths().to_numpy(zero_copy_only=False))
                place, count = places.flatten().to_numpy(), blocks.field("counts").flatten().to_numpy().astype(float)
                has = np.zeros((len(ids), len(terms)))
                has[place, term] = _saturated(count, lengths[place], mean)
                scores = np.zeros((len(queries), len(ids)))
                scores[asked] = np.round(has @ weight[terms][:, asked], 6).T
                best.add(scores, ids, scores > 0)
        yield from best.rows(queries, "doc_id")

    return run
