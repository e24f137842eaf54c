"""An inverted-file index for vectors: every vector lies in the list of its nearest centre, and
a query looks through the lists of the centres nearest to it.

Centres are fitted on a bounded sample; every row is indexed. Lists are a Parquet table, dealt
by centre, so that a search reads the lists that it needs and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.retrieval import BLOCK, Best, vector_search

SAMPLE = 20_000  # vectors that the centres are fitted on, those whose ids hash lowest; the only bound
LEAST_LISTS, MOST_LISTS = 8, 4096  # of an index; between, the square root of its rows


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fit(vectors: DataFrame, lists: int, id_col: str = "vec_id", vector_col: str = "embedding", most: int = SAMPLE, rounds: int = 15) -> np.ndarray:
    """Unit centres by spherical k-means over the sample, in one task; fewer if it has fewer
    different vectors. Null vectors and such with a null, NaN or infinity have no part."""
    clean = vectors.filter(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sample = clean.select(F.xxhash64(id_col).alias("low"), F.col(vector_col).cast("array<double>").alias("v")).orderBy("low", "v").limit(most)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [v for batch in batches for v in batch.column("v").to_pylist()]
        x = _unit(np.array([v for v in rows if len(v) == len(rows[0])], np.float64)) if rows else np.empty((0, 0))
        centres, near = x[:1], (x @ x[0] if len(x) else None)
        while 0 < len(centres) < lists and near.min() < 1 - 1e-9:  # the farthest from those before, so that the choice is certain
            centres = np.vstack([centres, x[int(near.argmin())]])
            near = np.maximum(near, x @ centres[-1])
        for _ in range(rounds):
            own = (x @ centres.T).argmax(axis=1) if len(x) else []
            centres = _unit(np.array([x[own == k].sum(axis=0) if (own == k).any() else c for k, c in enumerate(centres)]).reshape(centres.shape))
        yield pa.RecordBatch.from_arrays([pa.array(list(centres), pa.list_(pa.float64()))], ["c"])

    found = [r.c for r in sample.repartition(1).sortWithinPartitions("low", "v").select("v").mapInArrow(learn, "c array<double>").collect()]
    return np.array(found)


def lists_for(vectors: DataFrame) -> int:
    """How many lists suit so many vectors: as many as a list then has, within bounds."""
    return min(MOST_LISTS, max(LEAST_LISTS, round(vectors.count() ** 0.5)))


def build(vectors: DataFrame, centres: np.ndarray, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Write all vectors to `path` with the number of their list (null for those that can't be searched)."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    numbered = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")).withColumn("list", F.get(_lists(sent, 1)("embedding"), 0))
    # Files of Spark's advisory size: long lists in several tasks, short ones together.
    numbered.hint("rebalance", F.col("list")).write.partitionBy("list").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _lists(sent, n: int):
    """The n nearest centres of a vector, nearest first; empty for one of another length or with a value that isn't finite."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centres = sent.value
        for part in parts:
            out = []
            for v in part.to_pylist():
                row = np.array(v if v is not None else [], float)
                ok = len(row) == centres.shape[-1] and np.isfinite(row).all()
                out.append(np.argsort(-(centres @ row), kind="stable")[:n].tolist() if ok else [])
            yield pa.array(out, pa.list_(pa.int32()))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")


def probes_for(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, recall: float = 0.95) -> int:
    """How many lists to look through, so that this share of the true k nearest of the given
    queries (a bounded set; they are searched for exactly) lie in them."""
    truth = vector_search(index.select("vec_id", "embedding"), queries, k).join(index.select("vec_id", "list"), "vec_id")
    order = queries.select("query_id", _lists(queries.sparkSession.sparkContext.broadcast(centres), len(centres))("vector").alias("lists"))
    places = truth.join(order, "query_id").select(F.array_position("lists", F.col("list")).alias("place")).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
    wanted, seen = recall * sum(r.n for r in places), 0
    for r in places:  # at most as many rows as there are lists
        seen += r.n
        if seen >= wanted:
            return int(r.place)
    return len(centres)


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest by cosine of each query (query_id, vector) among
    the vectors of the `probes` lists nearest to it.

    Queries are broadcast in blocks, with their lists; a row is scored against the queries that
    look through its list, and every task keeps k candidates a query. Lists that no query of a
    block needs aren't read.
    """
    context = queries.sparkSession.sparkContext
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {index.schema['vec_id'].dataType.simpleString()}, score double"
    asked = queries.select("query_id", "vector", _lists(context.broadcast(centres), probes)("vector").alias("lists"))
    blocks = max(1, -(-queries.count() // BLOCK))
    out = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).filter(F.size("lists") > 0).orderBy("query_id").collect()
        if not part:
            continue
        members: dict[int, list[int]] = {}
        for n, r in enumerate(part):
            for x in r.lists:
                members.setdefault(x, []).append(n)
        sent = context.broadcast((pa.array([r.query_id for r in part]), _unit(np.array([r.vector for r in part], float)), members))
        found = index.filter(F.col("list").isin(sorted(members))).select("vec_id", "embedding", "list").mapInArrow(_near(sent, k), kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"{kinds}, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _near(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted, members = sent.value
        best = Best(len(queries), k)
        for batch in batches:
            lists = batch.column("list").to_numpy()
            vectors = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1))
            for x in np.unique(lists).tolist():
                rows, own = np.flatnonzero(lists == x), np.array(members[x])
                scores = np.full((len(queries), len(rows)), -np.inf)
                scores[own] = np.round(wanted[own] @ vectors[rows].T, 6)
                best.add(scores, batch.column("vec_id").take(pa.array(rows)), np.isfinite(scores))
        yield from best.rows(queries, "vec_id")

    return run
