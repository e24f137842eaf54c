"""A neighbour graph for vectors: built by neighbour descent in rounds of joins, pruned for
diversity, and searched best first over its table.

Equal directions are one node, however many rows have them. A round of descent lets the
neighbours of each node, a bounded number in both directions, meet there; each keeps the
nearest it has met. Queries go along the graph together: every step is a join of the
nodes to be looked at with their neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import is_finite
from quern.session import discard, materialise

NEIGHBOURS, DEGREE = 16, 32  # that descent keeps of a node, and that the graph has at most
MEETING = 32  # nodes that meet by chance at the start
ROUNDS, STILL = 12, 0.002  # of descent at most; the share of new neighbours under which it ends
_VALUES = 4_000_000  # numbers of groups that are multiplied at once
ENTRIES, BEAM = 32, 32  # nodes that every search begins with, and that it looks at in a step


@dataclass(frozen=True)
class VectorGraph:
    """nodes (node, vector, links) and members (node, vec_id, place): rows by node, in the order of ids."""

    nodes: DataFrame
    members: DataFrame


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, degree: int = DEGREE) -> VectorGraph:
    """The graph of all vectors but null ones, zero ones and such with a value that isn't finite."""
    norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    usable = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(is_finite(F.col(vector_col)), F.lit(False))).withColumn("_norm", norm).filter("_norm > 0")
    unit = usable.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda x: (x.cast("double") / F.col("_norm")).cast("float")).alias("vector"))
    whole = materialise(unit.withColumn("node", F.xxhash64("vector")), "graph-rows")
    place = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    members = materialise(whole.select("node", "vec_id", place.alias("place")), "graph-members")
    nodes = materialise(whole.groupBy("node").agg(F.first("vector").alias("vector")), "graph-vectors")
    n = nodes.count()
    edges = _best(_meet(_chance_meetings(nodes, n, 1).unionByName(_chance_meetings(nodes, n, 2)), neighbours), neighbours)
    edges, before = materialise(edges, "graph-edges"), None
    for _ in range(ROUNDS):
        members_of = materialise(_members_of(edges, nodes, before, neighbours), "graph-meetings")
        found = materialise(_meet(_met_at(members_of, edges, nodes, neighbours), neighbours), "graph-found-edges")
        new = materialise(_best(edges.unionByName(found), neighbours), "graph-edges")
        fresh = new.join(found.select("node", "other").distinct(), ["node", "other"], "left_semi").join(edges.select("node", "other"), ["node", "other"], "left_anti").count()
        for df in (edges, found, *([before] if before is not None else [])):
            discard(df)
        edges, before = new, members_of
        if fresh <= STILL * n * neighbours:
            break
    discard(before)
    both = edges.union(edges.select("other", "node", "similarity"))
    candidates = _best(both, 2 * neighbours).select("node", "other")
    there = candidates.join(nodes.toDF("other", "vector"), "other").select(F.col("node").alias("meeting"), F.col("other").alias("node"), "vector", F.lit(0.0).alias("reach"), F.lit(False).alias("fresh"))
    own = nodes.select(F.col("node").alias("meeting"), "node", "vector", F.lit(0.0).alias("reach"), F.lit(True).alias("fresh"))
    links = _dealt(there.unionByName(own)).mapInArrow(_by_meeting(_diverse(degree), pa.schema([("node", pa.int64()), ("links", pa.list_(pa.int64()))])), "node long, links array<long>")
    made = materialise(nodes.join(links, "node", "left").select("node", "vector", F.coalesce("links", F.array().cast("array<long>")).alias("links")), "graph-nodes")
    for df in (whole, nodes, edges):
        discard(df)
    return VectorGraph(made, members)


def _chance_meetings(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """meeting, node, vector, reach, fresh: nodes dealt by a hash into meetings of some MEETING."""
    meeting = F.xxhash64(F.lit(seed), F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(max(1, n // MEETING))))
    return nodes.select(meeting.alias("meeting"), "node", "vector", F.lit(float("-inf")).alias("reach"), F.lit(True).alias("fresh"))


def _members_of(edges: DataFrame, nodes: DataFrame, before: DataFrame | None, neighbours: int) -> DataFrame:
    """at, who, fresh: at each node its neighbours, as many of those whose neighbour it is, and itself; fresh are those that
    weren't there `before`."""
    back = edges.select(F.col("other").alias("at"), F.col("node").alias("who"), F.row_number().over(Window.partitionBy("other").orderBy(F.desc("similarity"), "node")).alias("place"))
    there = edges.select(F.col("node").alias("at"), F.col("other").alias("who")).union(back.filter(F.col("place") <= neighbours).select("at", "who")).union(nodes.select("node", "node")).distinct()
    if before is None:
        return there.withColumn("fresh", F.lit(True))
    return there.join(before.select("at", "who", F.lit(True).alias("_old")), ["at", "who"], "left").select("at", "who", F.col("_old").isNull().alias("fresh"))


def _met_at(members_of: DataFrame, edges: DataFrame, nodes: DataFrame, neighbours: int) -> DataFrame:
    """meeting, node, vector, reach, fresh: who meets at each node that has a fresh one, with the similarity that a
    neighbour must have to be among its nearest."""
    wanted = members_of.join(members_of.filter("fresh").select("at").distinct(), "at", "left_semi")
    full = edges.groupBy("node").agg(F.when(F.count("*") >= neighbours, F.min("similarity")).alias("reach"))
    known = nodes.join(full, "node", "left").select("node", "vector", F.coalesce("reach", F.lit(float("-inf"))).alias("reach"))
    return wanted.join(known, wanted.who == known.node).select(F.col("at").alias("meeting"), "node", "vector", "reach", "fresh")


def _dealt(meetings: DataFrame) -> DataFrame:
    """Meetings whole and one after the other in a task, vectors of one length together."""
    return meetings.withColumn("size", F.size("vector")).repartition("meeting").sortWithinPartitions("meeting", "size", "node")


def _by_meeting(one, schema: pa.Schema):
    """Batches of rows in the order of _dealt() to what `one` makes of equally large groups at a time: of the arrays meeting
    (groups), node (groups, members), vectors (groups, members, length), reach and fresh. A group is one meeting's vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            meeting, node, reach = (table.column(c).to_numpy() for c in ("meeting", "node", "reach"))
            size, fresh, lists = table.column("size").to_numpy(), table.column("fresh").to_numpy(), table.column("vector").combine_chunks()
            flat, offset = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
            begin = np.flatnonzero(np.concatenate([[True], (meeting[1:] != meeting[:-1]) | (size[1:] != size[:-1])]))
            count = np.diff(np.append(begin, len(meeting)))
            for length, m in sorted({(int(size[b]), int(c)) for b, c in zip(begin, count, strict=True)}):
                same = begin[(size[begin] == length) & (count == m)]
                most = max(1, _VALUES // (m * max(length, m)))
                for at in range(0, len(same), most):
                    rows = same[at : at + most, None] + np.arange(m)
                    x = flat[offset[rows][..., None] + np.arange(length)].astype(np.float64)
                    yield pa.RecordBatch.from_pydict(one(meeting[rows[:, 0]], node[rows], x, reach[rows], fresh[rows]), schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            meeting = held.column("meeting").to_numpy()
            end = int(np.searchsorted(meeting, meeting[-1]))  # the last meeting may go on
            if end:
                yield from made(held.slice(0, end))
                held = held.slice(end)
        if held is not None:
            yield from made(held)

    return run


def _meet(meetings: DataFrame, k: int) -> DataFrame:
    """node, other, similarity: of each node the k nearest at each meeting, of pairs that a fresh one is in and within its reach."""

    def one(_, node, x, reach, fresh) -> dict:
        near = np.round(x @ x.transpose(0, 2, 1), 6)
        near[(near < reach[:, :, None]) | ~(fresh[:, :, None] | fresh[:, None, :])] = -np.inf
        near[:, np.arange(near.shape[1]), np.arange(near.shape[1])] = -np.inf
        best = np.argsort(-near, axis=2, kind="stable")[:, :, :k]
        value = np.take_along_axis(near, best, 2)
        g, i, j = np.nonzero(value > -np.inf)
        return {"node": node[g, i], "other": node[g, best[g, i, j]], "similarity": value[g, i, j]}

    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])
    return _dealt(meetings).mapInArrow(_by_meeting(one, schema), "node long, other long, similarity double")


def _best(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.desc("similarity"), "other")
    once = edges.filter("node != other").groupBy("node", "other").agg(F.max("similarity").alias("similarity"))
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _diverse(degree: int):
    """Of a node's candidates, nearest first, those nearer to it than to any that stays before; while
    there is room, the nearest of the others too. The node itself is the fresh one of its group."""

    def one(meeting, node, x, _, fresh) -> dict:
        like, made = x @ x.transpose(0, 2, 1), []
        for g in range(len(node)):
            own = int(fresh[g].argmax()) if fresh[g].any() else -1
            if own < 0:  # candidates of another length than the node's own
                made.append([])
                continue
            near = like[g, own]
            order, stay, left = [int(c) for c in np.lexsort((node[g], -near)) if c != own], [], []
            for c in order:
                if len(stay) < degree and (not stay or (like[g, c, stay] < near[c]).all()):
                    stay.append(c)
                else:
                    left.append(c)
            made.append(node[g, stay + left[: max(0, degree // 2 - len(stay))]].tolist())
        kept = [g for g, links in enumerate(made) if links]
        return {"node": meeting[kept], "links": [made[g] for g in kept]}

    return one


def search(graph: VectorGraph, queries: DataFrame, k: int = 10, width: int = 128) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest by cosine of each query (query_id, vector) that a
    best-first search finds which keeps `width` nodes a query. Rows of one direction rank by id."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asked = queries.filter("query_id IS NOT NULL AND vector IS NOT NULL").withColumn("_norm", norm).filter("_norm > 0")
    asked = materialise(asked.select("query_id", F.transform("vector", lambda x: x.cast("double") / F.col("_norm")).alias("asked")), "graph-queries")
    nodes = graph.nodes
    entries = nodes.select("node").orderBy(F.xxhash64(F.lit(3), "node")).limit(ENTRIES)
    pool = _keep(_near(asked.select("query_id").join(F.broadcast(entries)), nodes, asked).withColumn("seen", F.lit(False)), width)
    pool = materialise(pool, "graph-pool")
    while True:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
        now = pool.filter("NOT seen").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BEAM).select("query_id", "node")
        now = materialise(now, "graph-step")
        if now.isEmpty():
            break
        linked = now.join(nodes.select("node", "links"), "node").select("query_id", F.explode("links").alias("node")).distinct().join(pool.select("query_id", "node"), ["query_id", "node"], "left_anti")
        looked = pool.join(now.withColumn("now", F.lit(True)), ["query_id", "node"], "left").select("query_id", "node", "score", (F.col("seen") | F.coalesce("now", F.lit(False))).alias("seen"))
        new = materialise(_keep(looked.unionByName(_near(linked, nodes, asked).withColumn("seen", F.lit(False))), width), "graph-pool")
        discard(pool)
        discard(now)
        pool = new
    rows = pool.join(graph.members.filter(F.col("place") <= k), "node").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _near(pairs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, node, score of pairs (query_id, node) with vectors of one length."""
    at = pairs.join(nodes.select("node", "vector"), "node").join(asked, "query_id").filter(F.size("asked") == F.size("vector"))
    dot = F.aggregate(F.zip_with("asked", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return at.select("query_id", "node", F.round(dot, 6).alias("score"))


def _keep(pool: DataFrame, width: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return pool.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= width).drop("place")
