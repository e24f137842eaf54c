"""Hard negatives by threshold joins in the manner of L2AP (Anastasiu and Karypis 2014).

Anchors come in blocks of bounded size, each broadcast and held against all rows in a pass. For a
block there is an inverted index: dimensions in the order of the anchors' weight in them,
and for each group of dimensions the anchors that list it. An anchor doesn't list its last
dimensions, as far as their norm times the rows' can't reach its threshold. Rows accumulate partial scores over the
groups; a pair goes when what it has and the product of the remaining norms stay below the
threshold; what is left is scored exactly, in whole numbers.

Thresholds begin high. A window (an anchor and a range of scores) is full when a pass found
its k rows above the threshold, and exhausted when the threshold reached its lower end;
anchors with other windows get a lower threshold and another pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialise, shared_dir

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LEAST, MOST = 80, 100  # hundredths of the positive's score that a negative has at least and at most
BLOCK = 4096  # anchors in a pass: 2 MB of 64 dimensions
GROUP, TILE = 8, 1024  # dimensions summed between prunings; rows, and anchors, of a tile
POSITIVE_LEVELS = (0.45, 0.3, 0.15)  # of the product of norms; then no threshold
NEGATIVE_LEVELS = (0.95, 0.88)  # of the positive's score; then the window's lower end
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_EXACT = float(1 << 62)


@dataclass(frozen=True)
class Windows:
    """Of each anchor (rows) the windows (columns): a label of its own or others', and scores from lo to hi."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    threshold: np.ndarray
    same: bool

    @property
    def exhausted(self) -> np.ndarray:
        return self.lo >= self.threshold[:, None]


class Index:
    """The inverted index over a block of anchors."""

    def __init__(self, windows: Windows, most_norm: float):
        q = windows.vectors.astype(float)
        self.order = np.argsort(-(q * q).sum(axis=0), kind="stable")
        self.q = q[:, self.order]
        self.starts = list(range(0, q.shape[1], GROUP))
        self.rest = suffix_norms(self.q, self.starts)
        self.t = windows.threshold.astype(float)
        # From the first group on whose remaining norms can't reach the threshold, nothing is listed.
        self.lists = self.rest[:, :-1] * most_norm * (1 + 1e-9) >= np.maximum(self.t, 0)[:, None]

    def candidates(self, x: np.ndarray, allowed: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Rows and anchors (of the slice `at`) of the pairs that may reach their threshold."""
        x = x[:, self.order].astype(float)
        rest, q_rest, t = suffix_norms(x, self.starts), self.rest[at], self.t[at]
        rows, acc = np.arange(len(x)), np.zeros(allowed.shape)
        end = np.zeros(allowed.shape[1], np.int64)  # groups that each anchor lists
        for g, start in enumerate(self.starts):
            listed = np.flatnonzero(self.lists[at, g])
            if not len(listed) or not len(rows):
                break
            end[listed] = g + 1
            part = slice(start, start + GROUP)
            acc[:, listed] += x[:, part] @ self.q[at][listed, part].T
            bound = acc + rest[:, end] * q_rest[np.arange(len(end)), end]
            allowed = allowed & (bound + np.abs(bound) * 1e-9 + 1 >= t)
            some = allowed.any(axis=1)
            if 2 * some.sum() < len(some):
                rows, acc, allowed, x, rest = rows[some], acc[some], allowed[some], x[some], rest[some]
        # Anchors that list nothing at all: no row reaches their threshold, unless it is 0 or less.
        allowed[:, (end == 0) & (t > 0)] = False
        r, a = np.nonzero(allowed)
        return rows[r], a + (at.start or 0)


def suffix_norms(v: np.ndarray, starts: list[int]) -> np.ndarray:
    """Norms of each row's components from each start on, and 0 for the end."""
    tail = np.cumsum((v * v)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.column_stack([*(tail[:, s] for s in starts), np.zeros(len(v))]))


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of x with that of q, in whole numbers; beyond 64 bits, the end of the range."""
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 1 << 15):
        a, b = x[k : k + (1 << 15)], q[k : k + (1 << 15)]
        largest = np.abs(a.astype(float)).max(initial=0) * np.abs(b.astype(float)).max(initial=0) * a.shape[1]
        if largest < _EXACT:
            out[k : k + len(a)] = np.einsum("ij,ij->i", a, b)
        else:
            out[k : k + len(a)] = [min(max(sum(map(int.__mul__, r, s)), _LOW), _HIGH) for r, s in zip(a.tolist(), b.tolist(), strict=True)]
    return out


Hits = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # anchor, window, score, id


def best(hits: Hits, k: int) -> Hits:
    """The k of each window with the highest scores; ties go to the smaller id."""
    anchor, window, score, ids = hits
    order = np.lexsort((ids, ~score, window, anchor))  # ~score falls as the score rises, without overflow
    anchor, window, score, ids = (c[order] for c in hits)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1]))) if len(anchor) else np.empty(0, bool)
    first = np.flatnonzero(new)
    own = np.arange(len(anchor)) - np.repeat(first, np.diff(np.append(first, len(anchor)))) < k
    return anchor[own], window[own], score[own], ids[own]


def search(index: Index, windows: Windows, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> Hits:
    """The best k of these rows for each window, among scores that reach the anchor's threshold."""
    empty = np.empty(0, np.int64)
    found: Hits = (empty, empty, empty, empty)
    for r0 in range(0, len(x), TILE):
        for a0 in range(0, len(windows.ids), TILE):
            rows, at = slice(r0, r0 + TILE), slice(a0, min(a0 + TILE, len(windows.ids)))
            same = labels[rows, None] == windows.labels[None, at]
            allowed = same & (ids[rows, None] != windows.ids[None, at]) if windows.same else ~same
            r, a = index.candidates(x[rows], allowed, at)
            r = r + r0
            score = inner_products(x[r], windows.vectors[a])
            reach = score >= windows.threshold[a]
            r, a, score = r[reach], a[reach], score[reach]
            parts = [found]
            for w in range(windows.lo.shape[1]):
                fits = (score >= windows.lo[a, w]) & (score <= windows.hi[a, w])
                parts.append((a[fits], np.full(fits.sum(), w), score[fits], ids[r[fits]]))
            found = best(tuple(np.concatenate(c) for c in zip(*parts, strict=True)), k)
    return found


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Lists as rows of `dims` whole numbers: shorter ones end in zeros, further components don't count."""
    lens, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (lens == dims).all():
        return flat.reshape(-1, dims)
    out, place = np.zeros((len(lens), dims), np.int64), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    fits = place < dims
    out[np.repeat(np.arange(len(lens)), lens)[fits], place[fits]] = flat[fits]
    return out


def scored_pass(rows: DataFrame, windows: Windows, k: int, most_norm: float) -> DataFrame:
    """anchor_id, window, score, vec_id, rank, full, exhausted: the best k of all rows for each window."""
    model = rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        index, found = Index(w, most_norm), []
        for batch in batches:
            got = search(index, w, batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"), w.vectors.shape[1]), k)
            found = [best(tuple(np.concatenate(c) for c in zip(*found, got, strict=True)), k)]
        for anchor, window, score, vec_id in found:
            columns = [w.ids[anchor], window.astype(np.int32), score, vec_id, w.exhausted[anchor, window]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "window", "score", "vec_id", "exhausted"])

    own = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    merged = rows.mapInArrow(run, "anchor_id long, window int, score long, vec_id long, exhausted boolean").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return merged.withColumn("full", F.max("rank").over(Window.partitionBy("anchor_id", "window")) == k)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each component. Rows with a null id, label, vector or
    component, or one that isn't finite, are left out; of rows that repeat an id, the least counts."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )
    usable = usable.filter("label IS NOT NULL")
    repeated = materialise(usable.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated-vectors")
    if repeated.isEmpty():
        return usable
    once = usable.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    return usable.join(repeated, "vec_id", "left_anti").unionByName(once)


def _blocks(anchors: DataFrame, block: int) -> Iterator[list]:
    rows = anchors.toLocalIterator()
    while got := list(islice(rows, block)):
        yield got


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows with `anchors` true, a condition on vec_id and label. Of each, the
    positives are the other rows of its label with the highest inner products, and for each
    positive the negatives are the rows of other labels with the highest of those between `least` and `most` hundredths
    of the positive's; ties go to the smaller id. A negative positive score leaves no room
    below it, and so no negatives.

    Null ids, labels, vectors or components, and components that aren't finite, leave a row
    out. Rows that repeat an id are one, with the least label and vector. Vectors of
    several lengths are read as if ended by zeros; an empty one scores 0. Scores beyond 64
    bits stand at the end of the range. No rows, or no anchors, give no rows; further
    columns play no part.
    """
    spark = rows.sparkSession
    vectors = materialise(whole_vectors(rows, id_col, vector_col, F.col("label") if label is None else label), "whole-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    most_norm = vectors.agg(F.max(norm)).first()[0] or 0.0
    path = f"{shared_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], shape).write.parquet(path)
    for part in _blocks(vectors.filter(anchors), block):
        width = max(1, *(len(r.v) for r in part))
        ids, labels = np.array([r.vec_id for r in part], np.int64), np.array([r.label for r in part], np.int64)
        of = np.zeros((len(part), width), np.int64)
        for k, r in enumerate(part):
            of[k, : len(r.v)] = r.v
        best_of = _positives(vectors, ids, labels, of, positives, most_norm)
        _negatives(vectors, ids, labels, of, best_of, negatives, least, most, most_norm, path)
    return spark.read.schema(shape).parquet(path)


def _positives(vectors: DataFrame, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, k: int, most_norm: float) -> dict[int, list[tuple[int, int]]]:
    """(score, id) of the k best rows of each anchor's label, by the anchor's place in the block."""
    reach = np.sqrt((of.astype(float) ** 2).sum(axis=1)) * most_norm
    out: dict[int, list[tuple[int, int]]] = {}
    place = {int(x): n for n, x in enumerate(ids)}
    for level in (*POSITIVE_LEVELS, None):
        left = np.array([n for n in range(len(ids)) if n not in out], np.int64)
        if not len(left):
            break
        t = np.full(len(left), _LOW) if level is None else np.minimum(np.floor(level * reach[left]), 2.0**62).astype(np.int64)
        windows = Windows(ids[left], labels[left], of[left], np.full((len(left), 1), _LOW), np.full((len(left), 1), _HIGH), t, True)
        found: dict[int, list[tuple[int, int]]] = {}
        for r in scored_pass(vectors, windows, k, most_norm).filter("full OR exhausted").orderBy("anchor_id", "rank").collect():
            found.setdefault(place[r.anchor_id], []).append((r.score, r.vec_id))
        out |= found if level is not None else {int(n): found.get(int(n), []) for n in left}
    return out


def _negatives(vectors: DataFrame, ids, labels, of, best_of, k: int, least: int, most: int, most_norm: float, path: str) -> None:
    """Append the negatives of a block of anchors to the table at `path`."""
    spark = vectors.sparkSession
    open_: dict[int, list[tuple[int, int]]] = {n: own for n, own in best_of.items() if own}
    for level in (*NEGATIVE_LEVELS, None):
        # The range of each window, empty where the positive's score is negative.
        ranges = {n: [(s, p, -(-least * s // 100), most * s // 100) for s, p in own] for n, own in open_.items()}
        ranges = {n: [w for w in own if w[2] <= w[3]] for n, own in ranges.items()}
        ranges = {n: own for n, own in ranges.items() if own}
        if not ranges:
            return
        left = np.array(list(ranges), np.int64)
        wide = max(map(len, ranges.values()))
        lo, hi = np.full((len(left), wide), _HIGH), np.full((len(left), wide), _LOW)
        for row, own in enumerate(ranges.values()):
            lo[row, : len(own)], hi[row, : len(own)] = [w[2] for w in own], [w[3] for w in own]
        ends = [min(w[2] for w in own) for own in ranges.values()]
        t = ends if level is None else [max(e, int(level * min(w[0] for w in own))) for e, own in zip(ends, ranges.values(), strict=True)]
        windows = Windows(ids[left], labels[left], of[left], lo, hi, np.array(t, np.int64), False)
        of_window = spark.createDataFrame([(int(ids[n]), w, p, s) for n, own in ranges.items() for w, (s, p, _, _) in enumerate(own)], "anchor_id long, window int, positive_id long, positive_score long")
        made = materialise(scored_pass(vectors, windows, k, most_norm), "negatives-pass")
        made.filter("full OR exhausted").join(F.broadcast(of_window), ["anchor_id", "window"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(path)
        full = {(r.anchor_id, r.window) for r in made.filter("full AND rank = 1").select("anchor_id", "window").collect()}
        done = windows.exhausted
        open_ = {int(n): [(s, p) for w, (s, p, _, _) in enumerate(own) if not done[row, w] and (int(ids[n]), w) not in full] for row, (n, own) in enumerate(ranges.items())}
        open_ = {n: own for n, own in open_.items() if own}
