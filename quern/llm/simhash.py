"""SimHash near-dedup by covering locality-sensitive hashing.

Every bit position i of the fingerprint gets a nonzero vector m(i) of radius + 1
bits. Table v, for each nonzero v of radius + 1 bits, keeps the positions with
<m(i), v> = 1 (mod 2). Two fingerprints that differ in at most `radius` positions
differ in positions whose vectors span at most `radius` dimensions, so some v is
orthogonal to all of them and the pair agrees on every bit of that table: no
pair within the radius is missed, without relying on chance.

Copies collapse to distinct fingerprints before anything is paired. Buckets are
read as sorted streams; one with more than BUCKET distinct fingerprints isn't
paired but hashed again by covering masks over its free bits, so the work for a
bucket is bounded and no pair is lost. The few buckets with a large share of the rows
are found beforehand, by heavy hitters, and are hashed again where their rows lie,
without meeting in a task. Buckets return stars, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.operators.relations import without
from quern.session import materialise

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
BUCKET = 256
HOT = 1 / 1000  # fingerprints with a larger share of the rows are joined by broadcast: fewer than 1000
HUGE = 16  # times BUCKET; larger buckets with over HOT of the rows don't meet in a task
SKETCH_TASKS = 512  # at most so many counter sets of 1/HOT entries meet in the merge
_CHUNK = 1 << 16  # shingles whose bits are unpacked at once


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over 3-word shingles (A-Z lower-cased, repeats included), each
    hashed by XXH64 with seed 42. A bit is 1 if over half the hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    hash64 = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((hash64(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(free: int = (1 << BITS) - 1, radius: int = RADIUS) -> list[int]:
    """The masks of the 2^(radius+1)-1 tables over the bits set in `free`."""
    vectors = range(1, 1 << (radius + 1))
    bits = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << b for k, b in enumerate(bits) if ((k % len(vectors) + 1) & v).bit_count() & 1) for v in vectors]


def table_mask(level: int, table: int, radius: int = RADIUS) -> int:
    """The mask of a table. Level 0 has 2^(radius+1)-1 tables; table t of a level leads to
    tables t*(2^(radius+1)-1)+k of the next, which keep its bits and cover the ones it
    leaves free."""
    if level == 0:
        return covering_masks(radius=radius)[table]
    above, k = divmod(table, (1 << (radius + 1)) - 1)
    mask = table_mask(level - 1, above, radius)
    return mask | covering_masks(~mask & (1 << BITS) - 1, radius)[k]


def _star(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least to the other members of each component within one bucket."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(fps))
    return fps[other], fps[label[other]]


SURE = 8  # free bits that leave a bucket so few members, 2^SURE, that it is always paired


def _pair_buckets(radius: int, most: int, level: int):
    """Over rows sorted by (tab, key, fp): rows (a, b, -1) are links; rows (fp, fp, tab)
    are the members of a bucket that is too large and is to be hashed again."""
    limits: dict[int, int] = {}

    def limit(table: int) -> int:
        if table not in limits:
            limits[table] = most if BITS - table_mask(level, table, radius).bit_count() > SURE else max(most, 1 << SURE)
        return limits[table]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tab = key = fp = np.empty(0, np.int64)
        over: tuple[int, int] | None = None  # the large bucket that is being passed on
        for batch in _with_end(batches):
            if batch is not None:
                tab, key, fp = (np.concatenate([old, batch[c].to_numpy(np.int64)]) for old, c in ((tab, "tab"), (key, "key"), (fp, "fp")))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if len(fp):
                cut = np.flatnonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1])) + 1
                starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
                last = len(starts) - 1
                for k in np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == last) | (np.arange(len(starts)) == 0)):
                    a, b = starts[k], ends[k]
                    me = (int(tab[a]), int(key[a]))
                    if over == me or b - a > limit(me[0]):
                        out.append((fp[a:b], fp[a:b], tab[a:b]))
                        over = me
                        if k == last:
                            a = b
                    elif k == last and batch is not None:
                        pass  # it may go on in the next batch
                    else:
                        if b - a > 1:
                            x, y = _star(fp[a:b].view(np.uint64), radius)
                            out.append((x.view(np.int64), y.view(np.int64), np.full(len(x), -1)))
                        if k == last:
                            a = b
                    if k == last:
                        tab, key, fp = tab[a:], key[a:], fp[a:]
            if out:
                x, y, z = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"a": x, "b": y, "tab": z.astype(np.int32)})

    return run


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _hash_again(radius: int, level: int):
    """Members (fp, tab) of large buckets of the level before, under each child table of `level`."""
    children, masks = (1 << (radius + 1)) - 1, {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tab, part in batch.groupby("tab")["fp"]:
                fp = part.to_numpy(np.int64)
                for child in range(tab * children, (tab + 1) * children):
                    if child not in masks:
                        masks[child] = _signed(table_mask(level, child, radius))
                    yield pd.DataFrame({"tab": np.full(len(fp), child, np.int32), "key": fp & masks[child], "fp": fp})

    return run


def _huge_buckets(rows: DataFrame, least: int) -> DataFrame:
    """Hashes (huge) of the buckets with over `least` rows and over HOT of all rows: fewer
    than 1/HOT. A bucket that shares such a hash is hashed again too, which loses nothing."""
    hashed = rows.select(F.xxhash64("tab", "key").alias("bucket"))
    candidates = hashed.coalesce(SKETCH_TASKS).stat.freqItems(["bucket"], HOT).select(F.explode("bucket_freqItems").alias("bucket"))
    counts = hashed.join(F.broadcast(candidates), "bucket").groupBy("bucket").agg(F.count("*").alias("n"))
    return materialise(counts.filter(F.col("n") > least).select(F.col("bucket").alias("huge")), "simhash-huge")


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct values of column fp within the radius:
    a and b are in one component of the result exactly if they are in one of the
    graph of all pairs within the radius."""
    found, level = [], 0
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"), "fp") for t, m in enumerate(covering_masks(radius=radius))])).alias("x")).select("x.*")
    while True:
        huge = _huge_buckets(rows, max(HUGE * bucket, 1 << SURE))
        apart = None if huge.isEmpty() else F.xxhash64("tab", "key") == F.col("huge")
        paired = rows if apart is None else rows.join(F.broadcast(huge), apart, "left_anti")
        out = materialise(
            paired.repartition("tab", "key").sortWithinPartitions("tab", "key", "fp").mapInPandas(_pair_buckets(radius, bucket, level), "a long, b long, tab int"),
            f"simhash-links-{level}",
        )
        found.append(out.filter("tab < 0").select("a", "b"))
        more = out.filter("tab >= 0").select(F.col("a").alias("fp"), "tab")
        if apart is not None:
            more = more.union(rows.join(F.broadcast(huge), apart, "left_semi").select("fp", "tab"))
        elif more.isEmpty():
            break
        level += 1
        rows = materialise(more.mapInPandas(_hash_again(radius, level), "tab int, key long, fp long"), f"simhash-rows-{level}")
    links = found[0]
    for x in found[1:]:
        links = links.union(x)
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most `radius` differing
    bits reach. Null and empty texts have fingerprint zero and are linked like any
    other. Equal texts always meet. Null ids are passed over when the smallest is
    chosen; a component without any id has a null one. Repeated ids are separate
    rows. An empty table gives an empty result; further columns play no part. A long
    text is hashed whole, in parts of bounded memory.
    """
    signed = materialise(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    distinct = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius, bucket))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(rooted.join(least, "root").select("fp", "n", "component_id"), "simhash-classes")

    total = signed.count()
    hot = F.broadcast(classes.filter(F.col("n") > total * HOT).select("fp", "component_id"))
    split = signed.join(hot, "fp", "left_anti").join(classes.select("fp", "component_id"), "fp")
    return signed.join(hot, "fp").unionByName(split).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """`docs` with one document of each component, the one whose id is component_id.

    Rows without an id are kept unless their component has a document with one;
    rows that repeat an id are one document and stay or go together. Texts stay where
    they are: the losers' ids are left out by quern.operators.relations.without().
    """
    found = materialise(near_duplicates(docs, id_col, text_col, radius), "simhash-decisions")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    losers = found.groupBy("doc_id").agg(F.max(kept).alias("kept")).filter("NOT kept").select("doc_id")
    return without(docs, materialise(losers, "simhash-losers"), id_col)
