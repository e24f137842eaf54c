"""Incremental ingestion and stateful rules over streams of items and events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_items(items: DataFrame, key: str, time_col: str, delay: str = "1 day") -> DataFrame:
    """Items of a stream whose key didn't come before within `delay` of event time; the
    watermark lets old keys go from state."""
    return items.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour", time_col: str = "ts", by: str = "event_type") -> DataFrame:
    """start, by, n, total per window, batch or stream; rows later than `delay` are left out of a stream."""
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    if events.isStreaming:
        events = events.withWatermark(time_col, delay)
    return events.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, time_col: str = "ts", by: str = "user_id") -> DataFrame:
    """by, start, end, n: runs of events with no pause of `gap`."""
    return events.groupBy(F.session_window(time_col, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def absent(first: DataFrame, second: DataFrame, items: DataFrame, key: str, seen_col: str, now, grace_hours: int = 24) -> DataFrame:
    """Keys of `items` that two complete scans both lack and that weren't seen for `grace_hours`."""
    gone = items.join(first.select(key), key, "left_anti").join(second.select(key), key, "left_anti")
    return gone.filter(F.col(seen_col) <= F.lit(now) - F.make_interval(hours=F.lit(grace_hours))).select(key)


def stuck(beats: DataFrame, key: str, time_col: str, now, minutes: int) -> DataFrame:
    """Keys whose last beat is older than so many minutes, with that beat."""
    last = beats.groupBy(key).agg(F.max(time_col).alias("last_seen"))
    return last.filter(F.col("last_seen") < F.lit(now) - F.make_interval(mins=F.lit(minutes)))


def requests_in_window(events: DataFrame, by: str, time_col: str, seconds: int) -> DataFrame:
    """Events with the number of the key's events in the last `seconds`, itself included."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    order = Window.partitionBy(by).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("n_recent", F.count("*").over(order))


PARTS = 16  # a merged table's parts by key to begin with; a change rewrites the parts that it touches only
PART_BYTES = 256 << 20  # a part that is larger is written as two by the next batch that touches it
#: A part's number is level * _LEVEL + path * _PATH + base: base is the key's hash by the number of parts to begin with, and
#: path the first `level` bits of the hash, since a part of one level is split into two of the next.
_LEVEL, _PATH = 1 << 48, 1 << 20


def _split_parts(parts: Iterable[int]) -> dict[int, set[int]]:
    """The parts that the given ones were split from, by level."""
    out: dict[int, set[int]] = {}
    for part in parts:
        level, path, base = part // _LEVEL, part % _LEVEL // _PATH, part % _PATH
        for above in range(level):
            out.setdefault(above, set()).add(above * _LEVEL + (path >> (level - above)) * _PATH + base)
    return out


def _part_of(hashed: Column, split: dict[int, set[int]], first: int) -> Column:
    """The part of a key's hash: as deep as parts were split."""
    base = at = F.pmod(hashed, F.lit(first)).cast("long")
    for level in sorted(split):
        below = F.lit((level + 1) * _LEVEL) + F.shiftrightunsigned(hashed, 63 - level) * F.lit(_PATH) + base
        at = F.when(at.isin(sorted(split[level])), below).otherwise(at)
    return at


def merge_into(target: str, key: str, order: str, parts: int = PARTS, keep_own: bool = False, part_bytes: int = PART_BYTES):
    """A foreachBatch function that merges changes into the Parquet table at `target`: the
    latest row of each key stays. Deletions are rows with a mark that merged() knows, and stay,
    so that older rows that come later don't bring their key back. With `keep_own`, a row that is there stays as it is. Rows without a key are left out.

    Rows lie in parts by the hash of their key, and a batch writes new versions of the parts
    that it has keys of, `merge_part=<p>/merge_version=<batch>`, in the place of a batch that failed before its
    end; merged() reads the newest of each. A part of more than `part_bytes` is written as two by the hash's next bit, so
    that parts, and what a batch rewrites for a key, stay of one size as the table grows. `parts`, how many there are
    to begin with, is a table's own and can't be changed later. Versions that no reader needs go by compact().
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = dict(_newest(spark, target, before=number))
        split = _split_parts(now)
        hashed = F.xxhash64(key)
        batch = batch.filter(F.col(key).isNotNull()).withColumn("merge_part", _part_of(hashed, split, parts))
        touched = [r.merge_part for r in batch.select("merge_part").distinct().collect()]
        if not touched:
            return
        rows = batch.withColumn("merge_new", F.lit(1))
        gone = {p for found in split.values() for p in found}
        paths = {p: f"{target}/merge_part={p}/merge_version={now[p]}" for p in touched if p in now and p not in gone}
        if paths:
            old = spark.read.option("basePath", target).parquet(*paths.values()).drop("merge_version")
            rows = rows.unionByName(old.withColumn("merge_part", F.col("merge_part").cast("long")).withColumn("merge_new", F.lit(0)))
        large = [p for p, path in paths.items() if _bytes(spark, path) > part_bytes]
        for p in large:
            split.setdefault(p // _LEVEL, set()).add(p)
        if large:
            rows = rows.withColumn("merge_part", _part_of(hashed, split, parts))
        rank = F.struct(-F.col("merge_new"), F.col(order)) if keep_own else F.struct(F.col(order), F.col("merge_new"))
        others = [c for c in batch.columns if c != "merge_part"]
        latest = rows.groupBy("merge_part", key).agg(F.max_by(F.struct(*others), rank).alias("row")).select("merge_part", "row.*")
        latest.select(*others, "merge_part", F.lit(number).alias("merge_version")).repartition("merge_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("merge_part", "merge_version").parquet(target)

    return run


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def _newest(spark: SparkSession, target: str, before: int | None = None) -> list[tuple[int, int]]:
    """(part, version) of the newest version of each part, below a batch number if one is given."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found: dict[int, int] = {}
    for version in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/merge_part=*/merge_version=*")):
        path = version.getPath()
        part, v = int(path.getParent().getName().removeprefix("merge_part=")), int(path.getName().removeprefix("merge_version="))
        if before is None or v < before:
            found[part] = max(v, found.get(part, -1))
    return sorted(found.items())


def _current(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(part, version) of what the table is made of: the newest of the parts that weren't split."""
    newest = _newest(spark, target)
    gone = {p for found in _split_parts(p for p, _ in newest).values() for p in found}
    return [(p, v) for p, v in newest if p not in gone]


def merged(spark: SparkSession, target: str, deleted: str | None = None) -> DataFrame:
    """The table that merge_into() keeps at `target`, as it is now; without what the boolean
    column `deleted` marks."""
    rows = spark.read.option("basePath", target).parquet(*[f"{target}/merge_part={p}/merge_version={v}" for p, v in _current(spark, target)]).drop("merge_part", "merge_version")
    return rows.filter(~F.coalesce(deleted, F.lit(False))).drop(deleted) if deleted else rows


def compact(spark: SparkSession, target: str) -> int:
    """Delete all but the newest version of each part, and parts that were split; how many went. Not while a batch is written."""
    newest, gone = set(_current(spark, target)), 0
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for version in fs.globStatus(path(f"{target}/merge_part=*/merge_version=*")):
        at = version.getPath()
        if (int(at.getParent().getName().removeprefix("merge_part=")), int(at.getName().removeprefix("merge_version="))) not in newest:
            gone += bool(fs.delete(at, True))
    return gone


def ingest(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str, key: str, order: str, **how) -> None:
    """Merge everything that is there by now into `target`, going on where the checkpoint stands."""
    query = stream.writeStream.foreachBatch(merge_into(target, key, order, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def undistilled(messages: DataFrame, marks: DataFrame, by: str, order: str, pause, now) -> DataFrame:
    """Messages after their conversation's mark (by, mark; none: all), of conversations that have
    been quiet for `pause` (an interval): what is to be distilled next. new_marks() of it
    are the marks from then on."""
    fresh = messages.join(marks.select(by, "mark"), by, "left").filter(F.col("mark").isNull() | (F.col(order) > F.col("mark"))).drop("mark")
    quiet = messages.groupBy(by).agg(F.max("at").alias("_last")).filter(F.col("_last") <= F.lit(now) - pause).select(by)
    return fresh.join(quiet, by, "left_semi")


def new_marks(distilled: DataFrame, marks: DataFrame, by: str, order: str) -> DataFrame:
    return marks.select(by, "mark").unionByName(distilled.select(by, F.col(order).alias("mark"))).groupBy(by).agg(F.max("mark").alias("mark"))


def log_from(log: DataFrame, by: str, order: str, offset: int) -> DataFrame:
    """Rows of each log from an offset (0: the first) on, with `offset`."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return log.withColumn("offset", place).filter(F.col("offset") >= offset)


def reclaimable(claims: DataFrame, key: str, now, minutes: int) -> DataFrame:
    """Keys whose newest claim (key, at, state) is still 'running' but older than so many minutes."""
    last = claims.groupBy(key).agg(F.max_by(F.struct("at", "state"), "at").alias("c"))
    return last.filter((F.col("c.state") == "running") & (F.col("c.at") < F.lit(now) - F.make_interval(mins=F.lit(minutes)))).select(key)
