"""Session, table loading and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}  # the folder of a local master without the setting
_SCOPES: list[list[DataFrame]] = []  # tables written since the scratch() blocks that are open began


def local_session(cores: int | str = "*", app: str = "quern") -> SparkSession:
    """A session for one machine: tests and bench.py. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test layout, `<dir>/<name>.parquet`, file or folder, on any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt by their keys to as many tasks as the session shuffles by, for work that costs much
    a row: a file of one row group is one task's, however many rows it has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only a local master may go without the setting; it then gets a temporary
    folder. On a cluster a missing setting is an error, since a machine-local
    folder would lose files with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.TemporaryDirectory(prefix="spark-quern-", ignore_cleanup_errors=True)  # goes with the process
    return _LOCAL["dir"].name


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` into the shared folder and read it back: cuts the lineage, survives
    lost executors, and lets several consumers read one result. With `keep` it outlives
    the scratch() block that it is written in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    if _SCOPES and not keep:
        _SCOPES[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that materialise() writes within the block are deleted at its end; what is
    to stay must have been written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for df in _SCOPES.pop():
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that nothing reads any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` doesn't have in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        got = f"_quern_{name}"
        while got.lower() in taken:
            got += "_"
        taken.add(got.lower())
        out.append(got)
    return out
