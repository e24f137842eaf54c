"""A connector over a feed: items after a cursor, in batch or as a stream.

The feed is a folder of JSON-lines files on any store that Spark reads, one a fetch. The
stream's checkpoint is the cursor: it knows the files that were read. Files are read by
the executors, in parts, and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "guid string, title string, link string, updated string"


def item_key(guid: Column, link: Column, title: Column) -> Column:
    """What identifies an item of a feed: its guid, else its link, else its title."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(guid), given(link), given(title), F.lit(""))


def _items(rows: DataFrame) -> DataFrame:
    return rows.select(item_key(F.col("guid"), F.col("link"), F.col("title")).alias("item_id"), "title", "link", "updated")


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, title, link, updated of all items."""
    return _items(spark.read.schema(SCHEMA).json(folder))


def stream_feed(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """The same as a stream: new files as they come, so many a batch."""
    return _items(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder))
