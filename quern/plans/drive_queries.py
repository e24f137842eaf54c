"""A drive made from the pages: fetched whole, and by what changed from scan to scan."""

import uuid

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.session import materialise, remove, shared_dir, table
from quern.sources.drive import Drive

HOST = "^[a-z]+://([^/?#]*)"
ITEMS = f"it AS (SELECT page_id, coalesce(html, '') AS html, coalesce(nullif(regexp_extract(url, '{HOST}', 1), ''), 'none') || '/' || page_id % 4 || '/' || page_id || '.html' AS item_id FROM pages)"


def _items(spark, sf_dir):
    """page_id, item_id and text: pages below their hosts, in four folders each."""
    host = F.coalesce(F.nullif(F.regexp_extract("url", HOST, 1), F.lit("")), F.lit("none"))
    key = F.concat_ws("/", host, F.col("page_id") % 4, F.concat("page_id", F.lit(".html")))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("item_id"), F.coalesce("html", F.lit("")).alias("text"))


def _folders(spark, *names):
    spark.dataSource.register(Drive)
    return [f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in names]


def _put(items, root):
    items.select("item_id", "text").write.format("drive").mode("append").option("path", root).save()


@query(f"WITH {ITEMS} SELECT item_id, md5(html) AS text_md5 FROM it")
def drive_full_fetch(spark, sf_dir):
    """Every page written as a file of a drive, listed, and fetched whole."""
    (root,) = _folders(spark, "drive")
    _put(_items(spark, sf_dir), root)
    read = spark.read.format("drive").option("path", root).option("buckets", 8)
    listed = read.option("contents", False).load().select("item_id", "version")
    whole = read.option("contents", True).load().select("item_id", "version", F.md5("text").alias("text_md5"))
    out = materialise(whole.join(listed, ["item_id", "version"]).select("item_id", "text_md5"), "drive-full")
    remove(spark, root)
    return out


@query(f"""WITH {ITEMS} SELECT 1 AS fetch, item_id, FALSE AS gone, md5(html) AS text_md5 FROM it WHERE page_id % 5 != 0
UNION ALL SELECT 2, item_id, FALSE, md5(html) FROM it WHERE page_id % 5 = 0 AND page_id % 11 != 0
UNION ALL SELECT 2, item_id, FALSE, md5(html || '!') FROM it WHERE page_id % 5 != 0 AND page_id % 7 = 0 AND page_id % 11 != 0
UNION ALL SELECT 2, item_id, TRUE, NULL FROM it WHERE page_id % 5 != 0 AND page_id % 11 = 0""")
def drive_increments(spark, sf_dir):
    """What three fetches bring, each going on from the checkpoint: all that is there; new, rewritten and
    vanished items; and nothing, since nothing changed."""
    root, state, out, mark = _folders(spark, "drive", "snapshots", "fetched", "progress")
    items, p = materialise(_items(spark, sf_dir), "items"), F.col("page_id")

    def fetch(number):
        changed = spark.readStream.format("drive").option("path", root).option("state", state).option("buckets", 8).load()
        changed = changed.select(F.lit(number).alias("fetch"), "item_id", "gone", F.md5("text").alias("text_md5"))
        changed.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    _put(items.filter(p % 5 != 0), root)
    fetch(1)
    text = F.when(p % 11 != 0, F.when(p % 5 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))))
    _put(items.filter((p % 5 == 0) | (p % 7 == 0) | (p % 11 == 0)).withColumn("text", text), root)
    fetch(2)
    fetch(3)
    done = materialise(spark.read.schema("fetch int, item_id string, gone boolean, text_md5 string").parquet(out), "drive-changes")
    for path in (root, state, out, mark):
        remove(spark, path)
    return done
