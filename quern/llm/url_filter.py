"""URL filter by a temporal list join: dated list entries become validity intervals, and
an as-of join judges every capture by the entries active when it was fetched.

A list of counted size is broadcast. With a longer one, keys that no entry has go on the
map side, by a filter of fixed size; entries of keys with over HOT of the rest, of which
there are fewer than 1 / HOT, are broadcast or, beyond the bound, salted; the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.relations import probably_among
from quern.session import materialise

BROADCAST_ROWS = 200_000  # intervals (under 50 MB) that are broadcast; a longer list is shuffled
SALTS = 16  # parts that each hot key's captures are dealt into when its intervals are too many
HOT = 1 / 1000
SKETCH_TASKS = 512  # at most so many counter sets of 1/HOT entries meet in the merge
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for null and for what isn't an absolute URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def keys_of(url: Column) -> Column:
    """The patterns that match a URL: its host and parent domains, and its host with each
    prefix of whole path segments."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit("")), "/"), lambda x: x != "")
    counts = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    domains = F.transform(counts(labels), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(counts(parts), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.array_distinct(F.when(F.size(labels) > 0, F.concat(domains, paths)).otherwise(F.array().cast("array<string>")))


def pattern_of(entry: Column) -> Column:
    """A list entry as keys_of writes it: the host lower-cased, the path in its own case."""
    host = F.substring_index(entry, "/", 1)
    return F.concat(F.lower(host), F.substr(entry, F.length(host) + 1))


def validity(entries: DataFrame) -> DataFrame:
    """pattern, valid_from, valid_to (null: still listed) from pattern, action ('add' or
    'remove') and at. Adding what is listed and removing what isn't change nothing; of
    entries for one moment, adding wins. Entries with a null in any of the three, or
    with another action, are left out."""
    events = entries.filter("pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    events = events.groupBy(pattern_of(F.col("pattern")).alias("pattern"), "at").agg(F.max(F.col("action") == "add").alias("listed"))
    by = Window.partitionBy("pattern").orderBy("at")
    changes = events.withColumn("before", F.lag("listed", 1, False).over(by)).filter("listed != before")
    return changes.withColumn("valid_to", F.lead("at").over(by)).filter("listed").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: page_id, host, fetched_at, blocked, pattern, listed_since.

    pattern is the longest that matches and was listed at fetch time (from inclusive,
    to exclusive). Captures without a URL or time match nothing. Repeated captures are
    judged alike; null ids are rows like others; empty tables give no rows, or no
    blocked ones; further columns play no part. A long URL is matched whole, by as many
    keys as it has labels and path segments.
    """
    listed = materialise(validity(entries), "url-validity")
    seen = captures.select(F.col(url_col).alias("url"), F.col(time_col).alias("at")).filter("url IS NOT NULL AND at IS NOT NULL").distinct()
    keyed = seen.select("url", "at", F.explode(keys_of(F.col("url"))).alias("key"))
    on = (F.col("key") == F.col("pattern")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    if listed.count() <= BROADCAST_ROWS:
        matched = keyed.join(F.broadcast(listed), on)
    else:
        keyed = materialise(probably_among(keyed, listed.select("pattern"), "key"), "url-keys")
        common = keyed.coalesce(SKETCH_TASKS).stat.freqItems(["key"], HOT).select(F.explode("key_freqItems").alias("common"))
        common = F.broadcast(materialise(common, "url-common"))
        hot, entries = keyed.join(common, F.col("key") == F.col("common"), "left_semi"), listed.join(common, F.col("pattern") == F.col("common"), "left_semi")
        if entries.count() <= BROADCAST_ROWS:
            matched = hot.join(F.broadcast(entries), on)
        else:
            hot = hot.withColumn("salt", F.pmod(F.xxhash64("url", "at"), F.lit(SALTS)).cast("int"))
            salted = entries.withColumn("list_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            matched = hot.join(salted, on & (F.col("salt") == F.col("list_salt"))).drop("salt", "list_salt")
        matched = matched.unionByName(keyed.join(common, F.col("key") == F.col("common"), "left_anti").join(listed, on))
    best = matched.groupBy("url", "at").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "valid_from")).alias("best"))
    best = best.select(F.col("url").alias("best_url"), F.col("at").alias("best_at"), "best")
    shown = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"))
    return shown.join(best, (F.col("url") == F.col("best_url")) & (F.col("fetched_at") == F.col("best_at")), "left").select(
        "page_id", host_of(F.col("url")).alias("host"), "fetched_at", F.col("best").isNotNull().alias("blocked"),
        F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("listed_since"),
    )
