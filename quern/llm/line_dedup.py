"""Line dedup by site-relative frequency: on each host, the pages that contain a line
divided by all pages of the host; lines above the boilerplate ratio go. A line that stands
on one page only isn't repeated and stays, however few pages its host has.

Lines are counted by (host, digest), so a large host is spread over all tasks, and
pre-aggregated before the shuffle. The boilerplate of a host is a short list: there
are at most (distinct lines of a page) / ratio such lines. Lists are broadcast as long as
their digests, which are counted, are at most LISTED: all of them, or those of hosts with
more than HOT of all pages, of which there are fewer than 1 / HOT; the pages of other hosts
are joined to their lists by host. Lists of hot hosts beyond the bound are joined line by
line. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import fresh, materialise

RATIO = 0.05
LEAST_SUPPORT = 2  # pages that contain a line: what stands on one page isn't repeated
HOT = 1 / 1000
LISTED = 500_000  # digests (some 30 MB) that are broadcast


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(line: Column) -> Column:
    return F.md5(F.trim(line))


def _digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _digest))


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO) -> DataFrame:
    """host, pages, lines: the digests of each host's boilerplate, for hosts that have any.
    Lines are compared without surrounding spaces; blank lines are never boilerplate."""
    host = F.col(host_col)
    pages = docs.groupBy(host.alias("page_host")).agg(F.count("*").alias("pages"))
    counts = docs.select(host.alias("host"), F.explode(_digests(F.col(text_col))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    frequent = counts.filter(F.col("n") >= LEAST_SUPPORT).join(pages, F.col("host").eqNullSafe(F.col("page_host")))
    return frequent.filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = RATIO) -> DataFrame:
    """`docs` with their columns, the text without its host's boilerplate lines, and
    n_lines and n_dropped (columns of these names are replaced).

    Null hosts are one host. A null text is an empty one; it has one, blank, line. A long
    text is one array of lines of its row. Repeated rows are pages of their own. An empty
    table gives no rows.
    """
    bad_host, bad, hit, lines_of, row, line = fresh(docs, "host", "bad", "hit", "lines", "row", "line")
    found = materialise(boilerplate(docs, text_col, host_col, ratio), "boilerplate").select(F.col("host").alias(bad_host), F.col("lines").alias(bad), "pages")
    total = docs.count()
    is_hot = F.col("pages") > total * HOT
    every, of_hot = found.agg(F.coalesce(F.sum(F.size(bad)), F.lit(0)), F.coalesce(F.sum(F.when(is_hot, F.size(bad))), F.lit(0))).first()
    on = F.col(host_col).eqNullSafe(F.col(bad_host))

    def cleaned(df: DataFrame) -> DataFrame:
        """`df` has the digests to drop, or more of the host's, in `bad`."""
        hits = F.coalesce(F.array_intersect(F.transform(F.col(lines_of), _digest), F.col(bad)), F.array().cast("array<string>"))
        kept = F.when(F.size(hit) == 0, F.col(lines_of)).otherwise(F.filter(F.col(lines_of), lambda x: ~F.array_contains(F.col(hit), _digest(x))))
        df = df.withColumn(lines_of, _lines(F.col(text_col))).withColumn(hit, hits).withColumns({"n_lines": F.size(lines_of), text_col: F.array_join(kept, "\n"), "n_dropped": F.size(lines_of) - F.size(kept)})
        return df.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")

    if every <= LISTED:
        return cleaned(docs.join(F.broadcast(found.drop("pages")), on, "left"))
    hot, rest = found.filter(is_hot).drop("pages"), found.filter(~is_hot).drop("pages")
    if of_hot <= LISTED:
        marked = docs.join(F.broadcast(hot), on, "left")
        large = marked.filter(F.col(bad).isNotNull())
        small = marked.filter(F.col(bad).isNull()).drop(bad_host, bad)
    else:
        names = F.broadcast(hot.select(bad_host))
        small = docs.join(names, on, "left_anti")
        pages = materialise(docs.join(names, on, "left_semi").withColumn(row, F.monotonically_increasing_id()), "hot-pages")
        own = pages.select(row, host_col, F.explode(_digests(F.col(text_col))).alias(line))
        lists = hot.select(bad_host, F.explode(bad).alias(bad))
        hits = own.join(lists, on & (F.col(line) == F.col(bad)), "left_semi").groupBy(row).agg(F.collect_list(line).alias(bad))
        large = pages.join(hits, row, "left")
    return cleaned(large).unionByName(cleaned(small.join(rest, on, "left")))
