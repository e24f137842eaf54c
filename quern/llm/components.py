"""Connected components over an edge table by alternating large-star and small-star
steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Each step is a minimum by node and a join; nothing is gathered by node, on the
driver or in a task. AQE splits the join partitions of nodes with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import discard, materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """From links (a, b): node, root for every node but the roots; root is the
    least node of the component. Self-links and repeats do no harm."""
    now = materialise(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        new = materialise(small, "components")
        new_mark = _mark(new)
        discard(now)
        now, done, mark = new, new_mark == mark, new_mark
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
