"""Exact dedup by a heavy-hitter split.

Misra-Gries counters (DataFrame.stat.freqItems) find every digest that may hold
more than `support` of all rows, at most 1/support of them whatever the input.
One aggregation over those candidates verifies them and picks their winners,
which are broadcast: rows of heavy groups are decided on the map side and never
shuffled. All other digests are shuffled as usual, in groups of at most
`support` of all rows.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.decisions import keep_decided
from quern.session import materialise

SUPPORT = 1 / 1000  # bounds candidates and broadcast winners at 1000 rows
SKETCH_TASKS = 512  # at most so many counter sets of 1/support entries meet in the merge


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def duplicate_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text is an empty one. Of equal texts
    the row with the largest id is kept. Null ids rank lowest; keep_id is null
    if a group has no id at all. Rows that repeat both id and text are a tie, of
    which one is kept. An empty table gives an empty result. Further columns of
    `docs`, whatever their names, play no part. A long text is digested whole.
    """
    digests = materialise(
        docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")),
        "exact-digests",
    )
    winner = F.max(F.struct("doc_id", "row")).alias("win")
    candidates = (
        digests.coalesce(SKETCH_TASKS).stat.freqItems(["text_sha256"], support)
        .select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    )
    verified = digests.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(winner, F.count("*").alias("group_size"))
    heavy = materialise(verified.filter("group_size > 1"), "exact-winners")

    split = digests.join(F.broadcast(heavy), "text_sha256", "left")
    hot = split.filter("group_size IS NOT NULL")
    # Groups are combined on the map side and joined back; AQE may split the join's partitions.
    rest = split.filter("group_size IS NULL").select("doc_id", "text_sha256", "row")
    groups = rest.groupBy("text_sha256").agg(winner, F.count("*").alias("group_size"))
    return hot.unionByName(rest.join(groups, "text_sha256").select(*hot.columns)).select(
        "doc_id", F.col("win.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("win.row")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of `docs` that duplicate_decisions() keeps, with their columns.

    Texts stay where they are; of rows that repeat id and text, one stays. Nulls, empty and long texts are as in duplicate_decisions(); an empty table gives
    no rows, and further columns are passed on whatever their names.
    """
    decisions = materialise(duplicate_decisions(docs, id_col, text_col, support), "exact-decisions")
    return keep_decided(docs, decisions.select("doc_id", "kept", F.col("text_sha256").alias("proof")), id_col, text_digest(F.col(text_col)), once=True)
