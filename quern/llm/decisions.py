"""Decisions on rows, made on ids and digests, applied to wide rows that stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.relations import without
from quern.session import fresh, materialise


def keep_decided(docs: DataFrame, decisions: DataFrame, id_col: str, proof: Column, once: bool = False) -> DataFrame:
    """The rows of `docs` whose decision (doc_id, kept, proof) says so, with their columns.

    Ids of which every row goes are left out by quern.operators.relations.without(). Rows of
    an id that has rows of both kinds, which only repeated ids can have, are kept if a kept
    decision has their id and `proof`; with `once`, one row of those that share both.
    """
    ids = decisions.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("all"))
    ids = materialise(ids.filter("NOT all"), "losers")
    kept = without(docs, ids.select("doc_id"), id_col)
    mixed = ids.filter("some").select("doc_id")
    if mixed.isEmpty():
        return kept
    at, of, own = fresh(docs, "at", "of", "own")
    mixed = mixed.toDF(at)
    same_id = F.col(id_col).eqNullSafe(F.col(at))
    winners = decisions.filter("kept").join(mixed, F.col("doc_id").eqNullSafe(F.col(at)), "left_semi").select(F.col("doc_id").alias(at), F.col("proof").alias(of))
    again = docs.join(mixed, same_id, "left_semi").withColumn(own, proof).join(winners, same_id & (F.col(own) == F.col(of)), "left_semi")
    again = again.dropDuplicates([id_col, own]) if once else again
    return kept.unionByName(again.select(*docs.columns))
