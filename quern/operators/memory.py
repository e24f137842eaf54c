"""Memories and conversations: lexical recall, budgets, windows over turns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.relations import similar_across

FLOOR = 0.15
QUERIES, SLICE = 256, 512  # queries that a pass over the items weighs, and items at once


def _pairs(words: Column) -> Column:
    """Neighbouring words, joined by a space."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(T.strings())


def _terms(text: Column) -> Column:
    """Distinct words of two characters or more, weight 1, and pairs of neighbouring words, weight 2."""
    words = T.words(F.coalesce(text, F.lit("")))
    uni = F.transform(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)), lambda w: F.struct(w.alias("term"), F.lit(1).alias("weight")))
    return F.concat(uni, F.transform(F.array_distinct(_pairs(words)), lambda w: F.struct(w.alias("term"), F.lit(2).alias("weight"))))


def recall(items: DataFrame, queries: DataFrame, floor: float = FLOOR) -> DataFrame:
    """query_id, item_id, score of items (item_id, content, importance) for queries (query_id, query).

    score is the weight of the query's words (1) and word pairs (2) that the item has, over
    the weight of all of them, and 0.01 a point of importance; items without any shared
    term, or under the floor, are left out.

    Queries come in blocks, whose terms are broadcast with their weights; an item's terms meet
    all queries of a block where the item lies, and only what reaches the floor leaves the
    task: a common word brings no rows of items and queries together.
    """
    asked = queries.filter("query_id IS NOT NULL").select("query_id", _terms(F.col("query")).alias("terms")).orderBy("query_id")
    words = T.words(F.coalesce(F.col("content"), F.lit("")))
    # Words and pairs are made distinct within their row.
    own = items.select("item_id", F.col("importance").cast("double").alias("importance"), words.alias("words"))
    own = own.select("item_id", "importance", F.array_distinct(F.concat("words", _pairs(F.col("words")))).alias("terms"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, importance double, hits long, total long"
    out, rows = None, asked.toLocalIterator()
    while block := list(islice(rows, QUERIES)):
        found = own.mapInArrow(_weigh(block, floor, items.sparkSession), kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = items.sparkSession.createDataFrame([], kinds)
    score = F.round(F.col("hits") / F.col("total") + 0.01 * F.col("importance"), 6)
    return out.select("query_id", "item_id", score.alias("score")).filter(F.col("score") >= floor)


def _weigh(block: list, floor: float, spark):
    number = {t: k for k, t in enumerate(dict.fromkeys(t["term"] for r in block for t in r.terms))}
    pairs = np.array([(number[t["term"]], q, t["weight"]) for q, r in enumerate(block) for t in r.terms], np.int64).reshape(-1, 3)
    sent = spark.sparkContext.broadcast((pa.array(list(number), pa.string()), pairs, pa.array([r.query_id for r in block])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs, ids = sent.value
        weight = np.zeros((len(known), len(ids)))
        weight[pairs[:, 0], pairs[:, 1]] = pairs[:, 2]
        total = weight.sum(axis=0)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column("terms")
                term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                has = np.zeros((part.num_rows, len(known)))
                has[row[term >= 0], term[term >= 0]] = 1
                hits = has @ weight
                extra = 0.01 * np.nan_to_num(part.column("importance").to_numpy(zero_copy_only=False).astype(float))
                r, q = np.nonzero((hits > 0) & (hits / np.maximum(total, 1) + extra[:, None] >= floor - 1e-5))
                where = pa.array(r)
                columns = [ids.take(pa.array(q)), part.column("item_id").take(where), part.column("importance").take(where), pa.array(hits[r, q].astype(np.int64)), pa.array(total[q].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "item_id", "importance", "hits", "total"])

    return run


def past_messages(hits: DataFrame, messages: DataFrame, needles: DataFrame, limit: int, width: int = 120) -> DataFrame:
    """query_id, place, conv_id, turn, snippet: of ranked hits (query_id, conv_id, turn, rank) the
    first `limit` of other conversations than the query's own (needles: query_id, conv_id as
    own_conv, word); two more than the limit are looked at. A snippet is `width` characters
    around the word's first place in the message (its beginning, if it isn't there)."""
    top = hits.filter(F.col("rank") <= limit + 2).join(needles, "query_id").filter(~F.col("conv_id").eqNullSafe(F.col("own_conv")))
    order = Window.partitionBy("query_id").orderBy("rank")
    kept = top.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).join(messages.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    at = F.greatest(F.instr(F.lower("text"), F.lower("word")) - F.lit(width // 2), F.lit(1))
    return kept.select("query_id", "place", "conv_id", "turn", F.substr("text", at, F.lit(width)).alias("snippet"))


def within_budget(ranked: DataFrame, by: str, most: int, budget: int) -> DataFrame:
    """Rows in order of rank while they fit: at most `most`, and `budget` for the sum of
    cost; a row that doesn't fit is passed over. A group is one query's bounded ranking."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used, keep = 0, []
        for k, cost in group.sort_values("rank")["cost"].items():
            if len(keep) == most:
                break
            if used + cost <= budget:
                used, keep = used + cost, [*keep, k]
        return group.loc[keep]

    return ranked.groupBy(by).applyInPandas(run, ranked.schema)


def recent_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= n).drop("_at")


def context_cut(turns: DataFrame, budget: int, chars_per_token: float = 4.0, extra: int = 3) -> DataFrame:
    """conv_id, cut, turn_start: where the longest suffix within the token budget begins that
    doesn't begin with a tool's answer; if not even the newest part fits, where that begins.
    turn_start is the user's turn that the cut lies within, null if the cut is one itself or
    none comes before. A conversation of tools' answers only is kept whole."""
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / chars_per_token) + extra
    after = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    user = F.col("role") == "user"
    at = turns.select("conv_id", "turn", "role", F.sum(tokens).over(after).alias("suffix"), F.max(F.when(user, F.col("turn"))).over(before).alias("asked"))
    legal = F.col("role") != "tool"
    of = at.groupBy("conv_id").agg(
        F.coalesce(F.min(F.when(legal & (F.col("suffix") <= budget), F.col("turn"))), F.max(F.when(legal, F.col("turn"))), F.min("turn")).alias("cut"),
    )
    found = of.join(at.select("conv_id", F.col("turn").alias("cut"), "role", "asked"), ["conv_id", "cut"])
    return found.select("conv_id", "cut", F.when(F.col("role") != "user", F.col("asked")).alias("turn_start"))


def rounds(turns: DataFrame, most: int) -> DataFrame:
    """conv_id, round, question, answer: the last `most` user turns that an assistant's turn answers,
    the next one after it before another question, oldest first."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = turns.filter(F.col("role").isin("user", "assistant"))
    at = said.withColumns({"_next": F.lead("role").over(order), "_answer": F.lead("text").over(order)})
    pairs = at.filter((F.col("role") == "user") & (F.col("_next") == "assistant"))
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = pairs.withColumn("_at", newest).filter(F.col("_at") <= most)
    return kept.select("conv_id", F.row_number().over(order).alias("round"), F.col("text").alias("question"), F.col("_answer").alias("answer"))


def batches(chunks: DataFrame, by: str, order: list[str], budget: int) -> DataFrame:
    """`chunks` with `batch` from 0: in order, each batch as many as the budget of characters
    allows; one that is longer has a batch of its own. The running sum is a fold over a
    document's lengths, not its texts."""
    sizes = chunks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.length("content").alias("n")))).alias("_all"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("numbers"))

    def add(s: Column, x: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + x["n"] > budget)
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(batch.alias("batch"), F.when(full, x["n"]).otherwise(s["used"] + x["n"]).alias("used"), F.concat(s["numbers"], F.array(batch)).alias("numbers"))

    numbered = sizes.select(by, F.explode(F.arrays_zip(F.col("_all"), F.aggregate("_all", start, add, lambda s: s["numbers"]).alias("batch"))).alias("_x"))
    return chunks.join(numbered.select(by, *[F.col(f"_x._all.{c}").alias(c) for c in order], F.col("_x.batch").alias("batch")), [by, *order])


def resolve_topics(surfaces: DataFrame, topics: DataFrame, limit: float = 0.8, least: int = 4) -> DataFrame:
    """surface, topic, tier of surfaces (surface) against topics (topic, aliases): 'reused' if it is
    the topic as written, 'exact' if letters and digits agree or an alias is equal, 'fuzzy' for the
    topic whose character pairs are most alike, at `limit` or more, where both have `least`
    characters; 'new' else. Names meet on their rarest pairs; the least topic wins a tie."""
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    asked = surfaces.select("surface").distinct()
    named = topics.select("topic", key(F.col("topic")).alias("_key")).union(topics.select("topic", F.explode("aliases").alias("_key")))
    exact = asked.withColumn("_key", F.explode(F.array(key(F.col("surface")), F.col("surface")))).join(named, "_key").filter("_key != ''")
    exact = exact.groupBy("surface").agg(F.max_by("topic", F.struct((F.col("topic") == F.col("surface")), F.col("topic"))).alias("_topic"))
    left = asked.join(exact, "surface", "left_anti").filter(F.length("surface") >= least)
    wide = topics.select("topic").filter(F.length("topic") >= least)
    near = similar_across(left, wide, limit).toDF("surface", "topic", "_like")
    fuzzy = near.groupBy("surface").agg(F.min_by("topic", F.struct(-F.col("_like"), F.col("topic"))).alias("_near"))
    at = asked.join(exact, "surface", "left").join(fuzzy, "surface", "left")
    tier = F.when(F.col("_topic") == F.col("surface"), "reused").when(F.col("_topic").isNotNull(), "exact").when(F.col("_near").isNotNull(), "fuzzy").otherwise("new")
    return at.select("surface", F.coalesce("_topic", "_near").alias("topic"), tier.alias("tier"))
