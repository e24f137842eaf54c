"""Evaluation: precision, recall, NDCG, MRR and MAP of ranked lists, BLEU and ROUGE of texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(results: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (3, 10)) -> DataFrame:
    """query_id, precision, recall, ndcg<k>, mrr, map, from results (query_id, doc_id, rank
    from 1) and relevant (query_id, doc_id).

    The ideal list of NDCG is as long as the relevant documents or the returned ones,
    whichever are fewer; MAP divides by the hits. Queries without results score 0;
    queries without relevant documents are left out.
    """
    truth = relevant.select("query_id", "doc_id").distinct()
    wanted = truth.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = results.join(truth.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("hits_so_far", F.sum("hit").over(order))
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    of = hits.groupBy("query_id").agg(
        F.count("*").alias("n_returned"), F.sum("hit").alias("n_hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits_so_far") / F.col("rank"))).alias("precision_sum"),
        *[F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg{k}") for k in cuts],
    )
    at = wanted.join(of, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def ideal(k: int):
        n = F.least(F.col("n_relevant"), F.col("n_returned"), F.lit(k)).cast("int")
        return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))

    return at.select(
        "query_id",
        F.round(zero(F.col("n_hits") / F.col("n_returned")), 6).alias("precision"),
        F.round(zero(F.col("n_hits") / F.col("n_relevant")), 6).alias("recall"),
        *[F.round(zero(F.when(ideal(k) > 0, F.col(f"dcg{k}") / ideal(k))), 6).alias(f"ndcg{k}") for k in cuts],
        F.round(zero(1 / F.col("first_hit")), 6).alias("mrr"),
        F.round(zero(F.col("precision_sum") / F.col("n_hits")), 6).alias("map"),
    )


#: Words of the text metrics: Han runs, runs of Latin letters, digits and inner signs, single signs. Fixed value.
WORD = r"[一-鿿㐀-䶿]+|[a-zA-Z0-9_.,!?]+|[^a-zA-Z0-9_\s]"


def sentences(text: Column) -> Column:
    """Parts between full stops, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[。.]"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def metric_words(part: Column) -> Column:
    """Words and signs of a sentence, and Han runs as overlapping pairs (a single one stays)."""
    pairs = lambda w: F.regexp_extract_all(w, F.lit("(?=(..))"), F.lit(1))
    found = F.regexp_extract_all(part, F.lit(WORD), F.lit(0))
    return F.flatten(F.transform(found, lambda w: F.when(w.rlike("^[一-鿿㐀-䶿]{2,}$"), pairs(w)).otherwise(F.array(w))))


def _grams(words: list[str], n: int) -> Counter:
    """How often each run of n words is there."""
    return Counter(zip(*(words[k:] for k in range(n))))


def _f(shared: Column, hyp: Column, ref: Column) -> Column:
    p, r = F.when(hyp > 0, shared / hyp).otherwise(0.0), F.when(ref > 0, shared / ref).otherwise(0.0)
    return 2 * p * r / (p + r + 1e-8)


def text_metrics(pairs: DataFrame) -> DataFrame:
    """pair_id, bleu1, bleu2, bleu4, rouge1, rouge2 of (pair_id, generated, truth), null texts
    empty. pair_id is unique.

    n-grams are counted within their row, lower-cased for BLEU. BLEU has clipped
    precisions smoothed by one in both counts at every order, equal weights, and a brevity
    penalty; orders that the generated text is too short for don't count, and without any it is
    0. ROUGE is F over sets of grams.
    """
    words = lambda c: F.flatten(F.transform(sentences(F.col(c)), metric_words))
    at = pairs.select("pair_id", words("generated").alias("h"), words("truth").alias("r"))
    # Both spellings as columns: Spark's lower case.
    at = at.withColumns({f"{side}_low": F.transform(side, lambda w: F.lower(w)) for side in ("h", "r")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [[] for _ in range(8)]
            for h, r, low_h, low_r in zip(*(batch.column(c).to_pylist() for c in ("h", "r", "h_low", "r_low")), strict=True):
                for out, n in zip(made, (1, 2, 3, 4)):
                    own, other = _grams(low_h, n), _grams(low_r, n)
                    out.append((own.total(), (own & other).total()))
                for out, n in zip(made[4:], (1, 2)):
                    own, other = set(_grams(h, n)), set(_grams(r, n))
                    out.append((len(own & other), len(own), len(other)))
                made[6].append(len(h))
                made[7].append(len(r))
            bleu = [pa.array(list(x), pa.int64()) for n in range(4) for x in zip(*made[n])]
            rouge = [pa.array(list(x), pa.int64()) for n in (4, 5) for x in zip(*made[n])]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), *bleu, *rouge, *(pa.array(x, pa.int64()) for x in made[6:])], ["pair_id", *names])

    names = [f"{c}{n}" for n in (1, 2, 3, 4) for c in ("total", "clipped")] + [f"{c}{n}" for n in (1, 2) for c in ("shared", "own", "other")] + ["size_h", "size_r"]
    counts = at.mapInArrow(run, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in names)}")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    log_precision = lambda n, most: F.when(F.col(f"total{n}") > 0, F.log((F.col(f"clipped{n}") + 1) / (F.col(f"total{n}") + 1)) / most)
    # The first order is there if any is; without it the score is 0.
    sums = lambda most: F.when(F.col("total1") > 0, reduce(lambda x, y: x + y, [zero(log_precision(n, most)) for n in range(1, most + 1)]))
    short = F.when(F.col("size_h") > F.col("size_r"), 1.0).otherwise(F.exp(1 - F.col("size_r") / F.col("size_h")))
    brevity = F.when(F.col("size_h") > 0, short).otherwise(0.0)
    return counts.select(
        "pair_id", *[zero(brevity * F.exp(sums(m))).alias(f"bleu{m}") for m in (1, 2, 4)], *[_f(F.col(f"shared{n}"), F.col(f"own{n}"), F.col(f"other{n}")).alias(f"rouge{n}") for n in (1, 2)]
    )


SLICE = 64  # pairs whose words a task holds as Python's at once


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _prefix_lengths(x: list[str], y: list[str]) -> list[list[int]]:
    """Lengths of the longest common subsequences of all pairs of prefixes."""
    out = [[0] * (len(y) + 1)]
    for a in x:
        above, row = out[-1], [0]
        for j, b in enumerate(y):
            row.append(max(above[j] + (a == b), above[j + 1], row[j]))
        out.append(row)
    return out


def on_a_longest(x: list[str], y: list[str]) -> set[str]:
    """Words that lie on some longest common subsequence of two word lists: those of equal places
    that a longest one before them and a longest one after them make up to the longest of all.
    As every longest one counts, there are no ties to break."""
    both = set(x) & set(y)  # others lie on none
    x, y = [a for a in x if a in both], [b for b in y if b in both]
    before, after = _prefix_lengths(x, y), _prefix_lengths(x[::-1], y[::-1])
    most, n, m = before[-1][-1], len(x), len(y)
    return {a for i, a in enumerate(x) for j, b in enumerate(y) if a == b and before[i][j] + 1 + after[n - i - 1][m - j - 1] == most}


def rouge_l(pairs: DataFrame) -> DataFrame:
    """pair_id, rougel of (pair_id, generated, truth): F over distinct words, the shared ones those
    that a longest common subsequence of some pair of their sentences holds. The table of a
    sentence pair is all that a task holds."""
    of = lambda c: F.transform(sentences(F.col(c)), metric_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = []
            for hyp, ref in zip(batch.column("h").to_pylist(), batch.column("r").to_pylist(), strict=True):
                union = set().union(*(on_a_longest(r, h) for r in ref for h in hyp))
                own, other = len({w for s in hyp for w in s}), len({w for s in ref for w in s})
                p, r = len(union) / own if own else 0.0, len(union) / other if other else 0.0
                scores.append(2 * p * r / (p + r + 1e-8))
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(scores, pa.float64())], ["pair_id", "rougel"])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", of("generated").alias("h"), of("truth").alias("r")).mapInArrow(run, f"pair_id {kind}, rougel double")


#: The twelve metrics: of ranked lists, and of texts.
METRICS = {"retrieval": ("precision", "recall", "ndcg3", "ndcg10", "mrr", "map"), "generation": ("bleu1", "bleu2", "bleu4", "rouge1", "rouge2", "rougel")}


def mean_metrics(scores: DataFrame) -> DataFrame:
    """metric, mean, n over all rows that have it, for the columns that are metrics."""
    names = [m for family in METRICS.values() for m in family if m in scores.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("x")
    return scores.select(rows).select("x.*").groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
