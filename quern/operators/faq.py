"""Questions and answers as chunks: negatives, deepening retrieval, bodies, snippets, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

DEPTHS, MOST = 5, 500  # rounds of retrieval, and the depth of the last one at most


def plain(question: Column) -> Column:
    return F.lower(F.trim(question))


def without_negatives(hits: DataFrame, queries: DataFrame, faqs: DataFrame, by: str = "query_id") -> DataFrame:
    """Hits (by, doc_id) without those whose entry (doc_id, negatives) names the query (by, query)
    itself as one that it doesn't answer; case and outer spaces don't count."""
    named = faqs.select("doc_id", F.explode("negatives").alias("_no")).select("doc_id", plain(F.col("_no")).alias("_no")).filter("_no != ''").distinct()
    barred = queries.select(by, plain(F.col("query")).alias("_no")).join(named, "_no").select(by, "doc_id")
    return hits.join(barred, [by, "doc_id"], "left_anti")


def depths(wanted: int) -> list[int]:
    """How deep each round looks: three times what is wanted, then twice as deep again and again."""
    return list(dict.fromkeys(min(3 * wanted << k, MOST) for k in range(DEPTHS)))


def deepened(ranked: DataFrame, barred: DataFrame, wanted: int, by: str = "query_id") -> DataFrame:
    """by, doc_id, score, depth: what retrieval gives that looks deeper until `wanted` different
    entries are left after the barred (by, doc_id) are gone, nothing more is found, or the rounds
    are over; each entry with its best score. `ranked` has by, doc_id, score and rank, to MOST."""
    rows = ranked.join(barred.select(by, "doc_id", F.lit(True).alias("_out")), [by, "doc_id"], "left")
    first = Window.partitionBy(by, "doc_id").orderBy("rank")
    counted = (F.col("_out").isNull() & (F.row_number().over(first) == 1)).cast("int")
    rows = rows.withColumn("_new", counted)
    steps = depths(wanted)
    at = rows.groupBy(by).agg(F.max("rank").alias("_found"), *[F.sum(F.when(F.col("rank") <= d, F.col("_new"))).alias(f"_n{d}") for d in steps])
    enough = F.coalesce(*[F.when((F.col(f"_n{d}") >= wanted) | (F.col("_found") < d), d) for d in steps], F.lit(steps[-1]))
    kept = rows.filter(F.col("_out").isNull()).join(at.select(by, enough.alias("depth")), by).filter(F.col("rank") <= F.col("depth"))
    return kept.groupBy(by, "doc_id").agg(F.max("score").alias("score"), F.first("depth").alias("depth"))


def answer_body(question: Column, answers: Column) -> Column:
    """'Q: question', then 'Answer:' and a line for every answer, without empty parts."""
    asked = F.nullif(F.trim(question), F.lit(""))
    given = F.filter(F.transform(F.coalesce(answers, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    lines = F.when(F.size(given) > 0, F.concat(F.lit("Answer:\n- "), F.array_join(given, "\n- ")))
    return F.concat_ws("\n", F.concat(F.lit("Q: "), asked), lines)


def matched_question(pattern: str, question: Column, similar: Column) -> Column:
    """The wording that a pattern matches, whatever the case: a similar question before the standard
    one, which is also shown where only answers match."""
    return F.coalesce(F.try_element_at(F.filter(similar, lambda s: s.rlike(f"(?i){pattern}")), F.lit(1)), question)


SHOWN = 5  # similar questions that an entry shows; the number of others is told


def rendered(entry_id: Column, question: Column, similar: Column, answers: Column) -> Column:
    """An entry as tags for a model: question, similar questions, answers that aren't blank; escaped."""
    tags = lambda name, items: F.transform(items, lambda x: F.concat(F.lit(f"<{name}>"), T.html_escape(x), F.lit(f"</{name}>")))
    none = F.array().cast("array<string>")
    similar, answers = F.coalesce(similar, none), F.filter(F.coalesce(answers, none), lambda a: F.trim(a) != "")
    omitted = F.size(similar) - SHOWN
    lines = F.concat(
        F.array(F.concat(F.lit('<faq faq_id="'), T.html_escape(entry_id.cast("string")), F.lit('">'))),
        F.when(F.coalesce(question, F.lit("")) != "", tags("question", F.array(question))).otherwise(none),
        tags("similar_question", F.slice(similar, 1, SHOWN)),
        F.when(omitted > 0, F.array(F.concat(F.lit('<similar_questions_omitted count="'), omitted.cast("string"), F.lit('" />')))).otherwise(none),
        tags("answer", answers), F.array(F.lit("</faq>")),
    )
    return F.array_join(lines, "\n")


def content_digest(question: Column, similar: Column, negatives: Column, answers: Column) -> Column:
    """SHA-256 of an entry's parts, each trimmed, without empty and repeated ones; lists count in
    any order, so putting an entry into its normal form doesn't change it."""
    def part(items: Column) -> Column:
        kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
        return F.array_join(F.sort_array(F.array_distinct(kept)), "\x1e")

    return F.sha2(F.concat_ws("\x1f", F.coalesce(F.trim(question), F.lit("")), part(similar), part(negatives), part(answers)), 256)
