"""Licence scan by canonical digest lookup.

Texts are brought into a canonical form (case, punctuation, copyright lines,
equivalent spellings), digested and hash-joined to the digests of known licences:
the whole document, and each of its lines as a text of its own, so that one-line
notices are found too.

Only texts and lines with a word that every known form has are brought into the form;
where some known form has none of these words, all are. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.license_texts import EQUIVALENT, known_texts
from quern.session import materialise

BROADCAST_ROWS = 100_000  # known digests (under 20 MB) that are broadcast; a larger table is shuffled
#: A line that names a holder or a year; a licence's own line may begin with "copyright notice".
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n©(]*(copyright[ \t]*(\(c\)|©|by |[0-9:])|(\(c\)|©)[ \t]*[0-9]|all rights reserved)[^\n]*"
#: What known forms have, one of them each; no other spelling of a word becomes one of these.
ANCHOR = r"(?i)licen|permission|redistribution|(released|distributed|published|available)[^\p{L}\p{N}]+under"
#: Without its copyright lines, which may stand between the words, a text can have what it hasn't with them.
COPYRIGHT = "(?i)copyright|©|\\(c\\)|all rights reserved"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, with one spelling of each equivalent, and with
    one space for every run of anything but letters and digits."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    plain = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), EQUIVALENT, plain)
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, text: of the list, or all that quern.llm.license_texts has (about 1 MB)."""
    return spark.createDataFrame(known_texts() if known is None else known, "license string, text string")


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, license, notices, n_notices.

    license is the licence that the whole text is (null if none; the least name if
    several share a canonical text); notices the names, sorted and comma-separated, of
    those that a line of it is; n_notices counts such lines. Known texts whose
    canonical form is empty match nothing, nor do null and empty documents. Rows that
    repeat an id, the null id included, are one document: its answers are the least
    licence and all notices. An empty table gives no rows; further columns play no part.
    A long text is one string of its row, whole, like any other.
    """
    forms = known.select("license", canonical(F.col("text")).alias("form")).filter("form != ''")
    digests = materialise(forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.min(F.col("form").rlike(ANCHOR)).alias("anchored")), "known-licenses")
    size, anchored = digests.agg(F.count("*"), F.coalesce(F.min("anchored"), F.lit(True))).first()
    text = F.col(text_col)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(ANCHOR) if anchored else line != "")
    whole = F.array(F.struct(F.lit(True).alias("whole"), text.alias("text")))
    if anchored:
        whole = F.when(text.rlike(ANCHOR) | text.rlike(COPYRIGHT), whole).otherwise(F.array().cast("array<struct<whole:boolean,text:string>>"))
    units = F.concat(whole, F.transform(lines, lambda line: F.struct(F.lit(False).alias("whole"), line.alias("text"))))
    found = (
        docs.select(F.col(id_col).alias("doc_id"), F.explode(units).alias("unit"))
        .select("doc_id", "unit.whole", canonical(F.col("unit.text")).alias("form")).filter("form != ''")
        .select("doc_id", "whole", F.sha2("form", 256).alias("digest"))
        .join(F.broadcast(digests) if size <= BROADCAST_ROWS else digests, "digest")
        .groupBy("doc_id").agg(
            F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
            F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"),
            F.count_if(~F.col("whole")).alias("n_notices"),
        )
        .withColumnRenamed("doc_id", "found_id")
    )
    ids = docs.select(F.col(id_col).alias("doc_id"))
    return ids.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).alias("n_notices")
    )
