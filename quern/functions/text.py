"""Text functions as Column expressions; lengths count code points unless a name says bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_STRINGS = "array<string>"


def strings() -> Column:
    return F.array().cast(NO_STRINGS)


def normalise(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def signature(text: Column) -> Column:
    """MD5 of the normalised text: equal for texts that differ in case or spacing only."""
    return F.md5(normalise(text))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct lower-cased words between white space that have more than one character
    and some letter or digit."""
    parts = F.split(normalise(text), " ")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 1) & w.rlike(r"[\p{L}\p{N}]")))


def bigram_set(text: Column) -> Column:
    """Distinct pairs of neighbouring letters and digits, lower-cased; a single character stands for itself."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    pairs = F.regexp_extract_all(plain, F.lit("(?=(..))"), F.lit(1))
    return F.when(F.length(plain) == 1, F.array(plain)).otherwise(F.array_distinct(pairs))


def cjk_tokens(text: Column) -> Column:
    """Lower-cased words, with runs of Han characters as overlapping pairs (a single one stays)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsHan}+|[[\p{L}\p{N}_]&&[^\p{IsHan}]]+"), F.lit(0))
    pairs = lambda r: F.regexp_extract_all(r, F.lit("(?=(..))"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}{2,}$"), pairs(r)).otherwise(F.array(r))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared elements over those of the smaller set; 0 if it is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def share(text: Column, pattern: str) -> Column:
    """Matches of a one-character pattern over the text's length."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(pattern)) / F.length(text)).otherwise(0.0)


#: German words that show the language where no umlaut does: fixed value.
GERMAN_WORDS = " (der|die|das|und|ist|nicht|mit|auf) "


def guess_language(text: Column) -> Column:
    """zh, de, en or mixed, by the scripts of the letters: mixed if Han, kana and Hangul, and
    Latin letters, both make 15 % or there is neither; zh above 30 % of the former; de with an
    umlaut or, in the first 512 characters, a German word; else en."""
    counts = F.struct(
        F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]")).alias("cjk"), F.regexp_count(text, F.lit("[A-Za-zäöüÄÖÜß]")).alias("latin")
    )
    german = text.rlike("[äöüÄÖÜß]") | F.substring(text, 1, 512).rlike("(?i)" + GERMAN_WORDS)

    def named(n: Column) -> Column:
        letters = n["cjk"] + n["latin"]
        return (
            F.when(letters == 0, "mixed").when((n["cjk"] >= 0.15 * letters) & (n["latin"] >= 0.15 * letters), "mixed")
            .when(n["cjk"] > 0.3 * letters, "zh").when(german, "de").otherwise("en")
        )

    return F.transform(F.array(counts), named)[0]  # so that the counts are made once


#: Characters per token by guessed language: fixed values.
CHARS_PER_TOKEN = {"en": 4.0, "de": 4.5, "zh": 1.7, "mixed": 3.0}


def estimate_tokens(text: Column, language: Column) -> Column:
    """Characters over the language's characters per token, rounded; at least 1 for any text."""
    ratio = F.lit(CHARS_PER_TOKEN["mixed"])
    for name, value in CHARS_PER_TOKEN.items():
        ratio = F.when(language == name, value).otherwise(ratio)
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.floor(n / ratio + 0.5), F.lit(1))).otherwise(0).cast("long")


def strip_thinking(text: Column) -> Column:
    """Without <think> blocks."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def slug_key(slug: Column) -> Column:
    """A slug without case, hyphens and underscores."""
    return F.translate(F.lower(slug), "-_", "")


def embedding_text(title: Column, path: Column, body: Column, most: int = 20_000) -> Column:
    """Title, breadcrumb and body on lines of their own, without inline images, at most
    `most` characters: the limit of an embedding request."""
    whole = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(path, F.lit("")), body)
    return F.substring(F.regexp_replace(whole, r"data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+", ""), 1, most)


def identifier_terms(text: Column) -> Column:
    """Parts of camelCase and snake_case identifiers, lower-cased and distinct."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: w != ""))


#: Between the words of a query: all but ASCII letters, digits and the signs that join parts of a name.
BETWEEN_NAMES = r"[^A-Za-z0-9_$./#:\\-]+"
_OUTER_SIGNS = r"^[./#:\\-]+|[./#:\\-]+$"
IN_QUOTES = "`[^`]+`|\"[^\"]+\"|'[^']+'"
#: A sign between two letters or digits, a sign that only names have, or a capital within a word.
LIKE_CODE = r"[A-Za-z0-9][./#:\\-]+[A-Za-z0-9_$]|[_$]|[a-z0-9][A-Z]"


def _names(text: Column) -> Column:
    """The words of a text that could be names, without signs around them, in order."""
    return F.filter(F.transform(F.split(text, BETWEEN_NAMES), lambda w: F.regexp_replace(w, _OUTER_SIGNS, "")), lambda w: w.rlike("[A-Za-z]"))


def code_query(query: Column, identifiers: int = 8, terms: int = 32) -> Column:
    """Of the first 512 characters of a query the code that it names: identifiers (words in quotes,
    and such as have signs or inner capitals; eight at most, as written) and terms (the parts between
    their signs, and the parts of those that begin with a capital; lower-cased, of two characters
    or more; 32 at most). Both are empty for prose."""
    query = F.substring(query, 1, 512)
    quoted = F.flatten(F.transform(F.regexp_extract_all(query, F.lit(IN_QUOTES), F.lit(0)), _names))
    named = F.array_distinct(F.filter(_names(query), lambda w: w.rlike(LIKE_CODE) | F.array_contains(quoted, w)))
    humps = lambda p: F.split(F.regexp_replace(F.regexp_replace(p, "([A-Z][a-z])", " $1"), "([a-z0-9])([A-Z])", "$1 $2"), " +")
    parts = F.flatten(F.transform(named, lambda w: F.split(w, "[^A-Za-z0-9]+")))
    every = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), humps(p))))
    lowered = F.filter(F.transform(every, lambda w: F.lower(w)), lambda w: F.length(w) > 1)
    return F.struct(F.slice(named, 1, identifiers).alias("identifiers"), F.slice(F.array_distinct(lowered), 1, terms).alias("terms"))


def html_escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text
