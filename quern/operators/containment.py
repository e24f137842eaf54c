"""Texts that contain others as they are, by anchor grams.

A text's chosen grams are those with the least hash among some neighbour; a text that contains a
pattern chooses, within it, all that the pattern chooses. So one chosen gram of the pattern, the rarest
in the texts, finds all places where it can stand: an equi-join of anchors with places, and a
comparison of the text at the place. Long patterns are anchored by two neighbouring grams and their
distance, which common wording doesn't have in common; short ones by grams of fewer
characters, and those under eight characters by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.relations import MAP_SIDE, probably_among
from quern.session import materialise

SCALES = ((16, 16), (4, 5))  # characters of a gram, and grams of which the least is chosen; the first that fits a pattern counts
SHORTEST = SCALES[-1][0] + SCALES[-1][1] - 1  # patterns below have their own length as their scale
SENT = 50_000_000  # characters of patterns that are broadcast with their places
HELD, LONGEST = 2_000_000, 64  # characters of short patterns (some 250 MB with their beginnings) that every worker keeps, and of one of them
FEW = 100  # patterns of which each is looked for by itself
FOUND = 1 << 20  # rows of what was found that a task passes on at once
ENDS, GOES_ON = 1, 2  # a pattern ends here, a longer one goes on
_PRIME, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(at: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` neighbouring characters, to be scrambled; other widths have other hashes."""
    if len(at) < width:
        return np.empty(0, np.uint64)
    out, have, factor = at + np.uint64(width), 1, _PRIME
    while 2 * have <= width:
        out = out[: len(out) - have] * np.uint64(factor) + out[have:]
        have, factor = 2 * have, factor * factor & _ALL
    for k in range(have, width):
        out = out[: len(at) - k] * np.uint64(_PRIME) + at[k:]
    return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    have, out = 1, x
    while 2 * have <= width:
        out, have = pick(out[: len(out) - have], out[have:]), 2 * have
    return pick(out[: len(x) - width + 1], out[width - have :]) if have < width else out


def chosen(h: np.ndarray, window: int) -> np.ndarray:
    """Positions whose order, 32 bits of a hash, is the least of some `window` neighbours that include them."""
    if len(h) < window:
        return np.empty(0, np.int64)
    order = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)
    least = _sliding(order, window, np.minimum)
    edge = np.zeros(window - 1, np.uint32)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum) == order)


def places(at: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: hashes and positions of its chosen grams; of neighbouring ones, with their distance; and
    which of these no surrounding text can change. A scale below 0 is a length to be hashed whole."""
    if scale < 0:
        h = _scrambled(gram_hashes(at, -scale))
        none = np.empty(0, np.int64)
        return h, np.arange(len(h)), none.astype(np.uint64), none, none.astype(bool)
    width, window = SCALES[scale]
    h = gram_hashes(at, width)
    pos = chosen(h, window)
    own, gap = _scrambled(h[pos]), np.diff(pos)
    pairs = _scrambled(own[:-1] * np.uint64(_PRIME) + own[1:] + gap.astype(np.uint64))
    inner = (pos[:-1] >= window - 1) & (pos[1:] <= len(h) - window)
    return own, pos, pairs, pos[:-1], inner


def scale_of(length: int) -> int:
    """The scale of a pattern: the number of an entry of SCALES, or its length below 0."""
    return next((k for k, (width, window) in enumerate(SCALES) if length >= width + window - 1), -length)


def pattern_keys(text: str, known: Keys | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, any of which can anchor the pattern, and where they stand in it; none if one of
    them isn't among the `known`, which then can't hold the pattern."""
    own, pos, pairs, first, inner = places(codes(text), scale_of(len(text)))
    if known is not None and not known(own).all():
        return own[:0], pos[:0]
    return (pairs[inner], first[inner]) if inner.any() else (own, pos)


class Keys:
    """Known keys, sorted, behind a table of bits that clears nearly all others at once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = np.sort(keys), np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        maybe = self.bits[(x >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(maybe)
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
            maybe[at] = self.keys[place] == x[at]
        return maybe


def _grams(rows: DataFrame, scales: list[int] | None, known) -> DataFrame:
    """id, key, pos: the keys of patterns (without scales), or of texts at these scales, each once at
    its first place in a text if its length is hashed whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None if known is None else Keys(known.value)
        for batch in batches:
            row, key, pos = [], [], []
            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                if scales is None:
                    found = [pattern_keys(text, have)]
                else:
                    at, found = codes(text), []
                    for scale in scales:
                        own, where, pairs, first, _ = places(at, scale)
                        if scale < 0:
                            own, once = np.unique(own, return_index=True)
                            where = where[once]
                        found += [(own, where), (pairs, first)]
                    if have is not None:
                        found = [(x[ok], y[ok]) for x, y in found for ok in [have(x)]]
                for x, y in found:
                    row.append(np.full(len(x), k))
                    key.append(x.view(np.int64))
                    pos.append(y)
            if row:
                ids = batch.column("id").take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(key)), pa.array(np.concatenate(pos).astype(np.int32))], ["id", "key", "pos"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, pos int")


def _known(keys: DataFrame, most: int):
    """The distinct keys in a broadcast array, or None if there are more than `most`."""
    some = keys.select("key").distinct().limit(most + 1).toArrow().column("key").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(some.view(np.uint64)) if len(some) <= most else None


def _scales(patterns: DataFrame) -> list[int]:
    n, out = F.length("text"), F.lit(None).cast("int")
    for k, (width, window) in reversed(list(enumerate(SCALES))):
        out = F.when(n >= width + window - 1, k).otherwise(F.when(n < SHORTEST, -n) if k == len(SCALES) - 1 else out)
    return sorted(r[0] for r in patterns.select(out.alias("scale")).filter("scale IS NOT NULL").distinct().collect())


def found_in(texts: DataFrame, patterns: DataFrame, few_patterns: bool, most: int = MAP_SIDE) -> DataFrame:
    """text_id, pattern_id: texts (id, text) that contain a pattern (id, text). Nulls and empty texts
    contain and match nothing. `few_patterns` tells which side is the smaller one, whose
    keys, up to `most`, are broadcast so that the other passes on nothing else."""
    texts, patterns = texts.filter("text != ''"), patterns.filter("text != ''")
    if few_patterns:
        scales = _scales(patterns)
        # Both the keys of patterns and what tells that all their grams are known.
        asked = materialise(_grams(patterns, None, None), "pattern-keys")
        known = _known(asked, most)
        hits = _grams(texts, scales, known)
        hits = materialise(hits if known else probably_among(hits, asked.select("key").distinct(), "key"), "text-keys")
    else:
        hits = materialise(_grams(texts, [*range(1 - SHORTEST, 0), *range(len(SCALES))], None), "text-keys")
        asked = materialise(_grams(patterns, None, _known(hits, most)), "pattern-keys")
    counts = hits.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "key").groupBy("id").agg(F.min(F.struct("n", "key", "pos")).alias("a")).select(F.col("id").alias("pattern_id"), "a.key", F.col("a.pos").alias("off"))
    anchored = rarest.join(hits, "key").filter("pos >= off").select("pattern_id", F.col("id").alias("text_id"), (F.col("pos") - F.col("off")).alias("start")).distinct()
    at = materialise(anchored.join(patterns.select(F.col("id").alias("pattern_id"), F.col("text").alias("pattern")), "pattern_id"), "anchored")
    # The texts stay where they are if what is to be compared is small; else those that may hold a pattern move.
    size, n = at.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0)), F.count("*")).first()
    small = size <= SENT and n <= MAP_SIDE
    holders = texts.select(F.col("id").alias("text_id"), "text")
    held = holders.join(F.broadcast(at), "text_id") if small else probably_among(holders, at.select("text_id").distinct(), "text_id").join(at, "text_id")
    return held.filter(F.substr("text", F.col("start") + 1, F.length("pattern")) == F.col("pattern")).select("text_id", "pattern_id").distinct()


class Beginnings:
    """Patterns and all their beginnings, to be followed from every place of a text."""

    def __init__(self, patterns: list[str]):
        self.few: list[str] = patterns if len(patterns) <= FEW else []
        self.of: dict[str, int] = {}
        for p in patterns:
            self.of[p] = self.of.get(p, 0) | ENDS
            for n in range(1, len(p)):
                self.of[p[:n]] = self.of.get(p[:n], 0) | GOES_ON

    def within(self, text: str) -> set[str]:
        if self.few:
            return {p for p in self.few if p in text}
        get, found = self.of.get, set()
        for start in range(len(text)):
            end = start + 1
            while k := get(text[start:end]):
                if k & ENDS:
                    found.add(text[start:end])
                if not k & GOES_ON or end == len(text):
                    break
                end += 1
        return found


def _followed(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id of few and short patterns (id, text), made where the texts (id, text) are read, and nothing shuffled."""
    sent = texts.sparkSession.sparkContext.broadcast(patterns.select("id", "text").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places = sent.value.column("id").combine_chunks(), {}
        for k, p in enumerate(sent.value.column("text").to_pylist()):
            places.setdefault(p, []).append(k)
        known = Beginnings(list(places))
        for batch in batches:
            row, at = [], []
            for k, text in enumerate(batch.column("text")):
                found = [n for p in known.within(text.as_py()) for n in places[p]]
                row += [k] * len(found)
                at += found
                if len(at) > FOUND or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int32())), ids.take(pa.array(at, pa.int32()))], ["text_id", "pattern_id"])
                    row, at = [], []

    return texts.select("id", "text").mapInArrow(run, f"text_id {texts.schema['id'].dataType.simpleString()}, pattern_id {patterns.schema['id'].dataType.simpleString()}")


def _found(texts: DataFrame, patterns: DataFrame, follow: bool) -> DataFrame:
    """found_in() of few patterns; with `follow`, patterns of up to LONGEST characters are followed, if they have up to HELD together."""
    short = patterns.filter(F.length("text").between(1, LONGEST)).distinct()
    if not follow or short.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] > HELD:
        return found_in(texts, patterns, True)
    long, made = patterns.filter(F.length("text") > LONGEST), _followed(texts.filter("text != ''"), short)
    made = made if long.isEmpty() else made.unionByName(found_in(texts, long, True))
    repeated = lambda rows: not rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return made.distinct() if repeated(patterns.distinct()) or repeated(texts) else made


def containing(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: bool = True, follow: bool = False) -> DataFrame:
    """doc_id, passage_id: documents that contain a passage (passage_id, passage) or, with `within`,
    are contained in one, null ids left out. Passages are the smaller table; `follow` is for many short ones that most documents
    have some of: they are followed through the texts then, and what is found stays where it is."""
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    parts = passages.select(F.col("passage_id").alias("id"), F.col("passage").alias("text")).filter("id IS NOT NULL")
    found = _found(whole, parts, follow).select(F.col("text_id").alias("doc_id"), F.col("pattern_id").alias("passage_id"))
    if not within:
        return found
    longest = parts.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]
    inside = found_in(parts, whole.filter(F.length("text") <= longest), False).select(F.col("pattern_id").alias("doc_id"), F.col("text_id").alias("passage_id"))
    return found.unionByName(inside).distinct()
