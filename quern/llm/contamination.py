"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows of the lengths in WINDOWS: long ones
that bear many edits, and shorter, closer ones that bear fewer, so that short copied
stretches hold a whole window too. An item shorter than the shortest window is one
window without edits, and counts where it stands as whole words; one of fewer than Q
characters has no q-gram and counts where it is the whole text. A text region within e edits of
a window of m characters shares at least m + 1 - q(1 + e) of its q-grams with it,
and those lie on e + 1 neighbouring diagonals. Shared q-grams (distinct places of the
window) are counted in diagonal bands of 2(e + 1) that overlap by half, so one band
holds them all; bands that meet the bound are verified by banded alignment.

The benchmark travels as a broadcast index, in blocks of bounded size if it is
large; documents never meet each other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.relations import without
from quern.session import materialise

Q = 10
# Characters of the normalised item, step, and most edits if the rate allows them; any copied stretch of
# characters + step - 1 holds a window: 49 within 1 edit, 79 (about 13 words) within 4, 149 within 8.
WINDOWS = ((100, 50, 9), (60, 20, 5), (40, 10, 1))
EDIT_RATE = 0.08
SHORT = 40  # normalised items below this count verbatim only, as whole words
BLOCK_CHARS = 4_000_000  # of benchmark text that one broadcast index covers: some 100 MB in each task
_PIECE = 1 << 19  # characters of text in one pass
_PLACES = 1 << 19  # of q-grams in the benchmark that are counted at once
_BANDS, _ITEM_BANDS = 1 << 10, 1 << 23  # added to band numbers of windows and of items, so that none is negative
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOT_WORD = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case; runs of anything but letters and digits become one space."""
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit polynomial hash of each q-gram."""
    with np.errstate(over="ignore"):
        out, width, power = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
        total, done = None, 0
        while True:
            if q & width:
                if total is None:
                    total = out
                else:
                    head = np.uint64(pow(int(_BASE), width, 1 << 64))
                    n = len(codes) - done - width + 1
                    total = total[:n] * head + out[done : done + n]
                done += width
            if done == q:
                return total
            out, power, width = out[:-width] * power + out[width:], power * power, width * 2


class Index:
    """Windows of benchmark items, and the places of the items' q-grams.

    Every q-gram is held once; which windows hold it follows from its place. Windows are
    numbered item by item; `most` of a kind start a step apart, one more ends with the item.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        self.whole: dict[str, list] = {}  # items without a q-gram
        self.ids, self.texts = [], []
        for item, raw in items:
            text = normalise(raw)
            if len(text) >= Q:
                self.ids.append(item)
                self.texts.append(text)
            elif text:
                self.whole.setdefault(text, []).append(item)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.base = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.empty(0, np.int64)
        self.kinds, owner, start, length, edits, first = [], [], [], [], [], 0
        for k, (wide, step, most) in enumerate(WINDOWS):
            own = np.flatnonzero((size > wide) | (k == 0))
            regular = np.maximum(0, -(-(size[own] - wide) // step))
            count = regular + 1
            number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            of = np.repeat(own, count)
            last = number == np.repeat(regular, count)
            at = np.full(len(size), -1)
            at[own] = first + np.cumsum(count) - count
            n_regular = np.zeros(len(size), np.int64)
            n_regular[own] = regular
            self.kinds.append((wide, step, at, n_regular))
            owner.append(of)
            start.append(np.where(last, np.maximum(0, size[of] - wide), number * step))
            length.append(np.minimum(size[of], wide))
            edits.append(np.full(len(of), most))
            first += len(of)
        self.owner, self.start, self.length = (np.concatenate(x).astype(np.int32) for x in (owner, start, length))
        n = self.length.astype(np.int64)
        # Fewer edits for windows of short items, so that the bound stays at one shared q-gram or more.
        self.edits = np.where(n < SHORT, 0, np.minimum(np.minimum((n * rate).astype(np.int64), (n - Q) // Q), np.concatenate(edits))).astype(np.int32)
        self.bound = n + 1 - Q * (1 + self.edits)
        grams = [_grams(_codes(t)) for t in self.texts]
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        at = np.concatenate([np.arange(b, b + len(g), dtype=np.int32) for b, g in zip(self.base, grams, strict=True)]) if grams else np.empty(0, np.int32)
        order = np.argsort(every, kind="stable")
        self.at = at[order]
        self.gram, first_of = np.unique(every[order], return_index=True)
        self.first = np.append(first_of, len(every)).astype(np.int32)
        self.shift = np.uint64(64 - min(26, max(16, int(64 * len(self.gram)).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.gram >> self.shift] = True
        self.reach = int((n + self.edits).max(initial=0))
        self.least = int(self.bound.min()) if len(self.bound) else 1
        self.span = int(self.edits.max(initial=0)) + 1

    def item(self, window: int):
        return self.ids[self.owner[window]]

    def pattern(self, window: int) -> str:
        start = int(self.start[window])
        return self.texts[self.owner[window]][start : start + int(self.length[window])]

    def windows_at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of `place`, window, place in the window) for every window that holds the q-gram at a place."""
        item = np.searchsorted(self.base, place, side="right") - 1
        inside = place - self.base[item]
        out = []
        for wide, step, at, n_regular in self.kinds:
            regular, own = n_regular[item], np.flatnonzero(at[item] >= 0)
            low = np.maximum(0, -(-(inside - (wide - Q)) // step))
            high = np.minimum(regular - 1, inside // step)
            for k in range((wide - Q) // step + 1):
                hit = own[low[own] + k <= high[own]]
                out.append((hit, at[item[hit]] + low[hit] + k))
            end = at[item] + regular  # the window that ends with the item
            hit = own[inside[own] >= self.start[end[own]]]
            out.append((hit, end[hit]))
        which, window = (np.concatenate(x) for x in zip(*out, strict=True))
        return which, window, inside[which] - self.start[window]


def _edits(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The least edits, if `most` at most, of the pattern against any stretch of the text on
    diagonals (text place - pattern place) from low to high; and that stretch's ends."""
    diagonals = np.arange(low, high + 1)
    never = len(pattern) + len(text) + 1
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, never)
    begin = diagonals.copy()
    for i in range(len(pattern)):
        j = i + diagonals
        inside = (j >= 0) & (j < len(text))
        same = np.full(len(j), never)
        same[inside] = text[j[inside]] != pattern[i]
        step, skip = cost + same, np.append(cost[1:], never) + 1  # both letters; the pattern's letter only
        skip[(j < 0) | (j > len(text))] = never
        new, start = np.where(step <= skip, step, skip), np.where(step <= skip, begin, np.append(begin[1:], 0))
        # The text's letter only: a walk to higher diagonals.
        ramp = new - np.arange(len(j))
        low_ramp = np.minimum.accumulate(ramp)
        source = np.maximum.accumulate(np.where(ramp == low_ramp, np.arange(len(j)), 0))
        cost, begin = low_ramp + np.arange(len(j)), start[source]
        cost[(j + 1 < 0) | (j + 1 > len(text))] = never
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(begin[k]), int(len(pattern) + diagonals[k])


def regions(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(window, edits, start, end) of the regions of a normalised text that match windows."""
    if len(text) < Q or not len(index.gram):
        return []
    codes = _codes(text)
    grams = _grams(codes)
    hit = index.maybe[grams >> index.shift]
    # Where no stretch as long as a region has enough hits, nothing is looked up.
    sums = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
    ends = np.minimum(np.arange(len(hit)) + index.reach, len(hit))
    dense = sums[ends] - sums[:-1] >= index.least
    if not dense.any():
        return []
    near = np.cumsum(dense, dtype=np.int32)
    covered = near - np.concatenate((np.zeros(min(index.reach, len(near)), np.int32), near[: -index.reach])) > 0
    at = np.flatnonzero(hit & covered)
    found = np.minimum(np.searchsorted(index.gram, grams[at]), len(index.gram) - 1)
    real = index.gram[found] == grams[at]
    at, found = at[real], found[real]
    out = []
    # Parts of about _PLACES places, each with the grams a region may share with the part before.
    places = np.cumsum(index.first[found + 1] - index.first[found])
    lo = 0
    while lo < len(at):
        least = lo + 1 + index.reach
        hi = max(least, int(np.searchsorted(places, (places[lo - 1] if lo else 0) + _PLACES, side="right")))
        part = slice(max(0, lo - index.reach), hi)
        out += _verify(codes, text, at[part], found[part], index)
        lo = hi
    return list(dict.fromkeys(out))


def _verify(codes: np.ndarray, text: str, at: np.ndarray, found: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    times = index.first[found + 1] - index.first[found]
    held = index.at[np.repeat(index.first[found] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
    held, own = held.astype(np.int64), np.repeat(at, times)
    # Before windows are told apart: a region's q-grams lie on neighbouring diagonals of the item as
    # a whole too, so bands of items without enough of them are passed over.
    item = np.searchsorted(index.base, held, side="right") - 1
    wide = item << 24 | (own - held + index.base[item]) // index.span + _ITEM_BANDS
    _, number, count = np.unique(np.concatenate([wide, wide - 1]), return_inverse=True, return_counts=True)
    enough = count[number] >= index.least
    enough = enough[: len(wide)] | enough[len(wide) :]
    held, own = held[enough], own[enough]
    if not len(held):
        return []
    which, window, place = index.windows_at(held)
    diagonal = own[which] - place
    width = index.edits[window] + 1
    band = diagonal // width
    # Window, band and place of the window in one number each; repeats of a place count once.
    key = (window << 22 | band + _BANDS) << 8 | place
    keys = np.unique(np.concatenate([key, key - (1 << 8)])) >> 8
    bands, shared = np.unique(keys, return_counts=True)
    bands = bands[shared >= index.bound[bands >> 22]]
    out, done = [], {}
    for both in bands.tolist():
        w, k = both >> 22, (both & (1 << 22) - 1) - _BANDS
        pattern, e = index.pattern(w), int(index.edits[w])
        low, high = k * (e + 1), (k + 2) * (e + 1) - 1
        if done.get(w, -1) >= low:
            continue  # the band before found the whole window in the half they share
        start, end = max(0, low - e), min(len(text), high + len(pattern) + e)
        exact = text.find(pattern, start, end)
        if exact >= 0:
            got = (0, exact, exact + len(pattern))
        elif not e:
            got = None
        else:
            got = _edits(_codes(pattern), codes[start:end], low - start, high - start, e)
            got = got and (got[0], got[1] + start, got[2] + start)
        if got and out and out[-1][0] == w and got[1] < out[-1][3]:  # the same region by the next band
            out[-1] = min(out[-1], (w, *got), key=lambda r: r[1])
        elif got:
            out.append((w, *got))
        if got and not got[0]:
            done[w] = got[1]
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """Matched regions: doc_id, item_id, item_start, edits, start, end.

    Places are characters of the normalised texts. Null and empty items and texts match
    nothing; repeated rows match alike. Long texts are searched whole, in overlapping parts;
    an item is held whole by every task. Empty tables give no rows; further columns play no part.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    numbered = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    out = None
    for block in range(blocks):
        rows = numbered.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows], rate))
        found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _matcher(index), f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, item_start int, edits int, start long, end long"
        )
        out = found if out is None else out.unionByName(found)
    return out


def whole_words(text: str, start: int, end: int) -> bool:
    return (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ")


def _matcher(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = index.value
        overlap = 2 * of.reach
        for batch in batches:
            rows: list[tuple] = []
            for k, raw in enumerate(batch.column("text")):
                text = normalise(raw.as_py())
                rows += [(k, item, 0, 0, 0, len(text)) for item in of.whole.get(text, ())]
                for at in range(0, max(1, len(text) - overlap), _PIECE):
                    for w, edits, start, end in regions(text[at : at + _PIECE + overlap], of):
                        if of.length[w] >= SHORT or whole_words(text, at + start, at + end):
                            rows.append((k, of.item(w), int(of.start[w]), edits, at + start, at + end))
            rows = list(dict.fromkeys(rows))
            if rows:
                k, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(k)), pa.array(rest[0]), *(pa.array(x, pa.int32()) for x in rest[1:3]), *(pa.array(x, pa.int64()) for x in rest[3:])],
                    ["doc_id", "item_id", "item_start", "edits", "start", "end"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """One row per input row: doc_id, contaminated, items (sorted item ids), n_regions, least_edits.

    Null and empty texts aren't contaminated; a long text is searched whole. Rows that repeat an id, the null id included, are one document and share the
    answer. An empty benchmark contaminates nothing, an empty table gives no rows,
    and further columns play no part.
    """
    found = materialise(matches(docs, benchmark, id_col, text_col, rate=rate), "contamination")
    by_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.count("*").alias("n_regions"), F.min("edits").alias("least_edits"))
    by_doc = by_doc.withColumnRenamed("doc_id", "found_id")
    ids = docs.select(F.col(id_col).alias("doc_id"))
    return ids.join(by_doc, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", F.col("n_regions").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast(by_doc.schema["items"].dataType)).alias("items"),
        F.coalesce("n_regions", F.lit(0)).alias("n_regions"), "least_edits",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """The rows of `docs` whose document has no matched region, with their columns; which
    documents those are is as in contamination(). Texts stay where they are."""
    found = materialise(matches(docs, benchmark, id_col, text_col, rate=rate).select("doc_id").distinct(), "contaminated")
    return without(docs, found, id_col)
