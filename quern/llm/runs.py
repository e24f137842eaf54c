"""Periodic runs of words, found by string synchronising sets (Kempa and Kociumaka 2019).

A run is a stretch of words with smallest period q that goes on for three periods or more and
that no neighbouring word extends. Scale k looks for periods from 2^k up to 2^(k+1) words. There a
position is synchronising if, of the hashes of all t-word contexts that begin at it or at one of the
next t words, t = 2^(k-2), the least stands first or last: a choice that hangs on the 2t words
from there on alone, so that equal stretches choose alike. Two synchronising positions with equal contexts
propose their distance as a period. Contexts that are themselves highly periodic (period up to
t/3, over all their words) take no part in the choice, or they would flood it; the runs that
hold them have smaller periods, which smaller scales find, and periods below 16 are found apart,
by comparing words directly. Every window of q + 3t words within a run of
period q has a context that isn't highly periodic, and so a synchronising position whose copy, q words on,
is still within the run: no run is missed. What is proposed is verified on the words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_PERIODS = 24, 3
SMALL = 16  # periods below are compared directly; the first scale's least period
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal ones."""
    distinct = dict.fromkeys(words)
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _joined(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the contexts of twice `width` words, from those of `width` words."""
    return _scramble(h[: len(h) - width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    out, have = h, 1
    while 2 * have <= width:
        out, have = np.minimum(out[: len(out) - have], out[have:]), 2 * have
    return np.minimum(out[: len(h) - width + 1], out[width - have :]) if have < width else out


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last positions of the stretches of true values."""
    edge = np.diff(np.concatenate(([0], equal.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _may_have(ids: np.ndarray, q: int) -> bool:
    """Whether 2q words in a row can equal those q on: samples s words apart show four hits then."""
    s = max(1, q // 2)
    hit = ids[: len(ids) - q : s] == ids[q::s]
    return bool((hit[:-1] & hit[1:]).any()) if q == 1 else bool((hit[:-3] & hit[1:-2] & hit[2:-1] & hit[3:]).any())


def _agreement(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch around `at`, which lies in it, whose words equal those `period` on: first, one past last."""
    first, last, step = at, at, 64
    while first > 0:
        low = max(0, first - step)
        bad = np.flatnonzero(ids[low:first] != ids[low + period : first + period])
        if len(bad):
            first = low + int(bad[-1]) + 1
            break
        first, step = low, 2 * step
    step, end = 64, len(ids) - period
    while last < end:
        high = min(end, last + step)
        bad = np.flatnonzero(ids[last:high] != ids[last + period : high + period])
        if len(bad):
            last += int(bad[0])
            break
        last, step = high, 2 * step
    return first, last


class _Found:
    """Stretches of three periods or more, by ascending smallest period."""

    def __init__(self):
        self.runs: list[Run] = []
        self.starts = np.empty(0, np.int64)
        self.periods = np.empty(0, np.int64)
        self.ends = np.empty(0, np.int64)

    def extend(self, start: np.ndarray, end: np.ndarray, period: int) -> None:
        """Add stretches of `period`, but for those of a run whose period divides it."""
        inner = (period % self.periods) == 0
        # One word of a stretch is enough: with three periods, it is within a run of a divisor or it isn't.
        order = np.argsort(self.starts[inner])
        starts, ends = self.starts[inner][order], np.maximum.accumulate(self.ends[inner][order]) if inner.any() else self.ends[:0]
        at = np.searchsorted(starts, start, "right") - 1
        own = np.ones(len(start), bool) if not len(starts) else (at < 0) | (ends[np.maximum(at, 0)] < end)
        start, end = start[own], end[own]
        self.runs += [(int(a), int(b - a), period) for a, b in zip(start, end, strict=True)]
        self.starts, self.ends = np.append(self.starts, start), np.append(self.ends, end)
        self.periods = np.append(self.periods, np.full(len(start), period))


def periodic_stretches(ids: np.ndarray, least_periods: int = LEAST_PERIODS, small: int = SMALL) -> list[Run]:
    """All runs of at least `least_periods` (3 or more) periods, however short, by period."""
    n, found = len(ids), _Found()
    for q in range(1, min(small - 1, n // least_periods) + 1):
        if not _may_have(ids, q):
            continue
        first, last = _stretches(ids[: n - q] == ids[q:])
        long = last - first >= (least_periods - 1) * q
        if long.any():
            found.extend(first[long], last[long] + q, q)
    if n < least_periods * small:
        return found.runs
    h, width = _scramble(ids.astype(np.uint64) + np.uint64(1)), 1
    while 4 * width < small:
        h, width = _joined(h, width), 2 * width
    while least_periods * 4 * width <= n:
        for period, at in _proposals(ids, h, width, found):
            if period * least_periods <= n:
                _verify(ids, at, period, least_periods, found)
        h, width = _joined(h, width), 2 * width
    return found.runs


def _proposals(ids: np.ndarray, h: np.ndarray, t: int, found: _Found) -> Iterator[tuple[int, np.ndarray]]:
    """Periods from 4t up to 8t words by equal contexts of synchronising positions, ascending, with
    the positions. h holds the hashes of t words."""
    dull = (found.periods <= t // 3) & (found.ends - found.starts >= t)
    if dull.any():  # highly periodic contexts
        delta = np.zeros(len(h) + 1, np.int64)
        np.add.at(delta, found.starts[dull], 1)
        np.add.at(delta, found.ends[dull] - t + 1, -1)
        h_of = np.where(np.cumsum(delta[:-1]) > 0, _NONE, h)
    else:
        h_of = h
    least = _least(h_of, t + 1)
    sync = np.flatnonzero(((h_of[: len(least)] == least) | (h_of[t:] == least)) & (least != _NONE))
    if len(sync) < 2:
        return
    name = _scramble(h[sync] * np.uint64(0x9E3779B97F4A7C15) + h[sync + t])
    order = np.argsort(name, kind="stable")  # equal contexts side by side, by place
    name, sync = name[order], sync[order]
    twin = name[1:] == name[:-1]
    twin = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
    name, sync = name[twin], sync[twin]
    apart, at, k = [], [], 1
    while k < len(sync):  # the k-th next with the same context, while any is less than 8t words on
        gap = sync[k:] - sync[:-k]
        near = (name[:-k] == name[k:]) & (gap < 8 * t)
        if not near.any():
            break
        far = np.flatnonzero(near & (gap >= 4 * t))
        apart.append(gap[far])
        at.append(sync[far])
        k += 1
    apart, at = np.concatenate(apart or [sync[:0]]), np.concatenate(at or [sync[:0]])
    if not len(apart):
        return
    # Two periods of agreement hold 4t words that agree from the pair on, or up to it.
    h4 = _joined(_joined(h, t), 2 * t)
    after, before = np.minimum(at, len(h4) - 1), at - 4 * t
    after_ok = (at + apart < len(h4)) & (h4[after] == h4[np.minimum(at + apart, len(h4) - 1)])
    before_ok = (before >= 0) & (h4[np.maximum(before, 0)] == h4[np.minimum(np.maximum(before, 0) + apart, len(h4) - 1)])
    good = after_ok | before_ok
    apart, at = apart[good], at[good]
    order = np.lexsort((at, apart))
    apart, at = apart[order], at[order]
    cut = np.flatnonzero(np.diff(apart)) + 1
    for own, places in zip(np.split(apart, cut), np.split(at, cut), strict=True):
        if len(own):
            yield int(own[0]), places


def _verify(ids: np.ndarray, places: np.ndarray, period: int, least_periods: int, found: _Found) -> None:
    done, starts, ends = -1, [], []
    for at in places.tolist():
        if at < done:
            continue
        first, last = _agreement(ids, at, period)
        done = last
        if last - first >= (least_periods - 1) * period:
            starts.append(first)
            ends.append(last + period)
    if starts:
        found.extend(np.array(starts), np.array(ends), period)


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of the runs of a sequence of numbers, by start and then period."""
    return sorted((r for r in periodic_stretches(ids, least_periods) if r[1] >= least_words), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if of each run its first period does."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:-1]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words of a document with a repetition planted in it, or None where there is none: of
    the ids whose CRC-32 ends in 0, from some word on, the next p words over and over."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


class Report:
    """A text's runs, and the text without their repetitions."""

    def __init__(self, text: str | None, doc_id: int | None = None, plant: bool = False):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        ids = numbered(words)
        order = planted(doc_id, len(words)) if plant else None
        if order is not None:
            words, ids = [words[i] for i in order.tolist()], ids[order]
        self.runs = runs_of(ids)
        if self.runs:
            stays = kept_words(len(words), self.runs)
            words = [words[i] for i in np.flatnonzero(stays).tolist()]
        self.collapsed = b" ".join(words)

    @property
    def strongest(self) -> Run | None:
        """The run of most periods; ties go to the first, then to the smallest period."""
        return min(self.runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per input row: doc_id, runs (array of start, length, period), strongest (one of them,
    or null) and collapsed, the text's words, joined by a space, of each run its first period only.

    With `plant`, texts whose id says so get a repetition first (planted()). Null and empty
    texts have no runs and collapse to an empty text; a null id plants nothing; repeated
    ids are rows like others. A long text is searched whole, in memory in proportion to its
    words. An empty table gives no rows; further columns play no part. No row is moved.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    as_struct = lambda r: dict(zip(("start", "length", "period"), r, strict=True)) if r else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Report(t.as_py(), i.as_py(), plant) for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([[as_struct(r) for r in m.runs] for m in made], pa.list_(run_type)),
                    pa.array([as_struct(m.strongest) for m in made], run_type), pa.array([m.collapsed.decode("utf-8", "surrogatepass") for m in made], pa.string()),
                ],
                ["doc_id", "runs", "strongest", "collapsed"],
            )

    struct = "struct<start:long, length:long, period:long>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, f"doc_id {kind}, runs array<{struct}>, strongest {struct}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs(): doc_id, n_runs, the strongest run with its exponent in thousandths, and
    digests of all runs and of the collapsed text."""
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length DIV strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
