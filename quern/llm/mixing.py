"""Mixing sources to target weights: iterative proportional fitting (raking) of token
weights to source, language and topic marginals, then sampling by calibrated
probabilities.

Documents are reduced to cells of (source, language, topic). Only values with a
target have cells of their own, all others share one, so the number of cells is
bounded by the targets and never by the data; the fit runs over that small table.

Topics are what the words of a language's documents differ in most: each document has a
small sketch of its words, and its topic says on which side of the mean of its language it
lies along each of the language's leading principal axes. So every language has every
topic, and targets for both can be met together. All documents count for means and axes.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.decisions import keep_decided
from quern.session import materialise

OTHER = "(other)"
MOST_CELLS = 1_000_000
TOLERANCE, ROUNDS = 1e-9, 2000
REPORTED = 1e-3  # of the tokens; a marginal that stays farther off its goals is reported by a RakingWarning
LOWER = 0.97  # the part of the fraction that is tried next while a marginal stays farther off
AXES, WIDTH = 3, 64  # principal axes, of which each side is a topic's half; numbers of a sketch
LANGUAGES = 1024  # groups that languages fall into by a hash; those that share one share their axes
POWER, NAMED = 0.7, 10_000  # of shares, for targets from the data; sources and languages that get a target of their own
_CACHE = 200_000  # words whose bucket a worker remembers


@dataclass(frozen=True)
class Targets:
    """Share of the tokens by value, for each marginal. Values that aren't listed share
    OTHER; where OTHER isn't listed, it keeps the share it has in the data."""

    source: Mapping[str, float]
    lang: Mapping[str, float]
    topic: Mapping[str, float]
    fraction: float = 0.85  # of all tokens that is sampled, or as much as values with a share above 0 have


class RakingWarning(UserWarning):
    """The marginals can't all be met together: how far the fit is from them."""


class Words:
    """A text's number of words between white space, and a sketch of them: logs of the counts of words, added
    up with a sign of each word's own in one of WIDTH places, as whole numbers of length 127."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        words = (text or "").split()
        if len(self.seen) > _CACHE:
            self.seen.clear()
        for w in set(words).difference(self.seen):
            self.seen[w] = xxhash.xxh64_intdigest(w.lower().strip(".,;:!?\"'()")) >> 40
        at, count = np.unique(np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words)), return_counts=True)
        made = np.bincount(at % WIDTH, np.log1p(count) * np.where(at & WIDTH, 1, -1), WIDTH) if len(at) else np.zeros(WIDTH)
        norm = np.sqrt((made * made).sum())
        return len(words), np.rint(made * (127 / norm) if norm else made).astype(np.int8)


@dataclass(frozen=True)
class Topics:
    """Of each group of languages, the mean of its sketches (groups, WIDTH) and its axes (groups, AXES, WIDTH)."""

    mean: np.ndarray
    axes: np.ndarray

    def __call__(self, groups: np.ndarray, sketches: np.ndarray) -> np.ndarray:
        """The topics' numbers: a bit for each axis."""
        off = sketches - self.mean[groups]
        side = np.einsum("rw,raw->ra", off, self.axes[groups]) > 0
        return (side << np.arange(AXES)).sum(axis=1)


def learn_topics(narrow: DataFrame) -> Topics:
    """From columns lang_group and sketch of all documents with words. The sums are of whole numbers, and so
    the same however the rows are dealt out. No rows give means and axes of zeros."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            groups, x = batch.column("lang_group").to_numpy(), _matrix(batch.column("sketch"))
            for g in np.unique(groups):
                own = np.column_stack([np.ones((groups == g).sum(), np.int64), x[groups == g]])
                sums[g] = sums.get(g, 0) + np.rint(own.T.astype(float) @ own).astype(np.int64).ravel()
        for g, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([total], pa.list_(pa.int64()))], ["lang_group", "sums"])

    parts = narrow.filter("n_tokens > 0").select("lang_group", "sketch").mapInArrow(add, "lang_group int, sums array<long>")
    total = parts.select("lang_group", F.posexplode("sums").alias("at", "v")).groupBy("lang_group", "at").agg(F.sum("v").alias("v")).toArrow()
    every = np.zeros((LANGUAGES, (WIDTH + 1) ** 2))
    every[total.column("lang_group").to_numpy(), total.column("at").to_numpy()] = total.column("v").to_numpy()
    mean, axes = np.zeros((LANGUAGES, WIDTH)), np.zeros((LANGUAGES, AXES, WIDTH))
    for g in np.unique(total.column("lang_group").to_numpy()):
        mean[g], axes[g] = principal(every[g].reshape(WIDTH + 1, WIDTH + 1))
    return Topics(mean, axes)


def principal(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes from the sums of products of (1, sketch); each axis's largest number is positive."""
    mean = sums[0, 1:] / sums[0, 0]
    _, vectors = np.linalg.eigh(sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, :AXES].T
    return mean, axes * np.sign(axes[np.arange(AXES), np.abs(axes).argmax(axis=1)])[:, None]


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.int8).reshape(len(sketches), WIDTH).astype(np.int64)


def described(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """doc_id, source, lang, lang_group, sketch, n_tokens, chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Words()
        for batch in batches:
            made = [make(text.as_py()) for text in batch.column("text")]
            columns = [*(batch.column(c) for c in ("doc_id", "source", "lang", "lang_group")), pa.array([m[1].tobytes() for m in made], pa.binary()), pa.array([m[0] for m in made], pa.int64()), batch.column("chance")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "lang", "lang_group", "sketch", "n_tokens", "chance"])

    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, source string, lang string, lang_group int, sketch binary, n_tokens long, chance double"
    lang = F.col(lang_col).cast("string")
    at = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), lang.alias("lang"), F.pmod(F.xxhash64(lang), F.lit(LANGUAGES)).cast("int").alias("lang_group"),
        F.col(text_col).alias("text"), _chance(F.col(id_col), F.col(text_col), seed).alias("chance"),
    )
    return at.mapInArrow(run, kinds)


def with_topics(narrow: DataFrame, topics: Topics) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, chance of described(). Texts without words have no topic (null)."""
    model = narrow.sparkSession.sparkContext.broadcast(topics)
    names = ["doc_id", "source", "lang", "topic", "n_tokens", "chance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value(batch.column("lang_group").to_numpy(), _matrix(batch.column("sketch")))
            some = batch.column("n_tokens").to_numpy() > 0
            topic = pa.array([f"topic{t}" if s else None for t, s in zip(found, some, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([topic if c == "topic" else batch.column(c) for c in names], names)

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, source string, lang string, topic string, n_tokens long, chance double")


def tempered(narrow: DataFrame, power: float = POWER, named: int = NAMED, fraction: float = 0.85) -> Targets:
    """Targets from the data: for the `named` values of each marginal with most tokens, shares
    in proportion to a power below 1 of what they have, so that small ones gain on large ones."""

    def shares(column: str) -> dict[str, float]:
        top = narrow.filter(F.col(column).isNotNull() & (F.col(column) != OTHER)).groupBy(column).agg(F.sum("n_tokens").alias("n")).filter("n > 0").orderBy(F.desc("n"), column).limit(named)
        return {r[0]: float(r.n) ** power for r in top.collect()}

    return Targets(shares("source"), shares("lang"), shares("topic"), fraction)


def _goals(have: np.ndarray, shares: np.ndarray, total: float) -> np.ndarray:
    """min(have, level * share) with the level at which they sum to `total`: what a value
    can't give of its share, the others make up for by theirs."""
    out, open_ = np.zeros_like(have), (shares > 0) & (have > 0)
    while open_.any():
        level = (total - out[~open_].sum()) / shares[open_].sum()
        full = open_ & (have <= level * shares)
        if not full.any():
            out[open_] = level * shares[open_]
            break
        out[full], open_ = have[full], open_ & ~full
    return out


def rake(tokens: np.ndarray, members: list[np.ndarray], shares: list[np.ndarray], fraction: float = 1.0) -> tuple[np.ndarray, float]:
    """Tokens to take of each cell, between 0 and what it has, and by what part of all of them
    the marginal that fits worst is off its goals.

    members[d][cell] is the cell's value in marginal d, shares[d][value] the share wanted.
    Each step scales the cells of a value to its goal; cells that would exceed what they
    have are held there and the others of the value make up for it, until nothing moves
    any more or ROUNDS are over. Marginals that contradict each other, or the cells that
    there are, can't all be met: the fit then meets the last one.
    """
    tokens = tokens.astype(float)
    have = [np.bincount(m, tokens, len(s)) for m, s in zip(members, shares, strict=True)]
    total = min([tokens.sum() * fraction, *(h[s > 0].sum() for h, s in zip(have, shares, strict=True))])
    if not total > 0:
        return np.zeros_like(tokens), 0.0
    goals = [_goals(h, s, total) for h, s in zip(have, shares, strict=True)]
    take = tokens * (total / tokens.sum())
    for _ in range(ROUNDS):
        before = take
        for m, goal in zip(members, goals, strict=True):
            for _ in range(len(tokens)):
                full = take >= tokens
                held = np.bincount(m, np.where(full, take, 0.0), len(goal))
                free = np.bincount(m, np.where(full, 0.0, take), len(goal))
                over = held > goal  # more is held than wanted: let go
                factor = np.where(over, goal / np.maximum(held + free, 1e-300), np.maximum(goal - held, 0) / np.maximum(free, 1e-300))
                new = np.minimum(tokens, np.where(full & ~over[m], take, take * factor[m]))
                done = np.abs(new - take).sum() <= TOLERANCE * total
                take = new
                if done:
                    break
        if np.abs(take - before).sum() <= TOLERANCE * total:
            break
    return take, float(max(np.abs(np.bincount(m, take, len(g)) - g).sum() for m, g in zip(members, goals, strict=True)) / total)


def rake_within(tokens: np.ndarray, members: list[np.ndarray], shares: list[np.ndarray], fraction: float, most: float = REPORTED) -> tuple[np.ndarray, float, float]:
    """rake() with a fraction that is lowered until no marginal is farther than `most` off its goals:
    what to take, the gap, and the fraction. Marginals that contradict each other at any fraction
    keep the fit with the least gap, and a RakingWarning tells it."""
    best = (np.zeros(len(tokens)), 0.0, fraction)
    tried = fraction
    while tried > fraction / 8:
        take, gap = rake(tokens, members, shares, tried)
        if gap <= most:
            return take, gap, tried
        best = (take, gap, tried) if tried == fraction or gap < best[1] else best
        tried *= LOWER
    warnings.warn(f"at any fraction, a marginal is off its goals by {best[1]:.2%} of the tokens", RakingWarning, stacklevel=2)
    return best


def _shares(targets: Mapping[str, float], have: np.ndarray) -> np.ndarray:
    """Shares in the order of the targets, with OTHER last."""
    named = [v for k, v in targets.items() if k != OTHER]
    total = have.sum()
    other = targets.get(OTHER, have[-1] / total if total else 0.0)
    rest = np.array(named, float)
    return np.append(rest / rest.sum() * (1 - other) if rest.sum() else rest, other)


def calibrated(docs: DataFrame, targets: Targets) -> DataFrame:
    """The bounded table source, lang, topic, probability, gap and fraction (of rake_within(), the same in
    all rows), from columns source, lang, topic, n_tokens."""
    dims = ("source", "lang", "topic")
    wanted = [getattr(targets, d) for d in dims]
    names = [[*(k for k in w if k != OTHER), OTHER] for w in wanted]
    rows = docs.groupBy(*[_cell(F.col(d), w).alias(d) for d, w in zip(dims, wanted, strict=True)]).agg(F.sum("n_tokens").alias("n")).orderBy(*dims).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"the targets make more than {MOST_CELLS} cells")
    tokens = np.array([r.n for r in rows], float)
    place = [{v: k for k, v in enumerate(n)} for n in names]
    members = [np.array([p[r[d]] for r in rows], np.int64) for d, p in zip(dims, place, strict=True)]
    shares = [_shares(w, np.bincount(m, tokens, len(n))) for w, m, n in zip(wanted, members, names, strict=True)]
    take, gap, fraction = rake_within(tokens, members, shares, targets.fraction) if rows else (tokens, 0.0, targets.fraction)
    made = [(*(r[d] for d in dims), float(t / n) if n else 0.0, gap, fraction) for r, t, n in zip(rows, take, tokens, strict=True)]
    return docs.sparkSession.createDataFrame(made, "source string, lang string, topic string, probability double, gap double, fraction double")


def _cell(value: Column, targets: Mapping[str, float]) -> Column:
    """The value if it has a target, else OTHER; null too is OTHER."""
    return F.when(value.isin([k for k in targets if k != OTHER]), value).otherwise(F.lit(OTHER))


def _chance(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on id, text and seed only: a lost task draws the same again."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: Targets | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topics: Topics | None = None) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, probability, gap, fraction, sampled, chance.

    Without targets, tempered() ones are taken; without topics, they are learnt. A row
    is sampled with the probability of its cell, by a number drawn from its id and text: rows
    that repeat both share their fate. gap is by what part of the tokens the marginal that fits worst
    is off its goals, and fraction the part of all tokens that is sampled: the targets'
    one, or what it was lowered to. Null sources and languages count as values without a
    target; null and empty texts have no tokens and no topic, and go with their cell. A cell
    without any tokens has probability 0. An empty table gives no rows; a long text is read
    whole; further columns play no part.
    """
    narrow = materialise(described(docs, seed, id_col, text_col, source_col, lang_col), "mix")
    named = with_topics(narrow, learn_topics(narrow) if topics is None else topics)
    targets = tempered(named) if targets is None else targets
    chances = calibrated(named, targets).select(*[F.col(c).alias(f"cell_{c}") for c in ("source", "lang", "topic")], "probability", "gap", "fraction")
    on = [_cell(F.col(c), getattr(targets, c)) == F.col(f"cell_{c}") for c in ("source", "lang", "topic")]
    return named.join(F.broadcast(chances), on, "left").select(
        "doc_id", "source", "lang", "topic", "n_tokens", "probability", "gap", "fraction", (F.col("chance") < F.col("probability")).alias("sampled"), "chance"
    )


def sample_mix(docs: DataFrame, targets: Targets | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topics: Topics | None = None) -> DataFrame:
    """The rows of `docs` that mix() samples, with their columns. Texts stay where they are:
    ids of which no row is sampled are left out, and rows of an id of which some are, which
    only repeated ids can have, are told apart by the number drawn for them."""
    made = materialise(mix(docs, targets, seed, id_col, text_col, source_col, lang_col, topics), "mix-decisions")
    return keep_decided(docs, made.select("doc_id", F.col("sampled").alias("kept"), F.col("chance").alias("proof")), id_col, _chance(F.col(id_col), F.col(text_col), seed))
