"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader (FTRL-proximal, McMahan et al. 2013) and scored as
sparse dot products.

Features are computed in parallel. FTRL reads one bounded sample in one task;
the model is a fixed-size vector, broadcast for scoring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_BITS = 18
MAX_LABELLED = 8000  # labelled documents that are learnt from, those whose ids hash lowest; the only bound
EPOCHS = 3
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_PIECE = 1 << 20  # characters that are tokenised at once, and on to the next white space
_SPACE = re.compile(r"\s")
_CACHE = 100_000  # token hashes that a worker remembers


def _token_code(token: str) -> tuple[int, int]:
    """Hash of the lower-cased token, and of its shape (case, digits, or the symbols themselves)."""
    if not (token[0].isalnum() or token[0] == "_"):
        shape = token
    elif token.isupper() and len(token) > 1:
        shape = "AA"
    elif token[0].isupper():
        shape = "Aa"
    else:
        shape = "00" if token[0].isdigit() else "aa"
    return xxhash.xxh64_intdigest(token.lower(), 1), xxhash.xxh64_intdigest(shape, 2)


class Features:
    """Text to a sparse unit vector: hashed 1- and 2-grams of words and of word shapes,
    log(1 + count), and two binned counts (words; share of distinct 2-grams)."""

    def __init__(self, bits: int = HASH_BITS):
        self.bits, self.seen, self.table = bits, {}, np.empty((2, 0), np.uint64)

    def _codes(self, text: str) -> np.ndarray:
        out, end = [], 0
        while end < len(text) or not out:
            at, space = end, _SPACE.search(text, end + _PIECE)  # no token holds white space
            end = space.start() if space else len(text)
            tokens = _TOKEN.findall(text[at:end])
            if len(self.seen) > _CACHE:
                self.seen, self.table = {}, np.empty((2, 0), np.uint64)
            new = list(set(tokens).difference(self.seen))
            if new:
                first = len(self.seen)
                self.seen.update(zip(new, range(first, first + len(new)), strict=True))
                if first + len(new) > self.table.shape[1]:
                    grown = np.empty((2, 2 * (first + len(new))), np.uint64)
                    grown[:, :first] = self.table[:, :first]
                    self.table = grown
                self.table[:, first : first + len(new)] = np.array([_token_code(t) for t in new], np.uint64).T
            out.append(self.table[:, np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))])
        return out[0] if len(out) == 1 else np.concatenate(out, axis=1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        codes = self._codes(text or "")
        word, shape = codes
        with np.errstate(over="ignore"):
            mix = np.uint64(0x9E3779B97F4A7C15)
            pairs = word[:-1] * mix + word[1:]
            again = (word[:-1] == word[1:]).astype(np.uint64)
            shapes = (shape[:-1] * mix + shape[1:]) * mix + again
            bins = np.array([xxhash.xxh64_intdigest(f"words {len(word).bit_length()}", 3), xxhash.xxh64_intdigest(f"distinct {10 * len(np.unique(pairs)) // max(1, len(pairs))}", 3)], np.uint64)
            every = np.concatenate([word, pairs * mix, shape, shapes, bins]) * mix >> np.uint64(64 - self.bits)
        every = np.sort(every.astype(np.int32))
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        index, value = every[first], np.log1p(np.diff(np.append(first, len(every))))
        return index, (value / np.sqrt((value * value).sum())).astype(np.float32)


def ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after `epochs` passes of FTRL-proximal; the last is the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = list(rows)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for index, value, label in rows:
            index, value = np.append(index, size), np.append(value, 1.0)
            w = weights(z[index], n[index])
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    return weights(z, n)


def held_out(id_col) -> F.Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED, bits: int = HASH_BITS) -> np.ndarray:
    """Weights learnt from at most `most` labelled, not held-out documents. An id with
    contradicting labels counts as the lower one; null labels and ids are left out. Rows
    that repeat an id are one document, with the least of their texts; a null text is an
    empty one. Without any usable label every weight is 0 and every score 0.5. Further
    columns play no part."""
    sample = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(bits)
        for batch in batches:
            made = [make(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float32()))],
                ["doc_id", "label", "index", "value"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (index.values.to_numpy(), value.values.to_numpy(), label.as_py())
            for batch in batches
            for index, value, label in zip(batch.column("index"), batch.column("value"), batch.column("label"), strict=True)
        )
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows, 1 << bits).astype(np.float32)], pa.list_(pa.float32()))], ["w"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .mapInArrow(features, f"doc_id {kind}, label double, index array<int>, value array<float>")
    )
    model = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "label", "index").mapInArrow(learn, "w array<float>").collect()
    return np.array(model[0]["w"], np.float32) if model else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. A null text scores as
    an empty one, a long one whole; null and repeated ids are rows like others. An empty
    table gives no rows; further columns play no part."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, w = Features((len(model.value) - 1).bit_length() - 1), model.value
        for batch in batches:
            dots = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                index, value = make(text.as_py())
                dots[k] = w[index] @ value + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], ["doc_id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_accepted(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with their columns. Every row
    is judged by itself, whatever its id; a null text is judged as an empty one, a long one
    whole. An empty table gives no rows. Only the text goes through Python."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make, w = Features((len(model.value) - 1).bit_length() - 1), model.value
        for part in texts:
            dots = np.empty(len(part))
            for k, text in enumerate(part):  # one text's features at a time
                index, value = make(text.as_py())
                dots[k] = w[index] @ value + w[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.filter(F.arrow_udf(run, "double")(F.col(text_col)) >= threshold)
