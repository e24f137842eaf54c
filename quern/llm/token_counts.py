"""Token counts by rank-synchronous merging.

The pre-tokens of a batch are held as one ragged numpy array of symbols. Each
round finds the lowest-ranked mergeable pair of every sequence and applies it in
all sequences at once; what is left when no pair merges is the token count.
Every symbol of the vocabulary is made by one merge only, so pairs that appear
during a round rank after it and all places of a pair can merge together.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 2048
_PIECE = 1 << 20  # characters that are split into words at once
_BATCH = 1 << 15  # distinct pre-tokens that are merged at once
_CACHE = 200_000  # pre-tokens whose count a worker remembers
#: White space as the vocabulary's own pattern language has it.
_SPACE = r"\t-\r\x20\x85\xA0  -     　"
#: Letters and numbers of Unicode versions after the library's: to it they are neither. Fixed values.
_NEW_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    r"\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
    r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
)
_FIRST_NEW = 0x558  # the least of both lists; texts below it, most of them, aren't searched
#: Capitals of Unicode versions after Python's, which the library lowers: (first, last, first small letter).
#: Fixed values.
_NEW_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWERED = {c: small + c - first for first, last, small in _NEW_CAPITALS for c in range(first, last + 1)}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for U+0100 and up, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """The parts of a word-end BPE file of the `tokenizers` library that counting needs.

    Raises ValueError for files whose rules differ from those written out here.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, steps = whole["model"], [x["type"] for x in whole["normalizer"]["normalizers"]]
    end = model["end_of_word_suffix"]
    split, level = whole["pre_tokenizer"]["pretokenizers"]
    if model["type"] != "BPE" or not end or steps != ["NFC", "Replace", "Lowercase"] or level["add_prefix_space"] or not split["invert"]:
        raise ValueError(f"not a word-end BPE vocabulary: {path}")
    ids = model["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [ids[a + b] for a, b in pairs]
    letters = _byte_letters()
    if len(set(made)) < len(made) or set(made) & {ids[x] for x in letters}:
        raise ValueError("a symbol is made in several ways; merges can't be applied together")
    keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return {
        "keys": keys[order],
        "ranks": np.arange(len(pairs), dtype=np.int32)[order],
        "made": np.array(made, np.int32)[order],
        "inner": np.array([ids[x] for x in letters], np.int32),
        "final": np.array([ids[x + end] for x in letters], np.int32),
        "pattern": split["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}"),
        "special": [x["content"] for x in whole["added_tokens"]],
    }


def merged_lengths(words: list[bytes], vocabulary: dict) -> np.ndarray:
    """How many symbols survive of each nonempty byte string."""
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8)
    symbol, last = vocabulary["inner"][flat], np.cumsum(lengths) - 1
    symbol[last] = vocabulary["final"][flat[last]]
    word, left = np.repeat(np.arange(len(words)), lengths), lengths.copy()
    keys, ranks, made = vocabulary["keys"], vocabulary["ranks"], vocabulary["made"]
    while True:
        at = np.flatnonzero(word[1:] == word[:-1])
        key = symbol[at].astype(np.int64) << 32 | symbol[at + 1]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[found] == key
        at, found = at[hit], found[hit]
        if not len(at):
            return left
        owner, rank = word[at], ranks[found]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lowest = rank == np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(at))))
        at, found = at[lowest], found[lowest]
        run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))  # a a a: merge from the left, no symbol twice
        turn = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at, found = at[turn % 2 == 0], found[turn % 2 == 0]
        symbol[at] = made[found]
        left -= np.bincount(word[at], minlength=len(words))
        stay = np.zeros(len(words), bool)
        stay[word[at]] = True  # a word without a merge is done
        keep = stay[word]
        keep[at + 1] = False
        symbol, word = symbol[keep], word[keep]


class Counter:
    """Token counts of texts, remembering those of words."""

    def __init__(self, vocabulary: dict):
        self.vocabulary, self.seen = vocabulary, {}
        self.word = regex.compile(vocabulary["pattern"])
        # For the few texts with characters that the pattern libraries class differently.
        known = vocabulary["pattern"].replace(r"\p{L}", rf"[\p{{L}}--[{_NEW_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_NEW_LETTERS}]]")
        self.known_word, self.new = regex.compile(known, regex.V1), regex.compile(f"[{_NEW_LETTERS}{''.join(map(chr, _LOWERED))}]")
        self.special = regex.compile("|".join(map(regex.escape, vocabulary["special"]))) if vocabulary["special"] else None

    def _add(self, words: list[str]) -> None:
        for at in range(0, len(words), _BATCH):
            part = words[at : at + _BATCH]
            self.seen.update(zip(part, merged_lengths([w.encode("utf-8", "surrogatepass") for w in part], self.vocabulary).tolist(), strict=True))

    def _plain(self, text: str) -> int:
        total = at = 0
        while at < len(text):
            cut = len(text) if len(text) - at <= _PIECE else text.find(" ", at + _PIECE)  # a word holds no space
            cut = len(text) if cut < 0 else cut
            piece = text[at:cut]
            at = cut
            if piece.isascii():
                words = self.word.findall(piece.lower())
            else:
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")  # letter by letter: no final sigma
                top = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).max()
                if top >= _FIRST_NEW and self.new.search(piece):
                    words = self.known_word.findall(piece.lower().translate(_LOWERED))
                else:
                    words = self.word.findall(piece.lower())
            if len(self.seen) > _CACHE:
                self.seen.clear()
            self._add(list(set(words).difference(self.seen)))
            total += sum(map(self.seen.__getitem__, words))
        return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special and "<" in text else [text]
        return len(parts) - 1 + sum(map(self._plain, parts))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the `tokenizers` library for the file, without added
    special tokens; the strings of special tokens inside a text count as one each.
    Null and empty texts have no bytes and no tokens. Null and repeated ids are
    rows like others; an empty table gives an empty result; further columns play
    no part. Long texts are counted whole, cut between words only. The vocabulary is read on the driver and broadcast (about 2 MB).
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary.value)
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
        .mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > context)
    )
