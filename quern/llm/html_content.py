"""Main text of HTML pages by the maximum-scoring subsequence (after Pasternack and Roth 2009).

A page is read once as a sequence of words and tags. Words score above zero and tags below; what
they score is learnt from pages that mark their article themselves (<article>, <main>), from how often
words, linked words and each tag stand inside and outside of it. One linear scan finds the contiguous
stretch with the highest sum. The stretch grows to the element that holds it, if that isn't the page as a whole,
and leaves out menus, footers, forms and the like within: known by their tag, or by the words
of their class, id or role, whose weights are learnt in the same way on top of a list of usual ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 10_000  # pages, those whose ids hash lowest, of which the labelled ones are learnt from; the only bound
KINDS = 20_000  # class words that are kept, those with most words of text
LEAST_COUNT = 20  # words of text, or tags, that a kind must have been seen with
CAP = 4.0
NEUTRAL = frozenset("div section span table tbody tr td".split())  # containers that say little about what they hold
WORD, LINKED = "a word", "a linked word"

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that are never part of an article, and usual words of classes, ids and roles.
APART = frozenset("nav footer aside form search menu dialog button select noscript template svg math object audio video canvas datalist".split())
USUAL_APART = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs pagination pager sidebar sidebars aside widget widgets footer masthead cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay dialog newsletter subscribe subscription signup login search form comment comments commentlist respond reply replies disqus "
    "discussion share sharing social related recommended toolbar skip complementary contentinfo"
).split()
USUAL_CONTENT = "article content main post entry story body text".split()
PRIOR = {**dict.fromkeys(USUAL_APART, -CAP), **dict.fromkeys(USUAL_CONTENT, CAP - 1), "header": -CAP / 2}

_TAG = re.compile(r"<(?:!--(?:-?>|.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_KIND = re.compile(r"(?:^|[\s\"'/])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_KIND_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORDS = re.compile(r"\S+")


def kind_words(attributes: str) -> list[str]:
    """Lower-cased words of an element's class, id, role and itemprop; not those after a "has", "with" or "no"."""
    out, skip = [], False
    for found in _KIND.findall(attributes):
        for word in _KIND_WORD.findall(" ".join(found)):
            word = word.lower()
            if not skip:
                out.append(word)
            skip = word in ("has", "with", "without", "no")
    return out


@dataclass(frozen=True)
class Weights:
    """Scores of words, costs of tags, and weights of class words beyond the usual ones."""

    word: float = 1.0
    linked: float = 0.2
    tags: dict[str, float] = field(default_factory=dict)
    kinds: dict[str, float] = field(default_factory=dict)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.5)

    def kind(self, words: list[str]) -> float:
        return sum(PRIOR.get(w, 0.0) + self.kinds.get(w, 0.0) for w in words)


@dataclass
class Element:
    name: str
    parent: int
    first: int  # events from here on are within
    apart: bool  # it is left out
    hard: bool = False  # by its tag, or that of one around it
    words: tuple[str, ...] = ()
    scope: bool = False
    last: int = -1


class Page:
    """One pass over a page's HTML: events (words or tags) with their elements and blocks."""

    def __init__(self, html: str | None, weights: Weights):
        self.weights = weights
        self.elements = [Element("", -1, 0, False, scope=True)]
        self.stack = [0]
        self.open: Counter[str] = Counter()
        # Of each scope (a block element): where a paragraph is open in it, and its open inline elements.
        self.paragraph, self.inline = [-1], [Counter()]
        self.links = 0
        self.score: list[float] = []
        self.at: list[int] = []  # element of each event
        self.texts: list[str | None] = []  # of each event
        self.blocks: list[int] = []
        self.counts: list[int] = []
        self.block = 0
        self._read(html or "")

    def _read(self, html: str) -> None:
        at = 0
        while True:
            found = _TAG.search(html, at)
            end = found.start() if found else len(html)
            if end > at:
                self._text(html[at:end])
            if not found:
                break
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if found[1] or found[4]:
                self._end(name)
                continue
            self._start(name, found[3] or found[6] or "")
            if name in RAW:
                close = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
        for k in self.stack:
            self.elements[k].last = len(self.score)

    def _event(self, score: float, text: str | None, count: int) -> None:
        self.score.append(score)
        self.at.append(self.stack[-1])
        self.texts.append(text)
        self.blocks.append(self.block)
        self.counts.append(count)

    def _text(self, raw: str) -> None:
        text = unescape(raw)
        count = sum(1 for _ in _WORDS.finditer(text))
        own = self.elements[self.stack[-1]].apart
        self._event(0.0 if own else count * (self.weights.linked if self.links else self.weights.word), text, count)

    def _pop(self) -> None:
        k = self.stack.pop()
        element = self.elements[k]
        element.last = len(self.score)
        self.open[element.name] -= 1
        self.links -= element.name == "a"
        if element.scope:
            self.paragraph.pop()
            self.inline.pop()
        elif element.name == "p":
            self.paragraph[-1] = -1
        else:
            self.inline[-1][element.name] -= 1

    def _start(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if block and self.paragraph[-1] >= 0:  # a block ends the paragraph that is open
            depth = self.paragraph[-1]
            while len(self.stack) > depth:
                self._pop()
        if name == "body" or name == "html":
            return
        self.block += block
        above = self.elements[self.stack[-1]]
        self._event(0.0 if above.apart else self.weights.tag(name), " " if name == "br" else None, 0)
        if name in VOID or name in RAW:
            return
        words = tuple(kind_words(attributes)) if "=" in attributes else ()
        article = self.open["article"] + self.open["main"] > 0
        hard = name in APART or (name == "header" and not article)
        soft = bool(words) and name != "main" and (name != "article" or self.open["article"] > 0) and self.weights.kind(words) < 0
        around = above.apart and (above.hard or name != "main")
        scope = block and name != "p"
        self.elements.append(Element(name, self.stack[-1], len(self.score), hard or soft or around, hard or (above.apart and above.hard), words, scope))
        self.stack.append(len(self.elements) - 1)
        self.open[name] += 1
        self.links += name == "a"
        if scope:
            self.paragraph.append(-1)
            self.inline.append(Counter())
        elif name == "p":
            self.paragraph[-1] = len(self.stack) - 1
        else:
            self.inline[-1][name] += 1

    def _end(self, name: str) -> None:
        block = name in BLOCKS
        self.block += block
        inside = self.elements[self.stack[-1]].apart
        if name not in ("body", "html") and (self.open[name] if block and name != "p" else self.paragraph[-1] >= 0 if name == "p" else self.inline[-1][name]):
            while self.elements[self.stack[-1]].name != name:
                self._pop()
            self._pop()
        if name not in VOID:
            self._event(0.0 if inside else self.weights.tag(name), None, 0)

    def article_of(self, k: int) -> int:
        """The innermost article around element k or at it, else the innermost main, else -1."""
        found = -1
        while k >= 0:
            if self.elements[k].name == "article" and not self.elements[k].apart:
                return k
            if self.elements[k].name == "main" and found < 0:
                found = k
            k = self.elements[k].parent
        return found

    def region(self) -> tuple[int, int]:
        """The events of the main content: first, one past last."""
        first, last = best_stretch(self.score)
        if first == last:
            return first, last
        k = self.at[first]
        while not (self.elements[k].first <= first and last <= self.elements[k].last):
            k = self.elements[k].parent
        marked = self.article_of(k)
        k = marked if marked >= 0 else k
        return (self.elements[k].first, self.elements[k].last) if k else (first, last)

    def text(self) -> str:
        """The main content's blocks, white space turned into single spaces, joined by blank lines."""
        first, last = self.region()
        # A stretch within the page as a whole takes in the rest of its first and last blocks.
        while first and first < last and self.blocks[first - 1] == self.blocks[first] and self.at[first - 1] == self.at[first]:
            first -= 1
        while first < last < len(self.blocks) and self.blocks[last] == self.blocks[last - 1] and self.texts[last] is not None:
            last += 1
        made: dict[int, list[str]] = {}
        for e in range(first, last):
            if self.texts[e] is not None and not self.elements[self.at[e]].apart:
                made.setdefault(self.blocks[e], []).append(self.texts[e])
        blocks = (" ".join("".join(parts).split()) for parts in made.values())
        return "\n\n".join(b for b in blocks if b)

    def label_counts(self) -> dict[tuple[str, bool], list[int]]:
        """How often words, tags and class words' texts stand inside the article that the page
        marks, and outside: (kind, whether it is a class word) to [inside, outside]. Empty if it marks none."""
        if not any(e.name in ("article", "main") and not e.apart for e in self.elements):
            return {}
        out: dict[tuple[str, bool], list[int]] = {}
        marked: list[bool] = []
        around: list[frozenset[str]] = []  # class words of each element and those around it
        for k, e in enumerate(self.elements):
            up = marked[e.parent] if k else False
            marked.append(not e.apart and (up or e.name in ("article", "main")))
            above = around[e.parent] if k else frozenset()
            around.append(above.union(e.words) if e.words else above)
        within: dict[int, list[int]] = {}
        for e in range(len(self.score)):
            k, n = self.at[e], self.counts[e]
            if n:
                outside = not marked[k]
                own = within.setdefault(k, [0, 0])
                own[outside] += n
        for k, own in within.items():
            for w in around[k]:
                c = out.setdefault((w, True), [0, 0])
                c[0], c[1] = c[0] + own[0], c[1] + own[1]
            linked = WORD
            j = k
            while j > 0 and not self.elements[j].scope:
                linked = LINKED if self.elements[j].name == "a" else linked
                j = self.elements[j].parent
            c = out.setdefault((linked, False), [0, 0])
            c[0], c[1] = c[0] + own[0], c[1] + own[1]
        for k, e in enumerate(self.elements[1:], 1):
            c = out.setdefault((e.name, False), [0, 0])
            c[not marked[k]] += 1
        return out


def best_stretch(score: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the highest sum above 0, the first of equals: first, one past last."""
    best, at, sum_, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(score):
        if sum_ <= 0:
            sum_, start = 0.0, k
        sum_ += s
        if sum_ > best:
            best, at = sum_, (start, k + 1)
    return at


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = LABELLED) -> Weights:
    """Weights from those pages that mark an article, of the `most` pages whose ids hash lowest (and
    others with the hash of the last). Without any such page, the usual weights."""
    low = F.xxhash64(F.col(id_col))
    bound = pages.select(low.alias("low")).orderBy("low").limit(most).agg(F.max("low")).first()[0]
    if bound is None:
        return Weights()
    sample = pages.filter((low <= bound) & F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(html_col).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for html in batch.column("html"):
                for kind, (a, b) in Page(html.as_py(), Weights()).label_counts().items():
                    own = total.setdefault(kind, [0, 0])
                    own[0], own[1] = own[0] + a, own[1] + b
        rows = [(k, c, a, b) for (k, c), (a, b) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["kind", "class", "inside", "outside"])

    sums = sample.mapInArrow(count, "kind string, class boolean, inside long, outside long").groupBy("kind", "class").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    seen = sums.withColumn("n", F.col("inside") + F.col("outside")).filter(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "kind", "class").limit(KINDS).collect()
    return fitted([(r["kind"], r["class"], r.inside, r.outside) for r in seen])


def fitted(seen: list[tuple[str, bool, int, int]]) -> Weights:
    """Log odds of standing inside; above zero for words, below it for tags."""
    odds = {(k, c): float(np.clip(np.log((a + 1) / (b + 1)), -CAP, CAP)) for k, c, a, b in seen}
    usual = Weights()
    return Weights(
        max(odds.get((WORD, False), usual.word), 0.1), max(min(odds.get((LINKED, False), usual.linked), odds.get((WORD, False), usual.word)), 0.05),
        {k: min(max(v, -1.0) if k in NEUTRAL else v, -0.05) for (k, c), v in odds.items() if not c and k not in (WORD, LINKED)}, {k: v for (k, c), v in odds.items() if c},
    )


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (its code points).

    A null or empty page, and one without words outside of menus and the like, has an
    empty text. Null and repeated ids are rows like others. A long page is read whole, in
    time and memory in proportion to its length, however it is nested or broken. An empty
    table gives no rows; further columns play no part. No row is moved.
    """
    model = pages.sparkSession.sparkContext.broadcast(weights)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py(), model.value).text() for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = f"page_id {pages.schema[id_col].dataType.simpleString()}, url {pages.schema[url_col].dataType.simpleString()}, text string"
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(read, kinds).withColumn("n_chars", F.length("text").cast("long"))
