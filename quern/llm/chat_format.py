"""Chat formatting with compiled templates, and reading the output back.

Turns are dealt by conversation, sorted, and streamed through the compiled
template; output rows hold a part of a conversation each, cut between pieces. No
conversation is gathered: memory is bounded by one turn and one part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.template import compile_template

# The format's control strings: fixed values.
TURN, SAYS, END = "<turn>", "<says>", "</turn>"
#: Turns are marked, control strings and backslashes inside texts escaped, and the
#: assistant's texts are what the model learns.
TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role | escape }}" + SAYS
    + '{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}'
    + END + "\n{% endfor %}"
)
_CONTROL = re.compile(r"\\|" + "|".join((TURN, SAYS, END)))
_TOKEN = re.compile(r"\\(.)|(" + "|".join((TURN, SAYS, END)) + ")", re.S)
PART = 1 << 16  # characters after which a part of the output is closed


def escape(text: str) -> str:
    """A backslash before every backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part: int = PART) -> DataFrame:
    """The formatted conversations: conv_id, part, text, learn.

    `turns` has conv_id, turn, role and text; other columns play no part. The parts of
    a conversation, in order, are its output; learn lists the spans of a part's text
    under the loss mask. Rows of a null conv_id are one conversation. Null roles and
    texts are empty; null turns come first, equal turns by role and text, and repeated
    rows are turns of their own. An empty table gives no rows. A long text is one piece and
    lies whole in its part. Parts of a conversation lie next to each other and in order
    within a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})

        def turn_rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

        def rows() -> Iterator[tuple]:
            for conv, own in groupby(turn_rows(), key=lambda r: r[0]):
                number, texts, spans, size = 0, [], [], 0
                for text, learn in render({"role": role, "text": said} for _, role, said in own):
                    if size and size + len(text) > part:
                        yield conv, number, "".join(texts), spans
                        number, texts, spans, size = number + 1, [], [], 0
                    if learn and text:
                        spans.append({"start": size, "end": size + len(text)})
                    texts.append(text)
                    size += len(text)
                yield conv, number, "".join(texts), spans

        yield from _batches(rows(), schema, lambda r: len(r[2]))

    kind = turns.schema["conv_id"].dataType.simpleString()
    made = f"conv_id {kind}, part int, text string, learn array<struct<start: int, end: int>>"
    schema = _arrow(turns.select("conv_id"), [("part", pa.int32()), ("text", pa.string()), ("learn", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    dealt = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, made)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What the formatted text says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 digests role, newline, text, newline of every turn, unescaped;
    loss_sha256 all text under the mask, unescaped. `in_order`: the parts still lie as
    format_conversations() gave them, so they needn't be dealt and sorted again.
    Text outside turns, or a turn without its end, raises ValueError. A null conv_id is a
    conversation like others; parts are never null, as format_conversations() makes them. An
    empty table gives no rows; further columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part_rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "learn")), strict=True)

        def rows() -> Iterator[tuple]:
            for conv, own in groupby(part_rows(), key=lambda r: r[0]):
                reader = Reader()
                for _, text, learn in own:
                    reader.read(text, learn)
                yield (conv, *reader.result())

        yield from _batches(rows(), schema, lambda r: 200)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = _arrow(formatted.select("conv_id"), names)
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.select("conv_id", "text", "learn").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


class Reader:
    """Reads the parts of one conversation in order and digests what they say."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.inside = ""  # "", TURN (in a role) or SAYS (in a text)

    def read(self, text: str, learn: list[dict]) -> None:
        self.chars += len(text)
        for span in learn:
            said = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        at = 0
        for m in _TOKEN.finditer(text):
            self._said(text[at : m.start()])
            at = m.end()
            if m[1] is not None:
                self._said(m[1])
                continue
            if (self.inside, m[2]) not in (("", TURN), (TURN, SAYS), (SAYS, END)):
                raise ValueError(f"{m[2]} out of place")
            self.inside = "" if m[2] == END else m[2]
            if m[2] != TURN:
                self.turns.update(b"\n")
            self.n_turns += m[2] == END
        self._said(text[at:])

    def _said(self, text: str) -> None:
        if self.inside:
            self.turns.update(text.encode("utf-8", "surrogatepass"))
        elif text.strip("\n"):
            raise ValueError("text outside a turn")

    def result(self) -> tuple:
        if self.inside:
            raise ValueError("a turn without its end")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _arrow(ids: DataFrame, more: list[tuple[str, pa.DataType]]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("conv_id", to_arrow_type(ids.schema["conv_id"].dataType)), *more])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_of, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `most` characters."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()
