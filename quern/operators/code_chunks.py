"""Source code cut where its outermost structures close.

One pass over a text knows strings and comments of the language's family, the depth of
brackets and the indent of lines. Chunks end at ends of lines outside strings and
comments: of those within reach, at the one that lies outermost, and the last of these.
Every file becomes rows in the task that reads it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.chunking import normalise_line_ends

SIZE = 1500
#: What a family's comments and strings are (signs: single quotes hold one sign). Fixed values.
COMMENTS = {
    "braces": r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*",
    "indent": r"\#[^\n]*",
    "sql": r"/\*[\s\S]*?(?:\*/|\Z)|--[^\n]*",
}
COMMENTS["signs"] = COMMENTS["braces"]
STRINGS = {
    "braces": r"`(?:\\[\s\S]|[^`\\])*+(?:`|\\?\Z)|\"(?:\\[^\n]|[^\"\\\n])*\"?|'(?:\\[^\n]|[^'\\\n])*'?",
    "indent": r"\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?",
    "signs": r"\"(?:\\[\s\S]|[^\"\\])*+(?:\"|\\?\Z)|'(?:\\[^\n']{1,9}|\\'|[^'\\\n])'",
    "sql": r"'(?:''|[^'])*(?:'|\Z)|\"(?:\"\"|[^\"])*(?:\"|\Z)",
}
FAMILIES = {
    "py": "indent", "pyi": "indent", "sh": "indent", "rb": "indent", "yaml": "indent", "yml": "indent", "toml": "indent", "r": "indent",
    "sql": "sql", "rs": "signs", "c": "signs", "h": "signs", "cc": "signs", "cpp": "signs", "hpp": "signs", "java": "signs", "cs": "signs", "kt": "signs", "scala": "signs", "swift": "signs",
}
_TOKENS = {f: re.compile(f"(?P<comment>{COMMENTS[f]})|(?P<string>{STRINGS[f]})|(?P<open>[\\[({{])|(?P<close>[\\])}}])|(?P<line>\n)") for f in COMMENTS}
_LEAD = re.compile(r"[ \t\n]*")
_CLOSES = dict(zip(")]}", "([{", strict=True))
Point = tuple[int, int, int, bool]  # end of a line, depth, indent of what follows, whether what stands before belongs to what follows


def family(extension: str | None) -> str:
    """The family of a file's extension; braces for those that aren't known."""
    return FAMILIES.get((extension or "").lower(), "braces")


def scan(text: str, kind: str) -> tuple[list[Point], list[tuple[int, str]]]:
    """Ends of lines outside strings and comments that span lines, and brackets with their places. Blank
    lines belong to what stands before them."""
    out: list[Point] = []
    brackets: list[tuple[int, str]] = []
    depth, line, note = 0, 0, False  # note: the line begins with a comment
    for m in _TOKENS[kind].finditer(text):
        if m.lastgroup == "open":
            depth += 1
            brackets.append((m.start(), m[0]))
        elif m.lastgroup == "close":
            depth = max(0, depth - 1)
            brackets.append((m.start(), m[0]))
        elif m.lastgroup == "comment":
            note = note or not text[line : m.start()].strip()
        elif m.lastgroup == "line":
            own = text[line : m.start()].strip()
            if own:
                follows = _LEAD.match(text, m.end())[0].rpartition("\n")[2]
                out.append((m.end(), depth, len(follows.expandtabs(4)), note or own.startswith("@")))
            elif out and out[-1][0] == line:
                out[-1] = (m.end(), *out[-1][1:])
            line, note = m.end(), False
    return [p for p in out if p[0] < len(text)], brackets


def _fits(brackets: list[tuple[int, str]]) -> bool:
    """Whether every bracket of a piece has its partner in it."""
    open_ = []
    for _, sign in brackets:
        if sign not in _CLOSES:
            open_.append(sign)
        elif not open_ or open_.pop() != _CLOSES[sign]:
            return False
    return not open_


def split_code(text: str, size: int = SIZE, kind: str = "braces") -> list[tuple[int, int, bool, bool]]:
    """(start, end, balanced, forced) of pieces of at most `size` that tile the text. A piece ends at
    the outermost point within reach (by depth, then indent; those that part a comment or a mark from what it
    belongs to come after others of their level), the last of these. `forced` pieces end elsewhere, as no point
    is within reach: at a line's end in the second half of the reach, else anywhere. Pieces that have
    no partner for a bracket aren't balanced, nor forced ones."""
    at, brackets = scan(text, kind)
    ends = [p[0] for p in at]
    out, start, k = [], 0, 0
    while start < len(text):
        reach, forced = start + size, False
        if reach >= len(text):
            end = len(text)
        else:
            near = at[bisect_right(ends, start) : bisect_right(ends, reach)]
            if near:
                end = min(near, key=lambda p: (p[3], p[1], p[2], -p[0]))[0]
            else:
                forced, line = True, text.rfind("\n", start + size // 2, reach) + 1
                end = line or reach
        stop = bisect_left(brackets, (end, ""), k)
        out.append((start, end, not forced and not (out and out[-1][3]) and _fits(brackets[k:stop]), forced))
        start, k = end, stop
    return out


def chunk_code(files: DataFrame, size: int = SIZE, id_col: str = "path", text_col: str = "text", extension: Column | None = None) -> DataFrame:
    """id_col, chunk_index, start_at, end_at, first_line, last_line, balanced, forced, content of files, whose
    language's family goes by `extension` (none: that of id_col, as a path). Null and empty texts have no chunks."""
    if size < 1:
        raise ValueError("a chunk has a character at least")
    ext = F.regexp_extract(F.col(id_col).cast("string"), r"\.([^./]+)$", 1) if extension is None else extension
    at = files.select(F.col(id_col).alias("_id"), ext.alias("ext"), normalise_line_ends(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    names = [id_col, "chunk_index", "start_at", "end_at", "first_line", "last_line", "balanced", "forced", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, line, rows = batch.column("text")[k].as_py(), 1, []
                for n, (a, b, balanced, forced) in enumerate(split_code(text, size, family(batch.column("ext")[k].as_py()))):
                    inner = text.count("\n", a, b)
                    rows.append((n, a, b, line, line + inner - (text[b - 1] == "\n"), balanced, forced, text[a:b]))
                    line += inner
                if rows:
                    types = [pa.int32()] * 5 + [pa.bool_()] * 2 + [pa.string()]
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array([k] * len(rows))), *arrays], names)

    kind = files.schema[id_col].dataType.simpleString()
    return at.mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, start_at int, end_at int, first_line int, last_line int, balanced boolean, forced boolean, content string")
