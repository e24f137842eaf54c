"""Whole files of many kinds to Markdown: a registry of parsers by extension, tried in turn.

Files are rows (path, content), as spark.read.format("binaryFile") gives them; each is parsed
in the task that reads it, and what can't be parsed becomes a row with its error.
"""

from __future__ import annotations

import base64
import email
import io
import json
import posixpath
import re
import xml.etree.ElementTree as xml
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.files import header_labels
from quern.sources.html import table_markdown, to_markdown

Parsed = tuple[str, dict[str, bytes]]  # Markdown, and images by the path that it names


def _text(content: bytes) -> Parsed:
    return content.decode("utf-8-sig"), {}


def _lenient_text(content: bytes) -> Parsed:
    return content.decode("utf-8", "replace"), {}


def _page(content: bytes) -> Parsed:
    title, body, _ = to_markdown(content.decode("utf-8", "replace"))
    return f"# {title}\n\n{body}" if title and title not in body else body, {}


#: Parts of addresses of what isn't a page's own: fixed values.
_ADS = ("doubleclick", "googlesyndication", "googleads", "adservice", "/ads/")


def _web_archive(content: bytes) -> Parsed:
    """The longest page of a web archive that isn't an advertisement, with the archive's images;
    links within the page itself are left out."""
    message = email.message_from_bytes(content)
    pages, images, names = [], {}, {}
    for part in message.walk():
        kind, where = part.get_content_type(), str(part.get("Content-Location", ""))
        data = part.get_payload(decode=True) or b""
        if kind == "text/html":
            pages.append((not any(ad in where.lower() for ad in _ADS), len(data), data.decode(part.get_content_charset() or "utf-8", "replace"), where))
        elif kind.startswith("image/") and data:
            path = f"images/{len(images) + 1}.{kind.split('/')[1].split('+')[0]}"
            images[path] = data
            names |= {where: path} if where else {}
            if part.get("Content-ID"):
                names["cid:" + part["Content-ID"].strip("<>")] = path
    if not pages:
        raise ValueError("no page in the archive")
    _, _, page, where = max(pages, key=lambda p: p[:2])
    body = to_markdown(page, names)[1]
    own = re.escape(where.split("#")[0])
    return re.sub(rf"(?<!!)\[([^\]]*)\]\((?:{own})?#[^)]*\)" if own else r"(?<!!)\[([^\]]*)\]\(#[^)]*\)", r"\1", body), images


def _children(node: xml.Element, *names: str) -> Iterator[xml.Element]:
    return (x for x in node.iter() if x.tag.rsplit("}", 1)[-1] in names)


def _word(content: bytes) -> Parsed:
    """Paragraphs, headings and tables of a word processor's document."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        body = next(_children(xml.fromstring(file.read("word/document.xml")), "body"))
    out = []
    for block in body:
        kind = block.tag.rsplit("}", 1)[-1]
        if kind == "p":
            text = "".join(t.text or "" for t in _children(block, "t"))
            style = next((v for s in _children(block, "pStyle") for v in s.attrib.values()), "")
            level = re.fullmatch(r"[Hh]eading ?([1-6])", style)
            out.append(("#" * int(level[1]) + " " if level else "") + text)
        elif kind == "tbl":
            rows = [["".join(t.text or "" for t in _children(cell, "t")) for cell in row if cell.tag.endswith("}tc")] for row in _children(block, "tr")]
            out.append(table_markdown(rows))
    return "\n\n".join(t for t in out if t.strip()), {}


def _book(content: bytes) -> Parsed:
    """Chapters of an electronic book, in reading order."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        root = next(_children(xml.fromstring(file.read("META-INF/container.xml")), "rootfile")).attrib["full-path"]
        package = xml.fromstring(file.read(root))
        base = root.rpartition("/")[0]
        items = {i.attrib["id"]: i.attrib["href"] for i in _children(package, "item")}
        order = [items[r.attrib["idref"]] for r in _children(package, "itemref") if r.attrib["idref"] in items]
        chapters = [to_markdown(file.read(f"{base}/{name}" if base else name).decode("utf-8", "replace"))[1] for name in order]
    return "\n\n".join(c for c in chapters if c), {}


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells) of a workbook's rows that aren't empty; every cell of a
    merged range has its first one's value."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        names = set(file.namelist())
        shared = ["".join(t.text or "" for t in _children(s, "t")) for s in xml.fromstring(file.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.attrib["Id"]: r.attrib["Target"] for r in xml.fromstring(file.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _children(xml.fromstring(file.read("xl/workbook.xml")), "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].removeprefix("/xl/").removeprefix("xl/")
            tree = xml.fromstring(file.read(f"xl/{target}"))
            cells: dict[tuple[int, int], str] = {}
            for cell in _children(tree, "c"):
                value = next((v.text for v in _children(cell, "v")), None)
                kind = cell.attrib.get("t", "n")
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in _children(cell, "t"))
                elif kind == "b" and value is not None:
                    value = "true" if value == "1" else "false"
                if value is not None:
                    cells[_place(cell.attrib["r"])] = value
            for merged in _children(tree, "mergeCell"):
                (r, c), (r2, c2) = map(_place, merged.attrib["ref"].split(":"))
                if (r, c) in cells:
                    cells |= {(y, x): cells[r, c] for y in range(r, r2 + 1) for x in range(c, c2 + 1)}
            width = max((c for _, c in cells), default=0)
            for row in sorted({r for r, _ in cells}):
                yield sheet.attrib["name"], row, [cells.get((row, c)) for c in range(1, width + 1)]


def _place(ref: str) -> tuple[int, int]:
    letters, number = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    column = 0
    for x in letters:
        column = column * 26 + ord(x) - 64
    return int(number), column


def _image_formula(value: str | None) -> bool:
    return bool(value) and value.startswith("=DISPIMG(")


def _workbook(content: bytes) -> Parsed:
    """Each sheet's rows as 'column: value,...' lines under its name; its first row names the columns.
    Formulas that only show an image count as empty."""
    out, heads = {}, {}
    for sheet, _, cells in workbook_rows(content):
        if sheet not in heads:
            heads[sheet] = header_labels(cells)
            continue
        pairs = [f"{h}: {v}" for h, v in zip(heads[sheet], cells) if v not in (None, "") and not _image_formula(v)]
        if pairs:
            out.setdefault(sheet, []).append(",".join(pairs))
    return "\n\n".join(f"## {sheet}\n\n" + "\n".join(rows) for sheet, rows in out.items()), {}


#: Parsers by extension, in the order in which they are tried.
def _targets(file: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Of a part of an office archive, id to (kind, path) of the parts that it relates to."""
    folder, _, name = part.rpartition("/")
    try:
        relations = xml.fromstring(file.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    out = {}
    for r in _children(relations, "Relationship"):
        target = r.attrib.get("Target", "")
        path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"{folder}/{target}")
        out[r.attrib.get("Id", "")] = (r.attrib.get("Type", "").rpartition("/")[2], path)
    return out


def _said(shape: xml.Element) -> list[str]:
    """The paragraphs of a shape that have text; breaks are spaces."""
    lines = ("".join(" " if x.tag.endswith("}br") else x.text or "" for x in _children(p, "t", "br")) for p in _children(shape, "p"))
    return [line.strip() for line in lines if line.strip()]


def _slides(content: bytes) -> Parsed:
    """Slides of a presentation in the order in which it shows them: titles as headings, paragraphs, tables,
    and the speaker's notes as quotes."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        main = "ppt/presentation.xml"
        parts = _targets(file, main)
        shown = [v for s in _children(xml.fromstring(file.read(main)), "sldId") for k, v in s.attrib.items() if k.endswith("}id")]
        for number, key in enumerate(shown, 1):
            if key not in parts:
                continue
            path = parts[key][1]
            slide, lines, title = xml.fromstring(file.read(path)), [], ""
            for shape in _children(slide, "sp", "graphicFrame"):
                for table in _children(shape, "tbl"):
                    lines.append(table_markdown([[" ".join(_said(cell)) for cell in _children(row, "tc")] for row in _children(table, "tr")]))
                kind = next((p.attrib.get("type", "") for p in _children(shape, "ph")), "")
                if shape.tag.endswith("}sp") and kind in ("title", "ctrTitle") and not title:
                    title = " ".join(_said(shape))
                elif shape.tag.endswith("}sp") and kind not in ("sldNum", "ftr", "dt"):
                    lines += _said(shape)
            for kind, notes in _targets(file, path).values():
                if kind == "notesSlide":
                    shapes = [s for s in _children(xml.fromstring(file.read(notes)), "sp") if not any(p.attrib.get("type") in ("sldNum", "sldImg", "hdr", "ftr", "dt") for p in _children(s, "ph"))]
                    lines += [f"> {line}" for s in shapes for line in _said(s)]
            out.append("\n\n".join([f"## {title or f'Slide {number}'}", *lines]))
    return "\n\n".join(out), {}


Topic = tuple[str, str, list]  # title, note, topics below


def _mind_map(content: bytes) -> Parsed:
    """Sheets of a mind map as nested lists, notes as quotes below their topic; from the newer JSON or the older XML."""

    def of_json(topic: dict) -> Topic:
        below = topic.get("children") or {}
        plain = ((topic.get("notes") or {}).get("plain") or {}).get("content") or ""
        return str(topic.get("title") or ""), str(plain), [of_json(t) for kind in ("attached", "detached") for t in below.get(kind) or []]

    def child(node: xml.Element | None, name: str) -> xml.Element | None:
        return next((x for x in node if x.tag.rsplit("}", 1)[-1] == name), None) if node is not None else None

    def of_xml(topic: xml.Element) -> Topic:
        text = lambda node: "" if node is None else "".join(node.itertext())
        groups = [g for g in child(topic, "children") if g.tag.rsplit("}", 1)[-1] == "topics"] if child(topic, "children") is not None else []
        return text(child(topic, "title")), text(child(child(topic, "notes"), "plain")), [of_xml(t) for g in groups for t in g if t.tag.rsplit("}", 1)[-1] == "topic"]

    with zipfile.ZipFile(io.BytesIO(content)) as file:
        if "content.json" in file.namelist():
            sheets = [(str(s.get("title") or ""), of_json(s.get("rootTopic") or {})) for s in json.loads(file.read("content.json"))]
        else:
            found = list(_children(xml.fromstring(file.read("content.xml")), "sheet"))
            sheets = [("".join(t.itertext()) if (t := child(s, "title")) is not None else "", of_xml(r)) for s in found if (r := child(s, "topic")) is not None]
    out = []
    for name, root in sheets:
        lines, todo = [f"# {name or root[0]}", ""], [(0, root)]
        while todo:  # from the top, without recursion
            depth, (title, note, below) = todo.pop()
            if title.strip():
                lines.append(f"{'  ' * depth}- {' '.join(title.split())}")
                lines += [f"{'  ' * (depth + 1)}> {line.strip()}" for line in note.splitlines() if line.strip()]
            todo += [(depth + bool(title.strip()), t) for t in reversed(below)]
        out.append("\n".join(lines))
    return "\n\n".join(out), {}


PARSERS: dict[str, tuple[Callable[[bytes], Parsed], ...]] = {
    "md": (_text, _lenient_text), "markdown": (_text, _lenient_text), "txt": (_text, _lenient_text), "csv": (_text, _lenient_text), "json": (_text, _lenient_text),
    "html": (_page,), "htm": (_page,), "mhtml": (_web_archive, _page), "mht": (_web_archive, _page),
    "docx": (_word,), "epub": (_book,), "xlsx": (_workbook,), "pptx": (_slides,), "xmind": (_mind_map,),
}


def parse(extension: str, content: bytes) -> tuple[str | None, dict[str, bytes], str | None]:
    """Markdown, images and error of a file: what the first parser gives that gives any text."""
    errors = []
    for parser in PARSERS.get(extension.lower(), ()):
        try:
            text, images = parser(content)
        except Exception as error:  # a file that can't be read is a row with its error
            errors.append(f"{parser.__name__.strip('_')}: {error}")
            continue
        if text.strip():
            return text, images, None
        errors.append(f"{parser.__name__.strip('_')}: no text")
    return None, {}, "; ".join(errors) or f"no parser for {extension!r}"


SLICE, SLICE_SIZE = 256, 4_000_000  # files, and characters and bytes of theirs, that leave a task together


def parse_documents(files: DataFrame) -> DataFrame:
    """path, extension, markdown, images (path, data), error of files (path, content)."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    image = pa.list_(pa.struct([("path", pa.string()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, start, size, held = batch.column("extension").to_pylist(), 0, 0, []
            for k in range(batch.num_rows):  # one file at a time
                text, images, error = parse(kinds[k], batch.column("content")[k].as_py() or b"")
                held.append((text, [{"path": p, "data": d} for p, d in images.items()], error))
                size += len(text or "") + sum(map(len, images.values()))
                if len(held) == SLICE or size >= SLICE_SIZE or k + 1 == batch.num_rows:
                    texts, found, errors = zip(*held, strict=True)
                    own = [batch.column(c).slice(start, len(held)) for c in ("path", "extension")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(found, image), pa.array(errors, pa.string())], ["path", "extension", "markdown", "images", "error"])
                    start, size, held = k + 1, 0, []

    return files.select("path", extension.alias("extension"), "content").mapInArrow(
        run, "path string, extension string, markdown string, images array<struct<path:string,data:binary>>, error string"
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_documents(spark.read.format("binaryFile").load(path).select("path", "content"))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, __sheet_name, row, values: the rows of all sheets of workbooks, as maps from column name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, heads = [], {}
                for sheet, number, cells in workbook_rows(batch.column("content")[k].as_py()):
                    if sheet in heads:
                        rows.append((sheet, number, [(h, v) for h, v in zip(heads[sheet], cells) if v is not None]))
                    else:
                        heads[sheet] = header_labels(cells)
                sheet, number, values = zip(*rows, strict=True) if rows else ((), (), ())
                path = pa.array([batch.column("path")[k].as_py()] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([path, pa.array(sheet, pa.string()), pa.array(number, pa.int32()), pa.array(values, pa.map_(pa.string(), pa.string()))], ["path", "__sheet_name", "row", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, __sheet_name string, row int, `values` map<string,string>")


DATA_IMAGE = r"!\[([^\]]*)\]\(data:image/([a-z+]+);base64,([A-Za-z0-9+/=\s]+)\)"


def inline_images(markdown: Column) -> Column:
    """Images that a Markdown text holds as base64: array of path (named by content) and data."""
    kinds, bodies = (F.regexp_extract_all(markdown, F.lit(DATA_IMAGE), F.lit(k)) for k in (2, 3))
    return F.zip_with(kinds, bodies, lambda kind, body: F.struct(_image_path(kind, body).alias("path"), F.unbase64(body).alias("data")))


def _image_path(kind: Column, body: Column) -> Column:
    return F.concat(F.lit("images/"), F.substring(F.sha2(F.regexp_replace(body, r"\s+", ""), 256), 1, 16), F.lit("."), kind)


def without_inline_images(markdown: Column) -> Column:
    """The text with each of its base64 images named by the path that inline_images() gives it."""
    rest = F.split(markdown, DATA_IMAGE)
    names, kinds, bodies = (F.regexp_extract_all(markdown, F.lit(DATA_IMAGE), F.lit(k)) for k in (1, 2, 3))
    parts = F.transform(F.arrays_zip(names.alias("n"), kinds.alias("k"), bodies.alias("b")), lambda x: F.concat(F.lit("!["), x["n"], F.lit("]("), _image_path(x["k"], x["b"]), F.lit(")")))
    woven = F.zip_with(rest, parts, lambda text, image: F.concat(text, F.coalesce(image, F.lit(""))))
    return F.array_join(woven, "")


def tidy_tables(markdown: Column) -> Column:
    """Markdown tables with one space around cells, without empty rows before the head, and with a line
    under it. Other lines stay as they are."""
    row, dashes, empty = r"^\s*\|.*\|\s*$", r"^\s*\|(\s*:?-+:?\s*\|)+\s*$", r"^\s*\|(\s*\|)+\s*$"
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    tidy = lambda line: F.concat(F.lit("| "), F.array_join(cells(line), " | "), F.lit(" |"))
    under = lambda line: F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(cells(line))))
    lines = F.split(markdown, "\n")
    # State: lines so far, and where a table stands: 0 outside, 1 before its head, 2 after it, 3 in its body.
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def add(s: Column, line: Column) -> Column:
        inside = line.rlike(row)
        none = F.array().cast("array<string>")
        before = s["at"] < 2
        head = inside & before & ~line.rlike(empty) & ~line.rlike(dashes)
        new = (
            F.when(~inside, F.array(line)).when(before & ~head, none).when(head, F.array(tidy(line)))
            .when((s["at"] == 2) & ~line.rlike(dashes), F.array(under(line), tidy(line))).otherwise(F.array(tidy(line)))
        )
        at = F.when(~inside, 0).when(before & ~head, 1).when(head, 2).otherwise(3)
        return F.struct(F.concat(s["out"], new).alias("out"), at.alias("at"))

    return F.array_join(F.aggregate(lines, start, add, lambda s: s["out"]), "\n")


HTML_TABLE = re.compile(r"<table\b.*?</table>", re.S | re.I)


def plain_tables(markdown: Column) -> Column:
    """HTML tables within Markdown as Markdown tables; those with spanning cells keep their tags, without attributes of layout."""

    def one(found: re.Match) -> str:
        block = found[0]
        if re.search(r"\b(row|col)span\s*=", block, re.I):
            return re.sub(r"""\s(style|align|valign|width|height|border|class|bgcolor)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", block, flags=re.I)
        made = to_markdown(block)[1]
        return f"\n\n{made}\n\n" if "| --- |" in made else block

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([None if t is None else HTML_TABLE.sub(one, t) for t in part.to_pylist()], pa.string())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.when(F.contains(F.lower(markdown), F.lit("<table")), F.arrow_udf(run, "string")(markdown)).otherwise(markdown)
