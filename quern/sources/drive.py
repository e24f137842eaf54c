"""A drive as a data source: items are files in folders, listed, fetched whole, fetched by what changed, and written.

    spark.dataSource.register(Drive)
    spark.read.format("drive").option("path", root)                    all items; option contents=false only lists them
    spark.readStream.format("drive").option("path", root).option("state", folder)   what changed since the scan before
    items.write.format("drive").mode("append").option("path", root)    item_id, text: one file each; a null text deletes

An item's key is its path below the root, its version the time and size of its file. The driver walks the upper
`depth` levels of folders only; tasks list what lies below and read one file at a time. Folders are dealt to `buckets`
by the hash of their path, and every task compares the items of its bucket with what the scan before left of them.

A stream's offset is the number of a scan, and stands for a snapshot of all keys and versions, a Parquet table in
`state`. A task writes its part after its last item. Where several attempts of a task leave parts, what they disagree
upon counts as changed: then an item may come again, but none is lost. Snapshots before a committed one are deleted.
A file that goes while it is read keeps its old state and is looked at again by the next scan. `buckets` and `depth`
belong to a checkpoint and can't be changed later. An empty or missing root has no items.
"""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as store
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "item_id string, version string, scan long, gone boolean, text string"
BUCKETS, DEPTH = 64, 2
ROWS, CHARS = 1000, 4_000_000  # items, and characters of their texts, with which a slice leaves a task


def _slices(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA in slices by number and size; Spark would hold thousands of texts at once."""
    kinds = pa.schema({"item_id": pa.string(), "version": pa.string(), "scan": pa.int64(), "gone": pa.bool_(), "text": pa.string()})
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if len(held) >= ROWS or size >= CHARS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _open(path: str) -> tuple[store.FileSystem, str]:
    """A store and the path within it, without a slash at its end."""
    if "://" in path:
        found, inner = store.FileSystem.from_uri(path)
    else:
        found, inner = store.LocalFileSystem(), path.removeprefix("file:")
    return found, inner.rstrip("/")


@dataclass
class Bucket(InputPartition):
    """Folders of one bucket (path, whether those below belong to it) and the scans at both ends."""

    number: int
    folders: list[tuple[str, bool]]
    start: int = 0
    end: int = 0


class _Folders:
    """The root, its folders by bucket, and the items in them."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.buckets, self.depth = int(options.get("buckets", BUCKETS)), int(options.get("depth", DEPTH))

    def dealt(self) -> dict[int, list[tuple[str, bool]]]:
        fs, root = _open(self.path)
        out: dict[int, list[tuple[str, bool]]] = {}
        level = [""]
        for depth in range(self.depth + 1):
            for folder in level:
                out.setdefault(zlib.crc32(folder.encode()) % self.buckets, []).append((folder, depth == self.depth))
            if depth < self.depth:
                below = (fs.get_file_info(store.FileSelector(f"{root}/{f}".rstrip("/"), allow_not_found=True)) for f in level)
                level = sorted(i.path.removeprefix(f"{root}/") for infos in below for i in infos if i.type == store.FileType.Directory)
        return out

    def items(self, folders: list[tuple[str, bool]]) -> Iterator[tuple[str, str]]:
        """(item_id, version) of the files in folders; those that begin with a dot or are still written don't count."""
        fs, root = _open(self.path)
        for folder, deep in folders:
            infos = fs.get_file_info(store.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True, recursive=deep))
            for info in sorted(infos, key=lambda i: i.path):
                if info.type == store.FileType.File and not info.base_name.startswith("."):
                    yield info.path.removeprefix(f"{root}/"), f"{info.mtime_ns}:{info.size}"

    def text(self, item_id: str) -> str | None:
        """The item's text, null if its file is gone by now."""
        fs, root = _open(self.path)
        try:
            with fs.open_input_stream(f"{root}/{item_id}") as file:
                return file.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return None


class DriveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders = _Folders(options)
        self.contents = str(options.get("contents", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [Bucket(n, folders) for n, folders in sorted(self.folders.dealt().items())]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        return _slices(self._rows(partition))

    def _rows(self, partition: Bucket) -> Iterator[tuple]:
        for item_id, version in self.folders.items(partition.folders):
            text = self.folders.text(item_id) if self.contents else None
            if text is not None or not self.contents:
                yield item_id, version, None, False, text


class DriveStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if "state" not in options:
            raise ValueError("a stream of a drive needs option 'state', a folder that all executors share")
        self.folders, self.state = _Folders(options), options["state"]

    def _offset(self, scan: int) -> dict:
        return {"scan": scan, "buckets": self.folders.buckets, "depth": self.folders.depth}

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        """Every look is a new scan, numbered by the clock, above all that left a snapshot."""
        return self._offset(max(time.time_ns() // 1_000_000, max(self._scans(), default=0) + 1))

    def _scans(self) -> list[int]:
        fs, root = _open(self.state)
        names = (i.base_name for i in fs.get_file_info(store.FileSelector(root, allow_not_found=True)))
        return [int(n.removeprefix("scan=")) for n in names if n.startswith("scan=")]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for at in (start, end):
            if at != self._offset(at["scan"]):
                raise ValueError(f"this checkpoint has {at['buckets']} buckets and depth {at['depth']}")
        dealt = self.folders.dealt()
        return [Bucket(n, dealt.get(n, []), start["scan"], end["scan"]) for n in range(self.folders.buckets)]

    def _known(self, number: int, scan: int) -> dict[str, str | None]:
        """Versions of a bucket's items as a scan left them, null where attempts disagree."""
        if scan == 0:
            return {}
        fs, root = _open(self.state)
        parts = fs.get_file_info(store.FileSelector(f"{root}/scan={scan}/bucket={number}", allow_not_found=True))
        parts = [p.path for p in parts if p.base_name.endswith(".parquet")]
        if not parts:
            raise FileNotFoundError(f"{self.state} has no snapshot of bucket {number} at scan {scan}")
        attempts = []
        for path in parts:
            with fs.open_input_file(path) as file:
                table = pq.ParquetFile(file).read()
            attempts.append(dict(zip(table["item_id"].to_pylist(), table["version"].to_pylist(), strict=True)))
        first, *others = attempts
        agreed = {k: v if all(o.get(k) == v for o in others) else None for k, v in first.items()}
        return {k: None for o in others for k in o} | agreed

    def _leave(self, partition: Bucket, seen: dict[str, str | None]) -> None:
        fs, root = _open(self.state)
        folder = f"{root}/scan={partition.end}/bucket={partition.number}"
        fs.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        table = pa.table({"item_id": pa.array(seen.keys(), pa.string()), "version": pa.array(seen.values(), pa.string())})
        with fs.open_output_stream(f"{folder}/.{name}") as file:
            pq.write_table(table, file)
        fs.move(f"{folder}/.{name}", f"{folder}/{name}.parquet")

    def read(self, partition: Bucket) -> Iterator[tuple]:
        known, seen = self._known(partition.number, partition.start), {}
        for item_id, version in self.folders.items(partition.folders):
            if known.get(item_id) == version:
                seen[item_id] = version
                continue
            text = self.folders.text(item_id)
            if text is not None:
                seen[item_id] = version
                yield item_id, version, partition.end, False, text
            elif item_id in known:
                seen[item_id] = known[item_id]
        for item_id in sorted(known.keys() - seen.keys()):
            yield item_id, known[item_id], partition.end, True, None
        self._leave(partition, seen)

    def commit(self, end: dict) -> None:
        fs, root = _open(self.state)
        for scan in self._scans():
            if scan < end["scan"]:
                fs.delete_dir(f"{root}/scan={scan}")


class SlicedStreamReader(DriveStreamReader):
    """The same rows, in slices."""

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        return _slices(super().read(partition))


class DriveWriter(DataSourceArrowWriter):
    """One file a row, put in place whole; of rows with one key any stays."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("a drive is written by append; delete items by a null text")
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        made: set[str] = set()
        for item_id, content in ((i.as_py(), t) for batch in iterator for i, t in zip(batch.column("item_id"), batch.column("text"), strict=True)):
            text = content.as_py()  # one at a time
            folder, _, name = f"{item_id or ''}".rpartition("/")
            if not name or {"", ".", ".."} & set(item_id.split("/")):
                raise ValueError(f"not a path below the root: {item_id!r}")
            target = f"{root}/{item_id}"
            if text is None:
                if fs.get_file_info(target).type == store.FileType.File:
                    fs.delete_file(target)
                continue
            if folder not in made:
                fs.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
                made.add(folder)
            parts = f"{root}/{folder}".rstrip("/") + f"/.{uuid.uuid4().hex}"
            with fs.open_output_stream(parts) as file:
                file.write(text.encode())
            fs.move(parts, target)
        return WriterCommitMessage()


class Drive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "drive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DriveReader:
        return DriveReader(dict(self.options))

    def streamReader(self, schema) -> SlicedStreamReader:
        return SlicedStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DriveWriter:
        return DriveWriter(dict(self.options), overwrite)
