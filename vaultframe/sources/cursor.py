"""Transcript files as a stream of lines, each once: byte offsets, identity checks, epochs on rotation.

    spark.dataSource.register(TranscriptSource)
    spark.readStream.format("transcripts").option("path", folder).option("cursors", folder_of_its_own).load()

A file's cursor is where the last line read ends, with a digest of the bytes before it, the first
line's digest and the file's identity. A file that is still the same one is read on from there. A
file that was rotated, rewritten or truncated fails one of the checks: it starts a new epoch at its
first byte. Only lines that end with a line feed are read; the rest waits. A line above
``maxLineBytes`` comes without its text but with its digest, length and beginning, and is never
held in memory.

Offsets are cursors, so Spark's own log makes a restarted query go on exactly there. A reader has to
know the last planned offset before Spark tells it (after a restart Spark first asks for the
latest); ``partitions`` therefore writes each planned offset to the folder ``cursors``. Which bytes
a batch reads is decided from its start and end alone: the same generation goes on, another one
starts at its first byte. If a file changed between planning and reading, its planned end no longer
verifies, nothing is read, and the next batch starts the new epoch.

Cursors are as many as files that are there; cursors of files that went are dropped. Options:
path (a folder or a file; of any file system that Arrow knows), pattern (of file names, by default
``*.jsonl``), maxBytesPerFile (of a batch, 256 MiB), maxLineBytes (64 MiB), cursors.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, epoch int, generation string, start long, end long, line string, sha string, oversized boolean, prefix string"
CHUNK, TAIL_BYTES, PREFIX_BYTES, OUT_BYTES = 1 << 20, 4096, 4096, 8 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri))


def _listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files, in order of their names."""
    fs, root = _open(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _tail(file: pa.NativeFile, at: int) -> str:
    """Digest of the bytes before a cursor."""
    return _digest(file.read_at(min(at, TAIL_BYTES), max(0, at - TAIL_BYTES)))


def _head(file: pa.NativeFile, size: int) -> str | None:
    """Digest of the first line, or of its beginning; None while it isn't whole."""
    data = file.read_at(min(size, CHUNK), 0)
    cut = data.find(b"\n")
    return None if cut < 0 and size < CHUNK else _digest(data[: cut if cut >= 0 else CHUNK])


def _last_line_end(file: pa.NativeFile, start: int, size: int, most: int) -> int:
    """The end of the last whole line of the bytes from start, of at most ``most`` bytes unless the first line is longer."""
    limit, at = min(size, start + most), 0
    at = limit
    while at > start:
        lo = max(start, at - CHUNK)
        cut = file.read_at(at - lo, lo).rfind(b"\n")
        if cut >= 0:
            return lo + cut + 1
        at = lo
    at = limit
    while at < size:  # one line is longer than a batch
        data = file.read_at(min(CHUNK, size - at), at)
        cut = data.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(data)
    return start


def _identity(fs: pafs.FileSystem, path: str) -> str:
    if isinstance(fs, pafs.LocalFileSystem):
        s = os.stat(path)
        return f"{s.st_dev}:{s.st_ino}"
    return ""


def cursor_after(fs: pafs.FileSystem, path: str, size: int, old: dict | None, most: int) -> dict | None:
    """The file's next cursor; None before its first line is whole."""
    with fs.open_input_file(path) as file:
        head, identity = _head(file, size), _identity(fs, path)
        if head is None:
            return None
        same = old is not None and old["identity"] == identity and old["head"] == head and old["at"] <= size and _tail(file, old["at"]) == old["tail"]
        start = old["at"] if same else 0
        at = _last_line_end(file, start, size, most)
        generation = old["generation"] if same else _digest(f"{old['generation'] if old else ''}|{identity}|{head}|{'' if old is None or (old['identity'], old['head']) != (identity, head) else old['tail']}".encode())[:16]
        epoch = old["epoch"] + (not same) if old is not None else 0
        return {"epoch": epoch, "generation": generation, "at": at, "tail": _tail(file, at), "head": head, "identity": identity}


@dataclass
class Span(InputPartition):
    root: str
    path: str
    epoch: int
    generation: str
    start: int
    end: int
    tail: str
    most_line: int


def lines(file: pa.NativeFile, start: int, end: int, most_line: int) -> Iterator[tuple[int, int, bytes | None, str, bytes | None]]:
    """(start, end, text, digest, beginning) of each line; above ``most_line`` bytes without text."""
    at, began, parts, size, long = start, start, [], 0, None
    beginning = b""
    while at < end:
        data = file.read_at(min(CHUNK, end - at), at)
        if not data:
            return
        i = 0
        while i < len(data):
            cut = data.find(b"\n", i)
            piece = data[i : cut if cut >= 0 else len(data)]
            if long is None:
                parts.append(piece)
                size += len(piece)
                if size > most_line:
                    long = hashlib.sha256()
                    for p in parts:
                        long.update(p)
                    beginning = b"".join(parts)[:PREFIX_BYTES]
                    parts = []
            else:
                long.update(piece)
            if cut < 0:
                break
            i = cut + 1
            if long is None:
                text = b"".join(parts)
                yield began, at + i, text, _digest(text), None
            else:
                yield began, at + i, None, long.hexdigest(), beginning
            began, parts, size, long = at + i, [], 0, None
        at += len(data)


class TranscriptReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.most, self.most_line = int(options.get("maxbytesperfile", 256 << 20)), int(options.get("maxlinebytes", 64 << 20))
        self.cursors = options["cursors"]
        self.planned: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def _planned(self) -> dict:
        """The newest planned offset, also of an earlier run."""
        if self.planned is None:
            fs, root = _open(self.cursors)
            names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.File and f.base_name.startswith("c"))
            self.planned = {}
            if names:
                with fs.open_input_stream(names[-1]) as s:
                    self.planned = json.loads(s.readall().decode())
        return self.planned

    def _keep(self, end: dict) -> None:
        fs, root = _open(self.cursors)
        fs.create_dir(root, recursive=True)
        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("c"))
        number = int(os.path.basename(names[-1])[1:]) + 1 if names else 0
        with fs.open_output_stream(f"{root}/t{number:012d}") as s:
            s.write(json.dumps(end).encode())
        fs.move(f"{root}/t{number:012d}", f"{root}/c{number:012d}")
        for old in names[:-1]:
            fs.delete_file(old)

    def latestOffset(self) -> dict:
        fs, _ = _open(self.path)
        known, out = self._planned(), {}
        for path, size in _listed(self.path, self.pattern):
            found = cursor_after(fs, path, size, known.get(path), self.most)
            if found or path in known:
                out[path] = found or known[path]
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if end != self.planned:
            self._keep(end)
            self.planned = end
        spans = []
        for path, e in end.items():
            s = start.get(path)
            began = s["at"] if s and s["generation"] == e["generation"] else 0
            if began < e["at"]:
                spans.append(Span(self.path, path, e["epoch"], e["generation"], began, e["at"], e["tail"], self.most_line))
        return spans

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(span.root)
        if fs.get_file_info(span.path).type != pafs.FileType.File:
            return
        with fs.open_input_file(span.path) as file:
            if file.size() < span.end or _tail(file, span.end) != span.tail:
                return  # rewritten since it was planned
            rows, size = [], 0
            for start, end, text, sha, beginning in lines(file, span.start, span.end, span.most_line):
                rows.append((span.path, span.epoch, span.generation, start, end, None if text is None else text.decode("utf-8", "replace"), sha, text is None, None if beginning is None else beginning.decode("utf-8", "replace")))
                size += end - start if text is not None else PREFIX_BYTES
                if size >= OUT_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class TranscriptSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TranscriptReader:
        return TranscriptReader(self.options)


def transcripts(spark: SparkSession, path: str, cursors: str, **options: str) -> DataFrame:
    """The stream of lines of the transcripts below a folder."""
    spark.dataSource.register(TranscriptSource)
    return spark.readStream.format("transcripts").options(path=path, cursors=cursors, **options).load()
