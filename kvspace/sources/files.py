"""Data sources that read files piece by piece: bounded lines, and range-query envelopes series by series.

Both open files through Arrow's file systems, in the tasks. Text is told to be gzip by its first
bytes, whatever its name. A plain file is read in splits of SPLIT bytes, a gzip file in one
task; a task holds a chunk and one line, or one series, at a time.
"""

from __future__ import annotations

import fnmatch
import json
import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20
SPLIT = 64 << 20
#: Bytes of lines, or samples of series, that are sent on at a time.
BATCH_BYTES, BATCH_SAMPLES = 4 << 20, 50_000
_GZIP = b"\x1f\x8b"  # a fixed value


def file_system(path: str) -> tuple[fs.FileSystem, str] | None:
    """(file system, path in it), or None for a store that only Spark can read."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), local[1]
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path with wildcards names, in folders below it too; none that begin with ``_`` or ``.``."""
    found = file_system(path)
    if found is None:
        raise ValueError(f"no file system for {path}")
    store, inner = found
    parts = inner.rstrip("/").split("/")
    fixed = next((k for k, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts))
    base = "/".join(parts[:fixed]) or "/"
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    out = []
    for f in every:
        below = f.path[len(base) :].strip("/").split("/")
        asked = parts[fixed:]
        if f.type == fs.FileType.File and all(fnmatch.fnmatchcase(b, a) for a, b in zip(asked, below, strict=False)) and len(below) >= len(asked) and not any(b[:1] in ("_", ".") for b in below if b):
            out.append((f.path, f.size))
    return sorted(out)


def splits(path: str, size: int = SPLIT) -> list[tuple[str, int, int, int]]:
    """(file, number, begin, end) of what each task reads; a gzip file is one split with no end (-1)."""
    store, out = file_system(path)[0], []
    for name, n in list_files(path):
        with store.open_input_file(name) as f:
            packed = f.read(2) == _GZIP
        out += [(name, 0, 0, -1)] if packed else [(name, k, a, min(a + size, n)) for k, a in enumerate(range(0, n, size))]
    return out


def plain_chunks(stream: Any, end: int | None = None) -> Iterator[bytes]:
    while (end is None or stream.tell() < end) and (chunk := stream.read(CHUNK)):
        yield chunk


def gzip_chunks(stream: Any, limit: int | None = None) -> Iterator[bytes]:
    """The expanded bytes of all members, a chunk at a time however well they were packed."""
    total, member, rest = 0, zlib.decompressobj(31), b""
    fresh = True
    while True:
        if not rest:
            rest = stream.read(CHUNK)
            if not rest:
                break
        if member.eof:
            member, fresh = zlib.decompressobj(31), True
        out = member.decompress(rest, CHUNK)
        fresh = False
        rest = member.unused_data if member.eof else member.unconsumed_tail
        if out:
            total += len(out)
            if limit is not None and total > limit:
                raise ValueError(f"expanded input exceeds {limit} bytes")
            yield out
    if not fresh and not member.eof:
        raise ValueError("gzip data ends too early")


def bounded_lines(chunks: Iterator[bytes], longest: int) -> Iterator[list[bytes | None]]:
    """Lines without their end, None for each longer than ``longest``; never more than that of one is kept."""
    kept, over, open_line = b"", False, False
    for chunk in chunks:
        *whole, rest = chunk.split(b"\n")
        out: list[bytes | None] = []
        for piece in whole:
            out.append(None if over or len(kept) + len(piece) > longest else (kept + piece).removesuffix(b"\r"))
            kept, over = b"", False
        open_line = bool(rest) or (open_line and not whole)
        over = over or len(kept) + len(rest) > longest
        kept = b"" if over else kept + rest
        yield out
    if open_line:
        yield [None if over else kept.removesuffix(b"\r")]


def _from_first_line(chunks: Iterator[bytes], owned: int) -> Iterator[bytes]:
    """What a split owns of the bytes from its begin on: from after the first line end to the first one at ``owned`` or behind.

    The first split's bytes are led by one line end, which is no byte of the file.
    """
    at, started = 0, False
    for chunk in chunks:
        begin = 0
        if not started:
            end = chunk.find(b"\n")
            if end < 0 or at + end >= owned:
                if end >= 0 or at + len(chunk) > owned:
                    return
                at += len(chunk)
                continue
            begin, started = end + 1, True
        stop = chunk.find(b"\n", max(begin, owned - at)) if at + len(chunk) > owned else -1
        if stop >= 0:
            yield chunk[begin : stop + 1]
            return
        yield chunk[begin:]
        at += len(chunk)


class Split(InputPartition):
    def __init__(self, file: str, number: int, begin: int, end: int) -> None:
        self.file, self.number, self.begin, self.end = file, number, begin, end


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.longest = options["path"], int(options["longest"])
        self.limit = int(options["expanded"]) if "expanded" in options else None
        self.size = int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        return [Split(*s) for s in splits(self.path, self.size)] or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        number, held, size = 0, [], 0

        def batch() -> pa.RecordBatch:
            n = len(held)
            text = pa.array(held, pa.binary()).view(pa.string())  # as it is: a broken line is told later
            columns = [pa.array([partition.file] * n), pa.array([partition.number] * n, pa.int32()), pa.array(range(number - n + 1, number + 1), pa.int64()), text, pa.array([x is None for x in held])]
            return pa.RecordBatch.from_arrays(columns, names=["file", "part", "number", "line", "overlong"])

        with file_system(self.path)[0].open_input_file(partition.file) as f:
            if partition.end < 0:
                chunks = gzip_chunks(f, self.limit)
            else:
                # a line belongs to the split that the byte before it lies in
                f.seek(max(partition.begin - 1, 0))
                chunks = plain_chunks(f)
                if partition.begin == 0:
                    chunks = _led(chunks)
                chunks = _from_first_line(chunks, partition.end - partition.begin)
            for lines in bounded_lines(chunks, self.longest):
                for line in lines:
                    number += 1
                    held.append(line)
                    size += len(line or b"") + 16
                    if size >= BATCH_BYTES:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


def _led(chunks: Iterator[bytes]) -> Iterator[bytes]:
    yield b"\n"
    yield from chunks


class Lines(DataSource):
    """Options: path, longest (bytes of a line), expanded (bytes of a gzip file, at most), split."""

    @classmethod
    def name(cls) -> str:
        return "kvspace_lines"

    def schema(self) -> str:
        return "file string, part int, number long, line string, overlong boolean"

    def reader(self, schema: Any) -> LineReader:
        return LineReader(self.options)


class Number(str):
    """The text of a JSON number."""


class JsonPieces:
    """A JSON text that is read value by value."""

    def __init__(self, stream: Any, chunk: int = CHUNK) -> None:
        self.stream, self.chunk = stream, chunk
        self.text, self.at, self.ended, self.held = "", 0, False, b""
        self.decoder = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_no_constant)

    def _more(self, size: int) -> None:
        raw = self.stream.read(size)
        self.ended = not raw
        data = self.held + raw
        whole = len(data)
        for back in range(1, min(4, len(data)) + 1):  # a character that the chunk cuts waits for the next one
            lead = data[-back]
            if lead >= 0xC0:
                whole = len(data) - back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else len(data)
                break
        if self.ended:
            whole = len(data)
        self.held = data[whole:]
        self.text = self.text[self.at :] + data[:whole].decode()
        self.at = 0

    def peek(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in " \t\r\n":
                    return self.text[self.at]
                self.at += 1
            if self.ended:
                return ""
            self._more(self.chunk)

    def take(self, *signs: str) -> str:
        found = self.peek()
        if found not in signs or not found:
            raise ValueError(f"JSON is damaged: {found or 'its end'} where one of {' '.join(signs)} belongs")
        self.at += 1
        return found

    def value(self) -> Any:
        """The next value; numbers as their text. Each try reads twice as much, so the work is linear."""
        self.peek()
        size = self.chunk
        while True:
            try:
                found, end = self.decoder.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:
                    self.at = end
                    return found
            except json.JSONDecodeError:
                if self.ended:
                    raise ValueError("JSON is damaged or ends too early") from None
            self._more(size)
            size *= 2

    def names(self) -> Iterator[str]:
        """The names of an object; the value of each has to be read before the next is asked for."""
        self.take("{")
        if self.peek() == "}":
            self.at += 1
            return
        while True:
            name = self.value()
            if not isinstance(name, str) or self.take(":") != ":":
                raise ValueError("JSON is damaged: an object's name is no text")
            yield name
            if self.take(",", "}") == "}":
                return

    def items(self) -> Iterator[Any]:
        """The values of an array, each when it is asked for."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            if self.take(",", "]") == "]":
                return


def _no_constant(name: str) -> None:
    raise ValueError(f"JSON has no {name}")


def _text(x: Any) -> str | None:
    return x if x is None else str(x) if isinstance(x, str) else json.dumps(x)


def matrix_series(stream: Any, max_series: int, max_samples: int, chunk: int = CHUNK) -> Iterator[tuple[int, list[tuple[str, str]], list[list[str | None]]]]:
    """(number, labels, values) of each series of an envelope, as it is read; a bad envelope, or one too large, is an error."""
    pieces = JsonPieces(stream, chunk)
    status = kind = None
    there, series, samples = False, 0, 0
    for name in pieces.names():
        if name == "status":
            status = pieces.value()
        elif name != "data" or pieces.peek() != "{":
            pieces.value()
        else:
            for part in pieces.names():
                if part == "resultType":
                    kind = pieces.value()
                elif part != "result" or pieces.peek() != "[":
                    pieces.value()
                else:
                    there = True
                    for one in pieces.items():
                        if series == max_series:
                            raise ValueError("series limit exceeded")
                        labels, values = (one.get("metric") or {}, one.get("values") or []) if isinstance(one, dict) else (None, None)
                        if not isinstance(labels, dict) or not all(type(x) is str for x in labels.values()) or not isinstance(values, list) or not all(isinstance(v, list) for v in values):
                            raise ValueError("a series is not of labels and pairs")
                        samples += len(values)
                        if samples > max_samples:
                            raise ValueError("sample limit exceeded")
                        yield series, list(labels.items()), [[_text(x) for x in v] for v in values]
                        series += 1
    if pieces.peek():
        raise ValueError("there is more after the envelope")
    for good, problem in ((status == "success", "response status is not success"), (kind == "matrix", "resultType must be matrix"), (there, "matrix result is missing")):
        if not good:
            raise ValueError(problem)


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most = options["path"], (int(options["series"]), int(options["samples"]))

    def partitions(self) -> list[Split]:
        return [Split(name, 0, 0, n) for name, n in list_files(self.path)] or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        kinds = (pa.int32(), pa.map_(pa.string(), pa.string()), pa.list_(pa.list_(pa.string())))
        held, size = [], 0
        with file_system(self.path)[0].open_input_file(partition.file) as f:
            for row in matrix_series(f, *self.most):
                held.append(row)
                size += len(row[2]) + 1
                if size >= BATCH_SAMPLES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["series_id", "metric", "values"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["series_id", "metric", "values"])


class Matrix(DataSource):
    """Options: path, series, samples (how many an envelope may have)."""

    @classmethod
    def name(cls) -> str:
        return "kvspace_matrix"

    def schema(self) -> str:
        return "series_id int, metric map<string,string>, values array<array<string>>"

    def reader(self, schema: Any) -> MatrixReader:
        return MatrixReader(self.options)
