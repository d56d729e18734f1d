"""Data sources of files that Spark's own readers cannot split or hold: raw float32 matrices and chunk envelopes.

Files are opened by the tasks through ``pyarrow.fs``, by path or by an address it knows (file, hdfs, s3, gs, abfs). A
matrix is read in byte ranges; an envelope as a stream of its chunks, so neither is ever held whole.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
BATCH_CHUNKS = 256
READ_CHARS = 1 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; ``file:`` in any number of slashes is this machine's."""
    local = re.sub("^file:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(path)


def matrix_files(path: str, dim: int) -> list[tuple[str, int]]:
    """(file, rows) of a matrix: the file itself, or the ``.f32`` files of a folder in the order of their names."""
    store, at = open_fs(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.is_file else sorted((x for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".f32")), key=lambda x: x.path)
    for x in infos:
        if x.size % (4 * dim):
            raise ValueError(f"{x.path}: {x.size} bytes are no whole number of rows of {dim} float32 values")
    return [(x.path, x.size // (4 * dim)) for x in infos]


@dataclass
class MatrixRange(InputPartition):
    """Rows ``first`` to ``first + rows`` of a file, the first of which has the id ``id``."""

    file: str
    first: int
    rows: int
    id: int


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, dim: int, range_bytes: int):
        self.path, self.dim = path, dim
        self.range_rows = max(1, range_bytes // (4 * dim))

    def partitions(self) -> list[MatrixRange]:
        out, at = [], 0
        for file, rows in matrix_files(self.path, self.dim):
            out += [MatrixRange(file, k, min(self.range_rows, rows - k), at + k) for k in range(0, rows, self.range_rows)]
            at += rows
        return out or [MatrixRange("", 0, 0, 0)]

    def read(self, partition: MatrixRange) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        store, _ = open_fs(self.path)
        step, width = max(1, BATCH_BYTES // (4 * self.dim)), 4 * self.dim
        with store.open_input_file(partition.file) as f:
            for k in range(0, partition.rows, step):
                rows = min(step, partition.rows - k)
                values = np.frombuffer(f.read_at(rows * width, (partition.first + k) * width), "<f4").astype(np.float32)
                edges = pa.array(np.arange(0, (rows + 1) * self.dim, self.dim, dtype=np.int32))
                ids = pa.array(np.arange(partition.id + k, partition.id + k + rows))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(edges, pa.array(values))], ["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    name: str


class MatrixWriter(DataSourceArrowWriter):
    """One file for each task, in the order of partitions; files get their names when all tasks are done."""

    def __init__(self, path: str, dim: int):
        self.path, self.dim = path, dim

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = open_fs(self.path)
        store.create_dir(at, recursive=True)
        name = f"part-{task.partitionId():08d}.f32"
        temporary = posixpath.join(at, f".{name}-{task.taskAttemptId()}")
        with store.open_output_stream(temporary) as f:
            for batch in iterator:
                column = batch.column("embedding")
                lengths = column.value_lengths().to_numpy(zero_copy_only=False)
                if column.null_count or (lengths != self.dim).any():
                    raise ValueError(f"a vector is null or has not {self.dim} values")
                f.write(column.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
        return Written(temporary, posixpath.join(at, name))

    def commit(self, messages: list[Written]) -> None:
        store, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.name)

    def abort(self, messages: list[Written]) -> None:
        store, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.temporary)


class Float32Matrix(DataSource):
    """``spark.read.format("float32_matrix").option("dim", n).load(path)``: row number and vector of a raw row-major matrix."""

    @classmethod
    def name(cls) -> str:
        return "float32_matrix"

    def schema(self) -> str:
        return "vec_id bigint, embedding array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options["dim"]), int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], int(self.options["dim"]))


class _Text:
    """A JSON text read piece by piece; what has been used up is let go."""

    def __init__(self, stream):
        self.stream, self.buffer, self.at, self.ended = stream, "", 0, False
        self.decoder = json.JSONDecoder()

    def more(self) -> bool:
        piece = self.stream.read(READ_CHARS)
        self.buffer, self.at = self.buffer[self.at :] + piece, 0
        self.ended = not piece
        return not self.ended

    def peek(self) -> str:
        """The next character that is no white space, empty at the end."""
        while True:
            rest = len(self.buffer)
            while self.at < rest and self.buffer[self.at] in " \t\r\n﻿":
                self.at += 1
            if self.at < rest:
                return self.buffer[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> str:
        found = self.peek()
        if not found or found not in wanted:
            raise ValueError(f"{wanted!r} expected, {found!r} found")
        self.at += 1
        return found

    def value(self):
        """The value that begins here. A number cut by the end of the buffer may go on, so more is read first."""
        self.peek()
        while True:
            try:
                value, end = self.decoder.raw_decode(self.buffer, self.at)
                if self.buffer[end : end + 1] in tuple(",]}: \t\r\n") or self.ended or not self.more_kept():
                    self.at = end
                    return value
            except ValueError:
                if not self.more_kept():
                    raise

    def more_kept(self) -> bool:
        """Reads at least as much as is held, so that a long value is not tried too often."""
        held, got = len(self.buffer) - self.at, 0
        while got <= held and self.more():
            got = len(self.buffer) - held
        return got > 0


def envelope_parts(stream) -> Iterator[tuple[str, object]]:
    """(name, value) of an envelope's fields in their order; ``chunks`` gives a pair for each chunk."""
    text = _Text(stream)
    text.take("{")
    if text.peek() == "}":
        return
    while True:
        name = text.value()
        text.take(":")
        if name == "chunks" and text.peek() == "[":
            text.take("[")
            if text.peek() == "]":
                text.take("]")
            else:
                yield name, text.value()
                while text.take(",]") == ",":
                    yield name, text.value()
        else:
            value = text.value()
            if name != "chunks":
                yield name, value
        if text.take(",}") == "}":
            return


@dataclass
class EnvelopeFile(InputPartition):
    path: str


_CHUNK = pa.struct([("chunk_id", pa.string()), ("year", pa.int32()), ("month", pa.string()), ("conv_id", pa.string()), ("text", pa.string()), ("embedding", pa.list_(pa.float32()))])


def _chunk(value) -> dict:
    """A chunk's fields; what is missing or of another type is null, numbers and ids become text where text is wanted."""
    value = value if isinstance(value, dict) else {}
    out = {f: value.get(f) for f in ("chunk_id", "year", "month", "conv_id", "text", "embedding")}
    for f in ("chunk_id", "month", "conv_id", "text"):
        if out[f] is not None and not isinstance(out[f], str):
            out[f] = json.dumps(out[f])
    if not isinstance(out["year"], int) or isinstance(out["year"], bool):
        out["year"] = None
    if not isinstance(out["embedding"], list):
        out["embedding"] = None
    return out


class EnvelopeReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[EnvelopeFile]:
        return [EnvelopeFile(p) for p in self.paths]

    def _stream(self, path: str):
        import io

        store, at = open_fs(path)
        return io.TextIOWrapper(store.open_input_stream(at), encoding="utf-8")

    def _header(self, path: str) -> tuple[str | None, bool]:
        """Name and completion flag, wherever they stand; chunks before them are passed over."""
        found: dict[str, object] = {}
        with self._stream(path) as stream:
            for name, value in envelope_parts(stream):
                if name in ("scripture", "complete"):
                    found[name] = value
                    if len(found) == 2:
                        break
        return found.get("scripture"), bool(found.get("complete"))

    def read(self, partition: EnvelopeFile) -> Iterator[pa.RecordBatch]:
        path = partition.path
        try:
            scripture, complete = self._header(path)
            with self._stream(path) as stream:
                held, position, size = [], 0, 0
                for name, value in envelope_parts(stream):
                    if name != "chunks":
                        continue
                    held.append(_chunk(value))
                    size += len(held[-1]["text"] or "") + 8 * len(held[-1]["embedding"] or ())
                    if len(held) == BATCH_CHUNKS or size > BATCH_BYTES:
                        yield self._batch(scripture, complete, path, position, held)
                        held, position, size = [], position + len(held), 0
                if held:
                    yield self._batch(scripture, complete, path, position, held)
        except ValueError as e:
            raise ValueError(f"{path} is no chunk envelope: {e}") from e

    @staticmethod
    def _batch(scripture, complete, path, position, held) -> pa.RecordBatch:
        n = len(held)
        chunks = pa.array(held, _CHUNK)
        columns = [pa.array([scripture] * n, pa.string()), pa.array([complete] * n), pa.array([path] * n), pa.array(range(position, position + n), pa.int64())]
        return pa.RecordBatch.from_arrays(columns + chunks.flatten(), ["scripture", "complete", "path", "position", *(f.name for f in _CHUNK)])


class ChunkEnvelopes(DataSource):
    """Chunks of ``*_embeddings.json`` files: ``paths`` is a JSON list, one file a task, chunks streamed in batches."""

    @classmethod
    def name(cls) -> str:
        return "chunk_envelopes"

    def schema(self) -> str:
        return (
            "scripture string, complete boolean, path string, position bigint, chunk_id string, year int, month string, "
            "conv_id string, text string, embedding array<float>"
        )

    def reader(self, schema) -> EnvelopeReader:
        return EnvelopeReader(json.loads(self.options["paths"]))


def envelope_files(folder: str) -> list[str]:
    """``*_embeddings.json`` files right in a folder, in the order of their names."""
    store, at = open_fs(folder)
    found = store.get_file_info(fs.FileSelector(at))
    scheme = folder[: len(folder) - len(at.rstrip("/"))] if folder.rstrip("/").endswith(at.rstrip("/")) and "://" in folder else ""
    return sorted(scheme + x.path for x in found if x.is_file and x.path.endswith("_embeddings.json"))
