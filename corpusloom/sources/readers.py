"""Readers of text files: byte ranges that end at delimiters, character chunks, UTF-8-safe byte chunks."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 64 << 20
CHUNK_CHARS = 1 << 20
#: Bytes looked at together for the next delimiter.
LOOK = 4096


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3:, gs:) or local path, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), str(Path(path).absolute()))


def next_delimiter(stream, start: int, size: int, delimiter: bytes) -> int:
    """Where the first delimiter at or after ``start`` begins; the file's size if there is none."""
    at, held = start, b""
    while at < size:
        stream.seek(at)
        block = stream.read(min(LOOK, size - at))
        if not block:
            break
        found = (held + block).find(delimiter)
        if found >= 0:
            return at - len(held) + found
        at += len(block)
        held = (held + block)[-(len(delimiter) - 1) :] if len(delimiter) > 1 else b""
    return size


def boundaries(path: str, n: int, delimiter: bytes) -> list[int]:
    """Offsets that part a file into at most ``n`` ranges, each but the first beginning with a delimiter; sorted, once each."""
    if n < 1:
        raise ValueError("fewer than one range")
    if not delimiter:
        raise ValueError("an empty delimiter")
    store, at = open_store(path)
    size = store.get_file_info(at).size
    with store.open_input_file(at) as stream:
        places = [next_delimiter(stream, k * (size // n), size, delimiter) for k in range(1, n)]
    return sorted({0, *places, size})


def ranges(path: str, workers: int = 1, chunk_bytes: int = CHUNK_BYTES, specials: tuple[str, ...] = ()) -> list[tuple[int, int]]:
    """(start, end) of a file's chunks: max(workers, size / chunk_bytes) of them, parted at the first special token.

    An empty file is one empty range, and without special tokens a file is one range.
    """
    if workers < 1 or chunk_bytes < 1:
        raise ValueError("workers and chunk_bytes are at least 1")
    store, at = open_store(path)
    size = store.get_file_info(at).size
    if not size:
        return [(0, 0)]
    if not specials:
        return [(0, size)]
    cuts = boundaries(path, max(workers, -(-size // chunk_bytes)), specials[0].encode())
    return list(zip(cuts, cuts[1:], strict=False))


def read_ranges(spark: SparkSession, path: str, workers: int | None = None, chunk_bytes: int = CHUNK_BYTES, specials: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, text) of a file's chunks, read by tasks; bytes that are no UTF-8 are an error.

    Newlines stay as they are.  With special tokens no range exceeds what lies
    between two of them by more than ``chunk_bytes``; without them the file is one
    range, as nothing says where it may be parted.
    """
    found = ranges(path, workers or spark.sparkContext.defaultParallelism, chunk_bytes, specials)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(path)
        with store.open_input_file(at) as stream:
            for batch in batches:
                for start, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    stream.seek(start)
                    text = stream.read(end - start).decode("utf-8")
                    yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([end]), pa.array([text])], ["start", "end", "text"])

    plan = spark.createDataFrame(found, "start long, end long").repartition(len(found), F.col("start"))
    return plan.mapInArrow(read, "start long, end long, text string")


def character_chunks(path: str | Path, size: int = CHUNK_CHARS) -> Iterator[str]:
    """A file's text in pieces of ``size`` characters; newlines are not translated."""
    if size < 1:
        raise ValueError("chunks of fewer than one character")
    with open(path, encoding="utf-8", newline="") as f:
        while chunk := f.read(size):
            yield chunk


def utf8_chunks(path: str | Path, size: int = CHUNK_CHARS) -> Iterator[str]:
    """A file's text in pieces of about ``size`` bytes: a sequence cut short waits for the next piece, a malformed one is an error."""
    if size < 1:
        raise ValueError("chunks of fewer than one byte")
    decoder = codecs.getincrementaldecoder("utf-8")()
    with open(path, "rb") as f:
        while block := f.read(size):
            if text := decoder.decode(block):
                yield text
        decoder.decode(b"", final=True)
