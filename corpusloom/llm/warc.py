"""WARC records in Zstandard archives: writer, reader, and the pages round trip.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
Zstandard dictionary of all its frames; then each record is one frame.  The
reader loads that dictionary, decodes frame after frame and checks each
record: version line, mandatory headers, Content-Length against the block, and
the payload digest.

Archives are rows (name, content) of a table in the shared checkpoint folder,
whose commit protocol outlives lost executors and repeated tasks; ``export``
puts them into files that other tools read, ``read_files`` reads such files.

Defined cases: a null html is an empty payload; rows that repeat are records
each, and all that tie with the group's largest page_id are responses; a null
page_id is written without the id header, is the smallest, and comes back null;
an archive without records gives no rows; a very long payload is one record, in
an archive that may exceed ARCHIVE_BYTES by it; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, skew_safe_lookup

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: An archive is closed after this many bytes of payload.
ARCHIVE_BYTES = 8 << 20
#: Bytes of dictionary, and of the records it is trained on.
DICTIONARY_BYTES, TRAINING_BYTES = 16 << 10, 512 << 10
LEVEL = 3
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Header names that are asked for; they are found in any case.
KNOWN = {
    name.lower(): name
    for name in (*MANDATORY, "Content-Type", "WARC-Payload-Digest", "WARC-Target-URI", "WARC-Profile", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "X-Payload-Length", "X-Page-Id", "X-Refers-To-Page-Id")
}


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""
    trailing: dict[str, str] = field(default_factory=dict)

    def to_bytes(self) -> bytes:
        head = {**self.headers, "Content-Length": str(len(self.block))}
        lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
        return f"WARC/1.1\r\n{lines}\r\n".encode() + self.block + b"\r\n\r\n"

    @classmethod
    def from_bytes(cls, data: bytes) -> Record:
        head, gap, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not gap or version not in ("WARC/1.0", "WARC/1.1"):
            raise WarcError(f"not a WARC record: {version[:40]!r}")
        headers, last = {}, None
        for line in lines:
            if line[:1] in (" ", "\t") and last is not None:  # goes on with the line before
                headers[last] = f"{headers[last]} {line.strip()}".strip()
                continue
            name, colon, value = line.partition(":")
            if not colon:
                raise WarcError(f"bad header line {line[:40]!r}")
            last = KNOWN.get(name.strip().lower(), name.strip())
            headers[last] = value.strip()
        if missing := [h for h in MANDATORY if h not in headers]:
            raise WarcError(f"headers missing: {missing}")
        if not headers["Content-Length"].isdigit():
            raise WarcError("Content-Length is no number")
        n = int(headers["Content-Length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {n}")
        record = cls(headers, rest[:n])
        if headers["WARC-Type"] == "response" and "WARC-Payload-Digest" in headers and headers["WARC-Payload-Digest"] != "sha1:" + payload_digest(record.block):
            raise WarcError("payload digest differs")
        return record


def write_archive(records: list[bytes]) -> bytes:
    """An archive: the dictionary's skippable frame, then a frame for each record."""
    sample, room = [], TRAINING_BYTES
    for r in records:
        if room <= 0:
            break
        sample.append(r[: min(room, 64 << 10)])
        room -= len(sample[-1])
    try:
        dictionary = zstd.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstd.ZstdError:  # too few records to train on: their own beginnings serve as content
        dictionary = b"".join(sample)[:DICTIONARY_BYTES]
    kind = zstd.DICT_TYPE_AUTO
    packer = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(dictionary, dict_type=kind), write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary, *(packer.compress(r) for r in records)])


def frame_end(content: bytes, start: int) -> int:
    """Where the Zstandard frame that begins at ``start`` ends: its header, its blocks, its checksum."""
    try:
        at = start + zstd.frame_header_size(content[start : start + 18])
    except zstd.ZstdError as e:
        raise WarcError(f"bad frame: {e}") from e
    last = False
    while not last:
        if at + 3 > len(content):
            raise WarcError("the last frame is cut short")
        head = int.from_bytes(content[at : at + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("bad frame: reserved block type")
        at += 3 + (1 if kind == 1 else size)  # a block of one repeated byte stores it once
    at += 4 if content[start + 4] & 4 else 0
    if at > len(content):
        raise WarcError("the last frame is cut short")
    return at


def read_archive(content: bytes) -> Iterator[Record]:
    """The records of an archive, validated; each frame is sliced out once."""
    if len(content) < 8:
        raise WarcError("archive too short")
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC or 8 + size > len(content):
        raise WarcError("no dictionary frame leads the archive")
    dictionary = content[8 : 8 + size]
    if dictionary[:4] == ZSTD_MAGIC:  # the dictionary may itself be compressed
        dictionary = zstd.ZstdDecompressor().decompressobj().decompress(dictionary)
    opener = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)
    at = 8 + size
    while at < len(content):
        if content[at : at + 4] != ZSTD_MAGIC:
            raise WarcError("a frame does not begin with the Zstandard magic")
        end = frame_end(content, at)
        try:
            data = opener.decompressobj().decompress(content[at:end])
        except zstd.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from e
        at = end
        yield Record.from_bytes(data)


def record_id(*facts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, facts)))}>"


def _line(text: str) -> str:
    return "".join(c for c in text if c not in "\r\n")


def page_record(page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, refers: tuple[int | None, str | None] | None = None, nth: object = "", of_nth: object = "") -> bytes:
    """A response, or with ``refers`` (page_id and url of the response) a revisit.

    ``nth`` tells records of equal rows apart; ``of_nth`` is None if the response is one of several such.
    """
    headers = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": record_id(page_id, url, digest, nth),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "Content-Type": "text/html",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(n),
    }
    if url is not None:
        headers["WARC-Target-URI"] = _line(url)
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    if refers is not None:
        headers["WARC-Profile"] = SAME_PAYLOAD
        if of_nth is not None:
            headers["WARC-Refers-To"] = record_id(*refers, digest, of_nth)
        if refers[1] is not None:
            headers["WARC-Refers-To-Target-URI"] = _line(refers[1])
        if refers[0] is not None:
            headers["X-Refers-To-Page-Id"] = str(refers[0])
    return Record(headers, payload if refers is None else b"").to_bytes()


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), n_bytes, sha1, refers_to, its url, revisit and most; payloads are moved at most once.

    ``most``: how often the most frequent row of the payload's group repeats.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "_key": F.sha2("payload", 256)})
    groups = (
        rows.filter(F.col("n_bytes") >= min_bytes)
        .groupBy("_key", "page_id", "url")
        .agg(F.count("*").alias("same"))
        .groupBy("_key")
        .agg(F.max(F.struct("page_id", "url")).alias("best"), F.sum("same").alias("n_rows"), F.max("same").alias("most"))
        .filter("n_rows > 1")
        .select("_key", F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("refers_url"), "n_rows", "most")
    )
    found = skew_safe_lookup(rows, groups, "_key", "n_rows")
    revisit = F.col("n_rows").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return found.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n_bytes", "sha1", F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("refers_url")).alias("refers_url"), revisit.alias("revisit"), F.coalesce("most", F.lit(1)).alias("most"),
    )


def archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(name, n_records, content): the pages' records in archives of bounded size."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, written, part = 0, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            content = write_archive(held)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())], ["name", "n_records", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, n, sha1, refers_to, refers_url, revisit, most = (batch.column(c)[k].as_py() for c in range(9))
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                written += 1
                nth = "" if most == 1 else f"{part}.{written}"
                held.append(page_record(page_id, url, payload or b"", n, digest, (refers_to, refers_url) if revisit else None, nth, "" if most == 1 else None))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return cut(with_revisits(pages, min_bytes).mapInArrow(write, "name string, n_records bigint, content binary"))


RECORD_SCHEMA = "archive string, nth int, page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def read_records(table: DataFrame, name: str = "name", payloads: bool = True) -> DataFrame:
    """The records of archives given as rows (name, content)."""

    def number(headers: dict[str, str], key: str) -> int | None:
        return int(headers[key]) if key in headers else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for nth, r in enumerate(read_archive(content.as_py())):
                    h, response = r.headers, r.headers["WARC-Type"] == "response"
                    length = number(h, "X-Payload-Length")
                    if response and length is not None and length != len(r.block):
                        raise WarcError("payload length differs")
                    digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or payload_digest(r.block)
                    rows.append((archive, nth, number(h, "X-Page-Id"), h.get("WARC-Target-URI"), h["WARC-Type"], r.block if payloads and response else None, len(r.block) if length is None else length, digest, number(h, "X-Refers-To-Page-Id")))
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return table.select(F.col(name).alias("name"), "content").mapInArrow(read, RECORD_SCHEMA)


def export(table: DataFrame, uri: str) -> DataFrame:
    """Write archives as files below a URI that pyarrow opens (file:, s3:, hdfs:, gs:); names and sizes.

    Names derive from contents, and a file is moved into place when complete,
    so a repeated task writes the same file again.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as f:
                    f.write(content.as_py())
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c.as_py()) for c in batch.column(1)], pa.int64())], ["name", "n_bytes"])

    return table.select("name", "content").mapInArrow(put, "name string, n_bytes bigint")


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of .warc.zst files below a path; Spark's reader takes files of up to 2 GB, ``export`` writes far smaller ones."""
    return read_records(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path), "path", payloads)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives."""
    return read_records(archives(pages, min_bytes), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base32 by groups of five hexadecimal digits, which are four characters.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, sha256(h) AS k FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS best,
  list_transform(range(8), lambda i: list_reduce(list_transform(string_split(x[5 * i + 1:5 * i + 5], ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, c: 16 * a + c)) AS v FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM g
"""
