"""Tokenizer artifacts and token arrays: vocabularies, merges, metadata, npy, manifests."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import bytes_literal, from_printable, parse_bytes_literal
from ..operators.bpe import UINT16_MAX, BpeModel
from .readers import open_store

FORMAT = "corpusloom-vocabulary-1"


def utc_now() -> str:
    """The time in UTC as ISO 8601, ``Z`` at the end."""
    return datetime.datetime.now(datetime.timezone.utc).isoformat().replace("+00:00", "Z")


def default_output_dir(path: str, vocab_size: int) -> Path:
    """``<stem>_bpe_<vocab_size>`` beside the input."""
    p = Path(path)
    return p.with_name(f"{p.stem}_bpe_{vocab_size}")


def replace_file(path: str | Path, data: bytes, force: bool = False) -> None:
    """Write beside the target, then rename; refuses to overwrite without ``force``."""
    path = Path(path)
    if path.exists() and not force:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.part")
    part.write_bytes(data)
    os.replace(part, path)


# --- vocabularies and merges ---


def vocab_entry(token_id: int, raw: bytes) -> dict:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = None
    return {"id": token_id, "byte_values": list(raw), "hex": raw.hex(), "repr": bytes_literal(raw), "utf8": text}


def vocab_json(model: BpeModel) -> str:
    return json.dumps({"format": FORMAT, "tokens": [vocab_entry(k, v) for k, v in sorted(model.vocab.items())]}, indent=2, ensure_ascii=False)


def merge_lines(model: BpeModel) -> list[str]:
    return ["\t".join([str(k), *map(bytes_literal, (a, b, a + b))]) for k, (a, b) in enumerate(model.merges)]


def save(model: BpeModel, folder: str | Path, metadata: dict | None = None, force: bool = False) -> None:
    folder = Path(folder)
    replace_file(folder / "vocab.json", vocab_json(model).encode(), force)
    text = "\n".join(["# byte-pair merges in order", "# rank, left, right, merged", *merge_lines(model)]) + "\n"
    replace_file(folder / "merges.txt", text.encode(), force)
    facts = {"vocab_size": len(model.vocab), "merges": len(model.merges), "special_tokens": model.specials} | (metadata or {})
    replace_file(folder / "metadata.json", json.dumps(facts, indent=2).encode(), force)


def parse_vocab(text: str) -> dict[int, bytes]:
    """Three layouts: a list of tokens, printable token to id, id to byte values."""
    data = json.loads(text)
    if isinstance(data, dict) and isinstance(data.get("tokens"), list):
        return {int(t["id"]): bytes(t["byte_values"]) for t in data["tokens"]}
    if isinstance(data, dict) and data and all(isinstance(v, int) for v in data.values()):
        return {v: from_printable(k) for k, v in data.items()}
    if isinstance(data, dict) and data and all(isinstance(v, list) for v in data.values()):
        return {int(k): bytes(v) for k, v in data.items()}
    raise ValueError("unknown vocabulary layout")


def load_vocab(path: str | Path) -> dict[int, bytes]:
    if str(path).endswith((".pkl", ".pickle")):
        raise ValueError("pickled vocabularies are refused: loading one runs its code")
    return parse_vocab(Path(path).read_text(encoding="utf-8"))


def parse_merges(lines: Iterable[str]) -> list[tuple[bytes, bytes]]:
    """Rank and bytes literals between tabs, or two printable tokens; blank, comment and other lines are skipped."""
    out = []
    for line in lines:
        line = line.rstrip("\r\n")
        if not line.strip() or line.startswith("#"):
            continue
        if len(fields := line.split("\t")) >= 3:
            out.append((parse_bytes_literal(fields[1]), parse_bytes_literal(fields[2])))
        elif len(fields := line.split(" ")) == 2:
            out.append((from_printable(fields[0]), from_printable(fields[1])))
    return out


def load(vocab: str | Path, merges: str | Path, specials: Sequence[str] = ()) -> BpeModel:
    with open(merges, encoding="utf-8") as f:
        return BpeModel(load_vocab(vocab), parse_merges(f), list(specials))


def save_parquet(model: BpeModel, spark: SparkSession, path: str) -> None:
    model.vocab_frame(spark).coalesce(1).write.parquet(f"{path}/vocab")
    model.merges_frame(spark).coalesce(1).write.parquet(f"{path}/merges")
    spark.createDataFrame([(k, s) for k, s in enumerate(model.specials)], "k int, special string").coalesce(1).write.parquet(f"{path}/specials")


def load_parquet(spark: SparkSession, path: str) -> BpeModel:
    vocab = {r.token_id: bytes(r.bytes) for r in spark.read.parquet(f"{path}/vocab").collect()}
    merges = [(bytes(r.left), bytes(r.right)) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    return BpeModel(vocab, merges, [r.special for r in spark.read.parquet(f"{path}/specials").orderBy("k").collect()])


# --- texts ---


def read_documents(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Text files as documents: whole files, or one row per piece between delimiters; newlines stay."""
    if delimiter is None:
        return spark.read.text(path, wholetext=True).toDF("text")
    return spark.read.text(path, lineSep=delimiter).toDF("text")


# --- token arrays ---


def npy_header(n: int) -> bytes:
    """Version 1.0 header of a one-dimensional little-endian uint16 array, padded to 16 bytes."""
    text = f"{{'descr': '<u2', 'fortran_order': False, 'shape': ({n},), }}"
    text += " " * (-(10 + len(text) + 1) % 16) + "\n"
    return b"\x93NUMPY\x01\x00" + len(text).to_bytes(2, "little") + text.encode()


def checked_uint16(ids: DataFrame, column: str = "ids") -> DataFrame:
    """Raise where an id does not fit an unsigned 16-bit integer."""
    bad = F.exists(column, lambda i: (i < 0) | (i > UINT16_MAX))
    return ids.withColumn(column, F.when(bad, F.raise_error(F.lit("token id beyond uint16"))).otherwise(F.col(column)))


def part_files(encoded: DataFrame, folder: str, order: str | None = "doc_id", ids: str = "ids") -> DataFrame:
    """Write each partition's ids as one npy file below ``folder``; (part, file, n, low, high, sha256) of the files.

    With ``order`` the rows are sorted across partitions, so that the files in the
    order of ``part`` are the whole stream.  A file is moved into place when it is
    complete, and a repeated task writes it again under the same name.
    """
    rows = encoded.repartitionByRange(order).sortWithinPartitions(order) if order else encoded

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, draft = f"part-{part:05d}.npy", f"{root}/.part-{part:05d}.{uuid.uuid4().hex}"
        n, low, high, digest = 0, None, None, hashlib.sha256()
        with store.open_output_stream(draft + ".raw", compression=None) as f:
            for batch in batches:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                if not len(values):
                    continue
                if values.min() < 0 or values.max() > UINT16_MAX:
                    raise ValueError("token id beyond uint16")
                low, high = min(int(values.min()), UINT16_MAX if low is None else low), max(int(values.max()), high or 0)
                raw = values.astype("<u2").tobytes()
                f.write(raw)
                digest.update(raw)
                n += len(values)
        with store.open_output_stream(draft, compression=None) as out, store.open_input_stream(draft + ".raw", compression=None) as f:
            out.write(npy_header(n))
            while block := f.read(1 << 20):
                out.write(block)
        store.delete_file(draft + ".raw")
        store.move(draft, f"{root}/{name}")
        columns = [[part], [name], [n], [low], [high], [digest.hexdigest()]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "file", "n", "low", "high", "sha256"])

    return rows.select(ids).mapInArrow(write, "part int, file string, n long, low int, high int, sha256 string")


def clean_stale(path: Path) -> None:
    """Drop what an export that broke off has left beside its target."""
    shutil.rmtree(path.with_name(f".{path.name}.parts"), ignore_errors=True)
    for stale in (path.with_name(f".{path.name}.part"), path.with_suffix(".json").with_name(f".{path.stem}.json.part")):
        stale.unlink(missing_ok=True)


def export_npy(encoded: DataFrame, path: str | Path, order: str = "doc_id", ids: str = "ids", split: str = "corpus", n_bytes: int | None = None, force: bool = False, extra: dict | None = None) -> dict:
    """Write the token stream, ordered, as one npy file with a sidecar; skips when both exist and not forced.

    Tasks write the parts; the driver only strings their bytes together, a block
    at a time.  (``part_files`` alone leaves the parts, for streams of any size.)
    """
    path = Path(path).absolute()
    side = path.with_suffix(".json")
    if path.exists() and side.exists() and not force:
        return json.loads(side.read_text())
    clean_stale(path)
    if force:
        path.unlink(missing_ok=True)
        side.unlink(missing_ok=True)
    began = time.perf_counter()
    path.parent.mkdir(parents=True, exist_ok=True)
    parts = path.with_name(f".{path.name}.parts")
    made = sorted(part_files(encoded, str(parts), order, ids).collect())  # a row for each partition
    count, digest, draft = sum(r.n for r in made), hashlib.sha256(), path.with_name(f".{path.name}.part")
    with draft.open("wb") as out:
        out.write(npy_header(count))
        for r in made:
            with (parts / r.file).open("rb") as f:
                f.seek(len(npy_header(r.n)))
                while block := f.read(1 << 20):
                    out.write(block)
                    digest.update(block)
    os.replace(draft, path)
    shutil.rmtree(parts)
    took = time.perf_counter() - began
    facts = {
        "split_name": split, "created_utc": utc_now(), "token_count": count, "min_id": min((r.low for r in made if r.n), default=0), "max_id": max((r.high for r in made if r.n), default=0),
        "payload_sha256": digest.hexdigest(), "dtype": "<u2", "shape": [count], "output_path": str(path), "input_bytes": n_bytes,
        "bytes_per_token": n_bytes / count if n_bytes and count else None, "elapsed_seconds": took, "tokens_per_second": count / took, "input_bytes_per_second": n_bytes / took if n_bytes else None,
    } | (extra or {})
    replace_file(side, json.dumps(facts, indent=2).encode(), True)
    return facts


def export_ids_json(encoded: DataFrame, path: str | Path, order: str = "doc_id", ids: str = "ids", force: bool = False) -> int:
    """Write the token stream, ordered, as one JSON array; partitions come one at a time.  The number of ids."""
    path, n = Path(path), 0
    if path.exists() and not force:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.part")
    with part.open("w") as f:
        f.write("[")
        for row in encoded.orderBy(order).select(ids).toLocalIterator():
            if row[0]:
                f.write(("," if n else "") + ",".join(map(str, row[0])))
                n += len(row[0])
        f.write("]\n")
    os.replace(part, path)
    return n


#: Ids of a file that one row of the reading plan stands for.
RANGE = 1 << 22


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, token_id) of an npy file of uint16, or of all below a folder; tasks read ranges of the files."""
    store, root = open_store(path)
    info = store.get_file_info(root)
    files = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".npy")]
    plan = [(x.path, start) for x in files for start in range(0, max(1, x.size // 2), RANGE)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(path)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(name) as f:
                    n, head = npy_shape(f.read(128))
                    f.seek(head + 2 * start)
                    ids = np.frombuffer(f.read(2 * max(0, min(RANGE, n - start))), "<u2").astype(np.int32)
                for lo in range(0, len(ids), 1 << 18):
                    part = ids[lo : lo + (1 << 18)]
                    at = np.arange(start + lo, start + lo + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(at), pa.array(part)], ["path", "pos", "token_id"])

    rows = spark.createDataFrame(plan, "path string, start long").repartition(max(1, len(plan)))
    return rows.mapInArrow(read, "path string, pos bigint, token_id int")


def npy_shape(head: bytes) -> tuple[int, int]:
    """The number of ids and the header's size of an npy file of little-endian uint16."""
    found = re.match(rb"\x93NUMPY\x01\x00(..)\{'descr': '<u2', 'fortran_order': False, 'shape': \((\d+),\), \}", head, re.DOTALL)
    if not found:
        raise ValueError("not a one-dimensional npy array of little-endian uint16")
    return int(found[2]), 10 + int.from_bytes(found[1], "little")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All sidecars below a folder, by split name."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.filter("split_name is not null").orderBy("split_name")
