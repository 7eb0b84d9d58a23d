"""Training, encoding and tokenising splits from files, in Python and from a command line.

    python -m corpusloom.commands train --input corpus.txt --vocab-size 32000 --special-token '<|end|>'
    python -m corpusloom.commands encode --vocab m/vocab.json --merges m/merges.txt --input corpus.txt --npy corpus.npy
    python -m corpusloom.commands splits --config splits.json --output tokens --split train --split valid
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators.bpe import UINT16_MAX, BpeModel, check_arguments, train_bpe
from .sources import artifacts
from .sources.readers import CHUNK_BYTES, open_store, read_ranges


def duration(seconds: float) -> str:
    """``M min S.SS sec``."""
    minutes = int(seconds // 60)
    return f"{minutes} min {seconds - 60 * minutes:.2f} sec"


def env_int(name: str, default: int | None = None) -> int:
    """A whole number of at least 1 from the environment."""
    text = os.environ.get(name)
    if text is None and default is None:
        raise KeyError(name)
    value = default if text is None else int(text)
    if value < 1:
        raise ValueError(f"{name} is less than 1")
    return value


def env_flag(name: str) -> bool:
    return os.environ.get(name, "0").lower() in ("1", "true", "yes")


def file_size(path: str) -> int:
    store, at = open_store(path)
    info = store.get_file_info(at)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size


def say(text: str) -> None:
    print(text, file=sys.stderr, flush=True)


@contextmanager
def progress(spark: SparkSession, what: str, every: float) -> Iterator[None]:
    """Says every so many seconds how many tasks of the running stages are done."""
    stop = threading.Event()
    tracker, began = spark.sparkContext.statusTracker(), time.perf_counter()

    def watch() -> None:
        while not stop.wait(every):
            stages = [tracker.getStageInfo(k) for k in tracker.getActiveStageIds()]
            done = ", ".join(f"{s.numCompletedTasks} of {s.numTasks} tasks" for s in stages if s)
            say(f"{what}: {done or 'planning'} after {time.perf_counter() - began:.1f} sec")

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()


def train_file(
    spark: SparkSession, path: str, vocab_size: int, specials: Sequence[str] = (), output: str | Path | None = None, workers: int | None = None, chunk_bytes: int = CHUNK_BYTES, force: bool = False
) -> tuple[BpeModel, Path]:
    """Train on a text file and write vocabulary, merges and metadata; the model and their folder.

    The file is read in at least ``workers`` ranges that begin with the first special token.
    """
    check_arguments(vocab_size, specials)
    folder = Path(output) if output is not None else artifacts.default_output_dir(path, vocab_size)
    began, timings = time.perf_counter(), {}
    n_bytes = file_size(path)
    docs = read_ranges(spark, path, workers, chunk_bytes, tuple(specials))
    model = train_bpe(docs, vocab_size, specials, timings=timings)
    phases = {"pretoken_counting": timings.pop("count_seconds"), "merge_loop": timings.pop("merge_seconds"), "total": time.perf_counter() - began}
    facts = {
        "input_path": str(path), "input_bytes": n_bytes, "output_dir": str(folder), "requested_vocab_size": vocab_size, "workers": workers, "chunk_bytes": chunk_bytes, "created_utc": artifacts.utc_now(),
        **timings, "phase_seconds": phases, "phase_durations": {k: duration(v) for k, v in phases.items()}, "slowest_phase": slowest(phases),
    }
    artifacts.save(model, folder, facts, force)
    return model, folder


def slowest(phases: Mapping[str, float]) -> str:
    return max((k for k in phases if k != "total"), key=phases.__getitem__)


def extrapolated(n_bytes: float, sample_bytes: float, sample_seconds: float) -> float:
    """Seconds for a corpus at the throughput of a sample."""
    return n_bytes * sample_seconds / sample_bytes


def encoded_file(spark: SparkSession, model: BpeModel, path: str, workers: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(start, ids) of a file's ranges, which in the order of ``start`` are its ids."""
    docs = read_ranges(spark, path, workers, chunk_bytes, tuple(model.specials))
    return model.encode(docs).select("start", "ids")


def encode_file(
    spark: SparkSession, vocab: str, merges: str, path: str, specials: Sequence[str] = (), npy: str | None = None, ids_json: str | None = None, split: str = "encode",
    manifest: str | None = None, force: bool = False, workers: int | None = None, chunk_bytes: int = CHUNK_BYTES, every: float = 30, extra: dict | None = None,
) -> dict:
    """Encode a text file to an npy array with its sidecar, or to a JSON array, or both; the sidecar's facts."""
    if npy is None and ids_json is None:
        raise ValueError("neither an npy file nor a JSON file is asked for")
    if npy is not None and not force and Path(npy).exists() != Path(npy).with_suffix(".json").exists():
        raise FileExistsError(f"{npy} is there without its sidecar, or the other way round; force replaces both")
    n_bytes = file_size(path)
    model = artifacts.load(vocab, merges, specials)
    rows, facts = encoded_file(spark, model, path, workers, chunk_bytes), {"input_path": str(path), "input_bytes": n_bytes}
    with progress(spark, split, every):
        if npy is not None:
            if max(model.vocab, default=-1) > UINT16_MAX:
                raise ValueError(f"the vocabulary has ids beyond {UINT16_MAX}")
            more = {"input_path": str(path), "vocab_path": str(vocab), "merges_path": str(merges), "special_tokens": list(specials)} | (extra or {})
            facts = artifacts.export_npy(rows, npy, "start", split=split, n_bytes=n_bytes, force=force, extra=more)
        if ids_json is not None:
            facts = facts | {"token_count": artifacts.export_ids_json(rows, ids_json, "start", force=force)}
    if manifest is not None:
        write_manifest(Path(manifest).parent, Path(manifest))
    return facts


def write_manifest(folder: Path, target: Path) -> list[dict]:
    """All sidecars below a folder as one JSON list, by split name."""
    found = []
    for side in sorted(folder.rglob("*.json")):
        facts = json.loads(side.read_text()) if side != target and not side.name.startswith(".") else None
        if isinstance(facts, dict) and "split_name" in facts:
            found.append(facts)
    found.sort(key=lambda x: x["split_name"])
    artifacts.replace_file(target, (json.dumps({"splits": found}, indent=2) + "\n").encode(), True)
    return found


def select_splits(config: Mapping[str, dict], names: Sequence[str] | None) -> list[str]:
    chosen = list(names) if names else list(config)
    if unknown := [x for x in chosen if x not in config]:
        raise ValueError(f"unknown splits: {', '.join(unknown)}; known: {', '.join(sorted(config))}")
    return chosen


def tokenize_splits(spark: SparkSession, config: Mapping[str, dict], output: str | Path, names: Sequence[str] | None = None, force: bool = False, **options) -> list[dict]:
    """Encode splits to ``<output>/<corpus>/<split>.npy`` with sidecars, and write manifest.json.

    ``config``: split name to input, vocab, merges, special_tokens, corpus and split.  Splits that are done already are skipped.
    """
    output = Path(output)
    for name in select_splits(config, names):
        c = config[name]
        target = output / c.get("corpus", name) / f"{c.get('split', name)}.npy"
        if target.exists() and target.with_suffix(".json").exists() and not force:
            say(f"{name}: done already, {target}")
            continue
        say(f"{name}: {c['input']} to {target}")
        facts = encode_file(
            spark, c["vocab"], c["merges"], c["input"], c.get("special_tokens", ()), str(target), split=name, force=True, extra={"corpus": c.get("corpus"), "split": c.get("split")}, **options
        )
        say(f"{name}: {facts['token_count']} tokens in {facts['elapsed_seconds']:.1f} sec")
        write_manifest(output, output / "manifest.json")
    return write_manifest(output, output / "manifest.json")


def session() -> SparkSession:
    return SparkSession.builder.appName("corpusloom").getOrCreate()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom")
    kinds = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = kinds.add_parser(name, help=text)
        p.add_argument("--workers", type=int)
        p.add_argument("--chunk-bytes", type=int, default=CHUNK_BYTES)
        p.add_argument("--force", action="store_true")
        return p

    p = command("train", "train a tokenizer on a text file")
    p.add_argument("--input", required=True)
    p.add_argument("--vocab-size", type=int, required=True)
    p.add_argument("--special-token", action="append", default=[])
    p.add_argument("--output-dir")
    p = command("encode", "encode a text file")
    for x in ("--vocab", "--merges", "--input"):
        p.add_argument(x, required=True)
    p.add_argument("--special-token", action="append", default=[])
    for x in ("--npy", "--ids-json", "--manifest"):
        p.add_argument(x)
    p.add_argument("--split-name", default="encode")
    p.add_argument("--progress-seconds", type=float, default=30)
    p = command("splits", "encode the splits of a configuration file")
    p.add_argument("--config", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--split", action="append")
    return out


def main(arguments: Sequence[str] | None = None, spark: Callable[[], SparkSession] = session) -> int:
    a = parser().parse_args(arguments)
    for name in ("workers", "chunk_bytes"):
        if (value := getattr(a, name)) is not None and value < 1:
            parser().error(f"--{name.replace('_', '-')} is at least 1")
    common = {"workers": a.workers, "chunk_bytes": a.chunk_bytes}
    if a.command == "train":
        _, folder = train_file(spark(), a.input, a.vocab_size, a.special_token, a.output_dir, force=a.force, **common)
        print(folder)
    elif a.command == "encode":
        if a.npy is None and a.ids_json is None:
            parser().error("give --npy, --ids-json or both")
        facts = encode_file(spark(), a.vocab, a.merges, a.input, a.special_token, a.npy, a.ids_json, a.split_name, a.manifest, a.force, every=a.progress_seconds, **common)
        print(json.dumps(facts))
    else:
        tokenize_splits(spark(), json.loads(Path(a.config).read_text()), a.output, a.split, a.force, **common)
        print(Path(a.output) / "manifest.json")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
