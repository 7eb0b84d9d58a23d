import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import commands
from corpusloom.functions.bytes import bytes_literal, parse_bytes_literal
from corpusloom.operators import training
from corpusloom.sources import artifacts, readers

TEXT = "we're  here — 中文 naïve 😀\r\nrow two\rthree <|end|>" * 30 + " it'll\n\n be 12 <|end|><|end|> low lower lowest"
SPECIALS = ("<|end|>",)


@pytest.fixture
def corpus(tmp_path):
    path = tmp_path / "corpus.txt"
    path.write_bytes(TEXT.encode())
    return path


@pytest.mark.parametrize("n", [1, 2, 5, 40, 5000])
def test_boundaries_begin_with_the_delimiter(corpus, monkeypatch, n):
    monkeypatch.setattr(readers, "LOOK", 5)  # shorter than the delimiter: it lies across blocks
    raw = TEXT.encode()
    cuts = readers.boundaries(str(corpus), n, b"<|end|>")
    assert cuts[0] == 0 and cuts[-1] == len(raw) and cuts == sorted(set(cuts)) and len(cuts) <= n + 1
    assert all(raw[k : k + 7] == b"<|end|>" for k in cuts[1:-1])
    want = {0, len(raw)} | {at if (at := raw.find(b"<|end|>", k * (len(raw) // n))) >= 0 else len(raw) for k in range(1, n)}
    assert set(cuts) == want


def test_ranges(spark, corpus, tmp_path):
    (tmp_path / "none.txt").touch()
    assert readers.ranges(str(tmp_path / "none.txt"), 4, 10, SPECIALS) == [(0, 0)]
    assert readers.ranges(str(corpus), 4, 10) == [(0, len(TEXT.encode()))]
    assert len(readers.ranges(str(corpus), 4, 1 << 20, SPECIALS)) == 4 and len(readers.ranges(str(corpus), 1, 200, SPECIALS)) > 4
    rows = readers.read_ranges(spark, str(corpus), 3, 300, SPECIALS).orderBy("start").collect()
    assert "".join(r.text for r in rows) == TEXT and rows[0].end == rows[1].start
    for bad in ({"workers": 0}, {"chunk_bytes": 0}):
        with pytest.raises(ValueError):
            readers.ranges(str(corpus), **{"workers": 1, "chunk_bytes": 1, **bad})
    (tmp_path / "bad.txt").write_bytes(b"ab\xff")
    with pytest.raises(Exception, match="invalid start byte"):
        readers.read_ranges(spark, str(tmp_path / "bad.txt")).collect()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 4096])
def test_chunk_readers(corpus, tmp_path, size):
    chunks = list(readers.character_chunks(corpus, size))
    assert "".join(chunks) == TEXT and all(len(x) == size for x in chunks[:-1])
    assert "".join(readers.utf8_chunks(corpus, size)) == TEXT
    for raw in (b"ab\xff", "é".encode()[:1]):
        (tmp_path / "bad.txt").write_bytes(raw)
        with pytest.raises(UnicodeDecodeError):
            list(readers.utf8_chunks(tmp_path / "bad.txt", size))


def test_train_and_encode_commands(spark, corpus, tmp_path, capsys):
    def run(*arguments):
        assert commands.main([str(x) for x in arguments], lambda: spark) == 0
        return capsys.readouterr().out.strip()

    folder = run("train", "--input", corpus, "--vocab-size", 300, "--special-token", "<|end|>", "--workers", 3, "--chunk-bytes", 400)
    assert folder == str(tmp_path / "corpus_bpe_300")
    facts = json.loads((tmp_path / "corpus_bpe_300/metadata.json").read_text())
    assert facts["requested_vocab_size"] == facts["vocab_size"] == 300 and facts["input_bytes"] == len(TEXT.encode())
    assert facts["slowest_phase"] in facts["phase_seconds"] and facts["phase_durations"]["total"].endswith("sec") and facts["unique_pretokens"] > 10
    assert facts["initial_pairs"] > 10 and facts["final_pairs"] > 0
    with pytest.raises(FileExistsError):
        run("train", "--input", corpus, "--vocab-size", 300, "--special-token", "<|end|>")
    model = artifacts.load(f"{folder}/vocab.json", f"{folder}/merges.txt", SPECIALS)
    common = ("--vocab", f"{folder}/vocab.json", "--merges", f"{folder}/merges.txt", "--special-token", "<|end|>", "--input", corpus)
    out = tmp_path / "out"
    facts = json.loads(run("encode", *common, "--npy", out / "a.npy", "--ids-json", out / "ids/a.json", "--manifest", out / "manifest.json", "--chunk-bytes", 300))
    want = model.encoder().text(TEXT)
    assert np.load(out / "a.npy").tolist() == want == json.loads((out / "ids/a.json").read_text())
    side = json.loads((out / "a.json").read_text())
    assert side["token_count"] == len(want) and side["tokens_per_second"] > 0 and side["input_bytes_per_second"] > 0 and side["created_utc"].endswith("Z")
    assert [x["split_name"] for x in json.loads((out / "manifest.json").read_text())["splits"]] == ["encode"]
    assert not list(out.glob(".*"))
    (out / "a.json").unlink()
    with pytest.raises(FileExistsError):
        run("encode", *common, "--npy", out / "a.npy")
    run("encode", *common, "--npy", out / "a.npy", "--force")
    for wrong in (["encode", *common], ["train", "--input", corpus, "--vocab-size", "300", "--workers", "0"], ["encode", *common, "--npy", "x", "--chunk-bytes", "0"]):
        with pytest.raises(SystemExit):
            commands.main([str(x) for x in wrong], lambda: spark)
    with pytest.raises(ValueError):
        commands.encode_file(spark, f"{folder}/vocab.json", f"{folder}/merges.txt", str(corpus))
    with pytest.raises(FileNotFoundError):
        commands.train_file(spark, str(tmp_path / "absent.txt"), 300)
    for size, specials in (("300", ()), (0, ()), (300, ("",)), (300, "<s>")):
        with pytest.raises((TypeError, ValueError)):
            commands.train_file(spark, str(corpus), size, specials)


def test_splits(spark, corpus, tmp_path, capsys):
    other = tmp_path / "other.txt"
    other.write_text("a b c <|end|>")
    (tmp_path / "empty.txt").touch()
    _, folder = commands.train_file(spark, str(corpus), 290, SPECIALS, tmp_path / "m")
    base = {"vocab": str(folder / "vocab.json"), "merges": str(folder / "merges.txt"), "special_tokens": list(SPECIALS)}
    config = {
        "x_train": base | {"input": str(corpus), "corpus": "x", "split": "train"},
        "x_valid": base | {"input": str(other), "corpus": "x", "split": "valid"},
        "y_none": base | {"input": str(tmp_path / "empty.txt"), "corpus": "y", "split": "none"},
    }
    (tmp_path / "config.json").write_text(json.dumps(config))
    out = tmp_path / "tokens"
    (out / "x").mkdir(parents=True)
    stale = out / "x/.train.npy.part"
    stale.write_bytes(b"stale")
    commands.main(["splits", "--config", str(tmp_path / "config.json"), "--output", str(out)], lambda: spark)
    found = json.loads((out / "manifest.json").read_text())["splits"]
    assert [x["split_name"] for x in found] == ["x_train", "x_valid", "y_none"] and not stale.exists()
    assert found[2]["token_count"] == 0 and found[2]["bytes_per_token"] is None and np.load(out / "y/none.npy").shape == (0,)
    assert sum(x["token_count"] for x in found) == sum(len(np.load(x["output_path"])) for x in found)
    before = (out / "x/train.npy").stat().st_mtime_ns
    commands.tokenize_splits(spark, config, out, ["x_train"])
    assert (out / "x/train.npy").stat().st_mtime_ns == before and "done already" in capsys.readouterr().err
    commands.tokenize_splits(spark, config, out, ["x_train"], force=True)
    assert (out / "x/train.npy").stat().st_mtime_ns > before
    with pytest.raises(ValueError, match="unknown splits: z; known: x_train, x_valid, y_none"):
        commands.tokenize_splits(spark, config, out, ["x_train", "z"])
    assert artifacts.manifest(spark, str(out)).count() == 3
    rows = artifacts.read_npy(spark, str(out / "x")).groupBy("path").count().collect()
    assert sorted(r["count"] for r in rows) == sorted(x["token_count"] for x in found[:2])


def test_small_helpers(monkeypatch):
    monkeypatch.setenv("N", "3")
    assert commands.env_int("N") == 3 and commands.env_int("ABSENT", 2) == 2
    monkeypatch.setenv("N", "0")
    with pytest.raises(ValueError):
        commands.env_int("N")
    with pytest.raises(KeyError):
        commands.env_int("ABSENT")
    for text, want in (("1", True), ("TRUE", True), ("yes", True), ("0", False), ("", False)):
        monkeypatch.setenv("F", text)
        assert commands.env_flag("F") is want
    assert commands.duration(125.5) == "2 min 5.50 sec" and commands.extrapolated(825e9, 93_516, 93_516 / 2.5e6) == pytest.approx(330_000)
    assert commands.slowest({"a": 1.0, "b": 2.0, "total": 3.0}) == "b"
    assert artifacts.utc_now()[10] == "T"


def test_bytes_literals():
    for raw in (bytes(range(256)), b"", b"'", b'"', b"'\"", b"\\x41"):
        assert parse_bytes_literal(bytes_literal(raw)) == raw
    assert parse_bytes_literal(r" b'\q\a\b\f\v\x0A' ") == b"q\x07\x08\x0c\x0b\x0a"
    for bad in ("'a'", "b'a", "b'\\'", "b'\\x4'", "b'é'", "b", "b'a' + b'c'"):
        with pytest.raises(ValueError):
            parse_bytes_literal(bad)


def test_random_batches_are_uniform(spark):
    n, length, size = 100, 7, 20_000
    stream = training.blocked(spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * 3).cast("int").alias("token_id")), 16)
    rows = training.random_batch(stream, n, size, length, 5, block=16).collect()
    starts = [r.x[0] // 3 for r in rows]
    assert len(rows) == size and sorted(r.sample for r in rows) == list(range(size))
    assert all(r.x == [3 * (s + k) for k in range(length)] and r.y == [v + 3 for v in r.x] for r, s in zip(rows, starts))
    assert min(starts) == 0 and max(starts) == n - length - 1
    expected = size / (n - length)
    spread = 5 * math.sqrt(expected)
    counts = np.bincount(starts, minlength=n - length)
    assert (abs(counts - expected) < spread).all()
    again = training.random_batch(stream, n, size, length, 5, block=16).collect()
    assert sorted(again) == sorted(rows)
    for bad in ({"n": 7}, {"device": "cuda:99"}, {"size": 0}):
        with pytest.raises((ValueError, RuntimeError)):
            training.random_batch(stream, **{"n": n, "size": 4, "length": length, "seed": 1, **bad})
