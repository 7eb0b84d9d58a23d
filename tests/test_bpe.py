import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import BpeModel, train_bpe, train_bpe_distributed
from corpusloom.functions import text as T
from corpusloom.operators import bpe
from corpusloom.operators.bpe import independent, joined, merge_loop
from corpusloom.sources import artifacts
from corpusloom.streaming.encode import encode_stream, flush, prefix

TEXTS = ["low low low lower lowest newest newest widest", "we're  here,\n\n and it's 42!  ", "", None, "naïve café 中文 😀 \t x"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def naive_merges(words, n):
    """Recount everything in every round."""
    words = [([bytes([b]) for b in w], c) for w, c in words]
    out = []
    for _ in range(n):
        counts = {}
        for t, c in words:
            for p in zip(t, t[1:]):
                counts[p] = counts.get(p, 0) + c
        if not counts:
            break
        best = max(counts, key=lambda p: (counts[p], p))
        out.append((*best, counts[best]))
        for t, _ in words:
            i = 0
            while i < len(t) - 1:
                if (t[i], t[i + 1]) == best:
                    t[i : i + 2] = [t[i] + t[i + 1]]
                i += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 5)), max_size=12), st.integers(0, 20))
def test_merge_loop_equals_recounting(words, n):
    assert merge_loop(words, n, 256) == naive_merges(words, n)


def test_ties_go_to_the_greater_pair():
    assert merge_loop([(b"ab", 3), (b"cd", 3)], 1, 256)[0][:2] == (b"c", b"d")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=14), st.integers(1, 6)), max_size=10), st.integers(2, 9))
def test_rounds_of_independent_merges_equal_recounting(words, ranked):
    """The distributed rounds in plain Python: the pairs of a round are counted once, its merges made one after the other."""
    held, found = [([f"{ord(c):02x}" for c in w], n) for w, n in words], []
    while len(found) < 12:
        counts = {}
        for t, n in held:
            for p in zip(t, t[1:]):
                counts[p] = counts.get(p, 0) + n
        top = sorted(((n, *p) for p, n in counts.items()), reverse=True)[: ranked + 1]
        if not top:
            break
        for n, left, right in independent(top[:ranked], len(top) <= ranked):
            held = [(joined(t, left, right, left + right), c) for t, c in held]
            found.append((bytes.fromhex(left), bytes.fromhex(right), n))
    assert found[:12] == naive_merges([(w.encode(), n) for w, n in words], 12)


def test_distributed_training_equals_local(spark):
    docs = frame(spark, [*TEXTS, *["aaaa"] * 10, *["cd"] * 5, "aaaaaaaa abab"])
    local = train_bpe(docs, 272)
    for model in (train_bpe_distributed(docs, 272, ranked=20, cut_every=2), train_bpe(docs, 272, max_local_bytes=0)):
        assert (model.merges, model.counts) == (local.merges, local.counts)


def test_local_training_fits_the_driver(spark, monkeypatch):
    """The loop's arrays take at most a third of the heap of any driver; beyond that the rounds train, with the same result."""
    import tracemalloc

    import numpy as np

    words, size = np.random.default_rng(1), 1 << 20
    lengths = np.full(size // 8, 8)
    tracemalloc.start()
    bpe.Symbols(words.integers(97, 123, size, np.uint8), lengths, np.ones(len(lengths), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    assert bpe.local_bytes(spark) * peak / size <= heap / 3
    docs, seen = frame(spark, [*TEXTS, *["aaaa"] * 10]), []
    local = train_bpe(docs, 272)
    rounds = bpe.train_bpe_distributed
    monkeypatch.setattr(bpe, "train_bpe_distributed", lambda *a, **k: seen.append(1) or rounds(*a, **k))
    assert train_bpe(docs, 272).merges == local.merges and not seen
    monkeypatch.setattr(bpe, "LOCAL_COST", heap)
    far = train_bpe(docs, 272)
    assert (far.merges, far.counts, seen) == (local.merges, local.counts, [1])


@pytest.mark.parametrize("dense, held", [(512, 1 << 20), (0, 1 << 20), (0, 2)])
@settings(max_examples=60, deadline=None)
@given(words=st.lists(st.tuples(st.text("abc", max_size=12), st.integers(1, 1 << 40)), max_size=10), n=st.integers(1, 14))
def test_rounds_over_blocks_equal_recounting(dense, held, words, n):
    import pyarrow as pa

    def batch(part):
        return pa.RecordBatch.from_arrays([pa.array([w.encode() for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], ["w", "cnt"])

    names, found, merges = [f"{b:02x}" for b in range(256)], [], []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "DENSE", dense)
        m.setattr(bpe, "HELD_SUMS", held)
        blocks = list(bpe.word_blocks([batch(words[:4]), batch(words[4:])]))
        while len(found) < n:
            counts = {}
            for b in bpe.pair_sums(blocks, merges, names):
                for r in b.to_pylist():
                    counts[r["l"], r["r"]] = counts.get((r["l"], r["r"]), 0) + r["n"]
            if not counts:
                break
            left, right = max(counts, key=lambda p: (counts[p], p))
            found.append((bytes.fromhex(left), bytes.fromhex(right), counts[left, right]))
            if left + right not in names:
                names.append(left + right)
            merges.append((names.index(left), names.index(right), names.index(left + right)))
            if len(merges) == 3:
                blocks, merges = list(bpe.merged_blocks(blocks, merges)), []
    assert found == naive_merges([(w.encode(), c) for w, c in words], n)


def plain_encode(model, text):
    """Ids by trying the merges one after the other on every pretoken."""
    import regex

    out = []
    for p in regex.findall(T.PATTERN, text):
        parts = [bytes([b]) for b in p.encode()]
        for a, b in model.merges:
            parts = joined(parts, a, b, a + b)
        out += [model.ids[x] for x in parts]
    return out


MIXED = "we're  here — 中文 naïve 😀\r\nrow\x85two\u2003three it'll\n\n be 12²³ \x1c x  " + "aaaa" * 20 + " " * 50 + "low lower"


def test_published_example(spark):
    """The vocabulary of Sennrich et al. (2016), ties to the greater pair."""
    words = ["low"] * 5 + ["lower"] * 2 + ["widest"] * 3 + ["newest"] * 6
    merges = [("s", "t"), ("e", "st"), ("o", "w"), ("l", "ow"), ("w", "est"), ("n", "e"), ("ne", "west"), ("w", "i"), ("wi", "d"), ("wid", "est"), ("low", "e"), ("lowe", "r")]
    m = train_bpe(frame(spark, words), 256 + len(merges))
    assert [(a.decode(), b.decode()) for a, b in m.merges] == merges and m.counts == [9, 9, 7, 7, 6, 6, 6, 3, 3, 3, 2, 2]
    assert train_bpe(frame(spark, words), 1000).vocab == m.vocab  # no pair is left
    assert train_bpe(frame(spark, []), 300, ("<s>",)).vocab == {**{k: bytes([k]) for k in range(256)}, 256: b"<s>"}


def test_whole_files_and_delimited_ones(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("a\r\nb é<|end|>\nc<|end|>".encode())
    assert artifacts.read_documents(spark, str(tmp_path / "x.txt")).first().text == "a\r\nb é<|end|>\nc<|end|>"
    assert [r.text for r in artifacts.read_documents(spark, str(tmp_path / "x.txt"), "<|end|>").collect()] == ["a\r\nb é", "\nc"]


@pytest.mark.parametrize("size", [320, 400])
@pytest.mark.parametrize("stretch", [1 << 17, 9])
def test_encoders_equal_the_merges_in_order(spark, monkeypatch, stretch, size):
    from corpusloom.operators import bpe

    monkeypatch.setattr(bpe, "STRETCH", stretch)
    model = train_bpe(frame(spark, [MIXED] * 3), size)
    assert train_bpe(frame(spark, [MIXED]), size).merges == model.merges
    enc = model.encoder()
    assert enc.regular and enc.text(MIXED) == plain_encode(model, MIXED)
    enc.regular = False
    assert enc.text(MIXED) == plain_encode(model, MIXED)
    enc.regular = True


def test_irregular_vocabularies(spark):
    """Tokens that two merges make, that no text reaches, or whose ids are not in the order of merges."""
    base = {k: bytes([k]) for k in range(256)}
    unreached = BpeModel(base | {256: b"ab", 257: b"bc", 258: b"abc"}, [(b"a", b"b"), (b"b", b"c"), (b"a", b"bc")])
    assert not unreached.encoder().regular and unreached.encoder().text("abc bc") == [256, 99, 32, 257]
    twice = BpeModel(base | {256: b"ab", 257: b"bc", 258: b"abc", 259: b"abc"}, [(b"b", b"c"), (b"a", b"b"), (b"a", b"bc"), (b"ab", b"c")])
    assert not twice.encoder().regular and twice.encoder().text("abc") == [259]
    turned = BpeModel(base | {256: b"cd", 257: b"ab"}, [(b"a", b"b"), (b"c", b"d")])
    assert not turned.encoder().regular and turned.encoder().text("abcd") == [257, 256]
    shifted = BpeModel({k + 5: bytes([k]) for k in range(256)} | {300: b"ab", 301: b"abc"}, [(b"a", b"b"), (b"ab", b"c")], ["<s>"])
    assert shifted.encoder().regular and shifted.encoder().text("abc<s>ab") == [301, 302, 300]


def test_columns_of_ids(spark):
    import numpy as np

    model = train_bpe(frame(spark), 300, ("<|end|>",))
    texts = [*TEXTS, MIXED, "<|end|>", "x<|end|>", "low " * 40_000]
    rows = frame(spark, texts).repartition(3)
    got = {r.doc_id: r for r in rows.select("doc_id", model.encode_column(spark, F.col("text")).alias("ids"), model.packed_column(spark, F.col("text")).alias("raw"), model.summary_column(spark, F.col("text")).alias("t")).collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k].ids is None and got[k].raw is None and got[k].t is None
            continue
        want = model.encoder().text(t)
        assert got[k].ids == want and np.frombuffer(got[k].raw, "<u2").tolist() == want
        assert tuple(got[k].t) == (len(want), min(want, default=None), max(want, default=None), sum(want))
    big = BpeModel({k + 65_400: bytes([k]) for k in range(256)}, [])
    with pytest.raises(Exception, match="beyond uint16"):
        frame(spark, ["\x7fz", "é"]).select(big.packed_column(spark, F.col("text"))).collect()


def test_running_sums(spark):
    rows = spark.createDataFrame([(0, [3, 0, 2]), (1, []), (2, None), (3, [5])], "k int, s array<int>")
    got = {r.k: r.p and [tuple(x) for x in r.p] for r in rows.repartition(1).select("k", T.running_sums(F.col("s")).alias("p")).collect()}
    assert got == {0: [(0, 3), (3, 3), (3, 5)], 1: [], 2: None, 3: [(0, 5)]}


def test_independent_stops_at_a_shared_symbol():
    assert independent([(9, "a", "b"), (8, "c", "d"), (7, "b", "e"), (6, "f", "g")], True) == [(9, "a", "b"), (8, "c", "d")]


def test_specials_are_kept_whole_and_out_of_the_merges(spark):
    m = train_bpe(frame(spark, ["a<|end|>a b<|end|>"] * 5), 270, ("<|end|>",))
    assert m.vocab[256] == b"<|end|>" and not any(b"<|" in v for k, v in m.vocab.items() if k != 256)
    got = m.encode(frame(spark, ["x<|end|><|end|>y"])).first().ids
    assert got == [120, 256, 256, 121]


def test_overlapping_specials_match_longest(spark):
    m = train_bpe(frame(spark, ["q"]), 256, ("<s>", "<s><s>"))
    assert m.encode(frame(spark, ["<s><s><s>"])).first().ids == [257, 256]


def test_round_trip(spark):
    m = train_bpe(frame(spark), 300)
    for row in m.decode(m.encode(frame(spark))).collect():
        assert row.decoded == row.text


def test_decoding_holds_one_row_of_numbers():
    """The numbers of a whole batch take many times the memory of its ids."""
    import tracemalloc

    import pyarrow as pa

    vocab = {k: b"x" for k in range(300, 2000)}
    rows = pa.array([[k % 1000 + 500 for k in range(5000)]] * 200 + [None, []], pa.list_(pa.int32()))
    tracemalloc.start()
    got = bpe.decoded_rows(vocab, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [b"x" * 5000] * 200 + [None, b""] and peak < 4 << 20
    with pytest.raises(KeyError):
        bpe.decoded_rows(vocab, pa.array([[5]], pa.list_(pa.int32())))


def test_pretokens_tile_and_split(spark):
    text = "Isn't 3km far?!  Yes,\t\tso it's"
    got = frame(spark, [text]).select(T.pretokens(F.col("text")).alias("p")).first().p
    assert got == ["Isn", "'t", " 3", "km", " far", "?!", " ", " Yes", ",", "\t", "\t", "so", " it", "'s"] and "".join(got) == text


@pytest.mark.parametrize("size", [1, 3, 11, 500])
def test_chunks_equal_whole(spark, size):
    m = train_bpe(frame(spark), 300, ("<|end|>",))
    text = "they've  gone <|end|> she'd\n\n be 77 <|end|>" * 3
    enc = m.encoder()
    assert list(enc.iterate(text[k : k + size] for k in range(0, len(text), size))) == enc.text(text)
    sunk = []
    assert enc.write((text[k : k + size] for k in range(0, len(text), size)), sunk.append, 32) == len(enc.text(text))
    assert b"".join(sunk) == enc.packed(text) and all(len(x) >= 32 for x in sunk[:-1])


def test_a_prefix_ends_between_tokens(spark):
    enc = train_bpe(frame(spark, ["a"]), 256).encoder()
    assert bytes(prefix(enc, "low lower", 3)) == b"low" and prefix(enc, "low", 0) == []
    for end in (2, 5, 10):
        with pytest.raises(ValueError):
            prefix(enc, "low lower", end)


def stream(spark, folder, model, batches):
    """The ids of each stream after all micro-batches."""
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "stream_id long, seq int, chunk string, last boolean")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema("stream_id long, seq int, chunk string, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    sink = encode_stream(source, model).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    out = {}
    for r in spark.read.parquet(f"{folder}/out").orderBy("stream_id", "batch").collect():
        out.setdefault(r.stream_id, []).append(r.ids)
    return out


def test_streams_over_micro_batches(spark, tmp_path):
    m = train_bpe(frame(spark), 300, ("<|end|>",))
    one, two = "they've gone <|end|> lower still", "newest widest"
    cut = [one[k : k + 5] for k in range(0, len(one), 5)]
    rows = [(1, k, x, k == len(cut) - 1) for k, x in enumerate(cut)]
    # Chunks that come early, twice and in another order; a stream that begins later; one that is empty.
    batches = [[rows[2], rows[0]], [rows[1], rows[0], (2, 0, two[:4], False)], [*reversed(rows[3:]), (3, 0, None, True)], [(2, 1, two[4:], True)]]
    got = stream(spark, str(tmp_path), m, batches)
    enc = m.encoder()
    assert {k: sum(v, []) for k, v in got.items()} == {1: enc.text(one), 2: enc.text(two), 3: []}
    assert len(got[1]) == 3 and len(got[2]) == 2


def test_a_stream_ends_with_its_last_chunk(spark, tmp_path):
    m = train_bpe(frame(spark), 260)
    with pytest.raises(Exception, match="goes on after its last chunk"):
        stream(spark, str(tmp_path), m, [[(1, 0, "low", True), (1, 1, "er", False)]])


def test_flush_keeps_a_growing_contraction(spark):
    enc = train_bpe(frame(spark, ["a"]), 256).encoder()
    done, rest = flush(enc, "we'")
    assert rest.endswith("'") and bytes(done).decode() + rest == "we'"


def test_artifacts(spark, tmp_path):
    m = train_bpe(frame(spark), 290, ("<|end|>",))
    artifacts.save(m, tmp_path / "m", {"input": "x"})
    back = artifacts.load(tmp_path / "m/vocab.json", tmp_path / "m/merges.txt", ("<|end|>",))
    assert (back.vocab, back.merges) == (m.vocab, m.merges)
    with pytest.raises(FileExistsError):
        artifacts.save(m, tmp_path / "m")
    with pytest.raises(ValueError):
        artifacts.load_vocab("x.pkl")
    assert artifacts.parse_vocab('{"a": 0, "Ġ": 1}') == {0: b"a", 1: b" "}
    assert artifacts.parse_vocab('{"3": [1, 2]}') == {3: b"\x01\x02"}
    assert artifacts.parse_merges(["# c", "", "Ġ t", "0\tb'a'\tb\"'\"\tb'x'", "odd"]) == [(b" ", b"t"), (b"a", b"'")]
    artifacts.save_parquet(m, spark, str(tmp_path / "p"))
    assert artifacts.load_parquet(spark, str(tmp_path / "p")).vocab == m.vocab


def test_npy(spark, tmp_path):
    import numpy as np

    m = train_bpe(frame(spark), 290)
    enc = m.encode(frame(spark).filter("text is not null"))
    facts = artifacts.export_npy(enc, tmp_path / "ids.npy", n_bytes=10)
    a = np.load(tmp_path / "ids.npy")
    assert a.dtype == np.dtype("<u2") and a.tolist() == [i for r in enc.orderBy("doc_id").collect() for i in r.ids]
    assert facts["token_count"] == len(a) and json.loads((tmp_path / "ids.json").read_text()) == facts
    assert artifacts.export_npy(enc, tmp_path / "ids.npy") == facts
    assert artifacts.read_npy(spark, str(tmp_path / "ids.npy")).count() == len(a)
    assert artifacts.manifest(spark, str(tmp_path)).first().token_count == len(a)


def test_sql_functions(spark):
    m = train_bpe(frame(spark), 280)
    m.register(spark, "enc")
    assert spark.sql("select enc('low') as x").first().x == m.encoder().text("low")
    assert [r.token_id for r in spark.sql("select * from enc_tokens('low')").orderBy("pos").collect()] == m.encoder().text("low")
