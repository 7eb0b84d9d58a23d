import random
from collections import Counter

import duckdb
import pytest

from corpusloom.operators import bpe
from corpusloom.plans import oracles, queries


def test_compression_is_that_of_a_whole_vocabulary(spark, tmp_path):
    """On a corpus this small the pairs run out: each pretoken is one token, in Spark and in SQL."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 9))) for _ in range(120)]
    rows = [(k, " ".join(rng.choices(words, k=40)), rng.choice(["en", "de", None])) for k in range(30)]
    rows += [(30, None, "fr"), (31, "", "en"), (32, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.lang: (r.n_bytes, r.n_tokens, r.bytes_per_token) for r in queries.compression_ratio(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == {lang: tuple(rest) for lang, *rest in con.execute(oracles.oracle_sql()["compression_ratio"]).fetchall()}
    assert {lang: n for lang, (_, n, _) in got.items()} == {"en": 40 * sum(r[2] == "en" and bool(r[1]) for r in rows), "de": 40 * sum(r[2] == "de" for r in rows), None: 40 * sum(r[2] is None for r in rows), "fr": 0}


@pytest.mark.parametrize("n_merges", [12, 90])
def test_sql_of_many_merges_equals_the_loop(n_merges):
    rng = random.Random(3)
    words = Counter("".join(rng.choices("aabc", k=rng.randint(1, 12))) for _ in range(150))
    con = duckdb.connect()
    con.execute("create table counts (pretoken text, cnt int)")
    con.executemany("insert into counts values (?, ?)", list(words.items()))
    got = dict(con.execute(f"with recursive {oracles.segmented(n_merges, 20)} select k, w from st where k <> ''").fetchall())
    merges = [(a, b) for a, b, _ in bpe.merge_loop([(w.encode(), n) for w, n in words.items()], n_merges, 256)]
    encoder = bpe.Encoder({}, merges, [])
    assert got == {w: "".join(f"<{t.hex()}>" for t in encoder.merged(w.encode())) for w in words}


@pytest.mark.parametrize("room", [1 << 20, 150, 0])
def test_rounds_over_stretches_equal_the_loop(spark, monkeypatch, room):
    """Whether there is room for the stretches of many pairs, few or none; a round makes many merges."""
    rng = random.Random(5)
    words = Counter("".join(rng.choices("aabcd", k=rng.randint(1, 14))) for _ in range(200))
    docs = spark.createDataFrame(list(words.items()), "pretoken string, cnt long").repartition(3)
    most = 70 if room else 20
    seen, tied = [], bpe._tied
    monkeypatch.setattr(bpe, "local_bytes", lambda _: room)
    monkeypatch.setattr(bpe, "_tied", lambda *a, **k: seen.append(1) or tied(*a, **k))
    model = bpe.train_bpe_distributed(docs, 256 + most, ranked=8, cut_every=3, counted=True)
    want = bpe.merge_loop([(w.encode(), n) for w, n in words.items()], most, 256)
    assert [(a, b, n) for (a, b), n in zip(model.merges, model.counts, strict=True)] == want
    assert bool(seen) == (room == 0)
