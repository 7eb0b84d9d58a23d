"""One query for each operator, over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tensor as X
from ..functions import text as T
from ..functions.bytes import bytes_literal
from ..operators import training
from ..operators.bpe import BpeModel, pretoken_counts as count_pretokens, train_bpe, train_bpe_distributed
from ..sources import artifacts
from ..sources.shared import shared_dir, spread, stamp
from ..streaming.encode import encode_stream

Query = Callable[[SparkSession, str], DataFrame]
MERGES = 24
#: Tokens of the vocabulary by which compression is measured, as the reference's run on stories trains it.
VOCABULARY = 10_000
SPECIALS = (". ", "<|end|>")
CHUNK = 1000
D, HEADS, FF = 64, 4, 128


#: Models by the files they were trained on; trained once for all queries of a session.
_MODELS: dict[tuple, BpeModel] = {}


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows) if table in ("documents", "pages", "conversations") else rows


def _train(spark: SparkSession, sf_dir: str, specials: tuple[str, ...] = (), again: bool = False, size: int | None = None) -> BpeModel:
    size = 256 + len(specials) + MERGES if size is None else size
    key = (spark.sparkContext.applicationId, sf_dir, specials, size, stamp(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    if again or key not in _MODELS:
        _MODELS[key] = train_bpe(_docs(spark, sf_dir), size, specials)
    return _MODELS[key]


# --- pretokens and pairs ---


def pretoken_counts(spark, sf_dir):
    return count_pretokens(_docs(spark, sf_dir))


def pretoken_totals(spark, sf_dir):
    return pretoken_counts(spark, sf_dir).agg(F.count("*").alias("n_unique"), F.sum("cnt").alias("n_total"))


def pretoken_spans(spark, sf_dir):
    """Offsets (code points) as running sums of lengths, within each text's array: nothing is shuffled."""
    sizes = F.transform(T.pretokens(F.col("text")), lambda p: F.length(p))
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.running_sums(sizes)).alias("pos", "s"))
    return rows.select("doc_id", "pos", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


def special_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_on_specials(F.col("text"), SPECIALS)).alias("seg", "segment"))


def special_segments(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.segments(F.col("text"), SPECIALS)).alias("seg", "s"))
    return rows.select("doc_id", "seg", F.col("s.text").alias("segment"), F.col("s.special").alias("is_special"))


def _words(spark, sf_dir):
    return pretoken_counts(spark, sf_dir).select("pretoken", "cnt", T.tokens_of(T.hex_word(F.col("pretoken"))).alias("tokens"))


def byte_counts(spark, sf_dir):
    rows = _words(spark, sf_dir).select(F.explode("tokens").alias("byte"), "cnt")
    return rows.groupBy("byte").agg(F.sum("cnt").alias("n"))


def initial_pair_counts(spark, sf_dir):
    rows = _words(spark, sf_dir).select(F.explode(T.adjacent_pairs(F.col("tokens"))).alias("p"), "cnt")
    return rows.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("cnt").alias("n"))


def pair_postings(spark, sf_dir):
    rows = _words(spark, sf_dir).select(F.explode(F.array_distinct(T.adjacent_pairs(F.col("tokens")))).alias("p"))
    return rows.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.count("*").alias("n_words"))


def pair_posting_lists(spark, sf_dir):
    """The words of each pair, a row for each: no pair's list is gathered in one place."""
    rows = _words(spark, sf_dir).select("pretoken", F.explode(F.array_distinct(T.adjacent_pairs(F.col("tokens")))).alias("p"))
    return rows.select("p.l", "p.r", "pretoken")


# --- training and coding ---


def _merge_rows(spark: SparkSession, m: BpeModel) -> DataFrame:
    rows = [(k, a.hex(), b.hex(), n) for k, ((a, b), n) in enumerate(zip(m.merges, m.counts, strict=True))]
    return spark.createDataFrame(rows, "rank int, l string, r string, n long")


def bpe_merges(spark, sf_dir):
    return _merge_rows(spark, _train(spark, sf_dir, again=True))


def bpe_merges_distributed(spark, sf_dir):
    """The same merges by rounds of jobs."""
    return _merge_rows(spark, train_bpe_distributed(_docs(spark, sf_dir), 256 + MERGES))


def bpe_vocab(spark, sf_dir):
    v = _train(spark, sf_dir).vocab_frame(spark)
    return v.select("token_id", F.lower(F.hex("bytes")).alias("hex"), T.decoded_or_null(F.col("bytes")).alias("utf8"))


def _encoded(spark, sf_dir):
    return _train(spark, sf_dir).encode(_docs(spark, sf_dir).select("doc_id", "lang", "text"))


def encode_tokens(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.posexplode("ids").alias("pos", "token_id"))


def encode_with_specials(spark, sf_dir):
    m = _train(spark, sf_dir, ("<|end|>",))
    rows = _docs(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit("<|end|>")).alias("text"))
    ids = m.encode(rows)
    return ids.select("conv_id", "turn", F.size("ids").alias("n_tokens"), F.element_at("ids", -1).alias("last_id"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("id_sum"))


def _summaries(spark, sf_dir, size: int | None = None) -> DataFrame:
    """Documents with sums over their ids (struct t); the ids themselves stay where they are made."""
    m = _train(spark, sf_dir, size=size)
    return _docs(spark, sf_dir).select("doc_id", "lang", "text", m.summary_column(spark, F.col("text")).alias("t"))


def doc_token_counts(spark, sf_dir):
    return _summaries(spark, sf_dir).select("doc_id", F.col("t.n").cast("int").alias("n_tokens"))


def _weighted_tokens(spark, sf_dir) -> DataFrame:
    """(token_id, cnt): each distinct pretoken is encoded once and weighs as often as it occurs."""
    m = _train(spark, sf_dir)
    return m.encode(pretoken_counts(spark, sf_dir), "pretoken").select(F.explode("ids").alias("token_id"), "cnt")


def token_frequency(spark, sf_dir):
    return _weighted_tokens(spark, sf_dir).groupBy("token_id").agg(F.sum("cnt").alias("n"))


def decode_roundtrip(spark, sf_dir):
    m = _train(spark, sf_dir)
    rows = m.decode(m.encode(_docs(spark, sf_dir).select("doc_id", "text")))
    return rows.select("doc_id", (F.col("decoded") == F.col("text")).alias("same"), F.length("decoded").alias("n_chars"))


def decode_invalid_utf8(spark, sf_dir):
    rows = spark.createDataFrame([(0, bytearray(b"\xff")), (1, bytearray(b"a\xc3")), (2, bytearray(b"\xe2\x82x")), (3, bytearray("é".encode()))], "k int, raw binary")
    return rows.select("k", T.decoded(F.col("raw")).alias("decoded"), T.decoded_or_null(F.col("raw")).isNull().alias("invalid"))


def token_stream_stats(spark, sf_dir):
    rows = _weighted_tokens(spark, sf_dir)
    return rows.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_tokens"), F.coalesce(F.min("token_id"), F.lit(0)).alias("min_id"), F.coalesce(F.max("token_id"), F.lit(0)).alias("max_id"))


def token_stream_sha256(spark, sf_dir):
    m = _train(spark, sf_dir)
    return _docs(spark, sf_dir).select("doc_id", F.sha2(m.packed_column(spark, F.col("text")), 256).alias("sha256"))


def compression_ratio(spark, sf_dir):
    """Bytes for each token of a vocabulary of full size, trained on the documents."""
    rows = _summaries(spark, sf_dir, VOCABULARY).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.coalesce("t.n", F.lit(0))).alias("n_tokens"))
    return rows.select("lang", "n_bytes", "n_tokens", F.round(F.try_divide(F.col("n_bytes"), F.col("n_tokens")), 6).alias("bytes_per_token"))


def cross_corpus_compression(spark, sf_dir):
    m = _train(spark, sf_dir)
    out = None
    for table, column in (("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")):
        part = _docs(spark, sf_dir, table).select(F.col(column).alias("text"), m.summary_column(spark, F.col(column)).alias("t"))
        part = part.agg(F.lit(table).alias("corpus"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum("t.n").alias("n_tokens"))
        out = part if out is None else out.unionByName(part)
    return out.select("corpus", "n_bytes", "n_tokens", F.round(F.try_divide(F.col("n_bytes"), F.col("n_tokens")), 6).alias("bytes_per_token"))


def longest_tokens(spark, sf_dir):
    v = _train(spark, sf_dir).vocab_frame(spark).select("token_id", F.lower(F.hex("bytes")).alias("hex"), F.octet_length("bytes").alias("n_bytes"))
    return v.join(v.agg(F.max("n_bytes").alias("n_bytes")), "n_bytes", "left_semi").select("token_id", "hex", "n_bytes")


def doc_sample(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", F.md5(F.concat(F.lit("336-"), F.col("doc_id").cast("string")).cast("binary")).alias("h")).orderBy("h", "doc_id").limit(10)


def chunk_boundaries(spark, sf_dir):
    """Evenly spaced guesses moved on to the next delimiter, once each."""
    n = 8
    size = F.length("text")
    guess = F.floor(size * F.col("k") / n).cast("int")
    at = F.expr("locate('. ', text, guess + 1)")
    rows = _docs(spark, sf_dir).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k")).withColumn("guess", guess)
    place = F.when(F.col("k") == 0, 0).when((F.col("k") == n) | (at == 0), size).otherwise(at - 1)
    return rows.select("doc_id", place.alias("boundary")).distinct()


def text_chunks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.chunked(F.col("text"), CHUNK)).alias("seq", "chunk"))


# --- artifacts ---


def byte_alphabet_table(spark, sf_dir):
    visible = F.col("id").between(33, 126) | (F.col("id").between(161, 255) & (F.col("id") != 173))
    rows = spark.range(256).withColumn("v", visible)
    hidden = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.select(F.col("id").cast("int").alias("byte"), F.when(F.col("v"), F.col("id")).otherwise(255 + hidden).cast("int").alias("code_point"))


def bytes_repr(spark, sf_dir):
    m = _train(spark, sf_dir)
    return spark.createDataFrame([(k, bytes_literal(v)) for k, v in sorted(m.vocab.items())], "token_id int, literal string")


def vocab_json(spark, sf_dir):
    m = _train(spark, sf_dir)
    rows = [(e["id"], e["hex"], e["repr"], e["utf8"], len(e["byte_values"])) for e in (artifacts.vocab_entry(k, v) for k, v in sorted(m.vocab.items()))]
    return spark.createDataFrame(rows, "token_id int, hex string, literal string, utf8 string, n_bytes int")


def merges_text(spark, sf_dir):
    return spark.createDataFrame([(k, line) for k, line in enumerate(artifacts.merge_lines(_train(spark, sf_dir)))], "rank int, line string")


def manifest(spark, sf_dir):
    """A sidecar row for each split of the corpus: tokens, extreme ids, bytes per token."""
    rows = _summaries(spark, sf_dir).groupBy(F.col("lang").alias("split_name")).agg(
        F.sum("t.n").alias("token_count"), F.min("t.low").alias("min_id"), F.max("t.high").alias("max_id"), F.sum(F.octet_length("text")).alias("input_bytes")
    )
    return rows.withColumn("bytes_per_token", F.round(F.try_divide("input_bytes", "token_count"), 6)).orderBy("split_name")


def streaming_encode(spark, sf_dir):
    """Documents as ordered chunks through the stateful encoder in several micro-batches; token counts as of whole texts."""
    m = _train(spark, sf_dir)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("stream_id"), F.posexplode(T.chunked(F.coalesce("text", F.lit("")), CHUNK)).alias("seq", "chunk"), F.length("text").alias("n"))
    rows = rows.select("stream_id", "seq", "chunk", (F.coalesce(F.col("n"), F.lit(0)) <= (F.col("seq") + 1) * CHUNK).alias("last"))
    # Texts go on from one micro-batch to the next: files come in the order they were written.
    for part in (F.col("seq") < 2, F.col("seq").between(2, 5), F.col("seq") > 5):
        rows.filter(part).write.mode("append").parquet(f"{folder}/chunks")
    files = len(spark.read.parquet(f"{folder}/chunks").inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(f"{folder}/chunks")
    sink = encode_stream(stream, m).writeStream.format("parquet").option("path", f"{folder}/ids").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/ids").groupBy("stream_id").agg(F.sum(F.size("ids")).cast("int").alias("n_tokens"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i)).alias("id_sum"))
    return out.select(F.col("stream_id").alias("doc_id"), "n_tokens", "id_sum")


# --- vectors ---


@cache
def _w(name: str, d_out: int, d_in: int) -> np.ndarray:
    """Closed-form weights, the same in the SQL."""
    phase = {"q": 1, "k": 2, "v": 3, "o": 4, "w1": 5, "w2": 6, "w3": 7, "linear": 0, "lm": 8, "e": 9}[name]
    o, i = np.arange(d_out)[:, None], np.arange(d_in)[None]
    return 0.1 * np.sin(0.1 * (o * d_in + i) + phase)


def _vectors(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return _docs(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), "label", F.floor(F.col("vec_id") / 10).alias("seq"), (F.col("vec_id") % 10).alias("pos"))


def _long(frame: DataFrame, y: Column) -> DataFrame:
    return frame.select("vec_id", F.posexplode(y).alias("i", "y")).select("vec_id", "i", (F.round("y", 6) + 0.0).alias("y"))


def linear(spark, sf_dir):
    w = _w("linear", D, D)
    return _long(_vectors(spark, sf_dir), X.map_vectors(lambda x: X.linear(x, w), F.col("x")))


def _greatest(x: Column) -> Column:
    return F.array_position(x, F.array_max(x)) - 1


def embedding_lookup(spark, sf_dir):
    """Rows of a weight table by id (the place of the vector's greatest component): an equi-join."""
    e = _w("e", 64, 8)
    table = spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(e)], "id long, row array<double>")
    ids = _vectors(spark, sf_dir).select("vec_id", _greatest(F.col("x")).alias("id"))
    return _long(ids.join(F.broadcast(table), "id"), F.col("row"))


def rope(spark, sf_dir):
    return _long(_vectors(spark, sf_dir), X.map_vectors(lambda x, p: X.rope(x, p), F.col("x"), F.col("pos")))


def rmsnorm(spark, sf_dir):
    """Higher-order functions suffice here: no Python."""
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x")
    return _long(_vectors(spark, sf_dir), F.transform("x", lambda v, i: v / F.sqrt(mean + 1e-5) * (1 + 0.01 * i)))


def sigmoid_silu(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v"))
    z = F.exp(-F.abs("v"))
    rows = rows.withColumn("sigmoid", F.when(F.col("v") >= 0, 1 / (1 + z)).otherwise(z / (1 + z)))
    return rows.select("vec_id", "i", F.round("sigmoid", 6).alias("sigmoid"), F.round(F.col("v") * F.col("sigmoid"), 6).alias("silu"))


def swiglu(spark, sf_dir):
    w1, w2, w3 = _w("w1", FF, D), _w("w2", D, FF), _w("w3", FF, D)
    return _long(_vectors(spark, sf_dir), X.map_vectors(lambda x: X.swiglu(x, w1, w2, w3), F.col("x")))


def softmax(spark, sf_dir):
    top = F.array_max("x")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return _long(_vectors(spark, sf_dir), F.transform("x", lambda v: F.exp(v - top) / total))


def _sequences(spark, sf_dir, f) -> DataFrame:
    rows = X.map_sequences(_vectors(spark, sf_dir), f, "seq", "pos")
    return _long(rows.withColumn("vec_id", F.col("seq") * 10 + F.col("pos")), F.col("y"))


def sdpa_masked(spark, sf_dir):
    def f(x):
        p = np.arange(len(x))
        return X.attention(x, x, x, ((p[:, None] + p[None]) % 3 != 0) | (p[:, None] == p[None]))

    return _sequences(spark, sf_dir, f)


def causal_mha(spark, sf_dir):
    w = [_w(k, D, D) for k in "qkvo"]
    return _sequences(spark, sf_dir, lambda x: X.multi_head(x, *w, HEADS))


def mha_rope(spark, sf_dir):
    w = [_w(k, D, D) for k in "qkvo"]
    return _sequences(spark, sf_dir, lambda x: X.multi_head(x, *w, HEADS, np.arange(len(x))))


def _block_weights() -> dict:
    gain = 1 + 0.01 * np.arange(D)
    return {k: _w(k, D, D) for k in "qkvo"} | {"w1": _w("w1", FF, D), "w2": _w("w2", D, FF), "w3": _w("w3", FF, D), "ln1": gain, "ln2": gain}


def transformer_block(spark, sf_dir):
    w = _block_weights()
    return _sequences(spark, sf_dir, lambda x: X.block(x, w, HEADS))


def transformer_lm(spark, sf_dir):
    w = {"embedding": _w("e", 64, D), "layers": [_block_weights()] * 2, "ln_final": np.ones(D), "lm_head": _w("lm", 64, D)}
    rows = _vectors(spark, sf_dir).withColumn("x", F.array(_greatest(F.col("x")).cast("double")))
    out = X.map_sequences(rows, lambda x: X.language_model(x[:, 0].astype(int), w, HEADS), "seq", "pos")
    return _long(out.withColumn("vec_id", F.col("seq") * 10 + F.col("pos")), F.col("y"))


# --- training utilities ---


def get_batch(spark, sf_dir):
    """Windows of the documents' bytes with labels one later; the start is a rule of the id."""
    length = 16
    rows = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all(T.hex_bytes(F.col("text")), F.lit(".."), F.lit(0)).alias("ids"))
    out = training.get_batch(rows, length, F.col("doc_id") * 7919 % (F.size("ids") - length))
    return out.select("doc_id", F.array_join("x", "").alias("x_hex"), F.array_join("y", "").alias("y_hex"))


def cross_entropy(spark, sf_dir):
    loss = training.cross_entropy(F.col("x"), (F.col("vec_id") % D).cast("int"))
    return _vectors(spark, sf_dir).agg(F.round(F.avg(loss), 6).alias("loss"), F.count("*").alias("n"))


def grad_clip(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "g"))
    return training.clip_gradients(rows, 1.0).select("vec_id", "i", (F.round("g", 6) + 0.0).alias("g"))


def adamw_steps(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v")).withColumns({"x": F.col("v"), "m": F.lit(0.0), "s": F.lit(0.0)})
    for t in range(1, 6):
        rows = training.adamw_step(rows.withColumn("g", F.col("x") * (1 + 0.1 * t)), t)
    return rows.select("vec_id", "i", F.round("v", 6).alias("v"))


def lr_schedule(spark, sf_dir):
    return spark.range(25).select(F.col("id").alias("it"), F.round(training.cosine_lr(F.col("id"), 1.0, 0.1, 7, 21), 6).alias("lr"))


def checkpoint_roundtrip(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v"))
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    training.save_checkpoint(rows, 7, path)
    back, iteration = training.load_checkpoint(spark, path)
    return back.groupBy("vec_id").agg(F.lit(iteration).alias("iteration"), F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


def d_ff_default(spark, sf_dir):
    d = F.col("id") * 32
    return spark.range(1, 65).select(d.alias("d"), F.greatest(F.lit(64), F.floor((8 * d / 3 + 32) / 64) * 64).cast("long").alias("d_ff"))


def duration_format(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.duration(F.col("n_chars") / 7).alias("duration"))


def queries() -> dict[str, Query]:
    own = [
        pretoken_counts, pretoken_totals, pretoken_spans, special_split, special_segments, byte_counts, initial_pair_counts, pair_postings,
        pair_posting_lists, bpe_merges, bpe_merges_distributed, bpe_vocab, encode_tokens, encode_with_specials, doc_token_counts, token_frequency, decode_roundtrip, decode_invalid_utf8,
        token_stream_stats, token_stream_sha256, compression_ratio, cross_corpus_compression, longest_tokens, doc_sample, chunk_boundaries, text_chunks,
        bytes_repr, vocab_json, merges_text, manifest, streaming_encode, linear, embedding_lookup, rope, rmsnorm, sigmoid_silu, swiglu, softmax,
        sdpa_masked, causal_mha, mha_rope, transformer_block, transformer_lm, get_batch, cross_entropy, grad_clip, adamw_steps, lr_schedule,
        checkpoint_roundtrip, d_ff_default, duration_format,
    ]
    return {f.__name__: f for f in own} | {"byte_alphabet": byte_alphabet_table}


