"""Byte-pair-encoding: training, encoding and decoding on DataFrames.

Training counts distinct pretokens on the cluster; their table is far smaller
than the corpus.  Where they fit the driver (``local_bytes``) the sequential
merge loop runs there over flat arrays, beyond that ``train_bpe_distributed``
runs it over the stretches of words where frequent pairs touch, round by round,
and gives the same merges.

Encoding sends whole texts to Arrow functions, which give back flat buffers:
ids, packed bytes or sums only, whichever a query needs.
"""

from __future__ import annotations

import heapq
import time
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Bytes of distinct pretokens that a driver of any size trains on, and what its arrays take for each at their peak.
MAX_LOCAL_BYTES, LOCAL_COST = 64 << 20, 64
#: Columns of a block of words: tokens (32-bit, each word ended by -1) and how often each word occurs (64-bit).
BLOCK = "tokens binary, weights binary"
#: Symbols up to which the pairs of a block are counted in a table of all pairs, and sums that a task holds.
DENSE, HELD_SUMS = 512, 1 << 20
#: Merges after which blocks are written anew, symbols of a block, and pairs whose stretches a round gathers at most.
CUT_MERGES, BLOCK_SYMBOLS, MOST_RANKED = 4096, 1 << 20, 1 << 16
UINT16_MAX = 65_535
#: Pretokens an encoder remembers, and characters of the longest.
MEMO, MEMO_CHARS = 200_000, 64
#: Characters that are encoded in one go.
STRETCH = 1 << 17


def pretoken_counts(docs: DataFrame, text: str = "text", specials: Sequence[str] = ()) -> DataFrame:
    """(pretoken, cnt) over all texts; special tokens separate segments and are not counted."""
    segment = F.explode(T.split_on_specials(F.col(text), specials)) if specials else F.col(text)
    words = docs.select(segment.alias("s")).select(F.explode(T.pretokens(F.col("s"))).alias("pretoken"))
    return words.groupBy("pretoken").agg(F.count("*").alias("cnt"))


def base_vocabulary(specials: Sequence[str]) -> dict[int, bytes]:
    """The 256 bytes, then the specials that are not already there."""
    vocab = {b: bytes([b]) for b in range(256)}
    have = set(vocab.values())
    for s in specials:
        raw = s.encode()
        if raw not in have:
            have.add(raw)
            vocab[len(vocab)] = raw
    return vocab


def local_bytes(spark: SparkSession) -> int:
    """Bytes of distinct pretokens that the driver trains on: its arrays take a third of what the JVM beside them may."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    return min(MAX_LOCAL_BYTES, heap // 3 // LOCAL_COST)


def flat_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of words, and the length of each word."""
    words = words.cast(pa.binary())
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], np.diff(bounds).astype(np.int64)


class _Later:
    """Orders names from the greatest down, for a heap of ties."""

    __slots__ = ("name",)

    def __init__(self, name: tuple[bytes, bytes]):
        self.name = name

    def __lt__(self, other: _Later) -> bool:
        return self.name > other.name


class Symbols:
    """The words' symbols in flat linked arrays, the count of each adjacent pair and the places where it begins.

    Places are listed when a pair comes into being and checked when it is merged,
    so that a merge touches the occurrences of its pair and their neighbours only.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        n = len(data)
        ends = np.cumsum(lengths)
        self.token = data.astype(np.int32)
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.back = np.arange(-1, n - 1, dtype=np.int32)
        full = lengths > 0
        self.next[ends[full] - 1] = -1
        self.back[(ends - lengths)[full]] = -1
        self.weight = np.repeat(weights.astype(np.int64), lengths)
        self.counts: dict[int, int] = {}
        self.places: dict[int, list[np.ndarray]] = {}
        self.add(np.flatnonzero(self.next >= 0).astype(np.int32), data.dtype == np.uint8)

    def keys(self, at: np.ndarray) -> np.ndarray:
        return self.token[at].astype(np.int64) << 32 | self.token[self.next[at]]

    def add(self, at: np.ndarray, pairs_of_bytes: bool = False) -> list[int]:
        """Count and list the pairs that begin at these places; their keys."""
        keys = self.keys(at)
        if pairs_of_bytes:  # they sort by radix
            order = np.argsort(((keys >> 32) << 8 | keys & 255).astype(np.uint16), kind="stable")
        else:
            order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(self.weight[at], first).tolist() if len(first) else []
        found = keys[first].tolist()
        for key, n, part in zip(found, sums, np.split(at, first[1:]), strict=False):
            self.counts[key] = self.counts.get(key, 0) + n
            self.places.setdefault(key, []).append(part)
        return found

    def take(self, at: np.ndarray) -> None:
        """Uncount the pairs that begin at these places."""
        keys = self.keys(at)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(self.weight[at[order]], first).tolist() if len(first) else []
        for key, n in zip(keys[first].tolist(), sums, strict=True):
            if key in self.counts:
                self.counts[key] -= n

    def merge(self, key: int, new: int) -> list[int]:
        """Join the pair's occurrences from left to right into a new symbol; the keys of the pairs that come into being."""
        left, right = key >> 32, key & 0xFFFFFFFF
        at = np.sort(np.concatenate(self.places.pop(key)))
        del self.counts[key]
        follow = self.next[at]
        at = at[(self.token[at] == left) & (follow >= 0)]
        at = at[self.token[self.next[at]] == right]
        if left == right and len(at):  # of a run of overlapping occurrences every second one
            k = np.arange(len(at))
            start = np.concatenate(([True], self.next[at[:-1]] != at[1:]))
            at = at[(k - np.maximum.accumulate(np.where(start, k, 0))) % 2 == 0]
        gone = self.next[at]
        before, after = self.back[at], self.next[gone]
        self.take(np.unique(np.concatenate((before[before >= 0], gone[after >= 0]))))
        self.token[at], self.token[gone] = new, -1
        self.next[at] = after
        self.back[after[after >= 0]] = at[after >= 0]
        before = self.back[at]
        return self.add(np.unique(np.concatenate((before[before >= 0], at[after >= 0]))))


def merge_symbols(symbols: Symbols, n_merges: int, first_id: int, names: dict[int, bytes] | None = None, floor: int = 0, keys: list[int] | None = None) -> list[tuple[bytes, bytes, int]]:
    """The merges (left, right, count): most frequent pair first, ties to the greater pair of bytes.

    ``names``: the bytes of each symbol, to which new ones are added.  Only pairs
    that occur more than ``floor`` times are merged; ``keys`` takes theirs.
    """
    names = {b: bytes([b]) for b in range(256)} if names is None else names

    def entry(key: int) -> tuple[int, _Later, int]:
        return -symbols.counts[key], _Later((names[key >> 32], names[key & 0xFFFFFFFF])), key

    heap = [entry(key) for key in symbols.counts]
    heapq.heapify(heap)
    merges: list[tuple[bytes, bytes, int]] = []
    while heap and len(merges) < n_merges:
        count, _, key = heapq.heappop(heap)
        now = symbols.counts.get(key, 0)
        if now <= floor:
            continue
        if now != -count:  # counts of listed pairs only fall
            heapq.heappush(heap, entry(key))
            continue
        left, right, new = names[key >> 32], names[key & 0xFFFFFFFF], first_id + len(merges)
        names[new] = left + right
        merges.append((left, right, now))
        if keys is not None:
            keys.append(key)
        for pair in symbols.merge(key, new):
            heapq.heappush(heap, entry(pair))
    return merges


def merge_loop(words: list[tuple[bytes, int]], n_merges: int, first_id: int) -> list[tuple[bytes, bytes, int]]:
    """The merges of (word, count) pairs."""
    data = np.frombuffer(b"".join(w for w, _ in words), np.uint8)
    return merge_symbols(Symbols(data, np.array([len(w) for w, _ in words], np.int64), np.array([n for _, n in words], np.int64)), n_merges, first_id)


def joined(parts: list, left, right, both) -> list:
    """A sequence with each (left, right) from left to right replaced by ``both``."""
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
            out.append(both)
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


@dataclass
class BpeModel:
    """Vocabulary (id to bytes), merges in order, and special tokens."""

    vocab: dict[int, bytes]
    merges: list[tuple[bytes, bytes]]
    specials: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)  # how often each merge's pair occurred

    def __post_init__(self):
        have = set(self.vocab.values())
        for s in self.specials:
            if s.encode() not in have:
                have.add(s.encode())
                self.vocab[max(self.vocab, default=-1) + 1] = s.encode()

    @property
    def ids(self) -> dict[bytes, int]:
        return {raw: k for k, raw in sorted(self.vocab.items())}

    # --- small frames of the model ---
    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, bytearray(v)) for k, v in sorted(self.vocab.items())], "token_id int, bytes binary")

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, bytearray(a), bytearray(b), bytearray(a + b)) for k, (a, b) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left binary, right binary, merged binary")

    # --- coding ---
    @cached_property
    def _encoder(self) -> Encoder:
        return Encoder(self.ids, self.merges, self.specials)

    def encoder(self) -> Encoder:
        return self._encoder

    def _column(self, spark: SparkSession, text: Column, kind: str, make) -> Column:
        shared = spark.sparkContext.broadcast(self.encoder())

        @F.arrow_udf(kind)
        def run(texts: pa.Array) -> pa.Array:
            return make(shared.value, texts)

        # Evaluated where it stands: an explode would infer a filter that runs it once more.
        return run.asNondeterministic()(text.cast("string"))

    def encode_column(self, spark: SparkSession, text: Column) -> Column:
        """ids of a text column; no shuffle."""
        return self._column(spark, text, "array<int>", Encoder.arrow_ids)

    def packed_column(self, spark: SparkSession, text: Column) -> Column:
        """ids of a text column as little-endian unsigned 16-bit integers; an id beyond them is an error."""
        return self._column(spark, text, "binary", Encoder.arrow_packed)

    def summary_column(self, spark: SparkSession, text: Column) -> Column:
        """struct of the number, least, greatest and sum of a text's ids (null text: null)."""
        return self._column(spark, text, "struct<n:bigint,low:int,high:int,total:bigint>", Encoder.arrow_summary)

    def encode(self, docs: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        return docs.withColumn(to, self.encode_column(docs.sparkSession, F.col(text)))

    def decode_column(self, spark: SparkSession, ids: Column) -> Column:
        """Text of an id array; unknown ids raise, malformed UTF-8 becomes U+FFFD."""
        shared = spark.sparkContext.broadcast(self.vocab)

        @F.arrow_udf("binary")
        def join(rows: pa.Array) -> pa.Array:
            return decoded_rows(shared.value, rows)

        return T.decoded(join(ids))

    def decode(self, frame: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        return frame.withColumn(to, self.decode_column(frame.sparkSession, F.col(ids)))

    def register(self, spark: SparkSession, name: str = "bpe_encode") -> None:
        """A SQL function of a text; a table function ``<name>_tokens(text)`` gives (pos, token_id)."""
        enc = self.encoder()

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return enc.arrow_ids(texts)

        spark.udf.register(name, encode)

        @F.udtf(returnType="pos int, token_id int")
        class Tokens:
            def eval(self, text: str):
                for pos, token in enumerate(enc.text(text or "")):
                    yield pos, token

        spark.udtf.register(f"{name}_tokens", Tokens)


def decoded_rows(vocab: dict[int, bytes], rows: pa.Array) -> pa.Array:
    """The bytes of each id array; Python's numbers are made for one row at a time."""
    return pa.array([b"".join(map(vocab.__getitem__, r.values.to_pylist())) if r.is_valid else None for r in rows], pa.binary())


def packed_ids(ids: np.ndarray) -> bytes:
    """Little-endian unsigned 16-bit integers; an id beyond them is an error."""
    if len(ids) and (ids.min() < 0 or ids.max() > UINT16_MAX):
        raise ValueError("token id beyond uint16")
    return ids.astype("<u2").tobytes()


class Encoder:
    """Greedy lowest-rank merging of pretokens, with a bounded memo.

    A *regular* vocabulary has a token of its own for each merge, with ids in the
    order of merges, and merges each token's own bytes to that token: then any
    merger that joins what makes the token of least id gives the same ids, and
    tiktoken does so for whole texts.
    """

    def __init__(self, ids: dict[bytes, int], merges: Sequence[tuple[bytes, bytes]], specials: Sequence[str]):
        import regex

        self.ids, self.specials = ids, list(specials)
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.memo: dict[str, list[int]] = {}
        self.special_ids = {s: ids[s.encode()] for s in specials}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=lambda s: (-len(s), s)))) + ")") if self.specials else None
        self.pretokens = regex.compile(T.PATTERN)
        self.regular = self._is_regular()
        self._merger = None

    def _is_regular(self) -> bool:
        try:
            import tiktoken  # noqa: F401
        except ImportError:
            return False
        made = [a + b for a, b in self.rank]
        order = [self.ids.get(m, -1) for m in made]
        if any(bytes([b]) not in self.ids for b in range(256)) or len(set(made)) < len(made) or any(x >= y for x, y in zip(order, order[1:], strict=False)):
            return False
        return all(k >= 0 for k in order) and all(self.merged(m) == [m] for m in made)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "_merger": None}

    def merged(self, raw: bytes) -> list[bytes]:
        """The tokens of a pretoken's bytes."""
        parts = [bytes([b]) for b in raw]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            parts = joined(parts, *best, best[0] + best[1])
        return parts

    def word(self, pretoken: str) -> list[int]:
        if (known := self.memo.get(pretoken)) is not None:
            return known
        found = [self.ids[p] for p in self.merged(pretoken.encode())]
        if len(pretoken) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[pretoken] = found
        return found

    def merger(self) -> Callable[[str], list[int]]:
        """Of a regular vocabulary: ids of a text of at most STRETCH characters.

        Ids serve as ranks; only their order among the merges matters.
        """
        if self._merger is None:
            import tiktoken

            ranks = {raw: self.ids[raw] for raw in [*(bytes([b]) for b in range(256)), *(a + b for a, b in self.rank)]}
            self._merger = tiktoken.Encoding(name="bpe", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return self._merger

    def plain(self, text: str) -> list[int]:
        """ids of a text without special tokens."""
        if not self.regular:
            return self._words(text)
        merger = self.merger()
        if len(text) <= STRETCH:
            return merger(text)
        return [k for part in T.stretches(text, STRETCH) for k in (merger(part) if len(part) <= STRETCH else self._words(part))]

    def _words(self, text: str) -> list[int]:
        return [k for p in self.pretokens.findall(text) for k in self.word(p)]

    def split(self, text: str) -> list[tuple[str, bool]]:
        """(text, special) parts of a text, as the JVM expression gives them."""
        out: list[tuple[str, bool]] = []
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            out += [(piece, True)] if k % 2 else [(p, False) for p in self.pretokens.findall(piece)]
        return out

    def parts(self, found: Sequence[tuple[str, bool]]) -> list[int]:
        """ids of (text, special) parts in order."""
        out: list[int] = []
        for text, special in found:
            if special:
                out.append(self.special_ids[text])
            else:
                out += self.memo.get(text) or self.word(text)
        return out

    def text(self, text: str) -> list[int]:
        """ids of a text."""
        if self.cut is None or not any(s in text for s in self.specials):
            return self.plain(text)
        out: list[int] = []
        for k, piece in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special_ids[piece])
            elif piece:
                out += self.plain(piece)
        return out

    # --- Arrow columns of texts ---
    def _flat(self, texts: pa.Array) -> Iterator[np.ndarray | None]:
        for t in texts:
            yield np.frombuffer(array("i", self.text(t.as_py())), np.int32) if t.is_valid else None

    def arrow_ids(self, texts: pa.Array) -> pa.Array:
        values, ends, missing = array("i"), [0], []
        for t in texts.to_pylist():
            if t:
                values.extend(self.text(t))
            ends.append(len(values))
            missing.append(t is None)
        if ends[-1] >= 1 << 31:
            raise ValueError("a batch of texts has more ids than an array of lists holds: make Arrow batches smaller")
        flat = pa.array(np.frombuffer(values, np.int32) if values else np.zeros(0, np.int32))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(missing) if any(missing) else None)

    def arrow_packed(self, texts: pa.Array) -> pa.Array:
        return pa.array([None if r is None else packed_ids(r) for r in self._flat(texts)], pa.binary())

    def arrow_summary(self, texts: pa.Array) -> pa.Array:
        rows = [None if r is None else (len(r), int(r.min()) if len(r) else None, int(r.max()) if len(r) else None, int(r.sum(dtype=np.int64))) for r in self._flat(texts)]
        kinds = [("n", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("total", pa.int64())]
        return pa.array([None if r is None else dict(zip(("n", "low", "high", "total"), r, strict=True)) for r in rows], pa.struct(kinds))

    def packed(self, text: str) -> bytes:
        return packed_ids(np.array(self.text(text), np.int32))

    def write(self, chunks: Iterator[str], sink: Callable[[bytes], object], size: int = 1 << 20) -> int:
        """Hand the packed ids of a text that comes in chunks to ``sink``, ``size`` bytes or more at a time; their number."""
        from ..streaming.encode import flush

        held, n, rest = bytearray(), 0, ""
        for chunk in chunks:
            done, rest = flush(self, rest + chunk)
            held += packed_ids(np.array(done, np.int32))
            n += len(done)
            if len(held) >= size:
                sink(bytes(held))
                held.clear()
        last = self.text(rest)
        held += packed_ids(np.array(last, np.int32))
        if held:
            sink(bytes(held))
        return n + len(last)

    def iterate(self, chunks: Iterator[str]) -> Iterator[int]:
        """ids of a text that comes in chunks, in bounded memory."""
        from ..streaming.encode import flush

        rest = ""
        for chunk in chunks:
            done, rest = flush(self, rest + chunk)
            yield from done
        yield from self.text(rest)


def check_arguments(vocab_size: int, specials: Sequence[str]) -> None:
    if isinstance(vocab_size, bool) or not isinstance(vocab_size, int):
        raise TypeError("vocab_size is no whole number")
    if vocab_size < 1:
        raise ValueError("vocab_size is less than one")
    if isinstance(specials, str) or any(not isinstance(s, str) or not s for s in specials):
        raise ValueError("special tokens are a list of texts that are not empty")


def train_bpe(docs: DataFrame, vocab_size: int, specials: Sequence[str] = (), text: str = "text", max_local_bytes: int | None = None, timings: dict | None = None) -> BpeModel:
    """A model of at most ``vocab_size`` tokens (fewer if no pair is left); ``timings`` takes the seconds and sizes of the phases."""
    check_arguments(vocab_size, specials)
    timings = {} if timings is None else timings
    began = time.perf_counter()
    counted = pretoken_counts(docs, text, specials).persist()
    try:
        n, size, total = counted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pretoken")), F.lit(0)), F.coalesce(F.sum("cnt"), F.lit(0))).first()
        timings |= {"unique_pretokens": n, "total_pretokens": total, "count_seconds": time.perf_counter() - began}
        if size > (local_bytes(docs.sparkSession) if max_local_bytes is None else max_local_bytes):
            model = train_bpe_distributed(counted, vocab_size, specials, counted=True)
            timings["merge_seconds"] = time.perf_counter() - began - timings["count_seconds"]
            return model
        table = counted.select(F.col("pretoken").cast("binary").alias("w"), "cnt").toArrow()
    finally:
        counted.unpersist()
    lengths, data = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for words in table.column("w").chunks:
        own, each = flat_words(words)
        data.append(own)
        lengths.append(each)
    symbols = Symbols(np.concatenate(data), np.concatenate(lengths), table.column("cnt").to_numpy())
    timings["initial_pairs"] = len(symbols.counts)
    vocab = base_vocabulary(specials)
    found = merge_symbols(symbols, vocab_size - len(vocab), len(vocab))
    timings["final_pairs"] = sum(n > 0 for n in symbols.counts.values())
    timings["merge_seconds"] = time.perf_counter() - began - timings["count_seconds"]
    return _model(vocab, found, specials)


def _model(vocab: dict[int, bytes], found: list[tuple[bytes, bytes, int]], specials: Sequence[str]) -> BpeModel:
    for left, right, _ in found:
        vocab[len(vocab)] = left + right
    return BpeModel(vocab, [(a, b) for a, b, _ in found], list(specials), [n for *_, n in found])


def independent(ranked: list[tuple[int, str, str]], complete: bool) -> list[tuple[int, str, str]]:
    """The longest prefix of ranked pairs (n, l, r) that sequential rounds would take in this order.

    A pair is safe while no pair that shares a symbol with an accepted one occurs
    as often: a merge's new pairs occur no more often than the old pair they grew
    from.  A pair of equal symbols grows new pairs from itself (a run of four is
    two of its merges, side by side), so that nothing after it is safe.
    """
    taken, symbols = ranked[:1], set(ranked[0][1:]) if ranked else set()
    least = ranked[-1][0] if ranked else 0
    for n, left, right in ranked[1:]:
        if taken[-1][1] == taken[-1][2] or (n == least and not complete):
            break
        if any(m >= n and (x in symbols or y in symbols) for m, x, y in ranked if (m, x, y) not in taken):
            break
        taken.append((n, left, right))
        symbols |= {left, right}
    return taken


# --- blocks of words on the cluster ---


def word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about BLOCK_SYMBOLS symbols of batches of (word, count)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        data, lengths = flat_words(batch.column(0))
        held.append((np.insert(data.astype(np.int32), np.cumsum(lengths), -1), batch.column(1).to_numpy().astype(np.int64)))
        if sum(len(tokens) for tokens, _ in held) >= BLOCK_SYMBOLS:
            yield _block(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield _block(*map(np.concatenate, zip(*held, strict=True)))


def _block(tokens: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (tokens, weights)], ["tokens", "weights"])


def merged_tokens(tokens: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """Tokens with each (left, right) from left to right replaced by ``new``."""
    at = np.flatnonzero((tokens[:-1] == left) & (tokens[1:] == right))
    if not len(at):
        return tokens
    k = np.arange(len(at))
    if left == right:  # of a run of overlapping occurrences every second one
        start = np.concatenate(([True], at[1:] - at[:-1] != 1))
        at = at[(k - np.maximum.accumulate(np.where(start, k, 0))) % 2 == 0]
        k = k[: len(at)]
    out = np.delete(tokens, at + 1)
    out[at - k] = new
    return out


def apart(merges: Sequence[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The merges in stretches, each of which has no two whose occurrences can overlap or that build on each other."""
    out: list[list[tuple[int, int, int]]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    made: set[int] = set()
    for left, right, new in merges:
        if not out or left == right or lefts & rights or left in rights or right in lefts or left in made or right in made:
            out.append([])
            lefts, rights, made = set(), set(), set()
        out[-1].append((left, right, new))
        lefts.add(left)
        rights.add(right)
        made.add(new)
    return out


class Pairs:
    """Finds where one of some pairs (left, right) of symbols below ``size`` begins."""

    def __init__(self, left: np.ndarray, right: np.ndarray, size: int):
        self.size, keys = size, left.astype(np.int64) * size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.begins, self.follows = np.zeros((2, size + 1), bool)  # the last is that of -1
        self.begins[left] = self.follows[right] = True

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and which pair begins there."""
        at = np.flatnonzero(self.begins[tokens[:-1]] & self.follows[tokens[1:]])
        keys = tokens[at].astype(np.int64) * self.size + tokens[at + 1]
        which = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[which] == keys
        return at[hit], self.order[which[hit]]


def _blocks(batches: Iterator[pa.RecordBatch], merges: Sequence[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens after these merges (left, right, new), and weights."""
    size = max((max(m) for m in merges), default=0) + 1
    steps = []
    for part in apart(merges):
        left, right, new = np.array(part, np.int32).T
        steps.append((part[0], None, new) if len(part) == 1 else (None, Pairs(left, right, max(size, 256)), new))
    for batch in batches:
        for raw, weights in zip(batch.column(0), batch.column(1), strict=True):
            tokens = np.frombuffer(raw.as_buffer(), np.int32)
            for one, pairs, new in steps:
                if one is not None:
                    tokens = merged_tokens(tokens, *one)
                    continue
                at, which = pairs.find(tokens)
                if len(at):
                    tokens = np.delete(tokens, at + 1)
                    tokens[at - np.arange(len(at))] = new[which]
            yield tokens, np.frombuffer(weights.as_buffer(), np.int64)


def merged_blocks(batches: Iterator[pa.RecordBatch], merges: Sequence[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    for tokens, weights in _blocks(batches, merges):
        yield _block(tokens, weights)


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(sums[order], first) if len(first) else sums


def block_pairs(tokens: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (left * size + right) of the adjacent pairs of ``size`` symbols, and how often each occurs."""
    ends = tokens < 0
    at = np.flatnonzero(~(ends[:-1] | ends[1:]))
    keys = tokens[at].astype(np.int64) * size + tokens[at + 1]
    each = weights[np.cumsum(ends)[at]]
    if size > DENSE or each.sum(dtype=np.float64) >= 1 << 53:  # beyond that the table's doubles would round
        return _summed(keys, each)
    table = np.bincount(keys, each, size * size)
    found = np.flatnonzero(table)
    return found, table[found].astype(np.int64)


def _pair_totals(batches: Iterator[pa.RecordBatch], merges: Sequence[tuple[int, int, int]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (left * size + right) of pairs with how often they occur in a task's blocks after these merges; a pair may come again."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = [(keys, sums)]
    for tokens, weights in _blocks(batches, merges):
        held.append(block_pairs(tokens, weights, size))
        if sum(len(k) for k, _ in held) > HELD_SUMS:
            held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
            if len(held[0][0]) > HELD_SUMS // 2:
                yield held[0]
                held = [(keys, sums)]
    yield _summed(*map(np.concatenate, zip(*held, strict=True)))


def pair_sums(batches: Iterator[pa.RecordBatch], merges: Sequence[tuple[int, int, int]], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(l, r, n): pairs of names with how often they occur in a task's blocks after these merges; a pair may come again."""
    size, label = len(names), pa.array(names, pa.string())
    for keys, sums in _pair_totals(batches, merges, size):
        yield pa.RecordBatch.from_arrays([label.take(pa.array(keys // size)), label.take(pa.array(keys % size)), pa.array(sums)], ["l", "r", "n"])


def pair_totals(batches: Iterator[pa.RecordBatch], merges: Sequence[tuple[int, int, int]], size: int) -> Iterator[pa.RecordBatch]:
    """(pair, n): as ``pair_sums``, by left * size + right."""
    for keys, sums in _pair_totals(batches, merges, size):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])


def pair_runs(batches: Iterator[pa.RecordBatch], merges: Sequence[tuple[int, int, int]], size: int, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(run, n): the longest stretches of words whose adjacent symbols all are one of these pairs (left * size + right)."""
    wanted = Pairs(pairs // size, pairs % size, size)
    for tokens, weights in _blocks(batches, merges):
        at, _ = wanted.find(tokens)
        if not len(at):
            continue
        new = np.concatenate(([True], at[1:] - at[:-1] != 1))  # a run's first pair
        first = np.flatnonzero(new)
        inside = np.sort(np.concatenate((at, at[np.append(first[1:] - 1, len(at) - 1)] + 1)))
        bounds = np.append(first + np.arange(len(first)), len(inside)).astype(np.int32) * 4
        runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(tokens[inside])])
        each = weights[np.cumsum(tokens < 0)[at[first]]]
        yield from pa.table({"run": runs, "n": each}).group_by("run").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["run", "n"]).to_batches()


def train_bpe_distributed(docs: DataFrame, vocab_size: int, specials: Sequence[str] = (), text: str = "text", ranked: int = 256, cut_every: int = 8, counted: bool = False) -> BpeModel:
    """The same merges by rounds of jobs over blocks of distinct words, which stay on the cluster.

    A round counts the pairs of all blocks and gathers the distinct stretches of
    words that consist of pairs occurring more than ``floor`` times.  A pair of
    new symbols occurs no more often than the pair at whose place it stands, so
    that these stretches hold all pairs that can exceed the floor: the driver
    merges until none does.  ``ranked``, the pairs of the first round, grows and
    shrinks with the room that the stretches take.  ``counted``: ``docs`` is a
    table (pretoken, cnt).
    """
    from ..sources.shared import cut

    check_arguments(vocab_size, specials)
    vocab = base_vocabulary(specials)
    table = docs if counted else pretoken_counts(docs, text, specials)
    blocks = cut(table.select(F.col("pretoken").cast("binary").alias("w"), "cnt").mapInArrow(word_blocks, BLOCK))
    names = {b: bytes([b]) for b in range(256)}
    found: list[tuple[bytes, bytes, int]] = []
    merges: list[tuple[int, int, int]] = []  # those that the blocks don't have yet
    rounds, room = 0, local_bytes(docs.sparkSession)
    while (left := vocab_size - len(vocab) - len(found)) > 0:
        size = len(names)
        totals = blocks.mapInArrow(partial(pair_totals, merges=tuple(merges), size=size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = totals.orderBy(F.desc("n")).limit(ranked + 1).toArrow()
        if not len(top):
            break
        pairs, n = top.column("pair").to_numpy(), top.column("n").to_numpy()
        ask, symbols = ranked, None
        while symbols is None and ask:
            floor = int(n[ask]) if len(n) > ask else 0
            if not (n > floor).any():
                break
            runs = blocks.mapInArrow(partial(pair_runs, merges=tuple(merges), size=size, pairs=pairs[n > floor]), "run binary, n long").groupBy("run").agg(F.sum("n").alias("n")).persist()
            try:
                taken = runs.agg(F.sum(F.octet_length("run"))).first()[0] // 4
                if taken <= room:
                    symbols = _run_symbols(runs.toArrow())
                    ranked = max(1, min(MOST_RANKED, 2 * ask if 4 * taken < room else ask))
                else:
                    ask //= 4
            finally:
                runs.unpersist()
        keys: list[int] = []
        if symbols is None:  # too many pairs that occur as often as the first
            keys, new = _tied(blocks, merges, names, left)
            names |= {size + k: a + b for k, (a, b, _) in enumerate(new)}
        else:
            new = merge_symbols(symbols, left, size, names, floor, keys)
        merges += [(key >> 32, key & 0xFFFFFFFF, size + k) for k, key in enumerate(keys)]
        found += new
        rounds += 1
        if rounds % cut_every == 0 or len(merges) >= CUT_MERGES:
            blocks = cut(blocks.mapInArrow(partial(merged_blocks, merges=tuple(merges)), BLOCK))
            merges = []
    return _model(vocab, found, specials)


def _run_symbols(table: pa.Table) -> Symbols:
    data, lengths = zip(*(flat_words(c) for c in table.column("run").chunks), strict=True)
    return Symbols(np.concatenate(data).view(np.int32), np.concatenate(lengths) // 4, table.column("n").to_numpy())


def _tied(blocks: DataFrame, merges: Sequence[tuple[int, int, int]], names: dict[int, bytes], most: int, ranked: int = 256) -> tuple[list[int], list[tuple[bytes, bytes, int]]]:
    """Keys and merges of a round that takes the ``ranked`` first pairs in order and merges those that are safe."""
    labels = [names[k].hex() for k in range(len(names))]  # hex: in the order of the bytes
    ids = {name: k for k, name in enumerate(labels)}
    pairs = blocks.mapInArrow(partial(pair_sums, merges=tuple(merges), names=tuple(labels)), "l string, r string, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))
    top = [(r.n, r.l, r.r) for r in pairs.orderBy(F.desc("n"), F.desc("l"), F.desc("r")).limit(ranked + 1).collect()]
    taken = independent(top[:ranked], len(top) <= ranked)[:most]
    return [ids[a] << 32 | ids[b] for _, a, b in taken], [(bytes.fromhex(a), bytes.fromhex(b), n) for n, a, b in taken]
