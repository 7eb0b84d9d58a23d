"""Best-fit packing by a configuration linear program.

Documents are tokenised once (the ids never leave their task; a piece keeps
its length and checksum).  The histogram of piece lengths has at most CAPACITY
bars whatever the corpus, and is all the driver sees.  Over it the covering
program "least number of sequences whose configurations hold every length as
often as it occurs" is solved by multiplicative weights: lengths that are
covered less weigh more, and a knapsack dynamic programme finds, under these
weights, the best configuration around each length.  The fractional solution
is rounded down, and what is left is packed best-fit decreasing.

Places are given out without a shuffle by length: a piece's rank among those
of its length is its number within its task plus the count in earlier tasks,
and each run of ranks maps to a run of sequences.

Defined cases: a null text counts as empty (one piece, the end id alone);
repeated rows are packed each; an empty table gives an empty result; a text
over CAPACITY ids is cut, its first piece may be shorter; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import byte_alphabet
from ..functions.text import PATTERN
from .common import cut, sized_join, trim

CAPACITY = 1024
END_ID = 2
#: Characters encoded in one go.
STRETCH = 1 << 17
#: Rounds of multiplicative weights and their learning rate.
ROUNDS, RATE = 200, 0.3

Config = tuple[int, ...]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def regular_ranks(path: str, tok) -> dict[bytes, int] | None:
    """Token bytes to ids, if plain byte-level merging by id gives the tokenizer's ids for every text; else None.

    That is so if every merge makes a token of its own, in the order of ids, and
    the model merges each token's own bytes to that one token: a merger that
    joins whatever two parts make the token of least id then never joins others
    than the model does.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in odd) and not data.get("normalizer")
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    byte_of = {c: b for b, c in byte_alphabet().items()}
    vocab = model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocab.get(m, -1) for m in merged]
    if not all(c in vocab for c in byte_of) or len(vocab) != 256 + len(merged) or any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
        return None
    if min(ids, default=256) <= max(vocab[c] for c in byte_of) or any([t.id for t in tok.model.tokenize(k)] != [v] for k, v in vocab.items()):
        return None
    return {bytes(map(byte_of.__getitem__, k)): v for k, v in vocab.items()}


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    A vocabulary whose ids follow from its ranks alone is merged by tiktoken,
    which equals the tokenizer then and makes plain lists of ids.  All other
    vocabularies, texts that hold a special token's string, and stretches of
    more than STRETCH characters that cannot be parted go to the tokenizer.
    Longer texts are parted at spaces that a non-space follows: the
    pre-tokeniser always starts a new piece there.
    """

    _cut = re.compile(r" (?=\S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        if (ranks := regular_ranks(path, self.tok)) is not None:
            import tiktoken

            self.fast = tiktoken.Encoding(name=os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def stretches(self, text: str) -> Iterator[str]:
        """Consecutive parts of a text, of at most STRETCH characters where it can be parted so."""
        start = 0
        while len(text) - start > STRETCH:
            at = text.rfind(" ", start + 1, start + STRETCH + 1)
            while at > start and (at + 1 == len(text) or text[at + 1].isspace()):
                at = text.rfind(" ", start + 1, at)
            if at <= start:
                found = self._cut.search(text, start + 1)
                at = found.start() if found else len(text)
            yield text[start:at]
            start = at
        yield text[start:]

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if len(text) <= STRETCH:
            return array("I", self.fast(text)).tobytes()
        parts = (self.fast(x) if len(x) <= STRETCH else self.tok.encode(x, add_special_tokens=False).ids for x in self.stretches(text))
        return b"".join(array("I", x).tobytes() for x in parts)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary, however many tasks the process runs."""
    return Encoder(path)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document with their task and their number there among those of their length."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encode, part = encoder_of(tokenizer or default_tokenizer()), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, stop = 0, n % capacity or min(n, capacity)
                piece = 0
                while start < n:
                    length = stop - start
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), part, seen[length]))
                    seen[length] += 1
                    piece, start, stop = piece + 1, stop, stop + capacity
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut_up, PIECES)


def price(weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the best value of each capacity, and a length that attains it (0: none)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(weight > 0)
    values = weight[lengths]
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        if n:
            total = best[room - lengths[:n]] + values[:n]
            k = int(total.argmax())
            best[room], choice[room] = total[k], lengths[k]
    return best, choice


def fill(choice: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0 and choice[room]:
        out.append(int(choice[room]))
        room -= out[-1]
    return out


def solve(need: np.ndarray, capacity: int) -> tuple[dict[Config, float], float]:
    """A fractional cover (configuration: amount) and a lower bound on the program's value.

    Round t raises the cover of every length to t/ROUNDS, each by the best
    configuration around it.  A length that other configurations' filling has
    covered beyond that loses weight exponentially, so that the next pricing
    avoids it.
    """
    lengths, size = np.flatnonzero(need), np.arange(capacity + 1) / capacity
    amount: Counter[Config] = Counter()
    cover, bound = np.zeros(capacity + 1), float((need * size).sum())
    for t in range(1, ROUNDS + 1):
        ahead = (cover * ROUNDS - (t - 1)) / np.sqrt(t)
        weight = np.where(need > 0, size * np.exp(np.clip(-RATE * ahead, -20, 3)), 0)
        best, choice = price(weight, capacity)
        bound = max(bound, float((weight * need).sum() / best[capacity]))
        for length in lengths[::-1].tolist():
            lack = (t / ROUNDS - cover[length]) * need[length]
            if lack > 1e-9:
                config = tuple(sorted([length, *fill(choice, capacity - length)], reverse=True))
                counts = Counter(config)
                step = lack / counts[length]
                amount[config] += step
                for x, k in counts.items():
                    cover[x] += step * k / need[x]
    return dict(amount), bound


def rounded(need: np.ndarray, amount: dict[Config, float], capacity: int) -> list[tuple[Config, int]]:
    """Whole configurations with their multiplicities that hold each length exactly as often as needed."""
    left, out = need.astype(np.int64).copy(), Counter()
    for config, a in sorted(amount.items(), key=lambda x: (-x[1], x[0])):
        counts = Counter(config)
        m = min(int(a), *(int(left[x]) // k for x, k in counts.items()))
        if m > 0:
            out[config] += m
            for x, k in counts.items():
                left[x] -= m * k
    # What rounding down left: best fit decreasing, equal bins at once.
    bins: dict[int, list[tuple[Config, int]]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        k = int(left[length])
        while k:
            room = min((r for r, b in bins.items() if r >= length and b), default=None)
            if room is None:
                each = min(capacity // length, k)
                m = k // each
                bins.setdefault(capacity - length * each, []).append(((length,) * each, m))
                k -= m * each
                continue
            config, m = bins[room].pop()
            used = min(m, k)
            if m > used:
                bins[room].append((config, m - used))
            bins.setdefault(room - length, []).append(((*config, length), used))
            k -= used
    for group in bins.values():
        for config, m in group:
            out[config] += m
    return sorted(out.items())


class Places:
    """Runs of ranks of each length: where they start, and the first sequence and the offset of the run."""

    def __init__(self, packed: list[tuple[Config, int]], capacity: int):
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        given, sequence = [0] * (capacity + 1), 0
        for config, m in packed:
            offset = 0
            for length in config:
                runs[length].append((given[length], sequence, offset))
                given[length] += m
                offset += length
            sequence += m
        self.sequences = sequence
        self.runs = [np.array(r, np.int64).reshape(-1, 3) for r in runs]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            at, runs = np.flatnonzero(length == x), self.runs[x]
            r = np.searchsorted(runs[:, 0], rank[at], "right") - 1
            sequence[at], offset[at] = runs[r, 1] + rank[at] - runs[r, 0], runs[r, 2]
        return sequence, offset


def plan(need: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[Config, int]], int]:
    """Configurations with their multiplicities that hold ``need[x]`` pieces of each length x, and a lower bound on their number."""
    whole, rest = need.copy(), need.copy()
    whole[:capacity] = 0
    rest[capacity] = 0
    packed, bound = [((capacity,), int(whole[capacity]))] if whole[capacity] else [], int(whole[capacity])
    if rest.any():
        amount, least = solve(rest, capacity)
        packed += rounded(rest, amount, capacity)
        bound += int(np.ceil(least - 1e-6))
    return packed, bound


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    made = cut(pieces(docs, tokenizer, capacity, end_id))
    counts = cut(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    need = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        need[row.length] = row.n
    packed, _ = plan(need, capacity)
    places = spark.sparkContext.broadcast(Places(packed, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = sized_join(made, bases, ["part", "length"], "left", counts.count())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value(b.column("length").to_numpy(), b.column("rank").to_numpy())
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")).mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
