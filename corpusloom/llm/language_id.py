"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (a parameter); each language
has a probability for every piece, fitted by expectation maximisation over all
segmentations of its words.  A word's probability is the sum over all of its
segmentations, by a forward pass; a text's score is the posterior of the product
over its words, under equal priors.

The fit uses at most SAMPLE_DOCS labelled documents of each language (those with
the smallest hash of the id), so that none is missed for its rarity, and all
their words; scoring reads every whole text.  Words are maximal runs of letters
in lower case, of any length: the sums of the forward pass are scaled as they
go.  Letters that no piece covers count as an unknown piece each.

Defined cases: a null text or one without a letter is ``und`` with score 0;
ties go to the language first in order; without any labelled row every text is
``und``; a very long word or text costs time in proportion to its length; rows
that repeat a sampled id all teach; repeated rows each get a row; an empty table
gives an empty result; other columns are ignored, lang is read from training
rows only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut

#: Labelled documents of each language that the fit takes, and rounds of expectation maximisation.
SAMPLE_DOCS, ROUNDS = 400, 4
MEMO = 150_000
#: Characters of texts whose new words are scored together.
BLOCK_CHARS = 2 << 20
#: Cells (places times words times languages) of a lattice, and places between two scalings.
CELLS, SCALE_EVERY = 1 << 22, 8
START = "▁"
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters (a leading mark shows a word's start), lower-cased, numbered from 1; 0 is the unknown letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k).lower() for k in range(model.get_piece_size())}
    found = {p for p in found if p.removeprefix(START).isalpha()}
    return {p: k + 1 for k, p in enumerate(sorted(found))}


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters and of anything beyond ASCII; ``letters`` cleans the latter."""
    return text.lower().encode().translate(_TABLE).split()


def letters(word: bytes) -> str:
    text = word.decode(errors="ignore")
    return text if text.isalpha() else "".join(filter(str.isalpha, text))


def marked(word: str) -> str:
    return START + word


class Trie:
    """The pieces as a trie in arrays, walked by many places of many words at once."""

    def __init__(self, pieces: dict[str, int]):
        self.letters = {c: k for k, c in enumerate(sorted(set("".join(pieces))), 1)}  # 0: a letter of no piece
        self.width = len(self.letters) + 1
        step: dict[int, int] = {}
        ends = {}
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                node = step.setdefault(node * self.width + self.letters[c], len(step) + 1)
            ends[node] = number
        self.keys = np.array(sorted(step), np.int64)
        self.next = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(step) + 1, -1, np.int32)
        for node, number in ends.items():
            self.piece[node] = number
        code = np.zeros(0x110000, np.int32)
        for c, k in self.letters.items():
            code[ord(c)] = k
        self.code = code

    def walk(self, words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Lengths, and for each piece length k from 1 the (start, word, piece) of every occurrence, by start."""
        size = np.array([len(w) for w in words])
        flat = self.code[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
        n, first = int(size.max(initial=0)), np.cumsum(size) - size
        places = np.arange(n)
        inside = places[:, None] < size
        at, word = np.nonzero(inside)  # by place, then by word
        position = first[word] + at
        node, out = np.zeros(len(at), np.int64), []
        start, left = at, size[word] - at
        while len(start) and len(self.keys):
            k = len(out)
            ok = left > k
            start, word, position, left, node = (x[ok] for x in (start, word, position, left, node))
            key = node * self.width + flat[position + k]
            found = np.searchsorted(self.keys, key)
            ok = self.keys[np.minimum(found, len(self.keys) - 1)] == key
            node = self.next[found[ok]]
            piece = self.piece[node]
            if k == 0:  # a lone letter or mark that is no piece is the unknown piece
                single = np.zeros(len(start), np.int32)
                single[ok] = np.maximum(piece, 0)
                out.append((start, word, single))
            else:
                is_piece = piece >= 0
                out.append((start[ok][is_piece], word[ok][is_piece], piece[is_piece]))
            start, word, position, left = (x[ok] for x in (start, word, position, left))
        if not out:
            out.append((start, word, np.zeros(len(start), np.int32)))
        return size, out


class Lattice:
    """All segmentations of a group of words: edges from place i to place i + k, by k and i."""

    def __init__(self, group: list[str], trie: Trie):
        self.size, edges = trie.walk(group)
        self.n = int(self.size.max(initial=0))
        self.edges = []
        for start, word, piece in edges:
            bounds = np.searchsorted(start, np.arange(self.n + 1))
            self.edges.append((bounds, word, piece))
        self.reach = len(self.edges)

    def ending(self, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, words, pieces) of the edges that end at place j."""
        for k in range(1, min(j, self.reach) + 1):
            bounds, word, piece = self.edges[k - 1]
            lo, hi = bounds[j - k], bounds[j - k + 1]
            if lo < hi:
                yield j - k, word[lo:hi], piece[lo:hi]

    def forward(self, p: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Log probability of each word (by column of p); with ``keep`` also the scaled sums of all places and their log scales.

        The sums of the last places are divided by their greatest every
        SCALE_EVERY places, so that words of any length neither underflow nor
        need to be cut; sums out of reach of a piece are let go.
        """
        shape = (len(self.size), p.shape[1])
        alpha: list = [np.ones(shape)]
        scale, scales = np.zeros(shape), [np.zeros(shape)]
        out = np.zeros(shape)
        for j in range(1, self.n + 1):
            now = np.zeros(shape)
            for i, word, piece in self.ending(j):
                now[word] += alpha[i][word] * p[piece]
            alpha.append(now)
            scales.append(scale)
            done = self.size == j
            if done.any():
                out[done] = np.log(now[done]) + scale[done]
            if j % SCALE_EVERY == 0:
                last = range(max(0, j - self.reach + 1), j + 1)
                top = np.max([alpha[i] for i in last], axis=0)
                top[top <= 0] = 1
                scale = scale + np.log(top)
                for i in last:
                    alpha[i], scales[i] = alpha[i] / top, scale
            if not keep and j >= self.reach:
                alpha[j - self.reach] = scales[j - self.reach] = None
        return out, alpha, scales

    def backward(self, p: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Scaled sums from each place to the word's end, and their log scales."""
        shape = (len(self.size), p.shape[1])
        beta = [np.zeros(shape) for _ in range(self.n + 1)]
        scales = [np.zeros(shape) for _ in range(self.n + 1)]
        scale = np.zeros(shape)
        for i in range(self.n, -1, -1):
            ends = self.size == i
            beta[i][ends] = 1
            for k in range(1, min(self.n - i, self.reach) + 1):
                bounds, word, piece = self.edges[k - 1]
                lo, hi = bounds[i], bounds[i + 1]
                if lo < hi:
                    beta[i][word[lo:hi]] += beta[i + k][word[lo:hi]] * p[piece[lo:hi]]
            scales[i] = scale
            if i % SCALE_EVERY == 0:
                first = range(i, min(self.n, i + self.reach - 1) + 1)
                top = np.max([beta[j] for j in first], axis=0)
                top[top <= 0] = 1
                scale = scale + np.log(top)
                for j in first:
                    beta[j], scales[j] = beta[j] / top, scale
        return beta, scales

    def expected(self, p: np.ndarray, often: np.ndarray, size: int) -> np.ndarray:
        """How often each piece is used over all segmentations of the words, which occur ``often``; p has one column."""
        total, alpha, up = self.forward(p, True)
        beta, down = self.backward(p)
        out = np.zeros(size)
        for j in range(1, self.n + 1):
            for i, word, piece in self.ending(j):
                weight = np.exp(up[i][word, 0] + down[j][word, 0] - total[word, 0])
                out += np.bincount(piece, alpha[i][word, 0] * p[piece, 0] * beta[j][word, 0] * weight * often[word], size)
        return out


def groups(found: list[str], languages: int = 1) -> Iterator[list[int]]:
    """Numbers of words of like lengths, so many that a lattice has about CELLS cells."""
    order = sorted(range(len(found)), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        end = at + 1
        longest = len(found[order[at]])
        while end < len(order) and len(found[order[end]]) <= longest + max(1, longest // 4) and (len(found[order[end]]) + 1) * (end + 1 - at) * languages <= CELLS:
            end += 1
        yield order[at:end]
        at = end


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    p: np.ndarray  # pieces (0: unknown) by languages

    def __post_init__(self):
        self.trie = Trie(self.pieces)

    def log_probabilities(self, found: list[str]) -> np.ndarray:
        """Of each word (with the mark), by language: the log of the sum over all its segmentations."""
        out = np.zeros((len(found), len(self.languages)))
        for at in groups(found, max(1, len(self.languages))):
            out[at] = Lattice([found[k] for k in at], self.trie).forward(self.p)[0]
        return out


def fit(counts: dict[str, dict[str, int]], pieces: dict[str, int]) -> Model:
    """counts: words (with the mark) and how often each occurs, by language."""
    languages = sorted(counts)
    size = len(pieces) + 1
    model = Model(languages, pieces, np.zeros((size, len(languages))))
    for c, language in enumerate(languages):
        found = list(counts[language])
        often = np.array([counts[language][w] for w in found], float)
        lattices = [(Lattice([found[k] for k in at], model.trie), often[at]) for at in groups(found)]
        # All pieces are alike at first; the rounds tell which are used.
        q = np.full((size, 1), 1.0 / size)
        for _ in range(ROUNDS):
            expected = np.full(size, 0.01)
            for lattice, n in lattices:
                expected += lattice.expected(q, n, size)
            q[:, 0] = expected / expected.sum()
        model.p[:, c] = q[:, 0]
    return model


def train(docs: DataFrame, vocabulary_path: str | None = None, sample: int = SAMPLE_DOCS) -> Model:
    """Fit on the training folds of ``docs`` (doc_id, text, lang): of each language the ``sample`` documents with the least hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("lang is not null and text is not null and doc_id is not null").filter(crc_mod("doc_id", 5) != 0)
    # Each task sends at most ``sample`` rows of a language to the window.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    few = cut(rows.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id").withColumn("nth", nth).filter(F.col("nth") <= sample).select("lang", "doc_id").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.setdefault(lang, Counter()).update(words(text.as_py()))
            out = [(lang, marked(clean), n) for lang, c in seen.items() for w, n in c.items() if (clean := letters(w))]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "word", "n"])

    counted = rows.join(F.broadcast(few), ["lang", "doc_id"], "left_semi").select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    counts: dict[str, dict[str, int]] = {}
    table = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()  # words of the sample
    for lang, word, n in sorted(zip(table["lang"], table["word"], table["n"].tolist(), strict=True)):
        counts.setdefault(lang, {})[word] = n
    return fit(counts, vocabulary(vocabulary_path or default_vocabulary()))


class Scorer:
    """Log probabilities of texts; new words of many texts share one forward pass and are memoised."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.table = np.zeros((2 * MEMO, len(model.languages)))
        self.used = 1  # row 0: no letter

    def block(self, texts: list[str]) -> list[np.ndarray | None]:
        found = [words(t) for t in texts]
        new = {w for ws in found for w in ws if w not in self.memo}
        if self.used + len(new) > len(self.table):
            self.memo, self.used = {}, 1
            new = set().union(*found)
            if len(new) >= len(self.table):
                self.table = np.zeros((len(new) + 1, self.table.shape[1]))
        if new:
            clean = [(w, letters(w)) for w in new]
            keep = [(w, x) for w, x in clean if x]
            end = self.used + len(keep)
            self.table[self.used : end] = self.model.log_probabilities([marked(x) for _, x in keep])
            self.memo.update((w, 0) for w, x in clean if not x)
            self.memo.update((w, k) for k, (w, _) in enumerate(keep, self.used))
            self.used = end
        out: list[np.ndarray | None] = []
        for ws in found:
            at = np.fromiter(map(self.memo.__getitem__, ws), np.int64, len(ws))
            out.append(self.table[at].sum(0) if at.any() else None)
        return out

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        held, room = [], BLOCK_CHARS
        for t in texts:
            held.append(t)
            room -= len(t)
            if room <= 0:
                yield from self.block(held)
                held, room = [], BLOCK_CHARS
        yield from self.block(held)


def identify(docs: DataFrame, model: Model | None = None, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row for each row of ``docs``."""
    if model is None:
        model = train(docs, vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            langs, scores = [], []
            for logs in scorer([t or "" for t in batch.column(1).to_pylist()]):
                if logs is None or not len(logs):
                    langs.append("und")
                    scores.append(0.0)
                else:
                    k = int(logs.argmax())
                    langs.append(scorer.model.languages[k])
                    scores.append(float(1 / np.exp(logs - logs[k]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
