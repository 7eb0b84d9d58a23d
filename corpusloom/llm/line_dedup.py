"""Line deduplication by pairwise alignment.

A *window* is a run of consecutive lines that has MIN_BLOCK_WORDS words and
would not without its last (or its first) line.  Whatever run of that many words
two documents share, each of its lines lies in a window that both hold.  Each
window's *first holder* (the smallest doc_id with it) stands for all its
holders, so that a window makes one pair for each later holder, frequent ones
no more than rare ones, and no window needs a cap.

Each pair is aligned by patience diff over the documents' lists of line
hashes: lines that occur once in both and keep their order are anchors, the
gaps between anchors are aligned the same way, and where no line is unique the
n-th occurrences stand for each other.  Runs of aligned lines with at least
MIN_BLOCK_WORDS words are deleted from the later document, and so are runs that
both documents have in another order.  Together the pairs delete exactly the
runs of so many words that any earlier document has, as if all documents were
compared.  The first holder of a line never loses it to a later one, so one copy
of every line stays.

Words are divided by white space; in scripts that write none between them, a
stretch of letters counts by its length (one word for each LETTERS_A_WORD, the
rest rounded up), so that their passages are found as others are.

Candidates meet by a 64-bit hash; alignment compares 128 bits.

Defined cases: a null text stays null; empty texts have nothing to delete; rows
that share a doc_id follow each other in the order of their texts' hashes, rows
without one come last, and each is compared with all before it, so that of
repeated rows the first stays whole; a very long text costs what it shares with
others; an empty table gives an empty result; other columns are kept, whatever
their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fresh, keyed, partitions, skew_safe_lookup, trimmed

MIN_BLOCK_WORDS = 8
#: Scripts without spaces, and how many of their characters (marks included) count as a word.
LETTERS_A_WORD = {
    # Chinese, Japanese, Yi
    "\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48f\uf900-\ufaff\uff66-\uff9f\U00016fe0-\U00018dff\U0001aff0-\U0001b2ff\U00020000-\U0003ffff": 2,
    # Thai, Lao, Tibetan, Burmese, Khmer, Tai scripts, Balinese, Javanese
    "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aad\u1b00-\u1b7f\ua980-\ua9ff\uaa60-\uaadf": 4,
}
_UNSPACED = re.compile("|".join(f"([{x}]+)" for x in LETTERS_A_WORD))
_A_WORD = list(LETTERS_A_WORD.values())
#: White space beyond ASCII; inside a line it divides words.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
#: Partners of one document that meet in a task with one copy of its lines, and places one copy of a document's lines is read for.
FAN, PLACES = 64, 1024
#: Bytes of removal lists that may be broadcast.
BROADCAST_BYTES = 32 << 20


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs sorted by the first, that grows in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[at], ends[at] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _anchors(a: Sequence, b: Sequence, lo: tuple[int, int], hi: tuple[int, int]) -> list[tuple[int, int]]:
    one, two = Counter(a[lo[0] : hi[0]]), Counter(b[lo[1] : hi[1]])
    unique = {x for x, n in one.items() if n == 1 and two.get(x) == 1}
    if unique:
        at = {b[j]: j for j in range(lo[1], hi[1]) if b[j] in unique}
        return _increasing([(i, at[a[i]]) for i in range(lo[0], hi[0]) if a[i] in unique])
    if not one.keys() & two.keys():
        return []
    nth: Counter = Counter()
    at = {}
    for j in range(lo[1], hi[1]):
        at[b[j], nth[b[j]]] = j
        nth[b[j]] += 1
    nth.clear()
    pairs = []
    for i in range(lo[0], hi[0]):
        if (j := at.get((a[i], nth[a[i]]))) is not None:
            pairs.append((i, j))
        nth[a[i]] += 1
    return _increasing(pairs)


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, in order."""
    out: list[tuple[int, int]] = []
    todo = [((0, 0), (len(a), len(b)))]
    while todo:
        (i, j), (m, n) = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        anchors = _anchors(a, b, (i, j), (m, n))
        out += anchors
        edges = [(i - 1, j - 1), *anchors, (m, n)]
        if anchors:
            todo += [((x + 1, y + 1), nxt) for (x, y), nxt in zip(edges, edges[1:], strict=False) if x + 1 < nxt[0] and y + 1 < nxt[1]]
    return sorted(out)


def count_words(line: bytes) -> int:
    """Words of a line; one at least if the line is not empty."""
    plain = len(line.split())
    if line.isascii():
        return plain
    text = _WIDE_SPACE.sub(" ", line.decode(errors="replace"))
    if not _UNSPACED.search(text):
        return max(plain, len(text.split()))
    letters = sum(-(-len(m[0]) // _A_WORD[m.lastindex - 1]) for m in _UNSPACED.finditer(text))
    others = sum(any(map(str.isalnum, x)) for x in _UNSPACED.sub(" ", text).split())
    return max(plain, letters + others)


def windows(words: Sequence[int], core: Callable[[int, int], object], least: int = MIN_BLOCK_WORDS) -> Iterator[tuple[object, int, int]]:
    """(key, first, last) of the shortest runs of at least so many words from each line on and up to each line.

    ``core`` names the lines from one with words to another; lines without words
    before or after those only count, so that long empty stretches cost no more.
    """
    full = [k for k, n in enumerate(words) if n]
    room = -least
    b = 0
    ends = {}
    for a, first in enumerate(full):
        while b < len(full) and room < 0:
            room += words[full[b]]
            b += 1
        if room < 0:
            break
        last = full[b - 1]
        name = ends[first, last] = core(first, last)
        yield (name, 0, 0), first, last
        for lead in range(1, first - (full[a - 1] if a else -1)):
            yield (name, lead, 0), first - lead, last
        room -= words[first]
    a, room = 0, -least
    for b, last in enumerate(full):
        room += words[last]
        while room >= words[full[a]]:
            room -= words[full[a]]
            a += 1
        if room < 0:
            continue
        first = full[a]
        if (first, last) in ends:
            name = ends[first, last]
        else:
            name = core(first, last)
            yield (name, 0, 0), first, last
        for trail in range(1, (full[b + 1] if b + 1 < len(full) else len(words)) - last):
            yield (name, 0, trail), first, last + trail


class Lines:
    """A document's lines, where each stands, and its windows."""

    def __init__(self, lines: Sequence, words: Sequence[int], least: int = MIN_BLOCK_WORDS):
        self.lines, self.words, self.least = lines, words, least
        self.at: dict = {}
        for k, x in enumerate(lines):
            self.at.setdefault(x, []).append(k)
        self.windows: dict[tuple, list[tuple[int, int]]] = {}
        for key, first, last in windows(words, lambda i, j: tuple(lines[i : j + 1]), least):
            self.windows.setdefault(key, []).append((first, last))


def common_blocks(earlier: Lines, later: Lines) -> list[int]:
    """Lines of ``later`` in runs of at least so many words that ``earlier`` has too.

    Only lines that both have are aligned, so that a pair costs no more than the
    shorter document and what it shares.
    """
    shared = earlier.at.keys() & later.at.keys()
    one, two = (sorted(k for x in shared for k in doc.at[x]) for doc in (earlier, later))
    gone: set[int] = set()
    run: list[int] = []
    at = None
    pairs = patience([earlier.lines[k] for k in one], [later.lines[k] for k in two])
    for i, j in [*((one[x], two[y]) for x, y in pairs), (-2, -2)]:
        if at != (i - 1, j - 1):
            if sum(later.words[x] for x in run) >= later.least:
                gone.update(run)
            run = []
        if j >= 0:
            run.append(j)
        at = (i, j)
    for key in earlier.windows.keys() & later.windows.keys():  # runs in another order
        for first, last in later.windows[key]:
            gone.update(range(first, last + 1))
    return sorted(gone)


def _keys(digests: bytes, words: Sequence[int]) -> np.ndarray:
    """A number for each distinct window of a document, from the 16-byte hashes of its lines."""

    def core(first: int, last: int) -> int:
        return xxhash.xxh3_64_intdigest(digests[16 * first : 16 * last + 16])

    found = {name if not lead + trail else xxhash.xxh3_64_intdigest(b"%d %d %d" % (name, lead, trail)) for (name, lead, trail), _, _ in windows(words, core)}
    return np.fromiter(found, np.uint64, len(found)).view(np.int64)


def line_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, h, g, w, k): two hashes and the number of words of every line, and the keys of the windows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                lines = [x.strip() for x in text.as_py().split(b"\n")]
                digests = b"".join(map(xxhash.xxh3_128_digest, lines))
                hashes.append(np.frombuffer(digests, np.int64).reshape(-1, 2))
                words.append([count_words(x) for x in lines])
                keys.append(_keys(digests, words[-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[:, 0] for x in hashes], pa.list_(pa.int64())),
                    pa.array([x[:, 1] for x in hashes], pa.list_(pa.int64())),
                    pa.array(words, pa.list_(pa.int32())),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "h", "g", "w", "k"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, h array<bigint>, g array<bigint>, w array<int>, k array<bigint>"
    return rows.filter("doc_id is not null and text is not null").mapInArrow(trimmed(split), schema)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, gone) of pairs, from rows (a, sub, b, h, g, w) sorted by (a, sub, b); null b: the lines of ``a`` itself."""
    key, own = None, None
    for batch in batches:
        ids, gone = [], []
        for k in range(batch.num_rows):
            a, sub, b, h, g, w = (batch.column(c)[k].as_py() for c in range(6))
            doc = Lines(list(zip(h, g, strict=True)), w)
            if b is None:
                key, own = (a, sub), doc
                continue
            if (a, sub) != key:
                raise RuntimeError("a document's lines do not lead its partners")
            if lines := common_blocks(own, doc) if a < b else common_blocks(doc, own):
                ids.append(max(a, b))
                gone.append(lines)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "gone"])


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, gone): the lines (from 0) to delete from each document that has some; ids are unique.

    Of each pair the document with fewer lines moves to the other, whose lines
    are there once for every FAN partners: neither a holder of what everyone has
    nor a long document gathers its partners in one task.
    """
    lists = cut(line_lists(docs))
    held = lists.select("doc_id", F.size("h").alias("n"), F.explode("k").alias("k"))
    first = held.groupBy("k").agg(F.min("doc_id").alias("owner"), F.min_by("n", "doc_id").alias("m"), F.count("*").alias("df")).filter("df > 1")
    pairs = skew_safe_lookup(held, first, "k", "df").filter("owner < doc_id")
    most = F.col("m") >= F.col("n")
    pairs = cut(pairs.select(F.when(most, F.col("owner")).otherwise(F.col("doc_id")).alias("a"), F.when(most, F.col("doc_id")).otherwise(F.col("owner")).alias("b")).distinct())
    fan = pairs.groupBy("a").agg(F.count("*").alias("n_pairs"), F.ceil(F.count("*") / FAN).alias("s"))
    placed = skew_safe_lookup(pairs, fan, "a", "n_pairs").select("a", F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("sub"), "b", F.col("b").alias("doc_id"))
    own = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("s").cast("int") - 1)).alias("sub"), F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
    places = placed.unionByName(own)
    many = places.groupBy("doc_id").agg(F.count("*").alias("n_places"))
    part = F.pmod(F.xxhash64("a", "sub", "b"), F.ceil(F.col("n_places") / PLACES))
    places = skew_safe_lookup(places, many, "doc_id", "n_places").groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct("a", "sub", "b")).alias("places"))
    rows = lists.drop("k").join(places, "doc_id").select(F.explode("places").alias("p"), "h", "g", "w").select("p.a", "p.sub", "p.b", "h", "g", "w")
    rows = rows.repartition(partitions(rows.sparkSession), "a", "sub").sortWithinPartitions("a", "sub", F.asc_nulls_first("b"))
    gone = rows.mapInArrow(trimmed(_align), "doc_id bigint, gone array<int>")
    return gone.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the deduplicated ``text``, and n_lines and n_removed (null text: 0)."""
    key, mark, gone = fresh(docs, "key", "mark", "gone")
    rows = keyed(docs, key)
    found = cut(removals(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(mark), F.col("gone").alias(gone)))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(4 * F.size(gone) + 16), F.lit(0))).first()
    near = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    out = rows.join(F.broadcast(found) if near else found, F.col(key) == F.col(mark), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("int")
    plain = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return out.select(*plain, text.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_removed"))


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, str | None]:
    """The same by strings, every run of every document against all earlier documents; for small tests."""
    split = {i: [x.strip(" \t\n\r\v\f") for x in t.split("\n")] for i, t in docs if t is not None}
    out: dict[int, str | None] = {}
    for i, t in docs:
        if t is None:
            out[i] = None
            continue
        gone: set[int] = set()
        mine = split[i]
        for theirs in (split[j] for j in split if j < i):
            for a in range(len(mine)):
                for b in range(len(theirs)):
                    n = 0
                    while a + n < len(mine) and b + n < len(theirs) and mine[a + n] == theirs[b + n]:
                        n += 1
                    if sum(count_words(x.encode()) for x in mine[a : a + n]) >= MIN_BLOCK_WORDS:
                        gone |= set(range(a, a + n))
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out
