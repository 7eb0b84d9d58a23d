"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document, as search engines shard theirs: a
*segment* holds the postings (term, position) of about a megabyte of whole
documents, written once to the shared checkpoint folder.  Terms no test item
uses can take part in no match, so only test terms get postings.  A query is
answered inside each segment: the terms of a window are ordered from the
rarest there, the rarest term's positions, less its offset in the window, are
the first candidate starts, and each further term's offset-adjusted list is
intersected with them.  No posting crosses the network, a term that every
document holds costs no more than its own list, and recovery of a lost
executor re-reads a segment.

Windows are broadcast in blocks of at most BLOCK_BYTES of test text; a larger
benchmark takes several passes over the stored index, whose results are merged
per document.

Defined cases: null or wordless texts have no words and match nothing; an item
of fewer words than a window is one window; items with the same words all
count; items without an id mark words but are not counted; an empty benchmark
hits nothing; a very long text is a segment of its own; repeated rows each get a
row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, trimmed

WINDOW = 10
SEGMENT_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
#: Candidate starts of a segment that are looked at together (a window with more is looked at alone).
SLICE = 1 << 20
#: Bytes of words to themselves, A-Z to a-z, all else of ASCII to a space; bytes from 0x80 on are parts of words.
_TABLE = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text in lower case (A-Z only)."""
    return text.translate(_TABLE).split()


class Windows:
    """The distinct windows of a block of test items, as arrays of term numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = WINDOW):
        self.size, self.terms = size, {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for k in range(max(1, len(ids) - size + 1) if ids else 0):
                owners = rows.setdefault(tuple(ids[k : k + size]), set())
                if item_id is not None:
                    owners.add(item_id)
        self.length = np.array([len(r) for r in rows], np.int32)
        self.grid = np.full((len(rows), size), -1, np.int32)
        for k, r in enumerate(rows):
            self.grid[k, : len(r)] = r
        self.items = [sorted(x) for x in rows.values()]


def _segments(batches: Iterator[pa.RecordBatch], terms: frozenset[bytes] | None) -> Iterator[list]:
    """Lists of (key, words) of whole documents, cut after SEGMENT_BYTES of text."""
    held, room = [], SEGMENT_BYTES
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            held.append((key.as_py(), words(text)))
            room -= len(text)
            if room <= 0:
                yield held
                held, room = [], SEGMENT_BYTES
    if held:
        yield held


INDEX_SCHEMA = "doc_ids array<bigint>, starts binary, terms array<binary>, bounds binary, positions binary"


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Segments of the positional index of ``docs`` (doc_id, text).

    Each row: the documents in order, where each starts in the segment's run
    of words (int64), the terms in byte order, the bounds (int64) of each
    term's list and the lists themselves (int32 positions).  ``terms``: a
    one-row frame with the array of the only terms to index (all if None).
    """
    only = None
    if terms is not None:
        only = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(t) for t in terms.first()[0] or ()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = only.value if only is not None else None
        for held in _segments(batches, wanted):
            starts = np.zeros(len(held) + 1, np.int64)
            np.cumsum([len(w) for _, w in held], out=starts[1:])
            number: dict[bytes, int] = {}
            if wanted is None:
                runs = [[number.setdefault(w, len(number)) for w in ws] for _, ws in held]
            else:
                number = {t: k for k, t in enumerate(sorted(wanted))}
                runs = [[number.get(w, -1) for w in ws] for _, ws in held]
            flat = np.concatenate([np.array(r, np.int32) for r in runs])
            at = np.flatnonzero(flat >= 0).astype(np.int32)
            names = np.array(list(number), object)
            rank = np.empty(len(number) + 1, np.int64)
            order = sorted(range(len(number)), key=names.__getitem__)
            rank[order] = np.arange(len(order))
            keys = rank[flat[at]]
            by = np.argsort(keys, kind="stable")
            counts = np.bincount(keys, minlength=len(order))
            used = np.flatnonzero(counts)
            bounds = np.concatenate(([0], np.cumsum(counts[used]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([[k for k, _ in held]], pa.list_(pa.int64())),
                    pa.array([starts.tobytes()], pa.binary()),
                    pa.array([[names[order[u]] for u in used]], pa.list_(pa.binary())),
                    pa.array([bounds.tobytes()], pa.binary()),
                    pa.array([at[by].astype(np.int32).tobytes()], pa.binary()),
                ],
                ["doc_ids", "starts", "terms", "bounds", "positions"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(trimmed(index), INDEX_SCHEMA))


class Segment:
    """A stored segment, opened for a block of windows."""

    def __init__(self, row: dict, windows: Windows):
        self.doc_ids = row["doc_ids"]
        self.starts = np.frombuffer(row["starts"], np.int64)
        bounds, positions = np.frombuffer(row["bounds"], np.int64), np.frombuffer(row["positions"], np.int32)
        self.n = int(self.starts[-1])
        own = np.array([windows.terms.get(bytes(t), -1) for t in row["terms"]], np.int64)
        counts = np.diff(bounds)
        self.counts = np.zeros(len(windows.terms) + 1, np.int64)
        self.first = np.zeros(len(windows.terms) + 1, np.int64)
        self.counts[own[own >= 0]] = counts[own >= 0]
        self.first[own[own >= 0]] = bounds[:-1][own >= 0]
        self.positions = positions.astype(np.int64)
        # Each list in one sorted run of (list, position) keys, for intersection by binary search.
        self.keys = np.repeat(np.arange(len(counts)), counts) * (self.n + 1) + self.positions
        self.slot = np.full(len(windows.terms) + 1, -1, np.int64)
        self.slot[own[own >= 0]] = np.flatnonzero(own >= 0)

    def near(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Does each term occur from the low to the high position?"""
        base = self.slot[term] * (self.n + 1)
        at = np.searchsorted(self.keys, base + low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= base + high)

    def matches(self, windows: Windows, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window numbers and start positions, in slices of about SLICE candidates.

        With slop, a start (whose window's length fits into its document) matches
        if each word occurs in that document within slop of its place.
        """
        grid = windows.grid
        if not len(grid) or not len(self.keys):
            return
        often = np.where(grid >= 0, self.counts[grid], np.iinfo(np.int64).max)
        live = np.flatnonzero(often.min(1) > 0)
        if not len(live):
            return
        order = np.argsort(often[live], 1, kind="stable")
        many = self.counts[grid[live, order[:, 0]]] * (2 * slop + 1)
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // SLICE)) + 1
        for part in np.split(np.arange(len(live)), cuts):
            yield self._slice(windows, live[part], order[part], slop)

    def _slice(self, windows: Windows, live: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        grid, length = windows.grid, windows.length.astype(np.int64)
        lead = grid[live, order[:, 0]]
        many = self.counts[lead]
        w = np.repeat(np.arange(len(live)), many)
        place = np.repeat(self.first[lead] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        at = self.positions[place]
        doc = np.searchsorted(self.starts, at, "right") - 1  # a match lies in one document
        if slop:
            shift = np.arange(-slop, slop + 1)
            w, doc = np.repeat(w, len(shift)), np.repeat(doc, len(shift))
            at = (at[:, None] + shift).ravel()
        start = at - order[w, 0]
        ok = (start >= self.starts[doc]) & (start + length[live[w]] <= self.starts[doc + 1])
        w, start, doc = w[ok], start[ok], doc[ok]
        for k in range(1, grid.shape[1]):
            off = order[w, k]
            ok = off >= length[live[w]]
            there = np.flatnonzero(~ok)
            place = start[there] + off[there]
            low, high = np.maximum(place - slop, self.starts[doc[there]]), np.minimum(place + slop, self.starts[doc[there] + 1] - 1)
            ok[there] = self.near(grid[live[w[there]], off[there]], low, high)
            w, start, doc = w[ok], start[ok], doc[ok]
        found = live[w]
        if slop and len(found):  # a start that several places of the rarest term lead to
            found, start = np.unique(np.stack([found, start]), axis=1)
        return found, start


HIT_SCHEMA = "doc_id bigint, segment bigint, nth int, n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>"


def find(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """Of each document: its number of words, the merged spans inside occurrences, the items found."""
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wins = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row, wins)
                parts = list(seg.matches(wins, slop))
                which, start = (np.concatenate([p[c] for p in parts] or [np.zeros(0, np.int64)]) for c in range(2))
                doc = np.searchsorted(seg.starts, start, "right") - 1
                by = np.lexsort((start, doc))
                spans: list[list] = [[] for _ in seg.doc_ids]
                items: list[set] = [set() for _ in seg.doc_ids]
                for d, s, w in zip(doc[by].tolist(), start[by].tolist(), which[by].tolist(), strict=True):
                    s -= int(seg.starts[d])
                    e = s + int(wins.length[w])
                    if spans[d] and s <= spans[d][-1]["e"]:
                        spans[d][-1]["e"] = max(e, spans[d][-1]["e"])
                    else:
                        spans[d].append({"s": s, "e": e})
                    items[d].update(wins.items[w])
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": k, "segment": row["segment"], "nth": n, "n_words": int(seg.starts[n + 1] - seg.starts[n]), "spans": spans[n], "items": sorted(items[n])}
                        for n, k in enumerate(seg.doc_ids)
                    ],
                    pa.schema(
                        [("doc_id", pa.int64()), ("segment", pa.int64()), ("nth", pa.int32()), ("n_words", pa.int64()),
                         ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string()))]
                    ),
                )

    return index.mapInArrow(trimmed(search), HIT_SCHEMA)


def test_blocks(benchmark: DataFrame, id_col: str = "item_id") -> Iterator[list[tuple[str | None, bytes]]]:
    """The test items in blocks of at most BLOCK_BYTES (one item at least)."""
    held, room = [], BLOCK_BYTES
    rows = benchmark.select(F.col(id_col).cast("string"), F.col("text").cast("string").cast("binary"))
    for item_id, text in rows.toLocalIterator(prefetchPartitions=False):
        text = bytes(text or b"")
        if held and len(text) > room:
            yield held
            held, room = [], BLOCK_BYTES
        held.append((item_id, text))
        room -= len(text)
    yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans."""
    spark = docs.sparkSession
    blocks = test_blocks(benchmark)
    first = next(blocks)
    second = next(blocks, None)
    # With one block its terms are the only ones that get postings; with more, all terms do.
    windows = Windows(first, size)
    terms = spark.createDataFrame([(sorted(windows.terms),)], "terms array<binary>") if second is None else None
    index = build_index(docs, terms).withColumn("segment", F.monotonically_increasing_id())
    found = find(index, windows, slop)
    if second is not None:
        while second is not None:
            found = found.unionByName(find(index, Windows(second, size), slop))
            second = next(blocks, None)
        found = found.groupBy("segment", "nth").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"),
        )
        found = found.withColumn("spans", merged("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct("items"))).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        "spans",
    )


def merged(column: str):
    """An array of spans, sorted and joined where they touch."""
    start = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def add(a, x):
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(a) > 0) & (x["s"] <= F.try_element_at(a, F.lit(-1))["e"]), joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(column), start, add)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[k:k + least({WINDOW}, len(w)) - 1], ' ') AS x, least({WINDOW}, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS k FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT occ.r, occ.k, occ.n, win.item FROM occ JOIN win ON occ.x = win.x AND occ.n = win.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS i FROM hits WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(i), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(i, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], size: int = WINDOW, slop: int = 0) -> list[tuple]:
    """The contract, straight from its words; for small tests."""

    def split(text: str | None) -> list[str]:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    wins = [(str(i), ws[k : k + size]) for i, t in items if (ws := split(t)) for k in range(max(1, len(ws) - size + 1))]
    out = []
    for doc_id, text in docs:
        ws, hit, found = split(text), set(), set()
        for i, win in wins:
            for s in range(len(ws) - len(win) + 1):
                if all(x in ws[max(0, s + k - slop) : s + k + slop + 1] for k, x in enumerate(win)):
                    hit.update(range(s, s + len(win)))
                    found.add(i)
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
