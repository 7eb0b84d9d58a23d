"""Similarity self-join of word shingles: Jaccard >= 0.75, as components.

1. Every text becomes a set of 64-bit shingle hashes.  Texts with equal sets are
   classes, joined by digest; their first document stands for them below.
2. Under an order that puts frequent shingles last, two similar sets share a
   shingle of their prefixes (the first |x| - ceil(0.75 |x|) + 1 of each), so
   prefixes alone are shuffled.  Only shared prefix shingles live on.
3. In each bucket of a shared shingle a greedy size band links to its smallest
   member.  These pairs, linear in the bucket, are verified and joined to
   components, which contracts even a group of a third of the corpus.
4. What remains are pairs of *different* components within a bucket, after
   NEAREST_ROUNDS rounds of each document's nearest partner.  A later round reads
   only the buckets in which an earlier one left a pair out.  Pairs are compared
   in size-banded tiles of bounded rows: a tile holds a band and its upper neighbour, each document with a bitmap of its hashes as wide as the
   band asks for.  Half of (sizes minus differing bits) bounds the overlap from
   above; only pairs that pass are verified by intersecting the sorted arrays.

No link between different texts is lost: pairs inside one component need no
further check, and every other pair that shares a prefix shingle is bounded or
verified.  Sets are computed again from the texts where needed; storing them
would write more than the corpus.

Defined cases: null, empty and wordless texts have an empty set and link with
nothing; fewer than five words are one shingle; a null doc_id is returned
with a null component; rows that repeat a doc_id are one node; a very long text
has a prefix and a bitmap in proportion to its set; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, release, sized_join, skew_safe_lookup, trim, trimmed
from .components import components

WIDTH = 5
#: Shingles seen in so many documents of a block, and over all in so many, go last in the order (at most HOT_SHINGLES of them).
LOCAL_DF, HOT_DF, HOT_SHINGLES = 3, 24, 200_000
BLOCK_BYTES = 8 << 20
PREFIX_ROWS = 1_500_000
TILE_ROWS = 2048
NEAREST_ROUNDS = 2
MIN_BITS, WIDE_BITS = 256, 1 << 20
#: Hashes of a set up to which its bitmap has more bits than hashes.
FULL = 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_SHIFT, _TRUE = np.uint64(31), np.array([True])


class Shingler:
    """Sorted distinct shingle hashes of UTF-8 texts."""

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(_LOWER).split()  # bytes.split() parts at [\x20\x09-\x0D]
        h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
        if not len(h):
            return h
        width = min(WIDTH, len(h))
        n = len(h) - width + 1
        out = h[:n] * _MULTIPLIERS[0]
        for k in range(1, width):
            out ^= out >> _SHIFT
            out += h[k : k + n] * _MULTIPLIERS[k]
        out ^= out >> _SHIFT
        out *= _MULTIPLIERS[width - 1]
        out ^= out >> _SHIFT
        out.sort()
        return out[np.concatenate((_TRUE, out[1:] != out[:-1]))]


def needed(n: int) -> int:
    """The least overlap that a set of n shingles has with any similar set."""
    return (3 * n + 3) // 4


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 4 * len(a) < 3 * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def band(n: int) -> int:
    return int(np.log(n) / np.log(4 / 3) + 1e-9)


def bits_of_band(k: int) -> int:
    """At least MIN_BITS, and two to four for each hash of the band's largest set of up to FULL hashes.

    Beyond that one to two, up to WIDE_BITS: two sets of n hashes that have nothing
    in common then differ in 0.46 n bits or more, of which 2 n / 7 rule them out.
    """
    most = (4 / 3) ** (k + 1)
    return int(min(WIDE_BITS, max(MIN_BITS, 1 << int(np.ceil(np.log2(2 * most if most <= FULL else most))))))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each hash modulo the width of the set's band."""
    bits = np.zeros(bits_of_band(band(len(shingles))), np.uint8)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of fewer bits: hashes modulo a smaller power of two."""
    while 8 * bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        yield doc_id, text.as_py() or b""


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (n, digest), and rows (shingle, c) for what a block repeats."""
    shingle, seen, held, room = Shingler(), set(), [], BLOCK_BYTES
    names = ["doc_id", "n", "d1", "d2", "shingle", "c"]

    def repeated() -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        ok = count >= LOCAL_DF
        m = int(ok.sum())
        none = pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(value[ok].view(np.int64)), pa.array(count[ok].astype(np.int64))], names)

    for batch in batches:
        rows = []
        for doc_id, text in _texts(batch):
            s = shingle(text)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            rows.append((doc_id, len(s), *np.frombuffer(digest, np.int64).tolist()))
            if len(s) and digest not in seen:
                seen.add(digest)
                held.append(s)
                room -= len(text)
            if room <= 0:
                yield repeated()
                held, room = [], BLOCK_BYTES
                seen.clear()
        none = pa.nulls(len(rows), pa.int64())
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [none] * 4
        yield pa.RecordBatch.from_arrays([*columns, none, none], names)
    yield repeated()
    held, seen = [], set()
    trim()


def _prefixes(hot_cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, hot = Shingler(), hot_cast.value
        for batch in batches:
            out: list[tuple[np.ndarray, int, int]] = []
            size = 0

            def flush() -> pa.RecordBatch:
                each = [len(p) for p, _, _ in out]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p for p, _, _ in out]).view(np.int64) if out else np.zeros(0, np.int64)),
                        pa.array(np.repeat(np.array([d for _, d, _ in out], np.int64), each)),
                        pa.array(np.repeat(np.array([n for _, _, n in out], np.int32), each)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in each]) if out else np.zeros(0, np.int32)),
                    ],
                    ["shingle", "doc_id", "n", "pos"],
                )

            for doc_id, text in _texts(batch):
                s = shingle(text)
                n = len(s)
                if doc_id is None or not n:
                    continue
                p = n - needed(n) + 1
                if len(hot):
                    at = np.searchsorted(hot, s)
                    frequent = hot[np.minimum(at, len(hot) - 1)] == s
                    prefix = np.concatenate((s[~frequent], s[frequent]))[:p] if frequent.any() else s[:p]
                else:
                    prefix = s[:p]
                out.append((prefix, doc_id, n))
                size += p
                if size > 200_000:
                    yield flush()
                    out, size = [], 0
            yield flush()
        trim()

    return run


SHARED = "shingle bigint, doc_id bigint, n int, pos int, center bigint"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that two rows or more hold, from rows sorted by (shingle, n, doc_id).

    ``center``: the first of the greedy size band (sizes up to 4/3 of its own)
    the row falls in.  One row is carried between batches.
    """
    names = [x.split()[0] for x in SHARED.split(", ")]
    last = None  # the row not yet known to be shared: (shingle, doc_id, n, pos, center, center_n, nth)
    for batch in batches:
        if not batch.num_rows:
            continue
        h, doc, n, pos = (batch.column(k).to_numpy() for k in range(4))
        new = np.concatenate(([True], h[1:] != h[:-1]))
        first_known = last is not None and last[0] == h[0]
        many = ~new | np.concatenate((~new[1:], [False]))
        if first_known:
            k = int(np.flatnonzero(new[1:])[0]) + 1 if new[1:].any() else len(h)
            many[:k] = True
        out = []
        if first_known and last[6] == 0:
            out.append(last[:5])
        state = (last[4], last[5], last[6]) if first_known else (0, 0, 0)
        center, center_n, nth = state
        rows = np.flatnonzero(many)
        for i, hh, d, nn, p, start in zip(rows.tolist(), h[rows].tolist(), doc[rows].tolist(), n[rows].tolist(), pos[rows].tolist(), new[rows].tolist(), strict=True):
            if start and not (i == 0 and first_known):
                center, center_n, nth = d, nn, 0
            else:
                nth += 1
                if 3 * nn > 4 * center_n:
                    center, center_n = d, nn
            out.append((hh, d, nn, p, center))
        end = len(h) - 1
        if many[end]:
            last = (int(h[end]), int(doc[end]), int(n[end]), int(pos[end]), center, center_n, max(nth, 1) if not (new[end] and not (end == 0 and first_known)) else 0)
        else:
            last = (int(h[end]), int(doc[end]), int(n[end]), int(pos[end]), int(doc[end]), int(n[end]), 0)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


BITS = "doc_id bigint, n int, bits binary"
#: A set or wide bitmap on its way to document ``a``; ``b`` is null for those of ``a`` itself.
MOVED = "a bigint, sub int, b bigint, n int, body binary"
#: Partners of one document that a task verifies against one copy of its set.
FAN = 64
#: Places one copy of a text is read for, and bytes of a batch of what is made of texts.
PLACES, MOVED_BYTES = 1024, 4 << 20


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        rows = [(doc_id, len(s), bitmap(s).tobytes()) for doc_id, text in _texts(batch) if len(s := shingle(text))]
        ids, sizes, bits = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], ["doc_id", "n", "bits"])


def wide_bitmap(shingles: np.ndarray) -> bytes:
    """Four to eight bits for each hash (up to WIDE_BITS), a tenth of the set's bytes."""
    bits = np.zeros(min(WIDE_BITS, 1 << (4 * max(16, len(shingles))).bit_length()), np.uint8)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _bodies(make):
    """Rows of MOVED, in batches of bounded bytes, from rows (text, places); ``make`` turns a set into bytes."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "sub", "b", "n", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            rows, size = [], 0
            for text, places in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                s = shingle(text.as_py() or b"")
                body = make(s)
                for place in places.as_py():
                    rows.append((place["a"], place["sub"], place["b"], len(s), body))
                    size += len(body)
                    if size > MOVED_BYTES:
                        yield table(rows)
                        rows, size = [], 0
            yield table(rows)
        trim()

    return run


BOUNDED = "a bigint, b bigint, share double"


def share(n: int, p: bytes, m: int, q: bytes) -> float | None:
    """The share of differing bits of two bitmaps; None if the overlap cannot suffice."""
    one, two = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    width = 8 * min(len(one), len(two))
    differ = int(np.bitwise_count(folded(one, width) ^ folded(two, width)).sum())
    return differ / (n + m) if 7 * (n + m - differ) >= 6 * (n + m) and 4 * min(n, m) >= 3 * max(n, m) else None


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, share of differing bits) of the rows (a, b, n and bits of a, n and bits of b) whose overlap may suffice."""
    for batch in batches:
        shares = pa.array([share(*row) for row in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)], pa.float64())
        keep = shares.is_valid()
        yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (batch.column(0), batch.column(1), shares)], ["a", "b", "share"])


def _set(shingles: np.ndarray) -> bytes:
    return shingles.tobytes()


def may_fit(n: int, p: bytes, m: int, q: bytes) -> bool:
    return share(n, p, m, q) is not None


def fit(n: int, p: bytes, m: int, q: bytes) -> bool:
    return similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))


def _against(test):
    """(a, b) that pass ``test``, from rows of MOVED sorted by (a, sub, b) with nulls first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            found = []
            for k, (a, sub, b, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if (a, sub) != key:
                    key, own = (a, sub), []
                body = batch.column(4)[k].as_py()
                if b is None:
                    own.append((n, body))
                elif any(test(*x, n, body) for x in own):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    return run


def bounded(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (a, b, share of differing bits) that sizes and bitmaps leave open."""
    one = bits.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = bits.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return rows.mapInArrow(trimmed(_bound), BOUNDED)


def confronted(pairs: DataFrame, texts: DataFrame, make, test) -> DataFrame:
    """The materialised pairs (a, b) that pass ``test`` on what ``make`` gives of their sets.

    What is made of ``b`` moves once to each ``a``, and that of ``a`` once for
    every FAN partners, so that no document's partners meet in one task.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("s"))
    placed = pairs.join(fan, "a").select("a", F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("sub"), "b")
    own = placed.select(F.col("a").alias("doc_id"), "a", "sub", F.lit(None).cast("long").alias("b")).distinct()
    places = placed.select(F.col("b").alias("doc_id"), "a", "sub", "b").unionByName(own)
    many = places.groupBy("doc_id").agg(F.ceil(F.count("*") / PLACES).alias("s"))
    part = F.pmod(F.xxhash64("a", "sub", "b"), F.col("s"))
    places = cut(places.join(many, "doc_id").groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct("a", "sub", "b")).alias("places")))
    n = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    if not n:
        return pairs.select("a", "b").filter("false")
    rows = sized_join(texts, places, "doc_id", "inner", n).select("text", "places").mapInArrow(_bodies(make), MOVED)
    rows = rows.repartition(partitions(rows.sparkSession), "a", "sub").sortWithinPartitions("a", "sub", F.asc_nulls_first("b"))
    return rows.mapInArrow(trimmed(_against(test)), "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, screen: bool = False) -> DataFrame:
    """The similar ones of materialised pairs (a, b); only their documents' sets are made and moved.

    With ``screen`` (for pairs of which few are similar), wide bitmaps rule out
    most pairs before a set moves.
    """
    pairs = pairs.select("a", "b")
    if screen:
        pairs = cut(confronted(pairs, texts, wide_bitmap, may_fit))
    return confronted(pairs, texts, _set, fit)


def settled(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components of known components and more links."""
    return cut(components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)))


def between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose documents are not in one component yet."""
    for c in ("a", "b"):
        pairs = sized_join(pairs, comps.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    return pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


TILE = "shingle bigint, band int, i int, j int, doc_id bigint, n int, pos int, comp bigint, sub int, home boolean, bits binary"
#: Cells of a tile compared at once, and pairs a task remembers not to send again.
CELLS, SENT = 65_536, 400_000


def _compare(tile: dict[str, np.ndarray], bits: list[bytes], nearest: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (a, b) of one tile that sizes, positions and bitmaps leave open, and whether ``nearest`` left some of them out."""
    doc, n, pos, comp, sub, home = (tile[c] for c in ("doc_id", "n", "pos", "comp", "sub", "home"))
    apart = tile["i"][0] != tile["j"][0]
    mine, place = np.flatnonzero(home), np.arange(len(doc))
    words, found, partial = None, [], False
    for start in range(0, len(mine), max(1, CELLS // len(doc))):
        k = mine[start : start + max(1, CELLS // len(doc))]
        rest = n - pos
        small, total = np.minimum(n[k, None], n), n[k, None] + n
        ok = (comp[k, None] != comp) & (7 * small >= 3 * total)
        if not nearest:
            ok &= ~home | (place > k[:, None])
        if apart:
            ok &= sub[k, None] != sub
        # If this is their first common shingle, no more can follow than the shorter rest.
        ok &= 7 * np.minimum(rest[k, None], rest) >= 3 * total
        r, c = np.nonzero(ok)
        if not len(r):
            continue
        if words is None:
            width = bits_of_band(int(tile["band"][0]))
            rows = [b if 8 * len(b) == width else folded(np.frombuffer(b, np.uint8), width).tobytes() for b in bits]
            width = min(width, 8 * min(map(len, rows)))
            words = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), width // 64)
        sums = total[r, c]
        differ = np.bitwise_count(words[k[r]] ^ words[c]).sum(1).astype(np.int64)
        at = np.flatnonzero(7 * (sums - differ) >= 6 * sums)
        if nearest and len(at):
            open_pairs = len(at)
            at = at[np.lexsort((differ[at] / sums[at], r[at]))]
            at = at[np.unique(r[at], return_index=True)[1]]
            partial |= len(at) < open_pairs
        found.append((doc[k[r[at]]], doc[c[at]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    one, two = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.minimum(one, two), np.maximum(one, two), partial


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tiles(batches, True)


def _tiles(batches: Iterator[pa.RecordBatch], nearest: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of each tile that the bounds leave; rows sorted by tile.

    With ``nearest``, each row of the home band gives only the pair of the
    smallest share of differing bits, and a row (null, null, shingle) names a
    bucket in which that left a pair out.  A pair that several tiles of a task
    find is sent once (as long as it is remembered).
    """
    names = [x.split()[0] for x in TILE.split(", ")][:-1]
    keys = names[:4]
    held: list[tuple[dict[str, np.ndarray], list[bytes]]] = []
    sent: set[tuple[int, int]] = set()

    again: set[int] = set()

    def compare(parts: list[tuple[dict[str, np.ndarray], list[bytes]]]) -> set[tuple[int, int]]:
        tile = parts[0][0] if len(parts) == 1 else {c: np.concatenate([p[0][c] for p in parts]) for c in names}
        bits = [b for _, part in parts for b in part]
        one, two, partial = _compare(tile, bits, nearest)
        if partial:
            again.add(int(tile["shingle"][0]))
        return set(zip(one.tolist(), two.tolist(), strict=True))

    def send(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
        if len(sent) > SENT:
            sent.clear()
        new = list(pairs - sent)
        sent.update(new)
        marks = list(again)
        again.clear()
        columns = ([*(p[0] for p in new), *[None] * len(marks)], [*(p[1] for p in new), *[None] * len(marks)], [*[None] * len(new), *marks])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shingle"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        columns = {c: v if c == "home" else v.astype(np.int64) for c, v in columns.items()}
        bits = batch.column("bits").to_pylist()
        new = np.zeros(len(bits) - 1, bool)
        for c in keys:
            new |= columns[c][1:] != columns[c][:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(bits)]
        pairs: set[tuple[int, int]] = set()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = {c: v[lo:hi] for c, v in columns.items()}
            if held and any(held[0][0][c][0] != part[c][0] for c in keys):
                pairs |= compare(held)
                held = []
            held.append((part, bits[lo:hi]))
        yield send(pairs)
    if held:
        yield send(compare(held))


def open_buckets(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, of buckets with the same documents only the first.

    Components only ever grow together, so that later rounds need no other rows.
    The order of shingles is the same for all documents: of equal buckets the
    first has the smallest positions, and the first bucket two documents share is
    never the one that goes.
    """
    rows = _placed(shared, comps)
    mark = [F.sum(F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1))).alias(f"mark_{seed}") for seed in (1, 2)]
    ends = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("pos").alias("last")]
    buckets = rows.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), *mark, *ends)
    # A bucket of two was settled by its star; one of a single component has nothing left to settle.
    buckets = buckets.filter("x <> y and m > 2")
    first = buckets.groupBy("m", "mark_1", "mark_2", "low", "high").agg(F.min(F.struct("last", "shingle")).alias("first"))
    return rows.join(first.select(F.col("first.shingle").alias("shingle")), "shingle", "left_semi").select("shingle", "doc_id", "n", "pos")


def _placed(shared: DataFrame, comps: DataFrame) -> DataFrame:
    known = comps.select(F.col("id").alias("doc_id"), "component")
    rows = sized_join(shared.select("shingle", "doc_id", "n", "pos"), known, "doc_id", "left")
    return rows.select("shingle", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("comp"))


def cross_pairs(shared: DataFrame, bits: DataFrame, comps: DataFrame, nearest: bool = False) -> DataFrame:
    """Pairs (a, b, null) of different components that share a prefix shingle and pass the bounds.

    With ``nearest``: of each row the nearest, and (null, null, shingle) for the buckets in which other pairs are left.
    """
    rows = _placed(shared, comps)
    open_ = rows.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    k = F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    rows = rows.join(open_.select("shingle"), "shingle", "left_semi").withColumn("k", k)
    rows = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("home")).withColumn("band", F.when(F.col("home"), F.col("k")).otherwise(F.col("k") - 1))
    sizes = rows.groupBy("shingle", "band").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("s"), F.max("home").alias("any"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("any and x <> y")
    rows = rows.join(sizes.select("shingle", "band", "s"), ["shingle", "band"])
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("s").cast("long")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.select("shingle", "band", F.least("sub", "x").alias("i"), F.greatest("sub", "x").alias("j"), "doc_id", "n", "pos", "comp", "sub", "home")
    rows = rows.join(bits.select("doc_id", "bits"), "doc_id")
    tile = ["shingle", "band", "i", "j"]
    rows = rows.select(*tile, "doc_id", "n", "pos", "comp", "sub", "home", "bits")
    return rows.repartition(partitions(rows.sparkSession), *tile).sortWithinPartitions(*tile).mapInArrow(trimmed(_nearest if nearest else _tiles), "a bigint, b bigint, shingle bigint").distinct()


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id; one row for each row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = cut(texts.mapInArrow(_scan, "doc_id bigint, n bigint, d1 bigint, d2 bigint, shingle bigint, c bigint"))
    found = scan.filter("n is not null")
    hot = (
        scan.filter("shingle is not null").groupBy("shingle").agg(F.sum("c").alias("c")).filter(F.col("c") >= HOT_DF)
        .orderBy(F.desc("c"), "shingle").limit(HOT_SHINGLES).select("shingle").toPandas()
    )
    hot_cast = spark.sparkContext.broadcast(np.sort(hot["shingle"].to_numpy(np.int64).view(np.uint64)))

    # Classes of equal sets.
    full = found.filter("n > 0 and doc_id is not null").withColumn("digest", F.struct("d1", "d2"))
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).filter("m > 1")
    twins = cut(skew_safe_lookup(full.select("doc_id", "digest"), classes, "digest", "m").filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    firsts = sized_join(texts, twins.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti", twins.count())

    # Shared prefix shingles.
    total = found.agg(F.coalesce(F.sum(F.col("n") / 4 + 1), F.lit(0.0))).first()[0]
    parts = max(partitions(spark), int(total / PREFIX_ROWS) + 1)
    prefixes = firsts.mapInArrow(_prefixes(hot_cast), "shingle bigint, doc_id bigint, n int, pos int")
    shared = cut(prefixes.repartition(parts, "shingle").sortWithinPartitions("shingle", "n", "doc_id").mapInArrow(trimmed(_shared), SHARED))
    release(spark)
    wanted = cut(shared.select("doc_id").distinct())
    n_wanted = wanted.count()
    if n_wanted:
        bits = cut(sized_join(texts, wanted, "doc_id", "left_semi", n_wanted).mapInArrow(trimmed(_bits), BITS))
        pairs = shared.filter("doc_id <> center").select(F.least("doc_id", "center").alias("a"), F.greatest("doc_id", "center").alias("b")).distinct()
        stars = cut(bounded(pairs, bits))
        # Each document's nearest centre first; then only star pairs that this leaves between two components.
        best = cut(stars.groupBy("b").agg(F.min(F.struct("share", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"))
        comps = cut(components(cut(twins.unionByName(verified(best, texts)))))
        stars = stars.select("a", "b")
        rest = cut(between(stars.join(best, ["a", "b"], "left_anti"), comps))
        more = cut(verified(rest, texts, True))
        if more.count():
            comps = settled(comps, more)
        release(spark)
        shared = cut(open_buckets(shared, comps))
        release(spark)
        # First each row's nearest partner (linear), which joins the groups a star left apart; at last all pairs still open.
        for nearest in (*[True] * NEAREST_ROUNDS, False):
            found_pairs = cut(cross_pairs(shared, bits, comps, nearest))
            crossing = cut(found_pairs.filter("a is not null").select("a", "b").join(stars, ["a", "b"], "left_anti"))
            more = cut(verified(crossing, texts, True))
            if more.count():
                comps = settled(comps, more)
            stars = stars.unionByName(crossing)
            again = cut(found_pairs.filter("shingle is not null").select("shingle"))
            n_again = again.count()
            if not n_again:
                break
            shared = cut(sized_join(shared, again, "shingle", "left_semi", n_again))
            release(spark)
    else:
        comps = cut(components(twins))
    known = comps.select(F.col("id").alias("doc_id"), "component")
    out = sized_join(found.select("doc_id", F.col("n").alias("n_shingles")), known, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, low) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.id WHERE r.low < e.b
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.low) AS component_id
FROM d JOIN reach r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """The contract by comparing all pairs of shingle sets of strings; for small tests."""
    import re

    sets = []
    for _, text in docs:
        words = [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        k = min(WIDTH, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(docs)]
