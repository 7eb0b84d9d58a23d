"""Text expressions that stay in the JVM: special-token splitting, pretokens, byte words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the public GPT-2 pretokenizer pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_BREAK = re.compile(r" (?=\S)")


def stretches(text: str, size: int) -> Iterator[str]:
    """Consecutive parts of a text, of at most ``size`` characters where it can be parted so.

    They part at spaces that a non-space follows: a pretoken always begins there.
    """
    start = 0
    while len(text) - start > size:
        at = text.rfind(" ", start + 1, start + size + 1)
        while at > start and (at + 1 == len(text) or text[at + 1].isspace()):
            at = text.rfind(" ", start + 1, at)
        if at <= start:
            found = _BREAK.search(text, start + 1)
            at = found.start() if found else len(text)
        yield text[start:at]
        start = at
    if start < len(text):
        yield text[start:]


def pretokens(text: Column) -> Column:
    """Pretokens of a text without special tokens; they tile it."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def special_pattern(specials: Sequence[str]) -> str:
    """Alternation of the quoted specials, longest first, so that overlapping ones match longest."""
    return "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in sorted(set(specials), key=lambda s: (-len(s), s)))


def split_on_specials(text: Column, specials: Sequence[str]) -> Column:
    """The segments between special tokens (empty ones too), specials dropped."""
    return F.split(text, special_pattern(specials), -1) if specials else F.array(text)


def segments(text: Column, specials: Sequence[str]) -> Column:
    """array<struct<text, special>> in order: normal segments and the specials between them."""
    normal = F.transform(split_on_specials(text, specials), lambda s: F.struct(s.alias("text"), F.lit(False).alias("special")))
    if not specials:
        return F.filter(normal, lambda s: s["text"] != "")
    found = F.transform(
        F.regexp_extract_all(text, F.lit("(" + special_pattern(specials) + ")"), F.lit(1)),
        lambda s: F.struct(s.alias("text"), F.lit(True).alias("special")),
    )
    both = F.transform(
        F.sequence(F.lit(0), F.size(normal) - 1),
        lambda i: F.when(i < F.size(found), F.array(F.get(normal, i), F.get(found, i))).otherwise(F.array(F.get(normal, i))),
    )
    return F.filter(F.flatten(both), lambda s: s["text"] != "")


def segmented_pretokens(text: Column, specials: Sequence[str] = ()) -> Column:
    """array<struct<text, special>>: each segment pretokenized on its own, specials whole."""
    if not specials:
        return F.transform(pretokens(text), lambda p: F.struct(p.alias("text"), F.lit(False).alias("special")))
    parts = F.transform(
        segments(text, specials),
        lambda s: F.when(s["special"], F.array(s)).otherwise(F.transform(pretokens(s["text"]), lambda p: F.struct(p.alias("text"), F.lit(False).alias("special")))),
    )
    return F.flatten(parts)


def hex_bytes(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "utf-8")))


def hex_word(text: Column) -> Column:
    """A text as a word of byte tokens, ``<hh>`` each: order and concatenation are those of the bytes."""
    return F.regexp_replace(hex_bytes(text), "(..)", "<$1>")


def tokens_of(word: Column) -> Column:
    """The tokens (hex) of a word."""
    return F.split(F.substring(word, F.lit(2), F.length(word) - 2), "><")


def adjacent_pairs(tokens: Column) -> Column:
    """array<struct<l, r>> of neighbours, overlapping ones too."""
    return F.when(
        F.size(tokens) > 1,
        F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda k: F.struct(F.get(tokens, k).alias("l"), F.get(tokens, k + 1).alias("r"))),
    ).otherwise(F.array().cast("array<struct<l:string,r:string>>"))


def chunked(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters (one empty piece of an empty text)."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def _running_sums(sizes: pa.Array) -> pa.Array:
    flat, bounds = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
    ends = np.concatenate(([0], np.cumsum(flat)))
    each = np.diff(bounds)
    ends = ends[1:] - np.repeat(ends[bounds[:-1]], each)
    parts = pa.StructArray.from_arrays([pa.array(ends - flat, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])
    mask = sizes.is_null() if sizes.null_count else None
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts, mask=mask)


def running_sums(sizes: Column) -> Column:
    """array<struct<start, end>>: where each part starts and ends, by sums within an array of lengths."""
    return F.arrow_udf(_running_sums, "array<struct<start:int,end:int>>")(sizes)


def duration(seconds: Column) -> Column:
    """``M min S.SS sec``."""
    return F.format_string("%d min %.2f sec", F.floor(seconds / 60).cast("int"), seconds - F.floor(seconds / 60) * 60)


def decoded(raw: Column) -> Column:
    """UTF-8 text of bytes, malformed parts replaced by U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def decoded_or_null(raw: Column) -> Column:
    return F.try_validate_utf8(raw.cast("string"))
