"""Bytes as text: the printable byte alphabet and bytes literals."""

from __future__ import annotations

import re
from functools import cache


@cache
def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: visible Latin-1 bytes are themselves, the others follow from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def to_printable(raw: bytes) -> str:
    return "".join(map(byte_alphabet().__getitem__, raw))


@cache
def _alphabet_bytes() -> dict[str, int]:
    return {c: b for b, c in byte_alphabet().items()}


def from_printable(text: str) -> bytes:
    return bytes(map(_alphabet_bytes().__getitem__, text))


def bytes_literal(raw: bytes) -> str:
    """``b'...'`` as Python writes it."""
    return repr(bytes(raw))


# The escapes of one letter.
ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, "'": 39, '"': 34}
_LITERAL = re.compile(r"""[bB](['"])(.*)\1""", re.DOTALL)
_PART = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([0-7]{1,3})|\\(.)|([^\\])", re.DOTALL)


def parse_bytes_literal(text: str) -> bytes:
    """The bytes of ``b'...'``; an unknown escape is the character itself."""
    whole = _LITERAL.fullmatch(text.strip())
    out, at = bytearray(), 0
    body = whole[2] if whole else ""
    while whole and at < len(body):
        part = _PART.match(body, at)
        if part is None or part[0] == whole[1] or not part[0].isascii():
            break
        if part[1]:
            out.append(int(part[1], 16))
        elif part[2]:
            out.append(int(part[2], 8) & 255)
        elif part[3]:
            if part[3] == "x":
                break
            if part[3] != "\n":
                out.append(ESCAPES.get(part[3], ord(part[3])))
        else:
            out.append(ord(part[4]))
        at = part.end()
    if whole is None or at < len(body):
        raise ValueError(f"not a bytes literal: {text[:40]!r}")
    return bytes(out)
