"""Personal data by candidate gradient boosting.

Base spans come from four fixed patterns and always stay.  Beyond them,
high-recall generators propose spans (they may overlap) of looser formats:
addresses with spelled-out signs, numbers with other separators, hexadecimal
addresses, card numbers in unusual groups.  Boosted trees score each proposal
from its format and its context; proposals above their kind's calibrated
threshold are added, best score first, where they overlap no span yet.

The trees are trained here, at first use, on generated examples with a fixed
seed (no corpus rows, no labels); each kind's threshold is the least that keeps
PRECISION on generated examples held back from the trees.

Defined cases: a null text counts as empty; no span gives empty strings' digest
and text; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.  Very long texts take time in proportion to their
length, whatever they hold: each run of characters is walked a bounded number of
times.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, tried only where a match can begin: at the first digit of a run, or at the @ (see ``emails``).
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: High-recall generators.
LOOSE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s{0,2}(?:@|[\[({<]\s?at\s?[\])}>]|\s(?:at|AT)\s)\s{0,2}[A-Za-z0-9-]{1,63}"
        r"(?:(?:\.|\s{0,2}[\[({<]\s?dot\s?[\])}>]\s{0,2}|\s{1,2}(?:dot|DOT)\s{1,2})[A-Za-z0-9-]{1,63}){1,4}"
    ),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_\xa0]|\s{1,2}|-{1,2})(?:[0-9]{4,6}(?:[./_\xa0]|\s{1,2}|-{1,2})?){1,3}[0-9]{1,7}(?![0-9])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:00[0-9]{1,3}[\s./-]?)?\(?[0-9]{2,5}\)?(?:[\s./-]{1,2}[0-9]{2,4}){1,4}(?![0-9A-Za-z])"),
}
PRECISION = 0.98
TREES, DEPTH, RATE, SEED = 60, 3, 0.2, 20240501
#: Words that make a format likelier or less likely to be personal data.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "cell", "ring", "anruf"),
    "other": ("version", "page", "isbn", "figure", "score", "order", "model", "year", "ratio", "lines"),
}


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, nines cast out, the sum a multiple of ten."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in match.split(".")))
    digits = _digits(match)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the base pattern of emails, from each @ outwards.

    The longest run of the local part's characters before an @ begins a match, if
    a domain follows; no such run holds an @, so that none is walked twice.
    """
    done = 0
    at = text.find("@")
    while at >= 0:
        if (domain := _DOMAIN.match(text, at)) is not None:
            start, size = at, 64
            while True:
                low = max(done, at - size)
                start = at - _LOCAL.match(text[low:at][::-1]).end()
                if start > low or low == done:
                    break
                size *= 2  # the run may begin further back
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    has_digit = any(d in text for d in "0123456789")
    for k, kind in enumerate(KINDS):
        if kind in BASE and has_digit and (kind != "phone" or "+" in text):
            out += [(k, m.start(), m.end()) for m in BASE[kind].finditer(text) if passes(kind, m[0])]
    return out


def joined(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that spans cover together, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def touches(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    """Does [start, end) share a character with one of the disjoint sorted intervals?"""
    before = bisect_left(starts, end)
    return before > 0 and ends[before - 1] > start


#: A sign that every match of the email generator holds.
_AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|\s(?:at|AT)\s")


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the generators that touch no base span."""
    out = []
    has_digit = any(d in text for d in "0123456789")
    for k, kind in enumerate(KINDS):
        if _AT.search(text) if kind == "email" else (":" in text if kind == "ip" else has_digit):
            out += [(k, m.start(), m.end()) for m in LOOSE[kind].finditer(text) if m.end() > m.start()]
    starts, ends = joined(base)
    return [x for x in out if not touches(starts, ends, *x[1:])]


def describe(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context features of a proposal."""
    kind, start, end = span
    inside, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    digits = _digits(inside)
    groups = re.findall(r"[0-9]+", inside)
    parts = re.findall(r"[A-Za-z0-9]+", inside)
    marks = {c for c in inside if not c.isalnum()}
    near = re.findall(r"[^\W\d_]+", before)[-5:]
    return [
        float(kind),
        float(len(inside)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(len(parts[-1]) if parts else 0),
        float(len(parts)),
        float(len(marks)),
        float("@" in inside),
        float(bool(re.search(r"[\[({<]\s?(?:at|dot)", inside))),
        float("(" in inside and bool(digits)),
        float(len(digits) >= 13 and luhn(digits)),
        float(inside.count(":")),
        float(inside.startswith("00")),
        float(len(set(digits))),
        float(bool(before[-1:].isalnum())),
        float(bool(after[:1].isalnum())),
        *(float(any(w.startswith(x) for w in near for x in CONTEXT[c])) for c in (*KINDS, "other")),
    ]


@dataclass
class Tree:
    """A regression tree in heap order; a feature of -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = self.feature[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return self.value[at]


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    size = 2 ** (DEPTH + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        g, h = gradient[rows], hessian[rows]
        tree.value[node] = g.sum() / (h.sum() + 1)
        best = (1e-6, -1, 0.0)
        if depth < DEPTH and len(rows) > 20:
            for f in range(x.shape[1]):
                order = np.argsort(x[rows, f], kind="stable")
                v, left, weight = x[rows[order], f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                gain = left**2 / (weight + 1) + (g.sum() - left) ** 2 / (h.sum() - weight + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[v[1:] == v[:-1]] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            tree.feature[node], tree.cut[node] = best[1], best[2]
            right = x[rows, best[1]] > best[2]
            todo += [(2 * node + 1, rows[~right], depth + 1), (2 * node + 2, rows[right], depth + 1)]
    return tree


@dataclass
class Boosted:
    trees: list[Tree]
    thresholds: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = sum((RATE * t(x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-total))


def examples(n: int, rng: random.Random) -> tuple[list[list[float]], list[int]]:
    """Generated proposals (in a context) and whether they are personal data."""
    filler = "the of and to in is that with for it was on as by at from la de le un que el los die der und das".split()

    def number(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word(lo: int = 3, hi: int = 9) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(lo, hi)))

    def card(valid: bool) -> str:
        body = number(15)
        last = next(d for d in "0123456789" if luhn(body + d) == valid)
        return rng.choice("./_") .join(re.findall("....", body + last))

    def phone() -> str:
        gap = rng.choice(" .-/")
        return rng.choice([f"({number(3)}){gap}{number(3)}{gap}{number(4)}", f"{number(3)}{gap}{number(3)}{gap}{number(4)}", f"00{number(2)}{gap}{number(3)}{gap}{number(3)}{gap}{number(3)}", f"0{number(3)}{gap}{number(3)}{gap}{number(3)}"])

    makers = [
        ("email", 1, lambda: f"{word()}.{word()} (at) {word()} (dot) {rng.choice(['com', 'org', 'net', 'de'])}"),
        ("email", 1, lambda: f"{word()}[at]{word()}[dot]{rng.choice(['com', 'org', 'fr', 'es'])}"),
        ("email", 1, lambda: f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}"),
        ("email", 1, lambda: f"{word()}{rng.choice(['', '.' + word()])}{rng.choice([' (at) ', '(at)', ' [at] ', '[at]', '{at}', '<at>', ' ( at ) '])}{word()}.{rng.choice(['com', 'org', 'net', 'de', 'co.uk'])}"),
        ("email", 0, lambda: f"{word()} at {word()}.{word(6, 12)}"),
        ("email", 0, lambda: f"{word()} at {word(2, 5)}.{word(2, 5)}"),
        ("email", 0, lambda: f"{word()} at {word()}.{number(2)}"),
        ("ip", 1, lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8))),
        ("ip", 1, lambda: f"{rng.randrange(0x1000, 65536):x}:{rng.randrange(65536):x}::{rng.randrange(65536):x}"),
        ("ip", 0, lambda: f"{rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}"),
        ("ip", 0, lambda: f"{rng.randrange(1, 9)}:{rng.randrange(1, 9)}:{rng.randrange(1, 9)}"),
        ("card", 1, lambda: card(True)),
        ("card", 0, lambda: card(False)),
        ("card", 1, lambda: f"{number(6)} {re.sub('[^0-9]', '', card(True))}"),
        ("card", 0, lambda: f"{number(6)} {re.sub('[^0-9]', '', card(False))}"),
        ("phone", 1, phone),
        ("phone", 0, lambda: f"{rng.randrange(1, 13)}/{rng.randrange(10, 29)}/{rng.randrange(1900, 2030)}"),
        ("phone", 0, lambda: f"{rng.randrange(1900, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}"),
        ("phone", 0, lambda: f"{number(2)} {number(2)}"),
        ("phone", 0, lambda: f"{number(3)}.{number(3)}"),
        ("phone", 0, lambda: f"{number(3)} {number(4)} {number(2)}"),
    ]
    x, y = [], []
    while len(y) < n:
        kind, label, make = rng.choice(makers)
        said = rng.choice(CONTEXT[kind]) if rng.random() < (0.4 if label else 0.05) else rng.choice(CONTEXT["other"]) if not label and rng.random() < 0.4 else ""
        lead = " ".join([*rng.choices(filler, k=4), said]).strip() + rng.choice([" ", ": ", " "])
        text = lead + make() + rng.choice([" ", ". ", ", "]) + " ".join(rng.choices(filler, k=3))
        for span in proposals(text, base_spans(text)):
            x.append(describe(text, span))
            y.append(label if KINDS[span[0]] == kind else 0)
    return x, y


@cache
def trained() -> Boosted:
    rng = random.Random(SEED)
    x, y = (np.array(a, float) for a in examples(3000, rng))
    held_x, held_y = (np.array(a, float) for a in examples(3000, rng))
    model = Boosted([], [1.0] * len(KINDS))
    for _ in range(TREES):
        p = model.scores(x)
        model.trees.append(grow(x, y - p, p * (1 - p)))
    p = model.scores(held_x)
    for k in range(len(KINDS)):
        own = held_x[:, 0] == k
        for t in np.linspace(0.5, 0.99, 50):
            chosen = own & (p >= t)
            if chosen.any() and held_y[chosen].mean() >= PRECISION:
                model.thresholds[k] = float(t)
                break
    return model


def detect(texts: list[str], model: Boosted) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text the base spans, and all spans by kind, then start."""
    bases = [base_spans(t) for t in texts]
    loose = [proposals(t, b) for t, b in zip(texts, bases, strict=True)]
    flat = [describe(t, s) for t, spans in zip(texts, loose, strict=True) for s in spans]
    scores = iter(model.scores(np.array(flat)).tolist() if flat else [])
    out = []
    for base, spans in zip(bases, loose, strict=True):
        rated = sorted(((next(scores), s) for s in spans), key=lambda x: (-x[0], x[1]))
        taken: list[tuple[int, int, int]] = []
        starts: list[int] = []
        ends: list[int] = []
        for score, (k, s, e) in rated:
            if score >= model.thresholds[k] and not touches(starts, ends, s, e):
                taken.append((k, s, e))
                insort(starts, s)
                insort(ends, e)
        out.append((base, sorted([*base, *taken])))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans; one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = detect([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([written(s) for _, s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans join."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
