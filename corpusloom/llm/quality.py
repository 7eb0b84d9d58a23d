"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed document statistics (lengths on log
scales, shares on logit scales).  Per class a mean and a covariance are fitted,
the covariance shrunk toward the pooled one and its diagonal; a text's score is
the logistic of the difference of log densities, with squared Mahalanobis
distances solved by the classes' cached Cholesky factors.

The fit uses at most SAMPLE labels and as many rows that have them (those with
the smallest hash of the id, then in the order of id, label and statistics);
scoring reads every whole text once.  Shrinkage and temperature are chosen
on a third of that sample that the covariances did not see.

Defined cases: null and empty texts are scored like any vector of zeros;
without labels of both classes every score is 0.5 or the one class; a null
quality or doc_id teaches nothing; a very long text is one vector like others;
repeated rows each get a row, and teach each; an empty table gives an empty
result; other columns (labels, lang, source) are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, trimmed

SAMPLE = 20_000
#: Shares of the class's own covariance, the pooled one and the diagonal to try.
SHRINKAGE = ((0.9, 0.08, 0.02), (0.7, 0.2, 0.1), (0.4, 0.4, 0.2), (0.1, 0.7, 0.2))
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0)
STATISTICS = (
    "words", "word_length", "upper", "digits", "symbols", "stops", "spaces", "high_bytes",
    "distinct_words", "top_word", "lines", "repeated_lines", "shouted", "marked", "repeated_pairs",
)
_CLASSES = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _kind = 0 if "A" <= _c <= "Z" else 1 if "0" <= _c <= "9" else 3 if _c in ".,;:'\"-()" else 4 if _c in " \t\n\r\x0b\x0c" else 5 if _b >= 128 else 2 if not ("a" <= _c <= "z") else None
    if _kind is not None:
        _CLASSES[_b, _kind] = 1


def _share(part: float, whole: float) -> float:
    """A share on a logit scale, finite at both ends."""
    return float(np.log((part + 0.1) / (whole - part + 0.1))) if whole else 0.0


def statistics(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    upper, digits, symbols, stops, spaces, high = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES).tolist()
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    pairs = len(set(zip(words, words[1:], strict=False)))
    scale = min(n, 200)  # shares say no more than so many words would
    return [
        float(np.log1p(n)),
        (size - spaces) / n,
        _share(upper / size * scale, scale),
        _share(digits / size * scale, scale),
        _share(symbols / size * scale, scale),
        _share(stops / size * scale, scale),
        _share(spaces / size * scale, scale),
        _share(high / size * scale, scale),
        float(np.log(len(counts) / n)),
        _share(max(counts.values()) / n * scale, scale),
        float(np.log1p(len(lines))),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(sum(map(bytes.isupper, words)) / n * scale, scale),
        _share(_CLASSES[ends, 2].sum() / n * scale, scale),
        float(np.log((pairs + 1) / n)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """``_row`` columns of docs are not needed: (doc_id, x) for each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(measure), "doc_id bigint, x array<double>")


def forward_substitution(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of lower x = b for a lower triangular matrix, column by column of b at once."""
    x = np.empty_like(b)
    for k in range(len(lower)):
        x[k] = (b[k] - lower[k, :k] @ x[:k]) / lower[k, k]
    return x


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: list[np.ndarray]  # Cholesky factors of the classes' covariances
    priors: np.ndarray
    temperature: float = 1.0

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        out = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            solved = forward_substitution(factor, (z - mean).T)
            out.append(-0.5 * (solved**2).sum(0) - np.log(np.diag(factor)).sum())
        return np.stack(out, 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        logs = self.log_densities(x)
        odds = (logs[:, 1] - logs[:, 0]) / self.temperature + np.log(self.priors[1] / self.priors[0])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


@dataclass
class Constant:
    value: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _fit(x: np.ndarray, y: np.ndarray, shrinkage: tuple[float, float, float]) -> Discriminant:
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - centre) / scale
    means = np.stack([z[y == c].mean(0) for c in (0, 1)])
    own = [np.cov(z[y == c].T, bias=True) if (y == c).sum() > 1 else np.eye(x.shape[1]) for c in (0, 1)]
    pooled = sum(o * (y == c).mean() for c, o in enumerate(own))
    a, b, d = shrinkage
    factors = []
    for o in own:
        sigma = a * o + b * pooled + d * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(o))
        factors.append(np.linalg.cholesky(sigma))
    priors = np.array([(y == c).mean() for c in (0, 1)])
    return Discriminant(centre, scale, means, factors, priors)


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | Constant:
    """The discriminant, its shrinkage and temperature chosen on every third row."""
    if len(set(y.tolist())) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    part = np.arange(len(y)) % 3 == 2
    best = (np.inf, SHRINKAGE[1], TEMPERATURES[1])
    if len(set(y[~part].tolist())) == 2 and part.any():
        for shrinkage in SHRINKAGE:
            model = _fit(x[~part], y[~part], shrinkage)
            for model.temperature in TEMPERATURES:
                p = np.clip(model.scores(x[part]), 1e-6, 1 - 1e-6)
                loss = float(-(y[part] * np.log(p) + (1 - y[part]) * np.log(1 - p)).mean())
                best = min(best, (loss, shrinkage, model.temperature))
    model = _fit(x, y, best[1])
    model.temperature = best[2]
    return model


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of at most SAMPLE labels of the training folds: those with the smallest hashes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & (crc_mod("doc_id", 3) != 1))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)


def train(measured: DataFrame, few: DataFrame) -> Discriminant | Constant:
    """Fit on measured documents (doc_id, x) that have a label in ``few``; where ids repeat, on the first SAMPLE rows in order."""
    rows = measured.join(F.broadcast(few), "doc_id").select("doc_id", "x", "quality")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(SAMPLE).collect()
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(STATISTICS)), np.array([r.quality for r in rows], int))


def score(measured: DataFrame, model: Discriminant | Constant) -> DataFrame:
    """(doc_id, score) of measured documents."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x), pa.float64())], ["doc_id", "score"])

    return measured.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row for each row of ``docs``."""
    measured = cut(features(docs))
    scored = score(measured, train(measured, known_labels(labels)))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    few = cut(known_labels(labels))
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few.select("doc_id").distinct()), "doc_id", "left_semi")
    model = train(features(taught), few)  # only labelled rows are measured for the fit
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts):
        import pandas as pd

        return pd.Series(shared.value.scores(np.array([statistics((t or "").encode()) for t in texts]).reshape(len(texts), len(STATISTICS))))

    return docs.filter(judge(F.col("text").cast("string")) >= 0.5)
