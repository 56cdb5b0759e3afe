"""Quality classifier: a support vector machine over Naive Bayes features.

A text is a set of indicators: its words, word pairs, word shapes, shape pairs
and immediate repetitions, hashed to ``1 << BITS`` bins.  Each indicator is
scaled by the ratio of its log counts in the two classes, rows are brought to
unit length, and a linear hinge-loss model is fitted by dual coordinate
descent, then drawn towards its mean weight.  A logistic curve fitted on
margins of rows left out of that fit turns margins into scores.

The fit sees a bounded sample: ``PER_CLASS`` labelled rows of each class,
chosen by a hash of the id among those that are not held out.  Scoring covers
every row and whole texts; what a task receives is the weights, 1 MB.

Defined results: a null or empty text has the constant indicator alone; ids
and other columns are never inputs; a null id is scored and not held out; a
document with several labels counts with the least; null labels are left out;
with one class or no labels at all the score is the share of label 1 (0.5 where
there are no labels); repeated rows are scored alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cache, use_cache

BITS = 18
#: Most labelled rows of each class that the fit sees.
PER_CLASS = 3_000
THRESHOLD = 0.3
FOLDS = 5
SMOOTH, COST, DRAWN = 1.0, 1.0, 0.25
EPOCHS = 12
KNOWN_WORDS = 150_000

_TIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SHAPE_BITS = np.uint64(20)
_SHIFT = np.uint64(64 - BITS)
#: Bins of the constant and of a word that repeats the one before once and twice.
_FIXED = np.array([0, 1, 2])
_RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"))


def shape(word: str) -> str:
    """Capitals, other letters and digits as A, a and 9, with runs as one; other characters stay, once each."""
    marks = ["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word[:40]]
    return "".join(c for i, c in enumerate(marks) if i == 0 or c != marks[i - 1])[:8]


class _Words(dict):
    """Of each word 44 bits of its hash, then 20 bits of its shape's; a bounded number remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        form = xxhash.xxh3_64_intdigest(shape(word.decode("utf-8", "replace"))) >> 44
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 20 << 20 | form
        return value


_words = _Words()
cache("indicators", _words.clear)


def _bins(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * _TIMES[0]
    x ^= x >> np.uint64(29)
    x *= _TIMES[1]
    return (x >> _SHIFT).astype(np.int64)


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct bins of a text."""
    found = text.encode("utf-8", "surrogatepass").split() if text else []
    if not found:
        return _FIXED[:1]
    both = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    form = both & ((np.uint64(1) << _SHAPE_BITS) - np.uint64(1))
    same = both[1:] == both[:-1]
    parts = [
        _FIXED[: 1 + bool(same.any()) + bool((same[1:] & same[:-1]).any())],
        _bins(both, 1),
        _bins(both[:-1] * _TIMES[1] + both[1:], 2),
        _bins(form, 3),
        _bins(form[:-1] * _TIMES[1] + form[1:], 4),
    ]
    return np.unique(np.concatenate(parts))


@dataclass
class QualityModel:
    """Weights of the indicators (already scaled), and the curve from margin to score."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def score(self, bins: np.ndarray) -> float:
        r = self.ratio[bins]
        margin = float(self.weight[bins].sum()) / max(float(np.sqrt((r * r).sum())), 1e-9)
        return 1 / (1 + float(np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << BITS), SMOOTH)
    for bins, y in zip(rows, labels, strict=True):
        counts[int(y), bins] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0]).astype(np.float32)


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int = 7
) -> np.ndarray:
    """Weights of least |w|^2 / 2 + sum of cost * hinge, one dual variable at a time."""
    w = np.zeros(size)
    alpha = np.zeros(len(rows))
    square = np.array([float(x @ x) for _, x in rows])
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(rows)).tolist():
            bins, x = rows[i]
            if not square[i]:
                continue
            slope = signs[i] * float(w[bins] @ x) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[bins] += step * signs[i] * x
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w


def _unit(bins: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = ratio[bins].astype(np.float64)
    return bins, x / max(float(np.sqrt(x @ x)), 1e-9)


def _logistic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps; targets are drawn in from 0 and 1 a little."""
    target = np.where(labels > 0, 1 - 1 / (2 + (labels > 0).sum()), 1 / (2 + (labels <= 0).sum()))
    x = np.stack([margins, np.ones_like(margins)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weights * (target - p)) - 1e-3 * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float) -> QualityModel:
    """``share``: the part of label 1 among all labelled rows; the sample's may differ."""
    if len(set(labels.tolist())) < 2:
        zero = np.zeros(1 << BITS, np.float32)
        p = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(zero, zero, 1.0, float(np.log(p / (1 - p))))

    def machine(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ratio = log_count_ratios([rows[i] for i in chosen], labels[chosen])
        units = [_unit(rows[i], ratio) for i in chosen]
        signs = np.where(labels[chosen] > 0, 1.0, -1.0)
        w = dual_coordinate_descent(units, signs, np.full(len(chosen), COST), 1 << BITS, EPOCHS)
        used = ratio != 0
        w[used] = (1 - DRAWN) * np.abs(w[used]).mean() + DRAWN * w[used] if DRAWN < 1 else w[used]
        return ratio, w

    fold = np.array([zlib.crc32(b"%d" % i) % 5 for i in range(len(rows))])
    ratio, w = machine(np.flatnonzero(fold != 0)) if len(set(labels[fold != 0].tolist())) == 2 else machine(np.arange(len(rows)))
    apart = np.flatnonzero(fold == 0) if len(set(labels[fold == 0].tolist())) == 2 else np.arange(len(rows))
    margins = np.array([float(w[b] @ x) for b, x in (_unit(rows[i], ratio) for i in apart)])
    y = labels[apart]
    weights = np.where(y > 0, share / max((y > 0).mean(), 1e-9), (1 - share) / max((y <= 0).mean(), 1e-9))
    slope, offset = _logistic(margins, y, weights)
    return QualityModel(ratio, (w * ratio).astype(np.float32), slope, offset)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python strings at once."""
    use_cache("indicators")
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Fits on a bounded sample of the labelled rows that are not held out.

    The sample's ids, at most about ``2 * per_class``, are broadcast.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    turn = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    chance = {y: min(1.0, per_class / n) for y, n in counts.items()}
    limit = F.when(F.col("y") == 1, int(chance.get(1, 0) * (1 << 30))).otherwise(int(chance.get(0, 0) * (1 << 30)))
    sample = known.filter(turn < limit).select("id", "y")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [indicators(t).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bins], pa.binary())], names=["id", "y", "bins"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    got = texts.join(F.broadcast(sample), "id").select("id", "y", "text").mapInArrow(featurise, "id long, y int, bins binary")
    got = sorted(((r.id, r.y, bytes(r.bins)) for r in got.toLocalIterator()))
    return fit([np.frombuffer(b, np.int32) for _, _, b in got], np.array([y for _, y, _ in got]), share)


def score_documents(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in _sliced(batches):
            scores = np.array([m.score(indicators(t)) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.record_batch([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = scored.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is under the threshold; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in _sliced(batches):
            keep = [m.score(indicators(t)) >= THRESHOLD for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # Under plain names, as a name with a dot would be taken for a field of another.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(good, plain.schema).toDF(*docs.columns)
