"""What the two n-gram classifiers share: bounded samples of labelled rows, n-gram slots, logistic regression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

_P = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, usable: Column | None = None) -> DataFrame:
    """(doc_id, text, y): about `bound` labelled documents, by a hash of doc_id, or all where there are fewer.

    Rows without a label or a doc_id are left out; of several labels for one doc_id the largest counts, of several rows
    with one doc_id the smallest text.  The chosen labels, at most about `bound` rows of two numbers, are broadcast, so
    only the chosen texts are shuffled, and no doc_id gives more than one row however often it comes.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    n = known.count()
    if n > bound:
        known = known.filter(unit_hash(F.col("doc_id"), F.lit("sample")) < bound / n)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and each text's offsets."""
    encoded = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
    return np.frombuffer(b"".join(encoded), np.uint32), offsets


def ngram_slots(codes: np.ndarray, orders: tuple[int, ...], bits: int):
    """For each order the slot of the n-gram that starts at each code point, text borders ignored."""
    h = codes * _SPREAD
    for n in range(2, max(orders) + 1):
        if len(codes) < n:
            return
        h = h[:-1] * _P + codes[n - 1 :] * _SPREAD
        if n in orders:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            yield n, x >> np.uint32(32 - bits)


def starts_inside(at: np.ndarray, n: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of n-gram starts those that end in the text where they start; and their texts."""
    rows = np.searchsorted(offsets, at, side="right") - 1
    inside = at + n <= offsets[rows + 1]
    return inside, rows


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass(frozen=True)
class SparseRows:
    """Rows of (column, value) pairs laid end to end; row i has those from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, lists: pa.ListArray, values: np.ndarray) -> SparseRows:
        return cls(lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False), values)

    def times(self, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.array([self.values[a:b] @ w[self.columns[a:b]] for a, b in zip(self.starts[rows].tolist(), self.starts[rows + 1].tolist())])


def fit_logistic(x: SparseRows, y: np.ndarray, rows: np.ndarray, size: int, penalty: float, tolerance: float = 2e-3, most: int = 1000) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L2 penalty, fitted on some rows by coordinate ascent in its dual.

    Each step solves for one row's dual variable, which lies between 0 and 1, and moves the weights along that row
    alone, so the work is in proportion to the pairs that there are.  Ends when no variable of a round moves by more
    than `tolerance`; a fit that doesn't get there in `most` rounds is an error.
    """
    w, b, unit = np.zeros(size), 0.0, 1 / (penalty * len(rows))
    dual = np.zeros(len(rows))
    starts, ends = x.starts[rows].tolist(), x.starts[rows + 1].tolist()
    signs = (2.0 * y[rows] - 1).tolist()
    curve = [(float(x.values[i:j] @ x.values[i:j]) + 1) * unit for i, j in zip(starts, ends)]
    draw = np.random.default_rng(0)
    for _ in range(most):
        moved = 0.0
        for k in draw.permutation(len(rows)).tolist():
            columns, values, sign, q = x.columns[starts[k] : ends[k]], x.values[starts[k] : ends[k]], signs[k], curve[k]
            margin, old = sign * (float(w[columns] @ values) + b), float(dual[k])
            # t + margin + q * (sigmoid(t) - old) = 0 has one root, between these two.
            low, high = -margin - q * (1 - old), -margin + q * old
            t = min(max(math.log((old + 1e-9) / (1 - old + 1e-9)), low), high)
            for _ in range(60):
                s = 1 / (1 + math.exp(-t)) if t > -700 else 0.0
                f = t + margin + q * (s - old)
                low, high = (t, high) if f < 0 else (low, t)
                new = t - f / (1 + q * s * (1 - s))
                new = new if low < new < high else (low + high) / 2
                if abs(new - t) < 1e-9:
                    break
                t = new
            s = 1 / (1 + math.exp(-t)) if t > -700 else 0.0
            step = s - old
            if step:
                dual[k] = s
                w[columns] += (step * sign * unit) * values
                b += step * sign * unit
                moved = max(moved, abs(step))
        if moved < tolerance:
            return w, b
    raise ArithmeticError(f"the fit still moves by {moved} after {most} rounds")


def fit_calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores z of rows not fitted on into probabilities, by Newton steps on softened labels."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)
