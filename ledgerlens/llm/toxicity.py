"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices
from .linear import SparseRows, code_points, fit_logistic, labelled_sample, ngram_slots, sigmoid

ORDERS = (4, 5, 6)
BITS = 20
#: About so many labelled rows are fitted on.
SAMPLE = 4000
PENALTY = 1e-3
THRESHOLD = 0.3
#: Bytes of text that an executor takes apart at once.
SLICE = 1 << 20


@dataclass(frozen=True)
class ToxicityModel:
    """A weight for each slot of an n-gram's hash."""

    weights: np.ndarray
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS


def distinct_slots(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct n-grams of each text, by row."""
    codes, offsets = code_points([t.lower() for t in texts])
    found = [np.zeros(0, np.int64)]
    rows = np.repeat(np.arange(len(texts)) << bits, np.diff(offsets))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for n, slots in ngram_slots(codes, orders, bits):
        inside = np.arange(n, len(codes) + 1) <= ends[: len(slots)]
        found.append((rows[: len(slots)] | slots)[inside])
    keys = np.sort(np.concatenate(found))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys >> bits, keys & ((1 << bits) - 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable=None, sample: int = SAMPLE, orders: tuple[int, ...] = ORDERS, bits: int = BITS, penalty: float = PENALTY) -> ToxicityModel:
    """Fits on about `sample` labelled rows, one a doc_id, whole texts; every n-gram of theirs counts.

    An n-gram counts once a text.  Its log-count ratio is r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)), p of P
    toxic and q of Q other texts having it; its feature is r.  Executors take the texts apart; the driver gets the
    distinct slots of each of the `sample` texts, 2**bits at most, and fits on them.  Rows without doc_id or label are
    left out, null texts count as empty.  Without rows of both labels the model is the constant base rate.
    """
    rows = labelled_sample(docs, labels, label, sample, usable).select("doc_id", "text", "y")

    def extract(batches):
        for batch in batches:
            for part in byte_slices(batch, SLICE):
                at, found = distinct_slots(part.column("text").to_pylist(), orders, bits)
                ends = np.searchsorted(at, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists], ["doc_id", "y", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(extract, f"doc_id {kind}, y int, f array<int>").orderBy("doc_id").select("y", "f").toArrow()
    y = got.column("y").to_numpy().astype(np.float32)
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return ToxicityModel(np.zeros(1 << bits, np.float32), float(np.log((pos + 0.5) / (neg + 10))), orders, bits)
    lists = got.column("f").combine_chunks()
    del got
    x = SparseRows.of(lists, np.zeros(0, np.float32))
    of_toxic = np.repeat(y > 0, np.diff(x.starts))
    p, q = (np.bincount(x.columns[side], minlength=1 << bits) for side in (of_toxic, ~of_toxic))
    r = (np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (neg + 2))).astype(np.float32)
    del of_toxic, p, q
    x = SparseRows(x.starts, x.columns, r[x.columns])
    w, b = fit_logistic(x, y, np.arange(len(y)), 1 << bits, penalty)
    return ToxicityModel((w * r).astype(np.float32), b, orders, bits)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), a row a row of (doc_id, text); text alone decides.

    Null texts count as empty, and an empty text gets the score of the bias; a text of any length is taken apart as a
    whole.  Null and repeated doc_ids pass through; an empty table gives an empty result.  The model is 2**bits numbers,
    whatever it was fitted on, and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    bias, orders, bits = model.bias, model.orders, model.bits

    def score(batches):
        weights = shared.value
        for batch in batches:
            for part in byte_slices(batch, SLICE):
                at, slots = distinct_slots([t or "" for t in part.column("text").to_pylist()], orders, bits)
                s = sigmoid(np.bincount(at, weights=weights[slots], minlength=part.num_rows) + bias)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, predicted int")
