"""Quality rules: plain counts of a text, then a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, byte_slices, mixed, sums_by_row, text_hashes, text_sums, words_of
from .linear import SparseRows, code_points, fit_calibration, fit_logistic, labelled_sample, ngram_slots, sigmoid, starts_inside

CHAR_ORDERS, CHAR_BITS, WORD_BITS, SLOT_BITS = (2, 3), 12, 11, 13
PENALTY = 0.1
#: About so many labelled rows are fitted on; one in CALIBRATE of them is kept for the calibration.
SAMPLE, CALIBRATE = 3000, 3
#: A text stays if the calibrated probability that it is good is as high as this.
THRESHOLD = 0.35
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def base_counts(text_column) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of an Arrow column."""
    data, offsets = batch_bytes(text_column)
    n = len(offsets) - 1
    starts, ends, rows = words_of(data, offsets)
    sums = text_sums(data)
    words = text_hashes(sums, starts, ends)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    out = {
        "n_words": np.bincount(rows, minlength=n).astype(np.int64),
        "word_chars": sums_by_row(lead[ends] - lead[starts], rows, n),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
    }
    # Lines: between line feeds and the borders of texts; those with a word count.
    cuts = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    line_starts = line_starts[line_starts < len(data)]
    # The line feed before the next start belongs to no line; a border between texts removes nothing.
    nexts = np.append(line_starts[1:], len(data))
    line_ends = nexts - ((nexts > line_starts) & (data[nexts - 1] == 10)) if len(nexts) else nexts
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
    keys = text_hashes(sums, line_starts, line_ends) ^ mixed(line_rows.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_rows, minlength=n) - np.bincount(line_rows[first], minlength=n)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(words) >= WINDOW:
        last = len(words) - WINDOW + 1
        keys = mixed(rows[:last].astype(np.uint64) + np.uint64(1))
        for k in range(WINDOW):
            keys = mixed(keys ^ words[k : k + last])
        at = np.flatnonzero(rows[:last] == rows[WINDOW - 1 :])
        order = at[np.argsort(keys[at], kind="stable")]
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, order[twice], 1)
        np.add.at(edge, order[twice] + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n).astype(np.int64)
    out["_words"], out["_rows"] = words, rows
    return out


@dataclass(frozen=True)
class QualityModel:
    char_weights: np.ndarray
    word_weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, texts: list[str], words: np.ndarray, word_rows: np.ndarray) -> np.ndarray:
        n = len(texts)
        codes, offsets = code_points(texts)
        z, total = np.zeros(n), np.zeros(n)
        for k, slots in ngram_slots(codes, CHAR_ORDERS, CHAR_BITS):
            # A running sum gives each text's sum without looking at single n-grams again.
            sums = np.zeros(len(slots) + 1)
            np.cumsum(self.char_weights[slots], out=sums[1:])
            last = np.maximum(offsets[:-1], np.minimum(offsets[1:] - k + 1, len(slots)))
            first = np.minimum(offsets[:-1], len(slots))
            z += sums[np.minimum(last, len(slots))] - sums[first]
            total += np.maximum(offsets[1:] - offsets[:-1] - k + 1, 0)
        z = z / np.maximum(total, 1)
        if len(words):
            w = np.bincount(word_rows, weights=self.word_weights[(words >> np.uint64(64 - WORD_BITS)).astype(np.int64)], minlength=n)
            z += w / np.maximum(np.bincount(word_rows, minlength=n), 1)
        return sigmoid(self.slope * (z + self.bias) + self.offset)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, penalty: float = PENALTY) -> QualityModel:
    """Fits on about `sample` labelled rows, one a doc_id, whole texts; one third of them, by a hash, calibrates.

    Features are the shares of hashed character n-grams and of hashed words, each over its spread among the fitted
    rows.  Executors count; the driver gets the slots that each of the `sample` texts has and their counts, at most
    2**CHAR_BITS + 2**WORD_BITS a text however long it is, and fits on these pairs.  Rows without doc_id or label are
    left out, null texts count as empty.  Without rows of both labels every text is kept.
    """

    def count(batches):
        for batch in batches:
            for part in byte_slices(batch):
                base = base_counts(part.column("text"))
                codes, offsets = code_points(part.column("text").to_pylist())
                keys = []
                for k, slots in ngram_slots(codes, CHAR_ORDERS, CHAR_BITS):
                    inside, rows = starts_inside(np.arange(len(slots)), k, offsets)
                    keys.append((rows[inside] << SLOT_BITS) | slots[inside])
                words = (base["_words"] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
                keys.append((base["_rows"] << SLOT_BITS) | (words + (1 << CHAR_BITS)))
                keys, counts = np.unique(np.concatenate(keys), return_counts=True)
                ends = pa.array(np.searchsorted(keys >> SLOT_BITS, np.arange(part.num_rows + 1)).astype(np.int32))
                slots = pa.ListArray.from_arrays(ends, pa.array((keys & ((1 << SLOT_BITS) - 1)).astype(np.int16)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), slots, pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))], ["doc_id", "y", "slots", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = labelled_sample(docs, labels, label, sample).select("doc_id", "text", "y")
    got = rows.mapInArrow(count, f"doc_id {kind}, y int, slots array<smallint>, counts array<int>").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE))).orderBy("doc_id").select("y", "slots", "counts", "fold").toArrow()
    size = (1 << CHAR_BITS) + (1 << WORD_BITS)
    y, fold = got.column("y").to_numpy().astype(np.float32), got.column("fold").to_numpy()
    if len(np.unique(y)) < 2:
        return QualityModel(np.zeros(1 << CHAR_BITS, np.float32), np.zeros(1 << WORD_BITS, np.float32), 20.0)
    lists = got.column("slots").combine_chunks()
    counts = got.column("counts").combine_chunks().flatten().to_numpy().astype(np.float32)
    del got
    x = SparseRows.of(lists, counts)
    x = SparseRows(x.starts, x.columns.astype(np.int32), counts)
    of = np.repeat(np.arange(len(y)), np.diff(x.starts))
    kind_of = 2 * of + (x.columns >= 1 << CHAR_BITS)
    x.values[:] /= np.bincount(kind_of, weights=x.values, minlength=2 * len(y))[kind_of]
    fit, rest = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[rest])) < 2:
        fit = rest = np.arange(len(y))
    used = np.isin(of, fit)
    mean = np.bincount(x.columns[used], weights=x.values[used], minlength=size) / len(fit)
    square = np.bincount(x.columns[used], weights=np.square(x.values[used], dtype=np.float64), minlength=size) / len(fit)
    scale = 1 / (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-4)
    x.values[:] *= scale[x.columns]
    w, b = fit_logistic(x, y, fit, size, penalty)
    slope, offset = fit_calibration(x.times(w, rest) + b, y[rest])
    w = (w * scale).astype(np.float32)
    return QualityModel(w[: 1 << CHAR_BITS], w[1 << CHAR_BITS :], b, max(slope, 1e-3), offset)


def rate_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept), by text alone.

    Null and empty texts have no words and fail.  With keep_text, all columns of docs stay and the results follow in a
    struct `quality`, so that their names can't clash.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    result = ", ".join(f"{x}: bigint" for x in names) + ", base_failed: boolean, probability: double, kept: boolean"

    def rate(batches):
        for batch in batches:
            for part in byte_slices(batch):
                base = base_counts(part.column("text"))
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                p = model.probability([t or "" for t in part.column("text").to_pylist()], base["_words"], base["_rows"])
                columns = [pa.array(base[x]) for x in names] + [pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                struct = pa.StructArray.from_arrays(columns, [*names, "base_failed", "probability", "kept"])
                rest = [part.column(i) for i in range(part.num_columns)] if keep_text else [part.column("doc_id")]
                yield pa.RecordBatch.from_arrays([*rest, struct], [*(part.schema.names if keep_text else ["doc_id"]), "quality"])

    if keep_text:
        if "quality" in docs.columns:
            docs = docs.drop("quality")
        return docs.mapInArrow(rate, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", quality struct<{result}>")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, quality struct<{result}>").select("doc_id", "quality.*")
