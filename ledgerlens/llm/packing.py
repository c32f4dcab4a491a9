"""Packing token sequences into windows by non-negative least squares.

Every document gives its full windows and a rest shorter than a window.  Rests are only seen as a histogram of lengths.
All combinations of two or three lengths that fill a window are enumerated; repeat counts x >= 0 that bring A x nearest to
the histogram, in least squares, are found by accelerated projected gradients, then rounded so that no length is used
more often than it occurs.  What remains is packed greedily, longest first, and cut where nothing fits, so no window
but the last has room left.  The plan names ranges of ranks within each length, so its size depends on the window
alone; documents find their windows by their length and rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, materialize
from .tokens import byte_level

WINDOW = 1024
#: The plan's columns: rests of length `length` and rank in [low, high) put their ids from `start` on, `n` of them, at
#: `offset` of sequence `sequence` + rank - low.
PLAN = ["length", "start", "low", "high", "n", "sequence", "offset"]


def combinations(window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, that sum to the window; c is 0 where two lengths fill it."""
    a, b = np.divmod(np.arange(window * window), window)
    c = window - a - b
    kept = (a >= b) & (b >= c) & (c >= 0) & (b > 0)
    return np.stack([a, b, c], 1)[kept]


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, steps: int = 400, tolerance: float = 1e-7) -> np.ndarray:
    """x >= 0 with the least |A x - histogram|^2, A counting each length in each combination.

    Accelerated projected gradient steps, started anew where they overshoot; ends when a step changes x by less than
    `tolerance` of it.  Fewer steps only leave more to the greedy part.
    """
    size = len(histogram)
    used = lambda x: np.bincount(combos.ravel(), np.repeat(x, 3), size)
    gain = lambda r: np.where(combos > 0, r[combos], 0).sum(1)
    probe = np.ones(len(combos))
    for _ in range(20):
        grown = gain(used(probe) * (np.arange(size) > 0))
        norm = np.linalg.norm(grown)
        probe = grown / norm
    step = 0.95 / norm
    x = ahead = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        off = used(ahead) - histogram
        off[0] = 0
        new = np.maximum(ahead - step * gain(off), 0)
        if (ahead - new) @ (new - x) > 0:
            t = 1.0
        grown_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / grown_t * (new - x)
        moved, x, t = np.linalg.norm(new - x), new, grown_t
        if moved <= tolerance * np.linalg.norm(x):
            break
    return x


def whole_counts(x: np.ndarray, combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts near x that use no length more often than the histogram has it.

    Running sums of x are rounded, in the order of the combinations, so rounding loses nothing on the way; then each
    count is cut to what is left of its lengths.
    """
    upto = np.floor(np.cumsum(x) + 1e-9).astype(np.int64)
    wanted, left = np.diff(upto, prepend=0), histogram.astype(np.int64).copy()
    for i in np.flatnonzero(wanted):
        lengths, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
        wanted[i] = min(wanted[i], (left[lengths] // times).min())
        left[lengths] -= wanted[i] * times
    return wanted


class Stock:
    """Rests that aren't placed yet: for each length left, runs (length, low, high, start) of ranks whose ids from start on are left."""

    def __init__(self, histogram: np.ndarray) -> None:
        self.count = histogram.astype(np.int64).copy()
        self.runs: dict[int, deque] = defaultdict(deque)
        for length in np.flatnonzero(self.count):
            self.runs[int(length)].append((int(length), 0, int(self.count[length]), 0))

    def take(self, left: int, n: int) -> list[tuple[int, int, int, int]]:
        out, self.count[left] = [], self.count[left] - n
        while n:
            length, low, high, start = self.runs[left].popleft()
            k = min(n, high - low)
            out.append((length, low, low + k, start))
            if low + k < high:
                self.runs[left].appendleft((length, low + k, high, start))
            n -= k
        return out

    def give(self, left: int, run: tuple[int, int, int, int]) -> None:
        self.count[left] += run[2] - run[1]
        self.runs[left].append(run)


def plan_windows(histogram: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Counts of the rests of each length to the rows of PLAN and the number of sequences.

    The last sequence's ids go to sequences of powers of two, which take no padding.
    """
    combos = combinations(window)
    counts = whole_counts(repeat_counts(histogram.astype(float), combos), combos, histogram)
    stock, plan, sequences = Stock(histogram), [], 0

    def place(left: int, n: int, repeats: int, first: int, offset: int) -> None:
        """Places the first n ids of `repeats` rests that have `left` ids, at one offset of as many sequences."""
        at = first
        for length, low, high, start in stock.take(left, repeats):
            plan.append((length, start, low, high, n, at, offset))
            at += high - low
            if n < left:
                stock.give(left - n, (length, low, high, start + n))

    for i in np.flatnonzero(counts):
        offset = 0
        for length in combos[i][combos[i] > 0]:
            place(int(length), int(length), int(counts[i]), sequences, offset)
            offset += int(length)
        sequences += int(counts[i])
    while stock.count.any():
        have, pattern, room = stock.count.copy(), [], window
        while room and have.any():
            lengths = np.flatnonzero(have)
            fits = np.searchsorted(lengths, room, side="right")
            left = int(lengths[fits - 1] if fits else lengths[0])
            pattern.append((left, min(left, room)))
            have[left] -= 1
            room -= min(left, room)
        lengths, times = np.unique([left for left, _ in pattern], return_counts=True)
        repeats = 1 if room else int((stock.count[lengths] // times).min())
        offset = 0
        for left, n in pattern:
            if room:
                while n:  # pieces that end at the powers of two in the sum of what is left
                    total = window - room
                    end = next(e for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1 and (e := total >> b << b) > offset)
                    part, base = min(n, end - offset), end - (end & -end)
                    place(left, part, 1, sequences + bin(base).count("1"), offset - base)
                    n, left, offset = n - part, left - part, offset + part
            else:
                place(left, n, repeats, sequences, offset)
                offset += n
        sequences += bin(window - room).count("1") if room else repeats
    return np.array(plan, np.int64).reshape(-1, len(PLAN)), sequences


def _encoded(docs: DataFrame, path: str | None, window: int, keep: list[str], with_ids: bool) -> DataFrame:
    """A row a document: its token count, checksums (and ids) of its full windows, its rest, and its place among equal rests of its task."""
    import pyspark.sql.types as T

    state: list = []

    def run(batches):
        if not state:
            state.append(byte_level(path))
        encoder, seen = state[0], np.zeros(window, np.int64)
        kind, task, windows = "<u2" if encoder.size <= 1 << 16 else "<u4", TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in byte_slices(batch):
                counts, sums, full, rests, ranks, firsts = [], [], [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = np.append(encoder.encode(text or "", special=True), np.uint32(0))
                    whole = len(ids) // window
                    packed = ids.astype("<u4").tobytes()
                    counts.append(len(ids))
                    sums.append([zlib.crc32(packed[4 * window * k : 4 * window * (k + 1)]) for k in range(whole)])
                    full.append(ids[: whole * window].astype(kind).tobytes() if with_ids else None)
                    rests.append(ids[whole * window :].astype(kind).tobytes())
                    ranks.append(int(seen[len(ids) % window]))
                    firsts.append(windows)
                    seen[len(ids) % window] += 1
                    windows += whole
                n = part.num_rows
                arrays = [part.column(k) for k in keep] + [pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(full, pa.binary()), pa.array(rests, pa.binary())]
                arrays += [pa.array([c % window for c in counts], pa.int32()), pa.array(np.full(n, task, np.int32)), pa.array(ranks, pa.int64()), pa.array(firsts, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    fields = [docs.schema[k] for k in keep] + [T.StructField(n, t) for n, t in (("_tokens", T.LongType()), ("_sums", T.ArrayType(T.LongType())), ("_full", T.BinaryType()), ("_rest", T.BinaryType()), ("_length", T.IntegerType()), ("_task", T.IntegerType()), ("_rank", T.LongType()), ("_window", T.LongType()))]
    names = [f.name for f in fields]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, T.StructType(fields))


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece of a document.

    A document is its tokens and id 0; each token is in one piece and each sequence has `window` tokens, but for at most
    ten sequences of smaller powers of two that hold the end of the last one.  `keep` names the columns that stay (doc_id
    by default; they may not have the names of results); with_ids adds the ids, little-endian unsigned 32-bit numbers.
    Null and empty texts are the id 0 alone; null and repeated doc_ids and repeated rows are documents of their own;
    texts of any length take memory for one text; an empty table gives an empty result.  Texts are encoded once; their
    rests are written, counted by length and task, and numbered by the running sums of these counts.
    """
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    rows = materialize(_encoded(docs, path, window, keep, with_ids))
    counts = materialize(rows.filter("_length > 0").groupBy("_length", "_task").agg(F.count("*").alias("n")))
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("_length").agg(F.sum("n").alias("n")).collect():  # a row a length
        histogram[r["_length"]] = r["n"]
    table, sequences = plan_windows(histogram, window)
    table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
    plan = spark.sparkContext.broadcast(table)
    before = counts.select("_length", "_task", (F.sum("n").over(Window.partitionBy("_length").orderBy("_task")) - F.col("n")).alias("_before"))
    placed = rows.join(before, ["_length", "_task"], "left").fillna(0, ["_before"])
    size = byte_level(path).size

    def pieces(batches):
        of = plan.value
        # Rows of one length and start have disjoint ranges of ranks, so one search finds a rest's row.
        keys = ((of[:, 0] * window + of[:, 1]) << 40) + of[:, 2] if len(of) else np.zeros(0, np.int64)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        for batch in batches:
            length = batch.column("_length").to_numpy().astype(np.int64)
            tokens = batch.column("_tokens").to_numpy()
            rank = batch.column("_rank").to_numpy() + batch.column("_before").to_numpy()
            rests, full = batch.column("_rest").to_pylist(), batch.column("_full").to_pylist() if with_ids else None
            whole, sums = tokens // window, batch.column("_sums").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), whole)
            k = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
            first = (batch.column("_task").to_numpy().astype(np.int64) << 40) + batch.column("_window").to_numpy()
            out = [(row, k * window, np.full(len(row), window), sums, sequences + first[row] + k, np.zeros(len(row), np.int64))]
            ids = [np.frombuffer(full[r], kind)[i * window : (i + 1) * window].astype("<u4").tobytes() for r, i in zip(row, k)] if with_ids else []
            open_, start = np.flatnonzero(length), np.zeros(batch.num_rows, np.int64)
            while len(open_):
                at = np.searchsorted(keys, ((length[open_] * window + start[open_]) << 40) + rank[open_], side="right") - 1
                found = of[at]
                data = [np.frombuffer(rests[r], kind)[s : s + n].astype("<u4").tobytes() for r, s, n in zip(open_, start[open_], found[:, 4])]
                crc = np.array([zlib.crc32(x) for x in data], np.int64)
                out.append((open_, whole[open_] * window + start[open_], found[:, 4], crc, found[:, 5] + rank[open_] - found[:, 2], found[:, 6]))
                ids += data if with_ids else []
                start[open_] += found[:, 4]
                open_ = open_[start[open_] < length[open_]]
            row, *columns = (np.concatenate(x) for x in zip(*out))
            start, n, crc, sequence, offset = (pa.array(c.astype(np.int64)) for c in columns)
            kept = [batch.column(c).take(pa.array(row)) for c in keep]
            arrays = [*kept, start, n, crc, pa.array(tokens[row]), sequence, offset]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * with_ids, names)

    names = [*keep, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    schema = ", ".join([*kinds, "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"] + ["ids binary"] * with_ids)
    return placed.mapInArrow(pieces, schema)
