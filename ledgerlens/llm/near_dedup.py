"""Near duplicates by banded MinHash, odd sketches and exact checks.

1. Each document's set of distinct word shingles gives MinHash samples.  The samples' bands are its buckets, and all
   samples are folded into a parity bitmap, the odd sketch: bits of samples that two documents share cancel in the XOR
   of their sketches, so its population count tells how many samples differ.  Equal sets are one class from here on.
2. Within a bucket, classes whose sketches promise a similarity well below the threshold, or more, are tied together by
   a star from the smallest one.  Components of these ties are groups; a true link never leaves its group.
3. Within a group, the intersections of all pairs of full sets are counted exactly, and true links are tied by stars.
   The components of those are the result.

Buckets and groups are counted before they are dealt.  Those of more classes than a block holds are split into blocks,
and pairs of blocks go to different tasks, so a task holds two blocks at most and no pair is left out.  No step emits
all pairs: a pair of blocks gives at most one row a class.  Work is quadratic in the number of different texts of one
group, which are near copies of each other or chains of them, not in the number of their copies.

A link at the threshold is lost if its sets share no bucket (MISSED) or if their sketches differ in too many bits
(`sketch_miss`, 5e-7 at 85 percent and three words, 2e-6 at 80 and five).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, byte_slices, deal, materialize, mixed, text_hashes, text_key, text_sums, words_of
from .components import connected_components

ROWS, BITS = 4, 256
#: The chance that a pair at the threshold shares no bucket.
MISSED = 1e-7
#: Sketches must promise a similarity so far below the threshold at least; the exact check follows.
MARGIN = 0.25
BLOCK, BLOCK_SETS = 1024, 512

_RNG = np.random.default_rng(85)
_A = _RNG.integers(0, 1 << 31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, 1024, dtype=np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(text_column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and offsets; fewer words make one shingle."""
    data, offsets = batch_bytes(text_column)
    data = _LOWER[data]
    n = len(offsets) - 1
    starts, ends, rows = words_of(data, offsets)
    hashes = text_hashes(text_sums(data), starts, ends)
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    size = np.minimum(counts, words)
    shingles = np.maximum(counts - words + 1, np.minimum(counts, 1))
    at = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    of = np.repeat(np.arange(n), shingles)
    h = mixed(size[of].astype(np.uint64))
    for k in range(words):
        in_it = k < size[of]
        h = np.where(in_it, mixed(h ^ (hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] + np.uint64(k))) if len(hashes) else h, h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)


def set_digests(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mixed(h ^ mixed(np.full(1, salt, np.uint64))), out=sums[1:])
        out.append(mixed(sums[offsets[1:]] - sums[offsets[:-1]] + (offsets[1:] - offsets[:-1]).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def bands_for(percent: int) -> int:
    """So many bands that a pair at the threshold misses all of them with a chance of MISSED at most."""
    same = (percent / 100) ** ROWS
    return 1 if same >= 1 else min(256, math.ceil(math.log(MISSED) / math.log1p(-same)))


def bands_and_sketches(h: np.ndarray, offsets: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (n x bands) and odd sketches (n x BITS / 8 bytes) of non-empty sets."""
    n, x = len(offsets) - 1, (h >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((n, bands), np.uint64)
    bits = np.zeros((n, BITS), np.uint8)
    rows = np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(bands * ROWS):
        low = np.minimum.reduceat(x * _A[k] + _B[k], offsets[:-1]).astype(np.uint64)
        sample = mixed(low ^ np.uint64((k + 1) << 32))
        bits[rows, (sample & np.uint64(BITS - 1)).astype(np.int64)] ^= 1
        key = mixed(key ^ sample) if k % ROWS else sample
        if k % ROWS == ROWS - 1:
            keys[:, k // ROWS] = key
    return keys.view(np.int64), np.packbits(bits, axis=1)


def most_bits(percent: int) -> int:
    """The largest population count of two sketches' XOR that promises a similarity of the threshold less MARGIN.

    d samples that only one of two documents has leave about BITS / 2 * (1 - exp(-2 d / BITS)) bits, and a similarity
    of s leaves d = 2 (1 - s) samples of each.
    """
    differing = 2 * (1 - percent / 100 + MARGIN) * bands_for(percent) * ROWS
    return int(BITS / 2 * (1 - math.exp(-2 * differing / BITS)))


def sketch_miss(percent: int) -> float:
    """The chance that the sketches of a pair at the threshold differ in more bits than most_bits.

    Samples differ independently; each that does flips two of BITS bits, and the number of set bits walks up or down.
    """
    n, p, most = bands_for(percent) * ROWS, 1 - percent / 100, most_bits(percent)
    bits = np.zeros(BITS + 1)
    bits[0] = 1
    up = 1 - np.arange(BITS + 1) / BITS
    out = 0.0
    for k in range(n + 1):
        out += math.comb(n, k) * p**k * (1 - p) ** (n - k) * bits[most + 1 :].sum()
        for _ in range(2):
            new = np.zeros(BITS + 1)
            new[1:] += (bits * up)[:-1]
            new[:-1] += (bits * (1 - up))[1:]
            bits = new
    return out


def stars(near: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix the smallest index that each index is connected to."""
    labels = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        new = np.where(near, labels[None, :], len(near)).min(1)
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def tie_sketches(sketches: np.ndarray, most: int) -> np.ndarray:
    x = sketches.view(np.uint64)
    near = np.empty((len(x), len(x)), bool)
    for i in range(0, len(x), 128):
        differ = np.zeros((min(128, len(x) - i), len(x)), np.uint16)
        for w in range(x.shape[1]):
            differ += np.bitwise_count(x[i : i + 128, w, None] ^ x[None, :, w])
        near[i : i + 128] = differ <= most
    return stars(near)


def tie_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Exact: sets are linked if 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    if n == 2:
        both = int(sizes.sum() - len(np.unique(np.concatenate(sets))))
        return np.array([0, 0 if 100 * both >= percent * int(sizes.sum() - both) else 1])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1  # hashes in one set alone are in no intersection
    of = np.repeat(np.arange(n), sizes)
    keep = counts[ids] > 1
    of, ids = of[keep], shared[ids[keep]]
    order = np.argsort(ids, kind="stable")
    of, ids = of[order], ids[order]
    total = np.zeros((n, n), np.float64)
    step = max(64, (1 << 22) // n)
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):
        a, b = np.searchsorted(ids, [lo, lo + step])
        x = np.zeros((n, step), np.float32)
        x[of[a:b], ids[a:b] - lo] = 1
        total += x @ x.T
    union = sizes[:, None] + sizes[None, :] - total
    return stars(100 * total >= percent * union)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for cut in np.flatnonzero(change):
            if cut - start > 1 or held:  # a row alone has no partner
                yield pa.Table.from_batches([*held, batch.slice(start, cut - start)])
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def tie(rows: DataFrame, key: str, block: int, payload: str, link: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Edges (a, b) between nodes with equal keys, as link labels them; rows: (key, node, payload).

    Keys with more than `block` rows are counted first and dealt as pairs of blocks, so no task holds more than two
    blocks, and edges leave in batches.
    """

    def edges(batches):
        a, b, held = [], [], 0
        for group in grouped(batches, [key, "pair"]):
            if group.num_rows < 2:
                continue
            nodes = group.column("node").to_numpy()
            labels = link(group)
            tied = np.flatnonzero(labels != np.arange(len(labels)))
            a.append(nodes[labels[tied]])
            b.append(nodes[tied])
            held += len(tied)
            if held >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    dealt = deal(rows.select(key, "node", payload), [key], "node", block)
    return dealt.repartition(key, "pair").sortWithinPartitions(key, "pair", "node").mapInArrow(edges, "a long, b long")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id, kept), a row a document.

    Words are runs of other bytes than ASCII white space, A-Z in lower case.  Documents are linked if 100 times the
    intersection of their shingle sets is at least `percent` times the union.  component_id is the smallest doc_id that
    links lead to; the document that has it is kept.  Null, empty and blank texts have no shingles, are linked with
    nothing and are kept.  Equal texts are always linked; texts of any length are read whole.  Repeated rows of one
    doc_id all get a row.  Rows without doc_id are linked like others; a component_id is null only where no row of the
    component has a doc_id, and then all of its rows are kept.  doc_id may have any type that can be ordered.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    bands, most = bands_for(percent), most_bits(percent)

    def describe(batches):
        for batch in batches:
            for part in byte_slices(batch, 1 << 21):
                h, offsets = shingle_sets(part.column("text"), words)
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                k1, k2 = set_digests(h, offsets)
                keys, sketches = bands_and_sketches(h, np.append(offsets[some], len(h)), bands) if len(some) else (np.zeros((0, bands), np.int64), np.zeros((0, BITS // 8), np.uint8))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)), pa.array(keys.ravel()))
                raw = iter(sketches)
                sketch = pa.array([next(raw).tobytes() if x else None for x in n > 0], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t1"), part.column("t2"), pa.array(n), pa.array(k1), pa.array(k2), lists, sketch], ["doc_id", "t1", "t2", "n_shingles", "k1", "k2", "bands", "sketch"])

    t1, t2 = text_key(F.col("text"))
    keyed = docs.select("doc_id", "text", t1.alias("t1"), t2.alias("t2"))
    described = materialize(keyed.mapInArrow(describe, f"doc_id {kind}, t1 long, t2 long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"))
    # A class's text is that of its smallest doc_id; rows without one only serve where there is no other.
    source = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    classes = described.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min(source).alias("at"), F.first(F.struct("bands", "sketch")).alias("s"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "doc_id", "at.t1", "at.t2", "s.bands", "s.sketch"))

    buckets = classes.select(F.explode("bands").alias("bucket"), "node", "sketch")
    promises = tie(buckets, "bucket", BLOCK, "sketch", lambda g: tie_sketches(_matrix(g.column("sketch"), BITS // 8), most))
    groups = connected_components(promises)

    wanted = groups.join(classes, "node").select("node", "component", F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("doc_id").alias("of"), F.col("t1").alias("of1"), F.col("t2").alias("of2"))

    def sets(batches):
        for batch in batches:
            for part in byte_slices(batch, 1 << 21):
                h, offsets = shingle_sets(part.column("text"), words)
                k1, k2 = set_digests(h, offsets)
                own = np.flatnonzero((k1 == part.column("m1").to_numpy()) & (k2 == part.column("m2").to_numpy()))
                raw = pa.array([h[offsets[i] : offsets[i + 1]].tobytes() for i in own], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("component").take(pa.array(own)), part.column("node").take(pa.array(own)), raw], ["component", "node", "hashes"])

    # The same plan at every size: texts of many groups are too much to broadcast.  Texts meet their class by digest and id.
    own = (F.col("t1") == F.col("of1")) & (F.col("t2") == F.col("of2")) & F.col("doc_id").eqNullSafe(F.col("of"))
    texts = keyed.join(wanted.hint("merge"), own).select("text", "node", "component", "m1", "m2")
    full = materialize(texts.mapInArrow(sets, "component long, node long, hashes binary").dropDuplicates(["node"]))
    links = tie(full, "component", BLOCK_SETS, "hashes", lambda g: tie_sets([np.frombuffer(x, np.uint64) for x in g.column("hashes").to_pylist()], percent))
    linked = connected_components(links)

    labelled = classes.join(linked, "node", "left").select("k1", "k2", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(smallest, "component").select("k1", "k2", "component_id")
    rows = described.select("doc_id", "n_shingles", "k1", "k2")
    out = rows.join(named, ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
