"""Repeated substrings by sorting suffixes that start at content-chosen anchors.

A byte goes if a string of `length` bytes that covers it also starts elsewhere.  Not all suffixes are sorted:

1. Each string of `length` bytes has one anchor, the leftmost smallest hash among its ANCHOR-byte parts.  Equal strings
   have the same anchor at the same offset, so only anchors with equal parts need comparing.  An anchor stands for
   the run of strings that chose it; about one in eighty positions is one.
2. Anchors with equal parts and equal spans, the bytes of all their strings, are one suffix that stands several times:
   all of their strings are repeated, and one of them is sorted with the others.
3. Where a part has different spans, their suffixes are sorted deep-shallow: multikey quicksort down to a shallow depth
   splits them by eight bytes at a time, and blind tries order what still shares a longer prefix.  Neighbours' common
   prefixes bound what follows the anchor, hashes of what precedes it the rest; a string is repeated if another suffix
   shares both.

A string has half of its other bytes at least before or behind its anchor, so step 3 gathers suffixes by part and half a
string behind, or by part and half a string before it.  Whatever is gathered more than BLOCK times is dealt in pairs of
blocks, and spans and parts that stand more than HOT times are counted before they are shuffled and split.  No task
holds more than two blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, batch_bytes, bucket_count, byte_slices, deal, materialize, mixed, prefix_sums, range_hashes, text_key, with_parts, write_buckets
from .near_dedup import grouped

ANCHOR = 40
#: Bytes that multikey quicksort looks at behind those that are known to be equal.
SHALLOW = 24
BLOCK, HOT = 4096, 2000
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, position, part hash, span hash, and largest and smallest offset of each anchor's strings."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 6
    sums = prefix_sums(data)
    _, down = POWERS.until(len(sums))
    part = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(sums) - ANCHOR])
    at = np.arange(len(part), dtype=np.uint64)
    best = (window_minima((part & np.uint64(0xFFFFFFFF00000000)) | at, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(best))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
    inside = starts + length <= offsets[rows + 1]
    starts, best, rows = starts[inside], best[inside], rows[inside]
    if not len(starts):
        return (none,) * 6
    new = np.ones(len(starts), bool)
    new[1:] = (best[1:] != best[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    row, pos, low, high = rows[first], best[first], starts[first], starts[last]
    span = range_hashes(sums, low, high + length)
    span = mixed(span ^ (((pos - low) << 8) | (pos - high)).astype(np.uint64))
    return row, pos - offsets[row], part[pos], span, pos - low, pos - high


class BlindTrie:
    """Orders byte strings: inner nodes hold the depth at which strings below differ and the bytes they have there."""

    def __init__(self) -> None:
        self.root = None
        self.strings: list[bytes] = []

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
        if a == b:
            return n
        return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, s: bytes) -> None:
        """A leaf is a list of the numbers of equal strings, an inner node a (depth, {byte: node})."""
        number = len(self.strings)
        self.strings.append(s)
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly: bytes between branches aren't looked at
            kids = node[1]
            node = kids.get(self._byte(s, node[0])) or next(iter(kids.values()))
        other = self.strings[node[0]]
        depth = self.common(s, other)
        if depth == len(s) == len(other):
            node.append(number)
            return
        above, byte, node = None, 0, self.root
        while isinstance(node, tuple) and node[0] <= depth:
            if node[0] == depth:
                node[1][self._byte(s, depth)] = [number]
                return
            above, byte = node, self._byte(s, node[0])
            node = node[1][byte]
        branch = (depth, {self._byte(other, depth): node, self._byte(s, depth): [number]})
        if above is None:
            self.root = branch
        else:
            above[1][byte] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(kid for _, kid in sorted(node[1].items(), reverse=True))
            else:
                out.extend(node)
        return out


def multikey_quicksort(groups: np.ndarray, words: np.ndarray, depth: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words within ascending groups, and where each run of rows equal up to word `last` starts in it.

    All segments are split at once, round by round: those below their pivot's word, equal to it, and above; equal ones
    go on with the next word.  depth and last hold the first and the end word of each row, equal within a group.
    """
    order, start = np.arange(len(groups)), np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1])[np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]]))]
    depth = depth.copy()
    while True:
        size = np.bincount(start, minlength=len(start))[start]
        at = np.flatnonzero((size > 1) & (depth < last))
        if not len(at):
            return order, start
        own = words[order[at], depth[at]]
        pivot = words[order[start[at] + size[at] // 2], depth[at]]
        side = (own > pivot).astype(np.int64) - (own < pivot) + 1
        key = start[at] * 3 + side
        by = np.argsort(key, kind="stable")
        order[at], key = order[at[by]], key[by]
        change = np.concatenate([[True], key[1:] != key[:-1]])
        start[at] = at[np.flatnonzero(change)][np.cumsum(change) - 1]
        depth[at] = depth[at] + (key % 3 == 1)


def deep_shallow_order(groups: np.ndarray, suffixes: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The order of suffixes (zero-padded rows) within ascending groups, whose rows share their first `known` bytes."""
    words = np.ascontiguousarray(suffixes).view(">u8").astype(np.uint64)
    first = np.minimum(known // 8, words.shape[1])
    order, start = multikey_quicksort(groups, words, first, np.minimum(first + SHALLOW // 8, words.shape[1]))
    lows, sizes = np.unique(start, return_counts=True)
    for low, n in zip(lows[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        trie, some = BlindTrie(), order[low : low + n].copy()
        for i in some:
            trie.add(suffixes[i, : lengths[i]].tobytes())
        order[low : low + n] = some[trie.ordered()]
    return order


def repeated_offsets(groups: np.ndarray, spans: list[bytes], most: np.ndarray, least: np.ndarray, known: np.ndarray, length: int) -> np.ndarray:
    """Which strings of each anchor (rows), by offset (columns), start elsewhere in the anchor's group as well."""
    n, width = len(groups), length - ANCHOR + 1
    sizes = np.fromiter(map(len, spans), np.int64, n)
    flat = np.frombuffer(b"".join(spans), np.uint8)
    starts = np.cumsum(sizes) - sizes
    column = np.arange(-(-length // 8) * 8)
    follow = sizes - most
    where = starts[:, None] + most[:, None] + column[None, :]
    inside = column[None, :] < follow[:, None]
    suffixes = np.where(inside, flat[np.minimum(where, len(flat) - 1)], 0).astype(np.uint8)
    order = deep_shallow_order(groups, suffixes, follow, known)
    a, b = suffixes[order[:-1]], suffixes[order[1:]]
    differ = a != b
    shared = np.where(differ.any(1), differ.argmax(1), column[-1] + 1)
    shared = np.minimum(shared, np.minimum(follow[order[:-1]], follow[order[1:]]))
    shared[groups[order[:-1]] != groups[order[1:]]] = -1
    # before[i, o]: a hash of the o bytes before the anchor.
    back = np.arange(1, width)
    where = starts[:, None] + most[:, None] - back[None, :]
    up, _ = POWERS.until(width + 1)
    terms = np.where(back[None, :] <= most[:, None], _CODES[flat[np.maximum(where, 0)]] * up[back][None, :], np.uint64(0))
    before = np.zeros((n, width), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    out = np.zeros((n, width), bool)
    for o in range(int(least.min()), min(int(most.max()), width - 1) + 1):
        run = np.zeros(n, np.uint64)
        run[1:] = np.cumsum(shared < length - o)
        runs = np.empty(n, np.uint64)
        runs[order] = run
        at = np.flatnonzero((least <= o) & (o <= most))
        keys = mixed(mixed(runs[at] + np.uint64(1)) ^ before[at, o])
        by = np.argsort(keys, kind="stable")
        same = keys[by][1:] == keys[by][:-1]
        twice = np.zeros(len(at), bool)
        twice[by[1:]] |= same
        twice[by[:-1]] |= same
        out[at[twice], o] = True
    return out


def _pack(pos, most, least):
    return (pos << 16) | (most << 8) | least


def find_repeats(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, spots: [(low, high)]) of distinct texts' bytes that strings repeated within or between texts cover."""

    def scan(batches):
        for batch in batches:
            for part in byte_slices(batch, 1 << 21):
                row, pos, kind, span, most, least = anchors(*batch_bytes(part.column("text")), length)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(kind.view(np.int64)), pa.array(span.view(np.int64)), part.column("k1").take(at), part.column("k2").take(at), pa.array(_pack(pos, most, least))], ["part", "span", "k1", "k2", "spot"])

    found = texts.select("k1", "k2", "text").mapInArrow(scan, "part long, span long, k1 long, k2 long, spot long")

    # Counted first: spans that stand very often, and parts that have very many other rows.
    counts = found.groupBy("part", "span").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") > HOT).select("part", "span", "n")
    wide = counts.filter(F.col("n") <= HOT).groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT)
    large = materialize(often.unionByName(wide, allowMissingColumns=True).withColumn("_parts", F.ceil(F.col("n") / HOT).cast("int")))
    spans = large.filter("span is not null").select("part", "span", "_parts")
    parts = materialize(large.groupBy("part").agg(F.greatest(F.max(F.when(F.col("span").isNull(), F.col("_parts"))), F.lit(2)).alias("_parts")))
    marked = with_parts(with_parts(found, spans, spans.count(), ["part", "span"], "k1"), parts, parts.count(), ["part"], "k1", "wide")
    # Rows of a frequent span are settled wherever they go; the first in each place goes on as well, and so do all other
    # spans of its part.
    sub = F.when(F.col("parts") > 1, -1 - F.pmod(F.xxhash64("k1", "spot"), F.col("parts"))).otherwise(F.pmod("span", F.col("wide"))).cast("int")
    dealt = marked.select("part", sub.alias("sub"), "span", "k1", "k2", "spot", (F.col("wide") > 1).alias("many"))

    def settle(batches):
        """Rows in the order of (part, sub, span): `open` is false for strings that are settled, true for spans to compare."""
        last, pending, seen = None, None, 0  # the last row, and the first span of its part while no second one came
        names = ["k1", "k2", "spot", "part"]

        def sequence():
            held = None
            for batch in batches:
                if batch.num_rows:
                    if held is not None:
                        yield held, batch
                    held = batch
            if held is not None:
                yield held, None

        def key(batch, i):
            return tuple(batch.column(c)[i].as_py() for c in ("part", "sub"))

        for batch, after in sequence():
            part, sub, span = (batch.column(c).to_numpy() for c in ("part", "sub", "span"))
            many = batch.column("many").to_numpy(zero_copy_only=False)
            n = len(part)
            same_part, same_span = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            same_part[1:n] = (part[1:] == part[:-1]) & (sub[1:] == sub[:-1])
            same_span[1:n] = same_part[1:n] & (span[1:] == span[:-1])
            if last is not None:
                same_part[0] = last[0] == (part[0], sub[0])
                same_span[0] = same_part[0] and last[1] == span[0]
            if after is not None:
                same_part[n] = key(after, 0) == (part[-1], sub[-1])
                same_span[n] = same_part[n] and after.column("span")[0].as_py() == span[-1]
            settled = np.flatnonzero(same_span[:n] | same_span[1:] | (sub < 0))
            group = np.cumsum(~same_part[:n])
            group -= group[0]
            leads = np.flatnonzero(~same_span[:n])
            of = group[leads]
            count = np.bincount(of, minlength=int(group[-1]) + 1)
            base = seen if same_part[0] else 0
            count[0] += base
            compare = leads[(count[of] > 1) | many[leads]]
            held_over = pending if base == 1 and count[0] > 1 else None
            seen = int(count[-1])
            if group[-1] or not same_part[0]:
                in_last = leads[of == group[-1]]
                pending = batch.slice(int(in_last[0]), 1) if seen == 1 and not many[in_last[0]] else None
            elif seen > 1:
                pending = None
            elif base == 0 and seen == 1:
                pending = None if many[leads[0]] else batch.slice(int(leads[0]), 1)
            last = ((part[-1], sub[-1]), span[-1])
            for rows, open_ in ((settled, False), (compare, True)):
                if len(rows):
                    some = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*(some.column(x) for x in names), pa.array(np.full(len(rows), open_))], [*names, "open"])
            if held_over is not None:
                yield pa.RecordBatch.from_arrays([*(held_over.column(x) for x in names), pa.array([True])], [*names, "open"])

    spots = dealt.repartition("part", "sub").sortWithinPartitions("part", "sub", "span").mapInArrow(settle, "k1 long, k2 long, spot long, part long, open boolean")
    # One row a text from here on; its anchors are bounded by its own length.
    spots = spots.select("k1", "k2", F.struct("spot", F.when(F.col("open"), F.col("part")).alias("part")).alias("spot")).groupBy("k1", "k2").agg(F.collect_list("spot").alias("spots"))
    half = (length - ANCHOR) // 2

    def cut(batches):
        """Settled ranges (kind 0), and spans to compare with their bytes: those for strings that share half a string behind
        the anchor (kind 1), or before it (kind 2)."""
        for batch in batches:
            for piece in byte_slices(batch, 1 << 21):
                data, offsets = batch_bytes(piece.column("text"))
                raw, sums = data.tobytes(), prefix_sums(data)
                lists = piece.column("spots")
                flat, at = lists.flatten(), lists.offsets.to_numpy()
                row = np.repeat(np.arange(piece.num_rows), np.diff(at))
                spot = flat.field("spot").to_numpy()
                open_ = flat.field("part").is_valid().to_numpy(zero_copy_only=False)
                pos, most, least = spot >> 16, (spot >> 8) & 255, spot & 255
                k1, k2 = piece.column("k1"), piece.column("k2")

                def rows(kind, at_rows, key, low, high, bytes_, k1=k1, k2=k2):
                    n, of = len(at_rows), pa.array(at_rows)
                    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), key, k1.take(of), k2.take(of), pa.array(low), pa.array(high), bytes_], ["kind", "key", "k1", "k2", "low", "high", "bytes"])

                done = np.flatnonzero(~open_)
                if len(done):
                    # Ranges of one text that touch become one before they travel.
                    low, high, of = (pos - most)[done], (pos - least)[done] + length, row[done]
                    low, high, of = union(low, high, of)
                    yield rows(0, of, pa.nulls(len(of), pa.int64()), low, high, pa.nulls(len(of), pa.binary()))
                for kind, some in ((1, np.flatnonzero(open_ & (least <= half))), (2, np.flatnonzero(open_ & (most > half)))):
                    if not len(some):
                        continue
                    far = np.minimum(most[some], half) if kind == 1 else most[some]
                    near = least[some] if kind == 1 else np.maximum(least[some], half + 1)
                    anchor = offsets[row[some]] + pos[some]
                    keys = range_hashes(sums, anchor, anchor + length - half) if kind == 1 else range_hashes(sums, anchor - half - 1, anchor + ANCHOR)
                    low, high = anchor - far, anchor - near + length
                    bytes_ = pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary())
                    yield rows(kind, row[some], pa.array(mixed(keys + np.uint64(kind)).view(np.int64)), _pack(pos[some], far, near), np.zeros(len(some), np.int64), bytes_)

    pieces = materialize(texts.select("k1", "k2", "text").join(spots, ["k1", "k2"]).select("k1", "k2", "text", "spots").mapInArrow(cut, "kind int, key long, k1 long, k2 long, low long, high long, bytes binary"))

    def compare(batches):
        def ranges(tables):
            """The repeated strings of whole groups, many groups at once."""
            table = pa.concat_tables(tables)
            key, pair, spot, kind = (table.column(c).to_numpy() for c in ("key", "pair", "low", "kind"))
            groups = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
            pos, most, least = spot >> 16, (spot >> 8) & 255, spot & 255
            hit = np.zeros((len(pos), length - ANCHOR + 3), np.int8)
            known = np.where(kind == 1, length - half, ANCHOR)
            hit[:, 1:-1] = repeated_offsets(groups, table.column("bytes").to_pylist(), most, least, known, length)
            edge = np.diff(hit, axis=1)
            row, first = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)  # runs come in the same order
            of = pa.array(row)
            return pa.RecordBatch.from_arrays([table.column("k1").combine_chunks().take(of), table.column("k2").combine_chunks().take(of), pa.array(pos[row] - (end - 1)), pa.array(pos[row] - first + length)], ["k1", "k2", "low", "high"])

        waiting, held = [], 0
        for group in grouped(batches, ["key", "pair"]):
            if group.num_rows < 2:
                continue
            waiting.append(group)
            held += group.num_rows
            if held >= BLOCK:
                yield ranges(waiting)
                waiting, held = [], 0
        if waiting:
            yield ranges(waiting)

    blocks = deal(pieces.filter("kind > 0").drop("high"), ["key"], "bytes", BLOCK)
    compared = blocks.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(compare, "k1 long, k2 long, low long, high long")
    every = pieces.filter("kind = 0").select("k1", "k2", "low", "high").unionByName(compared)
    return every.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def union(low: np.ndarray, high: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of each row with touching ones made one, in order."""
    order = np.lexsort((low, of))
    low, high, of = low[order], high[order], of[order]
    step = int(high.max()) + 1
    reach = np.maximum.accumulate(high + of * step)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] + of[1:] * step > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    return low[first], reach[last] - of[first] * step, of[first]


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row a document; `length` is 64 to 255.

    Removes every byte covered by a string of `length` bytes that also starts elsewhere, overlaps included, judged on
    the input.  Matches never cross documents; whole copies of one text are found by its digest and lose all their
    strings.  Null texts count as empty; texts shorter than `length` stay; texts of any length are read whole.  Null and
    repeated doc_ids pass through; an empty table gives an empty result.  with_text adds k1, k2 and kept_text instead
    of doc_id, a row a distinct text: what is left as text, without UTF-8 sequences that a removed range cuts.
    """
    if not ANCHOR + SHALLOW <= length <= 255:
        raise ValueError("length must be from 64 to 255")
    keyed = docs.select(*text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    # Copies meet before the shuffle.  The table is in buckets by text, so later joins with it don't move texts again.
    distinct = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = write_buckets(distinct, "texts", bucket_count(docs.sparkSession, total))
    ranges = find_repeats(texts, length)

    def remove(batches):
        for batch in batches:
            for part in byte_slices(batch, 1 << 22):
                data, offsets = batch_bytes(part.column("text"))
                raw = data.tobytes()
                sizes, copies = np.diff(offsets), part.column("copies").to_numpy()
                removed, spans, digests, kept = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [], []
                lists = part.column("ranges").to_pylist()
                for i in range(len(sizes)):
                    lo, n = int(offsets[i]), int(sizes[i])
                    if copies[i] > 1 and n >= length:
                        cuts = [(0, n)]
                    elif lists[i]:
                        low, high = (np.array([x[k] for x in lists[i]], np.int64) for k in ("low", "high"))
                        low, high, _ = union(low, high, np.zeros(len(low), np.int64))
                        cuts = list(zip(low.tolist(), high.tolist()))
                    else:
                        cuts = []
                    left, at = [], 0
                    for a, b in cuts:
                        left.append(raw[lo + at : lo + a])
                        at = b
                        removed[i] += b - a
                    left.append(raw[lo + at : lo + n])
                    spans[i] = len(cuts)
                    left = b"".join(left)
                    digests.append(hashlib.sha256(left).digest())
                    if with_text:
                        kept.append(left.decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array(digests, pa.binary()), pa.array(kept if with_text else [None] * len(sizes), pa.string())], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    joined = texts.join(ranges, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "ranges")
    results = joined.mapInArrow(remove, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")
    digest = F.lower(F.hex("kept")).alias("kept_sha256")
    if with_text:
        return results.select("k1", "k2", "n_bytes", "n_removed", "n_spans", digest, "kept_text")
    return docs.select("doc_id", *text_key(F.col("text"))).join(results.drop("kept_text"), ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", digest)
