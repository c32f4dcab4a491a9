"""Alignment of two tokenizers over the same bytes.

Texts are encoded by both; token starts and ends are byte offsets.  Within a slice of texts, pandas merge_asof, keyed by
document, finds for each token start the other side's token that covers it; both directions together give all overlaps,
and overlaps whose tokens end together close a group.  Links are all pairs of a group.  How many documents hold a pair of
ids linked is counted once a block of texts, so what is shuffled is a row a pair and block, not one a link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize
from .tokens import byte_level, pieces

#: Bytes of text that are aligned at once, and that share one table of pairs.
SLICE, BLOCK = 1 << 20, 16 << 20
#: Links of a group beyond which its equal ids are counted before they are paired.
WIDE = 1 << 14


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(doc, start, end) of tokens of both sides, in order, to (a_end, b_end) of all pairs that share a byte.

    Starts are offsets in the whole slice, so they ascend.  A pair of equal starts is found from both sides and kept once.
    """
    left = pd.merge_asof(a, b, on="start", by="doc", suffixes=("_a", "_b"))
    right = pd.merge_asof(b, a.assign(from_=a["start"]), on="start", by="doc", suffixes=("_b", "_a"))
    right = right[right["start"] != right["from_"]]
    return pd.concat([left[["end_a", "end_b"]], right[["end_a", "end_b"]]])


class Side:
    """One tokenizer's tables: the bytes of its tokens, and its ids as text with what follows them."""

    def __init__(self, encoder, between: str, after: str) -> None:
        self.encoder = encoder
        self.bytes = pa.array([encoder.tokens.get(i, b"") for i in range(encoder.size)], pa.large_binary())
        self.shown = [f"{i}{between}".encode() for i in range(encoder.size)] + [f"{i}{after}".encode() for i in range(encoder.size)]


def taken(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """The table's byte strings at ids, one after another, and their offsets."""
    got = table.take(pa.array(ids))
    _, offsets, data = got.buffers()
    offsets = np.frombuffer(offsets, np.int64)[got.offset : got.offset + len(got) + 1]
    return offsets - offsets[0], memoryview(data or b"")[offsets[0] : offsets[-1]]


def pairs_of_groups(doc: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, in order, of n_a ids of a and n_b ids of b, to (doc, pair, times): linked id pairs of each document, a << 32 | b."""
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    plain = n_a * n_b <= WIDE
    group = np.repeat(np.arange(len(n_a)), n_a)
    chosen = plain[group]
    group, left = group[chosen], a[chosen]
    each = n_b[group]
    rows = np.repeat(np.arange(len(group)), each)
    right = b[np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each) + at_b[group][rows]]
    found = [(doc[group][rows], left[rows].astype(np.int64) << 32 | right, np.ones(len(rows), np.int64))]
    for g in np.flatnonzero(~plain):
        x, times_x = np.unique(a[at_a[g] : at_a[g] + n_a[g]], return_counts=True)
        y, times_y = np.unique(b[at_b[g] : at_b[g] + n_b[g]], return_counts=True)
        pair = (x.astype(np.int64)[:, None] << 32 | y.astype(np.int64)).ravel()
        found.append((np.full(len(pair), doc[g]), pair, np.outer(times_x, times_y).ravel()))
    docs, pair, times = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((pair, docs))
    docs, pair, times = docs[order], pair[order], times[order]
    first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (pair[1:] != pair[:-1])]) if len(docs) else np.zeros(0, np.int64)
    return docs[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def align_slice(texts: list[str], a: Side, b: Side, shown: pa.Array) -> tuple[dict[str, np.ndarray], list[bytes], tuple]:
    """Per text n_a, n_b, n_groups, n_links and the groups as text, and (text, pair, times) of the linked id pairs."""
    n = len(texts)
    ids_a = [a.encoder.encode(" " + t, special=False) if t else np.zeros(0, np.uint32) for t in texts]
    ids_b = [b.encoder.encode(t) if t else np.zeros(0, np.uint32) for t in texts]
    while True:
        doc_a, doc_b = (np.repeat(np.arange(n), [len(x) for x in ids]) for ids in (ids_a, ids_b))
        flat_a, flat_b = np.concatenate([*ids_a, np.zeros(0, np.uint32)]), np.concatenate([*ids_b, np.zeros(0, np.uint32)])
        (off_a, all_a), (off_b, all_b) = taken(a.bytes, flat_a), taken(b.bytes, flat_b)
        ends_a, ends_b = off_a[np.searchsorted(doc_a, np.arange(n + 1))], off_b[np.searchsorted(doc_b, np.arange(n + 1))]
        lost = [k for k, t in enumerate(texts) if len(ids_a[k]) + len(ids_b[k]) and not (bytes(all_a[ends_a[k] : ends_a[k + 1]]) == (want := b" " + t.encode()) == bytes(all_b[ends_b[k] : ends_b[k + 1]]))]
        if not lost:
            break
        for k in lost:
            ids_a[k] = ids_b[k] = np.zeros(0, np.uint32)
    left = pd.DataFrame({"doc": doc_a, "start": off_a[:-1], "end": off_a[1:]})
    right = pd.DataFrame({"doc": doc_b, "start": off_b[:-1], "end": off_b[1:]})
    both = overlaps(left, right)
    ends = np.sort(both.loc[both["end_a"] == both["end_b"], "end_a"].to_numpy(np.int64))
    group_a, group_b = np.searchsorted(ends, off_a[1:]), np.searchsorted(ends, off_b[1:])
    size_a, size_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
    doc = doc_a[np.cumsum(size_a) - 1] if len(ends) else np.zeros(0, np.int64)
    upto = np.r_[0, np.cumsum(size_a * size_b)][np.searchsorted(doc, np.arange(n + 1))]
    counts = {"n_a": np.bincount(doc_a, minlength=n), "n_b": np.bincount(doc_b, minlength=n), "n_groups": np.bincount(doc, minlength=n), "n_links": np.diff(upto)}
    # Ids as text, group by group: those of a, then those of b, the last of each with its own mark.
    last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True][: len(group_a)], np.r_[group_b[1:] != group_b[:-1], True][: len(group_b)]
    codes = np.empty(len(flat_a) + len(flat_b), np.int64)
    codes[np.arange(len(flat_a)) + (np.cumsum(size_b) - size_b)[group_a]] = flat_a + last_a * a.encoder.size
    codes[np.arange(len(flat_b)) + np.cumsum(size_a)[group_b]] = 2 * a.encoder.size + flat_b + last_b * b.encoder.size
    offsets, line = taken(shown, codes)
    at = offsets[np.r_[0, np.cumsum(counts["n_a"] + counts["n_b"])]]
    told = [bytes(line[at[k] : max(at[k + 1] - 1, at[k])]) for k in range(n)]
    return counts, told, pairs_of_groups(doc, flat_a, flat_b, size_a, size_b)


def _aligned(docs: DataFrame, a_path: str | None, b_path: str | None, keep: list[str], with_groups: bool) -> DataFrame:
    """A row a document, with its pairs as places in its block's list of pairs, and a row a block, with that list."""
    fields = [T.StructField("kept", T.StructType([docs.schema[k] for k in keep]))]
    fields += [T.StructField(k, T.LongType()) for k in ("block", "n_a", "n_b", "n_groups", "n_links")]
    fields += [T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType())]
    fields += [T.StructField(k, T.ArrayType(T.IntegerType())) for k in ("places", "times", "a", "b", "docs")]
    schema, names = T.StructType(fields), [f.name for f in fields]
    state: list = []

    def block_rows(block: int, held: list) -> list[pa.RecordBatch]:
        """The documents of a block and its list of pairs."""
        pair, place, docs = np.unique(np.concatenate([x[3][1] for x in held]), return_inverse=True, return_counts=True)
        tables, at = [], 0
        for kept, counts, told, (doc, of, times) in held:
            n = len(told)
            cut = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32)))
            arrays = [kept, pa.array(np.full(n, block)), *(pa.array(counts[k].astype(np.int64)) for k in names[2:6])]
            arrays += [pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in told], pa.string()), pa.array([t.decode() for t in told], pa.string()) if with_groups else pa.nulls(n, pa.string())]
            arrays += [listed(place[at : at + len(of)]), listed(times), *(pa.nulls(n, pa.list_(pa.int32())) for _ in range(3))]
            tables.append(pa.RecordBatch.from_arrays(arrays, names))
            at += len(of)
        one = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
        nulls = [pa.nulls(1, tables[0].schema.field(k).type) for k in names]
        return [*tables, pa.RecordBatch.from_arrays([nulls[0], pa.array([block]), *nulls[2:10], one(pair >> 32), one(pair & 0xFFFFFFFF), one(docs)], names)]

    def run(batches):
        if not state:
            a, b = Side(byte_level(a_path), ",", "|"), Side(pieces(b_path), ",", ";")
            state.extend([a, b, pa.array(a.shown + b.shown, pa.large_binary())])
        held, size, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in byte_slices(batch, SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                columns = [part.column(k) for k in keep]
                held.append((pa.StructArray.from_arrays(columns, keep), *align_slice(texts, *state)))
                size += sum(map(len, texts))
                if size >= BLOCK:
                    yield from block_rows(block, held)
                    held, size, block = [], 0, block + 1
        if held:
            yield from block_rows(block, held)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents two ids are linked, and whether no other b has more for this a."""
    listed = aligned.filter("docs is not null").select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).select("p.*")
    counts = materialize(listed.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, keep: list[str] | None = None, with_groups: bool = False) -> DataFrame:
    """(doc_id, text) to (kept, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a document.

    A is a byte-level file over a space and the text, B a sentence-piece model over the text, special strings being plain
    text.  Null and empty texts, and those that either side doesn't give back byte by byte, have no tokens: zeros and an
    empty string.  `kept` is a struct of the columns that `keep` names, doc_id by default, so names can't clash;
    with_groups adds the groups as text.  Null and repeated doc_ids and repeated rows are documents of their own; a long
    text takes memory in proportion to itself and to its distinct pairs; an empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    aligned = materialize(_aligned(docs, a_path, b_path, keep, with_groups))
    listed = aligned.filter("docs is not null").select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("block", "place", "p.*")
    known = listed.join(pair_counts(aligned), ["a", "b"]).select(F.col("block").alias("of"), "place", "count", "best")
    shown = ["n_a", "n_b", "n_groups", "n_links"]
    rows = aligned.filter("docs is null").select("block", "kept", *shown, "groups_sha256", *["groups"] * with_groups, "places", "times")
    out = T.StructType([aligned.schema[k] for k in ("kept", *shown)] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), aligned.schema["groups_sha256"]] + [aligned.schema["groups"]] * with_groups)

    def summed(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        places, times = documents.column("places").combine_chunks(), documents.column("times").combine_chunks()
        n = places.value_lengths().to_numpy(zero_copy_only=False)
        at, times = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        upto = np.r_[0, np.cumsum(n)]
        total = lambda x: np.diff(np.r_[0, np.cumsum(x[at] * times)][upto])
        sums = {"n_best": pa.array(total(best)), "count_sum": pa.array(total(count))}
        return pa.table({f.name: sums.get(f.name, documents.column(f.name) if f.name in documents.column_names else None) for f in out})

    return rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(summed, out)
