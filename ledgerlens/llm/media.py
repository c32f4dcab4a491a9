"""Media columns with content-defined chunks.

A payload of 8-bit samples is cut where a rolling gear hash of its last 32 bytes has ten zero bits, so equal
stretches give equal chunks wherever they stand.  Two tables are written: lists, with a medium's header and the ordered
digests of its chunks, and chunks, with one row for each digest, kept beside the medium that owns it, the first that
has the chunk.  Spark joins on digests find the owners.  Reading takes both tables, fetches shared chunks from their
owners, puts each medium together in order and checks all digests.  Both tables are in buckets by text, so the bytes are
shuffled once; only shared chunks travel again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, bucket_count, byte_slices, join_split, materialize, text_key, write_buckets

UNIT = 192
CUT_BITS, LEAST, MOST = 10, 256, 8192
REACH = 32
RATE = 8000
#: References to one chunk beyond which they are split over tasks.
HOT = 4096
_GEAR = np.random.default_rng(1995).integers(0, 1 << 32, 256, dtype=np.uint32)


def padded(data: bytes) -> bytes:
    """data with bytes 32 up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def header(samples: int) -> bytes:
    """The RIFF header of `samples` mono 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + samples) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", samples & 0xFFFFFFFF)


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Ends of chunks that the gear hash allows, for all bytes at once: each doubling adds the hash of as many earlier bytes."""
    h, reach = _GEAR[data], 1
    while reach < REACH and len(h) > reach:
        ahead = h.copy()
        ahead[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = ahead, 2 * reach
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(candidates: np.ndarray, size: int) -> list[int]:
    """Ends of the chunks of a payload of `size` bytes: candidates at least LEAST apart, or MOST where none comes."""
    ends, at = [], 0
    while size - at > LEAST:
        k = int(np.searchsorted(candidates, at + LEAST))
        end = min(int(candidates[k]) if k < len(candidates) else size, at + MOST, size)
        ends.append(end)
        at = end
    if at < size:
        ends.append(size)
    return ends


def features(samples: np.ndarray) -> str:
    """Mean, spread, range and zero crossings of the samples around the middle value."""
    x = samples.astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero(np.diff(x > 96)))
    return f"mean={total / n:.6f};power={squares / n:.6f};low={int(x.min())};high={int(x.max())};crossings={crossings}"


def cut_up(part) -> Iterator[tuple[bytes, list[bytes]]]:
    """The payload of each row of an Arrow batch of texts, and its chunks."""
    data, offsets = batch_bytes(part.column("text"))
    cuts, raw = cut_candidates(data), data.tobytes()
    for i in range(part.num_rows):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        payload = padded(raw[lo:hi])
        own = cuts[np.searchsorted(cuts, lo + REACH) : np.searchsorted(cuts, hi, side="right")] - lo
        ends = chunk_ends(own, len(payload))
        yield payload, [payload[a:b] for a, b in zip([0, *ends], ends)]


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes the lists (k1, k2, n_bytes, header, payload_sha256, digests) and the chunks (k1, k2, digest, shared, body) of all texts.

    A chunk's k1 and k2 are those of the text that owns it.  The third table has the chunks that a text has but doesn't own.
    """
    spark = docs.sparkSession
    keyed = docs.select(*text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))

    def describe(batches):
        for batch in batches:
            for part in byte_slices(batch):
                sizes, heads, wholes, digests = pc.fill_null(pc.binary_length(part.column("text")), 0), [], [], []
                for payload, chunks in cut_up(part):
                    heads.append(header(len(payload)))
                    wholes.append(hashlib.sha256(payload).digest())
                    digests.append([hashlib.sha256(c).digest() for c in chunks])
                arrays = [sizes.cast(pa.int64()), pa.array(heads, pa.binary()), pa.array(wholes, pa.binary()), pa.array(digests, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), *arrays], ["k1", "k2", "n_bytes", "header", "payload_sha256", "digests"])

    described = keyed.mapInArrow(describe, "k1 long, k2 long, n_bytes long, header binary, payload_sha256 binary, digests array<binary>")
    described = described.groupBy("k1", "k2").agg(F.first(F.struct("n_bytes", "header", "payload_sha256", "digests")).alias("m")).select("k1", "k2", "m.*")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(spark, total)
    lists = write_buckets(described, "lists", buckets)

    borrowed = materialize(foreign(lists))

    def squeeze(batches):
        for batch in batches:
            packed = pa.array([zlib.compress(t.encode("utf-8"), 4) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), packed], ["k1", "k2", "packed"])

    texts = keyed.mapInArrow(squeeze, "k1 long, k2 long, packed binary").groupBy("k1", "k2").agg(F.first("packed").alias("packed"))
    elsewhere = borrowed.groupBy("k1", "k2").agg(F.collect_list("digest").alias("elsewhere"))
    lent = borrowed.groupBy("owner.k1", "owner.k2").agg(F.collect_set("digest").alias("lent"))

    def bodies(batches):
        for batch in batches:
            unpacked = pa.array([zlib.decompress(x) for x in batch.column("packed").to_pylist()], pa.binary())
            for part in byte_slices(batch.append_column("text", unpacked)):
                row, digests, out, shared = [], [], [], []
                for i, ((_, chunks), others, lent) in enumerate(zip(cut_up(part), part.column("elsewhere").to_pylist(), part.column("lent").to_pylist(), strict=True)):
                    written, lent = set(others or ()), set(lent or ())
                    for chunk in chunks:
                        digest = hashlib.sha256(chunk).digest()
                        if digest not in written:
                            written.add(digest)
                            row.append(i)
                            digests.append(digest)
                            shared.append(digest in lent)
                            out.append(chunk)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("k1").take(at), part.column("k2").take(at), pa.array(digests, pa.binary()), pa.array(shared, pa.bool_()), pa.array(out, pa.binary())], ["k1", "k2", "digest", "shared", "body"])

    owned = texts.join(elsewhere, ["k1", "k2"], "left").join(lent, ["k1", "k2"], "left").select("k1", "k2", "packed", "elsewhere", "lent")
    owned = owned.mapInArrow(bodies, "k1 long, k2 long, digest binary, shared boolean, body binary")
    return lists, write_buckets(owned, "chunks", buckets), borrowed


def foreign(lists: DataFrame) -> DataFrame:
    """(k1, k2, digest, owner) of the chunks that a text has but doesn't own: the smallest key of those that have one owns it."""
    place = F.struct("k1", "k2")
    refs = lists.select("k1", "k2", F.explode(F.array_distinct("digests")).alias("digest"))
    owned = refs.groupBy("digest").agg(F.min(place).alias("owner"), F.max(place).alias("other")).filter("owner <> other").select("digest", "owner")
    return join_split(refs, owned, ["digest"], "k1", HOT).filter(place != F.col("owner")).select("k1", "k2", "digest", "owner")


def read_media(lists: DataFrame, chunks: DataFrame, borrowed: DataFrame, with_payload: bool = False) -> DataFrame:
    """Puts media together from the two tables; a chunk or a medium that doesn't match its digest stops the job."""
    body = F.collect_list(F.struct("digest", "body"))
    shared = chunks.filter("shared").select("digest", "body")
    fetched = join_split(borrowed.select("k1", "k2", "digest"), shared, ["digest"], "k1", HOT).groupBy("k1", "k2").agg(body.alias("fetched"))
    own = chunks.groupBy("k1", "k2").agg(body.alias("own"))
    rows = lists.join(own, ["k1", "k2"], "left").join(fetched, ["k1", "k2"], "left").select("k1", "k2", "n_bytes", "header", "payload_sha256", "digests", "own", "fetched")
    results = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.binary(), "feature": pa.string(), "payload": pa.binary()}

    def read(batches):
        for batch in batches:
            columns: dict[str, list] = {x: [] for x in results}
            for head, expected, digests, own, fetched in zip(*(batch.column(x).to_pylist() for x in ("header", "payload_sha256", "digests", "own", "fetched")), strict=True):
                at = {}
                for chunk in [*(own or ()), *(fetched or ())]:
                    if hashlib.sha256(chunk["body"]).digest() != chunk["digest"]:
                        raise ValueError("a chunk doesn't match its digest")
                    at[chunk["digest"]] = chunk["body"]
                medium = head + b"".join([at[x] for x in digests])
                payload = medium[len(head) :]
                if hashlib.sha256(payload).digest() != expected:
                    raise ValueError("a medium doesn't match its digest")
                values = (len(payload), zlib.crc32(payload[-16:]), len(medium), hashlib.sha256(medium).digest(), features(np.frombuffer(payload, np.uint8)), payload if with_payload else None)
                for name, value in zip(results, values, strict=True):
                    columns[name].append(value)
            arrays = [pa.array(columns[k], kind) for k, kind in results.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("k1", "k2", "n_bytes", "payload_sha256")), *arrays], ["k1", "k2", "n_bytes", "payload_sha256", *results])

    return rows.mapInArrow(read, "k1 long, k2 long, n_bytes long, payload_sha256 binary, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 binary, feature string, payload binary")


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row a document with the sizes, digests and features of its medium as read back.

    The medium is a WAVE file of 8-bit samples, stored as its header and chunks.  Null texts count as empty, and an empty
    text has 192 bytes 32; equal texts share one medium.  Null and repeated doc_ids pass through; a text of any length
    is stored whole, and one task holds one medium at a time.  An empty table gives an empty result; other columns are
    dropped.
    """
    media = read_media(*store(docs)).drop("payload")
    hexed = lambda name: F.lower(F.hex(name)).alias(name)
    return docs.select("doc_id", *text_key(F.col("text"))).join(media, ["k1", "k2"]).select("doc_id", "n_bytes", "payload_bytes", hexed("payload_sha256"), "tail_crc32", "media_bytes", hexed("media_sha256"), "feature")
