"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the pattern of one word as Java's and DuckDB's regular expressions take it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only in local mode where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ledgerlens-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of large keys with so many rows at most are broadcast; longer ones are joined with salt.
BROADCAST_KEYS, SALTS = 50_000, 64


def _large_keys(rows: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, int]:
    """Keys with more than `block` rows and the number of parts of about a block that they need; counted before rows are shuffled."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    sizes = materialize(sizes.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_parts")))
    return sizes, sizes.count()


def with_parts(rows: DataFrame, large: DataFrame, n: int, keys: list[str], member: str, name: str = "parts") -> DataFrame:
    """Adds `name`, the number of parts of a row's key, 1 for keys that aren't large.

    A table of large keys longer than BROADCAST_KEYS is joined on the key and a salt that `member` decides, so a hot key
    never meets in one task.
    """
    if n <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(large), keys, "left")
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(member, F.lit("salt")), F.lit(SALTS)))
        marked = salted.join(large.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "_salt"], "left").drop("_salt")
    return marked.withColumn(name, F.coalesce("_parts", F.lit(1))).drop("_parts")


def deal(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Adds pair: rows of one key and pair fit in memory, and any two rows of one key meet in some pair.

    A key with at most `block` rows has one pair.  Larger ones are split into parts of about a block by `member`, and each
    row goes to the pairs of its part with every part.
    """
    mine = F.pmod(F.xxhash64(member), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(mine, o) * F.col("parts") + F.greatest(mine, o))
    return with_parts(rows, *_large_keys(rows, keys, block), keys, member).withColumn("pair", F.explode(pairs)).drop("parts")


def join_split(rows: DataFrame, unique: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """rows joined with a table that has a row a key; rows of keys with more than `block` rows are split, theirs repeated."""
    large, n = _large_keys(rows, keys, block)
    left = with_parts(rows, large, n, keys, member).withColumn("_part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int")).drop("parts")
    right = with_parts(unique, large, n, keys, keys[0]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.join(right, [*keys, "_part"]).drop("_part")


#: Bytes of text that a bucket of a written table should hold.
BUCKET_BYTES = 128 << 20


def write_buckets(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df as a table in the shared warehouse, in buckets by (k1, k2): later joins by text don't move it again."""
    table_name = f"ledgerlens_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "k1", "k2").saveAsTable(table_name)
    return df.sparkSession.table(table_name)


def bucket_count(spark: SparkSession, n_bytes: int) -> int:
    """As many buckets as shuffles have partitions, or more where a bucket would hold more than BUCKET_BYTES; 100,000 are Spark's limit."""
    return min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES)), 100_000)


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit digests that stand for a text (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7919), text).alias("k2")]


def unit_hash(*columns: Column) -> Column:
    """A number in (0, 1) that the columns decide."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / float(1 << 53)


def crc32_of(column: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))


# ---------------------------------------------------------------- numpy helpers, used inside Arrow batches

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = 0xD1342543DE82EF95
_BYTE_CODES = (np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def batch_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array, one after another, and each row's offsets; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Powers:
    """Powers of one odd number and their inverses modulo 2**64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def until(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            out = []
            for base in (_ODD, pow(_ODD, -1, 1 << 64)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                out.append(np.multiply.accumulate(x))
            self.up, self.down = out
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] times the inverse power of i a hash of data[i:j]; for strings of a few hundred bytes (see text_sums)."""
    up, _ = POWERS.until(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes, equal hashes."""
    _, down = POWERS.until(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


#: Texts of any length are hashed modulo this prime: unlike sums modulo a power of two, two texts collide for a share of
#: all bases that their length bounds, whatever they say.
PRIME = (1 << 61) - 1
_P, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_S30, _S31, _S61 = np.uint64(30), np.uint64(31), np.uint64(61)
_BASE, *_CODES_LIST = (int(x) for x in np.random.default_rng(20250611).integers(1 << 40, PRIME, 257))
_PRIME_CODES = np.array(_CODES_LIST, np.uint64)


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def _up31(x: np.ndarray) -> np.ndarray:
    """x times 2**31, for x below 2**63, before the last folding."""
    return (x >> _S30) + ((x & _LOW30) << _S31)


def times_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    high = a1 * b1
    return _folded(high + high + _up31(a1 * b0 + a0 * b1) + a0 * b0)


class PrimePowers:
    """Powers of a base modulo PRIME and their inverses, as far as asked for."""

    def __init__(self, base: int = _BASE) -> None:
        self.bases = base, pow(base, -1, PRIME)
        self.tables = [np.ones(1, np.uint64)] * 2

    def until(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            self.tables = [np.concatenate([t, times_mod(t, np.uint64(pow(b, len(t), PRIME)))]) for b, t in zip(self.bases, self.tables)]
        return self.tables


PRIME_POWERS = PrimePowers()


def text_sums(data: np.ndarray) -> np.ndarray:
    """Sums S modulo PRIME of byte codes times powers, with S[j] - S[i] times the inverse power of i a hash of data[i:j]."""
    up, _ = PRIME_POWERS.until(len(data) + 1)
    terms = times_mod(_PRIME_CODES[data], up[: len(data)])
    sums = np.zeros(len(data) + 1, np.uint64)
    sums[1:] = _folded(_up31(np.cumsum(terms >> _S31)) + _folded(np.cumsum(terms & _LOW31)))
    return sums


def text_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], of any length; equal bytes, equal hashes."""
    _, down = PRIME_POWERS.until(len(sums))
    differ = _folded(sums[ends] + _P - sums[starts])
    return mixed(times_mod(differ, down[starts]) + (ends - starts).astype(np.uint64) * _M2)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the row of each: words never cross rows."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    joined = cut[inside[cut] & inside[cut - 1]]
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def sums_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def byte_slices(table, limit: int = 1 << 22):
    """Cuts an Arrow batch into runs of rows with about `limit` bytes of text (a longer row stands alone)."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < table.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield table.slice(start, stop - start)
        start = stop
