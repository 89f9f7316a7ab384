"""Shared plumbing: tables, the shared folder, bounded Arrow chunks and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Estimated bytes of input whose records are dealt to one bucket.
BUCKET_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where that is unset a local session, whose executor is the driver, gets a fresh folder; a cluster is refused.
    """
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("memtide.shared.dir", None)
        if not d:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            d = "file://" + tempfile.mkdtemp(prefix="memtide-")
            spark.conf.set("memtide.shared.dir", d)
    return d


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/memtide/{tag}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended first
        pass


#: While a table is written: rows and bytes that cross between Spark and Python at once (blobs and texts are long rows), and the
#: shuffle files of the job go as it ends, not when the driver happens to collect its garbage.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and
    a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = spark.read.schema(df.schema).parquet(path)
    got._stashed_at = path
    return got


def release(*stashed: DataFrame) -> None:
    """Remove stashed tables that nothing reads any more."""
    for df in stashed:
        drop_path(df.sparkSession, df._stashed_at)


def partitions_for(df: DataFrame, at_least: int = 1) -> int:
    """Shuffle partitions for explicit repartitioning: the session's setting."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(df: DataFrame) -> int:
    """Buckets that rows are dealt to by key: of about BUCKET_BYTES of ``df`` each, one a partition at least.

    A task handles its partition bucket by bucket, so what it holds is bounded by a bucket, whatever the session's partitions.
    The size is Catalyst's estimate; a wild one (of joins) only makes more buckets, up to a bound.
    """
    parts = partitions_for(df)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(parts, size // BUCKET_BYTES), 256 * parts) + 1


def by_bucket(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[Iterator[pa.RecordBatch]]:
    """The rows of each bucket of a partition that is sorted by its bucket column, as an iterator of record batches."""

    def slices():
        for b in batches:
            k = np.asarray(b.column(column))
            cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else []
            for lo, hi in itertools.pairwise(cut):
                yield int(k[lo]), b.slice(lo, hi - lo)

    try:
        for _, part in itertools.groupby(slices(), key=lambda x: x[0]):
            yield (b for _, b in part)
    finally:
        give_back()


_given_back = 0.0


def give_back(pause: float = 1.0) -> None:
    """Freed memory goes back to the system, every ``pause`` seconds at most: Python workers live from stage to stage, and what
    the allocators keep for them would count beside all that comes later."""
    global _given_back
    if time.monotonic() - _given_back < pause:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
    _given_back = time.monotonic()


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches whose ``text`` column holds at most ``limit`` bytes (or one row)."""
    try:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            off = text_buffers(b.column(b.schema.get_field_index(text)))[1]
            lo = 0
            while lo < n:
                hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
                hi = min(n, max(hi, lo + 1))
                yield b.slice(lo, hi - lo)
                lo = hi
    finally:
        give_back()


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string or binary column; nulls are empty texts."""
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs, n, at = arr.buffers(), len(arr), arr.offset
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if big else np.int32, n + 1, at * (8 if big else 4)).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if arr.null_count:  # a null may cover bytes: copy those of the others only
        valid = np.asarray(arr.is_valid())
        lens = np.where(valid, np.diff(off), 0)
        data = np.concatenate([data[a:b] for a, b, v in zip(off[:-1], off[1:], valid, strict=True) if v] or [data[:0]])
        return data, np.concatenate([[0], np.cumsum(lens)])
    return data[off[0] : off[-1]], off - off[0]


# --- word hashing -----------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Two hashes in one: a polynomial modulo 2^64, and one modulo a prime, which has no strings that collide for every base.
_BASE, _PRIME, _PRIME_BASE = 0xD1342543DE82EF95, (1 << 31) - 1, 1_318_699_401
_INV, _PRIME_INV = pow(_BASE, -1, 1 << 64), pow(_PRIME_BASE, -1, _PRIME)
_RAND = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: list[np.ndarray] = [np.ones(1, np.uint64) for _ in range(4)]

#: Byte classes: the byte a text byte counts as, 0 for one that separates words.
ALNUM = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
#: Words split at ASCII white space only; NUL would be a separator, so byte 0 counts as byte 1 of another alphabet.
NONSPACE = np.array([0 if b == 32 or 9 <= b <= 13 else b for b in range(256)], np.uint8)
NONSPACE_IN = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MULT
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        n = max(n, CHUNK_BYTES + 2)
        for k, b in ((0, _BASE), (1, _INV)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p)
    return _POW[0], _POW[1]


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[2]) < n:
        n = max(n, CHUNK_BYTES + 2)
        for k, b in ((2, _PRIME_BASE), (3, _PRIME_INV)):
            p = np.ones(n, np.uint64)
            have = 1
            while have < n:
                more = min(have, n - have)
                p[have : have + more] = p[:more] * np.uint64(pow(b, have, _PRIME)) % np.uint64(_PRIME)
                have += more
            _POW[k] = p
    return _POW[2], _POW[3]


def words(data: np.ndarray, off: np.ndarray, classes: np.ndarray = ALNUM, space: np.ndarray | None = None):
    """Words of many texts at once: (start byte, end byte, first word index of each text plus the total).

    ``classes`` maps a byte to 0 if it separates words; ``space`` marks separators where NUL belongs to words.
    """
    inside = ~space[data] if space is not None else classes[data] != 0
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = distinct(off[(off > 0) & (off < n)])
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, classes: np.ndarray = ALNUM) -> np.ndarray:
    """A 64-bit hash of each word's mapped bytes: two cumulative sums over the chunk, no Python object per word."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    low = classes[data]
    v = _RAND[low]
    v *= up[:n]
    np.cumsum(v, out=acc[1:])
    h = (acc[end] - acc[start]) * down[start]
    up, down = _prime_powers(n + 1)
    v = low * up[:n]
    if n >= 1 << 24:  # below that no sum leaves 64 bits
        v %= np.uint64(_PRIME)
    np.cumsum(v, out=acc[1:])
    p = (acc[end] - acc[start]) % np.uint64(_PRIME) * down[start] % np.uint64(_PRIME)
    return mix(h ^ mix(p * _MULT + (end - start).astype(np.uint64)))


def shingles(h: np.ndarray, first: np.ndarray, size: int):
    """Hashes of ``size`` consecutive words inside a text: (hashes, index of each one's first word, first shingle of each text).

    A text of fewer words, but not none, gives one shingle of all its words.
    """
    n = np.diff(first)
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    room = np.repeat(np.minimum(n, size), count)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        part = h[np.minimum(at + k, len(h) - 1)] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
        part = (part ^ (part >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out += np.where(k < room, part, np.uint64(0))
    return mix(out), at, begin


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values (by sorting: numpy's own hashes, which keys of several packed numbers defeat)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def doc_of(begin: np.ndarray) -> np.ndarray:
    """The text index of every item, from the first item of each text."""
    return np.repeat(np.arange(len(begin) - 1), np.diff(begin))
