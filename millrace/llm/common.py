"""Helpers shared by the training-data operators: shared-folder tables and vectorised word hashing.

Nothing here keeps state on one machine: intermediate tables go to the folder named by
``spark.checkpoint.dir`` so that a lost executor only costs the tasks that ran on it.
"""

from __future__ import annotations

import atexit
import ctypes
import secrets
import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def _return_memory() -> None:
    """In a Python worker, freed arrays go back to the system at once: workers wait, with what they hold, for the next task."""
    from pyspark import TaskContext

    if TaskContext.get() is None:
        return
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 2 << 20)  # blocks of 2 MB and more are mapped on their own
        libc.mallopt(-1, 8 << 20)  # free memory at the heap's end above 8 MB is given back
    except (OSError, AttributeError):  # another C library
        return


_return_memory()


def trim() -> None:
    """Give free memory inside the heap back to the system."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(f):
    """``f`` over a task's batches; freed memory goes back at the end, since workers wait for other tasks."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


#: Bytes of an Arrow batch on its way to a worker. The JVM's buffers double as they grow, and what they leave free in the
#: C library's heaps counts on beside the Java heap.
BATCH_BYTES = 8 << 20
#: Bytes hashed at once, so that the work arrays stay in a core's cache.
CHUNK = 1 << 18
#: Positions in a word that have a table of random values of their own.
PLACES = 64
#: Word separators of the op7/op8 contracts: space and \t..\r.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master gets a temporary one where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    """This application's folder for stored tables; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(_delete, spark, path)
    return path


_SCRATCH: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # noqa: BLE001  the session may be gone at exit; a left folder is no fault of the result
        print(f"not deleted: {path} ({type(e).__name__})", file=sys.stderr)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hint_small(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Broadcast ``df`` only if its counted rows are within ``limit``; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hasher:
    """Keyed 64-bit hashes of words and of runs of words.

    A word's sum of random values, one for each pair of place and byte, is mixed with its length; words that
    differ meet with probability 2**-64 over the keys. Runs of words are hashed by doubling, with a mix in each
    step, so no algebra of one level carries over to the next. Operators draw ``seed`` anew for every run
    (see ``fresh_seed``), so no text can be made to collide, and take two hashers where 64 bits are too few.
    """

    def __init__(self, seed: int, lower: bool = False):
        rng = np.random.default_rng(seed)
        values = rng.integers(0, 2**64, (PLACES, 256), dtype=np.uint64)
        if lower:
            values[:, 65:91] = values[:, 97:123]
        self.values = values.ravel()
        self.far = values[PLACES - 1].copy()
        self.odd = [U64(int(x) | 1) for x in rng.integers(0, 2**64, 6, dtype=np.uint64)]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[s:e]; starts and ends ascend and do not overlap."""
        out = np.empty(len(starts), U64)
        i = 0
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
            s, e = starts[i:j] - lo, ends[i:j] - lo
            part = data[lo : int(ends[j - 1])]
            place = np.zeros(len(part), np.int32)
            place[s] = s
            place = np.arange(len(part), dtype=np.int32) - np.maximum.accumulate(place)
            value = self.values[np.minimum(place, PLACES - 1) << 8 | part]
            if int((e - s).max()) > PLACES:
                late = np.flatnonzero(place >= PLACES)
                value[late] = mix(self.far[part[late]] + place[late].astype(U64) * self.odd[0])
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(value, out=sums[1:])
            out[i:j] = mix(sums[e] - sums[s] + (e - s).astype(U64) * self.odd[1])
            i = j
        return out

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k consecutive words (may cross documents: the caller masks those)."""
        n = len(words) - k + 1
        if n <= 0:
            return np.empty(0, U64)
        out = np.empty(n, U64)
        for lo in range(0, n, CHUNK // 4):
            hi = min(n, lo + CHUNK // 4)
            power, size, made, held = words[lo : hi + k - 1], 1, None, 0
            while True:
                if k & size:
                    made = power if made is None else mix(made[: len(power) - held] * self.odd[2] + power[held:])
                    held += size
                if held == k:
                    break
                power = mix(power[:-size] * self.odd[3] + power[size:])
                size *= 2
            out[lo:hi] = mix(made[: hi - lo] * self.odd[4] + U64(k))
        return out


def fresh_seed() -> int:
    """128 random bits; drawn by the driver, so a repeated task hashes alike."""
    return secrets.randbits(128)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls count as empty. Works on slices."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, max_bytes: int, max_docs: int):
    """Cut documents into runs of at most max_bytes (one document at least) and max_docs."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), i + max_docs, n)
        yield i, j
        i = j


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word spans in ``data`` over the documents data[o[i]:o[i+1]]; words of
    document i are first[i]:first[i+1]. Positions are relative to offsets[0]."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    n = len(part)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[part]
    cut = np.zeros(n + 1, bool)
    cut[offsets - base] = True
    begin, finish = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    finish[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets - base)


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on Arrow batches to Python workers hold about ``most`` bytes, in this session; a smaller setting stays.

    Plans take the setting when they run, so it outlasts the query that is built here. No result depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= most:
        spark.conf.set(key, f"{most}b")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, each: int = 8 << 20, least: int = 16, most: int = 1 << 17) -> int:
    """A power of two of hash buckets, so that a bucket's share of ``df`` stays small."""
    want = max(1, min(estimated_bytes(df), each * most) // each)
    return max(least, min(most, 1 << (int(want) - 1).bit_length()))


def split_buckets(hashes: np.ndarray, n_buckets: int):
    """(bucket, lo, hi) runs of ascending ``hashes`` by their top bits."""
    shift = U64(64 - n_buckets.bit_length() + 1) if n_buckets > 1 else None
    tops = (hashes >> shift).astype(np.int64) if shift is not None else np.zeros(len(hashes), np.int64)
    edges = np.flatnonzero(np.diff(tops)) + 1
    lo = np.concatenate([[0], edges]) if len(tops) else np.empty(0, np.int64)
    hi = np.append(edges, len(tops)) if len(tops) else lo
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        yield int(tops[a]), a, b
