"""Shared helpers: text batches as flat byte arrays, hashes of substrings, the shared scratch folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

U64 = np.uint64
_STEP = 6364136223846793005  # odd, so that it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: Which bytes are white space between words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def bound_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Make workers ready: they find this package, and one Arrow batch is small unless the session says otherwise."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not re.fullmatch(r"[0-9]{1,7}", spark.conf.get(key)):
        spark.conf.set(key, str(megabytes * 1_000_000))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir, or one of our own where the session names none.

    Only a session within one process may go without: executors elsewhere cannot read the driver's folders.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def column(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def settle(df: DataFrame) -> DataFrame:
    """Write a result to a table in the shared checkpoint folder and read it from there, which cuts its lineage.

    What earlier steps have left in shuffle files is not needed any more. Spark removes such files when the driver's
    collector finds their plans gone (a checkpoint() would keep them), so it is asked to look.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    collect_plans(spark)
    df.write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(path)  # native codecs keep memory
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    del df
    collect_plans(spark)
    return out


def collect_plans(spark: SparkSession) -> None:
    """Let go of the plans of queries that have ended: those that Python still holds, those in events not yet heard,
    and that of the last job, which the scheduler's loop holds until it has seen another."""
    gc.collect()
    spark.range(0, 1, 1, 1).collect()
    with contextlib.suppress(Py4JError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(2000)
    spark.sparkContext._jvm.System.gc()


def forget(*settled: DataFrame) -> None:
    """Remove the tables of settled results that nothing reads any more."""
    for df in settled:
        remove(df.sparkSession, df._settled)


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder in the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join for which both sides are exchanged, so that Spark can split a hot key's rows at run time.

    Where one side is an aggregate on the same keys, its exchange would serve the join too, and
    could not be split. One more key, a hash of the others, asks for exchanges of the join's own.
    """
    h = F.xxhash64(*keys)
    return left.withColumn("__h", h).join(right.withColumn("__h", h), [*keys, "__h"], how).drop("__h")


#: What drops the tables that a Python worker keeps between tasks.
DROPS: list[Callable[[], None]] = []
_user = ""


def enter(user: str) -> None:
    """Called first in a Python worker's task. A worker is used again by later stages: what another operator
    has left in it goes before this one fills its own tables."""
    global _user
    if _user != user:
        for drop in [_POWERS.clear, *DROPS]:
            drop()
        _user = user
        trim()


def trim() -> None:
    """Hand memory that a Python worker has freed back to the system; done between groups of rows."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def block_count(spark: SparkSession, total: int, most: int, least: int = 128 << 10) -> int:
    """Into how many blocks to deal so many bytes: as many as there are shuffle partitions, but of no less than
    `least` bytes each, and more where they would pass `most`."""
    return max(1, min(shuffle_parts(spark), -(-total // least)), -(-total // most))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place (a finaliser of multiply and shift)."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def powers(step: int, n: int) -> np.ndarray:
    have = _POWERS.get(step)
    if have is None or len(have) < n:
        have = np.full(max(n, (1 << 20) + 1), step, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 21:
            _POWERS[step] = have
    return have[:n]


class Rolling:
    """Hashes of windows of a byte array, from prefix sums modulo 2**64.

    Different strings of a regular pattern may share one: good for fingerprints that are compared in full later.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        terms = data.astype(U64)
        terms += U64(1)
        terms *= powers(_STEP, n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(terms, out=self.sums[1:])
        self.back = powers(_BACK, n + 1)

    def windows(self, k: int) -> np.ndarray:
        """Of all k bytes long substrings, by their start."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.back[: len(h)]
        return mix(h)


#: Longer strings are hashed one by one.
LONG = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of substrings, eight bytes after eight bytes, each step scrambled: no two inputs of a simple
    pattern share one, as they may with prefix sums."""
    size = end - start
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    alive = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, own = start[alive], size[alive], h[alive]
    while len(alive):
        own ^= lanes[at] & _MASK[np.minimum(left, 8)]
        own *= U64(0x9E3779B97F4A7C15)
        own = mix(own)
        h[alive] = own
        more = np.flatnonzero(left > 8)
        alive, at, left, own = alive[more], at[more] + 8, left[more] - 8, own[more]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=key).digest(), "little")
    return h


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column back to back, and where each text starts and ends. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most `most` bytes together (a longer text stands alone)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


class Words:
    """Words of texts that stand back to back: where they start and end, which text each is of, how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.space = SPACE[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        gap = np.ones(n + 1, bool)
        gap[1:] = self.space
        self.start = np.flatnonzero(~self.space & (gap[:-1] | edge[:-1]))
        gap[:-1] = self.space
        gap[-1] = True
        self.end = np.flatnonzero(~self.space & (gap[1:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def as_long(values) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.int64))
