"""What the operators share: tables, the shared folder, Arrow batches and vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python; both bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all runs in one process (tests),
    one set here; an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))  # one process has one disk
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    trim_driver(spark)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans up
            pass

    atexit.register(drop)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# -- memory of reused workers ---------------------------------------------------------------------

_kept: dict[str, Callable[[], None]] = {}
_current: str | None = None


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Declare what a module keeps in a worker between tasks, and how to drop it."""
    _kept[name] = drop


def begin(name: str | None = None) -> None:
    """A task of name begins: a worker that served another operator before drops what that one kept."""
    global _current
    if name != _current:
        for other, drop in _kept.items():
            if other != name:
                drop()
        _current = name
        trim()


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and an idle one should not hold its last task's peak; nor
    should the driver's Python."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> bool:
    """Have the driver's JVM give freed native memory back; was it done? Planning and compiling many queries leaves some
    hundred MB free in the C library's arenas, beside the heap. Where the JVM has no such command, nothing is done."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        lang = jvm.java.lang
        kinds, values = gateway.new_array(lang.Class, 4), gateway.new_array(lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method, as the server's own class is not exported
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Exception:  # noqa: BLE001  a JVM of another kind or age
        return False
    return True


Batches = Iterator[pa.RecordBatch]


def task(run: Callable[[Batches], Batches], name: str | None = None) -> Callable[[Batches], Batches]:
    """run as a mapInArrow function that begins as name and trims the worker's memory when it ends."""

    def wrapped(batches: Batches) -> Batches:
        begin(name)
        yield from run(batches)
        trim()

    return wrapped


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def per_row(schema: pa.Schema, one: Callable[..., tuple], *names: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls one(column values...) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            yield arrow_rows(schema, [one(*values) for values in zip(*columns, strict=True)])

    return task(run)


# -- vectorised hashing -------------------------------------------------------------------------

_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHasher:
    """64-bit hashes of all words of a text in a few array passes.

    Every place in a word has its own table of random numbers for its byte; a word's hash is their sum, mixed, so words that
    differ anywhere collide with a chance of 2^-64, whatever their pattern. A sequence's hash is the sum of its words' hashes,
    each times its place's odd factor, mixed. Tables and factors follow from the seed: hashers of different seeds are independent.
    """

    CHUNK, DEEP = 1 << 18, 64

    def __init__(self, seed: int, fold_case: bool = False) -> None:
        rng = np.random.default_rng(seed)
        table = rng.integers(0, _M64, (self.DEEP, 256), dtype=np.uint64, endpoint=True)
        if fold_case:
            table[:, 65:91] = table[:, 97:123]
        self.table = table.ravel()
        self.salt = int(rng.integers(1, _M64, dtype=np.uint64, endpoint=True))
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True

    def words(self, data: bytes) -> np.ndarray:
        """Hashes of the words [^\\x20\\x09-\\x0D]+ of UTF-8 text, in order."""
        out = [self._some(part) for part in _parts(data, self.CHUNK)]
        return np.concatenate(out) if len(out) > 1 else out[0]

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one text after the other, and where each text's words begin (one more at the end)."""
        if not texts:
            return np.empty(0, np.uint64), np.zeros(1, np.int64)
        out, counts, some, size = [], [], [], 0

        def flush() -> None:
            raw = np.frombuffer(b"\n".join(some), np.uint8)
            begin, end = bounds(~self.space[raw])
            starts = np.cumsum([0, *(len(t) + 1 for t in some)])
            counts.append(np.diff(np.searchsorted(begin, starts)))
            out.append(self.mixed(self.sums(raw, begin), begin, end))

        for t in texts:
            if size + len(t) + 1 > self.CHUNK and some:
                flush()
                some, size = [], 0
            if len(t) >= self.CHUNK:
                out.append(self.words(t))
                counts.append([len(out[-1])])
                continue
            some.append(t)
            size += len(t) + 1
        if some:
            flush()
        return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)

    def values(self, raw: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The random number of each byte at its place in its word."""
        out = self.table[(place & (self.DEEP - 1)) << 8 | raw]
        far = np.flatnonzero(place >= self.DEEP)
        if len(far):
            out[far] = mix(out[far] + (place[far] // self.DEEP).astype(np.uint64) * np.uint64(self.salt | 1))
        return out

    def sums(self, raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Running sums of the bytes' numbers, one more than bytes; what lies between words counts for none of them."""
        total = np.zeros(len(raw) + 1, np.uint64)
        if len(begin):
            first = begin[0]
            place = np.arange(first, len(raw), dtype=np.int64) - np.repeat(begin, np.diff(begin, append=len(raw)))
            np.cumsum(self.values(raw[first:], place), out=total[first + 1 :])
        return total

    def mixed(self, total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(total[end] - total[begin] + (end - begin).astype(np.uint64))

    def _some(self, data: bytes) -> np.ndarray:
        if len(data) > self.CHUNK:  # one word longer than a chunk
            words = data.split()
            return np.array([self._one(w) for w in words], np.uint64) if words else np.empty(0, np.uint64)
        raw = np.frombuffer(data, np.uint8)
        begin, end = bounds(~self.space[raw])
        return self.mixed(self.sums(raw, begin), begin, end)

    def _one(self, word: bytes) -> int:
        value = len(word)
        for at in range(0, len(word), self.CHUNK):
            raw = np.frombuffer(word[at : at + self.CHUNK], np.uint8)
            value += int(self.values(raw, np.arange(at, at + len(raw))).sum(dtype=np.uint64))
        return int(mix(np.array([value & _M64], np.uint64))[0])

    def factors(self, n: int) -> np.ndarray:
        """Odd factors of the first n places of a sequence."""
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(self.salt)) | np.uint64(1)

    def windows(self, words: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all runs of width consecutive words; empty where there are fewer."""
        n = len(words) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k, factor in enumerate(self.factors(width)):
            out += words[k : k + n] * factor
        return mix(out)

    def whole(self, words: np.ndarray) -> int:
        """Hash of a word sequence of any length."""
        value = int((words * self.factors(len(words))).sum(dtype=np.uint64)) + len(words)
        return int(mix(np.array([value & _M64], np.uint64))[0])


def bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values."""
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


def _parts(data: bytes, size: int) -> list[bytes]:
    """data cut at white space into parts of about size bytes; a word is never cut."""
    if len(data) <= size:
        return [data]
    parts, at = [], 0
    while len(data) - at > size:
        cut = max(data.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [c for c in (data.find(s, at + size) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if c >= 0]
            cut = min(found, default=len(data))
        parts.append(data[at:cut])
        at = cut
    if at < len(data):
        parts.append(data[at:])
    return parts
