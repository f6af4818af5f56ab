"""Shared plumbing: Arrow batches of bounded size, the shared folder, words.

Python operators here all have the same shape: read a few columns, hand Arrow
batches to a generator that keeps no state but bounded caches, and return
narrow rows. A lost executor only repeats its own batches.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.shipping import ship

#: Rows in an Arrow batch; keeps a batch of very long texts within memory.
ROWS = 500
_WORD = re.compile(r"\w+")


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table's columns by name, in this order."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, remember: bool = True) -> DataFrame:
    """``fn`` over Arrow batches of at most ``ROWS`` rows; narrow, no shuffle.

    Unless it may ``remember``, a worker that has ended its task gives back
    what it holds, for idle workers stay and count as memory of the executor.
    """

    ship(df.sparkSession)
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = fn(batch.slice(at, ROWS))
                if out is not None and out.num_rows:
                    yield out
        if not remember:
            give_back()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Makes Spark's Arrow batches about as small as what is worked on at once, in the whole session.

    For programs of their own, such as the registered queries; the operators
    leave the session as it is and cut what they get.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2 * ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(2 * ROWS))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names for checkpoints.

    Where none is named and all runs on one machine (tests), a temporary folder
    becomes the session's; a cluster must name one.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="stowage-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base}/stowage-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here.

    The folder is removed by ``drop``, or else when the session's program ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read any more."""
    for table in tables:
        forget(table.sparkSession, table._stored_at)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(forget, spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, if the session still runs."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone, or was never ours to clean
        pass


#: What a worker remembers, by the operator's module; and the module that it works for.
_remembered: list[tuple[str, Remembered]] = []
_claimed = ""


def claim(owner: str) -> None:
    """Drops what other operators remember, and gives it back: workers outlive operators, and their memory is shared."""
    global _claimed
    if owner != _claimed:
        for of, cache in _remembered:
            if of != owner:
                cache.clear()
                cache.before = {}
        _claimed = owner
        _trim()


def give_back() -> None:
    """Drops all that is remembered, and returns freed memory to the system where its C library can."""
    claim("")
    _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Remembered(dict):
    """A function's values for short strings, in two generations of ``limit`` strings: what is used again outlives the rest."""

    def __init__(self, of: Callable, limit: int, owner: str):
        super().__init__()
        self.of, self.limit, self.before = of, limit, {}
        _remembered.append((owner, self))

    def __missing__(self, key: str):
        found = self.before.get(key)
        if found is None:
            found = self.of(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[key] = found
        return found


def code(word: str) -> int:
    """A stable 64-bit code of a word."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class Codes(Remembered):
    """Codes of words as an array."""

    def __init__(self, owner: str, of: Callable[[str], int] = code, limit: int = 250_000):
        super().__init__(of, limit, owner)

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` codes; of all of them, if there are fewer."""
    n = min(width, len(codes))
    if not n:
        return codes
    total = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        total += codes[k : len(codes) - n + 1 + k] * _POWERS[k]
    return mixed(total)


def learns_from(column: str, modulus: int, held_out: int):
    """True for the rows that a model may learn from: crc32(id as text) mod ``modulus`` is another remainder."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) != held_out
