"""What the corpus operators share: cutting lineage, bounded batches, reading tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once; a single longer text makes a batch of its own.
BATCH_BYTES = 1 << 20
#: Spark's bound on the bytes of an Arrow batch.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: White space of the contracts: blank and the five control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: later jobs neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t.table_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: What operators hold in this worker beyond a task, by name, and how it is released.
_held: dict[str, Callable[[], None]] = {}


def hold(name: str, release: Callable[[], None]) -> None:
    """From now on this worker holds something under that name; the next task of another operator releases it first."""
    _held[name] = release


def _let_go(holds: str) -> None:
    """Releases what others than `holds` hold in this worker."""
    for name in [x for x in _held if x != holds]:
        _held.pop(name)()


def _trim() -> None:
    """Gives free memory back, as workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def in_arrow(df: DataFrame, fn, schema: str, holds: str = "") -> DataFrame:
    """df.mapInArrow(fn, schema) with batches of bounded bytes, where the session sets no bound of its own.

    A worker first releases what other operators hold in it; what fn holds under the name `holds` stays for its later tasks.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES, None) is None:
        conf.set(ARROW_BYTES, str(4 * BATCH_BYTES))

    def own(batches):
        _let_go(holds)
        yield from fn(batches)
        _trim()

    return df.mapInArrow(own, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most `most`, or a single larger row."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def texts(column) -> list[str]:
    """An Arrow string column as str, null as empty."""
    return [x or "" for x in column.to_pylist()]


def encoded(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(*parts):
    """60 bits of SHA-256 over strings joined by |, null as empty: an order that SQL can say too."""
    said = F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def utf8_bytes(column: str = "text"):
    """Length in UTF-8 bytes, null as 0."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


_BASE = 0x9E3779B97F4A7C15
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def wrapping_powers(n: int, inverse: bool = False) -> np.ndarray:
    """_BASE^0 .. _BASE^n, or of its inverse, modulo 2^64; the tables double as longer arrays come."""
    b = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    while len(_tables[inverse]) <= n:
        t = _tables[inverse]
        step = np.uint64(int(t[-1]) * b & 0xFFFFFFFFFFFFFFFF)
        _tables[inverse] = np.concatenate([t, t * step])
    return _tables[inverse]


#: Symbols that span_hashes turns into arrays at once; a single longer span makes a window of its own.
WINDOW = 1 << 18


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of symbols, by their content alone. Spans come in ascending order.

    Spans are hashed window by window, since the arrays of one window are many times as large as its symbols.
    """
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        first = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, first + WINDOW, side="right")))
        out[lo:hi] = _hashes(symbols[first : ends[hi - 1]], starts[lo:hi] - first, ends[lo:hi] - first)
        lo = hi
    return out


def _hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(symbols)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(symbols.astype(np.uint64) + np.uint64(1)) * wrapping_powers(n)[:n], out=h[1:])
    return mixed((h[ends] - h[starts]) * wrapping_powers(n, True)[starts] + (ends - starts).astype(np.uint64))
