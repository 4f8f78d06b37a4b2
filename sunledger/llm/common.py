"""Shared helpers: tables in the shared folder, and vectorised hashing of texts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger.stored import stored

#: Bytes of text hashed at a time in a Python worker (one longer text is taken whole).
CHUNK_BYTES = 1 << 18
U = np.uint64
#: Fixed odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    return stored(df, name)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize wrote, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids under this stand for null ones.
NULL_IDS = -(1 << 62)


def row_key(text: Column) -> Column:
    """With row_id: tells rows apart that share a doc_id; rows alike in both get the same results."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("th")


def row_id(doc_id: Column, text: Column) -> Column:
    """doc_id, and for null ones another hash of the text, under NULL_IDS: so row_id and row_key have 128 bits or so."""
    low = F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(doc_id.cast("long"), low.bitwiseOR(F.lit(-(1 << 63)))).alias("doc_id")


def own_id(of: Column) -> Column:
    """The doc_id that row_id was made of."""
    return F.when(of >= NULL_IDS, of).alias("doc_id")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row (null: empty)."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, off


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows with about limit bytes."""
    data, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    pa.default_memory_pool().release_unused()  # what batches before took


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


class Rolling:
    """Hashes of any slice of a sequence of 64-bit values from prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self.pow = np.ones(1, U)
        self.inv = np.ones(1, U)
        self.sums = np.zeros(1, U)

    def load(self, values: np.ndarray) -> None:
        n = len(values)
        if len(self.pow) <= n:
            size = max(n, CHUNK_BYTES) + 1
            for name, base in (("pow", BASE), ("inv", BASE_INV)):
                x = np.full(size, U(base))
                x[0] = U(1)
                setattr(self, name, np.cumprod(x, dtype=U))
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * self.pow[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of values[start:end] for each pair; equal slices have equal hashes wherever they lie."""
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of every slice of k values."""
        n = len(self.sums) - 1
        return mix((self.sums[k:] - self.sums[:-k]) * self.inv[: n - k + 1] + U(k)) if n >= k else np.zeros(0, U)


#: Words over this many bytes are hashed one by one; shorter ones by slices of the chunk's polynomial.
LONG_WORD = 64


def word_hashes(roll: Rolling, values: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word data[start:end].

    A polynomial modulo 2**64 gives long words of a certain make (Thue-Morse words of 1024 letters and their complements)
    equal hashes whatever its base, so it serves short words only; long ones get BLAKE2b.
    """
    roll.load(values[data])
    out = roll.slices(start, end)
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U) * U(BASE)) | U(1)


def separators() -> np.ndarray:
    """Which bytes separate words: space, and the ASCII controls from tab to carriage return."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def lowered() -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ of a chunk, and the offset of each row's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    sep = is_sep[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, sep[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, sep[1:]
    start = np.flatnonzero(~sep & (before | edge[:-1]))
    end = np.flatnonzero(~sep & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, bounds)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if size < w else v


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_CACHE: dict = {}


def worker_cache() -> dict:
    """A dictionary that lasts as long as the Python worker, over all its tasks; operators that need much memory empty it."""
    return _CACHE
