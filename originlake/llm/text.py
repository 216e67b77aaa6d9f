"""Shared pieces: Arrow text in bounded chunks, words and hashes in numpy, tables that cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a temporary one is set, but only if driver and executors are one process: on a cluster its files
    would lie on several machines, and reads would miss some without a word.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: later stages start from the files, whatever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for tables in getattr(_OPEN, "stack", ()):
        tables.append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The written result of ``make``; other tables that this thread wrote for it are removed."""
    if not hasattr(_OPEN, "stack"):
        _OPEN.stack = []
    _OPEN.stack.append([])
    try:
        out = cut(make())
    finally:
        tables = _OPEN.stack.pop()
    drop(*(t for t in tables if t is not out))
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_buffers(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string array: (first row, end row, bytes, offsets into the bytes); null is empty.

    A range holds at most ``max_bytes`` unless a single text is longer.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), len(col))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that stay within one text, and the first run of each text."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: starts, ends, and for each text its first word's index (and the end)."""
    return runs_of(~_WS[data], offsets)


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of the inverse base; kept for the next call."""
    name = "inv" if inverse else "fwd"
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done, step = 1, np.uint64(_INV if inverse else _BASE)
        mul = int(step)
        while done < size:
            k = min(done, size - done)
            out[done : done + k] = out[:k] * np.uint64(mul)
            done += k
            mul = mul * mul % (1 << 64)
        _POWERS[name] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums c with which the hash of data[a:b] is ``span_hash(c, a, b)``."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * powers(len(data)), out=c[1:])
    return c


def span_hash(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    return mix((c[b] - c[a]) * powers(len(c), True)[a])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, A-Z lower-cased, and each text's first word (and the end).

    A long text is read in segments, so beside the hashes it takes a bounded amount of memory, however long its words are.
    """
    if len(data) <= CHUNK_BYTES:
        low = lower_ascii(data)
        s, e, first = words_of(low, offsets)
        return span_hash(prefix_hash(low), s, e), first
    texts = [_long_words(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _long_words(data: np.ndarray) -> np.ndarray:
    out = []
    part, size = np.zeros(1, np.uint64), 0  # of the word that the last segment ends in: its sum and length so far
    for x in range(0, len(data), CHUNK_BYTES):
        low = lower_ascii(data[x : x + CHUNK_BYTES])
        s, e, _ = words_of(low, np.array([0, len(low)]))
        c = prefix_hash(low)
        sums = (c[e] - c[s]) * powers(len(c), True)[s]
        if size and len(s) and s[0] == 0:
            sums[:1] = part + sums[:1] * np.uint64(pow(_BASE, size, 1 << 64))
            size += int(e[0])
        elif size:
            sums = np.concatenate([part, sums])
            size = 0
        if len(s) and e[-1] == len(low):
            part, sums = sums[-1:].copy(), sums[:-1]
            size = size if len(s) == 1 and s[0] == 0 and size else int(e[-1] - s[-1])
        else:
            size = 0
        out.append(mix(sums))
    return np.concatenate([np.zeros(0, np.uint64), *out, *([mix(part)] if size else [])])


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring values, one for each start (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for a in range(0, n, CHUNK_BYTES):
        part = out[a : a + CHUNK_BYTES]
        for j in range(k):
            part += mix(h[a + j : a + j + len(part)] + np.uint64(j * 0x632BE59BD9B4E019 % (1 << 64)))
        part[:] = mix(part)
    return out
