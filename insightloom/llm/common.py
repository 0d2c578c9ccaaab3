"""Shared helpers of the corpus operators: word scanning, hashing, sizing."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes \x20 and \x09-\x0D separate words; everything else is part of one.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared checkpoint directory.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset
    and the master is local (tests) a folder of our own is configured.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: the executors need a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table written to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.folder_ = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialised tables whose readers have all been written."""
    for t in tables:
        if path := getattr(t, "folder_", None):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def partitions(df: DataFrame, mb: float) -> int:
    """Number of partitions that gives each about ``mb`` MB of df's plan size,
    never below the session's shuffle partitions.  Needs no job."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # a plan without statistics
        size = 0
    return max(least, min(1 << 20, math.ceil(size / (mb * 1e6))))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64 (public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Word table of a batch of texts, found with vector operations only.

    ``buf``: the UTF-8 bytes, one separator byte after each text; ``start`` and
    ``end``: byte offsets of each word; ``first``: index of each text's first
    word (``len(texts) + 1`` entries).  A null text has no word.
    """

    def __init__(self, texts: list, lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
        self.raw = b"\n".join(raw) + b"\n"
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        if lower:
            self.buf = ASCII_LOWER[self.buf]
        inside = np.empty(len(self.buf) + 1, dtype=bool)
        inside[0] = False
        np.logical_not(SPACE[self.buf], out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        at = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=at[1:])
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes: words of up to eight bytes as the
        number that they spell, mixed, longer ones by xxh3."""
        out = np.empty(len(self.start), dtype=np.uint64)
        padded = np.append(self.buf, np.zeros(8, dtype=np.uint8))
        step = 1 << 20
        for i in range(0, len(out), step):
            start, size = self.start[i : i + step], self.end[i : i + step] - self.start[i : i + step]
            spelt = np.zeros(len(start), dtype=np.uint64)
            for k in range(min(8, int(size.max()))):
                spelt |= np.where(size > k, padded[start + k], np.uint8(0)).astype(np.uint64) << np.uint64(8 * k)
            with np.errstate(over="ignore"):
                out[i : i + step] = mix(mix(spelt) + size.astype(np.uint64) * _B)
        long = np.flatnonzero(self.end - self.start > 8)
        view = memoryview(self.buf)
        for i in range(0, len(long), 1 << 14):  # few Python objects at a time
            some = long[i : i + (1 << 14)]
            out[some] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(self.start[some].tolist(), self.end[some].tolist(), strict=True)]
        return out


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; ``len(word) - k + 1`` entries."""
    n = len(word) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            h = (h ^ word[i : i + n]) * _B
            h = h ^ (h >> np.uint64(29))
        return mix(h)


def by_bytes(batches, column: str, most: int = 8_000_000, rows: int = 1 << 20):
    """Re-cut Arrow batches so that each piece holds about ``most`` bytes of
    ``column``, and no more than ``rows`` rows."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(size)))
        i = 0
        while i < len(size):
            j = int(np.searchsorted(upto, upto[i] + most, side="right")) - 1
            j = min(max(i + 1, j), i + rows, len(size))
            yield b.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()  # workers live on, their neighbours need the memory


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another behind their sizes in bytes: no more than four
    bytes each beside their content, however few items they hold."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(r) for r in raw], dtype="<u4").tobytes() + b"".join(raw)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    """The arrays of a ``pack``, by their item types."""
    size = np.frombuffer(blob, dtype="<u4", count=len(types))
    at, out = 4 * len(types), []
    for n, t in zip(size.tolist(), types, strict=True):
        out.append(np.frombuffer(blob, dtype=t, count=n // np.dtype(t).itemsize, offset=at))
        at += n
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out
