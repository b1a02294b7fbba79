"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task handles at once, and bytes that go to its Python worker at once: workers keep what they once took.
BATCH_CHARS, BATCH_BYTES = 1_000_000, 4 << 20
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to a Python worker at once, by rows and by bytes: texts may be long."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointing(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; set one only where none is set and all runs on one machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder."""
    checkpointing(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that a later one has taken the place of."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(frames: Iterator[pd.DataFrame], text: str = "text", limit: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """The rows in order, in frames of about ``limit`` characters (one row at least)."""
    for frame in frames:
        size = frame[text].str.len().fillna(0).to_numpy(dtype=np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield frame.iloc[a:b]


def one_thread() -> None:
    """Spark deals out the cores; libraries inside a task keep to one."""
    for name in ("TOKENIZERS_PARALLELISM", "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ[name] = "false" if name.startswith("TOK") else "1"


# --- words and shingles as 64-bit hashes -------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(0x5EED_2024))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_WINDOW = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POW: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _POW:
        _POW.extend((_powers(_BASE, 2 * _WINDOW + 1), _powers(_BASE_INV, 2 * _WINDOW + 1)))
    up, down = _POW if len(buf) < 2 * _WINDOW else (_powers(_BASE, len(buf) + 1), _powers(_BASE_INV, len(buf) + 1))
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place of data that has so many, a stretch that fits the cache at a time."""
    if not _POW:
        _POW.extend((_powers(_BASE, 2 * _WINDOW + 1), _powers(_BASE_INV, 2 * _WINDOW + 1)))
    up, down = _POW
    out = np.zeros(max(0, len(data) - size + 1), np.uint64)
    step = 1 << 15
    for a in range(0, len(out), step):
        buf = data[a : a + step + size - 1]
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
        out[a : a + step] = mix((total[size:] - total[:-size]) * down[: len(buf) - size + 1])
    return out


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of the words ``[^\\x20\\x09-\\x0D]+`` of data, a window at a time."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + _WINDOW)
        if to < len(data):
            cut = max(data.rfind(x, at, to) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:  # a word longer than a window
                cut = min((x for x in (data.find(c, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0), default=len(data))
            to = cut
        h, s, e = _window_words(np.frombuffer(data, np.uint8, to - at, at))
        out.append((h, s + at, e + at))
        at = to
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def shingle(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; of the whole sequence if it is shorter; none of nothing."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return np.array([shingle_one(words)], np.uint64)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : n - k + 1 + i]
    return mix(out)


def shingle_one(words: np.ndarray) -> np.uint64:
    x = len(words)
    for w in words.tolist():
        x = (x * 0xD6E8FEB86659FD93 + w) % 2**64
    return mix(np.array([x ^ 0xA5A5A5A5], np.uint64))[0]


class Words:
    """The words of a batch of texts, read as one run of bytes with a line feed after each.

    Positions are bytes of that run; ``origin`` holds where each text starts, ``text`` whose a word is.
    """

    def __init__(self, texts: Sequence[str | None]):
        parts = [lower_ascii(t) for t in texts]
        self.data = b"\n".join(parts) + b"\n"
        sizes = np.array([len(x) + 1 for x in parts], np.int64)
        self.origin = np.cumsum(sizes) - sizes
        self.words, self.starts, self.ends = hash_words(self.data)
        self.text = np.searchsorted(self.origin, self.starts, side="right") - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of all texts, text after text, and where each text's begin (one more at the end)."""
        n = len(self.words)
        count = np.bincount(self.text, minlength=len(self.origin)) if n else np.zeros(len(self.origin), np.int64)
        if n >= k:
            whole = self.text[k - 1 :] == self.text[: n - k + 1]
            every, owner = shingle(self.words, k)[whole], self.text[: n - k + 1][whole]
        else:
            every, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            first = np.cumsum(count) - count
            ones = np.array([shingle_one(self.words[first[i] : first[i] + count[i]]) for i in short], np.uint64)
            every = np.insert(every, np.searchsorted(owner, short), ones)
        sizes = np.where(count < k, np.minimum(count, 1), count - k + 1)
        return every, np.r_[0, np.cumsum(sizes)]


def distinct_slices(every: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each slice sorted (in place) and without repeats, slice after slice, and the new cuts."""
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        every[a:b].sort()
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    fresh[cuts[:-1][cuts[:-1] < len(every)]] = True
    return every[fresh], np.r_[0, np.cumsum(fresh)][cuts]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def as_documents(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) for c in DOCUMENT_COLUMNS))
