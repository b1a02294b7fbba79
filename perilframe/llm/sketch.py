"""Arrays of a stated size, gathered over all rows of a table, and filters of hashes made of them.

Every partition adds its rows up in an array of its own; arrays are cut into slices and slices are
merged in rounds of at most ``FAN`` at a time, so that no task gets more than that many. What reaches
the driver, and is then broadcast, is one array of the stated size, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame

SLICES, FAN = 32, 64
#: Bits of a filter for each hash it holds, and the least and the most of them as powers of two.
FILTER_LOAD, FILTER_LEAST, FILTER_MOST = 24, 16, 28
_SCHEMA = "slice int, block long, data binary"
_CODEC = pa.Codec("zstd", compression_level=1)


def _pack(x: np.ndarray) -> bytes:
    """An array of counts, compressed, in the narrowest type that holds it."""
    kind = next(k for k in ("u1", "u2", "u4", "u8") if int(x.max(initial=0)) <= np.iinfo(k).max)
    return kind.encode() + len(x).to_bytes(8, "little") + _CODEC.compress(x.astype(kind).tobytes(), asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    kind, n = bytes(data[:2]).decode(), int.from_bytes(data[2:10], "little")
    return np.frombuffer(_CODEC.decompress(bytes(data[10:]), n * np.dtype(kind).itemsize, asbytes=True), kind)


def gather(df: DataFrame, add: Callable[[np.ndarray, pd.DataFrame], None], size: int, dtype: str, either: bool = False) -> np.ndarray:
    """``add(array, frame)`` over all rows of df, then the sum (or the bitwise or) of the arrays."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, any_rows = np.zeros(size, dtype), False
        for frame in frames:
            any_rows = any_rows or len(frame) > 0
            add(own, frame)
        if any_rows:
            yield from emit(own)

    return merged(df.mapInPandas(scan, _SCHEMA), size, dtype, either)


def emit(own: np.ndarray) -> Iterator[pd.DataFrame]:
    """A partition's array as rows of slices."""
    block = TaskContext.get().partitionId() // FAN
    for k, x in enumerate(np.array_split(own, SLICES)):
        if x.any():
            yield pd.DataFrame({"slice": [k], "block": [block], "data": [_pack(x)]})


def merged(rows: DataFrame, size: int, dtype: str, either: bool = False, finish: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """``finish`` of the array that rows of slices make together, slice by slice."""

    def merge(last: bool):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            total = _unpack(frame["data"].iloc[0]).astype(dtype)
            for x in frame["data"].iloc[1:]:
                if either:
                    total |= _unpack(x).astype(dtype)
                else:
                    total += _unpack(x)
            return pd.DataFrame({"slice": frame["slice"].iloc[:1].array, "block": [int(frame["block"].iloc[0]) // FAN], "data": [_pack(finish(total) if last else total)]})

        return run

    # FAN partitions, then FAN blocks of them, then a slice's blocks of FAN * FAN partitions.
    out = rows.groupBy("slice", "block").applyInPandas(merge(False), _SCHEMA)
    out = out.groupBy("slice", "block").applyInPandas(merge(False), _SCHEMA)
    out = out.groupBy("slice").applyInPandas(merge(True), _SCHEMA)
    parts = np.array_split(finish(np.zeros(size, dtype)), SLICES)
    for r in out.select("slice", "data").collect():
        parts[r["slice"]] = _unpack(bytes(r["data"]))
    return np.concatenate(parts)


def cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter for each hash."""
    return cell(hashes, bits), cell(hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits)


class Filter:
    """A broadcast set of hashes that may hold others, too: two bits a hash, FILTER_LOAD bits for each."""

    def __init__(self, df: DataFrame, column: str, count: int | None = None):
        count = df.count() if count is None else count
        self.bits = int(np.clip(np.ceil(np.log2(max(1, count * FILTER_LOAD))), FILTER_LEAST, FILTER_MOST))
        bits = self.bits

        def add(own: np.ndarray, frame: pd.DataFrame) -> None:
            for at in _places(frame[column].to_numpy(np.int64), bits):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))

        found = gather(df.select(column), add, 1 << (bits - 3), "u1", either=True)
        self.held: Broadcast = df.sparkSession.sparkContext.broadcast(found)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        own, out = self.held.value, np.ones(len(hashes), bool)
        for at in _places(hashes, self.bits):
            out &= (own[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def drop(self) -> None:
        """Free it on the driver and the executors; what was made with it must be written by then."""
        self.held.destroy()
