"""Packing token sequences by multiway Karmarkar-Karp differencing.

A document's ids are cut into whole windows, which stand alone, and a rest. The rests are cut into
pieces of at most ``quantum`` ids. Hash groups of about ``group_pieces`` pieces are each divided into
the fewest windows that could hold them: differencing merges the two partial partitions whose
imbalance is largest, matching the fullest windows of one with the emptiest of the other, until one
partition is left. If its fullest window is over capacity, the count rises by one and it is done again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.bpe import bpe
from perilframe.llm.common import slices

CAPACITY, QUANTUM, GROUP_PIECES = 1024, 256, 4000
_END = b"\0\0\0\0"
_PIECE = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by multiway differencing into ``windows`` near-equal sums."""
    n = len(sizes)
    if windows <= 1 or n <= windows:
        return np.arange(n) if windows > 1 else np.zeros(n, np.int64)
    # The first partial partitions: each holds ``windows`` sizes, one in each window, so that the largest pieces start apart.
    order = np.argsort(-sizes, kind="stable")
    heap, sums, made = [], {}, {}
    for k, at in enumerate(range(0, n, windows)):
        items = order[at : at + windows]
        s = np.zeros(windows, np.int64)
        s[: len(items)] = sizes[items]
        sums[k] = s
        made[k] = items
        heap.append((int(s[-1] - s[0]), k))
    heapq.heapify(heap)
    nodes: list[tuple[int, int, np.ndarray]] = []
    fresh = len(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        perm = np.argsort(-both, kind="stable")
        sums[fresh] = both[perm] - both[perm][-1]
        nodes.append((a, b, perm))
        heapq.heappush(heap, (int(sums[fresh][-1] - sums[fresh][0]), fresh))
        fresh += 1
    slots = {heap[0][1]: np.arange(windows)}
    out = np.zeros(n, np.int64)
    for node, (a, b, perm) in zip(range(fresh - 1, fresh - 1 - len(nodes), -1), reversed(nodes)):
        dest = np.empty(windows, np.int64)
        dest[perm] = slots.pop(node)
        slots[a], slots[b] = dest, dest[::-1]
    for k, items in made.items():
        out[items] = slots[k][: len(items)]
    return out


def divide(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size: near-equal sums, none over capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        out = differencing(sizes, windows)
        if len(sizes) == 0 or np.bincount(out, weights=sizes).max() <= capacity:
            return out
        windows += 1


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, quantum: int = QUANTUM) -> DataFrame:
    """Every document's pieces; each document ends with id 0, a null text is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            rows = []
            for doc, row, text in zip(frame["doc_id"], frame["row"], frame["text"]):
                ids = memoryview(bpe(path).encode(text) + _END)
                n = len(ids) // 4
                whole = n - n % capacity
                cuts = [*range(0, whole, capacity), *range(whole, n, quantum), n]
                rows += [(doc, row, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n) for a, b in zip(cuts, cuts[1:])]
            yield pd.DataFrame(rows, columns=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInPandas(run, _PIECE)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, quantum: int = QUANTUM, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces of a sequence lie one after the other from offset 0; no sequence is over ``capacity``.
    Repeated rows are packed once each; other columns are not looked at; of no rows it makes none.
    """
    from perilframe.llm.common import stored

    cut = stored(pieces(docs, path, capacity, quantum), "pieces")
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))

    def window(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "row", "start"], kind="stable")
        sizes = frame["length"].to_numpy(np.int64)
        to = divide(sizes, capacity)
        order = np.argsort(to, kind="stable")
        frame, to, sizes = frame.iloc[order], to[order], sizes[order]
        before = np.cumsum(sizes) - sizes
        first = np.r_[True, to[1:] != to[:-1]]
        offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(to)]))
        group = frame["pack_group"].to_numpy(np.int64)
        out = frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        return out.assign(sequence_id=((group + 1) << 24) + to, offset=offset).astype({"doc_id": "Int64"})

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rest.withColumn("pack_group", F.pmod(F.xxhash64("row", "start"), F.lit(groups))).groupBy("pack_group").applyInPandas(window, schema)
    alone = cut.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
