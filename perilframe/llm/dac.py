"""Token ids in directly addressable codes.

An id is cut into chunks of ``bits`` bits, lowest first. Level 0 holds the first chunk of every id,
level k the (k+1)-th chunk of the ids that have one. A level's bitmap says which of its entries go on;
a rank directory (ones before each block of 512 entries) finds the entry of the next level. Any id is
read by one look-up a level, without decoding its neighbours.

A segment holds the ids of a run of documents: ``DAC1``, bits, levels, documents and ids, the
documents' starts, then for each level its entries, bitmap, directory and chunks. Segments are rows of
Parquet files, partitioned by range of doc_id, so Spark can write and read them on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilframe.llm.bpe import bpe
from perilframe.llm.common import shared_path, slices

_BLOCK = 512
_MAGIC = b"DAC1"
SEGMENT = "part long, segment long, first_start long, n_docs long, n_ids long, doc_ids binary, doc_nulls binary, data binary"


def encode_segment(ids: np.ndarray, starts: np.ndarray, bits: int = 8) -> bytes:
    """A segment of ids (unsigned 32-bit) and the starts of its documents (one more than documents)."""
    width = np.uint8 if bits <= 8 else np.uint16
    levels, left = [], ids.astype(np.uint32)
    while True:
        more = left >> np.uint32(bits)
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(left), _BLOCK)) if len(left) else np.zeros(0)
        directory = np.concatenate(([0], np.cumsum(ones, dtype=np.int64))).astype("<u4")
        levels.append((len(left), bitmap, directory, (left & np.uint32((1 << bits) - 1)).astype(width)))
        left = more[goes_on]
        if not len(left):
            break
    out = [_MAGIC, struct.pack("<BBxxQQ", bits, len(levels), len(starts) - 1, len(ids)), starts.astype("<u8").tobytes()]
    for n, bitmap, directory, chunks in levels:
        out += [struct.pack("<Q", n), bitmap.tobytes(), directory.tobytes(), chunks.tobytes()]
    return b"".join(out)


class Segment:
    """A read segment: ``segment[i]`` is its i-th id; ``document(k)`` the ids of its k-th document."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a segment")
        self.bits, n_levels, docs, self.n_ids = struct.unpack_from("<BBxxQQ", data, 4)
        at = 24
        self.starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        width = np.dtype(np.uint8 if self.bits <= 8 else "<u2")
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            parts = []
            for kind, count in ((np.uint8, -(-n // 8)), ("<u4", -(-n // _BLOCK) + 1), (width, n)):
                parts.append(np.frombuffer(data, kind, count, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for k, (bitmap, directory, chunks) in enumerate(self.levels):
            out |= int(chunks[i]) << (k * self.bits)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return out
            block = i // _BLOCK
            inside = np.unpackbits(bitmap[block * _BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * _BLOCK]
            i = int(directory[block]) + int(inside.sum())
        return out

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b, from as much of each level as they need."""
        out = np.zeros(max(0, b - a), np.uint32)
        where = np.arange(len(out))
        for k, (bitmap, directory, chunks) in enumerate(self.levels):
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(k * self.bits)
            first = a // _BLOCK * _BLOCK
            on = np.unpackbits(bitmap[first // 8 : -(-b // 8)], bitorder="little")[: b - first].astype(bool)
            a2 = int(directory[first // _BLOCK]) + int(on[: a - first].sum())
            on = on[a - first :]
            where = where[on]
            a, b = a2, a2 + int(on.sum())
            if a == b:
                break
        return out

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, path: str, out: str, end_id: int = 1, bits: int = 8, segment_ids: int = 2_000_000) -> None:
    """Write the ids of docs in ascending doc_id order (nulls first; equal ones by text). Null texts are empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, done = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        keys: list = []
        held = 0
        end = int(end_id).to_bytes(4, "little")

        def flush() -> pd.DataFrame:
            nonlocal number, done, held
            starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
            data = encode_segment(np.frombuffer(b"".join(ids), "<u4"), starts, bits)
            null = np.array([pd.isna(x) for x in keys])
            row = pd.DataFrame({"part": [part], "segment": [number], "first_start": [done], "n_docs": [len(ids)], "n_ids": [int(starts[-1])], "doc_ids": [np.array([0 if z else int(x) for x, z in zip(keys, null)], "<i8").tobytes()], "doc_nulls": [np.packbits(null).tobytes()], "data": [data]})
            number, done, held = number + 1, done + int(starts[-1]), 0
            ids.clear()
            keys.clear()
            return row

        for frame in slices(frames):
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids.append(bpe(path).encode(text) + end)
                keys.append(doc)
                held += len(ids[-1]) // 4
                if held >= segment_ids:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInPandas(run, SEGMENT).write.option("compression", "uncompressed").parquet(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                s = Segment(r.data)
                keys = pd.array(np.frombuffer(r.doc_ids, "<i8"), "Int64")
                keys[np.unpackbits(np.frombuffer(r.doc_nulls, np.uint8))[: r.n_docs].astype(bool)] = pd.NA
                all_ids = memoryview(s.range(0, s.n_ids).astype("<u4").tobytes())
                ends = s.starts
                yield pd.DataFrame({"doc_id": keys, "start": ends[:-1] + int(r.first_start) + int(r.before), "n_tokens": np.diff(ends), "ids_crc32": [zlib.crc32(all_ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]})

    segments = spark.read.schema(SEGMENT).parquet(out)
    # One row for each range partition that was written, which their number bounds, goes through the window.
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("before", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = segments.join(parts.select("part", "before"), "part")
    return rows.select("first_start", "n_docs", "doc_ids", "doc_nulls", "data", "before").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def directory(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, part, segment, k): in which segment each document lies, and as its how-manieth. Codes aren't read; null ids have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                k = np.flatnonzero(np.unpackbits(np.frombuffer(r.doc_nulls, np.uint8))[: r.n_docs] == 0)
                yield pd.DataFrame({"doc_id": np.frombuffer(r.doc_ids, "<i8")[k], "part": r.part, "segment": r.segment, "k": k})

    segments = spark.read.schema(SEGMENT).parquet(out).select("part", "segment", "n_docs", "doc_ids", "doc_nulls")
    return segments.mapInPandas(run, "doc_id long, part long, segment long, k long")


def tokens_at(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, position, from 0) to (doc_id, position, token): each id read at its place, without its neighbours.

    Codes are read of those files alone that hold a wanted document, and of their segments only those with one are
    shuffled. Each distinct wanted place has one row for each document of that id: token is null outside the document.
    Ids that no document has, and null ids or positions, have no row.
    """
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position")).where("doc_id is not null and position is not null").distinct()
    hits = asked.join(directory(spark, out), "doc_id")
    # As many numbers as range partitions were written, at most.
    parts = [r["part"] for r in hits.select("part").distinct().collect()]
    segments = spark.read.schema(SEGMENT).parquet(out).where(F.col("part").isin(parts)).select("part", "segment", "data")
    held = segments.join(hits.select("part", "segment").distinct(), ["part", "segment"], "left_semi")

    def pick(places: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        s = Segment(found["data"].iloc[0])
        k, position = places["k"].to_numpy(), places["position"].to_numpy()
        inside = (position >= 0) & (position < s.starts[k + 1] - s.starts[k])
        tokens = pd.array([s[int(i)] if z else pd.NA for i, z in zip(s.starts[k] + position, inside)], "Int64")
        return pd.DataFrame({"doc_id": places["doc_id"], "position": position, "token": tokens})

    return hits.groupBy("part", "segment").cogroup(held.groupBy("part", "segment")).applyInPandas(pick, "doc_id long, position long, token long")


def round_trip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the files to the cluster's shared folder and read them back."""
    out = shared_path(docs.sparkSession, "dac")
    write(docs, path, out, end_id)
    return read(docs.sparkSession, out)
