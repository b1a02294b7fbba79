"""Periodic runs of words, found by suffix trees.

A run is a stretch of words with smallest period q, of at least ``max(LEAST, 2 * q)`` words, that neither
neighbouring word extends. Two Ukkonen trees, of a word sequence and of its reversal, answer how far two
positions agree to the right and to the left: the depth of their leaves' lowest common ancestor, the least
depth on the Euler tour between them, which a table of ranges gives in constant time. The order of the
leaves, once by a rank of words and once by the reverse of it, gives the longest Lyndon word at every
position. Every run has such a word as its root, so each is lengthened in both directions as far as the
period holds, and is a run if that makes two periods.

A run of LEAST words or more repeats ``LEAST // 2`` neighbouring words within itself, so trees are built of those
parts of a text only where each word is part of such a repeated stretch. Most texts have none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import hash_words, mix, shingle, slices, small_batches

LEAST = 12
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class SuffixTree:
    """The tree of a sequence of symbols 1, 2, ...; 0 stands for its end.

    Children hang on one dictionary, by node and first symbol.
    """

    def __init__(self, symbols: Sequence[int]):
        text = [*symbols, 0]
        n, width = len(text), max(text) + 1
        edges: dict[int, int] = {}
        start, end, link, suffix = [0], [0], [0], [-1]
        node = length = edge = left = 0
        for i, c in enumerate(text):
            left += 1
            split = 0
            while left:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(i - left + 1)
                    if split:
                        link[split] = node
                        split = 0
                else:
                    a = start[child]
                    size = end[child] - a
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if text[a + length] == c:
                        length += 1
                        if split:
                            link[split] = node
                        break
                    new = len(start)
                    edges[key] = new
                    start += (a, i)
                    end += (a + length, n)
                    link += (0, 0)
                    suffix += (-1, i - left + 1)
                    edges[new * width + c] = new + 1
                    start[child] = a + length
                    edges[new * width + text[a + length]] = child
                    if split:
                        link[split] = new
                    split = new
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.child = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        parent = keys[order] // width
        self.first = np.searchsorted(parent, np.arange(len(start) + 1)).tolist()
        self.ends = (keys[order] % width == 0).tolist()
        self.length, self.suffix, self.n = [b - a for a, b in zip(start, end)], suffix, n

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """String depths along the Euler tour, and where on it each suffix's leaf stands."""
        first, child, length, suffix = self.first, self.child, self.length, self.suffix
        depths, at = [0], [0] * self.n
        path, nexts, depth = [0], [first[0]], [0]
        while path:
            node, k = path[-1], nexts[-1]
            if k == first[node + 1]:
                path.pop()
                nexts.pop()
                depth.pop()
                if path:
                    depths.append(depth[-1])
                continue
            nexts[-1] = k + 1
            node = child[k]
            down = depth[-1] + length[node]
            if suffix[node] >= 0:
                at[suffix[node]] = len(depths)
                depths.append(down)
                depths.append(depth[-1])
            else:
                path.append(node)
                nexts.append(first[node])
                depth.append(down)
                depths.append(down)
        return np.array(depths, np.int32), np.array(at, np.int64)

    def ranks(self, reverse: bool) -> list[int]:
        """The rank of each suffix by its symbols, or by the reverse of their order; an end is least either way."""
        first, child, ends, suffix = self.first, self.child, self.ends, self.suffix
        out, n, stack = [0] * self.n, 0, [0]
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                out[suffix[node]] = n
                n += 1
                continue
            a, b = first[node], first[node + 1]
            if not reverse:
                stack += child[a:b][::-1]
            elif ends[a]:
                stack += child[a + 1 : b]
                stack.append(child[a])
            else:
                stack += child[a:b]
        return out


class RangeMin:
    """Least values of ranges: of up to 31 places by two overlapping powers of two, of more by whole blocks of 16 between two such."""

    def __init__(self, values: np.ndarray):
        self.small = [values]
        for k in range(4):
            x = self.small[-1]
            self.small.append(np.minimum(x[: len(x) - (1 << k)], x[1 << k :]) if len(x) > 1 << k else x[:0])
        n = len(values) // 16
        self.blocks = [values[: n * 16].reshape(n, 16).min(axis=1)]
        while len(x := self.blocks[-1]) > (step := 1 << (len(self.blocks) - 1)):
            self.blocks.append(np.minimum(x[: len(x) - step], x[step:]))

    @staticmethod
    def _two(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(out[i], np.minimum(tables[k][a[i]], tables[k][b[i] - (1 << k) + 1]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least values of places a to b, both included."""
        out = np.full(len(a), np.iinfo(np.int32).max, np.int32)
        near = b - a < 31
        i = np.flatnonzero(near)
        part = out[i]
        self._two(self.small, a[i], b[i], part)
        out[i] = part
        i = np.flatnonzero(~near)
        if len(i):
            part = np.minimum(self.small[4][a[i]], self.small[4][b[i] - 15])
            self._two(self.blocks, (a[i] + 15) // 16, b[i] // 16 - 1, part)
            out[i] = part
        return out


class Extension:
    """How many symbols two positions have in common from there on."""

    def __init__(self, tree: SuffixTree):
        depths, self.at = tree.tour()
        self.least = RangeMin(depths)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.at[i], self.at[j]
        return self.least(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def lyndon_ends(ranks: Sequence[int]) -> np.ndarray:
    """Where the longest Lyndon word from each position ends: at the next smaller suffix."""
    n = len(ranks) - 1
    out, open_ = [n] * n, []
    for i in range(n):
        r = ranks[i]
        while open_ and ranks[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs(symbols: Sequence[int], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of symbols (1, 2, ...), by start and period."""
    n = len(symbols)
    if n < max(2, least):
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(symbols)
    right, i = Extension(tree), np.arange(n)
    roots = np.unique(np.concatenate([i * (n + 1) + lyndon_ends(tree.ranks(reverse)) for reverse in (False, True)]))
    del tree
    at, to = roots // (n + 1), roots % (n + 1)
    onward = right(at, to)  # n is the end's own suffix
    del right
    left = Extension(SuffixTree(symbols[::-1]))
    back = np.zeros(len(at), np.int64)
    k = np.flatnonzero(at > 0)
    back[k] = left(n - at[k], n - to[k])
    period, start = to - at, at - back
    length = back + period + onward
    k = np.flatnonzero((back + onward >= period) & (length >= least))
    return np.unique(np.stack([start[k], length[k], period[k]], axis=1), axis=0) if len(k) else np.zeros((0, 3), np.int64)


def repeated_stretches(grams: np.ndarray, text: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Word ranges in which every word is part of ``size`` neighbouring ones that the same text has twice.

    ``grams`` has a hash of the words from each place on, ``text`` whose place it is; places lie in order.
    """
    if not len(grams):
        return []
    key = mix(grams ^ mix(text.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return []
    fresh = np.flatnonzero(np.r_[True, (at[1:] > at[:-1] + size) | (text[at[1:]] != text[at[:-1]])])
    return list(zip(at[fresh].tolist(), (at[np.r_[fresh[1:] - 1, len(at) - 1]] + size).tolist()))


def text_runs(texts: Sequence[bytes], least: int = LEAST) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words of each text, and its runs."""
    words = [t.split() for t in texts]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    size = max(1, least // 2)
    counts = np.array([len(w) for w in words], np.int64)
    hashes, _, _ = hash_words(b"\n".join(texts) + b"\n")
    text = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(counts) - counts
    if len(hashes) >= size:
        whole = np.flatnonzero(text[size - 1 :] == text[: len(text) - size + 1])
        for a, z in _stretches(shingle(hashes, size), text, whole, size):
            i = int(text[a])
            own = words[i][a - begin[i] : z - begin[i]]
            if len(own) >= least:
                number: dict[bytes, int] = {}
                out = runs([number.setdefault(w, len(number) + 1) for w in own], least)
                if len(out):
                    out[:, 0] += a - begin[i]
                    found[i].append(out)
    none = np.zeros((0, 3), np.int64)
    return words, [np.concatenate(f) if f else none for f in found]


def _stretches(grams: np.ndarray, text: np.ndarray, whole: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    for a, z in repeated_stretches(grams[whole], text[whole], size):
        # Within a text, places and words are numbered alike.
        yield int(whole[a]), int(whole[z - size]) + size


def dropped(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words any run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of docs (doc_id, text).

    ``runs`` holds every run's start (a word's number), length and period, by start and period; ``collapsed``
    the words that no run holds after its first period, joined by one space. Words are
    ``[^\\x20\\x09-\\x0D]+``, compared exactly. A null text counts as empty: no runs, and an empty string.
    Rows stay rows: repeated ones, ids that are null or shared, and an empty table are no exception; other
    columns are not looked at. A text is one row of one task, however long: memory is about 1 KB for
    each word of its longest repeated stretch.
    """
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            words, found = text_runs([(t or "").encode("utf-8", "surrogatepass") for t in frame["text"]], least)
            kept = [[w for w, gone in zip(ws, dropped(len(ws), f)) if not gone] if len(f) else ws for ws, f in zip(words, found)]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].array, "runs": [[{"start": s, "length": n, "period": p} for s, n, p in f.tolist()] for f in found],
                "collapsed": [b" ".join(ws).decode("utf-8", "surrogatepass") for ws in kept],
            })

    kind = docs.schema["doc_id"].dataType  # as strings: pandas turns longs with nulls into doubles
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, f"doc_id string, runs {_RUNS}, collapsed string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def longest(found: Column) -> Column:
    """The run of greatest length, of ties the first, then that of least period; null without any."""
    best = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), one in ten of which is made periodic from some word on, as a trial: see ``plant``. Null ids and texts stay as they are."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [plant(d, t) if t is not None and d is not None else t for d, t in zip(frame["doc_id"], frame["text"])]
            yield frame.assign(text=text)

    kind = docs.schema["doc_id"].dataType
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))


def plant(doc_id: str, text: str) -> str:
    """With h the crc32 of the id and g = h // 10: if h ends in 0, from word a = g % n on the text repeats its p words from there, p = 1 + (n - a) // (3 + g % 8)."""
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return text
    words = text.encode("utf-8", "surrogatepass").split()
    n, g = len(words), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return b" ".join((words[:a] + root * (-(-(n - a) // p)))[:n]).decode("utf-8", "surrogatepass")
