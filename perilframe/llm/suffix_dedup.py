"""Removal of repeated byte strings by a distributed difference-cover suffix order.

What is sorted
    Texts are read as units that end at places which their own bytes choose, each with the MATCH - 1 bytes
    after it, so that every MATCH-byte string starts in one unit. Every such string has an anchor, the
    least hash among its GRAM-byte substrings, and with HALF bytes after the anchor, or before it, still holds it. A
    string whose anchor with these bytes is at no other place of any unit, and in a unit that is at no other place,
    occurs once and goes no further. Of equal units, and of
    equal runs of what is left in them, the first is kept and the others are repeats. So it is with equal segments of what is
    then left, which are the strings of one anchor each; and what has no like in another kept segment, by an anchor and the
    bytes beside it again, isn't sorted. Filters keep too much at worst.

How it is sorted
    Units lie in blocks. Places whose number in their unit isn't divisible by three are the sample: a difference cover
    of three. The MATCH bytes at sampled places are sorted and named; since MATCH bytes decide, the names are the ranks of the
    sample and nothing is left to recur on. From them all windows are ranked: two are compared by the bytes up to the next
    place at which both are sampled, and by the ranks there. So the order is that of the suffixes as far as MATCH bytes decide it.

    A sort is an exchange: a block sends what it wants to know, each thing once, to ranges between
    splitters; a range puts them in order and answers the blocks. Ranges hold about RANGE things, whatever
    the corpus; splitters come from a sample of 8 a range. A string that is everywhere comes once from each
    block.

Last, neighbours in the order are compared, by a 64-bit hash of their MATCH bytes; of equal ones the first place is
kept and the others are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm import sketch
from perilframe.llm.common import checkpointing, discard, gram_hashes, mix, signed, slices, small_batches, stored

MATCH, GRAM = 100, 48
#: Places between two ends of units that bytes choose, at least; windows of a unit, at most; bytes of a text read at once.
APART, UNIT, PIECE = 128, 4096, 1 << 20
#: Places of a block, with those after its units; windows of a range, about; samples of a range.
BLOCK, RANGE, SAMPLES = 1 << 18, 1 << 18, 8
#: Bytes of a block that are sent at once.
SENT = 4 << 20
_LOCAL = 27
_TOP = np.uint32(2**32 - 1)
#: Places for an anchor in a string.
SPAN = MATCH - GRAM + 1
#: Bytes beside an anchor: a string has so many after it, if the anchor is among its first HALF + 1 places, or else before it.
HALF = (SPAN - 1) // 2
#: Kinds of an anchor's places in a string (lowest, highest): of one kind all have so many bytes beside their anchor in common.
KINDS = [(k * SPAN // 4, (k + 1) * SPAN // 4 - 1) for k in range(4)]
_COMMON = MATCH - max(z - a for a, z in KINDS)
#: Places after a unit's last window that are named, and those that some name looks at.
_NAMED = 2
_BEYOND = _NAMED + MATCH


# --- units and anchors ----------------------------------------------------------------------------


def sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """``best`` of the ``size`` values from each place on that has so many, by doubling."""
    n, k = len(x), 1
    if n < size:
        return x[:0]
    while 2 * k <= size:
        x, k = best(x[:-k], x[k:]), 2 * k
    return best(x[: n - size + 1], x[size - k :]) if k < size else x


class Units:
    """The units of a batch of texts, and the least hashes of their windows.

    ``text``, ``start`` (in its text), ``at`` (in ``data``) and ``windows`` of each unit; ``half``, what chooses
    anchors, at each place of data, and ``least``, the least of it in the window that starts there (0 where none does).
    """

    def __init__(self, texts: Sequence[bytes]):
        rim = bytes(APART)
        parts, at, owner, first, windows, n = [rim], [], [], [], [], APART
        for k, t in enumerate(texts):
            for a in range(0, len(t) - MATCH + 1, PIECE):
                part = t[a : a + PIECE + MATCH - 1]
                parts += (part, rim)
                at.append(n)
                owner.append(k)
                first.append(a)
                windows.append(len(part) - MATCH + 1)
                n += len(part) + APART
        self.bytes = b"".join(parts)
        self.data = np.frombuffer(self.bytes, np.uint8)
        at, count = np.array(at, np.int64), np.array(windows, np.int64)
        every = gram_hashes(self.data, GRAM)
        # Upper halves choose anchors; of equal ones all are.
        self.half = np.full(n, _TOP)
        window = np.zeros(n, bool)
        for a, c in zip(at.tolist(), windows):
            z = a + c + MATCH - GRAM
            self.half[a:z] = every[a:z] >> np.uint64(32)
            window[a : a + c] = True
        np.minimum(self.half, _TOP - 1, out=self.half, where=self.half != _TOP)
        np.maximum(self.half, 1, out=self.half)
        self.least = np.zeros(n, np.uint32)
        self.least[: n - SPAN + 1] = sliding(self.half, SPAN, np.minimum)
        self.least[~window] = 0
        # A place is an anchor if some window that holds it has no lesser one.
        most = np.zeros(n, np.uint32)
        most[SPAN - 1 :] = sliding(self.least, SPAN, np.maximum)
        self.anchors = np.flatnonzero((self.half == most) & (self.half != _TOP))
        # Anchors with the bytes after them, and before them.
        wide = gram_hashes(self.data, GRAM + HALF)
        self.after = mix(wide[self.anchors] ^ np.uint64(0x3C6E_F372_FE94_F82B))
        self.ahead = mix(wide[self.anchors - HALF] ^ np.uint64(0x510E_527F_ADE6_82D1))
        lows = sliding(self.half, APART, np.minimum)
        i = np.arange(APART, n - APART)
        cut = np.zeros(n, bool)
        cut[i] = (self.half[i] < lows[: len(i)]) & (self.half[i] <= lows[np.minimum(i + 1, len(lows) - 1)])
        cut &= window
        cut[at] = True
        edge = np.flatnonzero(cut)
        end = np.r_[edge[1:], n][: len(edge)]
        piece = np.searchsorted(at, edge, side="right") - 1
        end = np.minimum(end, (at + count)[piece]) if len(at) else end
        more = -(-(end - edge) // UNIT)
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        self.at = np.repeat(edge, more) + step * UNIT
        self.windows = np.minimum(np.repeat(end, more) - self.at, UNIT)
        piece = np.repeat(piece, more)
        self.text, self.start = np.array(owner, np.int64)[piece], np.array(first, np.int64)[piece] + self.at - at[piece]
        view = memoryview(self.bytes)
        self.keys = [hashlib.blake2b(view[a : a + w + MATCH - 1], digest_size=16).digest() for a, w in zip(self.at.tolist(), self.windows.tolist())]

    def short_keys(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.keys), np.uint64)[::2] if self.keys else np.zeros(0, np.uint64)

    def owners(self) -> np.ndarray:
        """The unit that each anchor stands in; those after a text's last window stand in its last unit."""
        return np.searchsorted(self.at, self.anchors, side="right") - 1

    def anchor_places(self) -> np.ndarray:
        """A number for each anchor's place in its unit's bytes."""
        k = self.owners()
        return mix(self.short_keys()[k] + (self.anchors - self.at[k]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _encoded(frame: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in frame["text"]]


def _once(keys: np.ndarray) -> np.ndarray:
    """Units' keys as hashes, unlike the anchors' ones."""
    return mix(keys ^ np.uint64(0xA5A5_5A5A_1234_8765))


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(t, x): anchors and where in a unit they are, units and where they are."""
    for frame in slices(frames):
        doc, tie = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("doc", "tie"))
        u = Units(_encoded(frame))
        x = u.anchor_places()
        place = mix(mix(doc[u.text] ^ mix(tie[u.text])) + u.start.astype(np.uint64))
        yield pd.DataFrame({"t": signed(np.r_[u.after, u.ahead, _once(u.short_keys())]), "x": signed(np.r_[x, x, place])})


_UNIT = "key binary, doc long, tie long, start long, windows long, body binary"


def _suspects(live: sketch.Filter):
    """Units that are elsewhere, too (without body), and runs of windows that may have their like in another unit (with it)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            doc, tie = frame["doc"].to_numpy(np.int64), frame["tie"].to_numpy(np.int64)
            u = Units(_encoded(frame))
            if not len(u.at):
                continue
            again = live.has(signed(_once(u.short_keys())))
            i = np.flatnonzero(again)
            if len(i):
                yield pd.DataFrame({"key": [u.keys[k] for k in i], "doc": doc[u.text[i]], "tie": tie[u.text[i]], "start": u.start[i], "windows": u.windows[i], "body": None})
            # A window is suspect if its anchor with what is beside it is in another unit, too, or stands in the next unit and that is elsewhere.
            owner = u.owners()
            tail = np.zeros(len(u.half), bool)
            for e in (u.at + u.windows)[:-1][again[1:]].tolist():
                tail[max(0, e - SPAN) : e] = True
            may = tail & _anchored_by(u, u.anchors[again[owner]], 0, SPAN)
            may |= _anchored_by(u, u.anchors[live.has(signed(u.after))], 0, HALF + 1) | _anchored_by(u, u.anchors[live.has(signed(u.ahead))], HALF, SPAN - HALF)
            first, end = _runs(may)
            more = -(-(end - first) // UNIT)
            step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            at = np.repeat(first, more) + step * UNIT
            to = np.minimum(np.repeat(end, more), at + UNIT)
            if len(at):
                k = np.searchsorted(u.at, at, side="right") - 1
                bodies = [u.bytes[p : q + MATCH - 1] for p, q in zip(at.tolist(), to.tolist())]
                keys = [hashlib.blake2b(x, digest_size=16, key=b"run").digest() for x in bodies]
                yield pd.DataFrame({"key": keys, "doc": doc[u.text[k]], "tie": tie[u.text[k]], "start": u.start[k] + at - u.at[k], "windows": to - at, "body": bodies})

    return run


def _anchored_by(u: Units, anchors: np.ndarray, low: int, count: int) -> np.ndarray:
    """The windows whose anchor is one of these, and at one of ``count`` places of theirs, from ``low`` on."""
    chosen = np.full(len(u.half), _TOP)
    chosen[anchors] = u.half[anchors]
    best, out = sliding(chosen, count, np.minimum)[low:], np.zeros(len(chosen), bool)
    out[: len(best)] = best == u.least[: len(best)]
    return out


# --- blocks ------------------------------------------------------------------------------------------

_BLOCK = "b long, body binary, windows binary, doc binary, tie binary, start binary"


def _blocked(units: pd.DataFrame, b: int) -> dict:
    """A block's row."""
    return {"b": b, "body": b"".join(units["body"])} | {c: units[c].to_numpy(np.int64).tobytes() for c in ("windows", "doc", "tie", "start")}


def _packed(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Units in order of their places, in blocks of about so many places."""
    part, held, size, k = TaskContext.get().partitionId(), [], 0, 0

    def block() -> pd.DataFrame:
        return pd.DataFrame({c: [x] for c, x in _blocked(pd.concat(held), (part << 20) + k).items()})

    for frame in frames:
        cuts = np.flatnonzero(np.diff((np.cumsum(frame["windows"].to_numpy() + _BEYOND) + size) // most)) + 1 if len(frame) else []
        for a, z in zip([0, *cuts], [*cuts, len(frame)]):
            if a and held:
                yield block()
                held, size, k = [], 0, k + 1
            if z > a:
                held.append(frame.iloc[a:z])
        size = int(sum(f["windows"].sum() + _BEYOND * len(f) for f in held))
        if size >= most:
            yield block()
            held, size, k = [], 0, k + 1
    if held:
        yield block()


class Block:
    """A block's units, each with _BEYOND places after its last window; places beyond its bytes are 0."""

    def __init__(self, row):
        self.b, self.windows = int(row["b"]), np.frombuffer(bytes(row["windows"]), np.int64)
        self.slots = self.windows + _BEYOND
        self.first = np.cumsum(self.slots) - self.slots
        self.size = int(self.slots.sum())
        length = self.windows + MATCH - 1
        begin = np.cumsum(length) - length
        self.text = np.zeros(self.size + MATCH, np.uint8)
        self.text[np.repeat(self.first - begin, length) + np.arange(length.sum())] = np.frombuffer(bytes(row["body"]), np.uint8)
        self.place = np.arange(self.size) - np.repeat(self.first, self.slots)
        self.beyond = self.place - np.repeat(self.windows, self.slots)

    def sampled(self) -> np.ndarray:
        """Places, up to _NAMED after the windows, that are in the sample."""
        return np.flatnonzero((self.beyond < _NAMED) & (self.place % 3 != 0))


def _names(block: Block) -> np.ndarray:
    """The strings at the sample."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(block.text, MATCH)[block.sampled()]).view(f"S{MATCH}").ravel()


# --- segments: the windows of one anchor ---------------------------------------------------------------------

_STRETCH = "doc long, tie long, start long, windows long, body binary"


class Segments:
    """A block's stretches of windows whose first least hash is at one place: where each begins, its windows and its anchor."""

    def __init__(self, block: Block):
        self.block, window = block, np.flatnonzero(block.beyond < 0)
        half = gram_hashes(block.text, GRAM) >> np.uint64(32)
        best = sliding(half << np.uint64(32) | np.arange(len(half), dtype=np.uint64), SPAN, np.minimum)
        anchor = (best[window] & np.uint64(_TOP)).astype(np.int64)
        #: Numbers of their first windows among the block's.
        self.head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
        self.first, self.anchor, self.windows = window[self.head], anchor[self.head], np.diff(np.r_[self.head, len(anchor)])

    def keys(self) -> np.ndarray:
        """128 bits for each segment's bytes."""
        view = memoryview(self.block.text.tobytes())
        raw = b"".join(hashlib.blake2b(view[a : a + n + MATCH - 1], digest_size=16, key=b"segment").digest() for a, n in zip(self.first.tolist(), self.windows.tolist()))
        return np.frombuffer(raw, np.int64).reshape(-1, 2)

    def marks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind: marks of the segments that have windows of it, and where these windows begin and end."""
        wide = gram_hashes(self.block.text, _COMMON)
        for k, (low, high) in enumerate(KINDS):
            a, z = np.maximum(self.first, self.anchor - high), np.minimum(self.first + self.windows, self.anchor - low + 1)
            i = np.flatnonzero(a < z)
            yield signed(mix(wide[self.anchor[i] - low] ^ np.uint64((k + 1) * 0x6A09_E667_F3BC_C908 % 2**64))), a[i], z[i]


def _stretches(block: Block, row, on: np.ndarray, body: bool) -> pd.DataFrame:
    """Runs of windows as rows."""
    first, end = _runs(on)
    unit = np.searchsorted(block.first, first, side="right") - 1
    doc, tie, start = (np.frombuffer(bytes(row[c]), np.int64)[unit] for c in ("doc", "tie", "start"))
    bodies = [block.text[p : q + MATCH - 1].tobytes() for p, q in zip(first.tolist(), end.tolist())] if body else None
    return pd.DataFrame({"doc": doc, "tie": tie, "start": start + block.place[first], "windows": end - first, "body": bodies})


def _filled(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which places lie in one of these stretches."""
    on = np.zeros(size + 1, np.int64)
    np.add.at(on, first, 1)
    np.add.at(on, end, -1)
    return np.cumsum(on[:-1]) > 0


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The segments of blocks, by their bytes."""
    for frame in frames:
        for _, row in frame.iterrows():
            found = Segments(Block(row))
            keys = found.keys()
            yield pd.DataFrame({"k": keys[:, 0], "m": keys[:, 1], "place": (int(row["b"]) << 22) + found.head})


def _parted(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A block's first segments (with bodies) and those that are elsewhere before (without)."""
    row = left.iloc[0]
    found = Segments(Block(row))
    block, kept = found.block, np.isin(found.head, right["place"].to_numpy(np.int64) & (1 << 22) - 1)
    rows = [_stretches(block, row, _filled(block.size, found.first[x], (found.first + found.windows)[x]), body) for x, body in ((kept, True), (~kept, False))]
    return pd.concat(rows)


def _marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            yield pd.DataFrame({"t": np.concatenate([t for t, _, _ in Segments(Block(_blocked(frame, 0))).marks()])})


def _live(live: sketch.Filter):
    """The windows that may have their like in another segment."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                row = _blocked(frame, 0)
                found = Segments(Block(row))
                held = [(a[on], z[on]) for t, a, z in found.marks() for on in (live.has(t),)]
                yield _stretches(found.block, row, _filled(found.block.size, *map(np.concatenate, zip(*held))), True)

    return run


def _ordered(units: DataFrame, most: int) -> DataFrame:
    """Units in order of their places, in blocks."""
    ordered = units.repartitionByRange("doc", "tie", "start").sortWithinPartitions("doc", "tie", "start")
    return stored(ordered.mapInPandas(partial(_packed, most=most), _BLOCK), "blocks")


def _without_copies(blocks: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the windows that may have their like among first segments, and the segments that are elsewhere before."""
    firsts = blocks.mapInPandas(_keyed, "k long, m long, place long").groupBy("k", "m").agg(F.min("place").alias("place"))
    firsts = firsts.select(F.shiftright("place", 22).alias("b"), "place")
    parted = stored(blocks.groupBy("b").cogroup(firsts.groupBy("b")).applyInPandas(_parted, _STRETCH), "parted")
    discard(blocks)
    copies = stored(parted.where("body is null").drop("body"), "segments")
    kept = parted.where("body is not null")
    marks = stored(kept.mapInPandas(_marked, "t long").groupBy("t").count().where("count > 1").select("t"), "marks")
    live = sketch.Filter(marks, "t")
    out = _ordered(kept.mapInPandas(_live(live), _STRETCH), most)
    live.drop()
    discard(marks, parted)
    return out, copies


# --- suffixes, in three classes --------------------------------------------------------------


def _bytes(*columns: np.ndarray) -> np.ndarray:
    """Columns of numbers as strings in the same order."""
    return np.stack(columns, axis=1).astype(">u8").view(f"S{8 * len(columns)}").ravel()


class Suffixes:
    """Suffixes by class (their number in the unit, modulo three), symbols t0, t1 and ranks ra, rb.

    Class 0 isn't sampled: ra and rb are the ranks one and two places on. Classes 1 and 2 are: ra is their
    own rank, rb that of the next place at which they and class 0 are both sampled (one on for class 1, two for class 2).
    """

    COLUMNS = ("cls", "t0", "t1", "ra", "rb", "mark")

    def __init__(self, *columns: np.ndarray):
        self.cls, self.t0, self.t1, self.ra, self.rb, self.mark = (np.asarray(c, np.int64) for c in columns)

    @classmethod
    def at(cls, place: np.ndarray, at: np.ndarray, step: int, symbols: np.ndarray, ranks: np.ndarray, mark: np.ndarray | None = None) -> Suffixes:
        c = place // step % 3
        on, two = at + step, at + 2 * step
        return cls(c, symbols[at], np.where(c == 1, 0, symbols[on]), np.where(c == 0, ranks[on], ranks[at]), np.where(c == 1, ranks[on], ranks[two]), np.zeros(len(at)) if mark is None else mark)

    def take(self, i) -> Suffixes:
        return Suffixes(*(getattr(self, c)[i] for c in self.COLUMNS))

    def tobytes(self) -> bytes:
        return np.stack([getattr(self, c) for c in self.COLUMNS]).tobytes()

    @classmethod
    def of(cls, parts: Sequence[bytes]) -> Suffixes:
        return cls(*np.concatenate([np.frombuffer(bytes(p), np.int64).reshape(len(cls.COLUMNS), -1) for p in parts], axis=1))

    def key(self, i: np.ndarray, other: int, small: bool) -> np.ndarray:
        """What decides between these suffixes, all of one class, and ones of another class. ``small``: symbols are bytes, and a key is one number."""
        own = int(self.cls[i[0]])
        if own and other:
            return self.ra[i]
        if 2 in (own, other):
            columns = (self.t0[i], self.t1[i], self.rb[i])
        else:
            columns = (self.t0[i], self.ra[i] if own == 0 else self.rb[i])
        if not small:
            return _bytes(*columns)
        out = columns[-1].astype(np.uint64)
        for k, c in enumerate(columns[-2::-1]):
            out = out | c.astype(np.uint64) << np.uint64(48 + 8 * k)
        return out

    def before(self, those: Suffixes, small: bool, side: str = "left") -> np.ndarray:
        """How many of those suffixes come before each (``side`` right: or are equal)."""
        out = np.zeros(len(self.cls), np.int64)
        own = [np.flatnonzero(self.cls == c) for c in range(3)]
        other = [np.flatnonzero(those.cls == c) for c in range(3)]
        for a in range(3):
            for b in range(3):
                if len(own[a]) and len(other[b]):
                    out[own[a]] += np.searchsorted(np.sort(those.key(other[b], a, small)), self.key(own[a], b, small), side=side)
        return out


def _whole(block: Block, row) -> Suffixes:
    """Every window, marked by the hash of its bytes."""
    ranks, at = np.zeros(block.size + 1, np.int64), np.flatnonzero(block.beyond < 0)
    ranks[block.sampled()] = np.frombuffer(bytes(row["names"]), np.int64)
    return Suffixes.at(block.place[at], at, 1, block.text[: block.size + 1].astype(np.int64), ranks, signed(gram_hashes(block.text, MATCH)[at]))


# --- exchanges -------------------------------------------------------------------------------------------


def _spaced(ordered, ranges: int):
    """Splitters from an ordered sample."""
    return np.unique(np.linspace(0, len(ordered), ranges + 1)[1:-1].astype(int)) if len(ordered) else np.zeros(0, int)


def _numbered(r: int, local: np.ndarray) -> np.ndarray:
    if r >= 1 << 48 - _LOCAL or len(local) and int(local.max()) >= 1 << _LOCAL:
        raise ValueError("too many ranges, or too much in one")
    return (r << _LOCAL) + local.astype(np.int64)


_ASKED, _ANSWER = "r long, b long, data binary", "b long, r long, answer binary"


def _sampled(blocks: DataFrame, pick: Callable[[pd.Series, int], bytes], ranges: int, count: int) -> list[bytes]:
    """SAMPLES things of a range, about, chosen evenly over the blocks."""
    each = max(1, -(-SAMPLES * ranges // max(1, count)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                yield pd.DataFrame({"data": [pick(row, each)]})

    return [bytes(r["data"]) for r in blocks.mapInPandas(run, "data binary").collect()]


def _chosen(n: int, each: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, n, each) if n else np.zeros(0, int)


def _exchange(blocks: DataFrame, ask: Callable, reply: Callable, settle: Callable, column: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """blocks with a column of answers: ``ask(row)`` gives (range, data) pairs, ``reply`` a range's answers to its blocks' data, ``settle(row, answers by range)`` the column."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                to, held, size = [], [], 0
                for r, data in ask(row):
                    to.append(r)
                    held.append(data)
                    size += len(data)
                    if size >= SENT:
                        yield pd.DataFrame({"r": to, "b": int(row["b"]), "data": held})
                        to, held, size = [], [], 0
                if to:
                    yield pd.DataFrame({"r": to, "b": int(row["b"]), "data": held})

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": frame["b"].array, "r": key[0], "answer": reply(int(key[0]), [bytes(x) for x in frame["data"]])})

    def take(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        got = {int(r): np.frombuffer(bytes(x), np.int64) for r, x in zip(right["r"], right["answer"])}
        return left.iloc[:1].drop(columns=list(drop)).assign(**{column: [settle(row, got)]})

    answers = blocks.mapInPandas(send, _ASKED).groupBy("r").applyInPandas(answer, _ANSWER)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields if f.name not in drop)
    out = stored(blocks.groupBy("b").cogroup(answers.groupBy("b")).applyInPandas(take, f"{kept}, {column} binary"), column)
    discard(blocks)
    return out


def _named(blocks: DataFrame, ranges: int, count: int) -> DataFrame:
    """blocks with the names of their sample: numbers in the strings' order, equal for equal strings."""
    kind = f"S{MATCH}"

    def pick(row, each: int) -> bytes:
        own = _names(Block(row))
        return own[_chosen(len(own), each, int(row["b"]))].tobytes()

    splitters = np.unique(np.frombuffer(b"".join(_sampled(blocks, pick, ranges, count)), kind))
    splitters = splitters[_spaced(splitters, ranges)]

    def ask(row):
        own = np.unique(_names(Block(row)))
        cuts = [0, *np.searchsorted(own, splitters).tolist(), len(own)]
        for r, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if z > a:
                yield r, own[a:z].tobytes()

    def reply(r: int, parts: list[bytes]) -> list[bytes]:
        sizes = [len(p) // MATCH for p in parts]
        _, inverse = np.unique(np.frombuffer(b"".join(parts), kind), return_inverse=True)
        return [x.tobytes() for x in np.split(_numbered(r, inverse), np.cumsum(sizes)[:-1])]

    def settle(row, got: dict[int, np.ndarray]) -> bytes:
        own, inverse = np.unique(_names(Block(row)), return_inverse=True)
        return (np.concatenate([got[r] for r in sorted(got)])[inverse] if len(own) else np.zeros(0, np.int64)).tobytes()

    return _exchange(blocks, ask, reply, settle, "names")


def _merged(blocks: DataFrame, ranges: int, count: int) -> DataFrame:
    """blocks with the first place of each window's like."""

    def pick(row, each: int) -> bytes:
        every = _whole(Block(row), row)
        return every.take(_chosen(len(every.cls), each, int(row["b"]))).tobytes()

    some = Suffixes.of(_sampled(blocks, pick, ranges, count) or [b""])
    some = some.take(np.sort(np.unique(some.mark, return_index=True)[1]))  # one splitter of windows that are alike
    some = some.take(np.argsort(some.before(some, True), kind="stable"))
    splitters = some.take(_spaced(some.cls, ranges))
    marks = np.argsort(splitters.mark)

    def dealt(own: Suffixes) -> np.ndarray:
        to = own.before(splitters, True, "right")
        if len(marks):  # windows like a splitter go with it, whatever follows them
            k = np.minimum(np.searchsorted(splitters.mark[marks], own.mark), len(marks) - 1)
            same = splitters.mark[marks[k]] == own.mark
            to[same] = marks[k[same]] + 1
        return to

    def own(row) -> tuple[Suffixes, np.ndarray, np.ndarray]:
        every = _whole(Block(row), row)
        _, first, inverse = np.unique(every.mark, return_index=True, return_inverse=True)
        return every.take(first), first, inverse

    def ask(row):
        some, first, _ = own(row)
        to = dealt(some)
        place = (int(row["b"]) << 22) + first
        for r in np.unique(to).tolist():
            i = np.flatnonzero(to == r)
            yield r, some.take(i).tobytes() + place[i].tobytes()

    def reply(r: int, parts: list[bytes]) -> list[bytes]:
        sizes = [len(p) // (8 * len(Suffixes.COLUMNS) + 8) for p in parts]
        every = Suffixes.of([p[: 48 * n] for p, n in zip(parts, sizes)])
        place = np.concatenate([np.frombuffer(p[48 * n :], np.int64) for p, n in zip(parts, sizes)])
        by = np.argsort(every.before(every, True), kind="stable")
        mark = every.mark[by]
        head = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
        out = np.zeros(len(by), np.int64)
        out[by] = np.repeat(np.minimum.reduceat(place[by], head), np.diff(np.r_[head, len(by)]))
        return [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]

    def settle(row, got: dict[int, np.ndarray]) -> bytes:
        some, first, inverse = own(row)
        to, out = dealt(some), np.zeros(len(first), np.int64)
        for r, x in got.items():
            out[to == r] = x
        return out[inverse].tobytes()

    return _exchange(blocks, ask, reply, settle, "kept", ("names",))


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[0, on.astype(np.int8), 0]))
    return edge[0::2], edge[1::2]


def _repeated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of bytes under windows whose first place is another one."""
    for frame in frames:
        for _, row in frame.iterrows():
            block = Block(row)
            doc, tie, start = (np.frombuffer(bytes(row[c]), np.int64) for c in ("doc", "tie", "start"))
            n = int(block.windows.sum())
            later = np.frombuffer(bytes(row["kept"]), np.int64) != (block.b << 22) + np.arange(n)
            unit = np.repeat(np.arange(len(block.windows)), block.windows)
            first = np.cumsum(block.windows) - block.windows
            # Runs of windows, cut where units end.
            apart = np.zeros(n + len(first), bool)
            apart[np.arange(n) + unit] = later
            a, z = _runs(apart)
            if len(a):
                k = np.searchsorted(first + np.arange(len(first)), a, side="right") - 1
                off = start[k] - first[k] - k
                yield pd.DataFrame({"doc": doc[k], "tie": tie[k], "start": a + off, "end": z - 1 + off + MATCH})


def repeats(docs: DataFrame, block: int = BLOCK, size: int = RANGE) -> DataFrame:
    """(doc, tie, start, end): spans of bytes, in no order and with overlaps, that together are all that ``cut`` removes; docs has doc, tie and text."""
    found = docs.mapInPandas(_places, "t long, x long").groupBy("t").agg(F.min("x").alias("x"), F.max("x").alias("y")).where("x <> y").select("t")
    found = stored(found, "anchors")
    live = sketch.Filter(found, "t")
    units = stored(docs.mapInPandas(_suspects(live), _UNIT), "units")
    live.drop()
    discard(found)
    firsts = units.groupBy("key").agg(F.min(F.struct("doc", "tie", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    own = F.struct("doc", "tie", "start")
    copies = units.select("key", "doc", "tie", "start", "windows").join(firsts.where("n > 1"), "key").where(own != F.col("first"))
    copies = stored(copies.select("doc", "tie", "start", "windows"), "copies")
    one = units.where("body is not null").groupBy("key").agg(F.min(F.struct("doc", "tie", "start", "windows", "body")).alias("u")).select("u.*")
    blocks = _ordered(one, block)
    discard(units)
    blocks, more = _without_copies(blocks, block)
    copies = copies.unionByName(more).select("doc", "tie", "start", (F.col("start") + F.col("windows") + MATCH - 1).alias("end"))
    windows = F.octet_length("body") - (MATCH - 1) * F.octet_length("windows") / 8
    whole = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(windows).alias("windows")).first()
    if not whole["n"]:
        return copies
    count, ranges = whole["n"], -(-int(whole["windows"]) // size)
    blocks = _merged(_named(blocks, ranges, count), ranges, count)
    return copies.unionByName(blocks.mapInPandas(_repeated, "doc long, tie long, start long, end long"))


def _kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        spans, kept, sizes = [], [], []
        for text, found in zip(frame["text"], frame["found"]):
            data = (text or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in found) if found is not None else ():
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at, rest = 0, []
            for a, z in merged:
                rest.append(data[at:a])
                at = z
            rest.append(data[at:])
            spans.append([{"start": a, "end": z} for a, z in merged])
            kept.append(b"".join(rest))
            sizes.append(len(data))
        yield pd.DataFrame({"doc_id": frame["doc_id"].array, "n_bytes": sizes, "spans": spans, "kept": kept})


def cut(docs: DataFrame, block: int = BLOCK, size: int = RANGE) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs (doc_id, text).

    ``spans`` are the removed stretches of the text's UTF-8 bytes, (start, end) in order; ``kept`` the other bytes. A
    byte is removed if a string of MATCH bytes that covers it also starts earlier: in a document of smaller
    doc_id, or earlier in its own. A null text counts as empty and stays empty, as does any text of fewer
    than MATCH bytes stay whole. A null doc_id comes after all others. Rows that share a doc_id are documents in the
    order of their texts' hashes; rows that share doc_id and text are one document, and each has its result.
    An empty table gives none; other columns are not looked at. Long texts are read in pieces, and only the last step holds one whole.
    """
    checkpointing(docs.sparkSession)
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    found = repeats(keyed.where("text is not null").select("doc", "tie", "text"), block, size).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = keyed.join(found, ["doc", "tie"], "left").select(F.col("doc_id").cast("string"), "text", "found")
    out = joined.mapInPandas(_kept, "doc_id string, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
