"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

All documents' shingles are counted in an array whose size follows the corpus; ascending count, then
hash, is the order of every document's shingles. If two sets have a Jaccard similarity of t, their
prefixes of n - ceil(t n) + l shingles share l at least. Each document takes the l, from a least one by
its size on, for which its longer prefix and its expected candidates together cost least; a pair is a
candidate if the prefixes for the smaller of their two l share that many. A document with fewer prefix
shingles in common with others than the least l of any partner's size has no candidate and goes early.
Every candidate is verified on the whole sets.

Equal sets are one class and take part once. A class's home is the fullest prefix bucket that it, or a
class that it shares a bucket with, is in; a home with much to hold is dealt to several cells by hash. Two
cells meet in one task if a bucket holds classes of both (cells of different homes with those classes
alone), so each pair of classes meets once at most, in a task of bounded size. Meetings are held twice: first over prefixes alone, and then, with the whole sets of
those classes only that have a candidate there; only links of a spanning forest leave the second.
Shingles are 56-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm import sketch
from perilframe.llm.common import Words, checkpointing, distinct_slices, mix, one_thread, signed, slices, stored
from perilframe.llm.graph import components

#: The least and the most bits of the array of counts, and the shingles to a cell that are aimed at.
COUNT_BITS, COUNT_LOAD = (16, 24), 4
#: The largest l, and the shingles of a set for each further l that it takes at least.
LEVELS, STEP = 16, 30
CELL_ROWS, CELL_SHINGLES, BLOCK_ROWS = 2048, 1_000_000, 512
#: Bytes of prefixes, and of whole sets, to a batch of meetings.
PREFIX_BATCH, SET_BATCH = 1 << 20, 8 << 20
_NODE = ["ka", "kb"]
_LOW = np.uint64(0xFF)


def need(n, percent: int):
    """The least overlap of a set of n with any set that it links to."""
    return (percent * n + 99) // 100


def least_level(n):
    """The l that a set of n takes at least."""
    return np.clip(np.asarray(n) // STEP, 1, LEVELS)


def steps(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, eight to a doubling."""
    return np.minimum(255, np.floor(8 * np.log2(1 + counts.astype(np.float64)))).astype(np.uint8)


#: The counts that the bytes stand for.
WORTH = 2.0 ** (np.arange(256) / 8) - 1


def text_sets(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each whole text, sorted, text after text, and the cuts between them."""
    every, cuts = Words(texts).shingles(k)
    return distinct_slices(every & ~_LOW, cuts)


def set_keys(every: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell each set from others; zeros of empty sets."""
    out = []
    some = cuts[1:] > cuts[:-1]
    for x in (0, 0x7C3A91E5D2B86F04):
        key = np.zeros(len(some), np.uint64)
        if some.any():
            key[some] = np.add.reduceat(mix(every ^ np.uint64(x)), cuts[:-1][some])
        out.append(signed(key))
    return tuple(out)


def prefixes(every: np.ndarray, cuts: np.ndarray, counts: np.ndarray, load: float, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each set: its number, its prefix, from which l on each shingle belongs to it, and the l chosen."""
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    if not len(some):
        return
    bits = len(counts).bit_length() - 1
    # The count's byte above the hash: sorted, the order of all prefixes.
    order = (every >> np.uint64(8)) | (counts[sketch.cell(every, bits)].astype(np.uint64) << np.uint64(56))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        order[a:b].sort()
    extra = np.maximum(WORTH[(order >> np.uint64(56)).astype(np.int64)] - load, 0.0)
    total = np.r_[0.0, np.cumsum(extra)]
    at, n = cuts[:-1][some], np.diff(cuts)[some]
    first = n - need(n, percent) + 1
    most, from_ = np.minimum(LEVELS, need(n, percent)), least_level(n)
    l = np.arange(1, LEVELS + 1)
    end = np.minimum(first[:, None] + l[None, :] - 1, n[:, None])
    costs = end + (total[at[:, None] + end] - total[at][:, None]) / l[None, :]
    costs[(l[None, :] < from_[:, None]) | (l[None, :] > most[:, None])] = np.inf
    chosen = costs.argmin(axis=1) + 1
    for i, a, f, c in zip(some.tolist(), at.tolist(), first.tolist(), chosen.tolist()):
        yield i, order[a : a + f + c - 1] << np.uint64(8), np.maximum(1, np.arange(f + c - 1) - f + 2).astype(np.uint8), c


def compare(a: list[dict], b: list[dict] | None, percent: int) -> np.ndarray:
    """Which sets of a link to which of b (of a itself, if b is None), candidates first; only candidates, if rows have no sets."""
    rows = a if b is None else a + b
    n = np.array([r["n"] for r in rows], np.int64)
    na, ia = len(a), np.arange(len(a))
    ib = ia if b is None else np.arange(na, len(rows))
    size_a, size_b = n[ia][:, None], n[ib][None, :]
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    mask = 100 * small >= percent * large
    l_a, l_b = np.array([rows[i]["l"] for i in ia])[:, None], np.array([rows[i]["l"] for i in ib])[None, :]
    level = np.minimum(l_a, l_b)
    enough = np.zeros_like(mask)
    for l in np.unique(level[mask]).tolist():
        shared = overlaps([r["p"][r["v"] <= l] for r in rows], ia, ib)
        enough |= (level == l) & (shared >= l)
    mask &= enough
    if b is None:
        mask &= ia[:, None] < ib[None, :]
    if rows[0]["s"] is None:
        return mask
    at, to = np.nonzero(mask)
    out = np.zeros_like(mask)
    if not len(at):
        return out
    if len(at) <= 4 * len(rows):
        both = np.array([len(np.intersect1d(rows[ia[x]]["s"], rows[ib[y]]["s"], assume_unique=True)) for x, y in zip(at, to)], np.int64)
    else:
        ra, rb = np.unique(at), np.unique(to)
        both = overlaps([r["s"] for r in rows], ia[ra], ib[rb])[np.searchsorted(ra, at), np.searchsorted(rb, to)]
    out[at, to] = 100 * both >= percent * (n[ia[at]] + n[ib[to]] - both)
    return out


def overlaps(sets: list[np.ndarray], ia: np.ndarray, ib: np.ndarray, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the sets ia with the sets ib, as products of 0/1 matrices."""
    used = np.unique(np.concatenate((ia, ib)))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    every = np.concatenate([sets[i] for i in used]) if len(used) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(ia), len(ib)), np.float32)
    for start in range(0, int(shared.sum()), width):
        x, y = np.searchsorted(column, (start, start + width))
        m = np.zeros((len(used), width), np.float32)
        m[row[x:y], column[x:y] - start] = 1
        total += m[place[ia]] @ m[place[ib]].T
    if len(ia) == len(ib) and (ia == ib).all():
        np.fill_diagonal(total, 0)
    return np.rint(total).astype(np.int64)


def forest(nodes: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The least node of each row's part of a graph of rows (a square, symmetric matrix)."""
    place = np.argsort(np.argsort(nodes, kind="stable"), kind="stable")
    label = place.copy()
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(nodes)).min(axis=1, initial=len(nodes)))
        new = np.minimum(new, new[np.argsort(place)][new])
        if (new == label).all():
            return np.sort(nodes)[label]
        label = new


def _pairwise(rows: list[dict], left: np.ndarray | None, percent: int) -> np.ndarray:
    """The links of a few rows, pair by pair; of rows on either side of ``left`` only, if given."""
    out = np.zeros((len(rows), len(rows)), bool)
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            na, nb = a["n"], b["n"]
            if (left is not None and left[i] == left[j]) or 100 * min(na, nb) < percent * max(na, nb):
                continue
            level = min(a["l"], b["l"])
            if len(np.intersect1d(a["p"][a["v"] <= level], b["p"][b["v"] <= level], assume_unique=True)) >= level:
                both = nb if a["s"] is None else len(np.intersect1d(a["s"], b["s"], assume_unique=True))
                out[i, j] = out[j, i] = a["s"] is None or 100 * both >= percent * (na + nb - both)
    return out


def _meeting(rows: list[dict], left: np.ndarray | None, percent: int) -> np.ndarray:
    """The links (the candidates, if rows have no sets) of one meeting, as a symmetric matrix."""
    if len(rows) <= 8:
        return _pairwise(rows, left, percent)
    links = np.zeros((len(rows), len(rows)), bool)
    one, two = (np.arange(len(rows)),) * 2 if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    for x in range(0, len(one), BLOCK_ROWS):
        for y in range(x if left is None else 0, len(two), BLOCK_ROWS):
            i, j = one[x : x + BLOCK_ROWS], two[y : y + BLOCK_ROWS]
            links[np.ix_(i, j)] = compare([rows[k] for k in i], None if left is None and x == y else [rows[k] for k in j], percent)
    return links | links.T


def _meetings(c1: np.ndarray, c2: np.ndarray, rep: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each meeting of a batch that has two or more, by rep."""
    if not len(c1):
        return
    order = np.lexsort((rep, c2, c1))
    edges = np.flatnonzero(np.r_[True, (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0)])
    for a, b in zip(edges, [*edges[1:], len(order)]):
        if b - a > 1:
            yield order[a:b]


def _rows(frame: pd.DataFrame, at: np.ndarray, whole: bool) -> list[dict]:
    column = {c: frame[c].to_numpy() for c in ("prefix", "levels", "chosen", "n", *(["shingles"] if whole else []))}
    read = lambda c, i, kind: np.frombuffer(column[c][i], kind)
    return [{"p": read("prefix", i, np.uint64), "v": read("levels", i, np.uint8), "l": int(column["chosen"][i]), "n": int(column["n"][i]), "s": read("shingles", i, np.uint64) if whole else None} for i in at]


def _sides(c1: np.ndarray, c2: np.ndarray, cell: np.ndarray, at: np.ndarray) -> np.ndarray | None:
    return None if c1[at[0]] == c2[at[0]] else cell[at] == c1[at]


def _narrow(percent: int):
    """The seats of a batch of meetings that have a candidate there."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        c1, c2, cell, rep = (frame[c].to_numpy(np.int64) for c in ("c1", "c2", "cell", "rep"))
        out = [np.zeros(0, np.int64)]
        for at in _meetings(c1, c2, rep):
            out.append(at[_meeting(_rows(frame, at, False), _sides(c1, c2, cell, at), percent).any(axis=1)])
        return frame.iloc[np.concatenate(out)][_SEAT]

    return run


def _meet(percent: int):
    """The links of a batch of meetings."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        c1, c2, cell, rep, copies = (frame[c].to_numpy(np.int64) for c in ("c1", "c2", "cell", "rep", "copies"))
        out = [(np.zeros(0, np.int64),) * 3]
        for at in _meetings(c1, c2, rep):
            links = _meeting(_rows(frame, at, True), _sides(c1, c2, cell, at), percent)
            some = links.any(axis=1)
            if some.any():
                out.append((rep[at][some], forest(rep[at], links)[some], (links @ copies[at])[some]))
        rep_, root, linked = map(np.concatenate, zip(*out))
        return pd.DataFrame({"rep": rep_, "root": root, "linked": linked})

    return run


#: What sets of classes, and classes with the prefix shingles that others have, too, look like.
SETS = "ka long, kb long, shingles binary"
NARROW = "ka long, kb long, n long, least int, chosen int, prefix binary, levels binary"
_SEAT = ["c1", "c2", "cell", "rep", "copies", "ka", "kb", "n", "chosen", "prefix", "levels"]


def link_classes(narrow: DataFrame, classes: DataFrame, sets: Callable[[sketch.Filter], DataFrame], percent: int, rounds: int = 0) -> DataFrame:
    """Compare all classes that share a key, in cells: (rep, root, linked), a row for each class and task that found links.

    narrow has a row (NARROW) for each class of n shingles, repeats allowed, with the keys of its prefix
    that others have, too; it shares ``least`` at least with any class that it links to, and classes with
    fewer shared ones go, in ``rounds`` rounds. classes has (ka, kb, rep, copies). sets(wanted) gives the
    sets (SETS) of the classes whose ka is in the filter, of others too, and repeats are allowed.
    """
    narrow = stored(narrow.dropDuplicates(_NODE), "narrow")
    entries = stored(narrow.mapInPandas(_exploded, "t long, ka long, kb long, n long, least int"), "entries")
    for _ in range(rounds):
        shared = entries.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("t")
        entries = entries.join(shared, "t", "left_semi")
        enough = entries.groupBy(*_NODE, "least").agg(F.count(F.lit(1)).alias("m")).where("m >= least").select(*_NODE)
        entries = stored(entries.join(enough, _NODE, "left_semi"), "entries")
    buckets = entries.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    entries = stored(entries.join(buckets, "t"), "buckets")
    # A class's home is the fullest bucket that it, or a class in one of its buckets, is in: so alike classes share one.
    first = entries.groupBy(*_NODE).agg(F.max(F.struct("m", "t")).alias("home"))
    best = entries.join(first, _NODE).groupBy("t").agg(F.max("home").alias("home"))
    homes = stored(entries.join(best, "t").groupBy(*_NODE).agg(F.max("home").alias("home"), F.max("n").alias("n")).select(*_NODE, F.col("home.t").alias("home"), "n"), "homes")
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS)), F.ceil(F.sum("n") / F.lit(CELL_SHINGLES))).alias("dealt"))
    nodes = homes.join(sizes, "home").select(*_NODE, "home", F.xxhash64("home", F.pmod(F.xxhash64(*_NODE), F.col("dealt"))).alias("cell"))
    nodes = stored(nodes.join(classes, _NODE), "cells")
    placed = stored(entries.select("t", *_NODE).join(nodes.select(*_NODE, "home", "cell"), _NODE), "placed")
    in_bucket = placed.groupBy("t", "home", "cell").agg(F.count(F.lit(1)).alias("m"))
    other = in_bucket.select("t", F.col("home").alias("home2"), F.col("cell").alias("c2"))
    met = in_bucket.withColumnRenamed("cell", "c1").join(other, "t").where("c1 < c2 or c1 = c2 and m > 1")
    sides = F.explode(F.array_distinct(F.array("c1", "c2"))).alias("cell")
    # Cells of one home meet whole; cells of two homes by the classes in a bucket that both have.
    whole = nodes.select(*_NODE, "cell").join(met.where("home = home2").select("c1", "c2").distinct().select("c1", "c2", sides), "cell")
    part = placed.select("t", "cell", *_NODE).join(met.where("home <> home2").select("t", "c1", "c2", sides), ["t", "cell"]).select("cell", *_NODE, "c1", "c2").distinct()
    seats = whole.unionByName(part).join(nodes.select(*_NODE, "rep", "copies"), _NODE).join(narrow.drop("least"), _NODE)
    seats = stored(seats.select(*_SEAT), "seats")
    seats = stored(_in_batches(seats, seats, F.length("prefix") + 64, PREFIX_BATCH).applyInPandas(_narrow(percent), seats.schema), "met")
    wanted = sketch.Filter(seats.select("ka").distinct(), "ka")
    whole = sets(wanted).dropDuplicates(_NODE).join(seats, _NODE)
    found = stored(_in_batches(whole, seats, 8 * F.col("n") + 64, SET_BATCH).applyInPandas(_meet(percent), "rep long, root long, linked long"), "links")
    wanted.drop()
    return found


def _in_batches(rows: DataFrame, seats: DataFrame, size, most: int):
    """rows, grouped into batches of about ``most`` bytes: small meetings share a task's call; a meeting is bounded by its cells."""
    total = seats.agg(F.sum(size)).first()[0] or 0
    return rows.groupBy(F.pmod(F.xxhash64("c1", "c2"), F.lit(total // most + 1)).alias("batch"))


def _exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            times = [len(x) // 8 for x in frame["prefix"]]
            out = {c: np.repeat(frame[c].to_numpy(), times) for c in ("ka", "kb", "n", "least")}
            yield pd.DataFrame({"t": np.frombuffer(b"".join(frame["prefix"]), np.int64), **out})


_FIRST = "kind int, doc_id long, n_shingles long, ka long, kb long, slice int, block long, data binary"


def first_pass(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, float]:
    """(doc_id, n_shingles, ka, kb) of every document, the steps of how often shingles fall on each cell, and the mean of those counts."""
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    bits = int(np.clip(np.ceil(np.log2(max(1.0, words / COUNT_LOAD))), *COUNT_BITS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(1 << bits, "u4")
        for frame in slices(frames):
            every, cuts = text_sets(frame["text"].tolist(), k)
            ka, kb = set_keys(every, cuts)
            np.add.at(own, sketch.cell(every, bits), np.uint32(1))
            yield frame[["doc_id"]].assign(kind=0, n_shingles=np.diff(cuts), ka=ka, kb=kb, slice=None, block=None, data=None)
        if own.any():
            for part in sketch.emit(own):
                yield part.assign(kind=1, doc_id=None, n_shingles=None, ka=None, kb=None)

    both = stored(docs.mapInPandas(run, _FIRST), "first")
    base = both.where("kind = 0").select("doc_id", "n_shingles", *_NODE)
    counts = sketch.merged(both.where("kind = 1").select("slice", "block", "data"), 1 << bits, "u8", finish=steps)
    return base, counts, float(base.agg(F.sum("n_shingles")).first()[0] or 0) / (1 << bits)


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document.

    Two documents link if 100 * intersection >= percent * union of their sets of k-word shingles; a
    text of fewer words is one shingle. component_id is the least doc_id that links reach, n_links the
    number of other documents linked. Texts without words, null texts, and rows without doc_id link
    with nothing. Rows that share a doc_id are one node. Other columns are not looked at. A text is
    worked on whole by one task, in some 60 bytes of memory for each of its own.
    """
    spark = docs.sparkSession
    checkpointing(spark)
    docs = docs.select("doc_id", "text")
    base, counts, load = first_pass(docs, k)
    classes = base.where("n_shingles > 0 and doc_id is not null").groupBy(*_NODE).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    held = spark.sparkContext.broadcast(counts)
    del counts

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            every, cuts = text_sets(frame["text"].tolist(), k)
            ka, kb = set_keys(every, cuts)
            n = np.diff(cuts)
            least = least_level(need(n, percent))
            got, seen = [], set()
            for i, p, v, chosen in prefixes(every, cuts, held.value, load, percent):
                if ka[i] not in seen:
                    seen.add(ka[i])
                    got.append((ka[i], kb[i], n[i], least[i], chosen, p.tobytes(), v.tobytes()))
            if got:
                yield pd.DataFrame(got, columns=["ka", "kb", "n", "least", "chosen", "prefix", "levels"])

    every_prefix = stored(docs.mapInPandas(ends, NARROW), "prefixes")
    held.destroy()
    # A prefix shingle of one class alone makes no candidate.
    met = every_prefix.mapInPandas(_exploded, "t long, ka long, kb long, n long, least int").groupBy("t").agg(F.min("ka").alias("x"), F.max("ka").alias("y")).where("x <> y")
    live = sketch.Filter(stored(met.select("t"), "shared"), "t")

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            times = np.array([len(x) // 8 for x in frame["prefix"]])
            p, v = np.frombuffer(b"".join(frame["prefix"]), np.uint64), np.frombuffer(b"".join(frame["levels"]), np.uint8)
            on = live.has(p)
            row = np.repeat(np.arange(len(frame)), times)[on]
            p, v, cuts = p[on], v[on], np.searchsorted(row, np.arange(len(frame) + 1))
            kept = np.flatnonzero(np.diff(cuts) >= frame["least"].to_numpy())
            if len(kept):
                cut = lambda x: [x[cuts[i] : cuts[i + 1]].tobytes() for i in kept]
                yield frame.iloc[kept].assign(prefix=cut(p), levels=cut(v))

    def whole(frames: Iterator[pd.DataFrame], wanted: sketch.Filter) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            every, cuts = text_sets(frame["text"].tolist(), k)
            ka, kb = set_keys(every, cuts)
            i = np.flatnonzero(wanted.has(ka) & (np.diff(cuts) > 0))
            if len(i):
                out = pd.DataFrame({"ka": ka[i], "kb": kb[i], "shingles": [every[cuts[j] : cuts[j + 1]].tobytes() for j in i]})
                yield out.drop_duplicates(_NODE)

    narrow = every_prefix.mapInPandas(shared, NARROW)
    found = link_classes(narrow, classes, lambda wanted: docs.select("text").mapInPandas(lambda frames: whole(frames, wanted), SETS), percent, rounds=2)
    live.drop()
    parts = components(found, "rep", "root")
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    known = classes.join(linked, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(*_NODE, F.coalesce("component", "rep").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = base.join(known, _NODE, "left")
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(has, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(has, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
