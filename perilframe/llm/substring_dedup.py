"""Substring deduplication across documents: paragraph MinHash banding, and anchored passages.

Paragraphs are lines of ``MIN_WORDS`` words or more, and blocks of several lines between blank ones, so
that wrapped text is compared too. Their MinHash is cut into bands, of which ``bands`` finds the number
of rows and of bands that reaches a stated recall at the threshold. Paragraphs that collide in a band
are compared on their whole sets of five-word shingles; links of 0.8 or more make components. A set of
fewer than ``LEAST_NEAR`` shingles links to no other set than its equal, and takes no bands.

A passage inside longer lines has no paragraph of its own, so texts are also read as windows of
``PASSAGE`` words that start at anchors, the words whose hash is least among ``ANCHORS`` neighbours:
any run of PASSAGE + ANCHORS - 1 words that two documents share has a window in both, which begins and
one that ends fewer than ANCHORS words from the run's ends. Windows at the ends of a stretch are
lengthened word by word, as far as the kept copy has the same words.

Of each component and each window the copy of the least document (its first one there) is kept, the
others are removed, but for paragraphs that overlap the kept one (a block's own lines).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilframe.llm import sketch
from perilframe.llm.common import Words, checkpointing, distinct_slices, mix, shingle, signed, slices, stored
from perilframe.llm.graph import components
from perilframe.llm.jaccard_join import NARROW, SETS, link_classes

SHINGLE, PERCENT, RECALL = 5, 80, 0.99
MIN_WORDS = SHINGLE
#: The least m that another set may link to: m of m + 1 shingles reach PERCENT.
LEAST_NEAR = -(-PERCENT // (100 - PERCENT))
PASSAGE, ANCHORS = 25, 16
_NODE = ["ka", "kb"]


def bands(percent: int = PERCENT, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """(rows, bands) with the most rows such that no more than ``most`` hashes reach the recall at the threshold."""
    best = (1, 1)
    for r in range(1, 17):
        b = 1
        while 1 - (1 - (percent / 100) ** r) ** b < recall:
            b += 1
        if r * b <= most:
            best = (r, b)
    return best


ROWS, BANDS = bands(most=40)
_ODD = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Units(Words):
    """Paragraphs and passages of a batch of texts."""

    def __init__(self, texts: Sequence[str | None]):
        super().__init__(texts)
        feeds = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 0x0A)
        line = np.searchsorted(feeds, self.starts)
        edge = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        last = np.r_[edge[1:], len(line)].astype(np.int64)
        # Blocks end where a line without words, or another text, comes before the next line.
        apart = (line[edge[1:]] - line[edge[:-1]] > 1) | (self.text[edge[1:]] != self.text[edge[:-1]])
        head = np.flatnonzero(np.r_[True, apart]) if len(edge) else edge
        tail = np.r_[head[1:], len(edge)].astype(np.int64) - 1
        several = tail > head
        first, last = np.r_[edge, edge[head[several]]], np.r_[last, last[tail[several]]]
        kept = last - first >= MIN_WORDS
        self.first, self.last = first[kept], last[kept]
        self.paragraph_text = self.text[self.first]

    def paragraph_sets(self) -> tuple[np.ndarray, np.ndarray]:
        """All paragraphs' distinct shingles, paragraph after paragraph and sorted, and where each begins."""
        n = self.last - self.first - SHINGLE + 1
        cuts = np.r_[0, np.cumsum(n)]
        if not len(n):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.arange(cuts[-1]) + np.repeat(self.first - cuts[:-1], n)
        every, cuts = distinct_slices(shingle(self.words, SHINGLE)[at], cuts)
        return every, cuts[:-1]

    def anchors(self) -> np.ndarray:
        """First words of the passages: the least hashes of every ANCHORS neighbouring places in a text.

        A text's last PASSAGE - 1 words start no passage, so no window of places meets two texts.
        """
        n = len(self.words)
        if n < PASSAGE:
            return np.zeros(0, np.int64)
        top = np.uint64(2**64 - 1)
        starts = np.r_[self.text[PASSAGE - 1 :] == self.text[: n - PASSAGE + 1], np.zeros(PASSAGE - 1, bool)]
        h = np.where(starts, mix(self.words ^ np.uint64(0x1234_5678_9ABC_DEF1)), top)
        h = np.r_[np.full(ANCHORS, top), h, np.full(ANCHORS, top)]
        chosen = np.zeros(len(h), bool)
        view = np.lib.stride_tricks.sliding_window_view(h, ANCHORS)
        for a in range(0, len(view), 1 << 16):
            part = view[a : a + (1 << 16)]
            chosen[np.argmin(part, axis=1) + np.arange(a, a + len(part))] = True
        return np.flatnonzero(chosen[ANCHORS : ANCHORS + n] & starts)

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors, and hashes of the PASSAGE words from each."""
        at = self.anchors()
        out = np.zeros(len(at), np.uint64)
        for i in range(PASSAGE):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.words[at + i]
        return at, mix(out ^ np.uint64(0x51))

    def beside(self, at: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """For passages at these words: half the hashes of the ANCHORS - 1 words on a side, nearest first, and where each ends (the end of its text) in characters.

        Beyond the text's ends, hashes are all different ones.
        """
        k = np.arange(1, ANCHORS)[None, :]
        word = at[:, None] - k if left else at[:, None] + PASSAGE - 1 + k
        inside = (word >= 0) & (word < len(self.words))
        word = np.clip(word, 0, len(self.words) - 1)
        inside &= self.text[word] == self.text[at][:, None]
        word = np.where(inside, word, at[:, None])
        flat = word.ravel()
        start, length = self.spans(flat, flat)
        to = (start if left else start + length).reshape(word.shape)
        half = (self.words[word] >> np.uint64(33)).astype(np.uint32)
        return np.where(inside, half, np.uint32(2**31) + np.uint32(left)), to.astype(np.int32)

    def spans(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters before each span in its text, and in it; spans go from word first to word last."""
        begins = np.cumsum((np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80)
        before = lambda at: np.where(at > 0, begins[at - 1], 0)
        a, z = self.starts[first], self.ends[last]
        return before(a) - before(self.origin[self.text[first]]), before(z) - before(a)


def keys(every: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ka and kb of each set."""
    return tuple(np.add.reduceat(mix(every ^ np.uint64(x)), at) for x in (0, 0x7C3A91E5D2B86F04))


def band_keys(every: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The MinHash band keys of each set: one row for a set."""
    out = np.zeros((len(at), BANDS), np.uint64)
    for k, odd in enumerate(_ODD):
        least = np.minimum.reduceat(every * odd, at)
        band = k // ROWS
        out[:, band] = out[:, band] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(band + 1)
    return mix(out)


_UNIT = "kind int, doc_id long, start long, length long, t long, ka long, kb long, n long, bands array<long>"


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(t, x): a band and the paragraph's set, a set or a passage and the document."""
    for frame in slices(frames):
        docs, u = frame["doc_id"].to_numpy(np.int64), Units(frame["text"].tolist())
        at, h = u.passages()
        t, x = [signed(h)], [docs[u.text[at]]]
        every, begin = u.paragraph_sets()
        if len(begin):
            ka, _ = keys(every, begin)
            near = np.diff(np.r_[begin, len(every)]) >= LEAST_NEAR
            t += [signed(band_keys(every, begin)[near].ravel()), signed(mix(ka))]
            x += [signed(np.repeat(ka[near], BANDS)), docs[u.paragraph_text]]
        t, x = np.concatenate(t), np.concatenate(x)
        if len(t):
            yield pd.DataFrame({"t": t, "x": x})


def _units(live):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            docs, u = frame["doc_id"].to_numpy(np.int64), Units(frame["text"].tolist())
            every, begin = u.paragraph_sets()
            if len(begin):
                ka, kb = keys(every, begin)
                b = band_keys(every, begin)
                near = np.diff(np.r_[begin, len(every)]) >= LEAST_NEAR
                on = live.has(signed(b.ravel())).reshape(b.shape) & near[:, None]
                i = np.flatnonzero(on.any(axis=1) | live.has(signed(mix(ka))))
                start, length = u.spans(u.first[i], u.last[i] - 1)
                n = np.diff(np.r_[begin, len(every)])[i]
                if len(i):
                    yield pd.DataFrame({"kind": 0, "doc_id": docs[u.paragraph_text[i]], "start": start, "length": length, "t": 0, "ka": signed(ka)[i], "kb": signed(kb)[i], "n": n, "bands": [x[y] for x, y in zip(signed(b[i]), on[i])]})
            at, h = u.passages()
            i = np.flatnonzero(live.has(signed(h)))
            start, length = u.spans(at[i], at[i] + PASSAGE - 1)
            none = np.zeros(0, np.int64)
            if len(i):
                yield pd.DataFrame({"kind": 1, "doc_id": docs[u.text[at[i]]], "start": start, "length": length, "t": signed(h)[i], "ka": 0, "kb": 0, "n": 0, "bands": [none] * len(i)})

    return run


def _sets(frames: Iterator[pd.DataFrame], wanted: sketch.Filter) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        every, begin = Units(frame["text"].tolist()).paragraph_sets()
        if not len(begin):
            continue
        ka, kb = map(signed, keys(every, begin))
        end = np.r_[begin[1:], len(every)]
        i = np.flatnonzero(wanted.has(ka))
        if len(i):
            yield pd.DataFrame({"ka": ka[i], "kb": kb[i], "shingles": [every[begin[j] : end[j]].tobytes() for j in i]}).drop_duplicates(_NODE)


def _narrow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A paragraph's bands that other sets have, too, as a prefix of which one shared key is enough."""
    for frame in frames:
        bands_ = [np.asarray(x, np.int64) for x in frame["bands"]]
        yield frame[["ka", "kb", "n"]].assign(least=1, chosen=1, prefix=[x.tobytes() for x in bands_], levels=[bytes([1]) * len(x) for x in bands_])


def repeats(docs: DataFrame) -> DataFrame:
    """A row for each paragraph, and each stretch of passages, that another document repeats.

    doc_id, start and length (characters), kind (paragraph or passage), kept_doc_id (the least document
    of its component or passage) and removed (false for the kept copy). Null texts and rows without
    doc_id have none; rows that share a doc_id are one document. Of no rows it makes none; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    checkpointing(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    shared = stored(docs.mapInPandas(_keys, "t long, x long").groupBy("t").agg(F.min("x").alias("x"), F.max("x").alias("y")).where("x <> y"), "shared")
    live = sketch.Filter(shared, "t")
    units = stored(docs.mapInPandas(_units(live), _UNIT), "units")
    live.drop()

    paragraphs = units.where("kind = 0").select("doc_id", "start", "length", "ka", "kb", "n", "bands")
    narrow = paragraphs.where("size(bands) > 0").select(*_NODE, "n", "bands").dropDuplicates(_NODE).mapInPandas(_narrow, NARROW)
    classes = paragraphs.select(*_NODE, F.col("ka").alias("rep"), F.lit(1).cast("long").alias("copies")).distinct()
    found = link_classes(narrow, classes, lambda wanted: docs.select("text").mapInPandas(partial(_sets, wanted=wanted), SETS), PERCENT)
    parts = components(found, "rep", "root").withColumnRenamed("node", "ka")
    joined = paragraphs.join(parts, "ka", "left").select("doc_id", "start", "length", F.coalesce("component", "ka").alias("component"))
    joined = stored(joined, "paragraphs")
    kept = joined.groupBy("component").agg(F.min(F.struct("doc_id", "start", (-F.col("length")).alias("less"))).alias("kept"), F.max("doc_id").alias("last")).where("kept.doc_id <> last")
    # A block and its own lines may be alike: what overlaps the kept copy stays with it.
    inside = (F.col("doc_id") == F.col("kept.doc_id")) & (F.col("start") < F.col("kept.start") - F.col("kept.less"))
    paragraphs = joined.join(kept, "component").select("doc_id", "start", "length", F.lit("paragraph").alias("kind"), F.col("kept.doc_id").alias("kept_doc_id"), (~inside).alias("removed"))

    windows = units.where("kind = 1").select("t", "doc_id", "start", (F.col("start") + F.col("length")).alias("end"))
    windows = windows.join(shared, "t").select("t", "doc_id", "start", "end", F.col("x").alias("kept_doc_id"), (F.col("doc_id") != F.col("x")).alias("removed"))
    return paragraphs.unionByName(_stretches(_lengthened(docs, stored(windows, "windows"))))


_BESIDE = "t long, doc_id long, start long, left boolean, words binary, to binary"


def _beside(ends: sketch.Filter):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            docs, u = frame["doc_id"].to_numpy(np.int64), Units(frame["text"].tolist())
            at, h = u.passages()
            doc = docs[u.text[at]] if len(at) else at
            own, _ = u.spans(at, at + PASSAGE - 1)
            i = np.flatnonzero(ends.has(signed(mix(h ^ doc.view(np.uint64)))))
            for left in (True, False) if len(i) else ():
                words, to = u.beside(at[i], left)
                yield pd.DataFrame({"t": signed(h)[i], "doc_id": doc[i], "start": own[i], "left": left, "words": [x.tobytes() for x in words], "to": [x.tobytes() for x in to]})

    return run


def _agreed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How far a passage and the kept copy have the same words beside them: (t, doc_id, start, left, to), a row for either."""
    for frame in frames:
        if not len(frame):
            continue
        read = lambda c, kind: np.frombuffer(b"".join(frame[c]), kind).reshape(len(frame), ANCHORS - 1)
        same = np.cumprod(read("words", np.uint32) == read("kept_words", np.uint32), axis=1).sum(axis=1)
        i = np.flatnonzero(same > 0)
        for own in ("", "kept_"):
            to = read(f"{own}to", np.int32)[i, same[i] - 1].astype(np.int64)
            yield pd.DataFrame({"t": frame["t"].iloc[i], "doc_id": frame[f"{own}doc_id"].iloc[i], "start": frame[f"{own}start"].iloc[i], "left": frame["left"].iloc[i], "to": to})


def _lengthened(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """windows, those at the ends of removed stretches with the words beside them that the kept copy has, too, and so that copy.

    Words are compared by 31 bits of their hashes, from the passage on until two differ.
    """
    own = Window.partitionBy("doc_id", "removed").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, 0))
    first, last = F.coalesce(F.col("start") > before, F.lit(True)), F.coalesce(F.lead("start").over(own) > reached, F.lit(True))
    ends = windows.where("removed").withColumn("first", first).withColumn("last", last).where("first or last")
    ends = stored(ends.select("t", "doc_id", "start", "kept_doc_id", "first", "last").distinct(), "ends")
    either = ends.select("t", "doc_id").unionByName(ends.select("t", F.col("kept_doc_id").alias("doc_id"))).distinct()
    # The same mixing as in _beside, of the hash and the document.
    keyed = stored(either.mapInPandas(_mixed, "h long"), "keyed")
    known = sketch.Filter(keyed, "h")
    sides = stored(docs.mapInPandas(_beside(known), _BESIDE), "beside")
    known.drop()
    # The kept copy's first passage of that hash.
    kept = ends.select("t", F.col("kept_doc_id").alias("doc_id")).distinct().join(sides, ["t", "doc_id"]).groupBy("t", "left").agg(F.min(F.struct("start", "words", "to", "doc_id")).alias("kept"))
    wanted = ends.select("t", "doc_id", "start", F.explode(F.array(F.when(F.col("first"), F.lit(True)), F.when(F.col("last"), F.lit(False)))).alias("left")).where("left is not null")
    pairs = wanted.join(sides, ["t", "doc_id", "start", "left"]).join(kept.select("t", "left", *(F.col(f"kept.{c}").alias(f"kept_{c}") for c in ("start", "words", "to", "doc_id"))), ["t", "left"])
    found = pairs.mapInPandas(_agreed, "t long, doc_id long, start long, left boolean, to long")
    found = found.groupBy("t", "doc_id", "start").agg(F.min(F.when(F.col("left"), F.col("to"))).alias("from"), F.max(F.when(~F.col("left"), F.col("to"))).alias("to"))
    out = windows.join(found, ["t", "doc_id", "start"], "left")
    return out.select("doc_id", F.coalesce("from", "start").alias("start"), F.coalesce("to", "end").alias("end"), "kept_doc_id", "removed")


def _mixed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        t, doc = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("t", "doc_id"))
        yield pd.DataFrame({"h": signed(mix(t ^ doc))})


def _stretches(windows: DataFrame) -> DataFrame:
    """Windows of a document that overlap and are kept or removed alike, as one stretch."""
    own = Window.partitionBy("doc_id", "removed").orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = windows.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy("doc_id", "removed", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept_doc_id").alias("kept_doc_id"))
    return out.select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"), F.lit("passage").alias("kind"), "kept_doc_id", "removed")


def cut(docs: DataFrame) -> DataFrame:
    """docs without the removed stretches; documents of which only white space is left go. n_chars follows."""
    gone_ = "_" * (1 + max(map(len, docs.columns))) + "gone"  # no column of the caller's
    gone = repeats(docs).where("removed").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(gone_))
    # Characters from the end of one stretch to the start of the next.
    folded = F.aggregate(
        gone_,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, g: F.struct(
            F.greatest(s["at"], g["start"] + g["length"]).alias("at"),
            F.concat(s["out"], F.when(g["start"] > s["at"], F.substring(F.col("text"), s["at"].cast("int") + 1, (g["start"] - s["at"]).cast("int"))).otherwise(F.lit(""))).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"].cast("int") + 1, F.length("text"))),
    )
    out = docs.join(gone, "doc_id", "left").withColumn("text", F.when(F.col(gone_).isNull(), F.col("text")).otherwise(folded))
    touched = F.col(gone_).isNotNull()
    out = out.where(~touched | F.col("text").rlike(r"\S")).withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
