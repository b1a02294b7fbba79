"""Exact top-k search by block-at-a-time pruning.

Components are small integers, dimensions are terms. A sample's widest dimensions, halved again and
again, divide the vectors into ranges of alike ones; a range is divided into blocks, each with the
largest and the least component of every term and a forward index, the matrix of its vectors. For a
query, the terms' maxima (minima, where the query is negative) sum up to a bound of every range's and
every block's scores. A query first goes to the ranges with the highest bounds; their scores raise its
k-th score, and of the other ranges it goes to those alone whose bound reaches it. In a range, blocks
are scored in descending order of bounds until a bound falls below the k-th score. Scores of a bounded
sample give a first k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilframe.llm import vectors
from perilframe.llm.common import one_thread, stored

BLOCK, RANGE, QUERIES, SAMPLE = 64, 8192, 1024, 4096
#: Ranges whose extremes lie in one row; bytes of queries sent on at once; query groups that meet one copy of a range.
EXTREMES, SENT, MEETINGS = 2048, 16 << 20, 64
_SENT = "range long, part long, salt long, q_n long, q_vectors binary, q_ids binary, q_counts binary, q_floors binary"


def quantised(v: Column, factor: int = 256) -> Column:
    return F.transform(v, lambda x: F.floor(x * factor).cast("double"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers."""
    top = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    return (a @ b.T).astype(np.int64) if top < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def in_blocks(m: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order of a range's vectors that puts alike ones into a block: by halving on the widest dimension."""
    parts, done = [np.arange(len(m))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= block:
            done.append(rows)
            continue
        x = m[rows]
        by = x[:, int(np.argmax(x.max(axis=0) - x.min(axis=0)))]
        half = len(rows) // 2 // block * block or block
        order = np.argsort(by, kind="stable")
        parts += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Ranges:
    """Ranges of alike vectors: a sample halved on its widest dimension, level after level."""

    def __init__(self, few: np.ndarray, levels: int):
        self.levels = levels
        self.by, self.cut = np.zeros(2**levels - 1, np.int64), np.full(2**levels - 1, np.inf)
        parts = [few]
        for node in range(2**levels - 1):
            x = parts[node]
            spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
            if spread.max(initial=0) > 0:
                self.by[node] = np.argmax(spread)
                values = x[:, self.by[node]]
                middle = np.partition(values, len(x) // 2)[len(x) // 2]
                self.cut[node] = middle if middle > values.min() else values[values > middle].min()
            right = x[:, self.by[node]] >= self.cut[node] if len(x) else np.zeros(0, bool)
            parts += [x[~right], x[right]]

    def place(self, m: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(m), np.int64), np.arange(len(m))
        for _ in range(self.levels):
            node = 2 * node + 1 + (m[every, self.by[node]] >= self.cut[node])
        return node - (2**self.levels - 1)


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What no score of a query with vectors between these extremes exceeds."""
    return product(np.maximum(queries, 0), most) + product(np.minimum(queries, 0), least)


def search_range(m: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, floor: np.ndarray, k: int, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, what of a range, in the order of its blocks, can be among its k best beside itself: number, ids, scores."""
    edges = np.arange(0, len(m), block)
    most, least = np.maximum.reduceat(m, edges), np.minimum.reduceat(m, edges)
    bound = bounds(queries, most, least)
    turn = np.argsort(-bound, axis=1, kind="stable")
    kth = floor.copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    active = np.arange(len(queries))
    for step in range(len(edges)):
        at = turn[active, step]
        go = bound[active, at] >= kth[active]
        active, at = active[go], at[go]
        if not len(active):
            break
        for b in np.unique(at):
            mine = active[at == b]
            rows = np.arange(edges[b], min(edges[b] + block, len(m)))
            scores = product(queries[mine], m[rows])
            for q, s in zip(mine, scores):
                good = s >= kth[q]
                if good.any():
                    r, v = np.concatenate((best[q][0], rows[good])), np.concatenate((best[q][1], s[good]))
                    if len(v) > k + 1:
                        # k + 1 vectors: one may be the query's own. Equal scores stay, for the ties.
                        kth[q] = max(kth[q], np.partition(v, len(v) - k - 1)[len(v) - k - 1])
                        r, v = r[v >= kth[q]], v[v >= kth[q]]
                    best[q] = (r, v)
    for q, (r, v) in enumerate(best):
        if len(r):
            all_ids = np.concatenate([ids[i] for i in r])
            scores = np.repeat(v, [len(ids[i]) for i in r])
            top = np.lexsort((all_ids, -scores))[: k + 1]
            yield q, all_ids[top], scores[top]


def _first_floors(q: np.ndarray, few: np.ndarray, floors: np.ndarray, k: int) -> np.ndarray:
    """The k-th scores known so far, or of the sample if they are higher. One of the sample may be the query's own."""
    if len(few) <= k:
        return floors
    return np.maximum(floors, np.partition(product(q, few), len(few) - k - 1, axis=1)[:, len(few) - k - 1])


def search(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to smaller vec_id.

    Queries are rows whose vec_id is divisible by ``every``. Vectors that are null, hold null or
    non-finite components, or have another length than most, and rows without vec_id, take no part;
    vectors of one vec_id are candidates of their own, but not for a query of that vec_id.
    """
    spark = df.sparkSession
    rows = stored(vectors.usable(df, zero=True).select("vec_id", quantised(F.col("v")).alias("v")), "vectors")
    things = stored(vectors.distinct(rows, k + 1), "distinct")
    n = things.count()
    sample = vectors.sample(things, SAMPLE)
    few = spark.sparkContext.broadcast((sample, Ranges(sample, min((max(1, -(-n // RANGE)) - 1).bit_length(), (SAMPLE // 8).bit_length() - 1))))
    blocks = stored(_ranges(things, few, n), "ranges")
    extremes = stored(_extremes(blocks), "extremes")
    asked = stored(rows.where(F.col("vec_id") % every == 0).groupBy("v").agg(F.collect_set("vec_id").alias("ids")), "queries")
    groups = max(1, -(-asked.count() // QUERIES))

    def meet(queries: DataFrame, first: bool) -> DataFrame:
        queries = vectors.packed(queries.withColumn("group", F.pmod(F.xxhash64("v"), F.lit(groups))), "group", QUERIES, n, floors=True)
        return _scores(_sent(queries, extremes, few, k, first, groups), blocks, k, groups)

    before = stored(meet(asked.withColumn("floor", F.lit(np.iinfo(np.int64).min)), True), "first")
    kth = vectors.ranked(before, k, "long").where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    known = asked.select("v", F.explode("ids").alias("id")).join(kth, "id", "left").groupBy("v")
    known = known.agg(F.collect_set("id").alias("ids"), F.min(F.coalesce("kth", F.lit(np.iinfo(np.int64).min))).alias("floor"))
    return vectors.ranked(before.unionByName(meet(known, False)), k, "long")


def _ranges(things: DataFrame, few: Broadcast, n: int) -> DataFrame:
    """Rows of about RANGE vectors of one range, in the order of their blocks."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(range=few.value[1].place(vectors.matrix(frame["v"])))

    def arrange(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                m, ids = vectors.unpack(r.n, r.vectors, r.ids, r.counts)
                order = in_blocks(m)
                ids = [ids[i] for i in order]
                sizes = np.array([len(x) for x in ids], np.int64)
                yield pd.DataFrame({"range": [r.range], "part": [r.part], "n": [r.n], "vectors": [m[order].tobytes()], "ids": [np.concatenate(ids).tobytes()], "counts": [sizes.tobytes()]})

    placed = things.mapInPandas(place, "v array<double>, ids array<long>, range long")
    return vectors.packed(placed, "range", RANGE, n).mapInPandas(arrange, "range long, part long, n long, vectors binary, ids binary, counts binary")


def _extremes(blocks: DataFrame) -> DataFrame:
    """(bunch, ranges, parts, most, least): the largest and least components of many ranges, as arrays of a row."""
    bunches = max(1, -(-blocks.count() // EXTREMES))

    def extremes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            m = [np.frombuffer(v, np.float64).reshape(n, -1) for n, v in zip(frame["n"], frame["vectors"])]
            yield frame[["range", "part"]].assign(most=[x.max(axis=0).tobytes() for x in m], least=[x.min(axis=0).tobytes() for x in m])

    def bunch(frame: pd.DataFrame) -> pd.DataFrame:
        out = {"ranges": frame["range"].to_numpy(np.int64).tobytes(), "parts": frame["part"].to_numpy(np.int64).tobytes(), "most": b"".join(frame["most"]), "least": b"".join(frame["least"])}
        return pd.DataFrame({"bunch": frame["bunch"].iloc[:1].array} | {name: [x] for name, x in out.items()})

    rows = blocks.select("range", "part", "n", "vectors").mapInPandas(extremes, "range long, part long, most binary, least binary")
    rows = rows.withColumn("bunch", F.pmod(F.xxhash64("range", "part"), F.lit(bunches)))
    return rows.groupBy("bunch").applyInPandas(bunch, "bunch long, ranges binary, parts binary, most binary, least binary")


def _sent(queries: DataFrame, extremes: DataFrame, few: Broadcast, k: int, first: bool, groups: int) -> DataFrame:
    """Packed queries for the ranges they have to be scored in: the first of a bunch, or those after it."""
    salts = -(-groups // MEETINGS)

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        out, size = [], 0
        for frame in frames:
            for r in frame.itertuples(index=False):
                q, q_ids = vectors.unpack(r.n, r.vectors, r.ids, r.counts)
                most, least = (np.frombuffer(x, np.float64).reshape(-1, q.shape[1]) for x in (r.most, r.least))
                ranges, parts = np.frombuffer(r.ranges, np.int64), np.frombuffer(r.parts, np.int64)
                floors = _first_floors(q, few.value[0], np.frombuffer(r.floors, np.int64), k)
                limit = bounds(q, most, least)
                goes = limit >= floors[:, None]
                best = np.zeros_like(goes)
                best[np.arange(len(q)), limit.argmax(axis=1)] = True
                goes &= best if first else ~best
                for at in np.flatnonzero(goes.any(axis=0)):
                    mine = np.flatnonzero(goes[:, at])
                    ids = [q_ids[i] for i in mine]
                    data = q[mine].tobytes()
                    out.append((ranges[at], parts[at], (r.group + r.part) % salts, len(mine), data, np.concatenate(ids).tobytes(), np.array([len(x) for x in ids], np.int64).tobytes(), floors[mine].tobytes()))
                    size += len(data)
                    if size > SENT:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in _SENT.split(", ")]
    bunches = extremes.select("bunch").distinct().count()
    to = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, bunches) - 1).cast("long")))
    return queries.withColumn("bunch", to).join(extremes, "bunch").mapInPandas(bound, _SENT)


def _scores(sent: DataFrame, blocks: DataFrame, k: int, groups: int) -> DataFrame:
    """(query_id, vec_id, score): what can be among the k best of the queries sent to each range."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for frame in frames:
            for r in frame.itertuples(index=False):
                q, q_ids = vectors.unpack(r.q_n, r.q_vectors, r.q_ids, r.q_counts)
                m, ids = vectors.unpack(r.n, r.vectors, r.ids, r.counts)
                yield vectors.expand(search_range(m, ids, q, np.frombuffer(r.q_floors, np.int64), k), q_ids).astype("int64")

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["range", "part", "salt"]
    copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-groups // MEETINGS) - 1).cast("long"))))
    pairs = copies.repartition(tasks, *keys).join(sent.repartition(tasks, *keys), keys)
    return pairs.mapInPandas(run, "query_id long, vec_id long, score long")
